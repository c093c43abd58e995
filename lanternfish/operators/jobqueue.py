"""A queue of leased jobs as a state machine over events.

Events of a job are replayed in order: seed, claim, progress, complete, release, fail, requeue, stats. Leases that have run out are taken back when somebody claims or asks for the counts, and at no other
event: a worker whose lease is over may still report and finish as long as nobody took the job. A claim takes a pending job; after ``most_attempts`` attempts a job whose lease runs out fails for good
instead. Only the worker that holds a job changes it. Progress keeps the old cursor where it brings none. A job's events depend on each other, so they pass in order
through one iterator of their partition; batches stream, and no job's history is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "claimed", "done", "failed")
STATE = "job long, state string, worker long, attempts int, produced double, lease_until double, cursor string, refused int"


class Job:
    """State of one job."""

    def __init__(self, job: int) -> None:
        self.job, self.state, self.worker, self.attempts, self.produced, self.lease, self.cursor, self.refused = job, None, None, 0, 0.0, 0.0, None, 0

    def expire(self, now: float, most_attempts: int) -> None:
        if self.state == "claimed" and self.lease < now:
            self.state, self.worker, self.lease = ("failed", self.worker, self.lease) if self.attempts >= most_attempts else ("pending", None, 0.0)

    def apply(self, kind: str, worker: int, amount: float, now: float, lease: float, most_attempts: int, cursor: str | None = None) -> None:
        if kind in ("claim", "stats"):
            self.expire(now, most_attempts)
        if kind == "stats":
            return
        if kind == "seed":
            self.state = self.state or "pending"
        elif kind == "claim" and self.state == "pending":
            self.state, self.worker, self.attempts, self.lease = "claimed", worker, self.attempts + 1, now + lease
        elif kind == "requeue" and self.state == "failed":
            self.state, self.worker, self.attempts, self.lease = "pending", None, 0, 0.0
        elif kind in ("progress", "complete", "release", "fail") and self.state == "claimed" and self.worker == worker:
            if kind == "progress":
                self.produced, self.lease, self.cursor = self.produced + max(0.0, amount), now + lease, cursor if cursor is not None else self.cursor
            else:
                self.state, self.worker, self.lease = {"complete": "done", "release": "pending", "fail": "failed"}[kind], None, 0.0
        else:
            self.refused += 1

    def row(self) -> tuple:
        return self.job, self.state, self.worker, self.attempts, self.produced, self.lease, self.cursor, self.refused


def replay(events: DataFrame, lease: float = 900.0, most_attempts: int = 8) -> DataFrame:
    """Final state of each job of the events (job, at, seq, kind, worker, amount, cursor)."""
    columns = ["job", "at", "seq", "kind", "worker", "amount", "cursor"]
    rows = events.select(*columns).repartition("job").sortWithinPartitions("job", "at", "seq")
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job = None
        for batch in batches:
            done = []
            for key, at, _, kind, worker, amount, cursor in batch[columns].itertuples(index=False):
                if job is None or job.job != key:
                    if job is not None:
                        done.append(job.row())
                    job = Job(key)
                job.apply(kind, worker, amount, at, lease, most_attempts, cursor)
            yield pd.DataFrame(done, columns=names).astype({"worker": "Int64"})
        if job is not None:
            yield pd.DataFrame([job.row()], columns=names).astype({"worker": "Int64"})

    return rows.mapInPandas(run, STATE)


def expired(jobs: DataFrame, now: float, most_attempts: int = 8) -> DataFrame:
    """The table of jobs after leases that have run out are returned, or given up after too many attempts."""
    dead = (F.col("state") == "claimed") & (F.col("lease_until") < now)
    spent = dead & (F.col("attempts") >= most_attempts)
    back = dead & ~spent
    return jobs.withColumns({
        "reason": F.when(spent, "lease expired too many times").otherwise(F.col("reason")), "worker": F.when(back, None).otherwise(F.col("worker")),
        "lease_until": F.when(back, 0.0).otherwise(F.col("lease_until")), "updated_at": F.when(dead, now).otherwise(F.col("updated_at")),
        "state": F.when(spent, "failed").when(back, "pending").otherwise(F.col("state")),
    })


def claimed(jobs: DataFrame, worker: str, now: float, lease: float = 900.0, most_attempts: int = 8) -> DataFrame:
    """One row per build: the job a worker gets next, the oldest pending one after expiry, flattened for the worker."""
    first = expired(jobs, now, most_attempts).where("state = 'pending'").groupBy("build").agg(F.min_by(F.struct("id", "unit", "cursor", "attempts"), "id").alias("j"))
    return first.select("build", F.col("j.id").alias("id"), F.col("j.unit").alias("unit"), F.coalesce("j.cursor", F.lit("{}")).alias("continue"), (F.col("j.attempts") + 1).alias("attempts"), F.lit(worker).alias("worker"), F.lit(now + lease).alias("lease_until"))


def counts(jobs: DataFrame, now: float, most_attempts: int = 8) -> DataFrame:
    """(build, pending, claimed, done, failed, produced) after expiry."""
    rows = expired(jobs, now, most_attempts)
    return rows.groupBy("build").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.coalesce(F.sum("produced"), F.lit(0)).alias("produced"))


def seeded(jobs: DataFrame, units: DataFrame) -> DataFrame:
    """Units (build, unit_hash, unit) that are not in the queue yet, each once: what an idempotent seed inserts."""
    new = units.join(jobs.select("build", "unit_hash"), ["build", "unit_hash"], "left_anti")
    return new.groupBy("build", "unit_hash").agg(F.min("unit").alias("unit"))


def flattened(claims: DataFrame, fields: list[str]) -> DataFrame:
    """Claims with the fields of their unit beside id, continue (the cursor, {} without one) and attempts, as a worker gets them; of a broken unit all fields are null."""
    read = F.when(F.try_parse_json("unit").isNotNull(), F.from_json("unit", "map<string,string>"))
    out = claims.withColumn("_unit", read)
    return out.select("id", "continue", "attempts", *[F.try_element_at("_unit", F.lit(f)).alias(f) for f in fields])


def shard_label(unit: Column) -> Column:
    """A short name of a job's shard: its start, else topic, licence and band as JSON."""
    good = F.when(F.try_parse_json(unit).isNotNull(), unit)
    field = lambda n: F.get_json_object(good, f"$.{n}").alias(n)
    return F.coalesce(F.get_json_object(good, "$.start"), F.to_json(F.struct(field("topic"), field("lic"), field("band")), {"ignoreNullFields": "false"}))
