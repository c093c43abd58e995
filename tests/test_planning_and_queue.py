from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.operators import jobqueue as Q
from lanternfish.operators import planning as P


def test_ranges_cover_all_names_once(spark):
    rows = P.name_ranges(spark).orderBy("lower").collect()
    assert len(rows) == 713 and rows[0].lower == "" and rows[-1].upper is None
    assert all(a.upper == b.lower for a, b in zip(rows, rows[1:], strict=False))


def test_packing_laws(spark):
    units = spark.createDataFrame([(f"t{i:03d}", 10_000.0 if i < 8 else 800.0 / 16) for i in range(200)], "topic string, weight double")
    rows = P.balanced(units, ["topic"], "weight", 40).collect()
    assert sorted(r.topic for r in rows) == sorted(r.topic for r in units.collect())
    load = [sum(r.weight for r in rows if r.lane == i) for i in range(40)]
    assert min(load) > 0 and max(load) <= 4 / 3 * max(10_000, sum(load) / 40)
    assert rows == P.balanced(units, ["topic"], "weight", 40).collect()


def replay(spark, *events, **how):
    rows = [(1, float(at), i, kind, worker, float(amount), cursor[0] if cursor else None) for i, (at, kind, worker, amount, *cursor) in enumerate(events)]
    return Q.replay(spark.createDataFrame(rows, "job long, at double, seq long, kind string, worker long, amount double, cursor string"), **how).first()


def test_claim_progress_complete(spark):
    r = replay(spark, (0, "seed", 0, 0), (1, "seed", 0, 0), (2, "claim", 7, 0), (3, "progress", 7, 5), (4, "progress", 7, -3), (5, "complete", 7, 0))
    assert (r.state, r.worker, r.attempts, r.produced, r.refused) == ("done", None, 1, 5.0, 0)


def test_only_the_owner_changes_a_job(spark):
    r = replay(spark, (0, "seed", 0, 0), (1, "claim", 7, 0), (2, "progress", 8, 5), (3, "complete", 8, 0))
    assert (r.state, r.worker, r.produced, r.refused) == ("claimed", 7, 0.0, 2)


def test_lease_runs_out(spark):
    r = replay(spark, (0, "seed", 0, 0), (1, "claim", 7, 0), (1000, "claim", 8, 0), lease=900.0)
    assert (r.state, r.worker, r.attempts) == ("claimed", 8, 2)


def test_poisoned_job_is_given_up_and_requeued(spark):
    events = [(0, "seed", 0, 0), (1, "claim", 7, 0), (1000, "claim", 7, 0), (3000, "claim", 7, 0)]
    assert replay(spark, *events, lease=900.0, most_attempts=2).state == "failed"
    r = replay(spark, *events, (3001, "requeue", 0, 0), (3002, "claim", 9, 0), lease=900.0, most_attempts=2)
    assert (r.state, r.worker, r.attempts) == ("claimed", 9, 1)


def test_release_keeps_attempts(spark):
    r = replay(spark, (0, "seed", 0, 0), (1, "claim", 7, 0), (2, "release", 7, 0))
    assert (r.state, r.attempts) == ("pending", 1)


def test_seed_is_idempotent(spark):
    jobs = spark.createDataFrame([("b", "h1", "u")], "build string, unit_hash string, unit string")
    units = spark.createDataFrame([("b", "h1", "u"), ("b", "h2", "v"), ("b", "h2", "v")], "build string, unit_hash string, unit string")
    new = Q.seeded(jobs, units)
    assert [tuple(r) for r in new.collect()] == [("b", "h2", "v")]
    assert Q.seeded(jobs.unionByName(new), units).count() == 0


def test_late_progress_of_the_owner_counts(spark):
    """A lease that has run out is taken back by a claim or the counts only; until then its worker may go on."""
    events = [(0, "seed", 0, 0), (1, "claim", 7, 0), (5000, "progress", 7, 4), (5001, "complete", 7, 0)]
    r = replay(spark, *events, lease=900.0)
    assert (r.state, r.produced, r.refused) == ("done", 4.0, 0)
    r = replay(spark, *events[:2], (4000, "stats", 0, 0), *events[2:], lease=900.0)
    assert (r.state, r.produced, r.refused) == ("pending", 0.0, 2)
    r = replay(spark, *events[:2], (4000, "claim", 8, 0), (4001, "progress", 7, 4), lease=900.0)
    assert (r.worker, r.produced, r.refused) == (8, 0.0, 1)


def test_progress_keeps_the_cursor_it_does_not_replace(spark):
    r = replay(spark, (0, "seed", 0, 0), (1, "claim", 7, 0), (2, "progress", 7, 1, "c1"), (3, "progress", 7, 1), (4, "release", 7, 0), (5, "claim", 8, 0))
    assert (r.cursor, r.produced, r.worker, r.attempts) == ("c1", 2.0, 8, 2)
    assert replay(spark, (0, "seed", 0, 0), (1, "claim", 7, 0), (2, "progress", 7, 1, "c1"), (3, "progress", 7, 1, "c2")).cursor == "c2"


def test_units_are_flat_for_workers(spark):
    df = spark.createDataFrame([(1, '{"topic":"a","lic":"b"}', None, 0), (2, "{broken", '{"x":1}', 3), (3, '{"start":"A","end":"B"}', None, 1)], "id long, unit string, cursor string, attempts int")
    rows = {r.id: r for r in Q.flattened(df.withColumn("continue", F.coalesce("cursor", F.lit("{}"))), ["topic", "start"]).collect()}
    assert (rows[1].topic, rows[1]["continue"], rows[2].topic, rows[2]["continue"], rows[3].start) == ("a", "{}", None, '{"x":1}', "A")
    labels = [r.x for r in df.orderBy("id").select(Q.shard_label(F.col("unit")).alias("x")).collect()]
    assert labels == ['{"topic":"a","lic":"b","band":null}', '{"topic":null,"lic":null,"band":null}', "A"]


def test_rotation_and_fame(spark):
    visits = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "x", 5), ("b", 1, "y", 2), ("b", 2, "z", 4)], "job string, page int, cursor string, place int")
    got = [(r.job, r.page, r.stuck) for r in P.rotation(visits, "page", "job", "cursor", "place").orderBy("turn").collect()]
    assert got == [("a", 1, False), ("b", 1, False), ("b", 2, False), ("a", 2, True)]
    people = spark.createDataFrame([(1, "x", 9), (2, "x", 12), (3, "y", 30), (4, "x", 12), (5, "x", 40)], "id int, kind string, links int")
    kinds, gone = spark.createDataFrame([("x",)], "kind string"), spark.createDataFrame([(5,)], "id int")
    assert [r.id for r in P.famous(people, "links", 10, kinds, "kind", gone, "id", 5).collect()] == [2, 4]
    assert [r.id for r in P.famous(people, "links", 10, kinds, "kind", None, "id", 2).collect()] == [5, 2]
