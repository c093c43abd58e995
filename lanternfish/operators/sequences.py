"""Operators over ordered rows of a key: running bests, streaks, caps, paces, replays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, key: str | list[str], order: list[str], chunk: Column, how: str, value: Column, to: str, inclusive: bool = True) -> DataFrame:
    """Running sum or maximum of ``value`` per key, in two levels, so that no key, however many rows it has, is sorted in one task.

    ``chunk`` grows with the order and cuts a key's rows to pieces (an hour, a range of numbers). Rows are sorted within a chunk only; what a
    chunk begins with comes from one row per chunk, aggregated before it is shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    total = F.sum if how == "sum" else F.max
    rows = df.withColumns({"_chunk": chunk, "_value": value})
    before = rows.groupBy(*keys, "_chunk").agg(total("_value").alias("_all")).withColumn("_before", total("_all").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)))
    inside = total("_value").over(W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1))
    out = rows.join(before.drop("_all"), [*keys, "_chunk"]).withColumn("_inside", inside)
    both = F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0)) if how == "sum" else F.greatest("_before", "_inside")
    return out.withColumn(to, both).drop("_chunk", "_value", "_before", "_inside")


def running_best(df: DataFrame, key: str, order: list[str], chunk: Column, value: str, to: str = "best") -> DataFrame:
    return running(df, key, order, chunk, "max", F.col(value), to)


def above_floor(df: DataFrame, score: str, reference: str, share: float) -> DataFrame:
    """Rows whose score is at least the share of a reference; references near 0 count as a millionth."""
    return df.where(F.col(score) >= share * F.greatest(F.col(reference), F.lit(1e-6)))


def streak(df: DataFrame, key: str, order: list[str], chunk: Column, bad: Column, to: str = "streak") -> DataFrame:
    """Length of the run of bad rows that ends at each row; 0 at a good row, which resets it.

    It is the number of bad rows so far less that number at the last good row, which is its running maximum over good rows.
    """
    marked = df.withColumn("_bad", F.coalesce(bad, F.lit(False)).cast("long"))
    counted = running(marked, key, order, chunk, "sum", F.col("_bad"), "_so_far")
    reset = running(counted, key, order, chunk, "max", F.when(F.col("_bad") == 0, F.col("_so_far")), "_reset")
    return reset.withColumn(to, F.col("_so_far") - F.coalesce("_reset", F.lit(0))).drop("_bad", "_so_far", "_reset")


def until(df: DataFrame, key: str, order: list[str], chunk: Column, stop: Column) -> DataFrame:
    """Rows of each key up to and with the first at which ``stop`` holds."""
    return running(df, key, order, chunk, "sum", F.when(stop, 1).otherwise(0), "_stops", inclusive=False).where("_stops = 0").drop("_stops")


def depth_capped(df: DataFrame, key: str, order: list[str], chunk: Column, amount: str, cap: float) -> DataFrame:
    """Rows of each key up to the one whose running sum reaches the cap, with ``kept``, that sum."""
    return until(running(df, key, order, chunk, "sum", F.col(amount), "kept"), key, order, chunk, F.col("kept") >= cap)


def trailing_pace(df: DataFrame, key: str, seconds: str, amount: str, window: int, least_dt: int = 20) -> DataFrame:
    """``per_minute``: growth of ``amount`` over the trailing window of seconds; null if the window is shorter than ``least_dt`` or nothing grew.

    Rows are cut to pieces as long as the window, and each piece also sees the rows of the one before, so a window is whole and no key's rows meet in one task.
    """
    piece = F.floor(F.col(seconds) / window)
    rows = df.withColumn("_shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_piece", piece + F.col("_shift"))
    w = W.partitionBy(key, "_piece").orderBy(seconds).rangeBetween(-window, 0)
    rows = rows.withColumn("_dt", F.col(seconds) - F.min(seconds).over(w)).withColumn("_dn", F.col(amount) - F.min(amount).over(w)).where("_shift = 0")
    return rows.withColumn("per_minute", F.when((F.col("_dt") > least_dt) & (F.col("_dn") > 0), F.round(60.0 * F.col("_dn") / F.col("_dt"), 6))).drop("_dt", "_dn", "_shift", "_piece")


def rate_buckets(df: DataFrame, time: str, ok: Column, minutes: int = 5) -> DataFrame:
    """(bucket, ok, failed, per_second) of tumbling windows."""
    bucket = F.window(time, f"{minutes} minutes")["start"]
    return df.groupBy(bucket.alias("bucket")).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed")).withColumn("per_second", F.round(F.col("ok") / (60.0 * minutes), 6))


def thinned(df: DataFrame, key: str, seconds: str, spacing: float, most: int | None = None) -> DataFrame:
    """Rows at least ``spacing`` after the last kept row of their key, the last ``most`` of each key, if given. Each decision needs the one before, so a key's rows pass in order through one Python
    iterator; batches stream, and no group is held whole."""
    rows = df.select(key, seconds).repartition(key).sortWithinPartitions(key, seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = object(), 0.0
        for batch in batches:
            keep = []
            for k, t in zip(batch[key], batch[seconds], strict=True):
                if k != at or t - last >= spacing:
                    at, last = k, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch[keep]

    kept = rows.mapInPandas(run, rows.schema)
    if most is None:
        return kept
    return kept.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seconds)))).where(F.col("_r") <= most).drop("_r")


def cache_replay(df: DataFrame, key: str, seconds: str, ttl: float) -> DataFrame:
    """Every request of a key with ``hit``: whether a fill not older than ``ttl`` was there. A miss fills the cache."""
    fills = thinned(df, key, seconds, ttl + 1e-9).distinct().withColumn("hit", F.lit(False))
    counted = df.select(key, seconds).join(fills, [key, seconds], "left")
    first = F.row_number().over(W.partitionBy(key, seconds).orderBy(F.lit(1)))
    return counted.withColumn("_r", first).withColumn("hit", ~((F.col("_r") == 1) & F.col("hit").isNotNull())).drop("_r")


def most_at_once(df: DataFrame, key: str, start: str, end: str, chunk: float) -> DataFrame:
    """(key, most): the greatest number of intervals of a key that are open at once; one that ends as another starts is closed. ``chunk`` is the length of the pieces of time."""
    marks = df.select(key, F.col(start).alias("t"), F.lit(1).alias("d")).unionAll(df.select(key, F.col(end).alias("t"), F.lit(-1).alias("d")))
    moments = marks.groupBy(key, "t").agg(F.sum("d").alias("d"))
    return running(moments, key, ["t"], F.floor(F.col("t") / chunk), "sum", F.col("d"), "open").groupBy(key).agg(F.max("open").alias("most"))


def carried_header(df: DataFrame, order: str, header: Column, to: str = "section", key: str | None = None, rows: int = 100_000) -> DataFrame:
    """Each row with the last header at or before it. ``order`` is a number; rows are cut to chunks of ``rows`` of it, so that without a key, too, no task sorts them all."""
    marked = df.withColumn("_head", F.when(header.isNotNull(), F.struct(F.col(order).alias("at"), header.alias("header")))).withColumn("_whole", F.lit(0))
    return running(marked, key or "_whole", [order], F.floor(F.col(order) / rows), "max", F.col("_head"), "_last").withColumn(to, F.col("_last.header")).drop("_head", "_whole", "_last")


def barren_break(df: DataFrame, key: str, order: list[str], chunk: Column, barren: Column, limit: int = 10, fail: bool = True) -> DataFrame:
    """A breaker: the rows with ``barren``, the run of barren rows that ends at each, and an error as soon as a run reaches the limit. With ``fail`` off, ``tripped`` marks the rows instead."""
    rows = streak(df, key, order, chunk, barren, "barren").withColumn("tripped", F.col("barren") >= limit)
    if not fail:
        return rows
    return rows.where(F.assert_true(~F.col("tripped"), F.concat(F.lit(f"{limit} barren pages in a row of "), F.col(key).cast("string"))).isNull()).drop("tripped")


def lru_replay(df: DataFrame, key: str, order: list[str], item: str, seconds: str, capacity: int, ttl: float) -> DataFrame:
    """Every request with ``hit``: whether its item was in the key's cache of ``capacity`` items, filled not longer than ``ttl`` ago. The item used longest ago gives way. Requests pass in order
    through one iterator; what is held is one cache."""
    rows = df.select(key, *[c for c in order if c not in (key, item, seconds)], item, seconds).repartition(key).sortWithinPartitions(key, *order)
    schema = ", ".join([*[f"`{n}` {t}" for n, t in rows.dtypes], "hit boolean"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cache = object(), {}
        for batch in batches:
            hits = []
            for k, x, t in zip(batch[key], batch[item], batch[seconds], strict=True):
                if k != at:
                    at, cache = k, {}
                filled = cache.pop(x, None)
                hit = filled is not None and t - filled < ttl
                cache[x] = filled if hit else t
                if len(cache) > capacity:
                    del cache[next(iter(cache))]
                hits.append(hit)
            yield batch.assign(hit=hits)

    return rows.mapInPandas(run, schema)
