"""Corpus and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternfish.operators.sequences import running
from lanternfish.session import cut


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, Column], buckets: int = 4_096, most: int = 262_144) -> DataFrame:
    """(keys, _n, one column per place): exact order statistics of each group. A place is counted from 0, an expression of the group's size ``_n``.

    Equal values are counted first. Counts of value ranges show in which range a place lies. A range that holds more than ``most`` different values, as when one outlier stretches the group, is
    cut to ranges between its own least and greatest value again, until all are small; only the values of such ranges are sorted: no group is sorted, or held, as a whole. Nulls are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    near = cut(counts.withColumns({"_g": F.lit(0).cast("long"), "_from": F.lit(0).cast("long")}))
    sizes = near.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    kept = near  # if there are few values in all, they are sorted at once
    while near.count() > most:
        finite = F.abs("_v") < F.lit(float("inf"))  # values that are not have ranges of their own; halves don't overflow
        half = F.when(finite, F.col("_v") / 2)
        groups = near.groupBy(*keys, "_g").agg(F.min(half).alias("_low"), F.max(half).alias("_high"))
        share = F.try_divide(F.col("_v") / 2 - F.col("_low"), F.col("_high") - F.col("_low"))
        bucket = F.when(finite, F.coalesce(F.floor(share * (buckets - 1)), F.lit(0))).when(F.col("_v") < 0, -1).otherwise(buckets)
        ranged = near.join(groups, [*keys, "_g"]).withColumn("_b", bucket)
        sums = ranged.groupBy(*keys, "_g", "_b").agg(F.sum("_c").alias("_s"), F.max("_from").alias("_from"), F.count("*").alias("_k"))
        sums = (sums.join(sizes, keys) if keys else sums.crossJoin(sizes)).withColumn("_upto", F.col("_from") + F.sum("_s").over(W.partitionBy(*keys, "_g").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)))
        holds = [(p >= F.col("_upto") - F.col("_s")) & (p < F.col("_upto")) for p in places.values()]
        wanted = cut(sums.where(F.array_contains(F.array(*holds), True)).select(*keys, "_g", "_b", "_k", (F.col("_upto") - F.col("_s")).alias("_start")))
        kept = ranged.join(wanted, [*keys, "_g", "_b"]).select(*keys, "_v", "_c", F.xxhash64("_g", "_b").alias("_g"), F.col("_start").alias("_from"))
        largest = wanted.agg(F.max("_k")).first()[0]
        if largest is None or largest <= most:
            break
        near = cut(kept)
    upto = F.col("_from") + F.sum("_c").over(W.partitionBy(*keys, "_g").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = (kept.join(sizes, keys) if keys else kept.crossJoin(sizes)).withColumn("_to", upto)
    hit = [F.max(F.when((p < F.col("_to")) & (p >= F.col("_to") - F.col("_c")), F.col("_v"))).alias(n) for n, p in places.items()]
    return found.groupBy(*keys, "_n").agg(*hit)


def index_percentile(df: DataFrame, keys: list[str], value: str, share: float, to: str) -> DataFrame:
    """The value at place min(n - 1, floor(n share)) of each group in order, without interpolation."""
    return at_places(df, keys, value, {to: F.least(F.col("_n") - 1, F.floor(F.col("_n") * share))}).drop("_n")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column per share): percentiles of each group with linear interpolation."""
    place = {n: F.lit(q) * (F.col("_n") - 1) for n, q in shares.items()}
    found = at_places(df, keys, value, {f"{n}_{k}": f(p) for n, p in place.items() for k, f in (("low", F.floor), ("high", F.ceil))})
    mixed = {n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (p - F.floor(p)) for n, p in place.items()}
    return found.select(*keys, *[c.alias(n) for n, c in mixed.items()])


def threshold_sweep(df: DataFrame, score: str, bad: str, thresholds: list[float], cost: float = 3.0) -> DataFrame:
    """(threshold, caught, lost, objective, best): share of bad and of good rows above each threshold, the objective caught - cost x lost, and whether the threshold has the highest (the least such)."""
    rows = df.where(f"{score} is not null and {bad} is not null")
    sums = rows.agg(*[x.alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, x in (("c", F.avg(F.when(F.col(bad) == 1, (F.col(score) > t).cast("int")))), ("l", F.avg(F.when(F.col(bad) == 0, (F.col(score) > t).cast("int")))))])
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(F.col(f"c{i}"), 6).alias("caught"), F.round(F.col(f"l{i}"), 6).alias("lost")) for i, t in enumerate(thresholds)])).alias("s")).select("s.*")
    each = each.withColumn("objective", F.round(F.col("caught") - cost * F.col("lost"), 6))
    best = F.first("threshold").over(W.orderBy(F.desc("objective"), "threshold").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return each.withColumn("best", F.col("threshold") == best)


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(auc, positives, negatives) by the rank sum, equal scores sharing their average rank. Ranks come from counts of distinct scores. Null if one class is empty."""
    counts = df.where(f"{score} is not null and {positive} is not null").groupBy(score).agg(F.count("*").alias("n"), F.sum(positive).alias("p"))
    before = running(counts.withColumn("_one", F.lit(0)), "_one", [score], F.floor(F.col(score) * 1024), "sum", F.col("n"), "before", inclusive=False)
    ranked = before.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"))
    area = F.try_divide(F.col("s") - F.col("positives") * (F.col("positives") + 1) / 2, F.col("positives") * F.col("negatives"))
    return sums.select(F.round(area, 6).alias("auc"), "positives", "negatives")


def exact_duplicates(df: DataFrame, value: str) -> DataFrame:
    """(groups, surplus): values that occur several times, and the rows beyond the first of each; blanks are ignored."""
    counts = df.where(F.length(F.trim(value)) > 0).groupBy(F.md5(value).alias("h")).agg(F.count("*").alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def spread(df: DataFrame, lane: str, weight: str) -> DataFrame:
    """(lanes, max_load, mean_load, max_over_mean)."""
    loads = df.groupBy(lane).agg(F.sum(weight).alias("load"))
    return loads.agg(F.count("*").alias("lanes"), F.round(F.max("load"), 6).alias("max_load"), F.round(F.avg("load"), 6).alias("mean_load"), F.round(F.try_divide(F.max("load"), F.avg("load")), 6).alias("max_over_mean"))
