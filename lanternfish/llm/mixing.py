"""Problem 9: sources mixed to target shares of the total size in tokens.

The total is the largest that no source's share of it exceeds ``max_repeats`` times what the source holds. A source gives whole epochs of all its
documents first; the rest of its budget is a weighted sample without replacement after Efraimidis and Spirakis: each document draws the
key -ln(u) / w, u from a hash of its key and the seed, w from its text quality, and documents are taken in order of their keys while the prefix sum of
their tokens stays in the budget.

No source is sorted in one task, though one may hold most rows: keys are cut to ranges by their sampled quantiles,
tokens are summed per range, prefix sums over the ranges give each range its start, and only rows within one range are sorted together.

Defined cases: null sources, sources without a target and targets without documents take no part (a target of a source without tokens makes the total
0); texts without tokens are never drawn; repeated texts are documents of their own; ties of keys are broken by the document's key; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternfish.llm.textstats import text_types
from lanternfish.llm.tokenise import token_counts
from lanternfish.session import cut


def sized(documents: DataFrame, targets: DataFrame, key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """(key, source, n_tokens, quality) of the documents of the target sources, in one pass over their texts. Quality is from 0.1, for what is surely no prose, to 1."""
    mine = documents.join(F.broadcast(targets.select("source")), "source", "left_semi").select(key, "source", "text")
    rated = text_types(token_counts(mine, folder=folder), key, keep=("source", "n_tokens"))
    return rated.select(key, "source", "n_tokens", (0.1 + 0.9 * F.coalesce("p_prose", F.lit(0.0))).alias("quality"))


def budgets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, held, budget, epochs, rest): one row per target."""
    held = rows.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    both = targets.join(held, "source", "left").fillna(0, ["held"])
    total = both.where("target_share > 0").agg(F.floor(F.min(F.col("max_repeats") * F.col("held") / F.col("target_share"))).alias("total"))
    both = both.crossJoin(F.broadcast(total)).withColumn("budget", F.floor(F.col("target_share") * F.col("total") + 1e-6).cast("long"))
    epochs = F.when(F.col("held") > 0, F.floor(F.col("budget") / F.col("held"))).otherwise(0).cast("long")
    return both.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("held"))


def ranged(drawn: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """The rows with ``range``: they are partitioned by sampled quantiles of (source, k), so ranges are about equally large whatever the qualities are. Written, as borders are sampled anew when computed."""
    order = [F.col("source"), F.col("k"), F.col(key)]
    cutup = drawn.repartitionByRange(ranges, *order) if ranges else drawn.repartitionByRange(*order)
    return cut(cutup.withColumn("range", F.spark_partition_id()))


def mixed(rows: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 17, ranges: int | None = None) -> DataFrame:
    """(key, source, n_tokens, copies): the documents of the mixture and how often each is used. ``ranges`` is the session's number of shuffle partitions if not given."""
    plan = F.broadcast(cut(budgets(rows, targets)).select("source", "epochs", "rest"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2**52)).cast("double") + 1) / (2.0**52 + 1)
    drawn = rows.where("n_tokens > 0").join(plan, "source").select(key, "source", "n_tokens", "epochs", "rest", (-F.log(u) / F.col("quality")).alias("k"))
    drawn = ranged(drawn, key, ranges)
    sums = drawn.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))  # one row per range, and one more per source
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.join(sums.withColumn("before", before).drop("tokens"), ["source", "range"])
    inside = F.sum("n_tokens").over(W.partitionBy("source", "range").orderBy("k", key).rowsBetween(W.unboundedPreceding, W.currentRow))
    copies = F.col("epochs") + F.when(F.col("before") + inside <= F.col("rest"), 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("int")).where("copies > 0").select(key, "source", "n_tokens", "copies")


def shares(rows: DataFrame, mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, held_tokens, used_tokens, actual_share, documents, most_copies): the report of a mixture."""
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum("used_tokens").alias("all"))
    out = targets.select("source", "target_share").join(budgets(rows, targets).select("source", F.col("held").alias("held_tokens")), "source").join(used, "source", "left").fillna(0, ["used_tokens", "documents", "most_copies"])
    actual = F.when(F.col("all") > 0, F.round(F.col("used_tokens") / F.col("all"), 6)).otherwise(0.0)
    return out.crossJoin(F.broadcast(total)).select("source", "target_share", "held_tokens", "used_tokens", actual.alias("actual_share"), "documents", "most_copies")
