"""Quantisation, its recall, prompt scores and similarity statistics of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.maths import dot, sigmoid
from lanternfish.operators.statistics import percentiles


def int8_scale(df: DataFrame, vec: str, share: float = 0.9999) -> DataFrame:
    """(scale): the percentile of all absolute components, exact, that the largest code stands for. No task holds the values."""
    values = df.select(F.explode(vec).alias("v")).select(F.abs(F.col("v").cast("double")).alias("v"))
    return percentiles(values, [], "v", {"scale": share}).select(F.round("scale", 9).alias("scale"))


def int8(vec: Column, scale: Column) -> Column:
    """Signed codes of -127 to 127, half to even."""
    return F.transform(vec, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.coalesce(F.rint(F.try_divide(x.cast("double"), scale) * 127), F.lit(0.0)))).cast("tinyint"))


def sign_bits(vec: Column) -> Column:
    """The signs of a vector of 64 components as one number."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(F.get(vec, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def overlap(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(recall, queries): mean share of the exact k best that a search found."""
    hit = exact.select("qid", "id").join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    each = hit.groupBy("qid").agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("recall"))
    return each.agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("queries"))


def neighbour_counts(df: DataFrame, queries: DataFrame, key: str, vec: str, thresholds: list[float], size: int = 64, block: int = 2_048) -> DataFrame:
    """(qid, n_0, n_1, …): for each query vector the number of other rows with at least each cosine, counted in blocks."""

    def pack(rows: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, rows):
                    b = whole.slice(start, rows)
                    x = b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, size)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype(np.int64).tobytes()]), pa.array([x.tobytes()])], names=["ids", "x"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, qx, d, dx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                qids, ids = np.frombuffer(q, np.int64), np.frombuffer(d, np.int64)
                s = np.round(np.frombuffer(qx).reshape(-1, size) @ np.frombuffer(dx).reshape(-1, size).T, 6)
                s[qids[:, None] == ids[None, :]] = -2
                yield pa.RecordBatch.from_arrays([pa.array(qids), *[pa.array((s >= t).sum(axis=1)) for t in thresholds]], names=["qid", *[f"n_{i}" for i in range(len(thresholds))]])

    schema = ", ".join(["qid long", *[f"n_{i} long" for i in range(len(thresholds))]])
    both = [x.select(F.col(key).cast("long"), vec).mapInArrow(pack(block), "ids binary, x binary") for x in (queries, df)]
    pairs = both[0].toDF("q", "qx").crossJoin(both[1])  # blocks of a stated query set against blocks of all rows
    return pairs.mapInArrow(run, schema).groupBy("qid").agg(*[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(thresholds))])


def prompt_scores(df: DataFrame, key: str, vec: str, prompts: DataFrame, groups: list[str], scale: float, bias: float, most_prompts: int = 10_000) -> DataFrame:
    """(key, one column per group): the highest calibrated score of each group of prompts (group, prompt_vec), rounded to 4 places.

    Prompts are folded to one array per group, so each row meets each group once. More than ``most_prompts`` are folded in parts, each row meets each part, and the best of all parts counts.
    """
    parts = max(1, -(-prompts.count() // most_prompts))
    folded = prompts.withColumn("_part", F.pmod(F.xxhash64("prompt_vec"), F.lit(parts))).groupBy("_part").pivot("group", groups).agg(F.collect_list("prompt_vec")).drop("_part")
    best = {g: F.round(F.array_max(F.transform(g, lambda p: sigmoid(dot(F.col(vec), p), scale, bias))), 4) for g in groups}
    if parts == 1:
        return df.select(key, vec).crossJoin(F.broadcast(folded)).select(key, *[c.alias(g) for g, c in best.items()])
    each = df.select(key, vec).crossJoin(folded).select(key, *[c.alias(g) for g, c in best.items()])
    return each.groupBy(key).agg(*[F.max(g).alias(g) for g in groups])
