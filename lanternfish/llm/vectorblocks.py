"""Candidate blocks of similar vectors, for problems 3 and 5.

Every valid vector becomes a 16-bit code of its direction; vectors of one code are one class, so exact and scaled copies, even a third of all
rows, cost one class. A class has one token for each of some random rotations: the coordinate that is largest after it, with its sign (cross-polytope hashing). A table
joins as many tokens to one key as keep the mean block below ``block_rows``, so blocks don't grow with the collection, and there are as many tables as keep the chance
that a similar pair meets what it is with single tokens (``planned``): recall doesn't depend on the size of the input, and comparisons grow in proportion to it. Classes that share
a key meet in its block, however frequent it is; a block that is too large is split into pieces, and every pair of pieces is compared, which is exact. Blocks are
compared by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions.maths import is_valid

SCALE = 32767
SLACK = 0.03
CODED = T.StructType([T.StructField("id", T.StringType()), T.StructField("code", T.BinaryType())])
LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("sim", T.FloatType())])
KEYED = T.StructType([T.StructField("c", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("light", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])


def unit(code: pa.ChunkedArray | pa.Array, size: int, kind: type = np.int16) -> np.ndarray:
    """Unit vectors of a column of codes."""
    x = np.frombuffer(b"".join(code.to_pylist()), kind).reshape(-1, size).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(df: DataFrame, key: str = "id", column: str = "vec", size: int = 64) -> DataFrame:
    """(id, c, code): one row per valid vector; c is the 128-bit key of the class of equal codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            raw = np.rint(x * SCALE).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "code"])

    rows = df.where(F.col(key).isNotNull() & is_valid(F.col(column), size)).select(F.col(key).cast("string").alias("id"), F.col(column).alias("vec"))
    return rows.mapInArrow(run, CODED).withColumn("c", F.unhex(F.md5("code")))


class Plan(NamedTuple):
    """Tables of a collection: how many, and how many tokens each of their keys joins."""

    tables: int
    joined: int

    @property
    def rotations(self) -> int:
        return self.tables * self.joined


def collision(similarity: float, size: int, samples: int = 20_000, seed: int = 5) -> float:
    """The share of rotations under which two vectors of the given cosine have the same token, by simulation."""
    random = np.random.default_rng(seed)
    x = random.normal(size=(samples, size))
    y = similarity * x + (1 - similarity**2) ** 0.5 * random.normal(size=(samples, size))
    every, a, b = np.arange(samples), np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1)
    return float(((a == b) & ((x[every, a] > 0) == (y[every, b] > 0))).mean())


def planned(rows: int, similarity: float, size: int = 64, tables: int = 6, block_rows: int = 16_384) -> Plan:
    """The plan of a collection: of ``tables`` tables while single tokens keep the mean block small; otherwise of so many that a pair of the given cosine misses all of them no oftener."""
    joined = next(m for m in range(1, 64) if rows <= block_rows * (2 * size) ** m)
    p = collision(similarity, size)
    return Plan(tables if joined == 1 else ceil(tables * log1p(-p) / log1p(-(p**joined))), joined)


def classes(rows: DataFrame, size: int = 64, rotations: int = 6, seed: int = 11) -> DataFrame:
    """(c, code, light, tokens): one row per class; light is the code in 8 bits. Copies are merged on the map side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(seed)
        turns = [np.linalg.qr(random.normal(size=(size, size)))[0].astype(np.float32) for _ in range(rotations)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, every = unit(batch.column(1), size), np.arange(batch.num_rows)
            tokens = np.empty((len(x), rotations), np.int32)
            for r, turn in enumerate(turns):
                y = x @ turn
                at = np.abs(y).argmax(axis=1)
                tokens[:, r] = (r * size + at) * 2 + (y[every, at] > 0)
            ends = pa.array(np.arange(0, tokens.size + 1, rotations, dtype=np.int32))
            light = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in light], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(tokens.ravel()))], names=["c", "code", "light", "tokens"])

    return rows.groupBy("c").agg(F.min("code").alias("code")).mapInArrow(run, KEYED)


def _keys(plan: Plan) -> Column:
    """The keys of a class, one of each table."""
    if plan.joined == 1:
        return F.transform("tokens", lambda t: t.cast("long"))
    return F.array(*[F.xxhash64(*[F.get("tokens", F.lit(t * plan.joined + i)) for i in range(plan.joined)]) for t in range(plan.tables)])


def links(held: DataFrame, floor: float, k: int | None = None, size: int = 64, plan: Plan = Plan(6, 1), piece_rows: int = 16_384) -> DataFrame:
    """(a, b, sim): pairs of classes that meet in a block and have about the cosine ``floor`` or more.

    Blocks carry the 8-bit codes, whose cosine is off by about 0.001, so everything from ``SLACK`` below the floor is given; ``verified`` has the cosines of the full codes.

    Without ``k`` each pair once, a < b. With ``k`` both directions, at most the k best b of each a in a block. A pair can come from several blocks.
    """
    keyed = held.select("c", "light", F.explode(_keys(plan)).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > piece_rows).select("key", F.ceil(F.col("count") / piece_rows).cast("int").alias("pieces"))
    if hot.take(1):
        own = F.pmod(F.xxhash64("c"), F.col("pieces")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))
        keyed = keyed.join(hot, "key", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
        keyed = keyed.select("c", "light", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own")
    split = "p" in keyed.columns

    def compare(block: pa.Table) -> pa.Table:
        n = block.num_rows
        if n < 2:
            return pa.table({"a": [], "b": [], "sim": []}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("sim", pa.float32())]))
        x = unit(block.column("light"), size, np.int8)
        p, q, own = (block.column("p")[0].as_py(), block.column("q")[0].as_py(), block.column("own").to_numpy()) if split else (0, 0, None)
        left = np.arange(n) if p == q else np.flatnonzero(own == p)
        right = left if p == q else np.flatnonzero(own == q)
        found = []
        for start in range(0, len(left), 1024):
            rows = left[start : start + 1024]
            sims = x[rows] @ x[right].T
            if p == q:
                sims[np.arange(len(rows)), start + np.arange(len(rows))] = -2
            i, j = np.nonzero(sims >= floor - SLACK)
            found.append((rows[i], right[j], sims[i, j]))
        i, j, sim = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3
        if p == q:
            once = i < j
            i, j, sim = i[once], j[once], sim[once]
        if k is not None:
            i, j, sim = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([sim, sim])
            order = np.lexsort((j, -sim, i))
            i, j, sim = i[order], j[order], sim[order]
            first = np.searchsorted(i, i)
            best = np.arange(len(i)) - first < k
            i, j, sim = i[best], j[best], sim[best]
        c = np.array(block.column("c").to_pylist(), object)
        a, b = c[i], c[j]
        if k is None:
            swap = a > b
            a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table({"a": pa.array(a.tolist(), pa.binary()), "b": pa.array(b.tolist(), pa.binary()), "sim": pa.array(sim.astype(np.float32))})

    return keyed.groupBy("key", *(["p", "q"] if split else [])).applyInArrow(compare, LINKS)


def similarity(pairs: DataFrame, held: DataFrame, floor: float, size: int = 64) -> DataFrame:
    """(a, b, sim) of the given pairs of classes (a, b), of at least the cosine ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("ij,ij->i", unit(batch.column(2), size), unit(batch.column(3), size)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["a", "b", "sim"]).filter(pa.array(sim >= floor))

    left = held.select(F.col("c").alias("a"), F.col("code").alias("x"))
    right = held.select(F.col("c").alias("b"), F.col("code").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, LINKS)


def verified(pairs: DataFrame, held: DataFrame, floor: float, size: int = 64) -> DataFrame:
    """(a, b, sim) of the pairs, each once with a < b, of at least the cosine ``floor``."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return similarity(once, held, floor, size)
