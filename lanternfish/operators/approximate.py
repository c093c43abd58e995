"""Approximate dense search: cells of similar vectors, and codes of parts of vectors. Both are fitted on a bounded sample; every row is indexed.

``cells`` cuts the space by k-means. A query is compared with the rows of its nearest cells only, as many as reach the wanted recall on the sample, where the exact answer is known. ``product_codes`` quantises parts of
a vector to the numbers of their nearest centres; a query adds up the products with these centres, and the best by codes are ranked again by the full vectors.

Defined cases: vectors that are null, of another size or not finite are no rows; queries without a valid vector have no results; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.maths import is_valid
from lanternfish.operators.retrieval import SCORED, top
from lanternfish.session import cut


def sampled(df: DataFrame, key: str, vec: str, size: int, most: int) -> np.ndarray:
    """At most ``most`` valid vectors, those with the least hashes of their ids."""
    rows = df.where(is_valid(F.col(vec), size)).orderBy(F.xxhash64(key), key).limit(most).select(F.col(vec).cast("array<double>").alias("v")).toArrow()
    return np.array(rows.column("v").to_pylist(), np.float64).reshape(-1, size)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """At most k centres of the rows of x, by squared distance."""
    random = np.random.default_rng(seed)
    centres = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds if len(centres) else 0):
        near = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Cells(NamedTuple):
    """Centres of cells, and how many of them a query looks into."""

    centres: np.ndarray
    probes: int


def _probed(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]


def cells(df: DataFrame, key: str, vec: str, k: int = 10, recall: float = 0.95, size: int = 64, most: int = 20_000, most_cells: int = 1_024) -> Cells:
    """Cells fitted on a sample: about the square root of the rows of them, and the fewest probes with which searches of the sample find the share ``recall`` of their true k best there."""
    x, n = sampled(df, key, vec, size, most), df.count()
    if not len(x):
        return Cells(np.zeros((1, size)), 1)
    centres = kmeans(x, int(min(most_cells, max(1, round(n**0.5 / 2)))))
    asked = x[: min(len(x), 200)]
    best = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : k + 1]
    place = np.empty((len(asked), len(centres)), int)
    np.put_along_axis(place, _probed(asked, centres, len(centres)), np.arange(len(centres))[None, :], axis=1)
    home = _probed(x, centres, 1)[:, 0]
    needed = np.sort(np.take_along_axis(place, home[best], axis=1), axis=None)
    return Cells(centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)


def _in_cells(df: DataFrame, key: str, vec: str, own: Cells, probes: int, size: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(own.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, size)
                at = _probed(x, shared.value, probes)
                rows = np.repeat(np.arange(len(x)), at.shape[1])
                out = x[rows].astype("<f8")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(at.ravel()), pa.array([v.tobytes() for v in out], pa.binary())], names=["id", "cell", "x"])

    kept = df.where(is_valid(F.col(vec), size)).select(F.col(key).cast("long"), F.col(vec).cast("array<double>"))
    return kept.mapInArrow(run, "id long, cell long, x binary")


def search(docs: DataFrame, key: str, vec: str, queries: DataFrame, k: int, own: Cells, size: int = 64, piece_rows: int = 16_384) -> DataFrame:
    """(qid, id, score, rank): the k rows of the highest dot product that lie in the cells nearest to each query (qid, qvec). A cell with more than ``piece_rows`` rows is searched in pieces."""
    rows = cut(_in_cells(docs, key, vec, own, 1, size))
    asked = cut(_in_cells(queries, "qid", "qvec", own, own.probes, size))
    pieces = rows.groupBy("cell").agg(F.ceil(F.count("*") / piece_rows).cast("int").alias("pieces"))
    rows = rows.join(pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    asked = asked.join(pieces, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, found = ids[order], []
        d = np.frombuffer(b"".join(right.column("x").to_pylist())).reshape(-1, size)[order]
        q = np.frombuffer(b"".join(left.column("x").to_pylist())).reshape(-1, size)
        for start in range(0, len(qids) if len(ids) else 0, 512):
            s = np.round(q[start : start + 512] @ d.T, 6)
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            found.append((np.repeat(qids[start : start + 512], at.shape[1]), ids[at.ravel()], np.take_along_axis(s, at, axis=1).ravel()))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(SCORED.names, cols, strict=True)))

    return top(asked.groupBy("cell", "piece").cogroup(rows.groupBy("cell", "piece")).applyInArrow(compare, SCORED), k)


def product_codes(df: DataFrame, key: str, vec: str, parts: int = 8, codes: int = 256, size: int = 64, most: int = 20_000) -> np.ndarray:
    """Centres (part, code, component) of the parts of vectors."""
    x = sampled(df, key, vec, size, most)
    books = np.zeros((parts, codes, size // parts))
    for p in range(parts):
        own = kmeans(x[:, p * (size // parts) : (p + 1) * (size // parts)], codes)
        books[p, : len(own)] = own
        books[p, len(own) :] = own[:1] if len(own) else 0
    return books


def search_codes(docs: DataFrame, key: str, vec: str, queries: DataFrame, k: int, books: np.ndarray, oversampling: int = 4, block: int = 4_096) -> DataFrame:
    """(qid, id, score, rank): the k best of ``oversampling`` times as many candidates by their codes, ranked by the full vectors. Only codes, a byte a part, are compared with all queries."""
    parts, _, width = books.shape
    size = parts * width
    valid = lambda df, k_, v: df.where(is_valid(F.col(v), size)).select(F.col(k_).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"))
    shared = docs.sparkSession.sparkContext.broadcast(books)

    def pack(coded: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, block if coded else 256):
                    part = whole.slice(start, block if coded else 256)
                    x = part.column(1).flatten().to_numpy().reshape(-1, parts, width)
                    if coded:
                        own = shared.value
                        body = np.stack([(x[:, p] @ own[p].T - (own[p] ** 2).sum(axis=1) / 2).argmax(axis=1) for p in range(parts)], axis=1).astype(np.uint8)
                    else:
                        body = np.ascontiguousarray(x)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()]), pa.array([body.tobytes()])], names=["ids", "x"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, qx, d, dx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                qids, ids = np.frombuffer(q, np.int64), np.frombuffer(d, np.int64)
                code, x = np.frombuffer(dx, np.uint8).reshape(-1, parts), np.frombuffer(qx).reshape(-1, parts, width)
                score = np.zeros((len(qids), len(ids)))
                for p in range(parts):
                    score += (x[:, p] @ shared.value[p].T)[:, code[:, p]]
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, : k * oversampling]
                rows = np.repeat(np.arange(len(qids)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows]), pa.array(ids[order.ravel()]), pa.array(score[rows, order.ravel()])], names=SCORED.names)

    left = valid(queries, "qid", "qvec").mapInArrow(pack(False), "ids binary, x binary").toDF("q", "qx")
    right = valid(docs, key, vec).mapInArrow(pack(True), "ids binary, x binary")
    near = top(left.crossJoin(right).mapInArrow(run, SCORED), k * oversampling)  # blocks of a stated query set against blocks of codes of all rows
    full = near.select("qid", "id").join(valid(docs, key, vec), "id").join(valid(queries, "qid", "qvec").toDF("qid", "qv"), "qid")
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return top(full.select("qid", "id", F.round(product, 6).alias("score")), k)
