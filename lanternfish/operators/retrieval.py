"""Lexical, dense and hybrid retrieval for batches of queries.

Choices where published semantics are open: BM25 with k1 1.2, b 0.75 and idf ln(1 + (N - df + 0.5) / (df + 0.5)) after Robertson & Zaragoza
2009; reciprocal rank fusion with constant 60 after Cormack, Clarke & Büttcher 2009; scores are rounded to 6 places before they are
ranked, and ties go to the smaller id, so ranks are the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions.maths import dot
from lanternfish.functions.text import canonical_query, words
from lanternfish.operators.normalise import asked_classes
from lanternfish.session import cut

SCORED = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])


def top(df: DataFrame, k: int, per: str = "qid", score: str = "score", key: str = "id", to: str = "rank") -> DataFrame:
    """The k best rows of each query, ranked."""
    w = W.partitionBy(per).orderBy(F.col(score).desc(), F.col(key))
    return df.withColumn(to, F.row_number().over(w).cast("long")).where(F.col(to) <= k)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, len, term, tf): the inverted index. Terms of a document are counted where its row is."""
    rows = docs.select(F.col(key).alias("id"), words(F.col(text)).alias("t"))
    return rows.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def term_statistics(index: DataFrame) -> DataFrame:
    """(term, df, total_tf) of every term."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def bm25(index: DataFrame, docs: DataFrame, key: str, text: str, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, id, score) of every document that shares a term with the query; each distinct query term has weight 1."""
    asked = queries.select("qid", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    corpus = docs.agg(F.count("*").cast("double").alias("n"), F.avg(F.size(words(F.col(text)))).alias("avg_len"))
    wanted = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighed = wanted.join(df, "term").crossJoin(F.broadcast(corpus)).select("term", "id", part.alias("w"))
    return weighed.join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum("w"), 6).alias("score"))


class _Best:
    """The k best (score, id) of each of n queries, of all that was offered so far. ``floor`` and ``last`` are the k-th score and its id: only what is better is looked at, and sorted when there is as much of it as is kept."""

    def __init__(self, qids: np.ndarray, k: int, least: float = -np.inf) -> None:
        self.qids, self.k, self.least, n = qids, k, least, len(qids)
        self.floor, self.last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.rows, self.waiting, self.fresh = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0, True

    def offer(self, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all queries (rows) by the documents ``ids`` (columns), not yet rounded; those under ``least`` are no answers."""
        under = lambda x: (x - 1e-6 - np.abs(x) * 1e-12)[:, None]  # noqa: E731 - rounding moves a score by less
        n, full = self.k * len(self.qids), s.shape[1] > self.k
        at = np.flatnonzero(~(s < np.maximum(under(self.floor), self.least)))
        if full and len(at) > 2 * n:
            own = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1]
            at = np.flatnonzero(~(s < np.maximum(under(np.fmax(own, self.floor)), self.least)))
        q, c = np.divmod(at, s.shape[1])
        score, found = np.round(s.ravel()[at], 6), ids[c]
        better = ~(score < self.floor[q]) & ((score != self.floor[q]) | (found < self.last[q]))
        self.rows.append((q[better], found[better], score[better]))
        self.waiting += len(self.rows[-1][0])
        if self.waiting >= n or self.fresh:
            self.settle()

    def settle(self) -> None:
        q, ids, s = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((ids, -s, q))
        q = q[order]
        starts = np.searchsorted(q, np.arange(len(self.qids) + 1))
        order = order[np.arange(len(q)) - starts[q] < self.k]
        q, ids, s = q[np.arange(len(q)) - starts[q] < self.k], ids[order], s[order]
        ends = np.cumsum(np.minimum(np.diff(starts), self.k)) - 1
        has = np.diff(starts) >= self.k
        self.floor[has], self.last[has] = s[ends[has]], ids[ends[has]]
        self.rows, self.waiting, self.fresh = [(q, ids, s)], 0, False

    def batch(self) -> pa.RecordBatch:
        self.settle()
        q, ids, s = self.rows[0]
        return pa.RecordBatch.from_arrays([pa.array(self.qids[q]), pa.array(ids), pa.array(s)], names=SCORED.names)


def _pairs(docs: DataFrame, queries: DataFrame, parts: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(qid, id, score): ``run`` over all blocks of documents of a part, one after another, for each block of queries (qb, of ``parts``). A task is one part by one block of queries, so it can keep the best of its queries while documents
    pass, and k rows a query leave it. There are as few parts of documents as keep 64 tasks busy, four at least, however many documents there are; more queries make more tasks. Neither side is copied on disk."""
    pairs = docs.coalesce(max(4, -(-64 // parts))).crossJoin(queries.repartitionById(parts, F.col("qb")).hint("shuffle_replicate_nl"))  # blocks of a stated query set against blocks of all rows
    return pairs.mapInArrow(run, SCORED)


def _numbers(column: pa.Array, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def index_blocks(docs: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """The inverted index in blocks of at most ``rows`` documents: their ids and lengths, the terms of the block with the number of documents of each, and by term the places of these documents and how often each has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                part = whole.slice(start, rows)
                n, sizes = part.num_rows, part.column(1).value_lengths().to_numpy()
                coded = part.column(1).flatten().dictionary_encode()
                own, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
                term, place = np.divmod(own, n)
                dfs = np.bincount(term, minlength=len(coded.dictionary)).astype(np.int32)
                one = pa.array([0, len(dfs)], pa.int32())
                packed = [pa.array([x.tobytes()]) for x in (part.column(0).to_numpy().astype(np.int64), sizes.astype(np.int32), place.astype(np.int32), tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([int(sizes.sum())]), *packed, pa.ListArray.from_arrays(one, coded.dictionary), pa.ListArray.from_arrays(one, pa.array(dfs))], names=["n", "words", "ids", "lens", "places", "tfs", "terms", "dfs"])

    return docs.select(F.col(key).cast("long"), words(F.col(text))).mapInArrow(run, "n long, words long, ids binary, lens binary, places binary, tfs binary, terms array<string>, dfs array<int>")


def lexical(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, block_docs: int = 2_048, block_queries: int = 1_024) -> DataFrame:
    """(qid, id, score, rank): the k best documents of each query by BM25; those that share no term with it are none.

    Texts are cut to words once and written as an inverted index in blocks of documents, a few bytes a posting. Queries are packed to blocks with the weights of their terms. Blocks of documents pass each block of
    queries in one task, which adds up in arrays and keeps the k best of each query meanwhile: no posting is sent to queries, and k rows a query leave a task. Terms that many of a pair of blocks share are one matrix product.
    """
    index = cut(index_blocks(docs, key, text, block_docs))
    n, total = (int(x or 0) for x in index.agg(F.sum("n"), F.sum("words")).first())
    avg_len = total / n if total else 1.0
    asked = cut(queries.select(F.col("qid").cast("long").alias("qid"), F.explode(F.array_distinct(words(F.col("text")))).alias("term")))
    parts = max(1, -(-asked.select("qid").distinct().count() // block_queries))
    df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select(F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("qb"), "qid", "term", idf.alias("idf"))

    def pack(block: pa.Table) -> pa.Table:
        """One row: the queries of the block, its terms and their weights, and by term the places of the queries that ask it."""
        qids, place = np.unique(block.column("qid").to_numpy(), return_inverse=True)
        coded = block.column("term").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        order, idfs = np.argsort(code, kind="stable"), np.empty(len(coded.dictionary))
        idfs[code] = block.column("idf").to_numpy()
        packed = (qids, idfs, np.bincount(code).astype(np.int32), place[order].astype(np.int32))
        return pa.table([block.column("qb").slice(0, 1), *(pa.array([x.tobytes()]) for x in packed), pa.ListArray.from_arrays(pa.array([0, len(idfs)], pa.int32()), coded.dictionary)], names=["qb", "qids", "idfs", "qfs", "asks", "qterms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                if (qb := col["qb"][i].as_py()) not in held:
                    qf = _numbers(col["qfs"], i, np.int32).astype(np.int64)
                    qids, *own = (np.array(_numbers(col[c], i, t)) for c, t in (("qids", np.int64), ("idfs", np.float64), ("asks", np.int32)))
                    held[qb] = _Best(qids, k, 5e-324), pa.array(col["qterms"][i].as_py(), pa.string()), qf, np.cumsum(qf) - qf, *own
                best, terms, qf, qstart, idfs, asks = held[qb]
                ids, lens, place, tf = (_numbers(col[c], i, t) for c, t in (("ids", np.int64), ("lens", np.int32), ("places", np.int32), ("tfs", np.int32)))
                dfs = col["dfs"][i].values.to_numpy().astype(np.int64)
                at = pc.fill_null(pc.index_in(col["terms"][i].values, value_set=terms), -1).to_numpy().astype(np.int64)
                of = np.repeat(at, dfs)  # the queries' term of each posting
                place, tf, of = place[of >= 0], tf[of >= 0], of[of >= 0]
                w = idfs[of] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[place] / avg_len))
                m, cols = len(best.qids), len(ids)
                shared = np.zeros(len(qf), np.int64)
                shared[at[at >= 0]] = dfs[at >= 0]
                heavy = np.flatnonzero(shared * qf * 512 > m * cols)  # a product of the matrices costs less than their single sums
                row = np.full(len(qf), -1)
                row[heavy] = np.arange(len(heavy))
                theirs, ours = np.zeros((len(heavy), cols)), np.zeros((m, len(heavy)))
                mine = row[of] >= 0
                theirs[row[of[mine]], place[mine]] = w[mine]
                term = np.repeat(np.arange(len(qf)), qf)
                ours[asks[row[term] >= 0], row[term[row[term] >= 0]]] = 1
                s = ours @ theirs
                place, of, w = place[~mine], of[~mine], w[~mine]
                times = qf[of]
                ends = np.cumsum(times)
                q = asks[np.arange(ends[-1] if len(ends) else 0) + np.repeat(qstart[of] - ends + times, times)]
                np.add.at(s.reshape(-1), q.astype(np.int64) * cols + np.repeat(place, times), np.repeat(w, times))
                best.offer(s, ids)
        for best, *_ in held.values():
            yield best.batch()

    blocks = weighed.groupBy("qb").applyInArrow(pack, "qb int, qids binary, idfs binary, qfs binary, asks binary, qterms array<string>")
    return top(_pairs(index.drop("n", "words"), blocks, parts, run), k)


def _blocks(df: DataFrame, key: str, vec: str, size: int, rows: int) -> DataFrame:
    """Rows packed to blocks (ids, matrix) of at most ``rows`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                ids = batch.column(0).to_numpy().astype(np.int64)
                x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(ids), size)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=["ids", "x"])

    return _valid(df, key, vec, size).mapInArrow(run, "ids binary, x binary")


def _valid(df: DataFrame, key: str, vec: str, size: int) -> DataFrame:
    """Keys and vectors of ``size`` finite numbers."""
    kept = df.where(F.col(vec).isNotNull() & (F.size(vec) == size) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    return kept.select(F.col(key).cast("long"), F.col(vec).cast("array<double>"))


def nearest_bits(docs: DataFrame, key: str, bits: str, queries: DataFrame, k: int, block: int = 8_192) -> DataFrame:
    """(qid, id, score, rank): the k signatures of 64 bits that differ from each query's (qid, bits) in fewest; the score is 64 less twice their distance, the dot product of the signs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                part = whole.slice(start, block)
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().astype(np.int64).tobytes()]) for c in part.columns], names=["ids", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, qx, d, dx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                qids, ids, own, other = (np.frombuffer(x, np.int64) for x in (q, d, qx, dx))
                s = 64 - 2 * np.bitwise_count((own[:, None] ^ other[None, :]).view(np.uint64)).astype(np.int64)  # of signed numbers it would count the absolute value
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(qids)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows]), pa.array(ids[order.ravel()]), pa.array(s[rows, order.ravel()].astype(np.float64))], names=SCORED.names)

    left = queries.where(F.col("bits").isNotNull()).select(F.col("qid").cast("long"), "bits").mapInArrow(pack, "ids binary, x binary").toDF("q", "qx")
    right = docs.where(F.col(bits).isNotNull()).select(F.col(key).cast("long"), bits).mapInArrow(pack, "ids binary, x binary")
    return top(left.crossJoin(right).mapInArrow(run, SCORED), k)  # blocks of a stated query set against blocks of all rows


def dense(docs: DataFrame, key: str, vec: str, queries: DataFrame, k: int, size: int = 64, block: int = 2_048) -> DataFrame:
    """(qid, id, score, rank): the k documents of the highest dot product with each query, exact.

    Blocks of documents pass each block of queries in one task; a pair of blocks is one matrix product, and the task keeps the k best of each query meanwhile. So what is written are the blocks of documents, once, and
    k rows a query and task, never all pairs, and neither side has to fit in memory.
    """
    rows = cut(_blocks(docs, key, vec, size, block).toDF("d", "dx"))
    asked = cut(_valid(queries, "qid", "qvec", size).toDF("qid", "qvec"))
    parts = max(1, -(-asked.count() // max(1, block // 2)))

    def pack(own: pa.Table) -> pa.Table:
        packed = own.column("qid").to_numpy(), own.column("qvec").combine_chunks().flatten().to_numpy()
        return pa.table([own.column("qb").slice(0, 1), *(pa.array([x.tobytes()]) for x in packed)], names=["qb", "q", "qx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            d, dx, qb, q, qx = batch.columns
            for i in range(batch.num_rows):
                if qb[i].as_py() not in held:
                    held[qb[i].as_py()] = _Best(np.array(_numbers(q, i, np.int64)), k), np.array(_numbers(qx, i, np.float64)).reshape(-1, size)
                best, own = held[qb[i].as_py()]
                best.offer(own @ _numbers(dx, i, np.float64).reshape(-1, size).T, _numbers(d, i, np.int64))
        for best, _ in held.values():
            yield best.batch()

    blocks = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")).groupBy("qb").applyInArrow(pack, "qb int, q binary, qx binary")
    return top(_pairs(rows, blocks, parts, run), k)


def fused(branches: list[DataFrame], constant: int = 60) -> DataFrame:
    """(qid, id, score): reciprocal rank fusion of ranked branches (qid, id, rank). An empty branch leaves the ranks of the others."""
    every = branches[0].select("qid", "id", "rank")
    for b in branches[1:]:
        every = every.unionByName(b.select("qid", "id", "rank"))
    return every.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))


def safe_enough(score: Column, threshold: float) -> Column:
    """Not known to be unsafe: rows without a score pass."""
    return ~F.coalesce(score >= threshold, F.lit(False))


def hybrid(docs: DataFrame, key: str, text: str, vec: str, queries: DataFrame, k: int = 10, offset: int = 0, most: int = 100, keep: Column | None = None, sparse: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, score): the k fused results after ``offset``. ``keep`` filters both branches before their candidates are cut, which
    no optimizer would do for it: a filter does not commute with a limit. ``sparse``: the lexical branch, of as many candidates or more, where it is made already."""
    candidates = max(most, (offset + k) * 2)
    rows = docs if keep is None else docs.where(keep)
    sparse = lexical(rows, key, text, queries, candidates) if sparse is None else sparse.where(F.col("rank") <= candidates)
    near = dense(rows, key, vec, queries.where("qvec is not null"), candidates)
    return top(fused([sparse, near]), offset + k).where(F.col("rank") > offset).select("qid", "rank", "id", "score")


def refused(queries: DataFrame, terms: DataFrame, concepts: DataFrame | None = None, least: float = 0.845, vec: str = "qvec") -> DataFrame:
    """(qid, reason): queries that are not answered. ``core`` holds a whole-word term (term, allowed) without any phrase that exempts it, wherever that stands; ``cosine`` comes as near as ``least`` to a
    concept vector (concept). A query without a valid vector, and a session without concepts, refuse nothing by cosine. Terms and concepts are lists of the service, not of its data."""
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    asked = queries.select("qid", spaced(canonical_query(F.col("text"))).alias("c"))
    named = asked.join(terms.select("term").distinct(), F.contains("c", spaced(F.col("term")))).select("qid", "c", "term")
    exempt = named.join(terms.where("allowed is not null and allowed <> ''"), "term").where(F.contains("c", spaced(F.col("allowed")))).select("qid", "term")
    core = named.join(exempt, ["qid", "term"], "left_anti").select("qid").distinct().withColumn("reason", F.lit("core"))
    if concepts is None:
        return core
    valid = queries.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select("qid", F.col(vec).alias("v"))
    folded = concepts.agg(F.collect_list("concept").alias("all"))
    near = F.array_max(F.transform("all", lambda c: dot(F.col("v"), c)))
    close = valid.crossJoin(F.broadcast(folded)).where(~F.isnan(near) & (near >= least)).select("qid").withColumn("reason", F.lit("cosine"))
    return core.unionByName(close.join(core.select("qid"), "qid", "left_anti"))


def answered(docs: DataFrame, key: str, text: str, vec: str, queries: DataFrame, classes: str = "", terms: DataFrame | None = None, concepts: DataFrame | None = None, k: int = 10, offset: int = 0, most: int = 100, score: str | None = None, threshold: float = 0.5) -> DataFrame:
    """(qid, rank, id, score, has_more, refusal): the search call for a batch of queries.

    An unknown class is an error before anything is read. A query that is empty in its canonical form has no rows. A refused one has one row, of its reason alone. The others are answered over the documents of the
    asked classes that aren't known to be unsafe, by both branches, or by the dense one alone where the lexical one finds nothing; one row more than the page is fetched, ``most`` at most, for ``has_more``.
    """
    wanted = asked_classes(classes)
    filled = queries.where(canonical_query(F.col("text")) != "")
    out = refused(filled, terms, concepts) if terms is not None else None
    open_ = filled if out is None else filled.join(out.select("qid"), "qid", "left_anti")
    keep = F.lit(True) if not wanted else F.col("license_class").isin(*wanted)
    if score is not None:
        keep = keep & safe_enough(F.col(score), threshold)
    fetched = min(k + 1, most)
    hits = hybrid(docs, key, text, vec, open_, fetched, offset, most, keep)
    more = F.count("*").over(W.partitionBy("qid")) > k
    page = hits.withColumn("has_more", more).where(F.col("rank") <= offset + k).withColumn("refusal", F.lit(None).cast("string"))
    if out is None:
        return page
    none = out.select("qid", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("has_more"), F.col("reason").alias("refusal"))
    return page.unionByName(none)


def saved_overlap(found: DataFrame, saved: DataFrame, k: int = 10) -> DataFrame:
    """(qid, shared, of): how many of the saved results of a query (qid, ids) its k best now hold."""
    now = found.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_list("id").alias("now"))
    both = saved.join(now, "qid", "left")
    return both.select("qid", F.size(F.array_intersect(F.coalesce("now", F.array().cast("array<bigint>")), "ids")).alias("shared"), F.size("ids").alias("of"))
