from __future__ import annotations

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.operators import retrieval as R
from lanternfish.operators import statistics as S
from lanternfish.operators import vectors as V


def test_dense_is_exact_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    x[7] = x[8]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(3)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
    got = {}
    for r in R.dense(rows, "id", "v", asked, 5, block=32).collect():
        got.setdefault(r.qid, {})[r.rank] = r.id
    for q in range(0, 300, 20):
        s = np.round(x.astype(float) @ x[q].astype(float), 6)
        assert [got[q][i] for i in range(1, 6)] == list(np.lexsort((np.arange(300), -s))[:5])
    assert R.dense(rows.limit(0), "id", "v", asked, 5).count() == 0


def test_fusion_and_fallback(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, id long, rank long")
    b = spark.createDataFrame([(1, 11, 1)], "qid long, id long, rank long")
    got = {r.id: r.score for r in R.fused([a, b]).collect()}
    assert got[11] == round(1 / 62 + 1 / 61, 6) and got[10] == round(1 / 61, 6)
    assert {r.id for r in R.fused([a, b.limit(0)]).collect()} == {10, 11}


def test_bm25_prefers_the_rarer_term(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the the cow"), (4, None), (5, "")], "id long, text string")
    asked = spark.createDataFrame([(9, "The cat cat")], "qid long, text string")
    top = R.top(R.bm25(R.postings(docs, "id", "text"), docs, "id", "text", asked), 10).orderBy("rank").collect()
    assert top[0].id == 1 and {r.id for r in top} == {1, 2, 3}


def test_null_scores_pass(spark):
    df = spark.createDataFrame([(None,), (0.9,), (0.1,)], "s double")
    assert df.where(R.safe_enough(F.col("s"), 0.5)).count() == 2


def test_quantised_codes(spark):
    v = [1.0, -0.5, 0.0, 2.0] + [0.0] * 60
    df = spark.createDataFrame([(v,)], "v array<double>")
    assert df.select(V.int8(F.col("v"), F.lit(1.0))).first()[0][:4] == [127, -64, 0, 127]
    assert df.select(V.hamming(V.sign_bits(F.col("v")), F.lit(0).cast("long"))).first()[0] == 2


def test_rank_statistics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1), (None, 1)], "s double, p int")
    assert S.auc(df, "s", "p").first().auc == 0.875
    xs = spark.createDataFrame([("a", float(x)) for x in (5, 1, 3, 3, 9)], "k string, v double")
    assert S.index_percentile(xs, ["k"], "v", 0.5, "m").first().m == 3.0
    assert S.index_percentile(xs, ["k"], "v", 0.95, "m").first().m == 9.0
    sweep = S.threshold_sweep(df, "s", "p", [0.0, 0.2, 0.6]).where("best").collect()
    assert [(r.threshold, r.caught, r.lost) for r in sweep] == [(0.6, 0.5, 0.0)]


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.exponential(size=501), "b": np.array([4.0] * 9), "c": np.array([1.0, 2.0]), "d": np.round(rng.normal(size=300), 1)}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None)], "k string, v double")
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in S.percentiles(df, ["k"], "v", shares).collect():
        for n, q in shares.items():
            assert abs(r[n] - np.quantile(data[r.k], q)) < 1e-9
    for r in S.index_percentile(df, ["k"], "v", 0.95, "x").collect():
        xs = sorted(data[r.k])
        assert r.x == xs[min(len(xs) - 1, int(len(xs) * 0.95))]


def test_order_statistics_with_outliers(spark):
    """One far value and one hot range: ranges are cut again until they are small, and the places are exact."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=3000), [1.7e308, -1.7e308, np.inf, -np.inf], np.repeat(0.25, 500)])
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)], "k string, v double")
    got = {r.k: r for r in S.at_places(rows, ["k"], "v", {"low": F.lit(0), "mid": F.floor(F.col("_n") / 2), "high": F.col("_n") - 1}, buckets=16, most=20).collect()}
    order = np.sort(x)
    assert (got["a"].low, got["a"].mid, got["a"].high) == (order[0], order[len(x) // 2], order[-1]) and got["b"].mid == 1.0
    one = S.percentiles(rows.where("k = 'a'"), [], "v", {"p": 0.3}).first().p
    assert one == pytest.approx(np.quantile(x, 0.3), rel=1e-12)


def test_lexical_blocks_equal_full_scores(spark):
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(w)}" for w in rng.zipf(1.5, size=int(n)) % 60)) for i, n in enumerate(rng.integers(0, 30, 200))], "id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q % 7} w1 w1 unknown") for q in range(40)] + [(99, "unknown"), (98, None)], "qid long, text string")
    want = sorted(map(tuple, R.top(R.bm25(R.postings(docs, "id", "text"), docs, "id", "text", asked), 5).select("qid", "rank", "id", "score").collect()))
    for n, m in ((2_048, 1_024), (16, 7)):
        got = R.lexical(docs, "id", "text", asked, 5, block_docs=n, block_queries=m).select("qid", "rank", "id", "score")
        assert sorted(map(tuple, got.collect())) == want
    assert R.lexical(docs.limit(0), "id", "text", asked, 5).count() == 0 and R.lexical(docs, "id", "text", asked.limit(0), 5).count() == 0


def test_prompts_in_parts_give_the_same(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 4)))], "id int, v array<double>")
    prompts = spark.createDataFrame([("ab"[i % 2], v.tolist()) for i, v in enumerate(rng.normal(size=(12, 4)))], "group string, prompt_vec array<double>")
    one, parts = (sorted(map(tuple, V.prompt_scores(rows, "id", "v", prompts, ["a", "b"], 2.0, -1.0, most_prompts=n).collect())) for n in (100, 3))
    assert one == parts and len(one) == 20


def shuffled(spark, df) -> int:
    """Bytes that all shuffles write while ``df`` is made (a function) and counted."""
    sc = spark.sparkContext._jsc.sc()

    def so_far() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = so_far()
    df().write.format("noop").mode("overwrite").save()
    return so_far() - before


def common(spark, docs: int, queries: int):
    """Documents and queries of few words, which most of them share, and vectors."""
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"w{int(w)}" for w in rng.integers(0, 40, n))
    rows = [(i, text(30), rng.normal(size=64).tolist()) for i in range(docs)]
    asked = [(q, text(8), rng.normal(size=64).tolist()) for q in range(queries)]
    return spark.createDataFrame(rows, "id long, text string, v array<double>").repartition(40, "id"), spark.createDataFrame(asked, "qid long, text string, qvec array<double>")


def test_lexical_sends_no_postings_to_queries(spark):
    docs, asked = common(spark, 2000, 600)
    assert shuffled(spark, lambda: R.lexical(docs, "id", "text", asked, 5, block_docs=256, block_queries=32)) < 5_000_000


def test_words_of_all_documents_count(spark):
    """A term that every document has weighs little, but its documents share it, as in SQL; ids decide ties across blocks."""
    docs = spark.range(40).selectExpr("id", "concat('all ', if(id = 33, 'one', 'other')) AS text").repartition(5)
    asked = spark.createDataFrame([(1, "all"), (2, "one all"), (3, "none")], "qid long, text string")
    got = {}
    for r in R.lexical(docs, "id", "text", asked, 4, block_docs=3, block_queries=1).orderBy("rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {1: [0, 1, 2, 3], 2: [33, 0, 1, 2]}


def test_dense_sends_few_rows_a_query(spark):
    docs, asked = common(spark, 2400, 400)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are too large for it
    try:
        assert shuffled(spark, lambda: R.dense(docs, "id", "v", asked, 50, block=32)) < 4_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_of_many_blocks(spark):
    """What is kept while blocks pass is what sorting all at once gives, with ties and less than k."""
    rng = np.random.default_rng(4)
    s, ids = np.round(rng.normal(size=(6, 500)), 1) + rng.uniform(-1e-8, 1e-8, (6, 500)), rng.permutation(500)
    s[5, 3:] = -1
    best = R._Best(np.arange(10, 16), 7, -0.5)
    for start in range(0, 500, 9):
        best.offer(s[:, start : start + 9], ids[start : start + 9])
    got = best.batch().to_pydict()
    for q in range(6):
        order = [i for i in np.lexsort((ids, -np.round(s[q], 6))) if s[q, i] >= -0.5][:7]
        assert [x for p, x in zip(got["qid"], got["id"], strict=True) if p == 10 + q] == list(ids[order])


def test_answers_send_no_postings_to_queries(spark, monkeypatch):
    docs, asked = common(spark, 2000, 600)
    docs = docs.withColumn("license_class", F.when(F.col("id") % 10 == 0, "public_domain").otherwise("attribution"))
    monkeypatch.setattr(R, "lexical", partial(R.lexical, block_docs=256, block_queries=32))
    assert shuffled(spark, lambda: R.answered(docs, "id", "text", "v", asked, "attribution", k=4, most=10)) < 16_000_000


def test_filtered_search_sends_no_postings_to_queries(spark, monkeypatch):
    docs, asked = common(spark, 2000, 600)
    monkeypatch.setattr(R, "lexical", partial(R.lexical, block_docs=256, block_queries=32))
    assert shuffled(spark, lambda: R.hybrid(docs, "id", "text", "v", asked, k=5, most=10, keep=F.col("id") % 10 != 0)) < 16_000_000


def test_saved_overlap_searches_texts_once(spark, monkeypatch):
    from lanternfish.plans import retrieval as plans

    calls, own = [], R.lexical
    monkeypatch.setattr(R, "lexical", lambda *a, **k: calls.append(1) or own(*a, **k))
    plans.saved_overlap(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
