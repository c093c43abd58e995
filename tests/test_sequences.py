from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from lanternfish.operators import sequences as S


def frame(spark, values, names="k string, t int, v double"):
    return spark.createDataFrame(values, names)


def test_streaks_reset_and_stop(spark):
    rows = frame(spark, [("a", i, v) for i, v in enumerate([1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])])
    got = [r.streak for r in S.streak(rows, "k", ["t"], F.floor(F.col("t") / 3), F.col("v") == 0).orderBy("t").collect()]
    assert got == [0, 1, 2, 0, 1, 2, 3, 0]
    kept = S.until(S.streak(rows, "k", ["t"], F.floor(F.col("t") / 3), F.col("v") == 0), "k", ["t"], F.floor(F.col("t") / 3), F.col("streak") >= 3)
    assert kept.count() == 7


def test_depth_cap_keeps_the_crossing_page(spark):
    rows = frame(spark, [("a", i, 4.0) for i in range(5)])
    assert [r.kept for r in S.depth_capped(rows, "k", ["t"], F.floor(F.col("t") / 2), "v", 10).orderBy("t").collect()] == [4, 8, 12]


def test_pace_needs_time_and_growth(spark):
    rows = frame(spark, [("a", 0, 0.0), ("a", 10, 5.0), ("a", 60, 60.0), ("a", 5000, 60.0)])
    assert [r.per_minute for r in S.trailing_pace(rows, "k", "t", "v", 900).orderBy("t").collect()] == [None, None, 60.0, None]


def test_thinning_law(spark):
    times = [0, 3, 5, 9, 10, 14, 15, 30, 30, 34]
    rows = spark.createDataFrame([(k, t) for k in "ab" for t in times], "k string, t int")
    kept = sorted(r.t for r in S.thinned(rows, "k", "t", 5).where("k = 'a'").collect())
    last, expected = None, []
    for t in times:
        if last is None or t - last >= 5:
            expected.append(t)
            last = t
    assert kept == expected
    assert S.thinned(rows.limit(0), "k", "t", 5).count() == 0


def test_cache_replay(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 100, 120, 121, 121, 300)], "k string, t int")
    assert [r.hit for r in S.cache_replay(rows, "k", "t", 120).orderBy("t", "hit").collect()] == [False, True, True, False, True, False]


def test_most_at_once(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 5, 8), ("a", 10, 12), ("b", 0, 1)], "k string, s int, e int")
    assert dict(map(tuple, S.most_at_once(rows, "k", "s", "e", 4.0).collect())) == {"a": 2, "b": 1}


def test_carried_header(spark):
    rows = spark.createDataFrame(list(enumerate(["# x", "1", "2", "# y", "3"])), "i int, line string")
    header = F.when(F.col("line").startswith("# "), F.substring("line", 3, 99))
    assert [r.section for r in S.carried_header(rows, "i", header).orderBy("i").collect()] == ["x", "x", "x", "y", "y"]


def test_two_levels_equal_one(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), ((F.col("id") * 7919) % 101).alias("v"))
    for how, inclusive in (("sum", True), ("sum", False), ("max", True)):
        got = {(r.k, r.t): r.x for r in S.running(rows, "k", ["t"], F.floor(F.col("t") / 37), how, F.col("v"), "x", inclusive).collect()}
        state = {}
        for r in rows.orderBy("t").collect():
            before = state.get(r.k, 0)
            state[r.k] = before + r.v if how == "sum" else max(before, r.v)
            assert got[r.k, r.t] == (state[r.k] if inclusive else before)


def test_breaker(spark):
    rows = spark.createDataFrame([("a", i, int(i == 4)) for i in range(9)] + [("b", i, i % 2) for i in range(30)], "k string, t int, n int")
    marked = S.barren_break(rows, "k", ["t"], F.floor(F.col("t") / 3), F.col("n") == 0, limit=4, fail=False)
    assert {(r.k, r.t) for r in marked.where("tripped").collect()} == {("a", 3), ("a", 8)}
    assert S.barren_break(rows, "k", ["t"], F.floor(F.col("t") / 3), F.col("n") == 0, limit=5).count() == 39
    with pytest.raises(Exception, match="4 barren pages in a row of a"):
        S.barren_break(rows, "k", ["t"], F.floor(F.col("t") / 3), F.col("n") == 0, limit=4).collect()


def test_lru_cache(spark):
    import random

    r = random.Random(2)
    asked = [("k%d" % (i % 2), i, r.choice("abcdef")) for i in range(400)]
    want = []
    caches = {}
    for k, t, x in asked:
        c = caches.setdefault(k, {})
        filled = c.pop(x, None)
        hit = filled is not None and t - filled < 40
        c[x] = filled if hit else t
        if len(c) > 3:
            del c[next(iter(c))]
        want.append((k, t, x, hit))
    got = S.lru_replay(spark.createDataFrame(asked, "k string, t int, x string"), "k", ["t"], "x", "t", 3, 40.0)
    assert sorted((r.k, r.t, r.x, r.hit) for r in got.collect()) == sorted(want)


def test_ring_keeps_the_last(spark):
    rows = spark.createDataFrame([("a", float(t)) for t in range(100)], "k string, t double")
    assert [r.t for r in S.thinned(rows, "k", "t", 5.0, most=3).orderBy("t").collect()] == [85.0, 90.0, 95.0]


def test_headers_are_carried_over_chunks(spark):
    rows = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") % 170 == 3, F.concat(F.lit("h"), F.col("id"))).alias("h"))
    got = {r.i: r.s for r in S.carried_header(rows, "i", F.col("h"), "s", rows=64).collect()}
    assert got == {i: None if i < 3 else f"h{(i - 3) // 170 * 170 + 3}" for i in range(1000)}
