from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import relational as R


def test_keyed_writes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn("s", F.lit(0))
    batch = spark.createDataFrame([(2, "x", 1), (3, "y", 1), (3, "z", 2)], "k int, v string, s int")
    assert sorted(map(tuple, R.insert_ignore(base, batch, "k", [F.col("s")]).select("k", "v").collect())) == [(3, "y")]
    assert sorted(map(tuple, R.upsert(base, batch, "k", [F.desc("s")]).select("k", "v").collect())) == [(1, "a"), (2, "x"), (3, "z")]
    update = spark.createDataFrame([(1, None), (2, "new")], "k int, v string")
    assert sorted(map(tuple, R.merge_payload(base, update, "k").select("k", "v").collect())) == [(1, "a"), (2, "new")]
    assert R.insert_ignore(base, batch.limit(0), "k", [F.col("s")]).count() == 0


def test_first_place_last_value(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, p int, v string")
    assert sorted(map(tuple, R.first_place_last_value(rows, "k", "p", "v").collect())) == [("a", 1, "z"), ("b", 2, "y")]


def test_numbering_is_total_and_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = R.numbered(rows, ["k"]).orderBy("n").collect()
    assert [r.k for r in got] == list(range(1000)) and [r.n for r in got] == list(range(1000))
    parts = R.stride(rows, ["k"], 7).groupBy("worker").count().collect()
    assert len(parts) == 7 and max(r["count"] for r in parts) - min(r["count"] for r in parts) <= 1
    assert R.chunks(rows, ["k"], 100).groupBy("chunk").count().where("count = 100").count() == 10


def test_page(spark):
    rows = spark.range(49)
    first, last = R.page(rows, [F.col("id")], 0, 48), R.page(rows, [F.col("id")], 48, 48)
    assert first.count() == 48 and first.where("has_more").count() == 48
    assert [(r.id, r.has_more) for r in last.collect()] == [(48, False)]


def test_copy_is_verified(spark):
    assert R.same_count(spark.range(3), spark.range(2)).first().copied == 3
    with pytest.raises(Exception, match="holds less"):
        R.same_count(spark.range(1), spark.range(2)).collect()


def test_two_unique_keys(spark):
    """As rows are inserted one after the other: a row that was left out blocks no other."""
    import random

    r = random.Random(6)
    rows = [(i, r.randint(0, 25), r.choice([None, *range(25)])) for i in range(120)]
    held = [(200, 3, 4), (201, 9, None)]
    one, two, want = {3, 9}, {4}, []
    for i, a, b in rows:
        if a not in one and b not in two:
            want.append(i)
            one.add(a)
            two |= {b} - {None}
    schema = "i int, a int, b int"
    got = R.insert_unique(spark.createDataFrame(held, schema), spark.createDataFrame(rows, schema), ["a", "b"], ["i"])
    assert sorted(x.i for x in got.collect()) == want
    assert R.insert_unique(spark.createDataFrame(held, schema), spark.createDataFrame([], schema), ["a", "b"], ["i"]).count() == 0


def test_a_committed_page_is_not_committed_again(spark):
    held = spark.createDataFrame([("t", 1, 5)], "topic string, page int, raw int")
    assert R.insert_strict(held, spark.createDataFrame([("t", 2, 7)], held.schema), ["topic", "page"]).count() == 2
    with pytest.raises(Exception, match="there already"):
        R.insert_strict(held, spark.createDataFrame([("t", 1, 7)], held.schema), ["topic", "page"]).collect()


def test_pages_probes_and_groups(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    after, seen = None, []
    while page := [r.k for r in R.keyset_page(df, "k", after, 300).collect()]:
        seen += page
        after = page[-1]
    assert seen == list(range(1000))
    one, other = ([r.k for r in R.probe(df, "k", seed, 50).collect()] for seed in (0, 1))
    assert one == [r.k for r in R.probe(df.repartition(7), "k", 0, 50).collect()] and len(set(one)) == 50 and one != other
    assert sorted(r.k for r in R.missing_page(df.limit(10), spark.createDataFrame([(0,), (3,)], "k long"), spark.createDataFrame([(1,)], "k long"), "k", [F.col("k")], 104, 100).collect()) == [2, 4, 5, 6]
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, None)], "n int, g string")
    assert [(r.g, r.group, r.rows) for r in R.grouped_in_order(rows, "g", F.col("n"), "n").orderBy("group").collect()] == [("b", 1, 2), (None, 2, 1), ("a", 3, 1), (None, 4, 1)]
