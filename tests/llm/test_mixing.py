from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanternfish.llm import mixing as M


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"), (F.col("id") % 50 + (F.col("id") % 7 == 0).cast("int")).cast("int").alias("n_tokens"), (0.1 + F.col("id") % 3 * 0.45).alias("quality"))
    return rows.withColumnRenamed("id", "doc_id").unionAll(spark.createDataFrame([(9001, "x", 10, 1.0), (9002, None, 10, 1.0)], "doc_id long, source string, n_tokens int, quality double"))


@pytest.mark.parametrize("ranges", [None, 50])
def test_shares_and_caps(documents, targets, ranges):
    mix = M.mixed(documents, targets, ranges=ranges)
    report = {r.source: r for r in M.shares(documents, mix, targets).collect()}
    assert set(report) == {"a", "b", "c"}
    for r in report.values():
        assert abs(r.actual_share - r.target_share) < 0.005
    assert report["c"].most_copies <= 4 and report["b"].most_copies <= 2 and report["a"].most_copies == 1
    rows = mix.collect()
    assert len({r.doc_id for r in rows}) == len(rows)


def test_whole_epochs_precede_the_sample(documents, targets):
    copies = {r.doc_id: r.copies for r in M.mixed(documents, targets).where("source = 'b'").collect()}
    plan = M.budgets(documents, targets).where("source = 'b'").first()
    held = documents.where("source = 'b' and n_tokens > 0").count()
    assert set(copies.values()) <= {plan.epochs, plan.epochs + 1}
    assert plan.epochs == 0 or len(copies) == held


def test_order_equals_a_sort_of_all_keys(documents, targets):
    one = sorted(map(tuple, M.mixed(documents, targets, ranges=1).collect()))
    assert one == sorted(map(tuple, M.mixed(documents, targets, ranges=40).collect()))


def test_quality_raises_the_chance(documents, targets):
    got = M.mixed(documents, targets).where("source = 'a'").join(documents.select("doc_id", "quality"), "doc_id").groupBy(F.round("quality", 2).alias("q")).count().collect()
    n = {r.q: r["count"] for r in got}
    assert not n or n.get(1.0, 0) >= n.get(0.1, 0)


def test_whole_pipeline_and_edges(spark, targets, cluttered):
    rows = [(i, "The old mill stands by the river and it is full of light. " * (i % 5), s) for i, s in enumerate("aaaaaabbbbcc")] + [(50, None, "a"), (51, "", "b"), (52, "x", None)]
    df = cluttered(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sized = M.sized(df, targets)
    assert sized.count() == 14
    mix = M.mixed(sized, targets)
    assert mix.where("n_tokens = 0").count() == 0 and mix.where("source is null").count() == 0
    assert M.mixed(sized.limit(0), targets).count() == 0
    assert {r.source: r.used_tokens for r in M.shares(sized.limit(0), M.mixed(sized.limit(0), targets), targets).collect()} == {"a": 0, "b": 0, "c": 0}


def test_ranges_are_even_when_qualities_are_mixed(spark):
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(2**40)) + 1) / 2.0**40
    rows = spark.range(40_000).withColumnRenamed("id", "doc_id").select("doc_id", F.lit("a").alias("source"), (-F.log(u) / F.when(F.col("doc_id") % 3 == 0, 0.1).otherwise(1.0)).alias("k"))
    sizes = [r["count"] for r in M.ranged(rows, "doc_id", 16).groupBy("range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 2 * 40_000 / 16
