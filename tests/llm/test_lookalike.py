from __future__ import annotations

import pytest

from lanternfish.llm import lookalike as L

SAME = [
    ("Café at 10", "Café at 10"), ("plate 7", "ｐｌａｔｅ　７"), ("a b", "a b"), ("a b", " a  \n b "), ("stair", "st​ai­r"), ("scope", "ѕсоре"),
    ("Avelm", "Аνеlm"), ("II", "Ⅱ"), ("fine", "ﬁne"), ("a-b", "a‑b"), ("ό", "ó"), ("﻿x", "x"),
]
OTHER = [("a", "A"), ("e", "é"), ("a.b", "ab"), ("<b>x</b>", "x"), ("a-b", "a–b"), ("O", "0"), ("ss", "ß"), ("a b", "ab")]


def pairs(spark, rows, more=lambda d: d):
    return sorted(map(tuple, L.same_looking_pairs(more(spark.createDataFrame(rows, "id string, title string")), "id", "title").collect()))


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(spark, a, b):
    assert pairs(spark, [("1", a), ("2", b)]) == [("1", "2")]


def test_different(spark):
    rows = [(f"{i}{k}", x) for i, p in enumerate(OTHER) for k, x in zip("ab", p, strict=True)]
    found = pairs(spark, rows)
    assert not [p for p in found if p[0][:-1] == p[1][:-1]]


def test_edges(spark, cluttered):
    rows = [("1", None), ("2", ""), ("3", " "), ("4", "x"), ("4", "x"), ("5", "x"), ("6", "х"), (None, "х"), ("7", "y" * 200_000), ("8", "y" * 200_000 + "​")]
    assert pairs(spark, rows, cluttered) == [("2", "3"), ("4", "6"), ("5", "6"), ("7", "8")]
    assert pairs(spark, rows[:0] or [("1", None)]) == []


def test_canonical_member_is_the_same_for_a_class(spark):
    df = spark.createDataFrame([(x,) for p in SAME for x in p], "title string")
    got = {r.value: r.canonical for r in L.canonical_values(df, "title").collect()}
    assert all(got[a] == got[b] for a, b in SAME)


def test_consistent_form(spark):
    df = spark.createDataFrame([("Ｃａｆｅ́ ",), (None,), ("х",)], "t string")
    assert [r.f for r in L.consistent_form(df, "t", "f").collect()] == ["Café", None, "x"]


def test_ids_with_equal_titles_never_meet(spark):
    """A placeholder of 100,000 ids and one look-alike of it: as many pairs as ids, not their square."""
    from pyspark.sql import functions as F

    df = spark.range(100_000).select(F.col("id").cast("string"), F.lit("untitled").alias("title")).unionAll(spark.createDataFrame([("x", "untіtled")], "id string, title string"))
    assert L.same_looking_pairs(df, "id", "title").count() == 100_000
