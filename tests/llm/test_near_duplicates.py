from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lanternfish.llm import near_duplicates as D


def titles(seed=2, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = {}
    for i in range(n):
        base = r.sample(vocabulary, r.randint(6, 14)) if i % 2 or not out else list(r.choice(list(out.values())))
        for _ in range(r.randint(0, 2)):
            base[r.randrange(len(base))] = r.choice(vocabulary)
        r.shuffle(base)
        out[f"t{i:03d}"] = base
    return out


def brute(sets, threshold=0.8, least=8):
    ids = sorted(k for k, v in sets.items() if len(set(v)) >= least)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(set(sets[a]) & set(sets[b])) >= threshold * len(set(sets[a]) | set(sets[b])) - 1e-9}


@pytest.mark.parametrize("how", [{}, {"rare": 2}, {"rare": 0, "k": 2}, {"rare": 1, "k": 4}, {"rare": 3, "long_words": 9}, {"rare": 0, "k": 1}])
def test_equals_brute_force(spark, cluttered, how):
    sets = titles()
    df = cluttered(spark.createDataFrame([(k, " ".join(v) + ".jpg") for k, v in sets.items()], "id string, title string"))
    got = {tuple(r) for r in D.id_pairs(*D.similar_titles(df, **how)).collect()}
    assert got == brute(sets)


def test_long_titles_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    sets = {}
    for i in range(120):
        base = r.sample(vocabulary, r.randint(30, 150)) if i % 3 == 0 else list(sets[f"t{i - i % 3:03d}"])
        edits = r.randint(0, len(base) // 8)
        sets[f"t{i:03d}"] = base[edits:] + r.sample(vocabulary, r.randint(0, len(base) // 10))
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in sets.items()], "id string, title string")
    assert len(brute(sets)) > 60
    for rare in (64, 0):
        assert {tuple(x) for x in D.id_pairs(*D.similar_titles(df, rare=rare)).collect()} == brute(sets)


def test_a_hot_word_of_long_titles_makes_no_long_list(spark):
    """All sets share a word; keys are the words of a class of tokens together, so no key holds them all."""
    rows = spark.range(2_000).select(F.col("id").alias("s"), F.lit(60).alias("n"), F.concat(F.array(F.lit("the")), F.transform(F.sequence(F.lit(1), F.lit(59)), lambda i: F.concat(F.col("id"), F.lit("-"), i))).alias("words"))
    longest = D.class_combinations(rows, 0.8).groupBy("key").count().agg(F.max("count")).first()[0]
    assert longest < 2_000 / 4


def test_words(spark):
    rows = [("The <b>Old</b> Mill, ｎｏ. 7_b&amp;c.JPEG",), ("x.tar.png ",), (None,), ("",), ("<i></i>.gif",)]
    got = [r.w for r in D.title_words(spark.createDataFrame(rows, "title string"), "title", "w").collect()]
    assert got == [["7", "b", "c", "mill", "no", "old", "the"], ["tar", "x"], None, [], []]


def test_edges(spark):
    eight = "a b c d e f g h"
    rows = [("1", eight), ("1", eight), ("2", eight.upper()), ("3", eight + " i"), ("4", "a b c d e f g"), ("5", None), ("6", ""), (None, eight), ("7", " ".join(f"x{i}" for i in range(5000))), ("8", " ".join(f"x{i}" for i in range(4100)))]
    df = spark.createDataFrame(rows, "id string, title string")
    assert {tuple(r) for r in D.id_pairs(*D.similar_titles(df)).collect()} == {("1", "2"), ("1", "3"), ("2", "3"), ("7", "8")}
    groups = {r.id: r for r in D.groups(*D.similar_titles(df)).collect()}
    assert (groups["2"].class_id, groups["2"].copies, groups["2"].links, groups["3"].links) == ("1", 2, 1, 1)
    assert D.id_pairs(*D.similar_titles(df.limit(0))).count() == 0


def test_pairs_of_either_kind_count_once(spark):
    t = "a b c d e f g h"
    images = spark.createDataFrame([("1", t), ("2", t), ("3", "x")], "id string, title string")
    vectors = spark.createDataFrame([("1", [1.0] * 64), ("2", [1.0] * 64), ("3", [1.0] * 64)], "id string, vec array<double>").withColumn("vec", F.col("vec").cast("array<float>"))
    assert sorted(map(tuple, D.near_duplicate_pairs(images, vectors).collect())) == [("1", "2"), ("1", "3"), ("2", "3")]
