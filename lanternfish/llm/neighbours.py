"""Problem 3: the most similar vectors of every vector, by NN-descent over Spark joins.

The graph starts from the blocks of ``vectorblocks`` (a random start never links far clusters) and is improved by rounds in which every two
neighbours of a vector are compared with each other; a round is a self-join of the graph on the middle vector. Rounds end when few
edges are new. ``search`` walks the finished graph greedily for a set of queries.

Classes of equal direction are one node. Defined cases: invalid vectors (null, another size, a number null or not finite, all zero) and null ids
are left out; an id counts once (of several different vectors, the least code); ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternfish.llm import vectorblocks as V
from lanternfish.session import cut, release


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each a, equal rows once. Each partition keeps its own k best before the shuffle, so a hub with very many edges sends few."""
    w = W.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    return edges.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k).drop("r").dropDuplicates(["a", "b"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *edges.columns[2:]))


def graph(held: DataFrame, k: int = 10, floor: float = -1.0, rounds: int = 6, least_new: float = 0.002, size: int = 64, plan: V.Plan = V.Plan(6, 1)) -> DataFrame:
    """(a, b, sim): for each class a up to k similar classes b, those below the cosine ``floor`` left out.

    A round compares two neighbours of a class if the edge to one of them is new; pairs of old ones were compared before. Rounds end when at most the share ``least_new`` of the edges is new.
    """
    met = cut(V.verified(V.links(held, floor, k, size, plan), held, floor, size))
    edges = cut(_best(_both_ways(met), k).withColumn("fresh", F.lit(True)))
    release(met)
    for _ in range(rounds):
        around = cut(_best(_both_ways(edges).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh")), 2 * k))
        one, two = around.where("fresh").select("a", F.col("b").alias("x")), around.select("a", F.col("b").alias("y"), "fresh")
        met = one.join(two, "a").where("x < y or (x > y and not fresh)")  # each pair with a new edge once
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        known = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = cut(V.similarity(pairs.join(known, ["a", "b"], "left_anti"), held, floor, size))
        fresh, before, old = new.count(), edges.count(), edges
        edges = cut(_best(edges.withColumn("fresh", F.lit(False)).unionByName(_both_ways(new).withColumn("fresh", F.lit(True))), k))
        release(old, new, around)
        if fresh <= least_new * before:
            break
    return edges.select("a", "b", "sim")


def nodes(df: DataFrame, key: str = "id", column: str = "vec", size: int = 64, similarity: float = 0.85, block_rows: int = 16_384) -> tuple[DataFrame, DataFrame, V.Plan]:
    """Members (id, c), one row per id, classes (c, code, light, tokens), and the plan of their tables for pairs of the given cosine."""
    rows = cut(V.coded(df, key, column, size))
    plan = V.planned(rows.count(), similarity, size, block_rows=block_rows)
    return rows.groupBy("id").agg(F.min("c").alias("c")), cut(V.classes(rows, size, plan.rotations)), plan


def _ranked(asked: DataFrame, members: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(id, other, sim, rank): for each asked id (id, c) its k best other ids, those of its own class and those of the classes near it: (a, b, sim)."""
    # The least k + 1 ids of a class are all that can be among the k most similar of any id. They are taken in two steps, as a class may be very large.
    part = W.partitionBy("c", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    heads = members.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    heads = heads.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy("id"))).where(F.col("r") <= k + 1).select("c", F.col("id").alias("other"))
    copied = heads.groupBy("c").count().where("count > 1").select("c")
    same = heads.join(copied, "c").withColumn("sim", F.lit(1.0).cast("float"))
    near = near.join(heads.withColumnRenamed("c", "b"), "b").select(F.col("a").alias("c"), "other", "sim")
    order = [F.col("sim").desc(), F.col("other")]
    listed = same.unionByName(near).withColumn("r", F.row_number().over(W.partitionBy("c").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    found = asked.join(listed, "c").where("id <> other")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("id", "other", "sim", "rank")


def most_similar(df: DataFrame, key: str = "id", column: str = "vec", k: int = 10, at_least: float = 0.85, slack: float = 0.15, size: int = 64, rounds: int = 6, block_rows: int = 16_384) -> DataFrame:
    """(id, other, sim, rank): for each id its k most similar other ids with a cosine of at least ``at_least``.

    The graph keeps edges down to ``at_least - slack``, over which the rounds walk. Where that is no bound to speak of, neighbours of a class hardly resemble each other, and the graph keeps twice k edges a class to
    walk over.
    """
    members, held, plan = nodes(df, key, column, size, max(at_least, 0.7), block_rows)
    edges = graph(held, k if at_least - slack >= 0.5 else 2 * k, max(-1.0, at_least - slack), rounds, size=size, plan=plan).where(F.col("sim") >= at_least)
    return _ranked(members, members, edges, k)


def pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs in which one is among the most similar of the other."""
    return neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def _entries(held: DataFrame, size: int, per_query: int, tokens: int = 6) -> DataFrame:
    """(c, key): combinations of the first ``tokens`` tokens, of as many as keep the chance meetings of a query few."""
    n = held.count()
    m = next((m for m in range(1, tokens) if n / (2 * size) ** m * comb(tokens, m) <= per_query), tokens - 1)
    keys = [F.xxhash64(*[F.col("tokens")[i] for i in c]) for c in combinations(range(tokens), m)]
    return held.select("c", F.explode(F.array(*keys)).alias("key"))


def search(asked: DataFrame, held: DataFrame, edges: DataFrame, k: int = 10, beam: int = 40, hops: int = 4, floor: float = -1.0, size: int = 64, per_query: int = 64) -> DataFrame:
    """(a, b, sim, r): for each asked class (c) its k best others, by greedy search of the graph.

    A search starts from classes that share a combination of tokens with it (of a key's classes at most ``per_query``; they only begin the walk). Each hop follows all edges, in both directions, of
    the best ``beam`` classes so far, and the walk ends when a hop finds nothing new for any search.
    """
    keyed = _entries(held, size, per_query)
    mine = cut(keyed.join(asked.select("c").distinct(), "c", "left_semi").withColumnRenamed("c", "a"))
    # Keys that no search has are of no use, and nearly all are. The list of the others is written, so that its true size decides how it is joined.
    wanted = keyed.join(cut(mine.select("key").distinct()), "key", "left_semi")
    part = W.partitionBy("key", F.pmod(F.xxhash64("c"), F.lit(16))).orderBy("c")
    starts = wanted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= per_query)
    starts = starts.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("c"))).where(F.col("r") <= per_query).select("key", F.col("c").alias("b"))
    met = mine.join(starts, "key").where("a <> b").select("a", "b").distinct()
    own = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    known = own.join(asked.select(F.col("c").alias("a")).distinct(), "a", "left_semi")  # an asked class that is a node starts from its own edges too
    seen = cut(V.similarity(met.unionByName(known).distinct(), held, floor, size))
    best = _best(seen, beam)
    steps = own.select(F.col("a").alias("b"), F.col("b").alias("x"))
    for _ in range(hops):
        onward = best.join(steps, "b").where("a <> x").select("a", F.col("x").alias("b")).distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti")
        new = cut(V.similarity(onward, held, floor, size))
        if not new.take(1):
            break
        seen, old = seen.unionByName(new), best
        best = cut(_best(seen, beam))
        release(old)
    return best.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.col("sim").desc(), "b"))).where(F.col("r") <= k)


def searched(df: DataFrame, key: str = "id", column: str = "vec", every: int = 20, k: int = 10, at_least: float = 0.85, slack: float = 0.15, size: int = 64, **how: int) -> DataFrame:
    """(id, other, sim, rank): for every id whose checksum is divisible by ``every``, its k best others of at least ``at_least``, copies of it and of them included."""
    members, held, plan = nodes(df, key, column, size, max(at_least, 0.7))
    edges = graph(held, k, max(-1.0, at_least - slack), size=size, plan=plan)
    asked = cut(members.where(F.crc32("id") % every == 0))
    found = search(asked.select("c"), held, edges, k, floor=at_least, size=size, **how)
    return _ranked(asked, members, found, k).withColumn("sim", F.round("sim", 4))
