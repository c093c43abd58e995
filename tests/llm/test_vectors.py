"""Problems 3 and 5 against brute force."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from lanternfish.llm import near_duplicates as D
from lanternfish.llm import neighbours as N
from lanternfish.llm import vectorblocks as V
from lanternfish.llm.queries import QUERIES
from lanternfish.session import table


def cluster_vectors(n=600, clusters=40, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 64))
    x = rng.normal(size=(n, 64))
    for i in range(n // 2):
        x[i] = centres[i % clusters] + rng.normal(size=64) * rng.choice([0.02, 0.2, 0.4])
    return {f"v{i:04d}": v * rng.uniform(0.5, 3) for i, v in enumerate(x.astype(np.float32))}


def frame(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in vectors], "id string, vec array<float>")


def cosines(vectors):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids, x @ x.T


BAD = [("b1", None), ("b2", [1.0] * 63), ("b3", [0.0] * 64), ("b4", [math.nan] + [1.0] * 63), ("b5", [math.inf] + [1.0] * 63), ("b6", [None] + [1.0] * 63), (None, [1.0] * 64)]


def expected_pairs(vectors, k=10, least=0.85):
    ids, s = cosines(vectors)
    np.fill_diagonal(s, -2)
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in np.lexsort((np.arange(len(ids)), -np.round(s[i], 6)))[:k] if s[i, j] >= least}


def test_recall_of_the_graph(spark, cluttered):
    vectors = cluster_vectors()
    got = {tuple(r) for r in N.pairs(N.most_similar(cluttered(frame(spark, [*vectors.items(), *list(vectors.items())[:9], *BAD])))).collect()}
    want = expected_pairs(vectors)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_copies_and_ties(spark):
    rows = [(f"c{i:03d}", [2.0 * (i % 3 + 1)] + [1.0 * (i % 3 + 1)] * 63) for i in range(50)]
    got = N.most_similar(frame(spark, rows)).collect()
    assert len(got) == 500 and {r.other for r in got} == {f"c{i:03d}" for i in range(11)}


def test_greedy_search(spark):
    vectors = cluster_vectors()
    found = N.searched(frame(spark, vectors.items()), every=5).collect()
    ids, s = cosines(vectors)
    np.fill_diagonal(s, -2)
    place, got = {x: i for i, x in enumerate(ids)}, {}
    for r in found:
        got.setdefault(r.id, set()).add(r.other)
    asked = [x for x in ids if zlib.crc32(x.encode()) % 5 == 0]
    want = {(x, ids[j]) for x in asked for j in np.argsort(-s[place[x]], kind="stable")[:10] if s[place[x], j] >= 0.85}
    assert len(want) > 50 and sum(b in got.get(a, ()) for a, b in want) >= 0.9 * len(want)
    assert N.searched(frame(spark, BAD)).count() == 0


def test_search_gives_copies(spark):
    x = np.random.default_rng(8).normal(size=64)
    y = x + 0.1 * np.random.default_rng(9).normal(size=64)
    vectors = {"a1": x, "a2": 2 * x, "a3": x, "b1": y, "b2": 2 * y, "far": -x}
    got = {(r.id, r.rank): (r.other, r.sim) for r in N.searched(frame(spark, vectors.items()), every=1, k=4).collect()}
    assert [got[("a2", r)][0] for r in range(1, 5)] == ["a1", "a3", "b1", "b2"] and got[("a2", 1)][1] == 1
    assert [got[("b1", r)][0] for r in range(1, 5)] == ["b2", "a1", "a2", "a3"] and ("far", 1) not in got
    many = {f"c{i:02d}": x * (i + 1) for i in range(30)}
    assert {(r.id, r.other) for r in N.searched(frame(spark, many.items()), every=1, k=3).collect()} == {(a, b) for a in many for b in [m for m in sorted(many) if m != a][:3]}


def test_empty(spark):
    assert N.most_similar(frame(spark, BAD)).count() == 0
    assert D.id_pairs(*D.similar_vectors(frame(spark, BAD))).count() == 0


def test_full_graph_recall_on_given_vectors(spark):
    df = table(spark, "/root/testdata/sf0.001", "vectors")
    vectors = {r.id: r.vec for r in df.collect() if r.id and r.vec and len(r.vec) == 64 and all(x is not None and math.isfinite(x) for x in r.vec) and any(r.vec)}
    ids, s = cosines(vectors)
    np.fill_diagonal(s, -2)
    got = {}
    for r in N.most_similar(df, at_least=-1.0).collect():
        got.setdefault(r.id, set()).add(r.other)
    hits = sum(len(got.get(ids[i], set()) & {ids[j] for j in np.argsort(-s[i], kind="stable")[:10]}) for i in range(len(ids)))
    assert hits >= 0.9 * 10 * len(ids)


@pytest.mark.parametrize("block_rows", [16_384, 2])
@pytest.mark.parametrize("piece_rows", [16_384, 5])
def test_all_pairs_above_a_threshold(spark, block_rows, piece_rows):
    vectors = cluster_vectors()
    members, held, plan = N.nodes(frame(spark, vectors.items()), similarity=0.95, block_rows=block_rows)
    assert plan.joined == (1 if block_rows > 600 else 2) and plan.tables >= 6
    got = {tuple(r) for r in D.id_pairs(members.withColumnRenamed("c", "s"), V.verified(V.links(held, 0.95, plan=plan, piece_rows=piece_rows), held, 0.95).select("a", "b")).collect()}
    ids, s = cosines(vectors)
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(s >= 0.95), strict=True) if i < j}
    assert len(got & want) >= 0.97 * len(want) and got <= {(ids[i], ids[j]) for i, j in zip(*np.nonzero(s >= 0.9499), strict=True) if i < j}


@pytest.mark.parametrize("similarity", [0.85, 0.95])
def test_a_pair_meets_as_often_at_any_size(similarity):
    """As tokens join, tables are added: the chance to miss all of them never grows, while mean blocks stay small."""
    p = V.collision(similarity, 64)
    for rows in (10**3, 10**6, 10**8, 10**10, 10**12):
        plan = V.planned(rows, similarity)
        assert (1 - p**plan.joined) ** plan.tables <= (1 - p) ** 6 + 1e-9 and rows / 128**plan.joined <= 16_384


def test_recall_of_the_graph_with_joined_tokens(spark):
    vectors = cluster_vectors()
    got = {tuple(r) for r in N.pairs(N.most_similar(frame(spark, vectors.items()), block_rows=2)).collect()}
    want = expected_pairs(vectors)
    assert len(got & want) >= 0.97 * len(want)


def test_one_shared_token_is_enough_however_frequent(spark):
    n = 16_390
    x = np.random.default_rng(3).normal(size=(n, 64))
    x[1] = x[0] + 0.01 * x[1]
    light = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
    rows = [(i.to_bytes(16, "big"), bytearray(v.tobytes()), [0, *(6 * i + j for j in range(1, 6))]) for i, v in enumerate(light)]
    held = spark.createDataFrame(rows, "c binary, light binary, tokens array<int>")
    assert {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in V.links(held, 0.95).collect()} == {(0, 1)}


def test_p3_found_leaves_the_rounds_to_the_operator(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(N, "most_similar", lambda df, **how: seen.append(how) or df.selectExpr("id", "id AS other"))
    QUERIES["p3_found"](spark, "/root/testdata/sf0.001")
    assert seen == [{}]
