from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.operators import approximate as A
from lanternfish.operators import retrieval as R
from lanternfish.operators import vectors as V


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 64))
    x = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 64)) * 0.6
    bad = [(9001, None), (9002, [1.0] * 3), (9003, [float("nan")] * 64)]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "id long, v array<double>")


def asked(rows):
    return rows.where("id % 20 = 0 or id > 9000").select(F.col("id").alias("qid"), F.col("v").alias("qvec"))


@pytest.mark.parametrize("piece_rows", [16_384, 20])
def test_cells(rows, piece_rows):
    q = asked(rows)
    exact = R.dense(rows, "id", "v", q.where("qid < 9000"), 10)
    own = A.cells(rows, "id", "v")
    assert 1 <= own.probes < len(own.centres)
    assert V.overlap(A.search(rows, "id", "v", q, 10, own, piece_rows=piece_rows), exact, 10).first().recall >= 0.9
    assert A.search(rows.limit(0), "id", "v", q, 10, A.cells(rows.limit(0), "id", "v")).count() == 0


def test_product_codes(rows):
    q = asked(rows)
    exact = R.dense(rows, "id", "v", q.where("qid < 9000"), 10)
    books = A.product_codes(rows, "id", "v", 16)
    assert V.overlap(A.search_codes(rows, "id", "v", q, 10, books), exact, 10).first().recall >= 0.9
    assert A.search_codes(rows.limit(0), "id", "v", q, 10, A.product_codes(rows.limit(0), "id", "v", 16)).count() == 0


def test_kmeans_finds_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(50, 4)) * 0.1 + c for c in np.eye(4) * 10])
    error = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).mean()
    assert error(A.kmeans(x, 16)) < error(A.kmeans(x, 1)) / 20 and len(A.kmeans(x[:0], 4)) == 0
