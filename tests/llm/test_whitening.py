import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voucherlake.llm import queries, whitening

DATA = "/root/testdata/sf0.01"


def plain(vectors, count=4):
    """(n, deviations, whitened, explained) with the whole covariance matrix and exact whole numbers."""
    whole = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, whole)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh(x.T @ x / n)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in whole]
    centred = np.array(whole, float) - np.array([s / n for s in sums])
    return n, deviations, centred @ axes / np.sqrt(values), values / (x * x).sum() * n


def agrees(found, vectors, count=4):
    n, deviations, whitened, explained = plain(vectors, count)
    assert len(found) == len(vectors) * count
    for k in range(count):
        rows = sorted((r for r in found if r.component == k + 1), key=lambda r: r.vec_id)
        got = np.array([r.whitened for r in rows])
        assert np.abs(got * np.sign(got @ whitened[:, k]) - whitened[:, k]).max() < 1e-9
        assert [r.deviation for r in rows] == deviations and {r.n for r in rows} == {n}
        assert all(abs(r.explained / explained[k] - 1) < 1e-12 and r.identity_error < 1e-12 for r in rows)


def usable(rows):
    return sorted((r.vec_id, r.embedding) for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding))


def test_the_query_against_the_whole_matrix(spark):
    rows = usable(spark.read.parquet(f"{DATA}/embeddings.parquet").collect())
    agrees(queries.op11(spark, DATA).collect(), [v for _, v in rows])


def test_repeats_count_once_in_the_fit_and_odd_rows_go(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1 + 3 * k) for k in range(6)] for _ in range(50)]
    rows = [(i, v) for i, v in enumerate(vectors + [vectors[0]] * 300)]
    odd = [(1000, None), (1001, [1.0] * 5 + [None]), (1002, [math.nan] * 6), (1003, [math.inf] + [0.0] * 5), (1004, []), (1005, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    for name in ("n", "code", "component", "entries", "rows"):
        df = df.withColumn(name, F.lit("clash"))
    agrees(whitening.whiten(df).collect(), [v for _, v in rows])


def test_wide_numbers_are_exact(spark):
    rows = [(i, [2e4 * i * i, -3e4 * i, 0.5]) for i in range(1, 8)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    agrees(found, [v for _, v in rows], 2)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e17, 0.0]), (None, [0.0, 1e16])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.deviation) for r in huge] == [(1, None), (1, None)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("size, falling", [(3, 1.0), (64, 0.01), (300, 1.0), (300, 0.05)])
def test_jacobi_davidson_reaches_double_precision(size, falling):
    turn, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((size, size)))
    matrix = turn * (1.0 / np.arange(1, size + 1) ** falling) @ turn.T
    matrix = (matrix + matrix.T) / 2
    passes = []
    values, vectors, _ = whitening.jacobi_davidson(lambda v: passes.append(1) or matrix @ v, size, min(4, size))
    want, axes = np.linalg.eigh(matrix)
    assert np.abs(values - want[::-1][: len(values)]).max() < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() <= whitening.PRECISION * want[-1]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12 and len(passes) < 400


def test_repeated_eigenvalues(spark):
    rows = [(i, [float(s * (k == j)) for k in range(5)]) for i, (j, s) in enumerate((j, s) for j in range(5) for s in (-1, 1))]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 40 and all(r.identity_error < 1e-12 and abs(r.explained - 0.2) < 1e-12 for r in found)
