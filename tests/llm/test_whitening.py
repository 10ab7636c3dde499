"""Incremental spectra and whitening against dense eigenvectors."""

import numpy as np
import pytest
from conftest import SMALL

from sheafwork.llm import queries, whitening
from sheafwork.llm.spectra import Spectrum
from sheafwork.llm.tables import importable_on_workers

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string, n string, x string"


def scatter(vectors):
    away = vectors - vectors.mean(axis=0)
    return away.T @ away


@pytest.mark.parametrize("size, count", [(1, 6), (3, 2), (5, 40), (24, 200)])
def test_spectra_equal_dense_eigenvalues(size, count):
    rng = np.random.default_rng(size)
    vectors = np.floor(rng.normal(size=(count, size)) * np.linspace(0, 30, size))
    vectors[: count // 3] = vectors[0]
    whole, first, second = Spectrum(size), Spectrum(size), Spectrum(size)
    for k, v in enumerate(vectors):
        whole.add(v)
        (first if 2 * k < count else second).add(v)
    first.merge(second)
    matrix = scatter(vectors)
    scale = max(np.abs(matrix).max(), 1)
    for s in (whole, first):
        assert s.n == count and np.allclose(s.mean, vectors.mean(axis=0))
        assert np.abs(s.values - np.linalg.eigvalsh(matrix)).max() < 1e-12 * scale * size
        assert np.abs(s.vectors.T @ s.vectors - np.eye(size)).max() < 1e-12
        assert np.abs(matrix @ s.vectors - s.vectors * s.values).max() < 1e-12 * scale * size


def plain(rows, wanted=16):
    """{(id, component): values} of all rows, from a dense covariance of the different vectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in good])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    away = (n * distinct - sums) / n
    covariance = away.T @ away / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(wanted, int((values > 1e-12 * values[0]).sum()))
    out = []
    for (i, _), row in zip(good, x):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
        whitened = (n * row - sums) / n @ vectors[:, :kept] / np.sqrt(values[:kept])
        out += [(i, k + 1, n, deviation, whitened[k], values[k] / np.trace(covariance)) for k in range(kept)]
    return out


def compare(found, expected):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    found, expected = sorted(found, key=order), sorted(expected, key=order)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    for component in {r[1] for r in expected}:
        ours = np.array([r[4] for r in found if r[1] == component])
        theirs = np.array([r[4] for r in expected if r[1] == component])
        sign = 1 if ours @ theirs > 0 else -1
        assert np.abs(ours - sign * theirs).max() < 1e-8
    assert np.allclose([r[5] for r in found], [r[5] for r in expected], rtol=1e-9)


@pytest.fixture
def many_partitions(spark):
    """A written table is read by a task for each of its files."""
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whitening_equals_dense_eigenvectors(spark, monkeypatch, many_partitions):
    importable_on_workers(spark)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 20)) * np.linspace(0.5, 4, 20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    vectors = [[float(np.float32(c)) for c in v] for v in data]
    vectors += [vectors[3]] * 100
    rows = list(enumerate(vectors))
    bad = [(900, None), (901, []), (902, [None] * 20), (903, [1.0] * 19 + [float("nan")]), (904, [float("-inf")] * 20)]
    short = [(905, [1.0, 2.0])]
    table = [(i, v, 1, "c", "n", "x") for i, v in rows + bad + short + [rows[7], (None, vectors[8])]]
    found = whitening.whiten_embeddings(spark.createDataFrame(table, SCHEMA).repartition(5))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = [tuple(r) for r in found.collect()]
    assert len({r[6] for r in found}) == 1 and found[0][6] < 1e-10
    compare(found, plain(rows + [rows[7], (None, vectors[8])]))


def test_few_vectors(spark):
    importable_on_workers(spark)

    def run(vectors):
        table = [(i, v, 0, "", "", "") for i, v in enumerate(vectors)]
        return [tuple(r) for r in whitening.whiten_embeddings(spark.createDataFrame(table, SCHEMA)).collect()]

    assert run([]) == run([[0.5, 1.0]]) == run([[0.5, 1.0]] * 3) == run([None, []]) == []
    two = run([[0.0, 1.0], [3.0, 5.0]])
    compare(two, plain([(0, [0.0, 1.0]), (1, [3.0, 5.0])]))
    assert [r[1] for r in two] == [1, 1]
    with pytest.raises(Exception, match="(?i)overflow|not exact"):
        run([[1e30, 1.0], [3.0, 5.0]])


def test_query_equals_dense_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = [tuple(r) for r in queries.QUERIES["op13_incremental_whitening"](spark, SMALL).collect()]
    assert found[0][6] < 1e-10
    compare(found, plain(rows))
