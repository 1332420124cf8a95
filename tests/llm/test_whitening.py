import numpy as np
import pytest

from concord.llm import whitening
from concord.llm.whitening import Spectrum, rank_one, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, d int, u int, place int, value int, n long"


def frame(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3, 4, 5, 6) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def sample(n, d, seed=0, rank=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank or d)) @ rng.normal(size=(rank or d, d))
    return (x * 0.3).astype(np.float32)


def whole(x):
    return np.floor(64 * x.astype(np.float64)).astype(np.int64) + 1_000_000


def held_against_eigh(out, ids, x, most=32):
    n, mean = len(x), x.sum(0) / len(x)
    y = x - mean
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    rows = sorted((r for r in out.collect()), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == [(i, c) for i in ids for c in range(1, k + 1)]
    got = np.array([r.whitened for r in rows]).reshape(n, k)
    want = (y @ vectors[:, :k]) / np.sqrt(values[:k])
    signs = np.sign((got * want).sum(0))
    assert np.abs(got - want * signs).max() < 1e-6
    assert np.allclose([r.explained for r in rows[:k]], (values / values.sum())[:k], rtol=1e-9)
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9 and len({r.identity_error for r in rows}) == 1
    s = [int(v) for v in x.sum(0)]
    exact = {i: sum((n * int(c) - t) ** 2 for c, t in zip(row, s, strict=True)) for i, row in zip(ids, x, strict=True)}
    assert all(r.deviation == exact[r.vec_id] for r in rows)


@pytest.mark.parametrize(("n", "d", "rank", "parts"), [(300, 12, None, 5), (60, 40, None, 20), (200, 10, 4, 3), (20, 30, None, 4)])
def test_rows_equal_a_plain_decomposition(spark, n, d, rank, parts):
    x = sample(n, d, n, rank)
    held_against_eigh(whiten(frame(spark, enumerate(x), parts)), range(n), whole(x))


def test_odd_vectors_are_dropped_and_repeated_rows_count(spark):
    x = sample(80, 6)
    odd = [(900, None), (901, []), (902, [None] * 6), (903, [1, 2, 3, 4, 5, float("nan")]), (904, [float("inf")] * 6), (905, [1.0, 2.0]), (906, [1.0, None, 1, 1, 1, 1])]
    twice = np.concatenate([x, x[-1:]])
    held_against_eigh(whiten(frame(spark, [*enumerate(twice), *odd])), range(81), whole(twice))
    shared = whiten(frame(spark, [(None, v) for v in x])).collect()
    assert len(shared) == 80 * 6 and {r.vec_id for r in shared} == {None}


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None), (2, [])]):
        assert whiten(frame(spark, vectors, 1)).isEmpty()


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 20))
    own, total = Spectrum(d), np.zeros((d, d))
    for i in range(40):
        z = rng.normal(size=d) * 10.0 ** rng.integers(-6, 4)
        if i % 5 == 0:
            z = np.eye(d)[i % d] * 3.0  # equal eigenvalues and zeros
        if i % 7 == 0:
            z = np.zeros(d)
        own.add(z)
        total += np.outer(z, z)
    size = np.abs(total).max()
    assert np.abs(own.vectors @ np.diag(own.values) @ own.vectors.T - total).max() < 1e-12 * size
    assert np.abs(own.vectors.T @ own.vectors - np.eye(d)).max() < 1e-12
    assert np.allclose(np.sort(own.values), np.linalg.eigvalsh(total), rtol=1e-10, atol=1e-12 * size)


def test_combined_spectra_equal_one(monkeypatch):
    x = sample(500, 9).astype(float)
    parts = [Spectrum(9) for _ in range(4)]
    for own, rows in zip(parts, np.array_split(x, 4), strict=True):
        own.add_block(rows)
    for own in parts[1:]:
        parts[0].add_spectrum(own.values, own.vectors)
    assert np.allclose(np.sort(parts[0].values), np.linalg.eigvalsh(x.T @ x), rtol=1e-11)


def test_close_eigenvalues():
    d, z = np.array([1.0, 1.0 + 1e-15, 1.0 + 1e-9, 2.0]), np.array([1e-9, 1.0, 1e-5, 1e-12])
    values, vectors = rank_one(d, np.eye(4), z)
    assert np.abs(vectors @ np.diag(values) @ vectors.T - np.diag(d) - np.outer(z, z)).max() < 1e-14
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13


def test_wide_deviations_are_exact():
    centre = whitening.Centre(3_000_000_000, [3_000_000_000 * 1_000_000 + 7] * 2)
    x = np.array([[1_000_000, 1_000_001]])
    assert centre.deviation(x) == [49 + (3_000_000_000 - 7) ** 2]
    with pytest.raises(OverflowError):
        whitening.pa.array(centre.deviation(x * 5), whitening.pa.int64())
