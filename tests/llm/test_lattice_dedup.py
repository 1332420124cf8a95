import itertools
import math

import numpy as np
import pytest

from concord.llm.lattice_dedup import PROBES, SCALE, TABLES, cells, near_duplicates, nearest_point
from tests.llm.helpers import components


def vectors():
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for size in (1, 1, 1, 3, 12, 40):
        base = rng.normal(size=24)
        for spread in rng.uniform(0.02, 0.12, size):
            rows.append((n, (base + spread * rng.normal(size=24)).tolist()))
            n += 1
    rows += [(n + i, rows[3][1]) for i in range(5)]  # equal vectors
    rows += [(n + 6, [3.5 * x for x in rows[4][1]]), (n + 7, [1e200 * x for x in rows[4][1]]), (n + 8, [1e-200 * x for x in rows[4][1]])]
    odd = [None, [], [0.0] * 24, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0]]
    return [*rows, *((200 + i, v) for i, v in enumerate(odd)), (rows[0][0], rows[0][1])]


def plain(rows):
    unit = []
    for _, v in rows:
        good = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        u = np.array(v) / np.abs(v).max() if good else None
        unit.append(u / np.sqrt(u @ u) if good else None)
    count, links = [0] * len(rows), []
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = unit[a], unit[b]
        if x is not None and y is not None and len(x) == len(y) and x @ y >= 0.9:
            count[a] += 1
            count[b] += 1
            links.append((rows[a][0], rows[b][0]))
    return count, components([i for i, _ in rows], links)


@pytest.mark.parametrize("block", [1500, 7])
def test_like_all_pairs(spark, block, monkeypatch):
    from concord.llm import lattice_dedup

    monkeypatch.setattr(lattice_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, c string, n int")
    out = sorted(map(tuple, near_duplicates(df).collect()))
    count, roots = plain(rows)
    assert out == sorted((i, n, roots[i], roots[i] == i) for (i, _), n in zip(rows, count, strict=True))


def test_nearest_point_is_nearest():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(200, 8)) * 2
    found = nearest_point(y)
    whole = np.allclose(found % 1, 0, atol=1e-9)
    assert not whole and np.all(np.isclose(found.sum(1) % 2, 0) | np.isclose(found.sum(1) % 2, 2))
    # no other point of the lattice near by is nearer
    from concord.llm.lattice_dedup import NEIGHBOURS

    own = ((y - found) ** 2).sum(1)
    other = ((y[:, None] - found[:, None] - NEIGHBOURS) ** 2).sum(2).min(1)
    assert len(NEIGHBOURS) == 240 and (own <= other + 1e-9).all() and (own <= 1 + 1e-9).all()


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_recall(cosine):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = cells(a, TABLES, PROBES, SCALE), cells(b, TABLES, PROBES, SCALE)
    assert (x[:, :, None] == y[:, None]).any((1, 2)).mean() >= 0.98


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(df).count() == 0
