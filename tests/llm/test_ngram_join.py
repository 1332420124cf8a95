import random

import numpy as np
import pyarrow as pa
import pytest

from concord.llm.ngram_join import Bands, candidates_in_tile, near_duplicates, one_of_each, tile_keys
from tests.llm.helpers import LOWER, ODD, components, documents, edited, prose


def shingles(text, n):
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def plain(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    nodes = [i for i, _ in sets if i is not None]
    links = []
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((i, j))
    return {i: len(s) for i, s in sets if i is not None}, components(nodes, links)


def corpus():
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = prose(g, rng.randint(4, 400))
        rows += [(len(rows) + k, edited(base, k, rng.randint(0, 4))) for k in range(rng.randint(1, 14))]
    # a chain whose ends are not similar, and pairs near the border
    chain = prose(77, 120)
    for k in range(12):
        rows.append((len(rows), chain))
        chain = edited(chain, 500 + k, 2)
    rng.shuffle(rows)
    odd = [r for r in ODD if r[0] != 908]
    return [*rows, *odd, (909, prose(0, 50).upper()), (910, prose(0, 50))]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_like_all_pairs(spark, n, percent):
    rows = corpus()
    sizes, roots = plain(rows, n, percent)
    out = near_duplicates(documents(spark, rows).repartition(4), n=n, percent=percent).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], roots[r.doc_id])


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    _, roots = plain(rows, 5, 80)
    out = one_of_each(documents(spark, rows))
    kept = [r.doc_id for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(roots.values())) and kept.count(None) == 1
    assert out.columns == documents(spark, rows).columns


def test_bands_allow_for_every_similar_pair():
    bands = Bands(90, 5000)
    for a in [*range(1, 60), 97, 311, 1999]:
        for b in range(a, a * 10 // 9 + 1):
            lo, hi = bands.of(__import__("numpy").array([a, b]))
            shared = set(range(lo[0], hi[0] + 1)) & set(range(lo[1], hi[1] + 1))
            # a pair may differ in as many elements as its similarity allows, and then one part is still equal
            differ = (a + b) * 10 // 190
            assert any(bands.parts[band] > differ for band in shared)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_a_tile_and_unlike_sets_hardly_any(percent):
    import numpy as np

    from concord.llm.ngram_join import tile_keys

    rng, bands = np.random.default_rng(percent), Bands(percent, 5000)
    for size in [*range(1, 40), 133, 199, 291, 600]:
        sets = []
        for _ in range(8):
            x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            gone = int(rng.integers(0, size * (100 - percent) // (100 + percent) + 1))  # so many replaced on both sides
            y = np.r_[x[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]
            sets += [np.unique(x), np.unique(y), np.unique(x[: -(-size * percent // 100)])]
        at = np.r_[0, np.cumsum([len(s) for s in sets])]
        keys = [set(k.tolist()) for k in tile_keys(np.concatenate(sets), at, bands)]
        for i in range(0, len(sets), 3):
            assert keys[i] & keys[i + 1] and keys[i] & keys[i + 2]
            if percent >= 80:
                assert not keys[i] & keys[(i + 3) % len(sets)]


def test_search_of_a_tile_ends_with_no_pair_left():
    from concord.llm.ngram_join import bitmap

    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: 200 - i], rng.integers(0, 1 << 62, i, dtype=np.uint64)]) for i in (0, 5, 8, 90, 91)]
    group = pa.table({
        "c": [1, 2, 3, 4, 5], "side": [2] * 5, "n": [len(s) for s in sets], "root": [1, 2, 3, 4, 5],
        "bits": [bitmap(s).view(np.int64).tolist() for s in sets], "refused": [None, [3], None, None, None],
    })
    found, more = candidates_in_tile(group, 90, 9)
    assert found == [(1, 2), (1, 3)] and not more
    group = group.set_column(group.column_names.index("refused"), "refused", pa.array([[2], [3], None, None, None]))
    assert candidates_in_tile(group, 90, 1) == ([(1, 3)], False)


def test_near_copies_offer_spanning_forests():
    from concord.llm.ngram_join import bitmap

    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[base[2:], rng.integers(0, 1 << 62, 2, dtype=np.uint64)]) for _ in range(60)]
    group = pa.table({
        "c": range(60), "side": [2] * 60, "n": [len(s) for s in sets], "root": range(60),
        "bits": [bitmap(s).view(np.int64).tolist() for s in sets], "refused": pa.array([None] * 60, pa.list_(pa.int64())),
    })
    one, more = candidates_in_tile(group, 90, 1)
    assert len(one) == 59 and more
    three, more = candidates_in_tile(group, 90, 3)
    assert len(set(three)) == len(three) <= 3 * 59 and more
    everything, more = candidates_in_tile(group, 90, 60)
    assert len(set(everything)) == 60 * 59 // 2 and not more


def test_small_blocks_and_many_rounds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr("concord.llm.ngram_join.BLOCK", 3)
    monkeypatch.setattr("concord.llm.ngram_join.BROADCAST_ROWS", 0)
    monkeypatch.setattr("concord.llm.ngram_join.MORE", 2)
    rows = corpus()
    _, roots = plain(rows, 2, 60)
    out = near_duplicates(documents(spark, rows).repartition(4), n=2, percent=60).collect()
    assert all(r.component_id == roots[r.doc_id] for r in out if r.doc_id is not None)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert one_of_each(documents(spark, [(1, None), (2, " ")])).count() == 2


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_tile_whatever_parts_are_left_out(percent):
    rng, bands = np.random.default_rng(3), Bands(percent)
    for size in [*range(1, 40), 60, 77, 100, 150, 230, 400, 900]:
        for _ in range(6):
            pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            # the largest difference that still links: some elements of each set are its own
            lost = int(rng.integers(0, 2 * size * (100 - percent) // (100 + percent) + 1))
            own = int(rng.integers(0, lost + 1))
            a, b = np.unique(pool[: size - own]), np.unique(np.r_[pool[lost - own : size - own], pool[size : size + own]])
            shared = len(np.intersect1d(a, b))
            if not len(a) or not len(b) or 100 * shared < percent * (len(a) + len(b) - shared):
                continue
            x, y = tile_keys(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), bands)
            assert set(x.tolist()) & set(y.tolist()), (size, lost, own)
