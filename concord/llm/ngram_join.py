"""Near-duplicate documents by an exact Jaccard join of word shingles over size-banded tiles.

Sets of similar size fall into one size band (a set near the upper edge also into the next), and a band allows at most H
elements in which two of its similar sets differ. Each set is cut by hash into H + 1 + E parts, so two similar sets have at
least E + 1 parts in common: a tile is all sets of a band with one equal part. Nothing is lost, however frequent a shingle is.

An empty part says nothing and would be a tile of unlike sets, and a part of one frequent shingle nearly so. A set with at most E empty
parts leaves out the E parts of fewest elements, the empty ones first, in an order that depends on a part's content alone. Of the
equal parts of two similar sets, the set that leaves out more leaves out all that either does, E at most; one is left. Sets with
more than E empty parts take part with all filled ones and are cut once more by another hash, for the pairs among themselves, and so
on; only the last cut has tiles of empty parts too.

Inside a tile sets carry bitmap signatures. If a bits of one signature are missing in the other, at least that many
elements are missing too, which bounds the overlap from above; only pairs that pass go to the exact intersection
of sorted arrays.

A tile is not expanded into all its pairs. Equal sets are one class from the start. First each class is held against the
least class of its tiles, which settles groups of copies in time linear in their size. Only tiles that still hold
several components are searched, large ones cut into blocks: each round verifies spanning forests of the pairs that the
bitmaps allow between components, until no tile has any left. The first rounds take a class to one or few of its
tiles only, since a group of near copies stands in many tiles and is joined in any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.llm.common import LOWER, connected_components, discard, flat, id_and_bytes, mix, sized, slices
from concord.session import cut_lineage

#: Bits of a bitmap signature for each element (a power of two at least, between these bounds). A class has a short one for the pairs
#: with the least classes of its tiles, which carry two each, and a wide one for the searches inside tiles.
BITS_EACH, LEAST_BITS, MOST_BITS = 1, 256, 16_384
WIDE_EACH, WIDE_LEAST, WIDE_MOST = 4, 512, 131_072
#: How often a set may be cut anew because it has too many empty parts, and how many standard deviations above the mean are too many.
CUTS, ABOVE = 6, 1.5
#: Members of a block of a large tile, rows up to which a stored table is broadcast.
BLOCK, BROADCAST_ROWS = 1000, 400_000
#: Tiles (a number each) up to which they are broadcast, so that only the members of shared tiles are shuffled.
TILE_ROWS = 2_000_000
#: The first searches: in how many of its tiles a class is searched, and how many spanning forests of pairs a pair of blocks offers;
#: and how many times more forests each further search offers, which takes a class to all its open tiles.
FIRST_ROUNDS, MORE = ((1, 1),), 8
#: Words of bitmaps held against each other at once.
PLANE = 1 << 19
#: Bytes worked on at once; it bounds the scratch arrays of a task.
SLICE = 2 << 20

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
_LANE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.frombuffer(LOWER, np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts data[ends[i]:ends[i + 1]], and at which word each text begins, and the end."""
    text = _LOWER[data]
    inside = ~_BLANK[text]
    before = np.zeros(len(text), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(text), bool)
    after[:-1] = inside[1:]
    first = ends[:-1][ends[:-1] < ends[1:]]
    before[first] = False
    after[first[1:] - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * powers(_BASE, len(text)), out=total[1:])
    back = powers(pow(_BASE, -1, 1 << 64), len(text) + 1)
    hashes = mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))
    return hashes, np.searchsorted(start, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one behind the other, and where each set begins, and the end."""
    words, at = word_hashes(data, ends)
    size = np.diff(at)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        grams += words[i : i + len(grams)] * _LANE[i]
    out = []
    for i, k in enumerate(size.tolist()):
        if k >= n:
            out.append(np.unique(mix(grams[at[i] : at[i] + k - n + 1])))
        elif k:
            whole = (words[at[i] : at[i] + k] * _LANE[n : n + k]).sum(dtype=np.uint64) + np.uint64(k)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in out], np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.r_[0, np.cumsum(sizes)]


class Bands:
    """Size bands and their numbers of parts for a similarity of `percent` hundredths."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent, edges = percent, [1]
        while edges[-1] < most:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2, -(-edges[-1] * 100 // percent)))
        self.edges = np.array(edges, np.int64)
        # sets of the band before, if similar ones may lie in this band, are smaller than its edge
        low, top = np.maximum(self.edges[:-1] * percent // 100, 1), self.edges[1:] - 1
        unequal = 2 * top * (100 - percent) // (100 + percent)
        self.parts, enough = unequal + 1, unequal == 0
        # as many parts as it takes for most of a band's smallest sets to have no more empty ones than may be left out
        for _ in range(60):
            each = low / self.parts
            empty, spread = self.parts * np.exp(-each), 1 - (1 + each) * np.exp(-each)
            enough |= empty + ABOVE * np.sqrt(empty * spread) <= self.parts - unequal - 1
            self.parts = np.where(enough, self.parts, self.parts + 1 + self.parts // 50)
        self.parts = np.where(enough, self.parts, unequal + 1)
        self.spare, self.cuts = self.parts - unequal - 1, np.where(enough & (unequal > 0), CUTS, 1)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last band in which a set of each size takes part."""
        low = np.searchsorted(self.edges, sizes, "right") - 1
        high = np.searchsorted(self.edges, sizes * 100 // self.percent, "right") - 1
        return low, high


def tile_keys(sets: np.ndarray, at: np.ndarray, bands: Bands) -> list[np.ndarray]:
    """Keys of the tiles of each set: band, cut, part number and a hash of the part's elements. Empty parts only have tiles in the
    last cut of a band."""
    sizes = np.diff(at)
    low, high = bands.of(np.maximum(sizes, 1))
    keys = [[] for _ in sizes]
    marks = mix(sets + _LANE[60])
    for step in range(int((high - low).max(initial=0)) + 1):
        chosen = np.flatnonzero((sizes > 0) & (low + step <= high))
        for cut in range(CUTS):
            if not len(chosen):
                break
            band = (low + step)[chosen]
            parts = bands.parts[band]
            base = np.r_[0, np.cumsum(parts)]
            count = sizes[chosen]
            index = np.repeat(np.arange(len(chosen)), count)
            elements = np.arange(count.sum()) + np.repeat(at[chosen] - (np.cumsum(count) - count), count)
            dealt = mix(sets[elements] + _LANE[50 + cut]) if cut else sets[elements]
            part = (dealt % parts[index].astype(np.uint64)).astype(np.int64) + base[index]
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, part, marks[elements])
            filled = np.bincount(part, minlength=base[-1])
            number = np.arange(base[-1]) - np.repeat(base[:-1], parts)
            place = number.astype(np.uint64) * _LANE[61] + np.repeat(band, parts).astype(np.uint64) * _LANE[62]
            found = mix(sums + mix(place + np.uint64(cut) * _LANE[59:60])).astype(np.int64)
            last, spare = cut == bands.cuts[band] - 1, bands.spare[band]
            empty = np.add.reduceat((filled == 0).astype(np.int64), base[:-1])
            # the parts of each set from the smallest on, of which as many as may be left out are
            found = found[np.lexsort((number, filled, np.repeat(np.arange(len(chosen)), parts)))]
            out = np.where(empty <= spare, spare, np.where(last, 0, empty))
            for i, a, b in zip(chosen, base[:-1] + out, base[1:], strict=True):
                keys[i].append(found[a:b])
            chosen = chosen[~last & (empty > spare)]
    return [np.concatenate(k) if k else np.zeros(0, np.int64) for k in keys]


def class_of(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    sums = np.r_[np.uint64(0), np.cumsum(mix(sets ^ _LANE[63]))]
    return mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def bitmap(members: np.ndarray, each: int = BITS_EACH, least: int = LEAST_BITS, most: int = MOST_BITS) -> np.ndarray:
    size = least
    while size < min(each * len(members), most):
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[(members >> np.uint64(11)) % np.uint64(size)] = 1
    return np.packbits(bits).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same set has at a smaller size."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def most_shared(bits: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of a set with others, from bitmaps of one size."""
    missing = np.bitwise_count(bits & ~others).sum(1, dtype=np.int64)
    surplus = np.bitwise_count(others & ~bits).sum(1, dtype=np.int64)
    return np.minimum(n - missing, sizes - surplus)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def partners(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one block pair of a tile, sorted by class: each member with the later ones that it may be similar to by the bitmaps, that
    belong to other components and that were not refused before."""
    c, side, n, root = (group[k].to_numpy() for k in ("c", "side", "n", "root"))
    bits = [np.array(b.values, np.int64).view(np.uint64) for b in group["bits"]]
    words = min(map(len, bits))
    bits = np.stack([folded(b, words) for b in bits])
    # folding to the shortest signature keeps the bound, if a looser one
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    step = max(1, PLANE // bits.size)
    for a in range(0, len(c), step):
        b = min(a + step, len(c))
        both = np.bitwise_count(bits[a:b, None] & bits[None, a:]).sum(2, dtype=np.int64)
        most = both + np.minimum((n - ones)[a:b, None], (n - ones)[None, a:])
        good = 100 * most >= percent * (n[a:b, None] + n[None, a:] - most)
        good &= root[a:b, None] != root[None, a:]
        good &= (side[a:b, None] != side[None, a:]) | (side[a:b, None] == 2)
        good &= np.arange(a, len(c))[None] > np.arange(a, b)[:, None]
        for v in np.flatnonzero(good.any(1)).tolist():
            others = a + np.flatnonzero(good[v])
            refused = group["refused"][a + v].as_py()
            if refused:
                others = others[~np.isin(c[others], refused)]
            if len(others):
                yield a + v, others


def in_order(group: pa.Table) -> pa.Table:
    return group.take(pa.array(np.argsort(group["c"].to_numpy())))


def possible_in_tile(group: pa.Table, percent: int) -> np.ndarray:
    """The classes of one block pair of a tile that have a partner in it by the bitmaps."""
    group = in_order(group)
    c, live = group["c"].to_numpy(), np.zeros(len(group), bool)
    for v, others in partners(group, percent):
        live[v] = live[others] = True
    return c[live]


def candidates_in_tile(group: pa.Table, percent: int, forests: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of one block pair of a tile that the bitmaps allow, that join different components and were not refused before, and
    whether there are more. They make up so many spanning forests: a pair is offered if it joins two parts that no pair of
    one of the forests has joined yet, so that a group of n near copies offers n - 1 pairs a forest and not all its pairs."""
    group = in_order(group)
    c, root = (group[k].to_numpy() for k in ("c", "root"))
    first = np.unique(root, return_inverse=True)[1]
    parts = [first.copy() for _ in range(min(forests, len(c)))]
    out, more = [], False
    for v, others in partners(group, percent):
        for part in parts:
            new = np.flatnonzero(part[others] != part[v])
            while len(new):
                u = others[new[0]]
                out.append((int(c[v]), int(c[u])))
                part[part == part[u]] = part[v]
                others = np.delete(others, new[0])
                new = np.flatnonzero(part[others] != part[v])
            if not len(others):
                break
        more |= len(others) > 0
    return out, more


def rounds() -> Iterator[tuple[int | None, int]]:
    """Of each round, in how many of its open tiles a class is searched (None: in all) and how many spanning forests are offered."""
    yield from FIRST_ROUNDS
    forests = FIRST_ROUNDS[-1][1]
    while True:
        forests *= MORE
        yield None, forests


def opened(members: DataFrame, roots: DataFrame, tiles_each: int | None) -> DataFrame | None:
    """Members of tiles that hold several components, stored: (tile, c, root, block, others: blocks that it meets); None without such.

    Of tiles with equal members one is searched. With `tiles_each`, a class is only taken to its largest tiles, and blocks
    meet themselves if it is one tile. Else the classes of a tile's largest component have blocks of their own, which do not
    meet each other.
    """
    placed = members.join(roots, members.c == roots.node, "left").select("tile", "c", F.coalesce("root", "c").alias("root"))
    state = placed.groupBy("tile").agg(
        F.count("*").alias("m"), F.min("root").alias("p"), F.max("root").alias("q"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s")
    )
    # the only pair of a tile of two has been seen already
    state = state.where("p < q and m > 2").groupBy("m", "s").agg(F.min("tile").alias("tile"))
    state = cut_lineage(state.select("tile", "m"), "open-tiles")
    if state.isEmpty():
        discard(state)
        return None
    placed = placed.join(sized(state, BROADCAST_ROWS), "tile")
    if tiles_each is not None:
        first = F.row_number().over(W.partitionBy("c").orderBy(F.desc("m"), "tile"))
        placed = placed.withColumn("__first", first).where(F.col("__first") <= tiles_each)
    placed = cut_lineage(placed.select("tile", "c", "root"), "placed")
    parts = placed.groupBy("tile", "root").agg(F.count("*").alias("k"))
    tops = parts.groupBy("tile").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    if tiles_each == 1:
        tops = tops.select("tile", F.lit(None).cast("long").alias("main"), F.ceil(F.col("m") / BLOCK).alias("few"), F.lit(0).cast("long").alias("many"))
    else:
        rest = F.ceil((F.col("m") - F.col("top.k")) / BLOCK).alias("few")
        tops = tops.select("tile", F.col("top.root").alias("main"), rest, F.ceil(F.col("top.k") / BLOCK).alias("many"))
    tops = cut_lineage(tops, "tops")
    inside = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    spread = F.xxhash64("c", "tile")
    block = F.when(inside, F.col("few") + F.pmod(spread, F.greatest("many", F.lit(1)))).otherwise(F.pmod(spread, "few"))
    last = F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    others = F.array("block") if tiles_each == 1 else F.sequence(F.lit(0).cast("long"), "last")
    out = placed.join(sized(tops, BROADCAST_ROWS), "tile").withColumns({"block": block, "last": last})
    out = cut_lineage(out.select("tile", "c", "root", "block", others.alias("others")), "opened")
    discard(state, placed, tops)
    return out


def refusals(bad: DataFrame, placed: DataFrame) -> DataFrame:
    """(tile, i, j, c, refused): classes of a pair of blocks that were held against c, the lesser one, and are not similar."""
    at = placed.select("tile", "c", "block")
    a = at.select("tile", F.col("c").alias("c"), F.col("block").alias("x"))
    b = at.select("tile", F.col("c").alias("u"), F.col("block").alias("y"))
    pairs = bad.select(F.least("a", "b").alias("c"), F.greatest("a", "b").alias("u"))
    low, high = F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")
    return pairs.join(a, "c").join(b, ["tile", "u"]).groupBy("tile", low, high, "c").agg(F.collect_set("u").alias("refused"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links of Jaccard similarity `percent` / 100 reach).

    Words are runs of anything but white space, A-Z lower-cased; a text of fewer than `n` words is one shingle, and a null
    or blank text has none and links with nothing. Repeated rows link with each other; a null id takes the component of
    its text but names none. Sets are compared by 64-bit shingle hashes. An empty table gives no row.
    """
    bands = Bands(percent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            sets, at = shingle_sets(*flat(batch.column(1)), n)
            keys = tile_keys(sets, at, bands)
            whole = class_of(sets, at)
            bits = [bitmap(sets[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            wide = [bitmap(sets[a:b], WIDE_EACH, WIDE_LEAST, WIDE_MOST) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [batch.column(0), pa.array(np.diff(at)), pa.array(whole), lists(bits), lists(wide), lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "c", "bits", "wide", "tiles"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            sets, at = shingle_sets(*flat(batch.column(1)), n)
            members = [sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            # rows that share an id may bring another text
            own = pa.array(class_of(sets, at) == batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(members)], ["c", "members"]).filter(own)

    def pass_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for na, xa, nb, xb in zip(*(batch.column(i) for i in (2, 3, 4, 5)), strict=True):
                na, nb, xa, xb = na.as_py(), nb.as_py(), *(np.array(x.values, np.int64).view(np.uint64) for x in (xa, xb))
                words = min(len(xa), len(xb))
                most = most_shared(folded(xa, words), na, folded(xb, words)[None], np.array([nb]))[0]
                good.append(bool(100 * most >= percent * (na + nb - most)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [similar(np.array(x[i].values), np.array(y[i].values), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "good"])

    def search(forests: int):
        def inside(group: pa.Table) -> pa.Table:
            found, more = candidates_in_tile(group, percent, forests)
            tile = group["tile"][0].as_py()
            columns = [[tile] * len(found), [a for a, _ in found], [b for _, b in found]]
            return pa.table([pa.array(c, pa.int64()) for c in columns] + [pa.array([more] * len(found), pa.bool_())], ["tile", "a", "b", "more"])

        return inside

    def possible(group: pa.Table) -> pa.Table:
        live = pa.array(possible_in_tile(group, percent))
        columns = [pa.array([group[k][0].as_py()] * len(live), pa.int64()) for k in ("tile", "i", "j")]
        return pa.table([*columns, live], ["tile", "i", "j", "c"])

    texts = id_and_bytes(df, id_col, text_col)
    rows = cut_lineage(texts.mapInArrow(describe, "id long, n long, c long, bits array<long>, wide array<long>, tiles array<long>"), "sets")
    # one row of each class; a class is known by rows with an id
    whole = rows.where("n > 0 and id is not null")
    again = whole.groupBy("c").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").select("c", "first")
    again = cut_lineage(again, "repeated-classes")
    members = whole.join(sized(again), "c", "left").where("first is null or id = first").select(F.explode("tiles").alias("tile"), "c")
    # the tiles alone are counted first: most belong to one class, and their members need not move
    tiles = cut_lineage(members.groupBy("tile").count().where("count > 1").select("tile"), "tiles")
    members, alike = members.join(sized(tiles, TILE_ROWS), "tile"), W.partitionBy("tile")
    members = members.withColumns({"low": F.min("c").over(alike), "top": F.max("c").over(alike)}).where("low < top")
    members = cut_lineage(members.select("tile", "low", "c").distinct(), "tile-members")
    discard(again, tiles)

    # the signatures of the classes that share a tile with another
    classes = cut_lineage(members.select("c").distinct(), "classes")
    named = rows.where("id is not null").join(sized(classes), "c").groupBy("c").agg(F.min("id").alias("id"))
    named = cut_lineage(named, "named-classes")
    signed = rows.join(sized(named), ["id", "c"]).select("c", "n", "bits", "wide").dropDuplicates(["c"])
    signed = cut_lineage(signed, "signatures")

    # every class against the least class of its tiles
    stars = members.where("low <> c").select(F.col("low").alias("a"), F.col("c").alias("b")).distinct()
    left = signed.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = signed.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    pairs = stars.join(left, "a").join(right, "b").select("a", "b", "na", "xa", "nb", "xb")
    pairs = cut_lineage(pairs.mapInArrow(pass_bitmaps, "a long, b long"), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
        classes = cut_lineage(wanted, "wanted")
        wanted = cut_lineage(named.join(sized(classes), "c"), "wanted-ids")
        chosen = texts.join(sized(wanted), "id").select("c", "body")
        sets = chosen.mapInArrow(load, "c long, members array<long>").dropDuplicates(["c"])
        sets = cut_lineage(sets, "members")
        pairs = pairs.join(sets.select(F.col("c").alias("a"), F.col("members").alias("x")), "a")
        pairs = pairs.join(sets.select(F.col("c").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
        out = cut_lineage(pairs.mapInArrow(verify, "a long, b long, good boolean"), "verified")
        discard(classes, wanted, sets)
        return out

    # only what the bitmaps let pass is read as sets
    seen = verified(pairs)
    roots = connected_components(seen.where("good"))
    for tiles_each, forests in rounds():
        placed = opened(members, roots, tiles_each)
        if placed is None:
            break
        refused = refusals(seen.where("not good").select("a", "b"), placed)
        met = placed.select("tile", "c", "root", "block", F.explode("others").alias("other"))
        # side 0 and 1 of a pair of blocks meet each other, side 2 is a block by itself
        side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side")
        low, high = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
        met = met.select("tile", "c", "root", low, high, side).join(refused, ["tile", "i", "j", "c"], "left")
        columns, stored = ["tile", "i", "j", "side", "c", "root", "n"], None
        if tiles_each is None:
            # short signatures go to every tile, wide ones only to members that have a partner by the short ones
            met = cut_lineage(met, "met")
            short = met.join(signed, "c").select(*columns, "bits", "refused")
            live = short.groupBy("tile", "i", "j").applyInArrow(possible, "tile long, i long, j long, c long")
            live = cut_lineage(live, "live")
            stored = (met, live)
            met = met.join(sized(live), ["tile", "i", "j", "c"], "left_semi")
        met = met.join(signed, "c").select(*columns, F.col("wide").alias("bits"), "refused")
        found = met.groupBy("tile", "i", "j").applyInArrow(search(forests), "tile long, a long, b long, more boolean")
        found = cut_lineage(found, "candidates")
        discard(placed)
        if stored is not None:
            discard(*stored)
        if found.isEmpty():
            if tiles_each is None:
                break
            continue
        pairs = cut_lineage(found.select("a", "b").distinct(), "pairs")
        before, seen = seen, cut_lineage(seen.union(verified(pairs)), "seen")
        roots_before, roots = roots, connected_components(seen.where("good"))
        discard(before, pairs, roots_before)
        if tiles_each is None:
            # in all other tiles every pair that the bitmaps allow has been verified
            before, left = members, cut_lineage(found.where("more").select("tile").distinct(), "tiles")
            members = cut_lineage(members.join(sized(left), "tile", "left_semi"), "tile-members")
            discard(before, left)
        discard(found)

    least = rows.where("n > 0").groupBy("c").agg(F.min("id").alias("first"))
    least = least.join(roots, least.c == roots.node, "left").select("c", "first", F.coalesce("root", "c").alias("root"))
    least = cut_lineage(least, "class-roots")
    groups = least.groupBy("root").agg(F.min("first").alias("component"))
    named = least.join(groups, "root").select("c", "component")
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(named, "c", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` without those whose component has a smaller id; of rows that share an id one stays.
    Rows without an id stay, as do rows without words."""
    found = cut_lineage(near_duplicates(df, id_col, text_col, n, percent), "components")
    gone = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    rows = df.join(sized(cut_lineage(gone, "copies")), id_col, "left_anti")
    often = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    often = sized(cut_lineage(often, "repeated-ids"))
    order = W.partitionBy(id_col).orderBy(F.col(text_col).desc_nulls_last())
    first = rows.join(often, id_col, "left_semi").withColumn("__again", F.row_number().over(order))
    return rows.join(often, id_col, "left_anti").unionByName(first.where("__again = 1").drop("__again")).select(*df.columns)
