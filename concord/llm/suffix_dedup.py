"""Removal of passages that an earlier document holds too, by suffix order.

Only places that can lie in a repeated passage are sorted. Each window of `length` bytes is known by its anchor, the piece of
24 bytes or less in it whose hash is least; equal windows have equal anchors at equal places. Anchors that stand in two
documents or more are found from packed hash lists and known to all tasks by a Bloom filter, or, where they are too many for
that, told to each text by the places of its anchors. The windows of such anchors, with their bytes, go to the shard of their
anchor, in rounds over the anchors if they are much more than the text; shuffle files are let go of after each step. A shard leaves out windows whose hash stands nowhere else and puts the suffixes of the rest, equal strings
once, in order by external induced sorting; neighbours that share `length` bytes are equal windows, and the least document id
of each run decides what is removed elsewhere.

Anchors that very many documents hold are dealt over all shards instead, where equal strings become one row; only those
rows meet in the shard of the anchor, and what it decides is joined back by string.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import discard, flat, free_shuffles, id_and_bytes, mix, partitions, sized, slices
from concord.llm.suffix_sort import sorted_suffixes
from concord.session import cut_lineage

#: Bytes worked on at once, text for each shard, and repeated anchors that are broadcast (ten bits each); more are joined.
SLICE, SHARD_BYTES, BROADCAST_ROWS = 256 << 10, 4 << 20, 48_000_000
#: Text for one hash list, and for each group of lists; bytes of windows that are sorted in one round at least, and for each byte of text.
LIST_BYTES, GROUP_BYTES, ROUND_BYTES, ROUND_SHARE = 16 << 20, 64 << 20, 256 << 20, 1.25
#: Bytes that a row of windows takes on disk besides them; bits of the filter for each anchor, and how many of them are set.
ROW_BYTES, FILTER_BITS, PROBES = 30, 10, 3
#: Places that an anchor may have before it is dealt over all shards, and places in one hash list from which on they are counted.
HOT, COUNTED = 20_000, 32
#: Low bytes of an anchor's hash are kept in the lists, the rest chooses the group.
KEPT_BYTES = 6
KEPT = np.uint64((1 << 8 * KEPT_BYTES) - 1)
PLACE = np.uint64((1 << 31) - 1)

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)


def piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` bytes, by doubling."""
    hashes, power, done, result, result_size = _BYTE[data], _BASE.copy(), 1, None, 0
    while True:
        if size & done:
            if result is None:
                result = hashes
            else:
                n = len(result) - done
                result = result[:n] * power + hashes[result_size : result_size + n]
            result_size += done
        if done * 2 > size:
            return mix(result)
        hashes = hashes[:-done] * power + hashes[done:]
        power, done = power * power, done * 2


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last window (places in the text) and hash of every anchor."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    size = max(4, min(24, length // 2))
    hashes = piece_hashes(data, size)
    least = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span, wanted = 1, length - size + 1
    while span * 2 <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wanted:
        least = np.minimum(least[: len(least) - (wanted - span)], least[wanted - span :])
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    windows = np.flatnonzero(text[: len(least)] == text[length - 1 :])
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    place = (least[windows] & PLACE).astype(np.int64)
    first = np.r_[True, (place[1:] != place[:-1]) | (np.diff(windows) > 1)]
    start = np.flatnonzero(first)
    stop = np.r_[start[1:], len(windows)] - 1
    which = text[windows[start]]
    return which, windows[start] - ends[which], windows[stop] - ends[which], mix(hashes[place[start]] + np.uint64(1))


def repeated_runs(strings: list[bytes], often: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that may stand elsewhere too: string, first byte, byte after the last. All windows of a string that occurs
    often may, and of others those whose hash occurs again."""
    sizes = np.array([len(s) for s in strings], np.int64)
    hashes, at = [], 0
    while at < len(strings):
        stop, size = at, 0
        while stop < len(strings) and size < SLICE:
            size += int(sizes[stop])
            stop += 1
        data = np.frombuffer(b"".join(strings[at:stop]), np.uint8)
        part = piece_hashes(data, length)
        begin = np.cumsum(sizes[at:stop]) - sizes[at:stop]
        count = sizes[at:stop] - length + 1
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hashes.append(part[np.repeat(begin, count) + offset])
        at = stop
    hashes = np.concatenate(hashes)
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(strings)), count)
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = np.zeros(len(hashes), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    keep = often[owner].copy()
    keep[order[same]] = True
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    kept = np.flatnonzero(keep)
    if not len(kept):
        return kept, kept, kept
    new = np.r_[True, (np.diff(kept) > 1) | (owner[kept][1:] != owner[kept][:-1])]
    first = kept[new]
    last = kept[np.r_[np.flatnonzero(new)[1:], len(kept)] - 1]
    return owner[first], offset[first], offset[last] + length


def judge(strings: list[bytes], least: np.ndarray, often: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one least id: string, first byte, byte after the last, and that id. `least` has the least id of
    each string, `often` whether several rows have it."""
    owner, a, b = repeated_runs(strings, often, length)
    # equal runs are sorted once, for the least id of all
    number: dict[bytes, int] = {}
    runs = [number.setdefault(strings[o][i:j], len(number)) for o, i, j in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True)]
    runs = np.array(runs, np.int64)
    first_id = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(first_id, runs, least[owner])
    suffixes, common, ends = sorted_suffixes(number, length)
    if not len(suffixes):
        return owner, a, b, owner
    new = np.flatnonzero(common < length)
    group = np.minimum.reduceat(first_id[np.searchsorted(ends, suffixes, "right")], new)
    low = np.empty(len(suffixes), np.int64)
    low[suffixes] = np.repeat(group, np.diff(np.r_[new, len(suffixes)]))
    starts = np.r_[0, ends[:-1]][runs]
    count = b - a - length + 1
    which = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    value = low[starts[which] + offset]
    first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (value[1:] != value[:-1])])
    last = np.r_[first[1:], len(which)] - 1
    begin = a[which[first]]
    return owner[which[first]], begin + offset[first], begin + offset[last] + length, value[first]


def dealt(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each hash, and what is kept of it there."""
    return ((hashes >> np.uint64(8 * KEPT_BYTES)) % np.uint64(groups)).astype(np.int64), hashes & KEPT


def packed(kept: np.ndarray) -> bytes:
    return np.ascontiguousarray(kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]).tobytes()


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    data = np.frombuffer(b"".join(column.drop_null().to_pylist()), np.uint8).reshape(-1, KEPT_BYTES)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :KEPT_BYTES] = data
    return out.reshape(-1).view("<u8").astype(np.uint64)


def probes(kept: np.ndarray, sizes: np.ndarray | np.uint64) -> list[np.ndarray]:
    """Places of a hash in a filter of `sizes` bits."""
    mixed = mix(kept)
    low, high = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)
    return [((low + np.uint64(i) * high) % sizes).astype(np.int64) for i in range(PROBES)]


def repeated_anchors(long: DataFrame, length: int, groups: int, hot_from: int) -> DataFrame:
    """Anchors that stand in several texts (body), stored, one row for each group: how many they are (n), about how many
    places they have, a Bloom filter of them (bits), and what is kept of their hashes (anchors), of the hot ones also alone (hot)."""

    def list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hash lists per group of about 16 MB of text; a hash of several texts stands twice."""
        held, size = [], 0

        def lists() -> pa.RecordBatch:
            hashes, places = (np.concatenate(c) for c in zip(*held, strict=True))
            distinct, where, count = np.unique(hashes, return_inverse=True, return_counts=True)
            places = np.bincount(where, places).astype(np.int64)
            group, distinct = dealt(distinct, groups)
            order = np.argsort(group, kind="stable")
            distinct, count, places = distinct[order], count[order], places[order]
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            rows = []
            for g in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[g], cuts[g + 1]
                part, n = distinct[a:b], places[a:b]
                many = n >= COUNTED
                twice = np.repeat(part, np.minimum(count[a:b], 2))
                rows.append((g, packed(twice), np.stack([part[many], n[many].view(np.uint64)], 1).tobytes()))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["group", "hashes", "many"])

        for batch in slices(batches, SLICE):
            data, ends = flat(batch.column(0))
            which, _, _, hashes = anchors(data, ends, length)
            # once for each text
            order = np.lexsort((which, hashes))
            h, w = hashes[order], which[order]
            if len(h):
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
                held.append((h[first], np.diff(np.r_[first, len(h)])))
            size += len(data)
            if size > LIST_BYTES and held:
                yield lists()
                held, size = [], 0
        if held:
            yield lists()

    def twice(lists: pa.Table) -> pa.Table:
        both, many = unpacked(lists["hashes"]), np.frombuffer(b"".join(lists["many"].to_pylist()), np.uint64)
        distinct, count = np.unique(both, return_counts=True)
        # it has at most so many places, and about so many
        most, places = count * (COUNTED - 1), count.copy()
        at, n = np.searchsorted(distinct, many[0::2]), many[1::2].astype(np.int64)
        np.add.at(most, at, n)
        np.add.at(places, at, n)
        again = count > 1
        found = distinct[again]
        bits = np.zeros(-(-max(1, len(found)) * FILTER_BITS // 8) * 8, bool)
        for place in probes(found, np.uint64(len(bits))):
            bits[place] = True
        row = (len(found), int(places[again].sum()), np.packbits(bits, bitorder="little").tobytes(), packed(found), packed(distinct[again & (most > hot_from)]))
        columns = [pa.array([x], kind) for x, kind in zip(row, [pa.int64()] * 2 + [pa.binary()] * 3, strict=True)]
        return pa.Table.from_arrays([lists["group"].slice(0, 1), *columns], ["group", "n", "places", "bits", "anchors", "hot"])

    lists = long.select("body").mapInArrow(list_hashes, "group int, hashes binary, many binary")
    found = lists.groupBy("group").applyInArrow(twice, "group int, n long, places long, bits binary, anchors binary, hot binary")
    return cut_lineage(found, "repeated-anchors")


CONTEXT = "k long, id long, at binary, h long, hot boolean, context binary"


def context_rows(k: np.ndarray, ids: np.ndarray, at: np.ndarray, h: np.ndarray, hot: np.ndarray, contexts: list[bytes]) -> pa.RecordBatch:
    """One row for each text (key) and string, with all its places in the text, packed as 64-bit numbers."""
    places: dict[tuple, list[int]] = {}
    first = []
    for i, (key, place) in enumerate(zip(zip(k.tolist(), contexts, strict=True), at.tolist(), strict=True)):
        known = places.get(key)
        if known is None:
            places[key] = [place]
            first.append(i)
        else:
            known.append(place)
    columns = [pa.array(np.asarray(c, np.int64)[first]) for c in (k, ids, h)] + [pa.array(hot[first])]
    packed = pa.array([np.array(p, np.int64).tobytes() for p in places.values()], pa.binary())
    strings = pa.array([context for _, context in places], pa.binary())
    return pa.RecordBatch.from_arrays([columns[0], columns[1], packed, *columns[2:], strings], ["k", "id", "at", "h", "hot", "context"])


def cut_out(batch: pa.RecordBatch, data: np.ndarray, ends: np.ndarray, length: int, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Rows of the windows found (text, first, last, hash, hot) in a batch (k, id, body)."""
    which, first, last, h, hot = found
    text, start = data.tobytes(), ends[which]
    parts = [text[a:b] for a, b in zip((start + first).tolist(), (start + last + length).tolist(), strict=True)]
    k, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    return context_rows(k[which], ids[which], first, h.view(np.int64), hot, parts)


def of_round(hashes: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    return (hashes >> np.uint64(8)) % np.uint64(rounds) == turn


def contexts_by_broadcast(long: DataFrame, repeated: DataFrame, length: int, groups: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """The windows of repeated anchors with their bytes; a filter of the anchors is small enough for every task. It lets a few
    others pass, whose windows are found to stand nowhere else later."""
    table = repeated.select("group", "bits", "hot").toArrow()
    # a group without a row has a filter of zeros
    group, sizes = table["group"].to_numpy(), np.full(groups, 8, np.int64)
    own = np.array([8 * len(b) for b in table["bits"].to_pylist()], np.int64)
    sizes[group] = own
    starts = np.full(groups, own.sum(), np.int64)
    starts[group] = np.cumsum(own) - own
    bits = np.frombuffer(b"".join([*table["bits"].to_pylist(), b"\0"]), np.uint8)
    hot_of = [unpacked(table["hot"].slice(i, 1)) | np.uint64(g << 8 * KEPT_BYTES) for i, g in enumerate(group.tolist())]
    hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *hot_of]))
    known = long.sparkSession.sparkContext.broadcast((bits, starts, sizes.astype(np.uint64), hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, starts, sizes, hot = known.value
        for batch in slices(batches, SLICE):
            data, ends = flat(batch.column(2))
            which, first, last, h = anchors(data, ends, length)
            hit = np.flatnonzero(of_round(h, turn, rounds))
            group, kept = dealt(h[hit], groups)
            start = starts[group]
            inside = np.ones(len(hit), bool)
            for place in probes(kept, sizes[group]):
                place += start
                inside &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            hit, whole = hit[inside], (kept | (group.astype(np.uint64) << np.uint64(8 * KEPT_BYTES)))[inside]
            if len(hit):
                yield cut_out(batch, data, ends, length, (which[hit], first[hit], last[hit], h[hit], np.isin(whole, hot)))

    return long.mapInArrow(run, CONTEXT)


def repeated_places(long: DataFrame, repeated: DataFrame, length: int, groups: int) -> DataFrame:
    """(k, at): for each text which of its anchors are repeated, as numbers of 32 bits, twice the anchor's place in the order of the
    text's anchors and one more if it is hot; stored. Anchors are numbered over some texts, which are known by a digest of their
    keys, and only hashes and numbers travel."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def lists() -> pa.RecordBatch:
            keys, counts, hashes = (np.concatenate(c) for c in zip(*held, strict=True))
            label = int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), signed=True)
            group, kept = dealt(hashes, groups)
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            rows = [(label % groups, label, keys.tobytes(), counts.tobytes(), None, None)]
            for g in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[g] : cuts[g + 1]]
                rows.append((g, label, None, None, packed(kept[own]), np.diff(own, prepend=0).astype(np.uint32).tobytes()))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["group", "label", "keys", "counts", "hashes", "numbers"])

        for batch in slices(batches, SLICE):
            data, ends = flat(batch.column(1))
            which, _, _, hashes = anchors(data, ends, length)
            held.append((batch.column(0).to_numpy(), np.bincount(which, minlength=len(batch)).astype(np.int64), hashes))
            size += len(data)
            if size > LIST_BYTES:
                yield lists()
                held, size = [], 0
        if held:
            yield lists()

    def chosen(lists: pa.Table, repeated: pa.Table) -> pa.Table:
        known, hot = (np.sort(unpacked(repeated[c])) for c in ("anchors", "hot"))
        lists = lists.combine_chunks()
        rows = [(x["label"], x["keys"], x["counts"], None) for x in lists.filter(lists["hashes"].is_null()).to_pylist()]
        lists = lists.filter(lists["hashes"].is_valid())
        for i, (label, numbers) in enumerate(zip(lists["label"].to_pylist(), lists["numbers"].to_pylist(), strict=True)):
            kept = unpacked(lists["hashes"].slice(i, 1))
            numbers = np.cumsum(np.frombuffer(numbers, np.uint32).astype(np.int64))
            hit = np.isin(kept, known)
            if hit.any():
                rows.append((label, None, None, (2 * numbers[hit] + np.isin(kept[hit], hot)).tobytes()))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int64(), *[pa.binary()] * 3])]
        return pa.Table.from_arrays(columns, ["label", "keys", "counts", "found"])

    def by_text(rows: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(next(x for x in rows[c].to_pylist() if x is not None), np.int64) for c in ("keys", "counts"))
        found = np.unique(np.frombuffer(b"".join(rows["found"].drop_null().to_pylist()), np.int64))
        ends = np.cumsum(counts)
        text = np.searchsorted(ends, found >> 1, "right")
        own = (found - 2 * (ends - counts)[text]).astype(np.uint32)
        who, begin = np.unique(text, return_index=True)
        cuts = np.r_[begin, len(own)]
        at = pa.array([own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        return pa.Table.from_arrays([pa.array(keys[who]), at], ["k", "at"])

    lists = long.select("k", "body").mapInArrow(
        numbered, "group int, label long, keys binary, counts binary, hashes binary, numbers binary"
    )
    found = lists.groupBy("group").cogroup(repeated.select("group", "anchors", "hot").groupBy("group"))
    found = cut_lineage(found.applyInArrow(chosen, "label long, keys binary, counts binary, found binary"), "found-anchors")
    places = cut_lineage(found.groupBy("label").applyInArrow(by_text, "k long, at binary"), "repeated-places")
    discard(found)
    free_shuffles(long.sparkSession)
    return places


def contexts_by_join(long: DataFrame, places: DataFrame, length: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """The same for any number of repeated anchors: texts are joined with the places of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            data, ends = flat(batch.column(2))
            which, first, last, h = anchors(data, ends, length)
            begin = np.searchsorted(which, np.arange(len(batch)))
            own = [np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column(3).to_pylist()]
            at = np.concatenate(own)
            hit, hot = (at >> 1) + np.repeat(begin, [len(x) for x in own]), at & 1 == 1
            mine = of_round(h[hit], turn, rounds)
            hit, hot = hit[mine], hot[mine]
            if len(hit):
                yield cut_out(batch, data, ends, length, (which[hit], first[hit], last[hit], h[hit], hot))

    # repeated rows have one key and equal places
    rows = long.join(places.dropDuplicates(["k"]).withColumnRenamed("k", "__k"), F.col("k") == F.col("__k"))
    return rows.select("k", "id", "body", "at").mapInArrow(run, CONTEXT)


def shard_output(**columns) -> pa.RecordBatch:
    names = ["k", "id", "a", "b", "c", "h", "n", "context", "at"]
    size = len(next(iter(columns.values())))
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.list_(pa.int64())]
    given = [pa.array(columns[x], kind) if x in columns else pa.nulls(size, kind) for x, kind in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(given, names)


def repeated_spans(
    df: DataFrame,
    id_col: str,
    text_col: str,
    length: int,
    hot_from: int = HOT,
    broadcast_rows: int = BROADCAST_ROWS,
    round_bytes: int = ROUND_BYTES,
    round_share: float = ROUND_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """The texts (k, id, body, copy), and for each key k of them the spans to remove, in order and apart (k, spans: array of
    start, stop). A text without spans has no row there, nor has one that is a copy of a text with a smaller id, which goes
    whole and needs no search."""
    spark = df.sparkSession
    shards = partitions(spark)
    texts = id_and_bytes(df, id_col, text_col).select(F.xxhash64("id", "body").alias("k"), "id", "body")
    judged = (F.length("body") >= length) & F.col("id").isNotNull()
    texts = texts.withColumns({"h1": F.xxhash64("body"), "h2": F.crc32("body")})
    copies = texts.where(judged).groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = cut_lineage(copies.drop("n"), "copied-texts")
    texts = texts.join(sized(copies), ["h1", "h2"], "left")
    texts = texts.select("k", "id", "body", (judged & F.coalesce(F.col("id") > F.col("first"), F.lit(False))).alias("copy"))
    long = texts.where(judged & ~F.col("copy")).drop("copy")
    size = long.agg(F.sum(F.length("body"))).first()[0] or 0
    groups = max(shards, -(-size // GROUP_BYTES))
    shards = max(shards, -(-size // SHARD_BYTES))
    repeated = repeated_anchors(long, length, groups, hot_from)
    free_shuffles(spark)
    anchored = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("places"), F.lit(0)).alias("places")).first()
    rounds = max(1, math.ceil(anchored.places * (length + ROW_BYTES) / max(round_bytes, round_share * size)))
    places = None if anchored.n <= broadcast_rows else repeated_places(long, repeated, length, groups)

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans (k, a, b) of most rows. Rows of hot anchors pass (k, id, c and h: string, at: its places in the text), and their
        distinct strings once (c, h, id: least id, n: rows, context)."""
        number: dict[tuple, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        hot_names: dict[tuple, list] = {}
        for batch in batches:
            k, ids, h, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            at, strings = batch.column(2).to_pylist(), batch.column(5).to_pylist()
            if hot.any():
                chosen = np.flatnonzero(hot).tolist()
                names = []
                for i in chosen:
                    entry = hot_names.setdefault((strings[i], int(h[i])), [0, int(ids[i]), 0])
                    if not entry[2]:
                        entry[0] = int.from_bytes(hashlib.blake2b(strings[i], digest_size=8, key=int(h[i]).to_bytes(8, signed=True)).digest(), signed=True)
                    entry[1] = min(entry[1], int(ids[i]))
                    entry[2] += 1
                    names.append(entry[0])
                ends = np.cumsum([0, *(len(at[i]) // 8 for i in chosen)]).astype(np.int32)
                places = pa.array(np.frombuffer(b"".join(at[i] for i in chosen), np.int64))
                yield shard_output(k=k[chosen], id=ids[chosen], c=names, h=h[chosen], at=pa.ListArray.from_arrays(pa.array(ends), places))
            cold = np.flatnonzero(~hot).tolist()
            index = np.array([number.setdefault(strings[i], len(number)) for i in cold], np.int64)
            n = [len(at[i]) // 8 for i in cold]
            places = np.frombuffer(b"".join(at[i] for i in cold), np.int64)
            parts.append((np.repeat(k[cold], n), np.repeat(ids[cold], n), places, np.repeat(index, n)))
        if hot_names:
            yield shard_output(
                c=[e[0] for e in hot_names.values()], h=[h for _, h in hot_names], id=[e[1] for e in hot_names.values()],
                n=[e[2] for e in hot_names.values()], context=[s for s, _ in hot_names],
            )
        if not number:
            return
        k, ids, at, index = (np.concatenate(c) for c in zip(*parts, strict=True))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, index, ids)
        copies = np.bincount(index, minlength=len(number))
        most = np.full(len(number), np.iinfo(np.int64).min)
        np.maximum.at(most, index, ids)
        owner, a, b, low = judge(list(number), least, most > least, length)
        # every row of a string gets its stretches
        order = np.argsort(index, kind="stable")
        begin = np.cumsum(copies) - copies
        n = copies[owner]
        stretch = np.repeat(np.arange(len(owner)), n)
        row = order[np.repeat(begin[owner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        later = ids[row] > low[stretch]
        row, stretch = row[later], stretch[later]
        for i in range(0, len(row), 100_000):
            r, s = row[i : i + 100_000], stretch[i : i + 100_000]
            yield shard_output(k=k[r], a=at[r] + a[s], b=at[r] + b[s])

    def sort_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each string with a window that stands elsewhere too: its stretches, which are fewer than its bytes."""
        names, anchor, least, often, strings = [], [], [], [], []
        for batch in batches:
            names.append(batch.column(0).to_numpy())
            anchor.append(batch.column(1).to_numpy())
            least.append(batch.column(2).to_numpy())
            often.append(batch.column(3).to_numpy() > 1)
            strings.extend(batch.column(4).to_pylist())
        if strings:
            owner, a, b, low = judge(strings, np.concatenate(least), np.concatenate(often), length)
            order = np.argsort(owner, kind="stable")
            who, begin = np.unique(owner[order], return_index=True)
            stretches = pa.StructArray.from_arrays([pa.array(c[order]) for c in (a, b, low)], ["from", "to", "low"])
            ends = pa.array(np.r_[begin, len(order)].astype(np.int32))
            columns = [pa.array(np.concatenate(c)[who]) for c in (names, anchor)] + [pa.ListArray.from_arrays(ends, stretches)]
            yield pa.RecordBatch.from_arrays(columns, ["c", "h", "stretches"])

    # rows of hot anchors may go anywhere
    target = F.when(F.col("hot"), F.xxhash64("k", "context")).otherwise(F.col("h"))
    done = []
    for turn in range(rounds):
        if places is None:
            held = contexts_by_broadcast(long, repeated, length, groups, turn, rounds)
        else:
            held = contexts_by_join(long, places, length, turn, rounds)
        sorted_out = held.repartition(shards, target).mapInArrow(
            sort_shard, "k long, id long, a long, b long, c long, h long, n long, context binary, at array<long>"
        )
        done.append(cut_lineage(sorted_out, "shards"))
        free_shuffles(spark)
    out = reduce(DataFrame.unionByName, done)
    strings = out.where("context is not null").groupBy("c", "h", "context").agg(F.min("id").alias("least"), F.sum("n").alias("n"))
    judged = strings.repartition(partitions(spark), "h").select("c", "h", "least", "n", "context")
    judged = judged.mapInArrow(sort_hot, "c long, h long, stretches array<struct<from: long, to: long, low: long>>")
    judged = cut_lineage(judged, "judged")
    # a text and string meet one row
    hot = out.where("at is not null").select("k", "id", "at", "c", "h").join(judged, ["c", "h"])
    hot = hot.withColumn("stretches", F.filter("stretches", lambda s: s["low"] < F.col("id"))).where(F.size("stretches") > 0)
    hot = hot.select("k", F.flatten(F.transform("at", lambda p: F.transform(
        "stretches", lambda s: F.struct((p + s["from"]).alias("start"), (p + s["to"]).alias("stop"))
    ))).alias("spans"))
    cold = out.where("b is not null").select("k", F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("stop"))).alias("spans"))
    # a document has no more spans than bytes; repeated rows have one key and equal spans
    spans = cold.union(hot).groupBy("k").agg(F.flatten(F.collect_set("spans")).alias("spans"))

    def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [[{"start": a, "stop": b} for a, b in merged(s)] for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(apart, batch.schema.field(1).type)], ["k", "spans"])

    spans = spans.mapInArrow(join_spans, "k long, spans array<struct<start: long, stop: long>>")
    spans = cut_lineage(spans, "spans")
    discard(repeated, judged, *done, *([] if places is None else [places]))
    free_shuffles(spark)
    return texts, sized(spans, 400_000)


def merged(spans: pa.Scalar) -> list[tuple[int, int]]:
    """Spans in order, those that touch joined."""
    if not spans.is_valid:
        return []
    start, stop = (c.to_numpy() for c in spans.values.flatten())
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    return list(zip(start[first].tolist(), stop[np.r_[first[1:], len(start)] - 1].tolist(), strict=True))


def without(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, stop in spans:
        out.append(body[at:start])
        at = stop
    return b"".join([*out, body[at:]])


def whole_letters(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole characters of UTF-8."""
    out = []
    for start, stop in spans:
        while start < stop and body[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(body) and body[stop] & 0xC0 == 0x80:
            stop -= 1
        if stop > start:
            out.append((start, stop))
    return out


def dedup_report(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    hot_from: int = HOT,
    broadcast_rows: int = BROADCAST_ROWS,
    round_bytes: int = ROUND_BYTES,
    round_share: float = ROUND_SHARE,
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes left, joined.

    A byte goes if a string of `length` bytes covers it that also starts in a row with a smaller id. Null texts are empty;
    rows without an id are neither judged nor compared; rows with one id do not judge each other; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests = [], [], [], []
            for body, spans in zip(batch.column(1), batch.column(2), strict=True):
                body, found = body.as_py(), merged(spans)
                left = without(body, found)
                sizes.append(len(body))
                removed.append(len(body) - len(left))
                runs.append(len(found))
                digests.append(hashlib.sha256(left).hexdigest())
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts, spans = repeated_spans(df, id_col, text_col, length, hot_from, broadcast_rows, round_bytes, round_share)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("body").cast("long").alias("stop")))
    rows = texts.join(spans, "k", "left").select("id", "body", F.when(F.col("copy"), whole).otherwise(F.col("spans")).alias("spans"))
    out = rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """`df` with the repeated passages cut out of its texts. A character stays whole if one of its bytes stays. Texts from
    which nothing goes, nulls included, and all other columns are as before."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(len(names)), strict=True):
                text = text.as_py()
                if text is not None and (found := merged(spans)):
                    body = text.encode()
                    text = without(body, whole_letters(body, found)).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    texts, spans = repeated_spans(df, id_col, text_col, length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("body").cast("long").alias("stop")))
    copies = cut_lineage(texts.where("copy").select("k", whole.alias("spans")).distinct(), "copies")
    spans = sized(cut_lineage(spans.unionByName(copies), "spans"), 400_000)
    spans = spans.withColumnsRenamed({"k": "__k", "spans": "__spans"})
    key = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = df.join(spans, key == F.col("__k"), "left").select(*names, "__spans")
    return rows.mapInArrow(run, df.schema)
