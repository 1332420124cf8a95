"""External induced sorting of the suffixes of many short strings, with common-prefix values.

Suffixes are split into those smaller (S) and larger (L) than their successor. Once the S suffixes that follow an L one (the
seeds) are in order, two sweeps over the first letters put all others in order: whoever is taken from the front of a
letter's queue puts its predecessor at the end of the queue of that predecessor's letter. The queues carry (suffix,
common prefix with the one before it); the common prefix of two neighbours in a queue is one more than the least value
between their sources. The seeds are ordered by the same two sweeps over the pieces between seeds, whose ranks form
a shorter string; that one is ordered by doubling of ranks.

All steps work on whole blocks of a queue with numpy. Queues beyond `memory` entries go to an unnamed temporary file and are
read back when their letter comes, and text and ranks beyond it are mapped from such files, so a shard may be far larger
than memory. Strings end in separators that are smaller than any byte and differ from each other, so no common prefix
runs over the end of a string. Common prefixes are counted up to `cap`.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import numpy as np

ALPHABET = 257  # separator and 256 bytes
NONE = np.iinfo(np.int64).max


class Queues:
    """A queue of (suffix, common prefix) for each letter, on disk beyond a bound."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.parts: list[list] = [[] for _ in range(ALPHABET)]

    def put(self, letter: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        self.parts[letter].append((suffixes, prefixes))
        self.held += len(suffixes)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, part in enumerate(parts):
                if not isinstance(part[0], int):
                    place = self.file.tell()
                    for column in part:
                        self.file.write(column.astype(np.int64).tobytes())
                    parts[i] = place, len(part[0])
        self.held = 0

    def take(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """All that the letter's queue holds, in order; it is empty afterwards."""
        parts, self.parts[letter] = self.parts[letter], []
        columns = []
        for part in parts:
            if isinstance(part[0], int):
                self.file.seek(part[0])
                both = np.frombuffer(self.file.read(16 * part[1]), np.int64)
                part = both[: part[1]], both[part[1] :]
            else:
                self.held -= len(part[0])
            columns.append(part)
        if not columns:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns])


def on_disk(array: np.ndarray, memory: int) -> np.ndarray:
    if len(array) <= memory:
        return array
    with tempfile.NamedTemporaryFile() as f:  # the mapping outlives the name
        array.tofile(f)
        f.flush()
        return np.memmap(f.name, array.dtype, "r", shape=array.shape)


class Shard:
    def __init__(self, strings: Iterable[bytes], cap: int, memory: int):
        joined, lengths = bytearray(), []
        for s in strings:
            joined += s
            joined.append(0)
            lengths.append(len(s) + 1)
        self.ends = np.cumsum(np.array(lengths, np.int64))
        letters = np.frombuffer(bytes(joined), np.uint8).astype(np.uint16) + 1
        if len(letters):
            letters[self.ends - 1] = 0
        self.cap, self.memory, self.n = cap, memory, len(letters)
        self.text = on_disk(letters, memory)
        self.small = on_disk(self.types(letters), memory)  # S suffixes

    @staticmethod
    def types(text: np.ndarray) -> np.ndarray:
        if not len(text):
            return np.zeros(0, bool)
        step = np.r_[np.diff(text.astype(np.int16)), 1]
        at = np.where(step != 0, np.arange(len(step)), len(step) - 1)
        return step[np.minimum.accumulate(at[::-1])[::-1]] > 0

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs by comparison, up to cap."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for k in range(self.cap):
            i, j = a[live] + k, b[live] + k
            ok = (i < self.n) & (j < self.n)
            live, i, j = live[ok], i[ok], j[ok]
            x = self.text[i]
            live = live[(x == self.text[j]) & (x > 0)]
            out[live] = k + 1
            if not len(live):
                break
        return out

    def spread(self, queues: Queues, since: np.ndarray, letter: int, block: np.ndarray, prefix: np.ndarray, kind: bool):
        """Put the predecessors of a block that are of the given type into the queues of their letters."""
        if not len(block):
            return
        before = np.where(block > 0, block - 1, 0)
        fits = (block > 0) & (self.small[before] == kind)
        letters = np.where(fits, self.text[before], ALPHABET)
        present = np.unique(letters)
        least = prefix.min()
        last = {}
        for c in present[present < ALPHABET].tolist():
            at = np.flatnonzero(letters == c)
            gaps = np.minimum.reduceat(prefix[: at[-1] + 1], np.r_[0, at[:-1] + 1])
            gaps[0] = min(gaps[0], since[c])
            queues.put(c, before[at], np.minimum(gaps + 1, self.cap) if c else np.zeros(len(at), np.int64))
            rest = prefix[at[-1] + 1 :]
            last[c] = rest.min() if len(rest) else NONE
        np.minimum(since, least, out=since)
        for c, value in last.items():
            since[c] = value

    def sweep(self, seeds: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """All suffixes with common prefixes, by first letter, from the seeds of each letter in order."""
        queues, since = Queues(self.memory), np.full(ALPHABET, NONE)
        large: list[tuple[np.ndarray, np.ndarray]] = []
        for c in range(ALPHABET):
            since[:] = np.minimum(since, 0)  # another first letter
            done = []
            while len((taken := queues.take(c))[0]):
                block, prefix = taken
                if not done:
                    prefix[0:1] = 0
                self.spread(queues, since, c, block, prefix, False)
                done.append(taken)
            joined = tuple(np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
            large.append(joined)
            block, prefix = seeds[c]
            if len(block):
                prefix = prefix.copy()
                prefix[0] = self.common(joined[0][-1:], block[:1])[0] if len(joined[0]) else 0
                self.spread(queues, since, c, block, prefix, False)
        queues, since = Queues(self.memory), np.full(ALPHABET, NONE)
        out: list[tuple[np.ndarray, np.ndarray]] = [None] * ALPHABET
        ended = np.flatnonzero(self.text == 0)  # separators, the last of them begins nothing
        for c in range(ALPHABET - 1, -1, -1):
            since[:] = np.minimum(since, 0)
            done = []
            if c == 0:
                done.append((ended[::-1], np.zeros(len(ended), np.int64)))
                queues.take(c)
            while len((taken := queues.take(c))[0]):
                block, prefix = taken
                if not done:
                    prefix[0:1] = 0
                self.spread(queues, since, c, block, prefix, True)
                done.append(taken)
            block, prefix = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
            low, low_prefix = large[c]
            seam = self.common(low[-1:], block[-1:])[0] if len(low) and len(block) else 0
            if len(low):
                # downwards the prefix shared with the one above stands at the one below
                down = np.r_[seam, low_prefix[:0:-1]]
                self.spread(queues, since, c, low[::-1], down, True)
            up = np.r_[seam, prefix[:0:-1]] if len(block) else prefix
            out[c] = np.concatenate([low, block[::-1]]), np.concatenate([low_prefix, up])
        return out

    def by_letter(self, seeds: np.ndarray, prefixes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Seeds in order, cut by first letter."""
        cuts = np.searchsorted(self.text[seeds], np.arange(ALPHABET + 1))
        return [(seeds[a:b], prefixes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order and the common prefix of each with the one before it."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        small = self.small
        is_seed = np.zeros(self.n, bool)
        is_seed[1:] = small[1:] & ~small[:-1]
        seeds = np.flatnonzero(is_seed)
        by_place = seeds[np.argsort(self.text[seeds], kind="stable")]
        first = self.sweep(self.by_letter(by_place, np.zeros(len(by_place), np.int64)))
        pieces = np.concatenate([s[is_seed[s]] for s, _ in first])
        # equal pieces between seeds get equal names; separators get names of their own, in the order of their places
        stop = np.full(self.n, self.n, np.int64)
        stop[seeds[:-1]] = seeds[1:] + 1
        mark = np.random.default_rng(5).integers(0, 1 << 63, ALPHABET, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.n, 0x9E3779B97F4A7C15, np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(mark[self.text] * power[: self.n])]
        inverse = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.n, inverse, np.uint64)])
        size = stop[pieces] - pieces
        digest = (sums[stop[pieces]] - sums[pieces]) * back[pieces]
        ends = np.add.reduceat(self.text[: self.n] == 0, seeds) if len(seeds) else np.zeros(0)
        has_end = np.zeros(self.n, bool)
        has_end[seeds[ends > 0]] = True
        # a piece that runs into a separator differs from all others
        runs_out = has_end[pieces] | (self.text[np.minimum(stop[pieces] - 1, self.n - 1)] == 0)
        new = np.r_[True, (size[1:] != size[:-1]) | (digest[1:] != digest[:-1]) | runs_out[1:] | runs_out[:-1]]
        name = np.zeros(self.n, np.int64)
        name[pieces] = np.cumsum(new)
        rank = name[seeds]
        # doubling: pieces that begin alike are told apart by what follows
        step = 1
        while len(rank) and rank.max() < len(rank):
            after = np.r_[rank[step:], np.zeros(min(step, len(rank)), np.int64)]
            order = np.lexsort((after, rank))
            fresh = np.r_[True, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])]
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(fresh)
            step *= 2
            if step > len(rank):
                break
        seeds = seeds[np.argsort(rank, kind="stable")]
        prefixes = np.r_[0, self.common(seeds[:-1], seeds[1:])].astype(np.int64)
        result = self.sweep(self.by_letter(seeds, prefixes))
        return np.concatenate([s for s, _ in result]), np.concatenate([p for _, p in result])


def sorted_suffixes(strings: Iterable[bytes], cap: int, memory: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordered suffixes (places in the joined strings, a separator behind each), common prefixes up to cap, and string ends."""
    shard = Shard(strings, cap, memory)
    suffixes, prefixes = shard.ordered()
    return suffixes, prefixes, shard.ends
