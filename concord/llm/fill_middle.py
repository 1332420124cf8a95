"""Fill-in-the-middle documents, cut at token borders by memoized content-defined chunks.

Where a document is cut depends on how many tokens it has and where they end. A rolling hash over the bytes cuts every text
into chunks whose borders depend on the content around them alone, so texts that share a passage share its chunks. For
a chunk that has been seen, after its bytes were compared, a cache holds a boundary summary: how many tokens end inside it and
where, whether its first and last byte are white space, and how many code points it has. Summaries combine: a token
also ends between a chunk that ends in a word and one that begins with white space. The sums give a document's token
count and the chunk in which each of its cuts lies; only that chunk's summary is searched for the place.

One pass over the table without a shuffle.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import flat, id_and_bytes, slices

#: Bytes under the rolling hash, a border after one in so many bytes, and the longest chunk.
WINDOW, MEAN_BITS, LONGEST = 32, 11, 1 << 14
#: Bytes that are hashed at once, and bytes of chunks that a task's cache holds at most.
SEGMENT, CACHE_BYTES = 1 << 19, 32 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_rng = np.random.default_rng(13)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, SEGMENT + WINDOW)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), SEGMENT + WINDOW + 1)


def borders(data: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last WINDOW bytes ends a chunk, in rising order."""
    found = []
    for at in range(0, len(data), SEGMENT):
        low = max(0, at - WINDOW + 1)
        part = data[low : at + SEGMENT]
        if len(part) < WINDOW:
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=sums[1:])
        hashes = (sums[WINDOW:] - sums[:-WINDOW]) * _DOWN[: len(part) - WINDOW + 1] * _SPREAD
        found.append(np.flatnonzero(hashes >> np.uint64(64 - MEAN_BITS) == 0) + low + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(places: np.ndarray, start: int, stop: int) -> list[int]:
    """Ends of the chunks of the text data[start:stop]: the borders whose window lies inside it, and a cut wherever a chunk
    would get longer than LONGEST."""
    inside = places[np.searchsorted(places, start + WINDOW) : np.searchsorted(places, stop)].tolist()
    out, last = [], start
    for end in [*inside, stop]:
        while end - last > LONGEST:
            last += LONGEST
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


@dataclass(slots=True)
class Summary:
    """What a chunk contributes to the tokens of a text."""

    content: bytes
    blank_first: bool
    blank_last: bool
    ends: np.ndarray  # offsets at which a token ends inside the chunk
    chars: int

    @classmethod
    def of(cls, content: bytes) -> Summary:
        data = np.frombuffer(content, np.uint8)
        blank = _BLANK[data]
        ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        return cls(content, bool(blank[0]), bool(blank[-1]), ends.astype(np.int32), characters(data))


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Memo:
    """Summaries of the chunks seen last, by a hash of the chunk; its bytes are compared before a summary is used."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.size, self.hits, self.seen = most, 0, 0, OrderedDict()

    def get(self, content: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(content)
        found = self.seen.get(key)
        if found is not None and found.content == content:
            self.seen.move_to_end(key)
            self.hits += 1
            return found
        made = Summary.of(content)
        if found is not None:
            self.size -= self._weight(found)
        self.seen[key] = made
        self.seen.move_to_end(key)
        self.size += self._weight(made)
        while self.size > self.most and len(self.seen) > 1:
            self.size -= self._weight(self.seen.popitem(last=False)[1])
        return made

    @staticmethod
    def _weight(entry: Summary) -> int:
        return len(entry.content) + entry.ends.nbytes + 300


class Tokens:
    """Token counts and cuts of one text, from the summaries of its chunks."""

    def __init__(self, data: np.ndarray, start: int, ends: list[int], memo: Memo):
        self.data, self.start, self.stop = data, start, ends[-1] if ends else start
        self.at, self.parts, self.border, self.upto, self.chars = [], [], [], [], []
        at, count, chars, word = start, 0, 0, False
        for end in ends:
            part = memo.get(data[at:end].tobytes())
            border = word and part.blank_first
            count += border + len(part.ends)
            chars += part.chars
            self.at.append(at)
            self.parts.append(part)
            self.border.append(border)
            self.upto.append(count)
            self.chars.append(chars)
            at, word = end, not part.blank_last
        #: the last word or the white space behind it ends with the text
        self.n = count + (1 if ends else 0)

    def end_of(self, token: int) -> tuple[int, int]:
        """Offset in bytes, and in code points, at which the first `token` tokens end."""
        if token == 0:
            return 0, 0
        if token == self.n:
            return self.stop - self.start, self.chars[-1]
        k = bisect_left(self.upto, token)
        before = self.upto[k - 1] if k else 0
        place = token - before - 1 - self.border[k]
        inside = 0 if place < 0 else int(self.parts[k].ends[place])
        passed = self.chars[k - 1] if k else 0
        at = self.at[k] + inside
        return at - self.start, passed + characters(self.data[self.at[k] : at])


def draws(seed: int, doc_id) -> list[int]:
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(text.encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80
) -> DataFrame:
    """Per row: id, n, form, prefix_chars, middle_chars, output.

    n counts the tokens: runs of anything but white space with the white space before them, and white space at the end.
    `rate` of a hundred texts are cut, `spm` of a hundred of those in the order suffix, prefix, middle, by a hash of `seed` and
    the id, so a rerun gives the same. A text that is empty, null (taken as empty) or holds a marker stays plain, with null
    lengths. A null id is hashed as an empty one; repeated rows give equal results. Texts of any length are cut whole: scratch
    arrays cover SEGMENT bytes and caches CACHE_BYTES. An empty table gives no row.
    """
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for whole in batches:
            for batch in slices([whole]):
                data, at = flat(batch.column(1))
                places = borders(data)
                out = [one(doc_id, data, a, b, places, memo) for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def one(doc_id, data, start, stop, places, memo):
        tokens = Tokens(data, start, chunk_ends(places, start, stop), memo)
        body = data[start:stop].tobytes()
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not body or h3 % 100 >= rate or any(m in body for m in markers):
            return tokens.n, "plain", None, None, body
        first, second = sorted((h1 % (tokens.n + 1), h2 % (tokens.n + 1)))
        (a, a_chars), (b, b_chars) = tokens.end_of(first), tokens.end_of(second)
        prefix, middle, suffix = body[:a], body[a:b], body[b:]
        p, s, m = markers
        form = "spm" if h4 % 100 < spm else "psm"
        parts = [s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle]
        return tokens.n, form, a_chars, b_chars - a_chars, b"".join(parts)

    rows = id_and_bytes(df, id_col, text_col)
    found = rows.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, found by its markers."""
    first = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    # an output begins with a marker of three characters, and each marker stands in it once
    parts = F.split(F.substr(output, F.lit(4)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", 3)
    a, b, middle = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    whole = F.when(first == PREFIX, F.concat(b, middle, a)).otherwise(F.concat(a, middle, b))
    return F.when(form == "plain", output).otherwise(whole)


def fill_in_middle_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`fill_in_middle` with digests of the output and of the text restored from it instead of the output."""
    made = fill_in_middle(df, id_col, text_col)
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || doc_id::VARCHAR) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents),
u AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
v AS (
  SELECT *, coalesce(array_to_string(w[1:least(x, y)], ''), '') AS pre, coalesce(array_to_string(w[least(x, y) + 1:greatest(x, y)], ''), '') AS mid,
         coalesce(array_to_string(w[greatest(x, y) + 1:], ''), '') AS suf
  FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM v
"""
