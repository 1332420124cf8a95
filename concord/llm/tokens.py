"""Exact token counts at every prefix, by prefix dynamic programming over a byte-pair vocabulary.

A token sequence is the encoding of its text exactly if every two neighbours are the encoding of their own
concatenation. So the encoding of a prefix ends in the one vocabulary entry whose left neighbour (the last token of the
shorter prefix) it may follow, and `count[i] = count[i - length of that entry] + 1`. The table over prefixes is shared by
all words that begin alike, so each new word costs only its tail. A vocabulary with an end-of-word mark needs two entries per
prefix: the state inside a word, and the count if the word ended here.

Counts hold at every character prefix of the normalised text (NFC, lower case), which is how the library reads a text.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words longer than this are counted without remembering their prefixes, and the shared tables are emptied at this size.
LONG, TABLE_SIZE = 48, 600_000
#: White space as the tokenizer's pattern has it (the Unicode property).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

SPACES, SEPARATORS = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranges(initial: str) -> str:
    """The characters of a Unicode major category as a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == initial
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Maps a run of text without white space or special strings to its number of tokens; fills itself by the prefix table."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letter = spec["model"], _byte_letters()
        self.suffix = suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix:
            raise ValueError("a byte-pair vocabulary with an end-of-word mark is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        for text, number in model["vocab"].items():
            if text in self.special:
                continue
            end = text.endswith(suffix)
            raw = bytes(letter[c] for c in (text.removesuffix(suffix) if end else text))
            (self.closed if end else self.open)[raw] = number
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: merge order and parts of every merged token; single bytes have neither
        self.order = {vocab[a + b]: i for i, (a, b) in enumerate(pairs)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in pairs}
        self.merged = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, [*self.open, *self.closed]))
        self.table: dict[bytes, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        letters, numbers = _ranges("L"), _ranges("N")
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
        self.cut = re.compile("|".join(map(re.escape, self.special)) or "(?!)")

    def may_follow(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when their concatenation is encoded: taking their merges back from the latest to
        the earliest, no two tokens that meet at the border may have a merge that comes before the one taken back."""
        merged, order, parts = self.merged, self.order, self.parts
        limit = 1 << 30
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            a, b = order.get(left, -1), order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:  # of equal merges the leftmost comes first
                limit, right = b + 1, parts[right][0]

    def step(self, raw: bytes, end: int, states: list[tuple[int, int]]) -> tuple[int, int]:
        """Last token and count of prefix raw[:end], inside a word, from the entries of all shorter prefixes."""
        opened, fits = self.open, self.fits
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            token = opened.get(raw[start:end])
            if token is not None:
                left, count = states[start]
                key = left << 20 | token
                good = fits.get(key)
                if good is None:
                    good = fits[key] = left < 0 or self.may_follow(left, token)
                if good:
                    return token, count + 1
        raise AssertionError("every byte is in the vocabulary")

    def closed_count(self, raw: bytes, end: int, states: list[tuple[int, int]]) -> int:
        """Count of prefix raw[:end] as a whole word."""
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            token = self.closed.get(raw[start:end])
            if token is not None and (start == 0 or self.may_follow(states[start][0], token)):
                return states[start][1] + 1
        raise AssertionError("every byte is in the vocabulary")

    def states(self, raw: bytes, upto: int | None = None) -> list[tuple[int, int]]:
        """Entries of the prefixes of length 0, 1, ..., up to `upto` or the whole."""
        upto = len(raw) if upto is None else upto
        out, table = [(-1, 0)], self.table
        if len(raw) > LONG:
            for end in range(1, upto + 1):
                out.append(self.step(raw, end, out))
            return out
        for end in range(1, upto + 1):
            key = raw[:end]
            entry = table.get(key)
            if entry is None:
                entry = table[key] = self.step(raw, end, out)
            out.append(entry)
        return out

    def entry(self, raw: bytes) -> tuple[int, int]:
        """The entry of one prefix; of the shorter ones only those are computed that its last token can stand behind."""
        found = self.table.get(raw)
        if found is None:
            size, opened, fits = len(raw), self.open, self.fits
            if size == 0:
                return -1, 0
            for start in range(max(0, size - self.longest), size):
                token = opened.get(raw[start:])
                if token is not None:
                    left, count = self.entry(raw[:start])
                    key = left << 20 | token
                    good = fits.get(key)
                    if good is None:
                        good = fits[key] = left < 0 or self.may_follow(left, token)
                    if good:
                        found = self.table[raw] = token, count + 1
                        break
        return found

    def whole(self, word: str) -> int:
        """Count of a word."""
        raw = word.encode()
        size = len(raw)
        if size > LONG:
            return self.closed_count(raw, size, self.states(raw, size - 1))
        for start in range(max(0, size - self.longest), size):
            token = self.closed.get(raw[start:])
            if token is not None:
                left, count = self.entry(raw[:start])
                if left < 0 or self.may_follow(left, token):
                    break
        for cache in (self.table, self.fits):
            if len(cache) > TABLE_SIZE:
                cache.clear()
        return count + 1

    def __missing__(self, run: str) -> int:
        count = sum(map(self.whole, self.word.findall(run)))
        if len(run) <= LONG:
            if len(self) > 2 * TABLE_SIZE:
                self.clear()
            self[run] = count
        return count

    def pieces(self, text: str) -> Iterator[tuple[int, str]]:
        """(start in the normalised text, word), special strings as words of their own."""
        at = done = 0
        for hit in [*self.cut.finditer(text), None]:
            plain = normal(text[at : hit.start() if hit else len(text)])
            for m in self.word.finditer(plain):
                yield done + m.start(), m[0]
            done += len(plain)
            if hit:
                yield done, hit[0]
                at, done = hit.end(), done + len(hit[0])

    def count(self, text: str) -> int:
        if "<|" in text and self.cut.search(text):
            return sum(map(self.count, self.cut.split(text))) + len(self.cut.findall(text))
        if SEPARATORS.search(text):  # white space to str.split, but not to the tokenizer
            return sum(map(self.__getitem__, SPACES.split(normal(text))))
        return sum(map(self.__getitem__, normal(text).split()))

    def of(self, word: str) -> int:
        return 1 if word in self.special else self[word]

    def inside(self, word: str) -> list[int]:
        """Counts of the character prefixes of length 1, ..., len(word) of a word."""
        if word in self.special:
            return [self.count(word[:k]) for k in range(1, len(word))] + [1]
        if word[0] == "'" and word[1:].isalpha():  # a cut contraction falls apart into mark and letters
            return [self.count(word[:k]) for k in range(1, len(word) + 1)]
        raw, out, at = word.encode(), [], 0
        states = self.states(raw)
        for c in word:
            at += len(c.encode())
            out.append(self.closed_count(raw, at, states))
        return out

    def at_every_prefix(self, text: str) -> list[int]:
        """Token count of each character prefix of the normalised text, the empty prefix first."""
        out, total, before, last = [0], 0, None, 0
        for start, word in self.pieces(text):
            out.extend([total] * (start - (len(out) - 1)))
            if word in self.special and before is not None and last == start and not before[-1].isalnum():
                # part of a special string joins the marks before it
                base = total - self.of(before)
                out.extend(base + self.count(before + word[:k]) for k in range(1, len(word)))
                out.append(total + 1)
            else:
                out.extend(total + n for n in self.inside(word))
            total += self.of(word)
            before, last = word, start + len(word)
        size = sum(len(normal(t)) for t in self.cut.split(text)) + sum(len(t) for t in self.cut.findall(text))
        out.extend([total] * (size + 1 - len(out)))
        return out

    def fit(self, text: str, budget: int) -> int:
        """Length of a longest run of leading whole words, and of characters of the next one, of at most `budget` tokens."""
        found = list(self.pieces(text))
        sums = list(accumulate(self.of(w) for _, w in found))
        whole = bisect_right(sums, budget)
        if whole == len(found):
            return sum(len(normal(t)) for t in self.cut.split(text)) + sum(len(t) for t in self.cut.findall(text))
        start, word = found[whole]
        left = budget - (sums[whole - 1] if whole else 0)
        part = [] if word in self.special else self.inside(word)
        return start + max((k for k, n in enumerate(part, 1) if n <= left), default=0)


def normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048, tokenizer: str | None = None
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than `budget` tokens) and fit_chars, the length of a prefix of the
    normalised text that has at most `budget` tokens, to the character.

    One pass without a shuffle; memory is one Arrow batch and the bounded prefix table. A null text counts as empty
    (0 tokens); a null id stays null; repeated rows give repeated rows; an empty table gives no row.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n_tokens, fit = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n = c.count(text)
                n_tokens.append(n)
                fit.append(c.fit(text, budget) if n > budget else len(normal(text)))
            columns = [batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "fit_chars"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("body"), F.octet_length(text).cast("long"))
    out = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, fit_chars long")
    over = (F.col("n_tokens") > budget).alias("over_limit")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", over, "fit_chars")


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per row: id and `counts`, the exact token count of every character prefix (index 0: the empty prefix). The cost of a
    cut at n characters is counts[n]; no text is encoded again to answer it."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                counts = [c.at_every_prefix(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.list_(pa.int32()))], ["id", "counts"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, "id long, counts array<int>").withColumnRenamed("id", id_col)


def within_budget(prefixes: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """Longest prefix of at most `budget` tokens, read from stored prefix counts alone."""
    # counts may fall by a token when a word is completed, so the longest prefix is looked up from the end
    fits = F.filter(F.sequence(F.size("counts") - 1, F.lit(0)), lambda i: F.col("counts")[i] <= budget)
    return prefixes.select(id_col, F.element_at(fits, 1).alias("fit_chars"))
