"""Packing of token sequences into fixed windows by the sum-of-squares rule.

Let N(h) be the number of open windows that are filled to level h. Each piece goes, as it comes, to the level where the
sum of the squares of all N(h) afterwards is least. That keeps windows of every level at hand, so that a partner can
be found for nearly every length; no look-ahead and no sorting are needed.

Documents longer than a window give whole windows and one rest, and only the rest is placed by the rule. Each task packs
its own input, so nothing is shuffled. At a task's end the windows still open are cut and joined so that one window of each
task at most stays partly empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens in a window.
WINDOW = 1024
#: Sequence numbers of one task start at its partition number times this.
PER_TASK = 1 << 40

NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary of a byte-level tokenizer file in the faster of the two libraries that read it. Both give the same ids
    (held against each other in the tests); special strings inside a text are tokens, as in the file's own library."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letter[c] for c in t): n for t, n in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coding.encode(text, allowed_special="all")


class Packer:
    """Assigns pieces to windows; rows come out in the order of NAMES."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence = window, first
        self.count = np.zeros(window + 1, np.int64)
        #: windows by level; each is a list of pieces (id, start, ids, doc_tokens)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def level(self, size: int) -> int:
        """Level (0: a new window) at which a piece leaves the least sum of squares; of equal ones the fullest."""
        n, w = self.count, self.window
        top = w - size
        gain = 1 - 2 * n[: top + 1]  # one window fewer at this level
        gain[0] = 0
        gain[:top] += 2 * n[size:w] + 1  # one more at the level it reaches; a full window leaves the count
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(gain[::-1]))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        whole = total - total % w
        for start in range(0, whole, w):
            self.close([(doc, start, ids[start : start + w], total)])
        if whole == total:
            return
        piece, size = (doc, whole, ids[whole:].copy(), total), total - whole
        at = self.level(size)
        pieces = self.open[at].pop() if at else []
        self.count[at] -= at > 0
        pieces.append(piece)
        if at + size == w:
            self.close(pieces)
        else:
            self.open[at + size].append(pieces)
            self.count[at + size] += 1

    def finish(self) -> None:
        room, window = self.window, []
        for pieces in (p for level in reversed(self.open) for p in level):
            for doc, start, ids, total in pieces:
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    window.append((doc, start, part, total))
                    start, room = start + len(part), room - len(part)
                    if not room:
                        self.close(window)
                        room, window = self.window, []
        if window:
            self.close(window)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids followed by id 0, so a null or empty text is one piece of length 1, and every token lies in
    exactly one piece. Memory is one Arrow batch and the open windows of one task, of which the rule keeps few. Repeated
    rows are packed each; a null id stays null; an empty table gives no row.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(window, TaskContext.get().partitionId() * PER_TASK)

        def rows() -> pa.RecordBatch:
            found, packer.rows = packer.rows, []
            columns = list(zip(*found, strict=True)) or [[]] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.array([*encode(value.as_py() or ""), 0], "<u4"))
                if len(packer.rows) >= 50_000:
                    yield rows()
            yield rows()
        packer.finish()
        yield rows()

    kinds = ", ".join(f"{n} long" for n in NAMES)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return texts.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
