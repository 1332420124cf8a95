import zlib
from collections import defaultdict

import numpy as np
import pytest

from concord.llm.packing import Packer, default_tokenizer, encoder, pack
from tests.llm.helpers import ODD, documents, prose

tokenizers = pytest.importorskip("tokenizers")


def test_round_trip(spark):
    rows = [*((i, prose(i, 20 + 97 * i % 900)) for i in range(60)), *ODD, (950, "hi <|endoftext|> ho"), (951, prose(9, 6000))]
    library = tokenizers.Tokenizer.from_file(default_tokenizer())
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in pack(documents(spark, rows).repartition(3)).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, texts in want.items():
        left = sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in pieces[i])
        for ids in texts:
            at = 0
            while at < len(ids):
                found = next(
                    p for p in left
                    if p[:2] == (len(ids), at) and p[3] == zlib.crc32(np.array(ids[at : at + p[2]], "<u4").tobytes())
                )
                left.remove(found)
                at += found[2]
            assert at == len(ids)
        assert not left
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    used = sum(n for parts in windows.values() for _, n in parts)
    assert len(windows) <= used / 1024 + 3  # one partly filled window for each task


def test_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(300):
        p = Packer(16, 0)
        p.count[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def squares(at, p=p, size=size):
            n = p.count.copy()
            n[at] -= at > 0
            if at + size < 16:
                n[at + size] += 1
            return int((n[1:16] ** 2).sum())

        allowed = [0, *(h for h in range(1, 16 - size + 1) if p.count[h])]
        best = min(map(squares, allowed))
        assert p.level(size) == max(h for h in allowed if squares(h) == best)


def test_both_libraries_agree():
    library, own = tokenizers.Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer())
    for text in ["  a  b \n\n c\t", "<|endoftext|>", "don't 'S   ٣ ½", "日本🙂", "\x1c\x85 x", prose(3, 200), "", "=" * 3000, " 　 a"]:
        assert own(text) == library.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert pack(documents(spark, [])).count() == 0
