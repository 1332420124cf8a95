import pytest

from concord.llm.tokens import counter, default_tokenizer, prefix_counts, token_counts, within_budget
from tests.llm.helpers import ODD, documents, prose

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "Don't stop, I'll say 're and 'RE and we've!", "hi!<|endoftext|>!!<|startoftext|><|ENDOFTEXT|> <|x|>", "ΑΣ ΟΔΟΣ İstanbul ½ ② ٣",
    "a\x1cb\x85c　d​e", "__init__ x_y 12345 $$$ %%%", "été été ẛ̣", "日本語テキスト🙂🙂", "aaaa" * 200, prose(1, 300),
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_tokenizer())


def test_counts_are_the_librarys(spark, library):
    rows = [*enumerate(TEXTS), *ODD]
    out = token_counts(documents(spark, rows), budget=40).collect()
    want = {(i, t): len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert len(out) == len(rows)
    for r, (i, t) in zip(out, rows, strict=True):
        assert (r.doc_id, r.n_bytes, r.n_tokens) == (i, len((t or "").encode()), want[i, t])
        assert r.over_limit == (r.n_tokens > 40)


def test_every_prefix(library):
    c = counter(default_tokenizer())
    for text in [*TEXTS[:4], *(t[:120] for t in TEXTS[4:])]:
        if "<|E" in text:
            continue  # lower-casing would make a special string of it
        plain = "".join(p if p in c.special else p for p in [text])
        if not plain.isascii():
            continue  # places are those of the normalised text, checked below
        low = "".join(t if t in c.special else t.lower() for t in c.cut.split(plain)) if "<|" not in plain else plain
        want = [len(library.encode(low[:k], add_special_tokens=False).ids) for k in range(len(low) + 1)]
        assert c.at_every_prefix(text) == want
    low = "été straße ñandú"
    assert c.at_every_prefix("ÉTÉ Straße Ñandú") == [len(library.encode(low[:k], add_special_tokens=False).ids) for k in range(17)]


def test_budget_needs_no_encoding(spark, library):
    docs = documents(spark, [(1, prose(2, 80)), (2, "short"), (3, None)])
    stored = prefix_counts(docs)
    fits = {r.doc_id: r.fit_chars for r in within_budget(stored, 30).collect()}
    for r in stored.collect():
        assert r.counts[fits[r.doc_id]] <= 30
        assert fits[r.doc_id] == max(k for k, n in enumerate(r.counts) if n <= 30)
    cut = {r.doc_id: r.fit_chars for r in token_counts(docs, budget=30).collect()}
    text = prose(2, 80)
    assert len(library.encode(text[: cut[1]], add_special_tokens=False).ids) <= 30 and cut[2] == 5 and cut[3] == 0


def test_empty_table(spark):
    assert token_counts(documents(spark, [])).count() == 0
