from concord.llm.licenses import PHRASES, TEMPLATES, Automaton, license_scan, words_of
from tests.llm.helpers import ODD, documents, prose


def plain_places(text):
    words = words_of((text or "").encode())
    out = []
    for phrase, label in PHRASES.items():
        p = phrase.encode().split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return words, out


def test_phrases_like_a_plain_search(spark):
    rows = [
        (1, "The MIT license, mit-LICENSE! and mit. License"), (2, "GNU General Public License general public license"), (3, "mit mit license apache licenses"),
        (4, "license mit apache general public"), (5, "mitlicense éMIT license mit license"), (6, prose(3, 400) + " Apache License " + prose(4, 400)), *ODD,
    ]
    out = license_scan(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    for r, (i, text) in zip(out, rows, strict=True):
        words, places = plain_places(text)
        starts = [p for p, _ in places]
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(words), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_templates_are_found_with_changes(spark):
    lines = TEMPLATES["bsd"].split()
    lines[10] = "source-and-so-on"
    del lines[20]
    text = "int main() { } " + " ".join(lines) + " #include <stdio.h>"
    rows = [(1, text), (2, " ".join(TEMPLATES["isc"].split()[:10])), (3, prose(5, 500)), (4, TEMPLATES["cc"].upper())]
    out = {r.doc_id: r for r in license_scan(documents(spark, rows)).collect()}
    assert out[1].labels == "bsd" and 0.7 < out[1].score < 1 and out[1].n_base == 0
    span = out[1].spans[0]
    assert span.start == 2 and 40 < span.stop - span.start < 60
    assert out[2].labels == "" and out[3].score == 0 and out[4].labels == "cc"


def test_each_place_of_a_notice_has_a_span(spark):
    isc = [w.decode() for w in words_of(TEMPLATES["isc"].encode())]
    n = len(isc)
    cut = [*isc[:20], "changed", *isc[21:]]
    rows = [
        (1, " ".join([*isc, *prose(1, 100).split(), *cut])), (2, " ".join([*isc, *isc, *isc])), (3, " ".join([*cut, *cut])),
        (4, " ".join(isc[: n // 2 - 5])), (5, " ".join([*isc, "x", *isc[: n // 2 - 5], "y", *isc])),
    ]
    out = {r.doc_id: r for r in license_scan(documents(spark, rows)).collect()}
    places = {i: [(s.start, s.stop) for s in r.spans if s.label == "isc"] for i, r in out.items()}
    middle = n // 2 - 3
    assert places == {1: [(0, n), (n + 100, 2 * n + 100)], 2: [(0, n), (n, 2 * n), (2 * n, 3 * n)], 3: [(0, n), (n, 2 * n)], 4: [], 5: [(0, n), (n + middle, 2 * n + middle)]}
    assert [out[i].score for i in (1, 2, 5)] == [1, 1, 1] and 0.9 < out[3].score < 1 and out[3].labels == "isc"


def test_many_notices_in_one_text():
    scanner = Automaton(list(TEMPLATES.items()), {})
    words = words_of((TEMPLATES["isc"] * 300).encode())
    spans = scanner.chains(scanner.scan(words)[1])
    assert sum(label == "isc" for label, *_ in spans) == 300


def test_matching_statistics():
    """At each word the automaton knows the longest run ending there that a template holds."""
    import random

    rng = random.Random(1)
    for _ in range(50):
        templates = [("t", " ".join(rng.choice("abc") for _ in range(rng.randint(3, 12)))) for _ in range(3)]
        a = Automaton(templates, {})
        known = {tuple(w[i:j]) for _, t in templates for w in [t.split()] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        text = [rng.choice("abc") for _ in range(30)]
        _, matches = a.scan([w.encode() for w in text])
        longest = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in known), default=0) for i in range(30)]
        maximal = [(i, n) for i, n in enumerate(longest) if n >= 3 and (i == 29 or longest[i + 1] <= n)]
        assert [(at, n) for at, n, _ in matches] == maximal
        for at, n, state in matches:
            for t, end in a.ends[state]:
                assert templates[t][1].split()[end - n + 1 : end + 1] == text[at - n + 1 : at + 1]


def test_empty_table(spark):
    assert license_scan(documents(spark, [])).count() == 0
