import random

import numpy as np
import pytest

from concord.llm import html_text
from concord.llm.html_text import Features, Labeller, blocks, by_names, made_page, main_text, trained

WORDS = "river stone about mountain light the of and water green".split()


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>{extra}<article>{body}</article><footer>&copy; foot</footer></body></html>'


def test_blocks():
    found = blocks(page('<h1>A&amp;B &lt;x&gt;</h1><p>one <b>two\n  three<br>four<p class="a-b">&eacute;&#x41;&nbsp;z<!-- <p>no</p> --></p><ul><li>l1<li>l2</ul>tail', '<nav><a href="x>y">menu</a></nav>'))
    texts = [b.text for b in found]
    assert texts == ["T", "menu", "A&B <x>", "one two three four", "éA z", "l1", "l2", "tail", "© foot"]
    assert found[4].path[-1] == ("p", ("a", "b")) and found[1].linked == 4
    assert [by_names(b.path) for b in found] == [False, False, True, True, True, True, True, True, False]
    assert blocks("") == [] and blocks("< > <<p>>") and [b.text for b in blocks("plain & text")] == ["plain & text"]
    assert blocks("<p>" * 5000 + "x")[0].text == "x"


@pytest.mark.parametrize("html, want", [
    ('<p>one <svg class="i"/> two</p><p>three</p><svg><path d="M0"/></svg>', ["one two", "three"]),
    ('<p>one <svg viewBox="0"><g><path d="M0"/><text>label</text></g></svg> two</p><p>three', ["one label two", "three"]),
    ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then <math/> so</p><p>end", ["if x=1 then so", "end"]),
    ('<object data="a"/><p>one</p><iframe src="a"/><p>two</p><template/><noscript/><p>three', ["one", "two", "three"]),
    ("<p>one <object data=a>two</object> three <noscript>four</noscript></p>", ["one two three four"]),
    ("<object-view><p>one</p></object-view><template-card>two</template-card><script-x>three</script-x><style-y>four", ["one", "two", "three", "four"]),
    ("<p>one<svg><p>two<div>three</div>", ["one", "two", "three"]),
    ('<script src="a.js"/><p>one</p><style/><p>two<script async src=http://a/>no</script><style >no</style><p>three<script>no', ["one", "two", "three"]),
])
def test_only_script_and_style_are_swallowed(html, want):
    assert [b.text for b in blocks(html)] == want


def test_gradients():
    """The way back through time against differences."""
    html_text_hidden = html_text.HIDDEN
    model = Labeller(3)
    rng = np.random.default_rng(1)
    pages = [rng.normal(size=(n, html_text.PATH + html_text.WORD + html_text.SHAPE)).astype(np.float32) * 0.3 for n in (3, 5)]

    def loss():
        return -sum(float(np.log(c).sum()) for c in model.label(pages))

    chance, (x, reverse, turn, column, both, memo_a, memo_b, lengths) = model.forward(pages, True)
    error = chance - 1
    for j, n in enumerate(lengths):
        error[n:, j] = 0
    d = error[:, :, None] * model.w["out"]
    grads = model.back(x, "f", memo_a, d[:, :, :html_text_hidden]) | model.back(reverse, "b", memo_b, d[turn, column][:, :, html_text_hidden:])
    for name in ("hf", "hb", "bf", "xb"):
        at = tuple(0 if i else 2 for i in range(model.w[name].ndim))
        old = model.w[name][at]
        values = []
        for step in (1e-2, -1e-2):
            model.w[name][at] = old + step
            values.append(loss())
        model.w[name][at] = old
        assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-2, rel=0.05, abs=2e-3)


def test_unseen_layouts():
    model, features, rng = trained([page("<p>some words</p>")] * 5), Features(), random.Random(77)
    right = total = 0
    for _ in range(60):
        html, main = made_page(rng, WORDS)
        found = blocks(html)
        chance = model.label([features.page(found)])[0]
        want = [by_names(b.path) is not False and b.text in {" ".join(m.split()) for m in main} for b in found]
        right += int(((chance >= 0.5) == want).sum())
        total += len(found)
    assert right / total > 0.98


def test_pages(spark):
    rng = random.Random(5)
    body = "".join(f"<p>{' '.join(rng.choice(WORDS) for _ in range(30))}.</p>" for _ in range(4))
    rows = [(i, f"http://x/{i}", page(body, '<nav><ul><li><a href="/">home</a></li></ul></nav><div class="ad">Buy water now.</div>')) for i in range(30)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<nav>menu</nav>"), (None, "u", page("<p>x</p>")), (103, "u", page("<p>" + "long " * 40_000 + "</p>")), rows[0]]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = {r.page_id: r for r in main_text(df).collect()}
    want = "\n".join(b.text for b in blocks(page(body)) if any(t == "article" for t, _ in b.path))
    assert all(out[i].text == want and out[i].n_chars == len(want) and out[i].url == f"http://x/{i}" for i in range(30))
    assert out[100].text == out[101].text == out[102].text == "" and out[100].url is None and out[102].n_chars == 0
    assert out[103].n_chars == 40_000 * 5 - 1
    assert main_text(df.limit(0)).count() == 0
    assert main_text(df).count() == len(rows)


def test_unclosed_tags_take_time_in_line_with_the_page():
    import time

    from concord.llm.html_text import blocks

    for pattern in ("<a b='c' ", "<a ", '<p x="', "<!", "<p class='x'", '<a "', "</a "):
        for end in ("", ">", "'", '"'):
            started = time.perf_counter()
            blocks(pattern * (1_000_000 // len(pattern)) + end)
            assert time.perf_counter() - started < 5
    # a tag ends at the first > outside quotes, one without an end is text
    assert [b.text for b in blocks("<p>one <b two</p> <i x='>' y>three</i> < four <a 'five")] == ["one three < four <a 'five"]
