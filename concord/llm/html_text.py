"""Main text of web pages: a bidirectional LSTM over the blocks of a page, in numpy.

A page is cut into leaf blocks in page order. Each block is read as its tag path (hashed tags, classes and ids), its hashed
words and a few shape figures; the network runs over all blocks of a page in both directions and labels every block as
main text or not, so a label can depend on the whole page.

The network is trained here, on a bounded sample of the given pages labelled by what their tags and class names say, and
on layouts made from the sample's words with names and orders that the sample may lack.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages read for training, layouts made for it, passes over them, and hidden units of each direction.
SAMPLE, MADE, EPOCHS, HIDDEN = 200, 200, 10, 16
PATH, WORD, SHAPE = 256, 32, 8
#: Blocks of one step of the network, at most (one page may have more).
STEP_BLOCKS = 20_000

#: Attributes up to the end of a self-closed tag; a slash at the end of a value without quotes belongs to the value.
CLOSED = r"(?:\s+[^\s\"'=<>/]++(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]++))?)*+\s*+/>"
HIDDEN_TEXT = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])(?!{CLOSED}).*?(?:</\1\s*>|\Z)", re.I | re.S)
HEAD = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)(?:(/?)>|(?=\s))", re.I)
OUTSIDE = re.compile(r"[^'\"<>]*+")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
#: Tags that do not end a block; all others do.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i iframe img input ins kbd label mark math meta noscript object "
    "q rp rt ruby s samp script small source span strike strong style sub sup svg time track tt u var wbr".split()
)
#: All tags inside drawings and formulas are inline, up to their end or the first tag that only a page can have.
FOREIGN = frozenset(["svg", "math"])
PAGE_TAGS = frozenset(
    "article aside blockquote body center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre "
    "section table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A new tag of the first kind closes open ones of the second at the end of the path.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head", "title"},
}

#: Tags and name parts of what is not main text, and of what is.
ASIDE_TAGS = frozenset("nav header footer aside form button select option textarea head title menu dialog fieldset".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navigation navbar menu breadcrumb breadcrumbs header "
    "masthead topbar footer bottom sidebar aside widget related share social cookie cookies consent notice alert popup modal "
    "newsletter subscribe signup login search form comment comments reply replies respond discussion disqus pagination pager "
    "toolbar copyright legal".split()
)
MAIN_TAGS, MAIN_NAMES = frozenset(["article", "main"]), frozenset("article content main post entry story body text".split())


class Block:
    __slots__ = ("path", "linked", "text")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def markup(html: str) -> Iterator[tuple[int, int, str, str | None, str]]:
    """Comments, scripts, styles, tags and declarations in page order: start, end, slash of an end tag, tag (None for what is no
    tag), attributes. A tag ends at the first `>` outside quotes; what never ends is text.

    If a scan for a tag's end finds none, it finds none from any `<` that it passed outside quotes either, so those are not
    scanned again and a page of unclosed tags takes time in line with its length.
    """
    at, last, endless = 0, html.rfind(">"), set()
    quotes = {q: html.rfind(q) for q in "\"'"}

    def end_of(pos: int) -> int:
        passed = []
        while True:
            pos = OUTSIDE.match(html, pos).end()
            if pos > last or pos in endless:
                break
            sign = html[pos]
            if sign == ">":
                return pos + 1
            if sign == "<":
                passed.append(pos)
            elif pos >= quotes[sign]:
                break
            else:
                pos = html.index(sign, pos + 1)
            pos += 1
        endless.update(passed)
        return 0

    while (at := html.find("<", at)) >= 0:
        end, slash, tag, rest = 0, "", None, ""
        if hidden := HIDDEN_TEXT.match(html, at):
            end = hidden.end()
        elif at < last:
            head = HEAD.match(html, at)
            if head and head[3] is not None:
                end, slash, tag, rest = head.end(), head[1], head[2], head[3]
            elif head and at not in endless and (end := end_of(head.end())):
                slash, tag, rest = head[1], head[2], html[head.end() : end - 1]
            elif html[at + 1] in "!?/":
                end = html.find(">", at + 2) + 1
        if end:
            yield at, end, slash, tag, rest
        at = end or at + 1


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order: path of (tag, name parts), text with character references decoded and white space joined."""
    out: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    texts: list[str] = []
    links = linked = at = 0
    foreign = False

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(tuple(path), text, linked))
            texts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            texts.append(text)
            if links:
                linked += len(text)

    for start, end, slash, tag, rest in markup(html):
        say(html[at:start])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        closed = not slash and rest.endswith("/")
        if tag in FOREIGN and not closed:
            foreign = not slash
        foreign = foreign and tag not in PAGE_TAGS
        if foreign and tag not in INLINE or closed and tag == "template":
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if slash else 1
            elif tag == "br":
                texts.append(" ")
            continue
        flush()
        if slash:
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] == tag:
                    del path[i:]
                    links = 0
                    break
            continue
        closes = CLOSES.get(tag, {"p"})
        while path and path[-1][0] in closes:
            path.pop()
        if tag not in VOID:
            names = NAMES.findall(rest) if "=" in rest else ()
            path.append((tag, tuple(p for n in names for p in PART.findall("".join(n).lower()))))
    say(html[at:])
    flush()
    return out


def by_names(path: tuple) -> bool | None:
    """What tags and names say of a block: main text, something else, or (None) nothing."""
    for tag, names in path:
        if tag in ASIDE_TAGS or ASIDE_NAMES.intersection(names):
            return False
    if any(tag in MAIN_TAGS or MAIN_NAMES.intersection(names) for tag, names in path):
        return True
    return None


def bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode()) % n


class Features:
    """Block vectors; those of paths and words are remembered."""

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            found = np.zeros(PATH, np.float32)
            for tag, names in path:
                found[bucket(tag, PATH)] = 1
                for name in names:
                    found[bucket(f"#{name}", PATH)] = 1
            if path:
                found[bucket(f"^{path[-1][0]}", PATH)] = 1
            if len(self.paths) > 20_000:
                self.paths.clear()
            self.paths[path] = found
        return found

    def page(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), PATH + WORD + SHAPE), np.float32)
        known = self.words
        if len(known) > 500_000:
            known.clear()
        for i, b in enumerate(page):
            out[i, :PATH] = self.path(b.path)
            words = b.text.split()
            for w in words:
                if w not in known:
                    known[w] = bucket(w, WORD)
            counts = np.bincount([known[w] for w in words], minlength=WORD)
            out[i, PATH : PATH + WORD] = counts / max(1.0, np.sqrt((counts * counts).sum()))
            n = len(b.text)
            out[i, -SHAPE:] = (
                np.log1p(n) / 8, min(1.0, b.linked / n), b.text.count(".") / (len(words) + 1), len(words) / (len(words) + 20),
                i / len(page), 1 / (i + 1), 1 / (len(page) - i), 1.0,
            )
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, h = PATH + WORD + SHAPE, HIDDEN
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, 0.1, (d, 4 * h))
            self.w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)) * 0.5
            self.w[f"b{side}"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]
        self.w["out"] = rng.normal(0, 0.1, 2 * h)
        self.w["bias"] = np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @staticmethod
    def turned(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Index that reverses each sequence and leaves its padding at the end."""
        t = np.arange(steps)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def run(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: steps, pages, inputs. States of every step, and what the way back needs."""
        h = HIDDEN
        z_in = x @ self.w[f"x{side}"] + self.w[f"b{side}"]
        state = cell = np.zeros((x.shape[1], h), np.float32)
        out, memo = np.empty((*x.shape[:2], h), np.float32), []
        for t in range(x.shape[0]):
            z = z_in[t] + state @ self.w[f"h{side}"]
            gates = sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            bent = np.tanh(cell)
            if keep:
                memo.append((i, f, o, g, before, bent, state))
            state = o * bent
            out[t] = state
        return out, memo

    def back(self, x: np.ndarray, side: str, memo: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        dz_all = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
        d_state = d_cell = np.zeros((x.shape[1], HIDDEN), np.float32)
        d_h = np.zeros_like(self.w[f"h{side}"])
        for t in range(x.shape[0] - 1, -1, -1):
            i, f, o, g, before, bent, state = memo[t]
            d = d_out[t] + d_state
            d_cell = d_cell + d * o * (1 - bent * bent)
            dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d * bent * o * (1 - o), d_cell * i * (1 - g * g)], 1)
            d_cell = d_cell * f
            d_h += state.T @ dz
            d_state = dz @ self.w[f"h{side}"].T
            dz_all[t] = dz
        flat_x, flat_dz = x.reshape(-1, x.shape[2]), dz_all.reshape(-1, 4 * HIDDEN)
        return {f"x{side}": flat_x.T @ flat_dz, f"h{side}": d_h, f"b{side}": flat_dz.sum(0)}

    def forward(self, pages: list[np.ndarray], keep: bool = False):
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((lengths.max(), len(pages), pages[0].shape[1]), np.float32)
        for i, p in enumerate(pages):
            x[: len(p), i] = p
        turn, column = self.turned(lengths, len(x)), np.arange(len(pages))
        reverse = x[turn, column]
        ahead, memo_a = self.run(x, "f", keep)
        behind, memo_b = self.run(reverse, "b", keep)
        both = np.concatenate([ahead, behind[turn, column]], 2)
        chance = sigmoid(both @ self.w["out"] + self.w["bias"])
        return chance, (x, reverse, turn, column, both, memo_a, memo_b, lengths)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        chance, _ = self.forward(pages)
        return [chance[: len(p), i] for i, p in enumerate(pages)]

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, seed: int = 1) -> None:
        rng, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for epoch in range(epochs):
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i]) // 8)
            groups = [order[a : a + 16] for a in range(0, len(order), 16)]
            for group in (groups[i] for i in rng.permutation(len(groups))):
                chance, (x, reverse, turn, column, both, memo_a, memo_b, lengths) = self.forward([pages[i] for i in group], True)
                target, weight = np.zeros_like(chance), np.zeros_like(chance)
                for j, i in enumerate(group):
                    target[: lengths[j], j] = labels[i]
                    weight[: lengths[j], j] = 1 / len(group) / np.sqrt(lengths[j])
                error = ((chance - target) * weight).astype(np.float32)
                grads = {"out": np.einsum("tp,tph->h", error, both), "bias": error.sum(keepdims=True).reshape(1)}
                d_both = error[:, :, None] * self.w["out"]
                grads |= self.back(x, "f", memo_a, d_both[:, :, :HIDDEN])
                grads |= self.back(reverse, "b", memo_b, d_both[turn, column][:, :, HIDDEN:])
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                rate = 0.02 * (1 - 0.7 * epoch / epochs)
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)


def made_page(rng: random.Random, words: list[str]) -> tuple[str, set[str]]:
    """A page of a random layout, and the texts of its main blocks."""
    main: set[str] = set()

    def say(low: int, high: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))

    def pick(*names: str) -> str:
        return rng.choice(names)

    def named(tag: str, name: str, inner: str) -> str:
        return f'<{tag} {pick("class", "id")}="{name}">{inner}</{tag}>'

    def sentence(low: int, high: int) -> str:
        return say(low, high).capitalize() + "."

    def menu(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{say(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def paragraphs(n: int) -> str:
        return "".join(f"<p>{sentence(4, 60)}</p>" for _ in range(n))

    before = ["<nav>" + menu(rng.randint(3, 8)) + "</nav>", f"<header><h1>{say(1, 4)}</h1><p>{sentence(2, 8)}</p></header>",
              named("div", pick("menu", "navbar", "nav-bar", "breadcrumbs"), menu(rng.randint(2, 6))), named("div", pick("header", "top-bar", "masthead", "banner"), say(2, 8)),
              named("div", pick("cookie-notice", "notice", "consent", "alert", "popup"), f"<p>{sentence(5, 20)}</p><button>{say(1, 2)}</button>"),
              named(pick("div", "section"), pick("ad", "ads", "advert", "sponsored", "promo", "ad-banner"), sentence(4, 25))]
    beside = [f"<aside>{pick(menu(4), paragraphs(2))}</aside>", named("div", pick("sidebar", "related", "widget", "share", "social"), pick(menu(4), paragraphs(2))),
              f'<form><label>{say(1, 3)}</label><p>{sentence(3, 10)}</p><button>{say(1, 2)}</button></form>', named("div", pick("newsletter", "subscribe", "search-form"), paragraphs(1)),
              named("div", pick("ad", "advert", "promo"), paragraphs(1))]
    after = [f"<footer><p>{sentence(3, 15)}</p>{pick('', menu(3))}</footer>", named("div", pick("footer", "copyright", "legal", "bottom"), sentence(3, 12)),
             named(pick("section", "div", "ol"), pick("comments", "comment-list", "replies", "discussion"), f"<h2>{say(1, 3)}</h2>" + "".join(named("div", pick("comment", "reply"), paragraphs(rng.randint(1, 2))) for _ in range(rng.randint(1, 5))))]

    def some(parts: list[str], most: int) -> str:
        return "".join(rng.sample(parts, rng.randint(0, most)))

    body = []
    for _ in range(rng.randint(1, 12)):
        text = sentence(*rng.choice([(1, 4), (5, 40), (30, 120)]))
        main.add(text)
        tag = rng.choice(["p"] * 8 + ["h2", "li", "blockquote", "div"])
        body.append(f"<{tag}>{text}</{tag}>")
        if rng.random() < 0.08:
            body.append(rng.choice(beside))
    title = say(1, 8)
    main.add(title)
    body.insert(0, f"<h1>{title}</h1>")
    wrap = rng.choice(["article"] * 4 + ["main", "div"])
    inner = "".join(body)
    comments = rng.random() < 0.2
    if comments:  # reader comments may also stand inside the article
        inner += after[2]
    article = f"<{wrap}>{inner}</{wrap}>" if wrap != "div" else named("div", pick("content", "post", "entry", "article-body", "story", "main-content"), inner)
    page = some(before, 4) + article + some(beside, 2) + some(after[: 2 if comments else 3], 2)
    return f"<html><head><title>{title} - {say(1, 2)}</title></head><body>{page}</body></html>", main


def trained(pages: list[str], made: int = MADE, epochs: int = EPOCHS, seed: int = 1) -> Labeller:
    """A labeller fitted to the pages by what their tags say, and to made layouts with words of the pages."""
    rng, features = random.Random(seed), Features()
    inputs, labels = [], []
    words = "about and are as be for from have in is it more new no of on or page read that the this to was we with you".split()
    for html in pages:
        found = blocks(html)
        if found:
            said = [by_names(b.path) for b in found]
            # on a page without a marked main part, text outside all marked parts is main
            marked = True in said
            inputs.append(features.page(found))
            labels.append(np.array([s is True or (s is None and not marked) for s in said], np.float32))
            words.extend(w for b in found for w in b.text.split()[:200] if len(words) < 20_000)
    for _ in range(made):
        html, main = made_page(rng, words)
        found = blocks(html)
        inside = [by_names(b.path) is not False and b.text in {" ".join(t.split()) for t in main} for b in found]
        inputs.append(features.page(found))
        labels.append(np.array(inside, np.float32))
    model = Labeller(seed)
    model.fit(inputs, labels, epochs, seed)
    return model


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """The id, url (where there is one) and main text of each page, blocks joined by line ends, and its length n_chars.

    A null or empty page has an empty text, as has one without main blocks. Training reads the `sample` pages with the least
    hashes of id and text, a bounded number at any size; an empty table trains on made layouts and gives no row. Repeated
    rows give repeated rows. Columns other than id, url and html are not read.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    keyed = df.select(html.alias("html"), F.xxhash64(F.col(id_col), html).alias("h"))
    chosen = keyed.orderBy("h").limit(sample).toArrow()["html"].to_pylist()
    model = trained(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            pages = [blocks(h.as_py()) for h in batch.column("html")]
            texts = [""] * len(pages)
            order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
            at = 0
            while at < len(order):
                stop = at + 1
                while stop < len(order) and (stop - at + 1) * len(pages[order[stop]]) <= STEP_BLOCKS:
                    stop += 1
                group = order[at:stop]
                for i, chance in zip(group, model.label([features.page(pages[i]) for i in group]), strict=True):
                    texts[i] = "\n".join(b.text for b, c in zip(pages[i], chance, strict=True) if c >= 0.5)
                at = stop
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "html"]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), lengths], [*(n for n in batch.schema.names if n != "html"), "text", "n_chars"])

    url = F.col("url").cast("string") if "url" in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias(id_col), url.alias("url"), html.alias("html"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars long")
