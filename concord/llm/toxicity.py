"""Toxicity scores of texts whose words may be disguised: noisy-channel restoration, then a linear score.

A disguised word (digits and signs for letters, letters drawn apart, letters repeated) is a lattice: each sign may stand for
some letters, a separator or a repeated letter may be noise, all at a cost. The cheapest way through the lattice under a
character trigram model, found by Viterbi decoding, is the restored word. The model is counted over the plain
words of all documents.

Scores come from words and beginnings of words of the restored text, with weights fitted to a bounded number of
labelled documents in which both classes weigh the same. A feature counts by the logarithm of the number of distinct words
that have it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.session import cut_lineage

#: Labelled documents of each class that weights are fitted to, features looked at, and documents a feature must have.
SAMPLE, FEATURES, LEAST = 20_000, 5_000, 3
#: Lengths of word beginnings that are features, the share above which a text is predicted toxic, and words remembered.
BEGINNINGS, THRESHOLD, REMEMBERED = (4, 5, 6, 7, 8), 0.7, 400_000

#: What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "§": "s", "¥": "y",
}
SEPARATORS = " .,-_*~'`:;/\\^#%&=\"<>)[]{}?"
#: Costs (natural logarithms) of a sign for a letter, of a separator inside a word, of a repeated letter, of a sign as noise.
SUBSTITUTE, SEPARATE, REPEAT, NOISE = 1.0, 0.7, 0.7, 8.0

EDGE = SEPARATORS + "!|+(\n\t\r"
THRICE = re.compile(r"(.)\1\1", re.S)
TWICE = re.compile(r"(.)\1+", re.S)
#: Letters of the character model; all others are one class.
LATIN = frozenset(chr(c) for c in range(0x250) if chr(c).isalpha() and chr(c).islower())


def letter(c: str) -> str:
    return c if c in LATIN else "?"


class Restorer(dict):
    """Maps a token to the words it may be: itself if plain, else its restoration."""

    def __init__(self, trigrams: dict[str, int]):
        super().__init__()
        pairs: Counter = Counter()
        for gram, n in trigrams.items():
            pairs[gram[:2]] += n
        follow: Counter = Counter()
        singles: Counter = Counter()
        for gram, n in trigrams.items():
            follow[gram[1:]] += n
            singles[gram[2]] += n
        middles: Counter = Counter()
        for gram, n in follow.items():
            middles[gram[0]] += n
        self.trigrams, self.pairs, self.follow, self.middles, self.singles = trigrams, pairs, follow, middles, singles
        self.all, self.known = sum(singles.values()), {}

    def cost(self, before: str, c: str) -> float:
        """Negative log probability of a letter after two others, interpolated with shorter contexts."""
        gram = before + c
        found = self.known.get(gram)
        if found is None:
            one = (self.singles[c] + 0.1) / (self.all + 10)
            two = (self.follow[gram[1:]] + 5 * one) / (self.middles[before[1]] + 5)
            three = (self.trigrams.get(gram, 0) + 5 * two) / (self.pairs[before] + 5)
            found = self.known[gram] = -math.log(three)
        return found

    def decode(self, signs: str) -> str:
        """Cheapest word through the lattice of a run of signs; empty if it is nothing but noise."""
        ways: dict[tuple[str, str], tuple[float, tuple | None]] = {("^^", ""): (0.0, None)}
        for sign in signs:
            ahead: dict[tuple[str, str], tuple[float, tuple | None]] = {}

            def offer(state, cost, chain, ahead=ahead):
                if state not in ahead or cost < ahead[state][0]:
                    ahead[state] = cost, chain

            letters = [(sign, 0.0)] if sign.isalpha() else [(c, SUBSTITUTE) for c in SIGNS.get(sign, "")]
            for (before, last), (cost, chain) in ways.items():
                for c, price in letters:
                    offer((before[1] + letter(c), c), cost + price + self.cost(before, letter(c)), (chain, c))
                    if c == last:
                        offer((before, last), cost + REPEAT, chain)
                if sign in SEPARATORS or sign.isspace():
                    offer((before, last), cost + SEPARATE, chain)
                elif not sign.isalpha():
                    offer((before, last), cost + NOISE, chain)
            ways = ahead
        _, chain = min((cost + self.cost(before, "$"), i, chain) for i, ((before, _), (cost, chain)) in enumerate(ways.items()))[1:]
        out = []
        while chain:
            chain, c = chain
            out.append(c)
        return "".join(reversed(out))

    def __missing__(self, token: str) -> tuple[str, ...]:
        core = token.strip(EDGE)
        if core.isalpha() and not THRICE.search(core):
            # signs at the end may stand for letters of the word or be no part of it
            found = (core,)
            if token[-1] in SIGNS or token[0] in SIGNS:
                found = (core, self.decode(token.strip(SEPARATORS)))
        elif any(c.isalpha() for c in token):
            whole = self.decode(token.strip(SEPARATORS))
            parts = [p for p in re.split(r"[^\w]+", core) if p.isalpha()]
            found = (whole, *parts)
        else:
            found = ()
        found = tuple(w for w in found if w)
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = found
        return found

    def drawn_apart(self, tokens: list[str]) -> Iterator[str]:
        """Words whose letters stand apart: three or more tokens of one sign in a row."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        short = np.flatnonzero(lengths == 1)
        if len(short) >= 3:
            breaks = np.flatnonzero(np.diff(short) > 1)
            for a, b in zip(np.r_[short[0], short[breaks + 1]], np.r_[short[breaks], short[-1]], strict=True):
                if b - a >= 2 and (word := self.decode(" ".join(tokens[a : b + 1]))):
                    yield word

    def words(self, text: str) -> set[str]:
        """Distinct words of the restored text, in lower case."""
        tokens = text.lower().split()
        return set().union(*map(self.__getitem__, set(tokens)), self.drawn_apart(tokens))


class Present(dict):
    """Maps a token to the numbers of the features that its words have."""

    def __init__(self, restore: Restorer, number: dict[str, int]):
        super().__init__()
        self.restore, self.number = restore, number
        # letters written twice or once are one word here
        self.single = {TWICE.sub(r"\1", name): i for name, i in number.items() if name[0] == "="}

    def of(self, word: str) -> set[int]:
        found = {self.number[b] for b in beginnings(word) if b in self.number}
        whole = self.single.get(TWICE.sub(r"\1", "=" + word))
        return found if whole is None else found | {whole}

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = tuple(set().union(*map(self.of, self.restore[token])))
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = found
        return found

    def in_text(self, text: str) -> Counter:
        """How many distinct tokens have each feature."""
        tokens = text.lower().split()
        found: Counter = Counter()
        for numbers in map(self.__getitem__, set(tokens)):
            if numbers:
                found.update(numbers)
        for word in self.restore.drawn_apart(tokens):
            found.update(self.of(word))
        return found


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) > n]


def count_trigrams(texts: DataFrame) -> DataFrame:
    """(gram, n) of the plain words of all texts (body): two marks before and one behind each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for value in batch.column(0):
                words.update(value.as_py().lower().split())
            for token, n in words.items():
                word = token.strip(EDGE)
                if word.isalpha() and not THRICE.search(word):
                    signs = "^^" + "".join(map(letter, word)) + "$"
                    for i in range(len(signs) - 2):
                        grams[signs[i : i + 3]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])

    return texts.select("body").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def restorer_model(texts: DataFrame) -> dict[str, int]:
    """The letters of the model are a fixed set, so the table has a fixed bound, whatever the texts hold."""
    found = count_trigrams(texts).toArrow()
    return dict(zip(found["gram"].to_pylist(), found["n"].to_pylist(), strict=True))


def size(count):
    return np.log2(1.0 + np.asarray(count))


def fit_weights(
    lengths: np.ndarray, flat: np.ndarray, counts: np.ndarray, labels: np.ndarray, n: int, rounds: int = 800, sparse: float = 4e-5
) -> tuple[np.ndarray, float]:
    """Logistic weights of n features, drawn to zero, and a bias; both classes weigh the same. Rows have `lengths` features each,
    whose numbers and counts stand one behind the other."""
    rows, at, value = lengths, np.repeat(np.arange(len(lengths)), lengths), size(counts)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(rows)
    w, bias = np.zeros(n), 0.0
    rate = 4.0 * len(rows) / ((np.bincount(flat, value * value * weight[at] * len(rows), n) + 1) * max(1.0, len(flat) / len(rows)))
    momentum = w.copy()
    for t in range(rounds):
        guess = 1 / (1 + np.exp(-np.clip(np.bincount(at, momentum[flat] * value, len(rows)) + bias, -30, 30)))
        error = (guess - labels) * weight
        step = momentum - rate * np.bincount(flat, error[at] * value, n)
        fresh = np.sign(step) * np.maximum(0, np.abs(step) - sparse * np.minimum(rate, 50.0))
        momentum, w = fresh + t / (t + 3) * (fresh - w), fresh
        bias -= 2.0 * error.sum()
    return w, bias


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> DataFrame:
    """Per row: id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on).

    Weights are fitted to at most `sample` labelled rows of each class, those with the least hashes of ids that are not held
    out. Null and empty texts have the score of a text without any feature. A null id counts as not held out and is never
    fitted to; repeated rows get equal results; without labels of both classes all scores are the share of toxic labels (0
    without labels). An empty table gives no row.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    model = spark.sparkContext.broadcast(restorer_model(rows))
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    parts = [usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = cut_lineage(parts[0].union(parts[1]), "fitted-rows")  # at most twice the sample: safe to broadcast
    fitted = cut_lineage(rows.join(F.broadcast(chosen), "id").select("body", "y"), "fitted-texts")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.value)
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for value, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = restore.words(value.as_py())
                counts[y].update(f"={w}" for w in words)
                counts[y].update({b for w in words for b in beginnings(w)})
        for y, found in enumerate(counts):
            names = pa.array(list(found), pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array([y] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["name", "y", "n"])

    tallies = fitted.mapInArrow(tally, "name string, y int, n long")
    tallies = tallies.groupBy("name").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    sizes = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    odds = F.log((F.col("n1") + 0.5) / (toxic + 1)) - F.log((F.col("n0") + 0.5) / (clean + 1))
    picked = tallies.where(F.col("n1") >= LEAST).withColumn("odds", odds).where("odds > 1")
    picked = picked.orderBy((F.col("n1") * F.col("odds")).desc(), "name").limit(FEATURES).select("name")
    number = {r["name"]: i for i, r in enumerate(picked.collect())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Present(Restorer(model.value), number)
        for batch in batches:
            found = [present.in_text(t.as_py()) for t in batch.column(0)]
            lists = [pa.array([list(part) for part in c], pa.list_(pa.int32())) for c in (found, [f.values() for f in found])]
            yield pa.RecordBatch.from_arrays([*lists, batch.column(1)], ["found", "counts", "y"])

    seen = fitted.mapInArrow(read, "found array<int>, counts array<int>, y int").toArrow()
    y, found = seen["y"].to_numpy().astype(float), seen["found"].combine_chunks()
    if clean and toxic:
        weights, bias = fit_weights(
            np.asarray(found.value_lengths()), np.asarray(found.flatten()), np.asarray(seen["counts"].combine_chunks().flatten()), y, len(number)
        )
    else:
        share = min(max(toxic / max(1, clean + toxic), 1e-9), 1 - 1e-9)
        weights, bias = np.zeros(len(number)), math.log(share / (1 - share))
    kept = {name: float(weights[i]) for name, i in number.items() if weights[i]}
    order = {name: i for i, name in enumerate(kept)}
    values = np.array(list(kept.values()) or [0.0])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Present(Restorer(model.value), order)
        for batch in batches:
            totals = []
            for value in batch.column(1):
                found = present.in_text(value.as_py())
                totals.append(bias + values[list(found)] @ size(list(found.values())) if found else bias)
            score = 1 / (1 + np.exp(-np.clip(np.array(totals, float), -500, 500)))
            predicted = (score >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(predicted)], ["id", "score", "predicted"])

    out = rows.mapInArrow(judge, "id long, score double, predicted int")
    out = out.withColumnRenamed("id", id_col)
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", "predicted")
