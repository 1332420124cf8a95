"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Counts of the highest order come from all trusted texts, added up inside each task before they are shuffled. Lower orders
are continuation counts of the next higher one, so all else is made by joins and sums over the count tables, which stay
sharded. A model row holds the probability of an n-gram or the weight of a context. For scoring, the model is cut into ranges
of language and context (the nearest byte first) at measured quantiles: all rows that one byte of text can need lie in one
shard. A shard has a bounded number of rows, however frequent a byte is; the driver reads and broadcasts one at a time. Texts
pass once for each shard, and the sums of log probabilities are added per document.

The perplexity of a text, shrunk towards the language's median for very short texts, is held against a quantile of trusted
texts of the same language that were kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import flat, sized, slices
from concord.session import cut_lineage

ORDER = 5
#: Rows of a broadcast model shard (12 bytes each in a task), and of broadcast lists of trusted ids.
SHARD_ROWS, BROADCAST_ROWS = 4_000_000, 2_000_000
#: Bytes worked on at once, and distinct n-grams that a task holds before it passes them on.
SLICE, HELD = 1 << 20, 2_000_000
#: One of so many trusted documents is kept out of the counts, to set thresholds.
FOLDS = 5
#: Threshold: the median times (quantile / median) to the power REACH, so the quantile itself. Texts count as if they had PRIOR more bytes
#: of median quality.
QUANTILE, REACH, PRIOR = 0.99, 1.0, 60

LANG_SHIFT, ORDER_SHIFT = 40, 60
BYTES = (1 << LANG_SHIFT) - 1


def language(col: str) -> Column:
    """Number of a language below 2^20 (null is a language of its own); two languages may share one, and then a model."""
    return F.crc32(F.coalesce(F.col(col), F.lit("")).cast("binary")) % F.lit(1 << 20)


def grams(data: np.ndarray, ends: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest-order n-gram ending in each byte (language, bytes), zero bytes standing before a text, and the text of each."""
    sizes = np.diff(ends)
    lead = ORDER - 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    padded = np.zeros(len(data) + lead * len(sizes), np.int64)
    places = np.arange(len(data)) + lead * (text + 1)
    padded[places] = data
    keys = langs[text] << LANG_SHIFT
    for back in range(ORDER):
        keys += padded[places - back] << (8 * back)
    return keys, text


def count_grams(texts: DataFrame) -> DataFrame:
    """(key, n) over (lang, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(k)
            k, n = k[order], n[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            return k[first], (np.add.reduceat(n, first) if len(first) else n)

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, SLICE):
            data, ends = flat(batch.column(1))
            waiting.append(np.unique(grams(data, ends, batch.column(0).to_numpy())[0], return_counts=True))
            if sum(len(k) for k, _ in waiting) > HELD:
                keys, counts = joined([(keys, counts), *waiting])
                waiting = []
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = joined([(keys, counts), *waiting])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return texts.select("lang", "body").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def lang_part(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(((1 << 20) - 1) << LANG_SHIFT))


def suffix(key: str, order: int) -> Column:
    """The last `order` bytes of a key, with its language."""
    return lang_part(key).bitwiseOR(F.col(key).bitwiseAND(F.lit((1 << 8 * order) - 1)))


def context(key: str) -> Column:
    return lang_part(key).bitwiseOR(F.shiftright(F.col(key).bitwiseAND(F.lit(BYTES)), 8))


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model tables from (lang, body): n-grams (o, key, value: log probability), contexts (o, key, value: log weight); o is the
    order, and the context of order o has o - 1 bytes."""
    counts = {ORDER: cut_lineage(count_grams(texts), "counts")}
    for order in range(ORDER - 1, 0, -1):
        lower = counts[order + 1].select(suffix("key", order).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        counts[order] = cut_lineage(lower, "counts")
    shapes = None
    for order, table in counts.items():
        tally = [F.sum((F.col("n") == i).cast("double")).alias(f"c{i}") for i in (1, 2, 3, 4)]
        shape = table.groupBy(lang_part("key").alias("lang")).agg(*tally).withColumn("o", F.lit(order))
        shapes = shape if shapes is None else shapes.union(shape)
    y = F.when(F.col("c1") > 0, F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(0.5)

    def discount(i: int) -> Column:
        ratio = F.when(F.col(f"c{i}") > 0, F.col(f"c{i + 1}") / F.col(f"c{i}")).otherwise(F.lit(1.0))
        # a discount stays between nothing and most of the count, also where counts are few
        return F.greatest(F.lit(0.05), F.least(i - (i + 1) * y * ratio, F.lit(i - 0.05))).alias(f"d{i}")

    shapes = cut_lineage(shapes.select("o", "lang", discount(1), discount(2), discount(3)), "discounts")
    probability, weights, lower = None, None, None
    for order in range(1, ORDER + 1):
        here = shapes.where(F.col("o") == order).drop("o")
        table = counts[order].withColumn("lang", lang_part("key")).join(here, "lang").withColumn("ctx", context("key"))
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        table = table.select("key", "ctx", F.col("n").cast("double").alias("n"), off.alias("off"))
        totals = table.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("off").alias("mass"))
        totals = cut_lineage(totals.select("ctx", "total", (F.col("mass") / F.col("total")).alias("gamma")), "contexts")
        rows = table.join(totals, "ctx")
        if lower is None:
            below = F.lit(1.0 / 256)
        else:
            rows = rows.withColumn("low", suffix("key", order - 1))
            rows = rows.join(lower.select(F.col("key").alias("low"), F.col("p").alias("below")), "low")
            below = F.col("below")
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("gamma") * below
        lower = cut_lineage(rows.select("key", p.alias("p")), "probabilities")
        grams_here = lower.select(F.lit(order).alias("o"), "key", F.log("p").cast("float").alias("value"))
        weights_here = totals.select(F.lit(order).alias("o"), F.col("ctx").alias("key"), F.log("gamma").cast("float").alias("value"))
        probability = grams_here if probability is None else probability.union(grams_here)
        weights = weights_here if weights is None else weights.union(weights_here)
    return probability, weights


def packed(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A bounded table (o, key, value) as sorted arrays by order."""
    found = rows.toArrow()
    o, key, value = (found[c].to_numpy() for c in ("o", "key", "value"))
    out = {}
    for order in range(1, ORDER + 1):
        here = np.flatnonzero(o == order)
        here = here[np.argsort(key[here])]
        out[order] = key[here], value[here]
    return out


def lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at]


def log_probability(keys: np.ndarray, model: tuple[dict, dict]) -> np.ndarray:
    """Log probability of the last byte of each (sorted, distinct) n-gram after those before it; NaN where the language
    has no model."""
    probability, weights = model
    out = np.zeros(len(keys))
    live = np.arange(len(keys))
    for order in range(ORDER, 0, -1):
        part = keys[live]
        low = part & BYTES & ((1 << 8 * order) - 1)
        lang = part & ~BYTES
        found, value = lookup(probability[order], lang | low)
        out[live[found]] += value[found]
        live, low, lang = live[~found], low[~found], lang[~found]
        seen, weight = lookup(weights[order], lang | (low >> 8))
        out[live[seen]] += weight[seen]
        if order == 1:
            out[live] += np.where(seen, -np.log(256.0), np.nan)
    return out


def context_place(keys: np.ndarray) -> np.ndarray:
    """Place of the context of a highest-order n-gram: by language, then by context bytes, the nearest one first."""
    out = keys >> LANG_SHIFT
    for back in range(1, ORDER):
        out = (out << 8) | ((keys >> (8 * back)) & 255)
    return out


def first_place(lead: int) -> Column:
    """The least place to which a model row (o, key) applies: the bytes it does not have are 0. Its context begins `lead`
    bytes before the end of the key."""
    out = F.shiftright("key", LANG_SHIFT)
    for back in range(ORDER - 1):
        byte = F.when(F.col("o") > back + 1, F.shiftright("key", 8 * (back + lead)).bitwiseAND(F.lit(255))).otherwise(0)
        out = F.shiftleft(out, 8).bitwiseOR(byte)
    return out


def shard_cuts(placed: list[DataFrame]) -> list[int]:
    """Places that cut the model tables (o, first, ...) into shards of at most SHARD_ROWS rows that start in them. Besides, a
    shard needs the rows of the contexts around its lower end, at most 257 for each order."""
    starts = placed[0].select("first").union(placed[1].select("first"))
    total = starts.count()
    if total <= SHARD_ROWS:
        return []
    # each cut may be off by a twentieth of a shard
    shards = -(-total * 5 // (SHARD_ROWS * 4))
    at = F.array(*[F.lit(i / shards) for i in range(1, shards)])
    return sorted(set(starts.agg(F.percentile_approx("first", at, max(10_000, 20 * shards))).first()[0]) - {0})


def score(texts: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(k, total, n): sum of log probabilities and number of bytes of each k of (k, lang, body), over all rows that share it;
    total is null for a language without a model."""
    spark = texts.sparkSession
    placed = [cut_lineage(m.withColumn("first", first_place(lead)), "model") for m, lead in zip(model, (1, 0), strict=True)]
    cuts = shard_cuts(placed)
    parts = []
    for low, high in zip([0, *cuts], [*cuts, 1 << 52], strict=True):
        applies = (F.col("first") < high) & (F.col("first") + F.expr(f"shiftleft(1L, 8 * ({ORDER} - o))") > low)
        held = spark.sparkContext.broadcast(tuple(packed(m.where(applies).drop("first")) for m in placed))

        def run(batches: Iterator[pa.RecordBatch], held=held, low=low, high=high) -> Iterator[pa.RecordBatch]:
            tables = held.value
            for batch in slices(batches, SLICE):
                data, ends = flat(batch.column(2))
                keys, text = grams(data, ends, batch.column(1).to_numpy())
                if cuts:
                    place = context_place(keys)
                    mine = (place >= low) & (place < high)
                    keys, text = keys[mine], text[mine]
                distinct, at = np.unique(keys, return_inverse=True)
                logs = log_probability(distinct, tables)[at]
                total = np.bincount(text, logs, batch.num_rows).astype(float)
                n = np.bincount(text, minlength=batch.num_rows)
                columns = [batch.column(0), pa.array(total, from_pandas=True), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "total", "n"])

        parts.append(texts.select("k", "lang", "body").mapInArrow(run, "k long, total double, n long"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    gap = F.max(F.col("total").isNull())  # one part without a model is no score at all
    sums = rows.groupBy("k").agg(F.sum("total").alias("t"), F.sum("n").alias("n"), gap.alias("gap"))
    return sums.select("k", F.when(~F.col("gap"), F.col("t")).alias("total"), "n")


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    trusted: str = "quality = 1",
    quantile: float = QUANTILE,
    reach: float = REACH,
) -> DataFrame:
    """Per row: id, n_bytes, perplexity (per byte), threshold, keep.

    `labels` (id, ...) rows that meet `trusted` name the trusted documents; all of them count, but for one in FOLDS, which set
    the thresholds. Null and empty texts, and languages without trusted text, have no perplexity and are kept. Repeated
    rows get equal results. An empty table gives no row; without trusted rows everything is kept.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), language(lang_col).alias("lang"), body.alias("body"))
    rows = rows.select(F.xxhash64("id", "lang", "body").alias("k"), "id", "lang", "body")
    good = cut_lineage(labels.where(trusted).select(F.col(id_col).cast("long").alias("id")).distinct(), "trusted")
    good = sized(good, BROADCAST_ROWS)
    chosen = rows.join(good, "id", "left_semi")
    fold = F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(FOLDS))
    model = train(chosen.where(fold > 0))
    scores = cut_lineage(score(rows, model), "scores")
    known = rows.select("k", "id", "lang", F.length("body").cast("long").alias("n_bytes"))
    known = cut_lineage(known.join(scores, "k", "left"), "scored").withColumn(
        "loss", -F.col("total") / F.nullif(F.col("n"), F.lit(0))
    )
    held_out = known.join(good, "id", "left_semi").where((fold == 0) & F.col("loss").isNotNull())
    cuts = held_out.groupBy("lang").agg(F.percentile_approx("loss", F.array(F.lit(0.5), F.lit(quantile)), 10_000).alias("q"))
    cuts = cuts.select("lang", F.col("q")[0].alias("middle"), (F.col("q")[0] + reach * (F.col("q")[1] - F.col("q")[0])).alias("cut"))
    out = known.join(F.broadcast(cuts) if cuts.count() <= 100_000 else cuts, "lang", "left")
    shrunk = (F.col("loss") * F.col("n_bytes") + PRIOR * F.coalesce("middle", "loss")) / (F.col("n_bytes") + PRIOR)
    keep = F.coalesce(shrunk <= F.col("cut"), F.lit(True))
    return out.select(
        F.col("id").alias(id_col), "n_bytes", F.exp("loss").alias("perplexity"), F.exp("cut").alias("threshold"), keep.alias("keep")
    )


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `df` that the classifier keeps. Of rows that share an id none stays if one is rejected; a row without an id
    stays."""
    found = classify(df, labels, id_col, text_col, lang_col)
    gone = cut_lineage(found.where("not keep").select(id_col).distinct(), "rejected")
    return df.join(sized(gone, BROADCAST_ROWS), id_col, "left_anti").select(*df.columns)
