"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (term, document, position) for every place of every term that the benchmark uses. A phrase is
looked up from its rarest term: its postings, moved back by the term's offset, are the places where the phrase can
begin. They are intersected with the moved postings of the second rarest term, and what is left is held against all other
terms. Proximity queries start from the rarest term in the same way.

Rows are known by a hash of id and text and indexed once, so that repeated rows share their postings and rows that share
an id but not the text stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.llm.common import sized
from concord.session import cut_lineage

UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased: runs of 0-9, a-z and anything outside ASCII. Null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER_CASE, LOWER_CASE))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def build_index(df: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (tid, k, pos) of the given terms (term, tid), stored. Each place is one posting, however often its row is
    repeated; positions count from 0."""
    rows = df.select(id_col, text_col).distinct()
    places = rows.select(row_key(id_col, text_col).alias("k"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return cut_lineage(places.join(sized(terms), "term").select("tid", "k", "pos"), "postings")


def phrase_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, window: array of words), and which item has which window (item, wid)."""
    tokens = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    rows = tokens.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()
    rows = cut_lineage(rows, "item-windows")
    distinct = rows.select("window").distinct().withColumn("wid", F.monotonically_increasing_id())
    distinct = cut_lineage(distinct, "windows")
    return distinct, cut_lineage(rows.join(distinct, "window").select("item", "wid"), "windows-of-items")


def vocabulary(windows: DataFrame) -> DataFrame:
    terms = windows.select(F.explode("window").alias("term")).distinct()
    return cut_lineage(terms.withColumn("tid", F.monotonically_increasing_id()), "terms")


def phrase_matches(postings: DataFrame, terms: DataFrame, windows: DataFrame) -> DataFrame:
    """Every place (k, wid, start, n) where the words of a window stand consecutively."""
    counts = cut_lineage(postings.groupBy("tid").agg(F.count("*").alias("df")), "term-counts")
    offsets = windows.select("wid", F.size("window").alias("n"), F.posexplode("window").alias("off", "term"))
    # a term that no document has drops out here, and with it the window
    offsets = offsets.join(terms, "term").join(counts, "tid")
    whole = offsets.groupBy("wid").agg(F.count("*").alias("found"))
    ranked = offsets.join(whole, "wid").where("found = n")
    rank = F.row_number().over(W.partitionBy("wid").orderBy("df", "off"))
    ranked = cut_lineage(ranked.select("wid", "n", "off", "tid", rank.alias("rank")), "ranked-terms")
    first = ranked.where("rank = 1")
    second = ranked.where("rank = 2").select("wid", F.col("off").alias("off2"), F.col("tid").alias("tid2"))
    begin = postings.join(sized(first), "tid").select("k", "wid", "n", (F.col("pos") - F.col("off")).alias("start"))
    begin = begin.where("start >= 0").join(sized(second), "wid", "left")
    rare = cut_lineage(second.select(F.col("tid2").alias("tid")).distinct(), "second-terms")
    listed = postings.join(sized(rare), "tid", "left_semi").withColumnsRenamed({"tid": "tid2", "pos": "pos2", "k": "k2"})
    meet = (F.col("k") == F.col("k2")) & (begin.tid2 == listed.tid2) & (F.col("start") + F.col("off2") == F.col("pos2"))
    both = begin.where("off2 is not null").join(listed, meet, "left_semi")
    one = begin.where("off2 is null").distinct()
    places = cut_lineage(both.union(one).select("k", "wid", "n", "start"), "places").distinct()
    # the other terms, among the postings of the documents that are left
    docs = cut_lineage(places.select("k").distinct(), "documents")
    left = postings.join(sized(docs), "k", "left_semi")
    wanted = places.join(sized(ranked.where("rank > 2").drop("n", "rank")), "wid", "left")
    wanted = wanted.withColumn("pos", F.col("start") + F.col("off"))
    short = wanted.where("off is null").select("k", "wid", "start", "n")
    full = wanted.where("off is not null").join(left, ["k", "tid", "pos"])
    full = full.groupBy("k", "wid", "start", "n").agg(F.count("*").alias("m")).where("m = n - 2").drop("m")
    return full.unionByName(short)


def proximity_matches(postings: DataFrame, terms: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """Places (k, qid, start) of the rarest term of a query (qid, words) in whose reach, `span` words to either side, all other
    terms of the query stand too. Positions are cut into cells of `span` words, so each term is looked up in three cells."""
    wanted = queries.select("qid", F.explode(F.array_distinct("words")).alias("term"))
    need = wanted.groupBy("qid").agg(F.count("*").alias("need"))
    counts = postings.groupBy("tid").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("df", "tid"))
    ranked = wanted.join(terms, "term").join(counts, "tid").join(need, "qid")
    ranked = cut_lineage(ranked.select("qid", "need", "tid", rank.alias("rank")), "ranked-terms")
    begin = postings.join(sized(ranked.where("rank = 1")), "tid").select("k", "qid", "need", F.col("pos").alias("start"))
    others = begin.join(ranked.where("rank > 1").select("qid", "tid"), "qid", "left")
    cells = F.array(*[F.floor(F.col("start") / span) + d for d in (-1, 0, 1)])
    others = others.withColumn("cell", F.explode(cells))
    listed = postings.select("k", "tid", "pos", F.floor(F.col("pos") / span).alias("cell"))
    near = others.join(listed, ["k", "tid", "cell"]).where(F.abs(F.col("pos") - F.col("start")) <= span)
    near = near.groupBy("k", "qid", "start", "need").agg(F.count_distinct("tid").alias("m")).where("m = need - 1")
    return near.select("k", "qid", "start").union(begin.where("need = 1").select("k", "qid", "start"))


def find_hits(df: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int):
    """Stored places (k, wid, start, n) of benchmark windows, and which item has which window."""
    windows, of_items = phrase_windows(items, item_col, item_text_col, window)
    terms = vocabulary(windows)
    postings = build_index(df, terms, id_col, text_col)
    return cut_lineage(phrase_matches(postings, terms, windows), "hits"), of_items


def contamination(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """Per row: n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 and contaminated.

    Null and empty texts have no words and no hit, and items without words have no window. Equal rows get equal results, and
    a null item_id joins no list but its windows hit. Empty tables on either side give no rows or no hits.
    """
    df = df.select(id_col, text_col)
    hits, of_items = find_hits(df, items, id_col, text_col, item_col, item_text_col, window)
    order = W.partitionBy("k").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select("k", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(order), F.lit(0))))
    n_hit = spans.select("k", covered.alias("c")).groupBy("k").agg(F.sum("c").cast("long").alias("n_hit"))
    found = hits.select("k", "wid").distinct().join(sized(of_items), "wid").where("item is not null").select("k", "item").distinct()
    found = found.groupBy("k").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    rows = df.select(
        id_col, F.size(words(F.col(text_col))).cast("long").alias("n_words"), row_key(id_col, text_col).alias("k")
    )
    out = rows.join(n_hit.join(found, "k", "left"), "k", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_benchmark(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """The rows of `df` in whose text no benchmark window occurs, with all their columns."""
    hits, _ = find_hits(df, items, id_col, text_col, item_col, item_text_col, window)
    gone = sized(cut_lineage(hits.select(F.col("k").alias("__k")).distinct(), "contaminated"))
    return df.join(gone, row_key(id_col, text_col) == F.col("__k"), "left_anti")


#: The same for documents and benchmark, by comparing every window of every text.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS a FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM benchmark),
v AS (SELECT item_id, unnest([array_to_string(a[s:s + 9], ' ') FOR s IN range(1, greatest(len(a) - 9, 1) + 1)]) AS key
      FROM i WHERE len(a) > 0),
sizes AS (SELECT DISTINCT len(string_split(key, ' ')) AS n FROM v),
d AS (SELECT doc_id, n, unnest(range(1, len(a) - n + 2)) AS s, a FROM w, sizes WHERE len(a) >= n),
k AS (SELECT doc_id, n, s, array_to_string(a[s:s + n - 1], ' ') AS key FROM d),
h AS (SELECT k.doc_id, k.n, k.s, v.item_id FROM k JOIN v USING (key) WHERE len(string_split(key, ' ')) = k.n),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY 1)
SELECT doc_id, len(a)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
