"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.llm.common import table
from concord.llm.decontaminate import ORACLE as DECONTAMINATION, contamination
from concord.llm.exact_dedup import ORACLE as EQUAL_TEXTS, exact_duplicates
from concord.llm.fill_middle import ORACLE as FILL_IN_MIDDLE, fill_in_middle_report
from concord.llm.html_text import main_text
from concord.llm.lattice_dedup import ORACLE as LINKED_VECTORS, near_duplicates as near_vectors
from concord.llm.licenses import license_scan
from concord.llm.ngram_join import near_duplicates
from concord.llm.packing import pack
from concord.llm.quality import classify
from concord.llm.suffix_dedup import dedup_report
from concord.llm.tokens import token_counts
from concord.llm.toxicity import toxicity
from concord.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("op1_token_counts")
def op1(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op9_benchmark_decontamination", DECONTAMINATION)
def op9(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_ngram_jaccard_join")
def op5(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)


@query("op7_suffix_array_dedup")
def op7(spark, sf_dir):
    return dedup_report(table(spark, sf_dir, "documents"))


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_html_extraction")
def op10(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


@query("op8_toxicity")
def op8(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_embedding_near_dedup", LINKED_VECTORS)
def op6(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_exact_dedup", EQUAL_TEXTS)
def op12(spark, sf_dir):
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


@query("op13_fill_in_middle", FILL_IN_MIDDLE)
def op13(spark, sf_dir):
    return fill_in_middle_report(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
