"""The corpus pipeline: rules, line dedup, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
run() writes it as Parquet in the shared folder and hands the table to the next stage. All stages but the last
return the columns of documents.

1. quality_rules: documents that the rules reject go.
2. line_dedup: boilerplate lines are cut from the texts; no document goes.
3. jaccard_join: of each component of near copies (five-word shingles, Jaccard 0.8 or more) the document with the least doc_id stays.
4. decontaminate: documents with a benchmark window go.
5. bpe: a row of token ids and digests for each document that is left.

A null or empty text has no words and goes in stage 1. A null doc_id is judged by the rules only: no line of it is cut, it is no copy
and no leak. Rows that repeat a doc_id are judged one by one by stages 1, 2 and 4; in stage 3 all of them stay or go, and what is left
comes out once for each row. Extra columns pass through stages 1 to 4, whatever their names. Without documents there are no rows,
without labels of quality 1 only the base rules reject, without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from wayfold.llm.common import table, written

#: Near copies of the stage: 100 * intersection >= COPY_T * union of shingles of COPY_N words. op8's query has its own contract.
COPY_T, COPY_N = 80, 5


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.cleaned(docs)


def _copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, t=COPY_T, n=COPY_N)


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs.select("doc_id", "text"), with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", _rules),
    ("line_dedup", _lines),
    ("jaccard_join", _copies),
    ("decontaminate", _leaks),
    ("bpe", _tokens),
]

#: Connected components and byte-pair merges have no SQL; tests/llm compares each stage and the whole with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
