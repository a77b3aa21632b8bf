"""Corpus pipeline: five stages over ``documents``, each written and read again.

Toxic documents go, one document of each near-duplicate class stays, documents
with benchmark passages go, sources are mixed to their target weights, and the
mix is written as token ids, which the last stage reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import queries as q
from tallyworks.llm import toxicity as tox
from tallyworks.llm.common import by_row, materialize, read_table
from tallyworks.llm.decontaminate import contamination
from tallyworks.llm.mixing import mixed_documents
from tallyworks.llm.neardup import near_duplicates
from tallyworks.llm.tokens import read_tokens, write_tokens


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier scores under 0.5; it learns from the labels that op5 learns from.

    Each row is judged by its own text: a null or empty one has the score of no
    evidence and repeated rows stay or go together. An empty table gives an
    empty result; further columns, of any name, are carried along.
    """
    return tox.keep_ordinary(docs, tox.fit_on(docs, q.training_labels(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of rows: the one with the least id, rows without an id last.

    Rows without words are classes of their own and all stay; repeated rows
    leave one. An empty table gives an empty result; further columns, of any
    name, are carried along.
    """
    rows = by_row(docs, "pipeline-dedup-rows")
    classes = near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"))
    classes = classes.select(F.col("doc_id").alias("row"), "class_id")
    rank = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), "doc.doc_id", F.xxhash64("doc.text").alias("hash"), "row")
    first = rows.select("row", rank.alias("rank")).join(classes, "row").groupBy("class_id").agg(F.min("rank").alias("rank"))
    return rows.join(first.select("rank.row"), "row", "left_semi").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside a benchmark window, each judged by its own text.

    Rows with a null or empty text stay. An empty table gives an empty result;
    further columns, of any name, are carried along.
    """
    rows = by_row(docs, "pipeline-decontamination-rows")
    found = contamination(rows.select(F.col("row").alias("doc_id"), "doc.text"), read_table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("row"))
    return rows.join(hit, "row", "left_anti").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row of ``docs`` and pass that the mix takes, with the words taken.

    Rows without words are never taken; an empty table gives an empty result;
    further columns, of any name, are carried along.
    """
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place, length and checksum, read back from the token files.

    A null or empty text is the end id alone; rows of one doc_id follow each
    other, by text; an empty table gives an empty result.
    """
    return read_tokens(spark, write_tokens(docs, q.tokenizer_path()))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: SQL can express neither the classifier nor the sampling nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result but the last is a Parquet table."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
