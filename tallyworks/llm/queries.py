"""The queries of this subpackage: each operator over its whole standard table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, oracles, pii, secrets, toxicity
from .alignment import token_alignment
from .common import read_table
from .decontaminate import SLOP, contamination
from .embeddings import near_embeddings
from .mixing import mix
from .neardup import near_duplicates
from .quality import quality
from .spelling import spelling_variants
from .tokens import read_tokens, write_tokens

#: Path of the tokenizer file; any file of the tokenizers library with a byte-level pattern will do.
TOKENIZER = os.environ.get("TALLYWORKS_TOKENIZER", "")


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    """Path of the sentencepiece model; any whose pieces hold the space mark only in front will do."""
    given = os.environ.get("TALLYWORKS_PIECES", "")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _crc_mod(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents")).drop("text")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(_crc_mod(4) == 2, F.lit(False))
    model = language.fit_on(docs.where(~held_out))
    return language.languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    got = chat.read_back(chat.format_conversations(chat.threads(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return got.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of documents that aren't held out."""
    return read_table(spark, sf_dir, "labels").where(F.coalesce(_crc_mod(5) != 0, F.lit(False)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(_crc_mod(5) == 0, F.lit(False))
    model = toxicity.fit_on(docs, training_labels(spark, sf_dir))
    return toxicity.toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return read_tokens(spark, folder)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries to one ledger: first the English documents, then the whole table, of which only unseen blobs are scanned."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", "lang")
    ledger = secrets.new_ledger(spark)
    secrets.scan_unseen(docs.where("lang = 'en'"), ledger)
    return secrets.digest(secrets.scan(docs, ledger), "doc_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(read_table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
        F.array_join("near_items", ",").alias("near_items"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(read_table(spark, sf_dir, "documents"), tokenizer_path(), pieces_path())


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_language": op3_language,
        "op4_chat": op4_chat,
        "op5_toxicity": op5_toxicity,
        "op6_token_ids": op6_token_ids,
        "op7_mixing": op7_mixing,
        "op8_secrets": op8_secrets,
        "op9_personal_data": op9_personal_data,
        "op10_decontamination": op10_decontamination,
        "op11_alignment": op11_alignment,
        "op12_spelling": op12_spelling,
        "op13_embeddings": op13_embeddings,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
