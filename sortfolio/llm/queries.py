"""The thin queries over the driver's tables, one per operator, and their SQL."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortfolio.llm import bpe, chat, decontaminate, lm, oracles, phrases, pieces, pii, quality, rules, simhash, toxicity, warc, whitening

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need no installation then (Spark's file server carries it)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(importlib.util.find_spec("sortfolio").origin).parent
    path = Path(tempfile.mkdtemp(prefix="ship-")) / "sortfolio_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *rules.BASE, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents"), own=True)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "exact")


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations in the ``messages`` layout and conversation -7 in the ``prompt`` layout, as one mixed table."""
    ok = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, ok, ok)], "conv_id bigint, prompt string, completion string")
    records = chat.grouped_messages(table(spark, sf_dir, "conversations")).unionByName(extra, allowMissingColumns=True)
    made = chat.format_chats(chat.canonical_turns(records, ("conv_id",))).select("conv_id", "layout", "formatted", "loss_mask")
    back = made.withColumns({"turns": chat.parsed(F.col("formatted")), "learnt": chat.masked(F.col("formatted"), F.col("loss_mask"))})
    return back.select(
        "conv_id", "layout", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_sentencepiece, op3_warc_round_trip, op4_lm_scoring, op5_pii_surrogates, op6_toxicity, op7_quality_classifier,
                              op8_decontamination, op9_quality_rules, op10_chat_formatting, op11_phrase_collocations, op12_embedding_whitening, op13_bpe)}

SQL: dict[str, str] = oracles.oracle_sql()
