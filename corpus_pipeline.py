"""From raw documents to token ids: toxicity, near-duplicates, benchmark passages, personal data, encoding.

Each stage takes all its predecessor kept, decides by one operator of ``sortfolio.llm``, and returns the columns of ``documents``
(the last one returns the ids as well). Keys may repeat or be null: each row is judged on its own text, and a near-duplicate class
keeps one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortfolio.llm import decontaminate, linear, pieces, pii, simhash, toxicity
from sortfolio.llm.queries import ship, table
from sortfolio.llm.storage import land

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: near-duplicates: fingerprints of three-word shingles, linked at two or fewer differing bits
SHINGLE, RADIUS = 3, 2


def _numbered(docs: DataFrame) -> DataFrame:
    """The landed rows with a number of their own."""
    return land(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the classifier calls toxic; each row travels with its score."""
    ship(spark)
    weights, bias = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), "text")
    scored = linear.scores(whole, weights, bias, toxicity.features, "__doc", "text")
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("__doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest key, a null one last; of equal keys the first row."""
    ship(spark)
    rows = _numbered(docs)
    classes = simhash.near_duplicates(rows, SHINGLE, RADIUS, key="__row").select("__row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    first = classes.join(rows.select("doc_id", "__row"), "__row").groupBy("component_id").agg(F.min(order).alias("first"))
    # one row in eight or more is kept, so the kept ones are never small beside the rows: both sides are dealt at every size
    return rows.join(land(first.select("first.__row"), "kept").hint("merge"), "__row", "left_semi").drop("__row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a window of a benchmark item."""
    ship(spark)
    rows = _numbered(docs)
    hits = decontaminate.contaminated_words(rows, table(spark, sf_dir, "benchmark"), key="__row")
    return rows.join(land(hits.where("contaminated").select("__row"), "contaminated_rows"), "__row", "left_anti").drop("__row")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; the character count follows the new text."""
    ship(spark)
    return pii.replace_pii(docs).drop("n_entities").withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document."""
    ship(spark)
    return pieces.encode(docs, own=True).select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "exact")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("sentencepiece", encode_pieces),
]
#: classifiers and near-duplicate classes can't be expressed in SQL; tests/llm/test_pipeline.py holds the filters and the whole run against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
