"""A corpus pipeline over the documents table: filter, deduplicate, sanitise, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadtide.llm import mixing, neardup, packing, pii, quality
from quadtide.llm.common import fresh, saved


def _same_columns(out: DataFrame) -> DataFrame:
    """The length follows the text where a stage has changed it."""
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go. A rejected document is known by its id, which may be null, and
    text; rows that repeat both share the decision. Null texts and texts without words are rejected."""
    found = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    i, v = fresh(docs, "score_id", "score_version")
    bad = found.where(~F.col("kept")).select(F.col("id").alias(i), F.col("version").alias(v)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(i)) & F.xxhash64(docs["text"]).eqNullSafe(F.col(v)), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id, null last: five words
    a shingle, similarity 0.8. Documents without words stay; rows equal in id and text stay once."""
    return neardup.keep_one(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the text; all rows stay, null texts null."""
    return _same_columns(pii.sanitise(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in its order; rows without words go, a null source is one of its own."""
    return _same_columns(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; a null text is an empty one, a null id stays null."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A classifier, near duplicates and packing are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written to the shared folder and read again. An empty
    table gives no pieces; columns beyond those of ``documents`` are carried to the last stage."""
    sf_dir = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
