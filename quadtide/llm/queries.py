"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quadtide.llm import covertree, hilbert, htmlcut, kronecker, mixing, neardup, packing, pii, quality, repeats, secrets, spelling, warc

CONTRACT_DUP = neardup.NearDup(k=3, num=85, den=100)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def joined(spans, kinds: tuple[str, ...]):
    """kind:start:end of spans with a numbered kind, comma-joined."""
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in kinds)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def of_kind(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == F.lit(kind))).cast("long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extract(read(spark, sf_dir, "pages"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    number = len(pii.KINDS)
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(number).alias("kind"), t["end"].alias("end")))
    counts = [of_kind("base", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    spans = joined(F.array_sort(F.concat(base, terms)), (*pii.KINDS, "term"))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base, pii.KINDS), 256).alias("base_sha256"), spans.alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    counts = [of_kind("spans", k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "evidence", "host_prior", "path_prior", "posterior", "kept")


def op5_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.search(read(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = mixing.Mix()
    found = mixing.shares(read(spark, sf_dir, "documents"), conf=conf)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", mixing.taken(conf).alias("taken"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))
    return made.withColumn("content", F.decode("content", "UTF-8"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"), conf=CONTRACT_DUP)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(read(spark, sf_dir, "documents"))
    lost = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", lost.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), digest)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return kronecker.hard_negatives(vectors.withColumn("label", label))


OPERATORS = (
    op1_main_text, op2_personal_data, op3_secrets, op4_quality, op5_exact_search, op6_mixing, op7_warc_derivatives, op8_nearest, op9_packing,
    op10_near_duplicates, op11_spelling, op12_repeats, op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}

EXACT_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

ORACLE = {"op13_hard_negatives": HARD_NEGATIVES, "op5_exact_search": EXACT_SEARCH}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
