"""Frames that several queries share, each with the same frame in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.maths import is_valid, unit
from lanternfish.operators.relational import first_per
from lanternfish.session import table

SIZE = 64


def latest_images(spark: SparkSession, sf: str) -> DataFrame:
    """The last crawl of each image."""
    return first_per(table(spark, sf, "images").where("id is not null"), ["id"], [F.desc("fetched_at"), F.col("state"), F.col("thumb_url")])


LATEST = "latest AS (SELECT * FROM images WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, state NULLS FIRST, thumb_url NULLS FIRST) = 1)"


def unit_vectors(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """(id, vec): one vector of length 1 per id, of the valid ones, with ``only`` of the ids in it; copies of an id are equal."""
    rows = table(spark, sf, "vectors")
    rows = (rows if only is None else rows.join(only, "id", "left_semi")).where(F.col("id").isNotNull() & is_valid(F.col("vec"), SIZE))
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).select("id", unit(F.col("vec")).alias("vec"))


UNITS = f"""units AS (SELECT id, list_transform(vec, lambda x: x / norm) AS vec FROM (SELECT id, vec, sqrt(list_dot_product(vec, vec)) AS norm FROM (
SELECT id, min(vec)::DOUBLE[] AS vec FROM vectors WHERE id IS NOT NULL AND len(vec) = {SIZE} AND len(list_filter(vec, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE} AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY id)))"""


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the vector of their image, where it has one."""
    docs = table(spark, sf, "documents")
    vectors = unit_vectors(spark, sf, docs.select(F.col("image_id").alias("id"))).withColumnRenamed("id", "image_id")
    return docs.join(vectors, "image_id", "left")


CATALOGUE = f"{UNITS}, catalogue AS (SELECT d.*, u.vec FROM documents d LEFT JOIN units u ON d.image_id = u.id)"


def searches(docs: DataFrame) -> DataFrame:
    """Queries: every document whose id is divisible by 20, by its first eight words and its vector."""
    from lanternfish.functions.text import words

    return docs.where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("qid"), F.array_join(F.slice(words(F.col("text")), 1, 8), " ").alias("text"), F.col("vec").alias("qvec"))


WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
SEARCHES = f"searches AS (SELECT doc_id AS qid, list_distinct({WORDS.format('text')}[1:8]) AS terms, vec AS qvec FROM catalogue WHERE doc_id % 20 = 0 AND text IS NOT NULL)"


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt vectors of four groups: the first 28 embeddings."""
    i = F.col("vec_id")
    group = F.when(i < 7, "unsafe").when(i < 10, "clinical").when(i < 12, "artistic").otherwise("safe")
    return table(spark, sf, "embeddings").where(i < 28).select(group.alias("group"), F.col("embedding").alias("prompt_vec"))


PROMPTS = "prompts AS (SELECT CASE WHEN vec_id < 7 THEN 'unsafe' WHEN vec_id < 10 THEN 'clinical' WHEN vec_id < 12 THEN 'artistic' ELSE 'safe' END AS grp, embedding::DOUBLE[] AS pvec FROM embeddings WHERE vec_id < 28)"
