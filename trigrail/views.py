"""The search engine's input tables as views of the test tables, once for Spark and once for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog: the pages' addresses play the paths."""
    n = F.col("page_id")
    kind = F.when(n % 15 == 0, 16384).when(n % 10 == 0, 40960).otherwise(32768)
    return table(spark, sf_dir, "pages").select(
        n.alias("id"), F.col("url").alias("path"), (kind + n * 37 % 512).cast("int").alias("permissions"),
        (1000 + n % 5).cast("int").alias("uid"), (100 + n % 3).cast("int").alias("gid"),
        F.timestamp_seconds(1704067200 + n * 3600).alias("modified"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records: the events play creations, modifications, moves and deletions."""
    kinds = {"signup": "create", "view": "modify", "purchase": "moved_to", "click": "moved_from", "error": "delete"}
    op = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.element_at(op, F.col("event_type")).alias("op"), F.concat(_folder(), F.lit("/"), _name()).alias("path"),
        F.lit(33188).alias("permissions"), F.col("ts").alias("modified"), F.col("user_id").alias("wd"), _name().alias("name"),
    )


def _folder():
    return F.concat(F.lit("/u"), F.col("user_id").cast("string"))


def _name():
    return F.concat(F.when(F.col("event_id") % 11 == 0, ".").otherwise(""), F.lit("f"), (F.col("event_id") % 40).cast("string"))


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("user_id % 7 <> 0").select(F.col("user_id").alias("wd"), _folder().alias("dir")).distinct()


#: The same as common table expressions.
SQL = """
files AS (
  SELECT page_id AS id, url AS path,
    CAST((CASE WHEN page_id % 15 = 0 THEN 16384 WHEN page_id % 10 = 0 THEN 40960 ELSE 32768 END) + page_id * 37 % 512 AS INT) AS permissions,
    CAST(1000 + page_id % 5 AS INT) AS uid, CAST(100 + page_id % 3 AS INT) AS gid FROM pages
), changes AS (
  SELECT event_id AS seq, user_id AS wd,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'modify' WHEN 'purchase' THEN 'moved_to' WHEN 'click' THEN 'moved_from' WHEN 'error' THEN 'delete' END AS op,
    (CASE WHEN event_id % 11 = 0 THEN '.' ELSE '' END) || 'f' || (event_id % 40) AS name,
    '/u' || user_id || '/' || (CASE WHEN event_id % 11 = 0 THEN '.' ELSE '' END) || 'f' || (event_id % 40) AS path
  FROM events
), watches AS (
  SELECT DISTINCT user_id AS wd, '/u' || user_id AS dir FROM events WHERE user_id % 7 <> 0
), grams AS (
  SELECT id AS file_id, i - 1 AS pos, substring(path, i, 3) AS trigram FROM (SELECT id, path, unnest(range(1, length(path) - 1)) AS i FROM files)
), postings AS (
  SELECT trigram, file_id, count(*) AS freq FROM grams GROUP BY ALL
), gaps AS (
  SELECT trigram, row_number() OVER w AS pos, file_id, file_id - coalesce(lag(file_id) OVER w, 0) AS gap FROM postings WINDOW w AS (PARTITION BY trigram ORDER BY file_id)
), dictionary AS (
  SELECT trigram, count(*) AS num_files, CAST(sum(freq) AS BIGINT) AS num_occurrences FROM postings GROUP BY trigram
), last AS (
  SELECT path, arg_max(op, seq) AS op, max(seq) AS seq FROM changes GROUP BY path
)
"""
