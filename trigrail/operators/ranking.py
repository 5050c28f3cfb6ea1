"""Relevance scores and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trigrail import schema as S
from trigrail.functions import score
from trigrail.functions.text import literal_trigrams


def literal(files: DataFrame, pattern: str) -> DataFrame:
    """(file_id, score) by functions.score.literal_relevance, files without a score left out."""
    return files.select(F.col("id").alias("file_id"), score.literal_relevance(F.col("id"), F.col("path"), pattern).alias("score")).where("score is not null")


def tfidf(files: DataFrame, postings: DataFrame, pattern: str) -> DataFrame:
    """(file_id, score) of files with any of the pattern's trigrams.

    Sum of freq / (length - 2) * ln((N + 1) / (num_files + 1)), over the root of the length.
    """
    rows = postings.where(F.col("trigram").isin(literal_trigrams(pattern)))
    df = rows.groupBy("trigram").agg(F.count("*").alias("num_files"))  # at most one row for each of the query's trigrams
    n = files.agg(F.count("*").alias("n"))  # one row
    return scores(files.join(F.broadcast(n)), rows, df, F.col("n"))


def scores(files: DataFrame, rows: DataFrame, df: DataFrame, n: Column) -> DataFrame:
    """The scores of tfidf from postings of the query's trigrams, all those of each file that has any. df: trigram, num_files, a row a trigram; n: files of the catalog."""
    length = F.length("path").cast("double")
    term = F.sum(F.col("freq") / (length - 2) * F.ln((n + 1) / (F.col("num_files") + 1)))
    each = rows.join(F.broadcast(df), "trigram").join(files.withColumnRenamed("id", "file_id"), "file_id")
    return each.groupBy("file_id", length.alias("length")).agg(term.alias("total")).select("file_id", F.round(F.col("total") / F.sqrt("length"), 8).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best, ties by the smaller id: each task keeps k rows of its own."""
    return scored.orderBy(F.col("score").desc(), F.col("file_id")).limit(k)


def above(scored: DataFrame, threshold: float = S.SCORE_THRESHOLD) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


def best_per_shard(scored: DataFrame, shards: int, k: int = S.SHARD_RESULTS) -> DataFrame:
    """The k best of each shard (file_id modulo shards)."""
    shard = F.pmod(F.col("file_id"), F.lit(shards)).cast("long")
    w = W.partitionBy("shard").orderBy(F.col("score").desc(), F.col("file_id"))
    return scored.withColumn("shard", shard).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
