"""Membership tests for trigrams. Sets are exact, where a bitmap of hashes would let false ones through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown(dictionary: DataFrame, trigrams: list[str]) -> DataFrame:
    """Which of the query's trigrams stand in no file."""
    spark = dictionary.sparkSession
    asked = spark.createDataFrame([(t,) for t in trigrams], "trigram string")
    return asked.join(dictionary.select("trigram").where(F.col("trigram").isin(trigrams)), "trigram", "left_anti")


def all_known(dictionary: DataFrame, trigrams: list[str]) -> DataFrame:
    """One row: whether every trigram stands in some file. The filter is pushed to the dictionary's scan."""
    there = dictionary.where(F.col("trigram").isin(trigrams)).agg(F.countDistinct("trigram").alias("n"))
    return there.select((F.col("n") == len(set(trigrams))).alias("all_known"))


def fed_forward(dictionary: DataFrame, asked: DataFrame) -> DataFrame:
    """The distinct asked trigrams that the dictionary knows: what a query adds to the hot set."""
    return asked.select("trigram").distinct().join(dictionary.select("trigram"), "trigram", "left_semi")


def hot_candidates(asked: DataFrame, hot: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of asked (pos, trigram) whose trigram is in the hot set, repeats and order kept; most: the first ones only."""
    out = asked.join(hot.select("trigram"), "trigram", "left_semi").select("pos", "trigram")
    return out.orderBy("pos").limit(most) if most is not None else out
