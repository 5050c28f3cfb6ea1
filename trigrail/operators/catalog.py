"""The file catalog: ids, kinds and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trigrail import schema as S
from trigrail.functions import text
from trigrail.sources.snapshots import held


def dense_ids(rows: DataFrame, by: str, start: int = 0) -> DataFrame:
    """rows with an id: start, start + 1, ... in the order of by, which must be unique.

    Rows are dealt by ranges and numbered within each; where a range begins comes from a row for each range. The
    dealt rows are checkpointed, so that a recomputed range can't number them differently.
    """
    dealt = held(rows.repartitionByRange(F.col(by)).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    first = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n") + start).alias("_first"))  # a row for each partition
    within = F.row_number().over(W.partitionBy("_range").orderBy(by)) - 1
    return dealt.join(F.broadcast(first), "_range").withColumn("id", (F.col("_first") + within).cast("long")).drop("_range", "_first")


def count(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"))


def is_file(permissions: Column, symlinks: bool = True) -> Column:
    """Regular files, and symbolic links if asked for."""
    kinds = [S.REGULAR, S.SYMLINK] if symlinks else [S.REGULAR]
    return permissions.bitwiseAND(S.KIND_MASK).isin(kinds)


def is_hidden(path: Column) -> Column:
    return text.name(path).startswith(".")


def within_depth(path: Column, most: int = S.MAX_DEPTH) -> Column:
    return text.depth(path) <= most
