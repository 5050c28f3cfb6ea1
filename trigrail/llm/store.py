"""Shared scratch tables and joins whose strategy follows a measured size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a key table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Rows from which on a key of spread_join is dealt to several tasks, and to how many.
HOT, SALT = 1000, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only local sessions, which share all, may have one of our own instead."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{_own()}"


@cache
def _own() -> str:
    """A folder for the local sessions of this process, gone at its end."""
    own = tempfile.mkdtemp(prefix="trigrail-")
    atexit.register(shutil.rmtree, own, True)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later readers neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def bucketed(df: DataFrame, name: str, by: str, n: int) -> DataFrame:
    """df as a table in the shared folder whose rows of equal by lie in one of n buckets: a grouping by it (n is not less than the shuffle's partitions) doesn't shuffle them."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "_".join((name, uuid.uuid4().hex))
    n = min(100_000, max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    df.write.format("parquet").bucketBy(n, by).option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def drop(table: DataFrame) -> None:
    """Deletes what written() wrote; no later plan may read it."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sized(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """keys (a written table), marked for broadcast if it has at most limit rows."""
    return F.broadcast(keys) if keys.count() <= limit else keys.hint("merge")


def spread_join(rows: DataFrame, keyed_by: DataFrame, on: list[str], salt: str, how: str = "inner") -> DataFrame:
    """rows joined to a table with one row for each value of on; a value that many rows have is dealt to SALT tasks.

    Which values these are is counted first (HOT rows and more, so at most one in HOT of the rows); only their rows of keyed_by are repeated. Only these values are broadcast, once counted. salt: a column of rows that tells them apart.
    """
    hot = written(rows.groupBy(*on).count().where(F.col("count") >= HOT).select(*on, F.lit(True).alias("_hot")), "hot-keys")
    if hot.isEmpty():
        return rows.join(keyed_by.hint("merge"), on, how)
    few = sized(hot)
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(SALT))).otherwise(F.lit(0).cast("long"))
    dealt = rows.join(few, on, "left").withColumn("_part", part).drop("_hot")
    parts = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    copied = keyed_by.join(few, on, "left").withColumn("_part", parts).drop("_hot")
    return dealt.join(copied.hint("merge"), [*on, "_part"], how).drop("_part")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: a table's other columns, whatever they are called, never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def keyed(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, text and the named columns: one row for each doc_id.

    Rows without doc_id are left out. Rows that share a doc_id count once: the one with the smallest
    text (null last). Only such rows are shuffled, and only if there are any.
    """
    docs = columns(docs, "doc_id", "text", *others).where("doc_id is not null")
    twice = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return docs
    twice = written(twice, "twice")
    rest = [F.col(n) for n in others]
    pick = F.min(F.struct(F.col("text").isNull().alias("none"), "text", *rest)).alias("one")
    some = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(pick).sortWithinPartitions("doc_id")  # the same order if a task runs again
    return docs.join(twice, "doc_id", "left_anti").unionByName(some.select("doc_id", "one.text", *[f"one.{n}" for n in others]))
