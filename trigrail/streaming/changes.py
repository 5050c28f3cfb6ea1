"""Change records: classification, resolution, and their merge into the catalog, in batches or streams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrail import schema as S
from trigrail.functions import text
from trigrail.operators.catalog import dense_ids
from trigrail.sources.snapshots import held


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of change records from Parquet files that appear in folder."""
    return spark.readStream.schema(S.CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def classified(changes: DataFrame, include_hidden: bool = True) -> DataFrame:
    """Adds action: upsert, delete or ignore, by the operation alone, as a deleted path can't be looked at any more."""
    action = F.when(F.col("op").isin(*S.UPSERTS), "upsert").when(F.col("op").isin(*S.DELETES), "delete").otherwise("ignore")
    out = changes.withColumn("action", action)
    return out if include_hidden else out.where(~text.name(F.col("path")).startswith("."))


def resolved(events: DataFrame, watches: DataFrame) -> DataFrame:
    """Events (wd, name, ...) with the path below their watch's dir; those of unknown watches are dropped."""
    met = events.join(watches.select("wd", "dir"), "wd")
    return met.withColumn("path", text.joined(F.col("dir"), F.col("name")))


def last(changes: DataFrame) -> DataFrame:
    """The last record of each path by seq. An aggregate, so a busy path is combined before the shuffle."""
    columns = [c for c in ("seq", "action", "permissions", "uid", "gid", "modified") if c in changes.columns]
    one = changes.where("action <> 'ignore' and path is not null").groupBy("path").agg(F.max(F.struct(*columns)).alias("one"))
    return one.select("path", *[f"one.{c}" for c in columns])


def applied(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog after the changes. Paths keep their ids; new ones get ids above all old ones, in the order of paths.

    Records may lack uid and gid: a known file keeps its own. Not lazy: new paths are numbered by jobs that run while the plan is made, and the
    last records are checkpointed, so that a micro-batch, with its state, is worked off once. Both sides may be large: joins merge.
    """
    if "action" not in changes.columns:
        changes = classified(changes)
    final = held(last(changes))
    new = {c: F.col(f"n.{c}") if c in final.columns else F.lit(None) for c in ("permissions", "uid", "gid", "modified")}
    upserts = final.where("action = 'upsert'").alias("n")
    known = upserts.join(files.alias("o").hint("merge"), F.col("n.path") == F.col("o.path"))
    changed = known.select("o.id", "o.path", *[F.coalesce(c, F.col(f"o.{k}")).cast(S.FILES[k].dataType).alias(k) for k, c in new.items()])
    unseen = upserts.join(files.select("path").hint("merge"), "path", "left_anti").select("path", *[c.cast(S.FILES[k].dataType).alias(k) for k, c in new.items()])
    top = files.agg(F.max("id")).first()[0]
    added = dense_ids(unseen, "path", 0 if top is None else top + 1)
    names = S.FILES.names
    rest = files.join(final.select("path").hint("merge"), "path", "left_anti")
    return rest.select(*names).unionByName(changed.select(*names)).unionByName(added.select(*names))


def identity(spark: SparkSession, checkpoint: str) -> str:
    """The id that a started query keeps in its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def follow(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 30, once: bool = False):
    """Starts a query that merges each micro-batch; its checkpoint makes every batch count once. once: it merges what there is, then ends."""
    when = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**when).start()


def stop(query) -> None:
    """Merges what has arrived, then ends."""
    query.processAllAvailable()
    query.stop()
