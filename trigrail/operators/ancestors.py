"""Whether a user may get to a path: the right to enter every folder above it, as far as the catalog has these folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrail import schema as S
from trigrail.operators.permissions import enterable
from trigrail.sources.snapshots import held

#: Closed folders that are broadcast at most; more are joined, each sent to so many places, to which the folders below it are dealt.
SENT, PLACES = 500_000, 16


def ancestors(path: Column) -> Column:
    """The folders above a path, without slashes at their ends: / (of absolute paths), /a and /a/b for /a/b/c. An empty path, or one without a slash, has none."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: _folder(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(F.size(parts) > 1, F.array_distinct(above)).otherwise(F.array().cast("array<string>"))


def _folder(path: Column) -> Column:
    """A folder's path without slashes at its end; the root stays one slash."""
    bare = F.rtrim(path, F.lit("/"))
    return F.when(bare == "", "/").otherwise(bare)


def closed(files: DataFrame, uid: int, gid: int) -> DataFrame:
    """folder: the catalog's folders that the user may not enter. A row without permissions (null) is no folder; one without owner and group is open if others may enter it."""
    shut = F.coalesce(enterable(F.col("permissions"), F.col("uid"), F.col("gid"), uid, gid), F.lit(False))
    return files.where(F.col("permissions").bitwiseAND(S.KIND_MASK) == S.FOLDER).where(~shut).select(_folder(F.col("path")).alias("folder")).distinct()


def reachable(rows: DataFrame, files: DataFrame, uid: int, gid: int) -> DataFrame:
    """rows (path, ...) with no folder above them that files says the user may not enter; a null path is above nothing and stays.

    Rows are first reduced to their distinct parents, so that what is expanded grows with folders, not files. A closed folder with very many folders below it
    is no hot key: closed folders are broadcast once counted, and beyond SENT the join is dealt by folder and place.
    """
    if uid == 0:
        return rows
    shut = held(closed(files, uid, gid))
    parent = F.try_element_at(ancestors(F.col("path")), F.lit(-1))
    n = shut.limit(SENT + 1).count()
    if not n:
        return rows
    parents = rows.select(parent.alias("_parent")).where("_parent IS NOT NULL").distinct()
    above = parents.select("_parent", F.explode(F.array_distinct(F.concat(ancestors(F.col("_parent")), F.array("_parent")))).alias("folder"))
    if n <= SENT:
        below = above.join(F.broadcast(shut), "folder", "left_semi")
    else:
        place = F.pmod(F.xxhash64("_parent"), F.lit(PLACES)).alias("_place")
        sent = shut.select("folder", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PLACES - 1).cast("long"))).alias("_place"))
        below = above.select("_parent", "folder", place).join(sent, ["folder", "_place"], "left_semi")
    barred = below.select("_parent").distinct()
    kept = rows.withColumn("_of", parent)
    return kept.join(barred, kept["_of"] == barred["_parent"], "left_anti").drop("_of")
