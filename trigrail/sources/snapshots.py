"""Versioned tables in folders: data folders of their own names, and commits/N files that say which of them version N has.

A version's tables are written whole before its commit appears, and nothing is overwritten. What a failed writer leaves is named by no
commit and never read. A commit file is complete when it gets its name, and gets it only if the name is free: by a hard link on file systems of
the machine, elsewhere by a rename, which HDFS refuses if the target exists (an object store that overwrites needs one writer at a time). vacuum()
deletes what no kept version names.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only local sessions, which share all, may have one of this process instead."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own()


@cache
def _own() -> str:
    own = tempfile.mkdtemp(prefix="trigrail-")
    atexit.register(shutil.rmtree, own, True)
    return own


def held(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, so that later reads don't compute it again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def located(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path, so that any store that Spark knows will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, folder: str) -> int:
    """The current version, -1 if there is none."""
    fs, p = located(spark, f"{folder}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n) for n in names if n.isdigit()), default=-1)


def contents(spark: SparkSession, folder: str, at: int | None = None) -> dict:
    """What the commit of the current version, or of version at, says: tables (name to data folder) and notes."""
    n = version(spark, folder) if at is None else at
    fs, p = located(spark, f"{folder}/commits/{n}")
    if n < 0 or not fs.exists(p):
        raise FileNotFoundError(f"{folder} has no version" + f" {n}" * (n >= 0))
    stream = fs.open(p)
    try:
        return json.loads(stream.readLine())
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], notes: dict | None = None) -> int:
    """Writes the tables, then makes them the next version, all at once."""
    new, written = version(spark, folder) + 1, {}
    for name, df in tables.items():
        written[name] = f"{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{folder}/{written[name]}")
    publish(spark, folder, new, {"tables": written, "notes": notes or {}})
    return new


def publish(spark: SparkSession, folder: str, new: int, what: dict) -> None:
    """Makes what the commit of version new, unless it has one."""
    fs, temporary = located(spark, f"{folder}/commits/_{uuid.uuid4().hex}")
    stream = fs.create(temporary, False)
    stream.writeBytes(json.dumps(what) + "\n")
    stream.close()
    _, to = located(spark, f"{folder}/commits/{new}")
    if fs.getUri().getScheme() == "file":
        local = [x.toUri().getPath() for x in (temporary, to)]
        try:
            os.link(*local)
            done = True
        except FileExistsError:
            done = False
        fs.delete(temporary, False)
    else:
        done = not fs.exists(to) and fs.rename(temporary, to)
    if not done:
        raise FileExistsError(f"another writer has made version {new} of {folder}")


def vacuum(spark: SparkSession, folder: str, keep: int = 1, idle: float = 3600, parts: tuple[str, ...] = ("",)) -> int:
    """Deletes all but the last keep versions, and the data folders that none of these names if they have not changed for idle seconds (a writer's, that may yet commit). Returns how many.

    parts: where data folders lie; their names are found anywhere in a commit.
    """
    newest = version(spark, folder)
    kept = [n for n in range(newest, -1, -1) if located(spark, f"{folder}/commits/{n}")[0].exists(located(spark, f"{folder}/commits/{n}")[1])][:keep]
    named = json.dumps([contents(spark, folder, n) for n in kept])
    gone = 0
    fs, commits = located(spark, f"{folder}/commits")
    for s in fs.listStatus(commits) if fs.exists(commits) else []:
        name = s.getPath().getName()
        if name.isdigit() and int(name) not in kept:
            fs.delete(s.getPath(), False)
    for part in parts:
        _, place = located(spark, f"{folder}/{part}".rstrip("/"))
        for s in fs.listStatus(place) if fs.exists(place) else []:
            name = s.getPath().getName().rpartition("=")[2]
            old = time.time() - s.getModificationTime() / 1000 >= idle
            if s.isDirectory() and name not in (*parts, "commits") and f'"{name}"' not in named and old:
                gone += bool(fs.delete(s.getPath(), True))
    return gone


def save(df: DataFrame, folder: str) -> int:
    """Writes df as the next version of a folder with one table."""
    return commit(df.sparkSession, folder, {"table": df})


def load(spark: SparkSession, folder: str, at: int | None = None, name: str = "table") -> DataFrame:
    """A table of the current version, or of version at."""
    return spark.read.parquet(f"{folder}/{contents(spark, folder, at)['tables'][name]}")
