"""A Spark data source that scans a directory tree; executors read the subtrees.

Every executor has to see the same tree (a shared mount), as with any file:// source.
"""

from __future__ import annotations

import logging
import os
import stat
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trigrail import schema as S

log = logging.getLogger(__name__)


def found(folder: str, depth: int, most: int, hidden: bool, links: bool, deep: bool = True, folders: bool = False) -> Iterator[tuple[str, os.stat_result]]:
    """Regular files (and symbolic links, and folders) below folder. Links are not followed; folders that can't be read, are missing or lie deeper than most are skipped, and names that aren't UTF-8."""
    try:
        with os.scandir(folder) as listed:
            some = sorted(listed, key=lambda e: e.name)
    except OSError as e:
        log.warning("skipped the folder %s: %s", folder, e)
        return
    for e in some:
        if e.name.startswith(".") and not hidden:
            continue
        try:
            e.name.encode()
            s = e.stat(follow_symlinks=False)
        except (OSError, UnicodeEncodeError) as why:
            log.warning("skipped %r: %s", e.path, why)
            continue
        if stat.S_ISDIR(s.st_mode):
            if folders:
                yield e.path, s
            if deep and depth >= most:
                log.warning("skipped the folder %s: deeper than %d", e.path, most)
            elif deep:
                yield from found(e.path, depth + 1, most, hidden, links, folders=folders)
        elif stat.S_ISREG(s.st_mode) or (links and stat.S_ISLNK(s.st_mode)):
            yield e.path, s


def entries(folder: str, depth: int, most: int, hidden: bool, links: bool, deep: bool = True, folders: bool = False) -> Iterator[tuple]:
    """Rows for what found() finds."""
    for path, s in found(folder, depth, most, hidden, links, deep, folders):
        yield path, s.st_mode, s.st_uid, s.st_gid, datetime.fromtimestamp(int(s.st_mtime), UTC)


class Subtree(InputPartition):
    def __init__(self, folder: str, depth: int, deep: bool):
        self.folder, self.depth, self.deep = folder, depth, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        flag = lambda k: options.get(k, "true").lower() == "true"
        self.hidden, self.links = flag("include_hidden"), flag("include_symlinks")
        self.folders = options.get("include_folders", "false").lower() == "true"
        self.most, self.tasks = int(options.get("max_depth", S.MAX_DEPTH)), int(options.get("tasks", 64))

    def partitions(self) -> list[Subtree]:
        """Subtrees, and folders without what is below them: folders are opened, level by level, until there are tasks subtrees."""
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        opened, below, depth = [], [self.root], 0
        while below and depth <= self.most and (depth == 0 or len(below) < self.tasks):
            deeper = []
            for folder in below:
                opened.append(Subtree(folder, depth, False))
                try:
                    with os.scandir(folder) as found:
                        deeper += sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and (self.hidden or not e.name.startswith(".")))
                except OSError:  # its own task says so
                    continue
            below, depth = deeper, depth + 1
        return [*opened, *(Subtree(p, depth, True) for p in below if depth <= self.most)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        yield from entries(partition.folder, partition.depth, self.most, self.hidden, self.links, partition.deep, self.folders)


class FileTree(DataSource):
    """format("filetree"): options path, include_hidden, include_symlinks, include_folders (no), max_depth, tasks."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, permissions int, uid int, gid int, modified timestamp"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """path, permissions, uid, gid, modified of the files below root."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").options(**options).load(root)
