"""A stream of the changes of a directory tree: what differs between two listings of it.

An offset names a listing, which lies in a shared folder, a file for each subtree. A batch goes from one listing to the next: tasks list their
subtrees, store what they saw, and give the difference to the listing before. A listing that is stored is never taken again, so a batch that is
repeated has the same records. Subtrees, once chosen, stay; folders that are new beside them become subtrees of their own. A vanished and
a new path of one subtree with one inode, time and size are a move; between subtrees they are a deletion and a creation with one cookie.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from trigrail.sources.filesystem import TreeReader, found

#: Of a listing's row: (device and inode, mode, owner, group, nanoseconds of the last change, size).
Seen = tuple[str, int, int, int, int, int]
INODE, MODE, OWNER, GROUP, TIME, SIZE = range(6)


def difference(old: dict[str, Seen], new: dict[str, Seen]) -> Iterator[tuple[str, str, Seen]]:
    """(operation, path, what was seen of it) that make the old listing the new one."""
    gone = defaultdict(list)
    for path in sorted(old.keys() - new.keys()):
        gone[old[path][INODE], old[path][TIME], old[path][SIZE]].append(path)
    for path in sorted(new):
        if path not in old:
            before = gone.get((new[path][INODE], new[path][TIME], new[path][SIZE]))
            if before:
                left = before.pop(0)
                yield "moved_from", left, old[left]
                yield "moved_to", path, new[path]
            else:
                yield "create", path, new[path]
        elif old[path] != new[path]:
            yield "modify", path, new[path]
    for paths in gone.values():
        for path in paths:
            yield "delete", path, old[path]


def cookie(seen: Seen) -> int:
    """A number for the file behind a path, whatever its path."""
    return int.from_bytes(hashlib.blake2b(seen[INODE].encode(), digest_size=8).digest(), "big", signed=True)


class Part(InputPartition):
    def __init__(self, folder: str, depth: int, deep: bool, start: int, end: int):
        self.folder, self.depth, self.deep, self.start, self.end = folder, depth, deep, start, end


def _kept(path: str, rows: list) -> list:
    """rows, stored as path, or what is stored there already: the first writer's rows count."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        try:
            os.link(temporary, path)
        except FileExistsError:
            pass
        os.unlink(temporary)
    return _stored(path)


def _stored(path: str) -> list:
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f]


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.tree = TreeReader(options)
        self.listings = os.path.realpath(options["listings"].removeprefix("file://"))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """A listing that is still to be made, above all that are there."""
        there = [int(n) for n in os.listdir(self.listings) if n.isdigit()] if os.path.isdir(self.listings) else []
        return {"listing": max([int(time.time() * 1000), *(n + 1 for n in there)])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        a, b = start["listing"], end["listing"]
        known = [tuple(x) for x in _stored(self._file(a, "subtrees"))] if a else [(p.folder, p.depth, p.deep) for p in self.tree.partitions()]
        subtrees = dict.fromkeys(known)
        for folder, depth, deep in known:
            if not deep and depth < self.tree.most:
                subtrees |= dict.fromkeys((child, depth + 1, True) for child in self._folders(folder) if (child, depth + 1, False) not in subtrees)
        kept = _kept(self._file(b, "subtrees"), [x for x in subtrees if os.path.isdir(x[0]) or _stored(self._of(a, *x))])
        return [Part(*x, a, b) for x in kept]

    def _folders(self, folder: str) -> list[str]:
        try:
            with os.scandir(folder) as listed:
                return sorted(e.path for e in listed if e.is_dir(follow_symlinks=False) and (self.tree.hidden or not e.name.startswith(".")))
        except OSError:
            return []

    def _file(self, listing: int, name: str) -> str:
        return f"{self.listings}/{listing}/{name}"

    def _of(self, listing: int, folder: str, depth: int, deep: bool) -> str:
        return self._file(listing, hashlib.sha256(f"{deep}:{folder}".encode()).hexdigest())

    def read(self, p: Part) -> Iterator[tuple]:
        path = self._of(p.end, p.folder, p.depth, p.deep)
        rows = []
        if not os.path.exists(path):
            for name, s in found(p.folder, p.depth, self.tree.most, self.tree.hidden, self.tree.links, p.deep):
                rows.append((name, (f"{s.st_dev}:{s.st_ino}", s.st_mode, s.st_uid, s.st_gid, s.st_mtime_ns, s.st_size)))
        new = {name: tuple(seen) for name, seen in _kept(path, rows)}
        old = {name: tuple(seen) for name, seen in _stored(self._of(p.start, p.folder, p.depth, p.deep))}
        for op, name, seen in difference(old, new):
            yield p.end, op, name, seen[MODE], seen[OWNER], seen[GROUP], datetime.fromtimestamp(seen[TIME] // 10**9, UTC), cookie(seen)

    def commit(self, end: dict) -> None:
        """Listings before the last one that was worked off aren't needed any more."""
        for n in os.listdir(self.listings) if os.path.isdir(self.listings) else []:
            if n.isdigit() and int(n) < end["listing"]:
                shutil.rmtree(f"{self.listings}/{n}", ignore_errors=True)


class TreeChanges(DataSource):
    """format("treechanges"): options path, listings (a folder that all share), and those of filetree. A subtree's listing is held by its task; tasks says how many subtrees there are at first."""

    @classmethod
    def name(cls) -> str:
        return "treechanges"

    def schema(self) -> str:
        return "seq long, op string, path string, permissions int, uid int, gid int, modified timestamp, cookie long"

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def changes_of(spark: SparkSession, root: str, listings: str, **options: str) -> DataFrame:
    """A stream of change records of the tree below root; its first batch creates all that is there."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("treechanges").options(listings=listings, **options).load(root)
