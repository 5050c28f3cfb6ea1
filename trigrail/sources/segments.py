"""A database as segments: what a batch of changes adds is a small segment of its own, what it takes away a list of rows.

A segment has rows of the catalog and, by trigram, the postings of exactly these rows and their tails, plain and folded, with the lengths of the lists. Rows that a
later batch replaced or deleted stay in their segment and are named, by segment and id, in a table of deletions; a live row stands in one segment.
A version is a commit that names its segments and deletions, with how many rows each has. Merging makes one segment of several, without their deleted rows.
Tables lie in folders segment=<name>, so that any set of segments is one scan, which knows each row's segment; catalog rows lie in blocks of ids.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrail import schema as S
from trigrail.operators import postings
from trigrail.plans.choice import BLOCK
from trigrail.sources import snapshots

#: Segments of one tier (rows by powers of this) that are merged into one.
FANOUT = 4
#: Rows that a task writes, and postings of a path, about.
PART, LONG = 1_000_000, 40
#: Most deletions that are broadcast to the scans of their segments.
SENT = 2_000_000
INDEXES = (("postings", False), ("postings_folded", True))
DICTIONARY = "trigram string, num_files long"
TABLES = {
    "files": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.FILES) + ", segment string, block int",
    "deletes": "segment string, id long, part string",
    **{name: "trigram string, file_id long, freq long, segment string" for name, _ in INDEXES},
    **{f"{name}_lengths": DICTIONARY + ", segment string" for name, _ in INDEXES},
}


@dataclass
class State:
    """A version: rows of each segment and of each table of deletions, the next new id, and notes of streams."""

    version: int = -1
    segments: dict[str, int] = field(default_factory=dict)
    deletes: dict[str, int] = field(default_factory=dict)
    next_id: int = 0
    notes: dict[str, int] = field(default_factory=dict)

    @property
    def n_files(self) -> int:
        return sum(self.segments.values()) - sum(self.deletes.values())


class Store:
    """The segments of one database folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def state(self, at: int | None = None) -> State:
        version = snapshots.version(self.spark, self.folder) if at is None else at
        return State(version, **snapshots.contents(self.spark, self.folder, version))

    def latest(self) -> State:
        """The current version, an empty one if there is none."""
        return self.state() if snapshots.version(self.spark, self.folder) >= 0 else State()

    def commit(self, base: State, segments: dict[str, int], deletes: dict[str, int], next_id: int, notes: dict[str, int]) -> int:
        """The version after base; fails if another writer was quicker."""
        snapshots.publish(self.spark, self.folder, base.version + 1, {"segments": segments, "deletes": deletes, "next_id": next_id, "notes": notes})
        return base.version + 1

    def read(self, table: str, names) -> DataFrame:
        """A table of some segments, in one scan."""
        key = "part" if table == "deletes" else "segment"
        rows = self.spark.read.schema(TABLES[table])
        if not names:
            return self.spark.createDataFrame([], TABLES[table])
        return rows.option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{table}/{key}={n}" for n in sorted(names)])

    def _put(self, rows: DataFrame, table: str, name: str, n: int, *by: str, parts: tuple[str, ...] = ()) -> None:
        """Writes rows in the order of by, dealt to a task for each PART of about n."""
        path = f"{self.folder}/{table}/{'part' if table == 'deletes' else 'segment'}={name}"
        dealt = rows.repartitionByRange(n // PART + 1, *by).sortWithinPartitions(*by)
        dealt.write.option("compression", "zstd").partitionBy(*parts).parquet(path)

    def add(self, files: DataFrame, n: int, index: dict[str, DataFrame] | None = None) -> dict[str, int]:
        """Writes a segment of n catalog rows (held: they are read more than once) and their postings, sorted by trigram, so that scans skip row groups. {name: n}; nothing for no rows.

        A list of very many files is dealt to several tasks, and so are the files whose postings a task counts: it holds about PART of them, however few tasks hold the files.
        """
        if not n:
            return {}
        name = uuid.uuid4().hex[:16] + "s"
        rows = files.select(*S.FILES.names, F.shiftright("id", BLOCK).cast("int").alias("block"))
        self._put(rows, "files", name, n, "id", parts=("block",))
        dealt = files.repartition(n * LONG // PART + 1)
        for table, fold in INDEXES:
            self._put(index[table] if index else postings.build(dealt, fold).unionByName(postings.tails(files, fold)), table, name, n * LONG, "trigram", "file_id")
            lists = self.read(table, [name]).groupBy("trigram").agg(F.count("*").alias("num_files"))
            self._put(lists, f"{table}_lengths", name, n, "trigram")
        return {name: n}

    def remove(self, rows: DataFrame, n: int) -> dict[str, int]:
        """Writes n deletions (segment, id)."""
        if not n:
            return {}
        name = uuid.uuid4().hex[:16] + "d"
        self._put(rows.select("segment", "id"), "deletes", name, n, "segment", "id")
        return {name: n}

    def _alive(self, rows: DataFrame, state: State, key: str) -> DataFrame:
        """rows of segments without those that are deleted there."""
        if not state.deletes:
            return rows
        gone = self.read("deletes", state.deletes).select("segment", F.col("id").alias(key))
        return rows.join(F.broadcast(gone) if sum(state.deletes.values()) <= SENT else gone, ["segment", key], "left_anti")

    def files(self, state: State, names=None) -> DataFrame:
        """Live catalog rows with their segment and block."""
        return self._alive(self.read("files", state.segments if names is None else names), state, "id")

    def postings(self, state: State, table: str, names=None) -> DataFrame:
        """Live postings (trigram, file_id, freq), the paths' tails (of less than three characters) among them."""
        return self._alive(self.read(table, state.segments if names is None else names), state, "file_id").select("trigram", "file_id", "freq")

    def due(self, state: State) -> list[str]:
        """The segments of the smallest tier that has FANOUT of them, none if there isn't one."""
        tiers: dict[int, list[str]] = {}
        for name, n in state.segments.items():
            tier = 0
            while FANOUT ** (tier + 5) < n:  # up to a thousand rows are the first tier
                tier += 1
            tiers.setdefault(tier, []).append(name)
        return next((sorted(tiers[t]) for t in sorted(tiers) if len(tiers[t]) >= FANOUT), [])

    def merge(self, state: State, names: list[str]) -> int:
        """A version in which names are one segment. Postings are carried over; deletions of these segments, applied, go."""
        files = snapshots.held(self.files(state, names))
        new = self.add(files, files.count(), {table: self.postings(state, table, names) for table, _ in INDEXES})
        left = self.read("deletes", state.deletes).where(~F.col("segment").isin(names))
        segments = {k: n for k, n in state.segments.items() if k not in names} | new
        return self.commit(state, segments, self.remove(left, left.count()), state.next_id, state.notes)

    def size(self, state: State) -> int:
        """Bytes of all files that a version names."""
        total = 0
        for table in TABLES:
            for name in state.deletes if table == "deletes" else state.segments:
                fs, p = snapshots.located(self.spark, f"{self.folder}/{table}/{'part' if table == 'deletes' else 'segment'}={name}")
                total += fs.getContentSummary(p).getLength()
        return total

    def vacuum(self, keep: int = 1, idle: float = 3600) -> int:
        return snapshots.vacuum(self.spark, self.folder, keep, idle, tuple(TABLES))

