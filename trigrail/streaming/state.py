"""Keyed state of change streams: records that come late or twice, and the halves of moves.

State is kept by Spark for each path (a streaming aggregate) and each move (transformWithState), in RocksDB, and follows the query's checkpoint. Records may come in
any order and any number of times: what goes on to the merge ends as the log in its order would.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trigrail.streaming.changes import classified

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVE = "cookie long, seq long, from_path string, to_path string, whole boolean"


def _keyed(rows: DataFrame, key: str):
    """rows by key; queries of this session then keep their state in RocksDB, which state of one's own needs."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(key)


def latest(changes: DataFrame) -> DataFrame:
    """Of a stream of change records, those that are news of their path: in a batch the last of each path, none that an earlier batch has overtaken or had.

    Records without a path or seq, or with an operation that changes nothing, are left out. The state is each path's record of the greatest seq, of equal ones that
    of the earliest batch, with the time of its batch (one for all its rows, the same if it is repeated): a record is news if it is of the present batch.
    """
    rows = classified(changes).where("action <> 'ignore' and path is not null and seq is not null")
    now = F.unix_millis(F.current_timestamp())
    rows = rows.withColumn("before", -now)
    best = F.max(F.struct("seq", "before", "op", "action", "permissions", "modified")).alias("best")
    return _keyed(rows, "path").agg(best).where(F.col("best.before") == -now).select("path", *[f"best.{c}" for c in ("seq", "op", "action", "permissions", "modified")])


class Halves(StatefulProcessor):
    """A move's halves, whichever comes first; one that waits in vain goes on alone."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.half = handle.getValueState("half", "seq long, from_path string, to_path string, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq, left, to, done = self.half.get() if self.half.exists() else (None, None, None, False)
        for r in sorted(rows, key=lambda r: r.seq):
            if r.op == "moved_from":
                left = left if left is not None else r.path
            else:
                to = to if to is not None else r.path
            seq = max(seq if seq is not None else r.seq, r.seq)
        whole = left is not None and to is not None
        if whole and not done:
            yield Row(cookie=key[0], seq=seq, from_path=left, to_path=to, whole=True)
        self.half.update((seq, left, to, done or whole))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seq, left, to, done = self.half.get()
        self.half.clear()
        if not done:
            yield Row(cookie=key[0], seq=seq, from_path=left, to_path=to, whole=False)

    def close(self) -> None:
        pass


def moves(changes: DataFrame, wait: int = 60_000) -> DataFrame:
    """(cookie, seq, from_path, to_path, whole): the two halves of each move as one row, joined by cookie. A half without a partner for wait milliseconds is a row with one path.

    A cookie is forgotten as long after its last record, until when repeated halves give no second row.
    """
    rows = changes.where(F.col("op").isin("moved_from", "moved_to") & F.col("cookie").isNotNull() & F.col("path").isNotNull())
    return _keyed(rows, "cookie").transformWithState(Halves(wait), MOVE, "Update", "ProcessingTime")
