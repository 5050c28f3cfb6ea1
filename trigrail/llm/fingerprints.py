"""Which 64-bit fingerprints of a corpus repeat, without a row for each.

A map task packs the fingerprints of many documents by bucket; one row holds a bucket's share of a
slice of documents: their ids, how many fingerprints each has there, which of these repeat an earlier one of
the slice (a bit each), and eight bytes for each distinct one. A hot fingerprint so leaves a slice
once, and a document of which a bucket has nothing but repeats of its slice is not sent there at all. Buckets
hold a bounded number of fingerprints. Up to FAN of them are chosen by a hash independent of the fingerprint (so
that the effective width is 64 bits and theirs); where a corpus needs more, each of these is split by the
fingerprint's own bits in a second step, in which rows of many slices become one, so that rows do not
shrink as the corpus grows. What returns are flags in the order of a document's fingerprints, with rows by
share of the documents, gathered in two steps too where there are more than FAN shares; a share's
flags then meet its texts in one task.

Slices, and with them the rows, follow from the order in which a task reads its rows, which is the same if it runs again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import text as tx

#: Fingerprints in a bucket, about; and in a slice of documents, or flags that are gathered at once.
BUCKET, SLICE = 1_000_000, 1_000_000
#: Most rows that a task makes of a slice; most tasks that a busy bucket's rows are dealt to in the second step.
FAN, SALT = 1024, 16
PACKED = "bucket long, docs binary, counts binary, repeats binary, prints binary"
PACKED_SCHEMA = pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in ("docs", "counts", "repeats", "prints"))])
#: Bytes of text in a share of documents, about.
SHARE = 4 << 20
FLAGS = "share long, docs binary, buckets binary, counts binary, flags binary"
FLAGS_SCHEMA = pa.schema([("share", pa.int64()), *((n, pa.binary()) for n in ("docs", "buckets", "counts", "flags"))])

#: From (bytes, offsets) of texts: (prints, bounds by text, salt hashes that choose the bucket).
Prints = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Deal:
    """How fingerprints are dealt to buckets, and documents to shares. prints: about how many there are; size: bytes of text."""

    def __init__(self, prints: float, size: float):
        buckets = max(24, int(prints // BUCKET) + 1)
        self.coarse = min(buckets, FAN)
        self.fine = -(-buckets // self.coarse)
        self.shares = max(53, int(size // SHARE) + 1)
        while any(self.shares % k == 0 for k in range(2, int(self.shares**0.5) + 1)):
            self.shares += 1  # a prime, so that ids in regular strides spread too

    def split(self, coarse: np.ndarray | int, prints: np.ndarray) -> np.ndarray:
        return coarse * self.fine + ((prints >> np.uint64(20)) % np.uint64(self.fine)).astype(np.int64)

    def bucket(self, prints: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return self.split(((salt >> np.uint64(20)) % np.uint64(self.coarse)).astype(np.int64), prints)

    def share(self):
        return F.pmod(F.col("doc_id"), F.lit(self.shares).cast("long"))


def ragged(start: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the items of the runs which, end to end; start, lengths: of all runs."""
    n = lengths[which]
    return np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1], [True])))


def first_of_equal(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the first of its equals, has equals), for values in their order of precedence."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    head = np.ones(len(v), bool)
    head[1:] = v[1:] != v[:-1]
    alone = head.copy()
    alone[:-1] &= head[1:]
    first, shared = np.empty(len(v), bool), np.empty(len(v), bool)
    first[order], shared[order] = head, ~alone
    return first, shared


def _batch(schema: pa.Schema, *row) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: v if isinstance(v, int) else v.tobytes() for f, v in zip(schema, row, strict=True)}], schema)


class Held:
    """Documents' fingerprints that a task gathers, brought to the order of ids."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray, prints: np.ndarray, bucket: np.ndarray) -> None:
        self.parts.append((ids, counts, prints, bucket))
        self.size += len(prints)

    def taken(self) -> tuple[np.ndarray, ...]:
        """(ids, counts, prints, buckets)."""
        ids, counts, prints, bucket = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.__init__()
        order = np.argsort(ids, kind="stable")
        at = ragged(np.cumsum(counts) - counts, counts, order)
        return ids[order], counts[order], prints[at], bucket[at]


def _runs(ids: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, places of its prints, its documents' ids, how many prints each has) of each bucket."""
    doc = np.repeat(np.arange(len(ids)), counts)
    order = np.argsort(bucket, kind="stable")
    edge = cuts(bucket[order])
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        at = order[lo:hi]
        head = cuts(doc[at])
        yield int(bucket[at[0]]), at, ids[doc[at[head[:-1]]]], np.diff(head)


def _dealt(ids: np.ndarray, counts: np.ndarray, prints: np.ndarray, coarse: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with every print, for the second step."""
    for b, at, docs, n in _runs(ids, counts, coarse):
        yield _batch(PACKED_SCHEMA, b, docs.astype("<i8"), n.astype("<u4"), np.zeros(0, np.uint8), prints[at])


def _slice(ids: np.ndarray, counts: np.ndarray, prints: np.ndarray, bucket: np.ndarray, earlier: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one slice; ids ascend, prints are in the order of ids. A row of a bucket below 0 has documents' repeats of which the flags are known: their buckets stand for repeats."""
    known: list[tuple] = []
    for b, at, docs, n in _runs(ids, counts, bucket):
        p = prints[at]
        first, shared = first_of_equal(p)
        new = np.add.reduceat(first, np.cumsum(n) - n) > 0
        if not new.all():
            known.append((docs[~new], n[~new], np.full((~new).sum(), b)))
            stays = np.repeat(new, n)
            docs, n, p, first, shared = docs[new], n[new], p[stays], first[stays], shared[stays]
        marks = np.packbits(~first) if earlier else np.packbits(np.concatenate((~first, shared)))
        yield _batch(PACKED_SCHEMA, b, docs.astype("<i8"), n.astype("<u4"), marks, p[first])
    if known:
        docs, n, b = (np.concatenate(k) for k in zip(*known, strict=True))
        yield _batch(PACKED_SCHEMA, -1 - int(docs.min() % (1 << 30)), docs.astype("<i8"), n.astype("<u4"), b.astype("<i8"), np.zeros(0, np.uint64))


def _pack(prints: Prints, deal: Deal, earlier: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def flush() -> Iterator[pa.RecordBatch]:
            ids, counts, p, bucket = held.taken()
            return _dealt(ids, counts, p, bucket // deal.fine) if deal.fine > 1 else _slice(ids, counts, p, bucket, earlier)

        for batch in batches:
            data, offs = tx.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tx.steps(offs):
                p, bounds, salt = prints(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                held.add(ids[i:j], np.diff(bounds), p, deal.bucket(p, salt))
                if held.size >= SLICE:
                    yield from flush()
        if held.parts:
            yield from flush()

    return run


def _split(deal: Deal, earlier: bool):
    """The second step: rows of a coarse bucket, in the order of buckets, to rows of its fine ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Held(), None
        for batch in batches:
            for b, docs, counts, _, raw in zip(*(batch.column(k) for k in range(5)), strict=True):
                if held.parts and (b.as_py() != now or held.size >= SLICE):
                    yield from _slice(*held.taken(), earlier)
                now, prints = b.as_py(), np.frombuffer(raw.as_py(), np.uint64)
                held.add(np.frombuffer(docs.as_py(), "<i8"), np.frombuffer(counts.as_py(), "<u4").astype(np.int64), prints, deal.split(now, prints))
        if held.parts:
            yield from _slice(*held.taken(), earlier)

    return run


def _by_share(docs: np.ndarray, buckets: np.ndarray, n: np.ndarray, flags: np.ndarray, share: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(share, kind="stable")
    edge, start = cuts(share[order]), np.cumsum(n) - n
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        at = order[lo:hi]
        yield _batch(FLAGS_SCHEMA, int(share[at[0]]), docs[at].astype("<i8"), buckets[at].astype("<i8"), n[at].astype("<u4"), np.packbits(flags[ragged(start, n, at)]))


def _resolve(earlier: bool, shares: int):
    def run(table: pa.Table) -> pa.Table:
        bucket, got, out = table.column("bucket")[0].as_py(), [], []
        for docs, counts, repeats, prints in zip(*(table.column(n) for n in ("docs", "counts", "repeats", "prints")), strict=True):
            ids, n = np.frombuffer(docs.as_py(), "<i8"), np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
            total = int(n.sum())
            if bucket < 0:
                out.append((ids, np.frombuffer(repeats.as_py(), "<i8"), n, np.ones(total, bool)))
            else:
                bits = np.unpackbits(np.frombuffer(repeats.as_py(), np.uint8), count=total * (1 if earlier else 2)).astype(bool)
                got.append((ids, n, bits, np.frombuffer(prints.as_py(), np.uint64)))
        if got:
            ids = np.concatenate([np.repeat(i, n)[~b[: n.sum()]] for i, n, b, _ in got])
            prints = np.concatenate([p for *_, p in got])
            order = np.argsort(ids, kind="stable")  # precedence: the smaller doc_id, then the place in the document
            first, shared = first_of_equal(prints[order])
            flag = np.empty(len(prints), bool)
            flag[order] = ~first if earlier else shared
        lo = 0
        for i, n, b, p in got:
            total = int(n.sum())
            repeat = b[:total]
            flags = repeat.copy() if earlier else b[:total] | b[total:]
            flags[~repeat] |= flag[lo : lo + len(p)]
            lo += len(p)
            some = np.add.reduceat(flags, np.cumsum(n) - n) > 0
            if some.any():
                out.append((i[some], np.full(some.sum(), bucket), n[some], flags[np.repeat(some, n)]))
        rows = []
        if out:
            docs, buckets, n, flags = (np.concatenate(x) for x in zip(*out, strict=True))
            rows = list(_by_share(docs, buckets, n, flags, docs % shares % FAN if shares > FAN else docs % shares))
        return pa.Table.from_batches(rows, FLAGS_SCHEMA)

    return run


def _entries(*columns) -> tuple[np.ndarray, ...]:
    """(docs, buckets, counts, flags) of rows of FLAGS, end to end."""
    parts = []
    for docs, buckets, counts, flags in zip(*columns, strict=True):
        n = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
        parts.append((np.frombuffer(docs.as_py(), "<i8"), np.frombuffer(buckets.as_py(), "<i8"), n, np.unpackbits(np.frombuffer(flags.as_py(), np.uint8), count=int(n.sum())).astype(bool)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (none, none, none, none.astype(bool))


def _regroup(shares: int):
    """The second step of the way back: rows of many shares, in the order of FAN kinds of these, to rows of each share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            docs, buckets, n, flags = (np.concatenate(p) for p in zip(*held, strict=True))
            return _by_share(docs, buckets, n, flags, docs % shares)

        for batch in batches:
            for k in range(batch.num_rows):
                kind = batch.column(0)[k].as_py()
                if held and (kind != now or size >= SLICE):
                    yield from flush()
                    held, size = [], 0
                now = kind
                held.append(_entries(*([batch.column(c)[k]] for c in range(1, 5))))
                size += len(held[-1][3])
        if held:
            yield from flush()

    return run


def _in_order(rows: DataFrame, by: str, salt: str) -> DataFrame:
    """Rows of one value of by go to SALT tasks at most: a busy one does not meet in one."""
    return rows.repartition(F.col(by), F.pmod(F.xxhash64(salt), F.lit(SALT))).sortWithinPartitions(by)


def repeated(docs: DataFrame, prints: Prints, total: float, size: float, *, earlier: bool) -> tuple[DataFrame, Deal]:
    """Flags of the fingerprints that occur elsewhere (earlier: at a smaller doc_id, or before in the document).

    docs: doc_id, text; doc_id unique. total: about how many fingerprints there are; size: bytes of
    text. Returns FLAGS, with entries only for documents with a set flag, and how all was dealt.
    """
    deal = Deal(total, size)
    rows = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(tx.lean(_pack(prints, deal, earlier)), PACKED)
    if deal.fine > 1:
        rows = _in_order(rows, "bucket", "docs").mapInArrow(tx.lean(_split(deal, earlier)), PACKED)
    flags = rows.groupBy("bucket").applyInArrow(tx.lean(_resolve(earlier, deal.shares)), FLAGS)
    if deal.shares > FAN:
        flags = _in_order(flags, "share", "docs").mapInArrow(tx.lean(_regroup(deal.shares)), FLAGS)
    return flags, deal


def flagged(flags: DataFrame) -> DataFrame:
    """doc_id of the documents that rows (share, docs) name."""

    def ids(table: pa.Table) -> pa.Table:
        some = [np.frombuffer(x.as_py(), "<i8") for x in table.column("docs")]
        return pa.table({"doc_id": pa.array(np.unique(np.concatenate(some)), pa.int64())})

    return flags.select("share", "docs").groupBy("share").applyInArrow(ids, "doc_id long")


class Marks:
    """A share's flags by document."""

    def __init__(self, table: pa.Table):
        doc, bucket, n, flags = _entries(*(table.column(c) for c in ("docs", "buckets", "counts", "flags")))
        order = np.lexsort((bucket, doc))
        self.flag = flags[ragged(np.cumsum(n) - n, n, order)]
        self.bucket, n = bucket[order], n[order]
        edge = cuts(doc[order])
        self.docs, self.edge = doc[order][edge[:-1]], edge
        self.start = np.concatenate(([0], np.cumsum(n)))

    def flags(self, doc: int, bucket: np.ndarray) -> np.ndarray:
        """The flags of a document's fingerprints, in their order; bucket: of each fingerprint."""
        out = np.zeros(len(bucket), bool)
        k = int(np.searchsorted(self.docs, doc))
        if k < len(self.docs) and self.docs[k] == doc:
            lo, hi = self.edge[k], self.edge[k + 1]
            order = np.argsort(bucket, kind="stable")
            out[order[np.isin(bucket[order], self.bucket[lo:hi])]] = self.flag[self.start[lo] : self.start[hi]]
        return out
