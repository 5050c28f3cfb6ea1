"""Line dedup: lines that stand in many documents go, looked up in a sharded minimal perfect hash.

A line's key is the line without blanks at its ends and with A-Z in lower case. Documents are cut into slices, each a row of a
written table with 64-bit hashes of its lines' keys. Distinct hashes of all slices, with the number of documents that
have them, are dealt to shards by their bits; a shard's task builds a minimal perfect hash of its own (levels of bit arrays, Limasset et al. 2017) that
gives each hash a slot of two arrays: a fingerprint and a count, saturated at a byte or four. These
arrays, some four bytes a distinct line, are the index. Slices then send each distinct hash once to its shard, packed, eight bytes a
hash, and get back those that are in too many documents: no line is joined, and a line that stands everywhere is one entry a slice.

Keys are equal if their hashes are: with d distinct lines, h of them to be dropped, about d * h / 2**64 others go too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import fingerprints as fp
from trigrail.llm import store
from trigrail.llm import text as tx

LEAST_CHARS, LEAST_DOCS = 1, 10
#: Lines of a slice of documents, about (a longer text is a slice of its own); lines of a shard, about; least and most shards.
SLICE, SHARD, FEW, MANY = 1 << 18, 1 << 20, 48, 1 << 14
#: Slots of a level for each hash that reaches it; levels after which the few hashes left are kept as they are.
SPACIOUS, LEVELS = 1.5, 32
SEED = 11
NEWLINE = 10


def lines(data: np.ndarray, offs: np.ndarray, least: int = LEAST_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each line's key, lines of each text). Keys of less than least code points have hash 0."""
    breaks = np.flatnonzero(data == NEWLINE)
    n = np.diff(np.searchsorted(breaks, offs)) + 1
    first = np.zeros(n.sum() + 1, bool)  # of a text, and behind the last one
    first[np.concatenate(([0], np.cumsum(n)))] = True
    start, end = np.empty(n.sum(), np.int64), np.empty(n.sum(), np.int64)
    start[first[:-1]], start[~first[:-1]] = offs[:-1], breaks + 1
    end[first[1:]], end[~first[1:]] = offs[1:], breaks
    from_, to, _ = tx.words(data, offs)
    a, b = np.searchsorted(from_, start), np.searchsorted(from_, end)
    some = a < b
    s, e = from_[a[some]], to[b[some] - 1]
    out = np.zeros(len(start), np.uint64)
    found = tx.word_hashes(tx.LOWER[data], s, e, SEED)
    found[found == 0] = 1
    if least > 1:
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        found[chars[e] - chars[s] < least] = 0
    out[some] = found
    return out, n


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: level by level, those alone in their place get its bit; a bit's rank is the slot."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        while len(keys) and len(self.levels) < LEVELS:
            size = -(-int(len(keys) * SPACIOUS + 1) // 64) * 64
            place = self.place(keys, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append(np.packbits(alone))
            keys = keys[~alone[place]]
        self.rest = np.sort(keys)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tx.mix(keys + np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each hash; of one that is not in it any slot, or -1."""
        out, open_, done = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, packed in enumerate(self.levels):
            bits = np.unpackbits(packed).astype(bool)
            rank = np.cumsum(bits) - 1
            place = self.place(keys[open_], level, len(bits))
            hit = bits[place]
            out[open_[hit]] = done + rank[place[hit]]
            open_, done = open_[~hit], done + int(bits.sum())
        if len(self.rest):
            at = np.searchsorted(self.rest, keys[open_]).clip(max=len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = done + at[same]
        return out

    def packed(self) -> tuple[bytes, bytes]:
        """(levels, end to end, before each its bytes in four; the rest)."""
        return b"".join(np.uint32(len(x)).tobytes() + x.tobytes() for x in self.levels), self.rest.tobytes()

    @classmethod
    def unpacked(cls, levels: bytes, rest: bytes) -> PerfectHash:
        out = cls(np.zeros(0, np.uint64))
        at = 0
        while at < len(levels):
            n = int(np.frombuffer(levels, np.uint32, 1, at)[0])
            out.levels.append(np.frombuffer(levels, np.uint8, n, at + 4))
            at += 4 + n
        out.rest = np.frombuffer(rest, np.uint64)
        return out


def _print(keys: np.ndarray) -> np.ndarray:
    """Sixteen bits of a hash that neither its shard nor its places are made of alone."""
    return (tx.mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)).astype(np.uint16)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def _column(table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in table.column(name)]


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys)."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    edge = fp.cuts(shard[order])
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(shard[order[lo]]), order[lo:hi]


SLICES = "slice long, docs binary, n_lines binary, hashes binary"
INDEX = "shard long, n_keys long, levels binary, rest binary, prints binary, counts binary"


def sliced(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """A written table of slices: their documents, how many lines each has, and the hashes of all lines, in order. slice is a doc_id of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            data, offs = tx.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tx.steps(offs):
                hashes, n = lines(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], least_chars)
                held.append((ids[i:j], n, hashes))
                size += len(hashes)
                if size >= SLICE:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    def row(held: list[tuple]) -> pa.RecordBatch:
        ids, n, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_pylist([{"slice": int(ids[0]), "docs": ids.tobytes(), "n_lines": n.astype("<u4").tobytes(), "hashes": hashes.tobytes()}])

    return store.written(docs.select("doc_id", "text").mapInArrow(tx.lean(run), SLICES), "slices")


def index(slices: DataFrame, shards: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """INDEX, a row a shard: the perfect hash of its distinct line hashes, and by slot a fingerprint and the documents that have the line, up to least_docs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, hashes in zip(_column(batch, "n_lines", "<u4"), _column(batch, "hashes", np.uint64), strict=True):
                doc = np.repeat(np.arange(len(n)), n)[hashes != 0]
                keys = hashes[hashes != 0]
                order = np.lexsort((doc, keys))
                keys, doc = keys[order], doc[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                keys, counts = np.unique(keys[new], return_counts=True)
                rows = [{"shard": s, "hashes": keys[at].tobytes(), "counts": counts[at].astype("<u4").tobytes()} for s, at in _dealt(keys, shards)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    def build(table: pa.Table) -> pa.Table:
        keys, counts = np.concatenate(_column(table, "hashes", np.uint64)), np.concatenate(_column(table, "counts", "<u4"))
        keys, which = np.unique(keys, return_inverse=True)
        counts = np.minimum(np.bincount(which, counts).astype(np.int64), least_docs)
        found = PerfectHash(keys)
        slot = found.slots(keys)
        prints, by_slot = np.empty(len(keys), np.uint16), np.empty(len(keys), np.uint8 if least_docs < 256 else np.uint32)
        prints[slot], by_slot[slot] = _print(keys), counts
        levels, rest = found.packed()
        return pa.Table.from_pylist([{"shard": table.column("shard")[0].as_py(), "n_keys": len(keys), "levels": levels, "rest": rest, "prints": prints.tobytes(), "counts": by_slot.tobytes()}])

    rows = slices.select("n_lines", "hashes").mapInArrow(tx.lean(pack), "shard long, hashes binary, counts binary")
    return store.written(rows.groupBy("shard").applyInArrow(tx.lean(build), INDEX), "line-index")


def probed(slices: DataFrame, known: DataFrame, shards: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(slice, hashes): which of a slice's hashes the index has with least_docs documents. Others (of new documents, say) are told by their fingerprints, but for one in 2**16."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, hashes in zip(batch.column("slice").to_pylist(), _column(batch, "hashes", np.uint64), strict=True):
                keys = np.unique(hashes[hashes != 0])
                rows = [{"shard": s, "slice": name, "hashes": keys[at].tobytes()} for s, at in _dealt(keys, shards)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        rows = []
        for r in shard.to_pylist():
            found = PerfectHash.unpacked(r["levels"], r["rest"])
            prints, counts = np.frombuffer(r["prints"], np.uint16), np.frombuffer(r["counts"], np.uint8 if least_docs < 256 else np.uint32)
            parts = _column(asked, "hashes", np.uint64)
            keys = np.concatenate([np.zeros(0, np.uint64), *parts])
            slot = found.slots(keys)
            there = slot >= 0
            there[there] = (prints[slot[there]] == _print(keys[there])) & (counts[slot[there]] >= least_docs)
            lo = 0
            for name, part in zip(asked.column("slice").to_pylist(), parts, strict=True):
                if (hit := there[lo : lo + len(part)]).any():
                    rows.append({"slice": name, "hashes": part[hit].tobytes()})
                lo += len(part)
        return pa.Table.from_pylist(rows, pa.schema([("slice", pa.int64()), ("hashes", pa.binary())]))

    asked = slices.select("slice", "hashes").mapInArrow(tx.lean(ask), "shard long, slice long, hashes binary")
    return asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(tx.lean(answer), "slice long, hashes binary")


def marked(slices: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, dropped): a bit for each line, for documents that lose one."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        out, some = [], _column(found, "hashes", np.uint64)
        many = np.unique(np.concatenate([np.zeros(0, np.uint64), *some]))
        for docs, n, hashes in zip(_column(rows, "docs", np.int64), _column(rows, "n_lines", "<u4"), _column(rows, "hashes", np.uint64), strict=True):
            gone = np.isin(hashes, many)
            edge = np.concatenate(([0], np.cumsum(n.astype(np.int64))))
            with_ = np.flatnonzero(np.add.reduceat(gone, edge[:-1]) > 0) if len(n) else []
            out += [{"doc_id": int(docs[k]), "dropped": np.packbits(gone[edge[k] : edge[k + 1]]).tobytes()} for k in with_]
        return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("dropped", pa.binary())]))

    return slices.groupBy("slice").cogroup(hits.groupBy("slice")).applyInArrow(tx.lean(run), "doc_id long, dropped binary")


RESULT = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for doc, text, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode()
            n, gone = raw.count(b"\n") + 1, 0
            if bits is not None:
                keep = np.unpackbits(np.frombuffer(bits, np.uint8), count=n) == 0
                gone = n - int(keep.sum())
                raw = b"\n".join(compress(raw.split(b"\n"), keep.tolist()))
            for c, v in zip(out, (doc, n, gone, raw.decode() if texts else None, hashlib.sha256(raw).hexdigest()), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def remove_lines(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, texts: bool = True) -> DataFrame:
    """One row per document: n_lines, n_dropped, kept_text, kept_sha256.

    docs: doc_id, text; other columns are ignored. Lines end at \\n. Lines whose key has least_chars code points and stands in least_docs
    documents are dropped from all of them; the others stay as they are, joined by \\n. Null or empty texts are one empty line, which stays: its key
    has no code point. Rows of equal doc_id: see store.keyed. Only texts that lose a line are shuffled. texts=False leaves kept_text null.
    """
    docs = store.keyed(docs)
    slices = sliced(docs, least_chars)
    total = slices.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    shards = min(MANY, max(FEW, total // 8 // SHARD + 1))
    dropped = store.written(marked(slices, probed(slices, index(slices, shards, least_docs), shards, least_docs)), "dropped")
    ids = store.sized(dropped.select("doc_id"))
    clean = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("binary").alias("dropped"))
    changed = docs.join(ids, "doc_id", "left_semi").join(dropped.hint("merge"), "doc_id").select("doc_id", "text", "dropped")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, texts)

    return clean.unionByName(changed).mapInArrow(tx.lean(cut), RESULT)
