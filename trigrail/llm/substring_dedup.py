"""Substring dedup: Rabin-Karp hashes of every window of SIZE words, counted in Spark.

A word goes if some window over it has the words of a window that starts earlier (smaller doc_id, or
the same document and an earlier start). Removed windows merge into maximal intervals of words.

The windows' hashes go to their buckets eight bytes each (see fingerprints); what returns are bits, for
documents that have a repeat. Only those documents' texts are shuffled, the others are read in place.
Null, empty and short texts have no window and keep all their words. Rows of equal doc_id: see store.keyed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import fingerprints as fp
from trigrail.llm import store
from trigrail.llm import text as tx

SIZE = 20
#: Bytes of a word with its space, about: for the number of buckets only.
WORD = 6
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string, kept_sha256 string"


def _windows(size: int) -> fp.Prints:
    def prints(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, bounds = tx.words(data, offs)
        ok = tx.inside(bounds, size)
        p, salt = (tx.window_hashes(tx.word_hashes(data, start, end, seed), size, seed)[ok] for seed in (0, 7))
        n = np.maximum(np.diff(bounds) - size + 1, 0)
        return p, np.concatenate(([0], np.cumsum(n))), salt

    return prints


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _cut(ids: list, column: pa.Array, marks: fp.Marks | None, size: int, deal: fp.Deal, texts: bool) -> Iterator[pa.RecordBatch]:
    """Removes the words that flagged windows cover."""
    prints = _windows(size)
    data, offs = tx.buffers(column)
    for i, j in tx.steps(offs):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        start, end, bounds = tx.words(part, o)
        raw = part.tobytes()
        if marks is not None:
            p, pb, salt = prints(part, o)
            bucket = deal.bucket(p, salt)
        out: list[list] = [[] for _ in SCHEMA]
        for k in range(j - i):
            s, e = start[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]]
            gone = np.zeros(len(s), bool)
            if marks is not None:
                gone = tx.covered(marks.flags(ids[i + k], bucket[pb[k] : pb[k + 1]]), size, len(s))
            kept = b" ".join([raw[a:b] for a, b in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True)])
            row = (ids[i + k], len(s), int(gone.sum()), [{"start": a, "end": b} for a, b in tx.runs(gone).tolist()], kept.decode() if texts else None, hashlib.sha256(kept).hexdigest())
            for c, v in zip(out, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SCHEMA, strict=True)], schema=SCHEMA)


def remove_repeats(docs: DataFrame, *, size: int = SIZE, texts: bool = True) -> DataFrame:
    """One row per document: n_words, n_removed, spans (removed intervals of words), kept_text, kept_sha256.

    docs: doc_id, text; other columns are ignored. texts=False leaves kept_text null.
    """
    docs = store.keyed(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    flags, deal = fp.repeated(docs, _windows(size), total / WORD, total, earlier=True)
    flags = store.written(flags, "repeats")
    ids = store.sized(store.written(fp.flagged(flags), "repeat-ids"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut(batch.column(0).to_pylist(), batch.column(1), None, size, deal, texts)

    def part(rows: pa.Table, marks: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_cut(rows.column("doc_id").to_pylist(), rows.column("text"), fp.Marks(marks), size, deal, texts), SCHEMA)

    clean = docs.join(ids, "doc_id", "left_anti").mapInArrow(tx.lean(whole), RESULT)
    found = docs.join(ids, "doc_id", "left_semi").withColumn("share", deal.share())
    return clean.unionByName(found.groupBy("share").cogroup(flags.groupBy("share")).applyInArrow(tx.lean(part), RESULT))
