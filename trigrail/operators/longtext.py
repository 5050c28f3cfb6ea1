"""Trigram counts of long texts, where places of a substring can't be looked up one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a code point; characters that one step holds, about.
WIDTH, STEP = 21, 2_000_000


def trigram_stats(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(trigram, num_files, num_occurrences) over a text column, as dictionary() gives for paths.

    Code points are packed three to a number and counted in arrays; a task sends one row for each
    trigram of a step, not of a text. Null texts have none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, size = batch.column(0).to_pylist(), [], 0
            for i, t in enumerate(texts):
                held.append(t or "")
                size += len(held[-1])
                if size >= STEP or i == len(texts) - 1:
                    yield step(held)
                    held, size = [], 0

    def step(texts: list[str]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts])
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        gram = c[:-2] << (2 * WIDTH) | c[1:-1] << WIDTH | c[2:]
        text = np.repeat(np.arange(len(texts)), lengths)
        inside = text[:-2] == text[2:] if len(c) > 2 else np.zeros(0, bool)
        gram, text = gram[: len(inside)][inside], text[: len(inside)][inside]
        grams, which, total = np.unique(gram, return_inverse=True, return_counts=True)
        pairs = np.unique(which.astype(np.int64) * len(texts) + text)
        there = np.bincount(pairs // len(texts), minlength=len(grams))
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(there), pa.array(total)], names=["gram", "files", "occurrences"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy()
            c = np.stack((gram >> (2 * WIDTH), gram >> WIDTH & (1 << WIDTH) - 1, gram & (1 << WIDTH) - 1), 1).astype("<u4")
            names = [r.tobytes().decode("utf-32-le", "surrogatepass") for r in c]
            yield pa.RecordBatch.from_arrays([pa.array(names), *batch.columns[1:]], names=["trigram", "num_files", "num_occurrences"])

    sums = docs.select(column).mapInArrow(count, "gram long, files long, occurrences long").groupBy("gram").agg(F.sum("files").alias("num_files"), F.sum("occurrences").alias("num_occurrences"))
    return sums.mapInArrow(unpack, "trigram string, num_files long, num_occurrences long")
