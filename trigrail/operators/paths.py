"""A dictionary of sorted paths in blocks: each path is what it shares with the one before it, and its own tail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths of a block.
BLOCK = 128

PACKED = "head string, last string, n int, ids array<long>, shared array<int>, sizes array<int>, tails binary"


def packed(files: DataFrame) -> DataFrame:
    """Files (id, path) as a row for each BLOCK paths in the order of their bytes; without null paths. Equal paths are kept, by id.

    Blocks are in order within tasks and tasks in order of paths, so that the written table's row groups have narrow ranges of head and last.
    """
    rows = files.select("id", "path").where(F.col("path").isNotNull())
    return rows.repartitionByRange("path", "id").sortWithinPartitions("path", "id").mapInArrow(_pack, PACKED)


def _shared(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many first bytes each string has in common with the one before it; the first one has none."""
    size = np.diff(starts)
    most = np.concatenate([[0], np.minimum(size[1:], size[:-1])])
    ends = np.cumsum(most)
    at = np.arange(ends[-1]) - np.repeat(ends - most, most)
    differ = np.flatnonzero(data[at + np.repeat(starts[:-1], most)] != data[at + np.repeat(np.concatenate([[0], starts[:-2]]), most)])
    differ = np.append(differ, ends[-1])
    return np.minimum(differ[np.searchsorted(differ, ends - most)], ends) - (ends - most)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            paths = [p.encode() for p in part.column("path").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
            shared = _shared(np.frombuffer(b"".join(paths), np.uint8), starts)
            tails = b"".join(p[s:] for p, s in zip(paths, shared, strict=True))
            rows.append((paths[0].decode(), paths[-1].decode(), len(paths), part.column("id"), shared.tolist(), (np.diff(starts) - shared).tolist(), tails))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        names = ["head", "last", "n", "ids", "shared", "sizes", "tails"]
        yield pa.RecordBatch.from_arrays([pa.array([v.to_pylist() if isinstance(v, pa.Array) else v for v in c], t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            paths, path, at = [], b"", 0
            for shared, size in zip(r["shared"], r["sizes"], strict=True):
                path, at = path[:shared] + r["tails"][at : at + size], at + size
                paths.append(path.decode())
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(paths, pa.string())], ["id", "path"])


def unpacked(blocks: DataFrame) -> DataFrame:
    """(id, path) of blocks."""
    return blocks.select("ids", "shared", "sizes", "tails").mapInArrow(_unpack, "id long, path string")


def holding(blocks: DataFrame, start: str) -> DataFrame:
    """The blocks in which a path could begin with start. The conditions are pushed down to the scan."""
    return blocks.where((F.col("last") >= start) & ((F.col("head") <= start) | F.col("head").startswith(start)))


def starting(blocks: DataFrame, start: str) -> DataFrame:
    """(id, path) of the paths that begin with start (all if it is empty)."""
    return unpacked(holding(blocks, start)).where(F.col("path").startswith(start))


def under(blocks: DataFrame, folder: str) -> DataFrame:
    """(id, path) of what is below a folder, at any depth; the folder itself isn't."""
    return starting(blocks, folder.rstrip("/") + "/")


def exact(blocks: DataFrame, path: str) -> DataFrame:
    """(id, path) of the files of this path."""
    return unpacked(blocks.where((F.col("head") <= path) & (F.col("last") >= path))).where(F.col("path") == path)
