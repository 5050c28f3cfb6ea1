"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random lines. Two vectors of cosine COSINE differ on a line by a
normal variable of known spread, so that a window of WINDOW spreads around a query catches such a pair
on a known share of the lines; LOSS calibrates how many of the windows a pair has to share before it is
verified by its cosine in double precision. So that no line is searched over all vectors, lines also form
tables: vectors of one label that fall into the same cell of a table's lines meet in one task, are
sorted by the table's first line, and each vector's window there yields the pairs whose collisions on
all lines are counted. The number of lines of a table grows with the logarithm of the vectors of a
label, and the number of tables follows from the recall that LOSS asks of a pair at the threshold.

Equal vectors form a class with one representative and a weight. A cell of more than CELL of these is
dealt out in blocks, every two of which meet. Tasks return what each vector gathers, never pairs.

Tables that grow with the vectors are joined by merging: the size of a compressed scratch table says little of what the driver would hold to broadcast it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import store
from trigrail.llm import text as tx
from trigrail.llm.components import components

COSINE, WINDOW, LOSS, CELL = 0.98, 2.0, 1e-4, 1500
#: Width of a cell along a line (unit vectors spread by 1), and vectors that a cell of random ones holds, about.
WIDTH, FILL = 1.0, 100
VALID = "vec_id long, label string, vector binary"
MET = "id long, links long, low long"


def spread(cosine: float) -> float:
    """Standard deviation of the difference of two unit vectors of this cosine along a normal line."""
    return math.sqrt(2 - 2 * cosine)


def tables_for(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(tables, lines of each) for so many vectors of a label."""
    alike = 0.27  # of two random vectors, share of lines with the same cell
    lines = min(10, max(2, round(math.log(max(vectors, 1) / FILL) / -math.log(alike)) if vectors > FILL else 2))
    together = (1 - spread(cosine) * math.sqrt(2 / math.pi) / WIDTH) ** lines * math.erf(WINDOW / math.sqrt(2))
    return math.ceil(math.log(LOSS) / math.log(1 - together)), lines


def needed(lines: int) -> int:
    """The most collisions on so many lines that a pair at the threshold has but for a share LOSS."""
    hit = math.erf(WINDOW / math.sqrt(2))
    below = 0.0
    for c in range(lines + 1):
        below += math.comb(lines, c) * hit**c * (1 - hit) ** (lines - c)
        if below > LOSS:
            return c
    return lines


def lines_of(dimension: int, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(normal directions [dimension, lines], offsets of their cells)."""
    rng = np.random.default_rng(dimension)
    return rng.standard_normal((dimension, lines)), rng.uniform(0, WIDTH, lines)


def _valid(kind: str):
    """Ids, labels with the vector's length, and vectors as bytes of their own kind of number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, labels = [], [], []
            for i, v, label in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if v and None not in v:
                    x = np.array(v, kind)
                    if np.isfinite(x).all() and x.any():
                        ids.append(i)
                        labels.append(f"{label}/{len(x)}")
                        out.append((x + x.dtype.type(0)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"])

    return run


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _cells(tables: int, lines: int, kind: str):
    """(id, label, vector) to a row for each table with its cell, without the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                to, shift = lines_of(size // np.dtype(kind).itemsize, tables * lines)
                cell = np.floor((_unit([vectors[k] for k in at], kind) @ to + shift) / WIDTH).astype("<i4")
                rows = batch.select(["id", "label"]).take(pa.array(at))
                for t in range(tables):
                    key = [c.tobytes() for c in np.ascontiguousarray(cell[:, t * lines : (t + 1) * lines])]
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([t] * len(at), pa.int32()), pa.array(key, pa.binary())], names=["id", "label", "table", "cell"])

    return run


def links_of(unit: np.ndarray, block: np.ndarray, apart: bool, table: int, tables: int, lines: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (x, y) of a cell's vectors, each only in the first table that brings them together (one cell, one window on its first line).

    apart: only pairs of different blocks.
    """
    to, shift = lines_of(unit.shape[1], tables * lines)
    on = unit @ to
    cell = np.floor((on + shift) / WIDTH).astype(np.int32).reshape(len(unit), tables, lines)
    half, least = WINDOW * spread(cosine), needed(tables * lines)
    order = np.argsort(on[:, table * lines], kind="stable")
    on, cell, unit, block = on[order].astype(np.float32), cell[order], unit[order], block[order]
    along, found = on[:, table * lines], []
    for k in range(0, len(on), 256):
        q = slice(k, min(k + 256, len(on)))
        lo, hi = k, int(np.searchsorted(along, along[q.stop - 1] + half, "right"))
        count = np.zeros((q.stop - k, hi - lo), np.uint16)  # of a few hundred lines
        for m in range(on.shape[1]):
            count += np.abs(on[q, m, None] - on[None, lo:hi, m]) <= half
        x, y = np.nonzero(count >= least)
        x, y = x + k, y + lo
        ok = (x < y) & (np.abs(along[x] - along[y]) <= half) & ((block[x] != block[y]) | (not apart))
        x, y = x[ok], y[ok]
        if table:
            first = np.abs(on[x][:, : table * lines : lines] - on[y][:, : table * lines : lines]) <= half
            ok = ~((cell[x, :table] == cell[y, :table]).all(2) & first).any(1)
            x, y = x[ok], y[ok]
        ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine if len(x) else np.zeros(0, bool)
        found.append((order[x[ok]], order[y[ok]]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def lowest(n: int, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each of n vertices the smallest id of its component under the edges (x, y)."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        if (new == low).all():
            return low
        low = new


def _meet(tables: int, lines: int, cosine: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        cell = np.unique(np.array(table.column("tile").to_pylist(), np.int64), return_inverse=True)[1]
        order = np.argsort(cell, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(cell[order]) > 0, [True])))
        ids, weight, block, cross, of = (table.column(c).to_numpy() for c in ("id", "weight", "block", "cross", "table"))
        vectors = table.column("vector")
        out: list[tuple] = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at = order[a:b]
            if len(at) > 1:
                x, y = links_of(_unit(vectors.take(pa.array(at)).to_pylist(), kind), block[at], bool(cross[at[0]]), int(of[at[0]]), tables, lines, cosine)
                if len(x):
                    w, n = weight[at], len(at)
                    links = np.bincount(x, w[y], n) + np.bincount(y, w[x], n)
                    met = np.flatnonzero(links)
                    out.append((ids[at][met], links[met].astype(np.int64), lowest(n, x, y, ids[at])[met]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("id", "links", "low"), cols, strict=True)})

    return run


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """One row per vector: n_links, component_id (smallest vec_id reachable by links), kept (vec_id = component_id).

    vectors: vec_id, embedding, label; other columns are ignored. Vectors link if their labels are equal,
    not null, and their cosine is at least cosine. Null, empty and zero vectors, vectors with null or
    non-finite components, and vectors of different lengths link with nothing. Rows without vec_id are
    left out; rows that share one count once, as the one with the smallest label and vector.
    """
    rows = store.columns(vectors, "vec_id", "embedding", "label").where("vec_id is not null")
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("one")).select("vec_id", "one.embedding", "one.label")
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    known = rows.where("label is not null").select("vec_id", F.col("embedding").cast(f"array<{'float' if kind == '<f4' else 'double'}>"), F.col("label").cast("string"))
    valid = store.written(known.mapInArrow(tx.lean(_valid(kind)), VALID), "vectors")
    digest = F.sha2(F.concat("label", F.lit("/"), F.hex("vector")).cast("binary"), 256)
    member = store.written(valid.select("vec_id", "label", digest.alias("digest")), "members")
    classes = store.written(member.groupBy("digest", "label").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, lines = tables_for(most, cosine)
    reps = store.written(classes.select("id", "weight").join(valid.withColumnRenamed("vec_id", "id").hint("merge"), "id").select("id", "label", "vector", "weight"), "reps")
    cells = store.written(reps.select("id", "label", "vector").mapInArrow(tx.lean(_cells(tables, lines, kind)), "id long, label string, table int, cell binary"), "cells")
    full = cells.groupBy("label", "table", "cell").agg(F.count("*").alias("n")).where("n > 1")
    full = full.select("label", "table", "cell", F.when(F.col("n") <= cell, 1).otherwise(F.ceil(F.col("n") * 2 / cell)).cast("int").alias("s"), "n")
    dealt = cells.join(full.hint("merge"), ["label", "table", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    tile = F.xxhash64("label", "table", "cell", F.least("block", "j"), F.greatest("block", "j"))
    dealt = dealt.select("id", "table", "block", (F.col("block") != F.col("j")).alias("cross"), tile.alias("tile"))
    shares = max(24, (full.agg(F.sum(F.col("n") * F.col("s"))).first()[0] or 0) // 20_000 + 1)  # rows of blocks, copies counted
    dealt = dealt.join(reps.select("id", "weight", "vector").hint("merge"), "id").withColumn("share", F.pmod(F.col("tile"), F.lit(shares)))
    met = dealt.groupBy("share").applyInArrow(tx.lean(_meet(tables, lines, cosine, kind)), MET)
    met = store.written(met, "met")
    parts = components(met.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    to = classes.join(links.hint("merge"), "id", "left").join(parts.hint("merge"), "id", "left")
    to = to.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("c"))
    out = rows.select("vec_id").join(store.spread_join(member, to, ["digest"], "vec_id").select("vec_id", "links", "c").hint("merge"), "vec_id", "left")
    own = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (own == F.col("vec_id")).alias("kept"))
