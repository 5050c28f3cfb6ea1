"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and marks of any script, lower-cased; a character of a script that is written without
spaces is a token of its own. A document and a benchmark item that share a seed (a run of MATCH tokens; an item
with fewer: all of it) are tiled: the maximal runs of equal tokens are found from the seeds that begin one (the tokens before
differ) and measured by Karp-Rabin hashes, the longest run of tokens that are unmarked on both sides becomes a
tile, and so on until none of MATCH tokens is left. A tile need not stand where it stands in the item, so reordered
passages are caught. The item leaks into the document if its tiles cover at least COVER of its tokens.

Seeds of the items go to every task; a benchmark of more than BLOCK bytes is taken in blocks of items,
each a pass over the documents. No document is shuffled.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import store
from trigrail.llm import text as tx

MATCH, COVER, BLOCK = 5, 0.5, 8 << 20
RESULT = "doc_id long, item_id long, coverage double, n_tokens int, n_covered int, n_tiles int, longest_tile int"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), *((n, pa.int32()) for n in ("n_tokens", "n_covered", "n_tiles", "longest_tile"))])
#: First and last characters of scripts that are written without spaces (Thai to Lao, Myanmar, Khmer, kana, Han). Fixed values.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
APART, INSIDE, SINGLE = 0, 1, 2


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower-case character) of every code point."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        one = chr(c)
        if one.isalnum() or unicodedata.category(one) in ("Mn", "Mc"):
            kind[c] = INSIDE
            if len(one.lower()) == 1:
                lower[c] = ord(one.lower())
    kind[0x20000:0x40000] = INSIDE
    for first, last in ALONE:
        kind[first : last + 1][kind[first : last + 1] == INSIDE] = SINGLE
    return kind, lower


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, bounds by text)."""
    kinds, lower = characters()
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    if len(points) < len(data):
        offs = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    kind = kinds[points]
    cut = np.zeros(len(points) + 1, bool)
    cut[offs] = True
    inside, single = kind == INSIDE, kind == SINGLE
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start = np.flatnonzero(begins | single)
    return tx.word_hashes(lower[points], start, np.flatnonzero(ends | single) + 1), np.searchsorted(start, offs)


class Sums:
    """Karp-Rabin hashes of any runs of tokens."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * tx.powers(tx.WINDOW_BASE, len(h)), out=self.sums[1:])
        self.down = tx.powers(tx.inverse(tx.WINDOW_BASE), len(h) + 1)

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]


class Items:
    """Benchmark items and where their seeds stand, by seed and by the token before."""

    def __init__(self, ids: list[int], texts: pa.Array, match: int):
        self.ids, self.match = ids, match
        self.hashes, self.bounds = tokens(*tx.buffers(texts))
        self.sums = Sums(self.hashes)
        lengths = np.diff(self.bounds)
        before = np.zeros(len(self.hashes), np.uint64)
        before[1:] = self.hashes[:-1]
        self.before = np.unique(before)
        rank = np.searchsorted(self.before, before) + 1
        rank[self.bounds[:-1][lengths > 0]] = 0  # before an item's first token is nothing, which equals no token
        self.seeds: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({min(int(n), match) for n in lengths if n}):
            h, some = tx.window_hashes(self.hashes, size), np.minimum(lengths, match) == size
            item = np.repeat(np.arange(len(ids)), lengths)[: len(h)]
            at = np.flatnonzero(tx.inside(self.bounds, size) & some[item])
            at = at[np.lexsort((rank[at], h[at]))]
            seed, which = np.unique(h[at], return_inverse=True)
            self.seeds[size] = (seed, np.searchsorted(which, np.arange(len(seed) + 1)), which * (len(self.before) + 1) + rank[at], item[at], at)

    def tokens(self, k: int) -> np.ndarray:
        return self.hashes[self.bounds[k] : self.bounds[k + 1]]

    def shared(self, doc: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
        """Of each item that shares a seed: (its seed's size, rows (place in the item, place in doc, length) of the maximal matches)."""
        out: dict[int, tuple[int, np.ndarray]] = {}
        sums = None
        for size, (seed, cut, key, item, at) in self.seeds.items():
            d = tx.window_hashes(doc, size)
            which = np.searchsorted(seed, d)
            there = np.flatnonzero(seed[np.minimum(which, len(seed) - 1)] == d)
            if not len(there):
                continue
            which = which[there]
            last = doc[there - 1]
            rank = np.searchsorted(self.before, last)
            known = (self.before[np.minimum(rank, len(self.before) - 1)] == last) & (there > 0)
            same = which * (len(self.before) + 1) + rank + 1
            lo, hi = cut[which], cut[which + 1]
            a = np.where(known, np.searchsorted(key, same), hi)  # between a and b the tokens before are equal too: the match began earlier
            b = np.where(known, np.searchsorted(key, same, "right"), hi)
            n = np.stack((a - lo, hi - b), 1).ravel()
            first = np.stack((lo, b), 1).ravel()
            one = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x, y = at[one], np.repeat(np.repeat(there, 2), n)
            if not len(x):
                continue
            sums = sums or Sums(doc)
            end, length = self.bounds[item[one] + 1], np.full(len(x), size)
            for bit in reversed(range(int(min((end - x).max(), len(doc))).bit_length())):
                step = 1 << bit
                more = np.flatnonzero((x + length + step <= end) & (y + length + step <= len(doc)))
                p, q = x[more] + length[more], y[more] + length[more]
                length[more[self.sums.of(p, step) == sums.of(q, step)]] += step
            order = np.argsort(item[one], kind="stable")
            edge = np.flatnonzero(np.diff(item[one][order], prepend=-1, append=-1))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                some = order[i:j]
                k = int(item[one[some[0]]])
                out[k] = (size, np.stack((x[some] - self.bounds[k], y[some], length[some]), 1))
        return out


def tile(matches: np.ndarray, size: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, length) from the maximal matches of size tokens at least.

    The longest match is marked, what marked tokens leave of a match comes up again by its length; ties go to the
    earlier place in the item, then in the document.
    """
    heap = [(-n, a, b) for a, b, n in matches.tolist()]
    heapq.heapify(heap)
    base = int(matches[:, 1].min())
    item, doc = np.zeros(n_item, bool), np.zeros(int((matches[:, 1] + matches[:, 2]).max()) - base, bool)
    tiles, left = [], n_item
    while heap and left >= size:
        n, a, b = heapq.heappop(heap)
        free = ~(item[a : a - n] | doc[b - base : b - base - n])
        if free.all():
            item[a : a - n] = doc[b - base : b - base - n] = True
            tiles.append((a, b, -n))
            left += n
        else:
            for s, e in tx.runs(free).tolist():
                if e - s >= size:
                    heapq.heappush(heap, (s - e, a + s, b + s))
    return tiles


def _tiled(items: Items, cover: float, ids: list, column: pa.Array) -> Iterator[pa.RecordBatch]:
    data, offs = tx.buffers(column)
    for i, j in tx.steps(offs):
        h, bounds = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        out: list[list] = [[] for _ in SCHEMA]
        for k in range(j - i):
            for item, (size, matches) in items.shared(h[bounds[k] : bounds[k + 1]]).items():
                n = len(items.tokens(item))
                tiles = tile(matches, size, n)
                covered = sum(t[2] for t in tiles)
                if covered >= cover * n:
                    for c, v in zip(out, (ids[i + k], items.ids[item], covered / n, n, covered, len(tiles), max(t[2] for t in tiles)), strict=True):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SCHEMA, strict=True)], schema=SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, *, match: int = MATCH, cover: float = COVER, block: int = BLOCK) -> DataFrame:
    """A row for each document and benchmark item that leaks into it: coverage, n_tokens, n_covered, n_tiles, longest_tile.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and empty texts leak
    nothing and get no row, nor do items without a token or an id. Rows of equal doc_id: see store.keyed;
    items of equal item_id are each compared, and the best coverage of an id is returned.
    """
    docs = store.keyed(docs)
    items = store.columns(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block) + 1
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow() if blocks > 1 else items.toArrow()
        index = Items(part.column("item_id").to_pylist(), part.column("text"), match)
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _tiled(sent.value, cover, batch.column(0).to_pylist(), batch.column(1))

        found = docs.mapInArrow(tx.lean(run), RESULT)
        out = found if out is None else out.unionByName(found)
    names = ("coverage", "n_tokens", "n_covered", "n_tiles", "longest_tile")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct(*names)).alias("best"))
    return best.select("doc_id", "item_id", *[f"best.{n}" for n in names])
