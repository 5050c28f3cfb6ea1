"""Suffix-array dedup: maximal repeats from the interval tree of an enhanced suffix array.

A full suffix array of a corpus holds a pointer for every byte. This one is sparse: of every SIZE - GRAM + 1
successive positions, the leftmost one whose GRAM bytes hash least is an anchor. Equal strings of SIZE
bytes choose the same anchor at the same offset, so every repeat of SIZE bytes shows up at anchors with
equal grams. Grams that stand once in the corpus are set aside (fingerprints); for the rest, the bytes
around the anchor that a string of SIZE bytes through it can reach go to the gram's part. There the
suffixes from the anchors are sorted, common prefixes of neighbours are measured, and a stack scan visits
every interval of suffixes with a common prefix. Members whose left extensions differ make the interval
a maximal repeat; each member's longest left extension common with another member and the interval's
depth bound the repeated bytes around it. All members of an interval count, not just neighbours.

Of equal surroundings a share of the documents sends one, and gets one span back: the places where they stand never leave their share.

Equal texts are told by digest first: of each such class one document goes on. A gram with more
than HOT rows of surroundings departs from the tree, as it does not meet in one task: all SIZE-byte strings in them are counted as
fingerprints instead, which splits without limit and gives the same bytes.

Texts are UTF-8 bytes; null counts as empty; matches never cross documents. Rows of equal doc_id: see store.keyed.
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

SIZE, GRAM, HOT = 200, 50, 2_000
#: Bytes of text for each part of the suffix array, about.
PART = 4 << 20
AROUND = "share long, k int, gram long, part long, left binary, right binary, several boolean, docs binary, at binary"
COVER = "share long, k int, l int, r int"
RESULT = "doc_id long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"
BYTES = tx.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(tx.WORD_BASE))


def _leftmost_least(g: np.ndarray, wide: int) -> np.ndarray:
    """Of every run of wide values the place of the leftmost least one."""
    least, place, reach = g, np.arange(len(g)), 1
    while reach < wide:
        step = min(reach, wide - reach)
        a, b = least[:-step], least[step:]
        later = b < a
        least, place = np.where(later, b, a), np.where(later, place[step:], place[:-step])
        reach += step
    return place


def anchors(data: np.ndarray, offs: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in data, gram hashes, bounds by text, salts) of the anchors."""
    ok, found = tx.inside(offs, size), []
    for lo in range(0, len(ok), tx.BLOCK):  # the strings that start there
        hi = min(len(ok), lo + tx.BLOCK)
        h = BYTES[data[lo : hi + size - 1]]
        g = tx.window_hashes(h, gram)
        at = np.unique(_leftmost_least(g, size - gram + 1)[ok[lo:hi]])
        found.append((at + lo, g[at], tx.window_hashes(h, gram, seed=7)[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.uint64)
    at, g, salt = (np.concatenate(f) for f in zip(*found, strict=True))
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > np.maximum.accumulate(at)[:-1]  # blocks share anchors at their ends
    return at[new], g[new], np.searchsorted(at[new], offs), salt[new]


def _prints(size: int, gram: int) -> fp.Prints:
    def prints(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, g, bounds, salt = anchors(data, offs, size, gram)
        return g, bounds, salt

    return prints


def _own_strings(data: np.ndarray, offs: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in data, bounds by row) of the strings whose anchor is the row's.

    A row is two bytes that hold how many bytes lie before the anchor, and the surroundings. Strings
    that another anchor stands for are counted there, so that none is met twice at one place.
    """
    g = tx.window_hashes(BYTES[data], gram)
    if len(g) < size - gram + 1:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    place = _leftmost_least(g, size - gram + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(place)]
    first = offs[:-1] + 2
    anchor = first + data[offs[:-1]].astype(np.int64) * 256 + data[offs[:-1] + 1]
    starts = np.flatnonzero(tx.inside(offs, size) & (np.arange(len(place)) >= first[row]) & (place == anchor[row]))
    return starts, np.searchsorted(starts, offs)


def _strings(size: int, gram: int) -> fp.Prints:
    def prints(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, bounds = _own_strings(data, offs, size, gram)
        h = BYTES[data]
        return tx.window_hashes(h, size)[starts], bounds, tx.window_hashes(h, size, seed=7)[starts]

    return prints


def _surroundings(size: int, gram: int, deal: fp.Deal, parts: int):
    """What a string of size bytes through a repeated anchor can reach; equal ones of a share are one row."""

    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        flags, ids = fp.Marks(marks), rows.column("doc_id").to_pylist()
        data, offs = tx.buffers(rows.column("text"))
        seen: dict[tuple[int, bytes, bytes], list] = {}
        for i, j in tx.steps(offs):
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            at, grams, bounds, salt = anchors(part, o, size, gram)
            bucket, raw = deal.bucket(grams, salt), part.tobytes()
            for k in range(j - i):
                lo, hi, a, b = int(o[k]), int(o[k + 1]), bounds[k], bounds[k + 1]
                keep = flags.flags(ids[i + k], bucket[a:b])
                for p, g in zip(at[a:b][keep].tolist(), grams[a:b][keep].view(np.int64).tolist(), strict=True):
                    key = (g, raw[max(lo, p - size + gram) : p], raw[p : min(hi, p + size)])
                    seen.setdefault(key, []).append((ids[i + k], p - lo))
        keys = list(seen)
        places = [np.array(seen[k], "<i8").reshape(-1, 2) for k in keys]
        g = np.array([k[0] for k in keys], np.int64)
        return pa.table(
            {
                "share": np.full(len(keys), rows.column("share")[0].as_py() if len(rows) else 0, np.int64), "k": np.arange(len(keys), dtype=np.int32), "gram": g, "part": g % parts,
                "left": pa.array([k[1] for k in keys], pa.binary()), "right": pa.array([k[2] for k in keys], pa.binary()), "several": np.array([len(x) > 1 for x in places], bool),
                "docs": pa.array([x[:, 0].tobytes() for x in places], pa.binary()), "at": pa.array([x[:, 1].tobytes() for x in places], pa.binary()),
            }
        )

    return run


def common(a: list[bytes]) -> list[int]:
    """Lengths of the common prefixes of neighbours."""
    out = []
    for x, y in zip(a, a[1:], strict=False):
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            out.append(n)
        else:
            u, v = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
            out.append(int(np.argmax(u != v)))
    return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last + 1) of every interval of sorted suffixes with a common prefix, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, 0]):
        start = i
        while stack and stack[-1][0] > depth:
            deep, start = stack.pop()
            yield deep, start, i + 1
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


class Least:
    """The least of values[a:b], for many a < b at once."""

    def __init__(self, values: list[int]):
        self.levels = [np.array(values, np.int32)]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int32)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - 2**k])
        return out


class Repeats:
    """The repeats around the anchors of one gram: rows (left bytes reversed, right bytes, stands at several places, what the caller knows it by), all different."""

    def __init__(self, rows: list[tuple[bytes, bytes, bool, object]], size: int):
        self.rows, self.size = sorted(rows, key=lambda r: r[1]), size
        self.lcp = common([r[1] for r in self.rows])
        by_left = sorted(range(len(rows)), key=lambda k: self.rows[k][0])
        self.rank = np.empty(len(rows), np.int64)
        self.rank[by_left] = np.arange(len(rows))
        self.near = Least(common([self.rows[k][0] for k in by_left]))

    def extensions(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of an interval in the order of their left bytes, and the common left bytes of neighbours."""
        rank = self.rank[first:last]
        order = np.argsort(rank)
        rank = rank[order]
        return order + first, self.near.of(rank[:-1], rank[1:])

    def covers(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes to the left, bytes to the right) of each row: around its anchor these lie in repeated strings of size bytes; -1, -1 if none do.

        Whatever an interval covers has the anchor in it, so that a row's covers are one span.
        """
        left, right = (np.array([len(r[k]) if r[2] and len(r[0]) + len(r[1]) >= self.size else -1 for r in self.rows], np.int64) for k in (0, 1))
        for depth, first, last in intervals(self.lcp):
            order, near = self.extensions(first, last)
            best = np.zeros(len(order), np.int64)
            best[1:] = near
            best[:-1] = np.maximum(best[:-1], near)
            ok = best + depth >= self.size
            some = order[ok]
            left[some], right[some] = np.maximum(left[some], best[ok]), np.maximum(right[some], depth)
        return left, right

    def maximal(self) -> Iterator[tuple[int, int, list[int]]]:
        """(bytes to the left, bytes to the right, rows) of each maximal repeat of size bytes at least.

        An interval whose members' left extensions are all alike is not maximal as it is: it is widened
        to the left until they differ; subsets that stay alike for longer are intervals of the sorted left bytes.
        """
        for k, (left, right, several, _) in enumerate(self.rows):
            if several and len(left) + len(right) >= self.size:
                yield len(left), len(right), [k]
        for depth, first, last in intervals(self.lcp):
            order, near = self.extensions(first, last)
            widths = list(intervals(near.tolist()))
            if near.min() == 0:
                widths.append((0, 0, len(order)))
            for left, a, b in widths:
                some = order[a:b].tolist()
                right = {self.rows[k][1][depth : depth + 1] for k in some}
                if left + depth >= self.size and (len(right) > 1 or b"" in right):
                    yield left, depth, some


def _groups(table: pa.Table) -> Iterator[list[tuple[bytes, bytes, bool, np.ndarray]]]:
    """Rows of each gram, equal ones of different shares made one, with their places in the table; only grams that stand twice."""
    found: dict[int, dict[tuple[bytes, bytes], list[int]]] = {}
    several = table.column("several").to_numpy(zero_copy_only=False)
    for k, (g, left, right) in enumerate(zip(*(table.column(c).to_pylist() for c in ("gram", "left", "right")), strict=True)):
        found.setdefault(g, {}).setdefault((left[::-1], right), []).append(k)
    for rows in found.values():
        out = [(*key, len(at) > 1 or bool(several[at[0]]), np.array(at)) for key, at in rows.items()]
        if len(out) > 1 or out[0][2]:
            yield out


def _covers(size: int):
    def run(table: pa.Table) -> pa.Table:
        at, l, r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in _groups(table):
            repeats = Repeats(rows, size)
            for row, left, right in zip(repeats.rows, *(x.tolist() for x in repeats.covers()), strict=True):
                if left >= 0:
                    at.append(row[3])
                    l.append(np.full(len(row[3]), left))
                    r.append(np.full(len(row[3]), right))
        some = table.select(["share", "k"]).take(pa.array(np.concatenate(at)))
        return some.append_column("l", pa.array(np.concatenate(l), pa.int32())).append_column("r", pa.array(np.concatenate(r), pa.int32()))

    return run


def _hot_covers(size: int, gram: int, deal: fp.Deal):
    """Of hot rows: the span of the strings that flags call repeated."""
    prints = _strings(size, gram)

    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        flags, out = fp.Marks(marks), []
        ids, several = (rows.column(c).to_pylist() for c in ("doc_id", "several"))
        data, offs = tx.buffers(rows.column("text"))
        for i, j in tx.steps(offs):
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, bounds = _own_strings(part, o, size, gram)
            p, _, salt = prints(part, o)
            bucket = deal.bucket(p, salt)
            for k in range(j - i):
                hit = flags.flags(ids[i + k], bucket[bounds[k] : bounds[k + 1]]) | several[i + k]
                mine = starts[bounds[k] : bounds[k + 1]][hit] - o[k] - 2 - (int(part[o[k]]) * 256 + int(part[o[k] + 1]))
                if len(mine):  # each has the anchor in it
                    out.append((i + k, -int(mine[0]), int(mine[-1]) + size))
        at, l, r = np.array(out, np.int64).reshape(-1, 3).T
        some = rows.select(["in", "k"]).take(pa.array(at)).rename_columns(["share", "k"])
        return some.append_column("l", pa.array(l, pa.int32())).append_column("r", pa.array(r, pa.int32()))

    return run


def _cut(texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(rows: pa.Table, covers: pa.Table) -> pa.Table:
        n = np.array([len(x.as_py()) // 8 for x in covers.column("docs")], np.int64)
        doc, at = (np.frombuffer(b"".join(covers.column(c).to_pylist()), "<i8") for c in ("docs", "at"))
        left, right = (np.repeat(covers.column(c).to_numpy(), n) for c in ("l", "r"))
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order], (at - left)[order], (at + right)[order]
        out: list[list] = [[] for _ in schema]
        for one, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
            raw = (text.as_py() or "").encode()
            step = np.zeros(len(raw) + 1, np.int32)
            mine = slice(*np.searchsorted(doc, [one, one + 1]).tolist())
            np.add.at(step, start[mine], 1)
            np.add.at(step, end[mine], -1)
            gone = tx.runs(np.cumsum(step[:-1]) > 0).tolist()
            kept, last = [], 0
            for a, b in [*gone, (len(raw), len(raw))]:
                kept.append(raw[last:a])
                last = b
            kept = b"".join(kept)
            for c, v in zip(out, (one, len(raw) - len(kept), [{"start": a, "end": b} for a, b in gone], kept if texts else None, hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _around(docs: DataFrame, size: int, gram: int, total: int, earlier_copies: DataFrame) -> tuple[DataFrame, fp.Deal]:
    """The written surroundings of repeated anchors, and how documents were dealt to shares."""
    work = docs.join(store.sized(earlier_copies), "doc_id", "left_anti")
    flags, deal = fp.repeated(work, _prints(size, gram), 2 * total / (size - gram + 2), total, earlier=False)
    flags = store.written(flags, "anchors")
    ids = store.sized(store.written(fp.flagged(flags), "anchored"))
    found = work.join(ids, "doc_id", "left_semi").withColumn("share", deal.share())
    parts = max(48, total // PART + 1)
    rows = found.groupBy("share").cogroup(flags.groupBy("share")).applyInArrow(tx.lean(_surroundings(size, gram, deal, parts)), AROUND)
    return store.written(rows, "surroundings"), deal


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_bytes, digest) of all; digests of several documents; all but the first of their documents."""
    content = F.coalesce("text", F.lit(""))
    info = store.written(docs.select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest")), "texts")
    several = store.written(info.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("digest", "first"), "several")
    others = store.spread_join(info, several, ["digest"], "doc_id").where("doc_id <> first").select("doc_id")
    return info, several, store.written(others, "copies")


def remove_repeats(docs: DataFrame, *, size: int = SIZE, gram: int = GRAM, hot: int = HOT, texts: bool = True) -> DataFrame:
    """Removes each byte covered by a string of size bytes that also starts anywhere else in the corpus.

    One row per document: n_bytes, n_removed, spans (maximal removed runs of bytes), kept (the other
    bytes; texts=False: null), kept_sha256. docs: doc_id, text; other columns are ignored.
    """
    docs = store.keyed(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    info, several, copies = _classes(docs)
    around, deal = _around(docs, size, gram, total, copies)
    heavy = store.written(around.groupBy("gram").count().where(F.col("count") > hot).select("gram"), "hot-grams")
    texts_around = around.select("share", "k", "gram", "part", "left", "right", "several")
    normal = texts_around.join(store.sized(heavy), "gram", "left_anti")
    covers = normal.groupBy("part").applyInArrow(tx.lean(_covers(size)), COVER)
    if not heavy.isEmpty():
        rows = texts_around.join(store.sized(heavy), "gram", "left_semi")
        head = F.unhex(F.lpad(F.hex(F.octet_length("left").cast("long")), 4, "0"))
        rows = store.written(rows.select(F.monotonically_increasing_id().alias("doc_id"), F.concat(head, "left", "right").alias("text"), F.col("share").alias("in"), "k", "several"), "hot-rows")
        n, long = rows.agg(F.count("*") * (size - gram + 1), F.sum(F.octet_length("text"))).first()
        flags, dealt = fp.repeated(rows, _strings(size, gram), n, long, earlier=False)
        some = rows.withColumn("share", dealt.share()).groupBy("share").cogroup(store.written(flags, "hot-strings").groupBy("share"))
        covers = covers.unionByName(some.applyInArrow(tx.lean(_hot_covers(size, gram, dealt)), COVER))
    covers = store.written(covers, "covers")
    placed = store.written(around.select("share", "k", "docs", "at").join(covers, ["share", "k"]), "placed")
    ids = store.sized(store.written(fp.flagged(placed), "covered"))
    found = docs.join(ids, "doc_id", "left_semi").withColumn("share", deal.share())
    cut = found.groupBy("share").cogroup(placed.groupBy("share")).applyInArrow(tx.lean(_cut(texts)), RESULT)
    empty = F.unhex(F.lit(""))
    state = store.spread_join(info, several.select("digest", F.lit(True).alias("twice")), ["digest"], "doc_id", "left").join(cut.hint("merge"), "doc_id", "left")
    whole = F.col("twice") & (F.col("n_bytes") >= size)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = state.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, all_).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, empty).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.sha2(empty, 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    if not texts:
        return out.withColumn("kept", F.lit(None).cast("binary"))
    uncut = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("all"))
    return out.join(uncut, "doc_id").withColumn("kept", F.coalesce("kept", "all")).drop("all")


def maximal_repeats(docs: DataFrame, *, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Maximal repeats of size bytes at least with all their occurrences: gram, nth, length (bytes), doc_id, start, one row an occurrence.

    Rows of equal (gram, nth) are a group. Repeats are followed as far as a string of size bytes through the anchor
    reaches; a longer one has groups at several anchors. Every set of places where some string of size bytes
    stands is that of a group, moved to its left end. A class of equal texts of size bytes is a group too (nth is -1, gram of the
    texts' digest); occurrences in the copies are those in the class's first document, moved. Null and short texts have none.
    All surroundings of a gram meet in one task here, whatever their number (remove_repeats splits them). docs: doc_id, text.
    """
    docs = store.keyed(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    info, several, copies = _classes(docs)
    around, _ = _around(docs, size, gram, total, copies)
    kinds = [("gram", pa.int64()), ("nth", pa.int32()), ("length", pa.int64()), ("left", pa.int32()), ("place", pa.int64())]

    def run(table: pa.Table) -> pa.Table:
        out = []
        for rows in _groups(table):
            repeats = Repeats(rows, size)
            name = table.column("gram")[int(rows[0][3][0])].as_py()
            for nth, (left, right, some) in enumerate(repeats.maximal()):
                out += [(name, nth, left + right, left, p) for k in some for p in repeats.rows[k][3].tolist()]
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        found = pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, cols, strict=True)})
        return found.drop_columns("place").append_column("share", table.column("share").take(found.column("place"))).append_column("k", table.column("k").take(found.column("place")))

    groups = around.select("share", "k", "gram", "part", "left", "right", "several").groupBy("part").applyInArrow(tx.lean(run), "gram long, nth int, length long, left int, share long, k int")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *names, left, docs, at = (batch.column(c) for c in range(6))
            for k in range(batch.num_rows):
                doc, place = (np.frombuffer(x[k].as_py(), "<i8") for x in (docs, at))
                same = [pa.array([x[k].as_py()] * len(doc), x.type) for x in names]
                yield pa.RecordBatch.from_arrays([*same, pa.array(doc), pa.array(place - left[k].as_py())], names=["gram", "nth", "length", "doc_id", "start"])

    each = groups.join(around.select("share", "k", "docs", "at"), ["share", "k"]).select("gram", "nth", "length", "left", "docs", "at")
    found = store.written(each.mapInArrow(expand, "gram long, nth int, length long, doc_id long, start long"), "repeats")
    member = info.join(several, "digest").where(F.col("n_bytes") >= size)
    moved = found.join(member.where("doc_id <> first").select(F.col("first").alias("doc_id"), F.col("doc_id").alias("copy")), "doc_id").select("gram", "nth", "length", F.col("copy").alias("doc_id"), "start")
    classes = member.select(F.xxhash64("digest").alias("gram"), F.lit(-1).alias("nth"), F.col("n_bytes").alias("length"), "doc_id", F.lit(0).cast("long").alias("start"))
    return found.unionByName(moved).unionByName(classes)

