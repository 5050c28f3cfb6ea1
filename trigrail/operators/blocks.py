"""Posting lists packed in blocks, of which a query decodes those that can matter.

A list has a grid of its own: its blocks are 2**shift ids wide, so that one holds about 2**LIST of them, and are never
narrower than a region of 2**REGION ids. So an id, or a region, names its block of any list, and blocks are picked by equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.functions import packing, score
from trigrail.functions.text import literal_trigrams
from trigrail.operators import postings, ranking
from trigrail.sources.snapshots import held

#: Bits of the ids in a region; bits of the number of ids that a block holds on average; most lists whose shifts are broadcast.
REGION, LIST, SENT = 10, 8, 2_000_000
#: Blocks that a kernel takes at a time.
STEP = 500

PACKED = "trigram string, shift int, block long, n long, first_id long, last_id long, k int, quotients binary, remainders binary, freqs binary"
_ROWS = pa.schema([("trigram", pa.string()), ("file_id", pa.int64()), ("freq", pa.int64())])


def packed(rows: DataFrame) -> DataFrame:
    """Postings (trigram, file_id, freq) as a row for each block: its range, and gaps as quotients and remainders by 2**k, k from the block's mean gap.

    A block holds at most as many rows as it is ids wide: 2**LIST times the list's mean gap, and never more than the list has, so with N ids
    at most the root of 2**LIST * N. A trigram of a third of all files is dealt to as many tasks as others, by block. A trigram of
    no file has no row; an empty table has none. Pairs (trigram, file_id) are distinct, freq is 1 or more.
    """
    lists = held(rows.groupBy("trigram").agg(F.count("*").alias("files"), (F.max("file_id") - F.min("file_id") + 1).alias("span")))
    shift = F.greatest(F.lit(REGION), F.ceil(F.log2(F.col("span") * float(1 << LIST) / F.col("files"))).cast("int")).alias("shift")
    lists = lists.select("trigram", shift)
    each = rows.join(F.broadcast(lists) if lists.count() <= SENT else lists, "trigram").withColumn("block", F.expr("shiftright(file_id, shift)"))
    full = each.groupBy("trigram", "shift", "block").agg(F.array_sort(F.collect_list(F.struct("file_id", "freq"))).alias("rows"), F.count("*").alias("n"))
    ids = F.col("rows.file_id")
    full = full.select("trigram", "shift", "block", "n", F.element_at(ids, 1).alias("first_id"), F.element_at(ids, -1).alias("last_id"), ids.alias("ids"), F.col("rows.freq").alias("freq"))
    k = score.golomb_parameter((F.col("last_id") - F.col("first_id")) / F.greatest(F.col("n") - 1, F.lit(1))).cast("int")
    return full.withColumn("k", k).mapInArrow(_pack, PACKED)


def _column(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            yield batch.slice(start, STEP)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        n, k = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "k"))
        ids, freq = (b.column(c).flatten().to_numpy() for c in ("ids", "freq"))
        gaps = np.where(packing.within(n) == 0, 0, np.diff(ids, prepend=0))
        bits = np.repeat(k, n)
        coded = [packing.unary(gaps >> bits, n), packing.fixed(gaps, k, n), packing.unary(freq - 1, n)]
        kept = ["trigram", "shift", "block", "n", "first_id", "last_id", "k"]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [_column(*c) for c in coded], [*kept, "quotients", "remainders", "freqs"])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = pc.binary_length(column).to_numpy().astype(np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(size)])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        n, k, first = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "k", "first_id"))
        quotients = packing.from_unary(*_bytes(b.column("quotients")), n)
        gaps = (quotients << np.repeat(k, n)) | packing.from_fixed(*_bytes(b.column("remainders")), k, n)
        sums = np.cumsum(gaps)
        start = np.cumsum(n) - n
        ids = sums + np.repeat(first - sums[start], n)  # the first gap of a block is 0
        freq = packing.from_unary(*_bytes(b.column("freqs")), n) + 1
        yield pa.RecordBatch.from_arrays([b.column("trigram").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(ids), pa.array(freq)], schema=_ROWS)


def unpacked(blocks: DataFrame) -> DataFrame:
    """(trigram, file_id, freq) of blocks."""
    return blocks.select("trigram", "n", "first_id", "k", "quotients", "remainders", "freqs").mapInArrow(_unpack, "trigram string, file_id long, freq long")


def lists_of(blocks: DataFrame, grams: list[str]) -> list:
    """(trigram, shift, files) of those of the trigrams that have a list, the rarest first. No list is decoded."""
    rows = blocks.where(F.col("trigram").isin(grams)).groupBy("trigram", "shift").agg(F.sum("n").alias("files")).collect()  # at most one a trigram asked for
    return sorted(rows, key=lambda r: (r.files, r.trigram))


def _grids(lists: list) -> F.Column:
    return F.explode(F.array(*[F.struct(F.lit(r.trigram).alias("trigram"), F.lit(r.shift).alias("shift")) for r in lists])).alias("list")


def holding(blocks: DataFrame, ids: DataFrame, lists: list) -> DataFrame:
    """The blocks of these lists that could hold one of ids (file_id): by the list's grid, then by the block's first and last id."""
    asked = ids.select("file_id", _grids(lists)).select("file_id", "list.*")
    asked = asked.groupBy("trigram", F.expr("shiftright(file_id, shift)").alias("block")).agg(F.min("file_id").alias("least"), F.max("file_id").alias("most"))
    some = blocks.where(F.col("trigram").isin([r.trigram for r in lists]))
    return some.join(asked, ["trigram", "block"]).where((F.col("first_id") <= F.col("most")) & (F.col("last_id") >= F.col("least"))).drop("least", "most")


def all_of(blocks: DataFrame, grams: list[str]) -> DataFrame:
    """file_id of the files that have all of the trigrams: the rarest list is decoded, of the others the blocks that could hold one of its ids. No trigrams: an error."""
    grams = list(dict.fromkeys(grams))
    lists = lists_of(blocks, grams)
    if len(lists) < len(grams):
        return blocks.select(F.col("first_id").alias("file_id")).where(F.lit(False))
    ids = unpacked(blocks.where(F.col("trigram") == lists[0].trigram)).select("file_id")
    if len(lists) == 1:
        return ids
    found = unpacked(holding(blocks, ids, lists[1:])).join(ids, "file_id", "left_semi")
    return found.groupBy("file_id").count().where(F.col("count") == len(lists) - 1).select("file_id")


def bounds(files: DataFrame) -> DataFrame:
    """(trigram, region, top): the greatest weight of the trigram in a file of the region, that is its part of ranking.tfidf's score without the logarithm."""
    length = F.length("path")
    each = postings.exploded(files.withColumn("path", F.when(length >= 3, F.col("path")))).groupBy("trigram", "file_id").agg(F.count("*").alias("freq"))
    size = files.select(F.col("id").alias("file_id"), length.cast("double").alias("length"))
    weight = F.col("freq") / (F.col("length") - 2) / F.sqrt("length")
    return each.join(size, "file_id").groupBy("trigram", F.shiftright("file_id", REGION).alias("region")).agg(F.max(weight).alias("top"))


def _in(blocks: DataFrame, regions: DataFrame, lists: list) -> DataFrame:
    """Postings of these lists in regions, from the blocks that reach into one."""
    asked = regions.select("region", _grids(lists)).select("region", "list.*")
    asked = asked.select("trigram", F.expr(f"shiftright(region, shift - {REGION})").alias("block")).distinct()
    rows = unpacked(blocks.join(asked, ["trigram", "block"], "left_semi")).withColumn("region", F.shiftright("file_id", REGION))
    return rows.join(regions, "region", "left_semi").drop("region")


def promising(files: DataFrame, blocks: DataFrame, tops: DataFrame, pattern: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(regions in which a file could be among the k best, their scores as ranking.tfidf gives them).

    The k regions of the greatest bounds are scored first; the k-th score there is one that the k best reach, and regions whose bound is below it are left out.
    """
    lists, n = lists_of(blocks, literal_trigrams(pattern)), files.count()
    if not lists:
        none = files.select(F.shiftright("id", REGION).alias("region")).where(F.lit(False))
        return none, files.select(F.col("id").alias("file_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    df = files.sparkSession.createDataFrame([(r.trigram, r.files) for r in lists], "trigram string, num_files long")
    part = F.col("top") * F.ln((F.lit(n) + 1) / (F.col("num_files") + 1))
    reach = held(tops.join(F.broadcast(df), "trigram").groupBy("region").agg(F.sum(part).alias("bound")))

    def scores(regions: DataFrame) -> DataFrame:
        some = files.withColumn("region", F.shiftright("id", REGION)).join(regions, "region", "left_semi")
        return ranking.scores(some, _in(blocks, regions, lists), df, F.lit(n))

    first = ranking.best(scores(reach.orderBy(F.col("bound").desc(), "region").limit(k).select("region")), k)
    least, reached = first.agg(F.min("score"), F.count("*")).first()
    # scores are rounded to eight places
    regions = reach.where(F.col("bound") >= (least - 1e-8 if reached == k else float("-inf"))).select("region")
    return regions, scores(regions)


def best(files: DataFrame, blocks: DataFrame, tops: DataFrame, pattern: str, k: int) -> DataFrame:
    """The rows of ranking.best(ranking.tfidf(...), k), from the blocks that could hold one of them. tops: bounds(files)."""
    return ranking.best(promising(files, blocks, tops, pattern, k)[1], k)
