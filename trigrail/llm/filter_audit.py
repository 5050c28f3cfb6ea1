"""Filter interaction audit: what each order of some filters removes, from counts by failure mask.

A document's mask has a bit for each filter that it fails. Spark counts masks by part, so that at most 2**k rows a part are
left of any corpus. A zeta transform over subsets turns a part's counts into survivors of every set of filters; each
step of each order is then the difference between a set and the one without the step's filter, and likewise for
documents with labels. No order is ever applied to documents.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrail.llm import store
from trigrail.llm import text as tx

#: Least words, least percentage of distinct words, most percentage of capitals.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text by letter: too few words (A), too few distinct ones (B), too many capitals (C), signs (D)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, LETTERS, ""))
    return {"A": n < WORDS, "B": 100 * distinct < DISTINCT * n, "C": 100 * capitals > CAPITALS * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def masks(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic), and the filters' letters by bit. docs: doc_id, text, lang; labels: doc_id, quality, toxic.

    The last filter (E) is failed by a text that a smaller doc_id has too. Digests are reduced to their first doc_id; these, the labels and the
    documents' bits then meet by doc_id in one aggregate, so that a text of very many documents is no group anywhere.
    Null texts count as empty, null parts as the empty one. Rows of equal doc_id: see store.keyed; of labels any row counts.
    """
    rows = store.keyed(docs, "lang").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    filters = text_filters(F.col("text"))
    mask = sum((F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(filters.values())), F.lit(0))
    rows = store.written(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    none = F.lit(None).cast("int")
    each = rows.select("doc_id", "part", "mask", none.alias("first"), none.alias("good"), none.alias("toxic"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(None).cast("string").alias("part"), none.alias("mask"), F.lit(1).alias("first"), none.alias("good"), none.alias("toxic"))
    marked = store.columns(labels, "doc_id", "quality", "toxic").where("doc_id is not null")
    marked = marked.select("doc_id", F.lit(None).cast("string").alias("part"), none.alias("mask"), none.alias("first"), F.when(F.col("quality") == 1, 1).alias("good"), F.when(F.col("toxic") == 1, 1).alias("toxic"))
    met = each.unionByName(first).unionByName(marked).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("part", "mask", "first", "good", "toxic")]).where("part is not null")
    whole = F.col("mask") + F.when(F.col("first").isNull(), 1 << len(filters)).otherwise(0)
    counts = met.groupBy("part", whole.alias("mask")).agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in ("good", "toxic")])
    return counts, "".join(filters) + "E"


def survivors(counts: np.ndarray) -> np.ndarray:
    """Of counts by mask (its last axis, 2**k long): how many fail no filter of each set.

    The zeta transform adds up along each bit what the sets without it have; a set's survivors are the masks inside its complement.
    """
    k = counts.shape[-1].bit_length() - 1
    cube = counts.reshape(*counts.shape[:-1], *(2,) * k)
    for axis in range(cube.ndim - k, cube.ndim):
        cube = cube.cumsum(axis)
    return cube.reshape(counts.shape)[..., ::-1]


class Orders:
    """All orders of k filters as arrays: for each order and step the filter, and the sets before and after it."""

    def __init__(self, letters: str):
        k = len(letters)
        self.steps = np.array([*itertools.permutations(range(k))])
        self.names = ["".join(letters[i] for i in o) for o in self.steps]
        self.after = np.cumsum(1 << self.steps, axis=1)
        self.before = self.after - (1 << self.steps)
        sets = np.arange(1 << k)
        self.without = np.array([sets[sets >> i & 1 == 0] for i in range(k)])
        size = np.array([int(s).bit_count() for s in range(1 << k)])
        self.weight = np.array([math.factorial(s) * math.factorial(k - 1 - s) for s in range(k)])[size[self.without]]

    def audit(self, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Each measure by order and step, of counts (n, good, toxic by mask)."""
        n, good, toxic = alive = survivors(counts)
        lost = alive[:, self.before] - alive[:, self.after]
        i, bit, full = self.steps, 1 << self.steps, n.shape[0] - 1
        shapley = (self.weight * (n[self.without] - n[self.without | (1 << np.arange(len(self.without)))[:, None]])).sum(1)
        return {
            "kept": n[self.after], "removed": lost[0], "redundant": n[0] - n[bit] - lost[0], "unique_fails": n[full - bit] - n[full],
            "good_lost": lost[1], "toxic_lost": lost[2], "shapley": shapley[i],
        }


def _by_part(counts: DataFrame, filters: int) -> DataFrame:
    """One row a part: its counts by mask as arrays."""
    sums = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << filters)]).alias(c) for c in COUNTS]
    return counts.groupBy("part").agg(*sums)


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): k! * k rows a part.

    counts: part, mask, n, good, toxic. kept: left after the step; removed: by it; redundant: fail its filter but were
    removed before; unique_fails: fail that filter only; shapley: removed by that filter in all orders together. No parts, no rows.
    """
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((m, pa.int64()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(letters)
        k = len(letters)
        names, step = pa.array(np.repeat(orders.names, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders.names)))
        for batch in batches:
            for r in batch.to_pylist():
                found = orders.audit(np.array([r[c] for c in COUNTS], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(names)), names, step, *(pa.array(found[m].ravel()) for m in MEASURES)], schema=schema)

    return _by_part(counts, len(letters)).mapInArrow(tx.lean(run), "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def surviving(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filters, n, good, toxic): what is left under each set of filters, named by its letters in order."""
    names = ["".join(x for b, x in enumerate(letters) if s >> b & 1) for s in range(1 << len(letters))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                alive = survivors(np.array([r[c] for c in COUNTS], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(names)), pa.array(names), *map(pa.array, np.ascontiguousarray(alive))], names=["part", "filters", *COUNTS])

    return _by_part(counts, len(letters)).mapInArrow(tx.lean(run), "part string, filters string, n long, good long, toxic long")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the five filters over all documents, by lang."""
    return audit(*masks(docs, labels))
