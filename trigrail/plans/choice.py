"""Which posting lists a query reads, by how long they are, and how a tree is evaluated on them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrail.plans.boolean import ANY, NONE, All, Some, Start, Tree, all_, holds, leaves, some_

#: Catalogs of less files are scanned at once: that is a stage over some dozen MB, where the index has jobs for the lengths of lists and for candidates first.
SCAN_FILES = 2_000_000
#: The index is used if it reads at most this share of the catalog's number of files, of posting and catalog rows together.
SHARE = 0.25
#: Of an AND the rarest part is read and these more, if they are at most so many times longer.
MORE, TIMES = 3, 4
#: Conditions that one pass tests: the bits of a long.
BITS = 62
#: Most candidates that are named to the catalog's scan; most that are broadcast.
NAMED, SENT = 10_000, 2_000_000


@dataclass(frozen=True)
class Choice:
    """how: scan, index or nothing (no path can match). bound: most files that pass the tree, reads: posting rows (both None if lists weren't measured)."""

    how: str
    tree: Tree
    bound: int | None = None
    reads: int | None = None


def fitting(tree: Tree, room: int = BITS) -> Tree:
    """The tree, or a weaker one with at most room leaves."""
    if len(leaves(tree)) <= room:
        return tree
    if isinstance(tree, Some):
        return ANY
    parts: list[Tree] = []
    for p in sorted(tree.parts, key=lambda p: (len(leaves(p)), str(p))):
        if len(leaves(All(frozenset([*parts, p])))) <= room:
            parts.append(p)
    return all_(*parts)


def _rarest(tree: Tree, counts: dict) -> tuple[Tree, int]:
    """(the tree without parts that aren't worth their reading, most files that pass it). A leaf that is not in counts is of no file."""
    if isinstance(tree, str | Start):
        n = counts.get(tree, 0)
        return (tree if n else NONE), n
    parts = [_rarest(p, counts) for p in tree.parts]
    if isinstance(tree, Some):
        return some_(*(p for p, _ in parts)), sum(n for _, n in parts)
    parts.sort(key=lambda p: (p[1], str(p[0])))
    least = parts[0][1]
    return all_(*(p for k, (p, n) in enumerate(parts) if k == 0 or (k <= MORE and n <= TIMES * least))), least


def choose(tree: Tree, counts: dict | None = None, n_files: int | None = None) -> Choice:
    """counts: of how many files each of the tree's leaves is, at most; n_files: of the catalog. Without them all lists are read that fit."""
    if tree == NONE:
        return Choice("nothing", tree)
    if tree == ANY:
        return Choice("scan", tree)
    if counts is None:
        tree = fitting(tree)
        return Choice("scan" if tree == ANY else "index", tree)
    tree, bound = _rarest(tree, counts)
    if tree == NONE:
        return Choice("nothing", tree, 0, 0)
    if len(leaves(tree)) > BITS:
        return Choice("scan", ANY)
    reads = sum(counts[g] for g in leaves(tree))
    return Choice("index" if reads + bound <= SHARE * n_files else "scan", tree, bound, reads)


def _of(leaf: str | Start) -> Column:
    """Whether a row of postings or of a dictionary is of the leaf; both forms are pushed down to scans."""
    return F.col("trigram").startswith(leaf.start) if isinstance(leaf, Start) else F.col("trigram") == leaf


def _any(some: set) -> Column:
    grams = sorted(x for x in some if isinstance(x, str))
    return reduce(lambda a, b: a | b, [*([F.col("trigram").isin(grams)] if grams else []), *(_of(x) for x in sorted(some - {*grams}, key=str))])


def measured(dictionary: DataFrame, tree: Tree) -> dict[str, dict[str | Start, int]]:
    """By segment, rows of postings of each leaf that has some there. A row for each trigram asked for, and a number for each beginning, come to the driver of each segment.

    dictionary: trigram, num_files, segment (without that column it is one segment).
    """
    if "segment" not in dictionary.columns:
        dictionary = dictionary.withColumn("segment", F.lit(""))
    starts = sorted((x for x in leaves(tree) if isinstance(x, Start)), key=str)
    grams = leaves(tree) - {*starts}
    out: dict[str, dict] = {}
    if grams:
        for r in dictionary.where(_any(grams)).groupBy("segment", "trigram").agg(F.sum("num_files").alias("n")).collect():
            out.setdefault(r.segment, {})[r.trigram] = r.n
    if starts:
        for segment, *sums in dictionary.where(_any({*starts})).groupBy("segment").agg(*[F.sum(F.when(_of(x), F.col("num_files"))) for x in starts]).collect():
            out.setdefault(segment, {}).update({x: n for x, n in zip(starts, sums, strict=True) if n})
    return out


def summed(by_segment: dict[str, dict]) -> dict[str | Start, int]:
    out: dict = {}
    for counts in by_segment.values():
        for leaf, n in counts.items():
            out[leaf] = out.get(leaf, 0) + n
    return out


def opened(tree: Tree, by_segment: dict[str, dict]) -> list[str]:
    """The segments in which some row may pass the tree: the others are read neither for their lists nor for their rows."""
    return sorted(s for s, counts in by_segment.items() if holds(tree, {*counts}))


def candidates(postings: DataFrame, tree: Tree) -> DataFrame:
    """file_id of the files for which the tree holds: one pass over its lists, one aggregate with a bit for each leaf."""
    some = sorted(leaves(tree), key=str)
    rows = postings.where(_any({*some}))
    if len(some) == 1:
        return rows.select("file_id").distinct()
    bits = {x: 1 << i for i, x in enumerate(some)}
    grams = [x for x in some if isinstance(x, str)]
    mine = [F.coalesce(F.element_at(F.create_map(*[F.lit(y) for g in grams for y in (g, bits[g])]), F.col("trigram")).cast("long"), F.lit(0).cast("long"))] if grams else []
    mine += [F.when(_of(x), F.lit(bits[x]).cast("long")).otherwise(F.lit(0).cast("long")) for x in some if isinstance(x, Start)]
    found = rows.groupBy("file_id").agg(F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), mine)).alias("found"))
    return found.where(_test(tree, bits)).select("file_id")


def _test(tree: Tree, bits: dict) -> Column:
    if isinstance(tree, str | Start):
        return F.col("found").bitwiseAND(F.lit(bits[tree]).cast("long")) != 0
    return reduce(lambda a, b: a & b if isinstance(tree, All) else a | b, (_test(p, bits) for p in sorted(tree.parts, key=str)))


def narrowed(files: DataFrame, postings: DataFrame, choice: Choice) -> DataFrame:
    """The files that may match. Few candidates, of proven number, are named to the scan, which then opens only their blocks; more are joined."""
    ids = candidates(postings, choice.tree)
    if choice.bound is not None and choice.bound <= NAMED and "block" in files.columns:
        named = [r.file_id for r in ids.collect()]
        return files.where(F.col("block").isin(sorted({n >> BLOCK for n in named})) & F.col("id").isin(named)) if named else files.where(F.lit(False))
    ids = ids.withColumnRenamed("file_id", "id")
    return files.join(F.broadcast(ids) if choice.bound is not None and choice.bound <= SENT else ids, "id", "left_semi")


#: Bits of an id within a block of the catalog.
BLOCK = 20
