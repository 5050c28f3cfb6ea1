"""Queries and their plans: a trigram prefilter where a pattern has trigrams and it pays, then the exact test."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrail import schema as S
from trigrail.functions import text
from trigrail.operators.ancestors import reachable
from trigrail.operators.permissions import readable
from trigrail.plans import boolean, choice


@dataclass(frozen=True)
class Query:
    """What to look for. Several patterns are alternatives; an empty one matches every path. parents: all folders above a match, as far as the catalog has them, must be open to the user."""

    patterns: tuple[str, ...]
    ignore_case: bool = False
    regex: bool = False
    uid: int = 0
    gid: int = 0
    limit: int | None = S.MAX_RESULTS
    parents: bool = False


def matches(path: Column, pattern: str, ignore_case: bool = False, regex: bool = False) -> Column:
    """Whether the pattern is somewhere in the path; regular expressions are Java's and not anchored. Ignoring case folds both sides by text.folded; expressions ignore that of ASCII letters."""
    if regex:
        return path.rlike(("(?i)" if ignore_case else "") + pattern)
    return text.folded(path).contains(text.folded(F.lit(pattern))) if ignore_case else path.contains(pattern)


def tree_of(spark: SparkSession, pattern: str, ignore_case: bool = False, regex: bool = False, tails: bool = False) -> boolean.Tree:
    """What trigrams every match has, of the folded path if case is ignored. A literal is folded by Spark, as the paths are. tails: the index has those of paths, so that short literals can use it."""
    if regex:
        return boolean.of_regex(pattern, ignore_case)
    if ignore_case:
        pattern = spark.range(1).select(text.folded(F.lit(pattern))).first()[0] if not pattern.isascii() else pattern.lower()
    return boolean.of_strings([pattern], tails)


def trees(spark: SparkSession, query: Query, tails: bool = False) -> boolean.Tree:
    return boolean.some_(*(tree_of(spark, p, query.ignore_case, query.regex, tails) for p in query.patterns))


def any_of(postings: DataFrame, trigrams: list[str]) -> DataFrame:
    """file_id of files with at least one of the trigrams."""
    return postings.where(F.col("trigram").isin(trigrams)).select("file_id").distinct()


def all_of(postings: DataFrame, trigrams: list[str]) -> DataFrame:
    """file_id of files with all of the (distinct) trigrams: a pushed-down filter and one aggregate, as postings has one row for each trigram of a file."""
    met = postings.where(F.col("trigram").isin(trigrams)).groupBy("file_id").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(trigrams)).select("file_id")


def planned(spark: SparkSession, query: Query, dictionary: DataFrame | None = None, n_files: int | None = None, scan_below: int = 0, tails: bool = False) -> choice.Choice:
    """How a query is answered. dictionary (trigram, num_files) with n_files: lists are measured, and those read that pay; catalogs of less than scan_below files are scanned."""
    tree = trees(spark, query, tails)
    if dictionary is None or tree in (boolean.ANY, boolean.NONE):
        return choice.choose(tree)
    if n_files < scan_below:
        return choice.Choice("scan", tree)
    return choice.choose(tree, choice.summed(choice.measured(dictionary, tree)), n_files)


def search(files: DataFrame, query: Query, postings: DataFrame | None = None, how: choice.Choice | None = None, folders: DataFrame | None = None) -> DataFrame:
    """Matching, readable files (id, path), in the order of id if there is a limit.

    postings: of the paths, folded if the query ignores case; without them, or for patterns without
    trigrams, all files are tested. how: from planned(), else all lists of the patterns are read.
    folders: the catalog in which folders above matches are looked up, if files is only a part of it.
    """
    tests = [matches(F.col("path"), p, query.ignore_case, query.regex) for p in query.patterns]
    if not tests:
        return files.select("id", "path").where(F.lit(False))
    rows = files
    if postings is not None:
        how = how or planned(files.sparkSession, query)
        if how.how == "nothing":
            rows = files.where(F.lit(False))
        elif how.how == "index":
            rows = choice.narrowed(files, postings, how)
    rows = rows.where(reduce(lambda a, b: a | b, tests))
    if query.uid != 0:
        rows = rows.where(readable(F.col("permissions"), F.col("uid"), F.col("gid"), query.uid, query.gid))
    rows = rows.select("id", "path")
    if query.parents:
        rows = reachable(rows, files if folders is None else folders, query.uid, query.gid)
    return rows.orderBy("id").limit(query.limit) if query.limit is not None else rows


def exact(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).select("id", "path")
