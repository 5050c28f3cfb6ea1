"""Packed posting lists and paths: round trips, the same rows as the plain forms, and how little of them is read."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trigrail.functions import packing, text
from trigrail.operators import blocks, paths, postings, ranking

ROWS = st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=9), max_size=6)


@given(ROWS, st.data())
def test_numbers_come_back(rows, data):
    n = np.array([len(r) for r in rows], np.int64)
    values = np.array([v for r in rows for v in r], np.int64)
    assert packing.from_unary(*packing.unary(values, n), n).tolist() == values.tolist()
    width = np.array([data.draw(st.integers(max((v.bit_length() for v in r), default=0), 12)) for r in rows], np.int64)
    assert packing.from_fixed(*packing.fixed(values, width, n), width, n).tolist() == values.tolist()


def catalog(n, seed=1, spread=1):
    """Paths of which some words are rare; ids in order, with gaps of spread and one far away; some are null or short."""
    rng = random.Random(seed)
    rows = [(i * spread - 700, f"/{rng.choice('abc')}{rng.randrange(9)}/x{i % 977}" + ("/needle.org" if i % 1500 == 7 else "") + ("xxx" * rng.randrange(4)) + ".log") for i in range(n)]
    return [*rows, (10**12, "/far/needle.org"), (10**12 + 1, None), (10**12 + 2, "ab"), (10**12 + 3, "")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(catalog(20_000), "id long, path string").cache()


@pytest.fixture(scope="module")
def index(spark, files, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("blocks"))
    postings.laid_out(postings.build(files)).write.option("compression", "zstd").parquet(f"{place}/long")
    postings.laid_out(blocks.packed(postings.build(files)), "block").write.option("compression", "zstd").parquet(f"{place}/packed")
    return place, spark.read.parquet(f"{place}/long"), spark.read.parquet(f"{place}/packed")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_packed_lists_are_the_long_ones_in_less_bytes(index):
    place, long, packed = index
    assert rows_of(blocks.unpacked(packed)) == rows_of(long.select("trigram", "file_id", "freq"))
    size = {k: sum(f.stat().st_size for f in Path(place, k).glob("*.parquet")) for k in ("long", "packed")}
    assert size["packed"] < 0.5 * size["long"]
    # a block is as wide as its grid says, and holds what its columns say
    wrong = packed.where("shiftright(first_id, shift) <> block OR shiftright(last_id, shift) <> block OR shift < 10 OR n > last_id - first_id + 1")
    assert wrong.count() == 0 and packed.agg(F.max("n")).first()[0] <= 1024


@pytest.mark.parametrize("spread", [1, 1000, 10**7])
def test_lists_of_any_gaps(spark, spread):
    rows = postings.build(spark.createDataFrame(catalog(400, spread, spread), "id long, path string"))
    assert rows_of(blocks.unpacked(blocks.packed(rows))) == rows_of(rows)


def test_an_empty_index(spark):
    none = blocks.packed(spark.createDataFrame([], "trigram string, file_id long, freq long"))
    assert none.count() == 0 and blocks.unpacked(none).count() == 0 and blocks.all_of(none, ["abc"]).count() == 0


@pytest.mark.parametrize("pattern", ["needle.org", ".log", "/a1/x5", "xxxxxx", "nothing here", "log"])
def test_files_with_all_trigrams(files, index, pattern):
    grams = text.literal_trigrams(pattern)
    want = [(i,) for i, p in sorted((r.id, r.path) for r in files.where("path is not null").collect()) if all(g in p for g in grams)]
    assert rows_of(blocks.all_of(index[2], grams)) == want


def test_only_blocks_that_could_hold_a_candidate_are_decoded(index):
    _, _, packed = index
    lists = blocks.lists_of(packed, ["nee", ".lo"])
    ids = blocks.unpacked(packed.where("trigram = 'nee'"))
    read, there = blocks.holding(packed, ids, lists[1:]).count(), packed.where("trigram = '.lo'").count()
    assert 0 < read <= ids.count() and read < there


@pytest.mark.parametrize(("pattern", "k"), [("needle.org", 10), ("needle.org", 3), ("/a1/x5", 5), ("xxxxxx", 7), (".log", 10), ("nothing here", 4), ("zq9", 4), ("x", 3), ("needle.org", 100_000)])
def test_best_by_bounds_are_the_best(files, index, pattern, k):
    _, long, packed = index
    want = [tuple(r) for r in ranking.best(ranking.tfidf(files, long, pattern), k).collect()]
    assert [tuple(r) for r in blocks.best(files, packed, blocks.bounds(files), pattern, k).collect()] == want


def test_regions_below_the_last_of_the_best_are_left_out(files, index):
    regions, _ = blocks.promising(files, index[2], blocks.bounds(files), "needle.org", 3)
    assert 0 < regions.count() < files.select(F.shiftright("id", blocks.REGION)).distinct().count()


WORDS = ["", "/", "/a", "/a/", "/ab", "/a/b", "/a/é", "/a/è", "/a/e", "/a/😀", "/a/b/c", "/a/b", "b", "/a" * 40]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """(rows, the dictionary as it is written)."""
    rows = [(i, p) for i, p in enumerate([*WORDS, *(f"/d{k % 50}/s{k % 7}/f{k}" for k in range(5000))])]
    place = str(tmp_path_factory.mktemp("paths"))
    paths.packed(spark.createDataFrame([*rows, (-1, None)], "id long, path string")).write.parquet(f"{place}/t")
    return rows, spark.read.parquet(f"{place}/t")


def test_paths_come_back(tree):
    rows, table = tree
    assert rows_of(paths.unpacked(table)) == sorted(rows)
    assert table.agg(F.sum("n")).first()[0] == len(rows) and table.agg(F.max("n")).first()[0] <= paths.BLOCK
    assert table.agg(F.sum(F.length("tails"))).first()[0] < 0.7 * sum(len(p.encode()) for _, p in rows)


@pytest.mark.parametrize("start", ["", "/", "/a", "/a/b", "/a/é", "/a/è", "/d1/", "/d49/s0", "zz", "/a/😀x"])
def test_paths_that_begin_so(tree, start):
    rows, table = tree
    assert rows_of(paths.starting(table, start)) == sorted(r for r in rows if r[1].startswith(start))
    assert rows_of(paths.exact(table, start)) == sorted(r for r in rows if r[1] == start)
    assert rows_of(paths.under(table, start)) == sorted(r for r in rows if r[1].startswith(start.rstrip("/") + "/"))


def test_a_folder_is_in_few_blocks(spark, tree):
    _, table = tree
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    few = paths.holding(table, "/d7/")
    assert few.count() <= 3 < table.count()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(last,/d7/)" in plan and "StringStartsWith(head,/d7/)" in plan


def test_no_paths(spark):
    none = paths.packed(spark.createDataFrame([(1, None)], "id long, path string"))
    assert none.count() == 0 and paths.under(none, "/a").count() == 0
