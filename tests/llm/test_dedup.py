"""Deduplication against plain versions: nulls, empty and long texts, equal rows, hot groups."""

import itertools
import math

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trigrail.llm import components, embedding_dedup, fingerprints, minhash_dedup, store, substring_dedup, suffix_dedup
from trigrail.llm import text as tx


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how, monkeypatch):
    monkeypatch.setattr(store, "HOT", 20)
    rows = spark.createDataFrame([(k, "hot" if k % 2 else None if k % 10 == 0 else f"k{k % 7}") for k in range(200)], "id long, key string")
    table = spark.createDataFrame([("hot", 1), *((f"k{k}", k) for k in range(5))], "key string, v int")
    got = store.spread_join(rows, table, ["key"], "id", how)
    assert got.columns == ["key", "id", "v"] and sorted(got.collect(), key=str) == sorted(rows.join(table, "key", how).collect(), key=str)


def test_best_of_blocks_is_the_best_of_all():
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 3, (300, 128)).astype(np.uint8)
    bits[::3] = bits[0]
    comp = rng.integers(0, 40, 300)
    x, y, near = (np.concatenate(f) for f in zip(*minhash_dedup.across(bits, comp), strict=True))
    want = {}
    for of in (comp[x], comp[y]):
        for c in np.unique(of):
            at = np.flatnonzero(of == c)
            for k in sorted(at, key=lambda i: (-near[i], x[i], y[i]))[: minhash_dedup.BEST]:
                want[int(x[k]), int(y[k])] = True
    a, b, _ = minhash_dedup.best(bits, comp)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want.keys()


def test_components(spark):
    rnd = np.random.default_rng(3)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(50)] + [(100, 101), (100, 101)], rnd.integers(0, 80, (60, 2)).tolist()):
        got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        nodes = {n for e in edges if e[0] != e[1] for n in e}
        assert got == plain.components(nodes, [e for e in edges if e[0] != e[1]])


#: So many buckets and shares that fingerprints go out and come back in two steps.
TWO_STEPS = {"BUCKET": 60, "FAN": 7, "SHARE": 2000}


@pytest.mark.parametrize(("size", "steps"), [(20, {}), (4, {}), (4, TWO_STEPS)])
def test_substring(docs, corpus, size, steps, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE", 500)
    for name, value in steps.items():
        monkeypatch.setattr(fingerprints, name, value)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, size=size).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items()} == plain.cut_windows(corpus, size)
    for d, r in got.items():
        words = plain.WORD.findall(corpus[d] or "")
        spans = sorted((s.start, s.end) for s in r.spans)
        assert r.kept_text == " ".join(w for i, w in enumerate(words) if not any(a <= i < b for a, b in spans))
        assert all(b < c for (_, b), (c, _) in itertools.pairwise(spans))


def test_rows_of_fingerprints_grow_as_the_corpus():
    """Rows that leave the first step, and that come of the second: no more than so many for each slice."""
    for prints in (1e9, 1.7e11, 1e13):
        deal = fingerprints.Deal(prints, 6 * prints)
        slices = prints / fingerprints.SLICE
        assert deal.coarse <= fingerprints.FAN and slices * deal.coarse <= prints / 900
        assert prints / deal.coarse / deal.fine <= fingerprints.BUCKET


@pytest.mark.parametrize(("size", "gram", "hot", "steps"), [(200, 50, 20_000, {}), (30, 10, 20_000, {}), (30, 10, 1, {}), (30, 10, 1, TWO_STEPS)])
def test_suffix(docs, corpus, size, gram, hot, steps, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE", 500)
    monkeypatch.setattr(tx, "BLOCK", 1000)
    for name, value in steps.items():
        monkeypatch.setattr(fingerprints, name, value)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, size=size, gram=gram, hot=hot).collect()}
    assert {d: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for d, r in got.items()} == plain.cut_bytes(corpus, size)
    for d, r in got.items():
        raw, kept = (corpus[d] or "").encode(), b""
        for a, b in zip([0, *[s.end for s in r.spans]], [*[s.start for s in r.spans], len(raw)], strict=True):
            kept += raw[a:b]
        assert bytes(r.kept) == kept


def test_maximal_repeats(docs, corpus):
    """Every set of places where a string stands several times is a group, moved to its left end; groups are repeats and no more than that."""
    raw, size = {d: (t or "").encode() for d, t in corpus.items()}, 30
    groups = {}
    for r in suffix_dedup.maximal_repeats(docs.where("doc_id <> 1006"), size=size, gram=10).collect():
        groups.setdefault((r.gram, r.nth, r.length), []).append((r.doc_id, r.start))
    places = {}
    for (*_, length), at in groups.items():
        assert len(at) > 1 and len(set(at)) == len(at) and length >= size
        assert len({raw[d][s : s + length] for d, s in at}) == 1
        for d, s in at:
            places.setdefault((d, s), set()).add((length, frozenset(at)))
    where = {}
    for d, t in raw.items():
        for i in range(len(t) - size + 1 if d != 1006 else 0):
            where.setdefault(t[i : i + size], []).append((d, i))
    assert sum(len(x) > 1 for x in where.values()) > 100
    for at in where.values():
        if len(at) > 1:
            d, s = at[0]
            lefts = range(min(i for _, i in at) + 1)
            assert any(length >= size + left and all_ == {(x, i - left) for x, i in at} for left in lefts for length, all_ in places.get((d, s - left), ()))


def test_stack_scan():
    lcp = [1, 3, 0, 2, 2]
    assert sorted(suffix_dedup.intervals(lcp)) == [(1, 0, 3), (2, 3, 6), (3, 1, 3)]
    assert list(suffix_dedup.intervals([])) == []
    assert suffix_dedup.common([b"abc", b"abd", b"ab", b"x"]) == [2, 2, 0]


@pytest.mark.parametrize("region", [4000, 2])
def test_minhash(docs, corpus, region):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, region=region).collect()}
    assert got == plain.near_documents(corpus)


def test_dense_regions_are_not_squared(spark):
    """A dense region of near copies and a few others: every pair of different components in one tile, rows linear."""
    copies = [(k, " ".join(f"w{i}" for i in range(100)) + f" end{k}") for k in range(480)]
    others = [(1000 + k, " ".join(f"x{k}y{i}" for i in range(40))) for k in range(20)]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string")
    dense = docs.select(F.col("doc_id").alias("rep"), F.lit(7).cast("long").alias("region"), F.lit(2000).alias("tree"))
    tiles, links = minhash_dedup._tiles(docs, dense, 40)
    assert {r.b for r in links.collect()} == set(range(1, 480)) and {r.a for r in links.collect()} == {0}
    rows = tiles.collect()
    assert len(rows) == 480 + 20 * 25 and {r.whole for r in rows} == {7}
    met: dict[int, set[int]] = {}
    for r in rows:
        met.setdefault(r.rep, set()).add(r.region)
    ids = [d for d, _ in copies + others]
    assert all(len(met[o] & met[d]) == 1 for o, _ in others for d in ids if d < 1000)
    assert all(met[o] & met[p] for o, _ in others for p, _ in others)
    same, none = minhash_dedup._tiles(docs.where("doc_id < 480"), dense.where("rep < 480"), 40)
    assert same.isEmpty() and none.count() == 479


def test_levels_have_their_recall():
    least = minhash_dedup.THRESHOLD[0] / minhash_dedup.THRESHOLD[1]
    assert all(1 - (1 - least**depth) ** trees >= 0.998 for depth, trees in minhash_dedup.LEVELS)


def test_trees_share_no_values():
    """Recall of the levels at the threshold as their trees really read values, not by the formula."""
    rng = np.random.default_rng(6)
    least = minhash_dedup.THRESHOLD[0] / minhash_dedup.THRESHOLD[1]
    for level, (depth, trees) in enumerate(minhash_dedup.LEVELS):
        order = minhash_dedup.orders(level, depth, trees)
        equal = rng.random((40_000, max(o.max() for o in order) + 1)) < least
        assert np.any([equal[:, o].all(1) for o in order], axis=0).mean() >= 0.998


def test_settle_leaves_pairs_only_to_compared_regions():
    """Alike texts meet in nearly all trees; those of dense regions, which are not compared, settle nothing."""
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"])]
    last = minhash_dedup.LEVELS[0][1] - 1

    def settled(tree, region, met):
        rows = [{"region": region, "tree": tree, "rep": d, "comp": d, "text": t, "met": met} for d, t in enumerate(texts)]
        kind = pa.schema([("region", pa.int64()), ("tree", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64()), ("text", pa.string()), ("met", pa.list_(pa.struct([("tree", pa.int32()), ("whole", pa.int64())])))])
        out = minhash_dedup._settle(pa.Table.from_pylist(rows, kind))
        return list(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))

    here, earlier = {"tree": last, "whole": 77}, {"tree": 0, "whole": 55}
    assert settled(last, 77, [here]) == [(0, 1)]
    assert settled(last, 77, [here, earlier]) == []
    assert settled(0, 55, [here, earlier]) == [(0, 1)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    both = np.concatenate((np.unique(a), np.unique(np.concatenate((a[:800], rng.integers(0, 2**63, 200).astype(np.uint64))))))
    sig = minhash_dedup.minhashes(both, np.array([0, 1000, 2000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.08


def vectors():
    rng = np.random.default_rng(2)
    out = []
    for k in range(150):
        v = rng.standard_normal(16)
        out.append((v, k % 3))
        for _ in range(k % 5):
            out.append((v / np.linalg.norm(v) + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.035, 0.05]), k % 3))
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(out)]
    n = len(rows)
    return rows + [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, None], 1), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:8], 0), (n + 6, [], 0), (n + 7, [x * 2 for x in rows[0][1]], 0), (n + 8, [float("inf")] * 16, 0)]


@pytest.mark.parametrize("cell", [1500, 6])
def test_embeddings(spark, cell):
    rows = vectors()
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, tile string")
    table = table.unionByName(spark.createDataFrame([(None, [1.0], 1, 9, "x"), (0, [99.0], 2, 9, "x")], table.schema))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table, cell=cell).collect()}

    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v), label) for i, v, label in rows if label is not None and ok(v)]
    links = [(a, b) for (a, u, x), (b, v, y) in itertools.combinations(good, 2) if x == y and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98]
    n = {i: sum(i in p for p in links) for i, *_ in rows}
    part = plain.components([r[0] for r in rows], links)
    assert len(links) > 100
    assert got == {i: (n[i], part[i], part[i] == i) for i, *_ in rows}
    assert embedding_dedup.near_duplicates(table.where("vec_id < 0")).count() == 0


def test_embeddings_are_not_broadcast(spark):
    """What grows with the vectors stays off the driver: no join broadcasts a side, however few the vectors are."""
    table = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    done = spark._jsparkSession.sharedState().statusStore()
    seen = done.executionsCount()
    embedding_dedup.near_duplicates(table).collect()
    ran = [done.executionsList().apply(k).physicalPlanDescription() for k in range(seen, done.executionsCount())]
    assert any("SortMergeJoin" in plan for plan in ran) and not any("BroadcastHashJoin" in plan for plan in ran)


def test_needed_collisions_keep_recall():
    for tables, lines in map(embedding_dedup.tables_for, (10, 1000, 10**6, 10**9)):
        assert 0 < embedding_dedup.needed(tables * lines) <= tables * lines


@pytest.mark.parametrize(("tables", "lines"), [(27, 10), (40, 10)])
def test_links_of_many_lines(tables, lines):
    """More lines than a byte counts: what the closest pairs share does not wrap."""
    rng = np.random.default_rng(4)
    base = np.repeat(rng.standard_normal((30, 32)), 5, axis=0)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True) + rng.standard_normal((150, 32)) * np.tile([0, 1e-4, 0.01, 0.02, 0.03], 30)[:, None]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    x, y = embedding_dedup.links_of(unit, np.zeros(150, np.int64), False, 0, tables, lines, 0.98)
    to, _ = embedding_dedup.lines_of(32, tables * lines)
    on, half = (unit @ to)[:, 0], embedding_dedup.WINDOW * embedding_dedup.spread(0.98)
    near = {(i, j) for i, j in itertools.combinations(range(150), 2) if unit[i] @ unit[j] >= 0.98 and abs(on[i] - on[j]) <= half}
    assert len(near) > 100 and embedding_dedup.needed(tables * lines) > 240
    assert {(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} == near


def test_window_hashes_tell_windows_apart():
    h = tx.mix(np.arange(50, dtype=np.uint64))
    assert len(np.unique(tx.window_hashes(h, 20))) == 31
    twice = np.concatenate((h, h))
    p = tx.window_hashes(twice, 20)
    assert (p[:31] == p[50:]).all()
    data, offs = tx.buffers(__import__("pyarrow").array(["ab cd", None, " é\x0bx", ""]))
    start, end, bounds = tx.words(data, offs)
    assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == [b"ab", b"cd", "é".encode(), b"x"] and bounds.tolist() == [0, 2, 2, 4, 4]
    one, two = tx.word_hashes(data, start, end), tx.word_hashes(data, start, end, seed=1)
    assert len({*one.tolist(), *two.tolist()}) == 8


@pytest.mark.parametrize("operator", [substring_dedup.remove_repeats, suffix_dedup.remove_repeats, suffix_dedup.maximal_repeats, minhash_dedup.near_duplicates])
def test_empty_tables(nothing, operator):
    assert operator(nothing).count() == 0
