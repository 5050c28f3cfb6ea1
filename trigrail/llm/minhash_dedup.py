"""MinHash near-dedup by an LSH forest.

Each document's set of distinct five-word shingles (A-Z lower-cased; fewer words: the whole sequence
as one) gets MINHASHES minhash values. A tree of the forest reads some of the values in an order of
its own, and a region is the documents that agree on the first of them, as many as the depth of the
level: tables of fixed prefixes stand in for orders sorted by signature. LEVELS pairs a
depth with as many trees as catch a pair of similarity THRESHOLD with at least 0.998. A region too
dense at one level is not searched there: its documents, all of them, go to the next level, which is
deeper and has more trees. These read minhash values of their own, computed again from the texts, so that
no two trees share a value, and a level misses at most 0.002 of such pairs (once for each level that
a pair has to pass). What is still too dense at the last level is compared block by block; before that its
documents meet a leader of their regions, and only what doesn't join the region's greatest component is
compared with all, so that a million copies of a page are a million comparisons and not their square.

Sets that are equal form a class with one representative. In a region, pairs whose sketches agree
well enough (SLACK lets pairs of the threshold through with 4.4 standard deviations to spare) are
candidates, verified on full sets. First each document meets the one that seems most similar of its
regions' leaders. Then, in regions with several components, each component's best candidates are
tried. What still lies in regions with several components at last brings its texts there, and each
region's task verifies every candidate across components, listing no pairs but those that join two.
What is lost is thus only what the trees miss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import store
from trigrail.llm import text as tx
from trigrail.llm.components import components

WORDS, THRESHOLD, MINHASHES, SLACK = 5, (75, 100), 128, 0.58
#: (depth, trees); recall of one pair at similarity s: 1 - (1 - s ** depth) ** trees.
LEVELS = ((4, 18), (6, 34), (9, 84))
#: Most documents of a region that one task compares with each other.
REGION = 4000
#: Candidates of a component that the second round tries in each region; bytes of text in a task of the last.
BEST, SETTLED = 4, 16 << 20
SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, sig binary, bits binary"


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): of each text the distinct hashes of its shingles, ascending."""
    data = tx.LOWER[data]
    start, end, bounds = tx.words(data, offs)
    h = tx.word_hashes(data, start, end)
    p = tx.window_hashes(h, WORDS)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        sets.append(np.unique(p[a : b - WORDS + 1]) if b - a >= WORDS else tx.window_hashes(h[a:b], b - a) if b > a else h[:0])
    return np.concatenate(sets) if sets else h[:0], np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def multipliers(n: int) -> np.ndarray:
    return tx.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(tx.WINDOW_BASE)) | np.uint64(1)


def minhashes(sets: np.ndarray, bounds: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """uint32 [texts, n], of the functions after the first skip; an empty set has the greatest values."""
    out = np.full((len(bounds) - 1, n), 2**32 - 1, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[:-1][full]
        for k, a in enumerate(multipliers(skip + n)[skip:]):
            out[full, k] = np.minimum.reduceat(sets * a + (a >> np.uint64(7)), at) >> np.uint64(32)
    return out


def sketch_bits(sig: np.ndarray) -> np.ndarray:
    """A byte of each minhash value."""
    return (tx.mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = tx.buffers(batch.column(1))
        for i, j in tx.steps(offs):
            sets, bounds = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            sig = minhashes(sets, bounds, MINHASHES)
            digests = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            two = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            bits = sketch_bits(sig)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([s.tobytes() for s in bits], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "sig", "bits"],
            )


def orders(level: int, depth: int, trees: int) -> list[np.ndarray]:
    """Which minhash values of a level each tree reads, in its order; no two trees share one."""
    n = depth * trees
    deck = np.random.default_rng(1000).permutation(MINHASHES) if level == 0 else np.arange(n)
    return list(deck[:n].reshape(trees, depth))


def _prefixes(level: int, depth: int, trees: int):
    """(rep, tree, prefix): of each document the common hash of its first depth values in each tree.

    Level 0 reads (rep, sig); deeper levels read (rep, text) and compute values that no other level has.
    """
    skip = MINHASHES + sum(d * t for d, t in LEVELS[1:level])

    def hashed(rep: pa.Array, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t, order in enumerate(orders(level, depth, trees)):
            h = np.full(len(sig), t + 1, np.uint64)
            for c in order:
                h = tx.mix(h ^ sig[:, c].astype(np.uint64) * np.uint64(tx.WINDOW_BASE))
            yield pa.RecordBatch.from_arrays([rep, pa.array(h.view(np.int64)), pa.array(np.full(len(sig), 1000 * level + t, np.int32))], names=["rep", "region", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if level == 0:
                yield from hashed(batch.column(0), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1))
                continue
            data, offs = tx.buffers(batch.column(1))
            for i, j in tx.steps(offs):
                sets, bounds = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield from hashed(batch.column(0).slice(i, j - i), minhashes(sets, bounds, depth * trees, skip))

    return run


def agreement(bits: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Similarity that the sketches lo:hi show to all, [hi - lo, n]."""
    same = np.empty((hi - lo, len(bits)), np.float32)
    for k in range(lo, hi):
        same[k - lo] = (bits == bits[k]).sum(1, dtype=np.int16)
    same /= bits.shape[1]
    return (same - 1 / 256) / (1 - 1 / 256)


def led(bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leader, followers, similarities): each document follows the first leader that seems similar, or leads itself."""
    left = np.arange(len(bits))
    while len(left) > 1:
        near = agreement(bits[left], 0, 1)[0]
        follows = near >= THRESHOLD[0] / THRESHOLD[1]
        follows[0] = False
        if follows.any():
            yield int(left[0]), left[follows], near[follows]
        follows[0] = True
        left = left[~follows]


def across(bits: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, similarity) of the candidates of different components, each once, in blocks of x."""
    for k in range(0, len(bits), 64):
        near = agreement(bits, k, min(k + 64, len(bits)))
        x, y = np.nonzero((near >= SLACK) & (comp[k : k + 64, None] < comp[None, :]))
        yield x + k, y, near[x, y]


def _foremost(x: np.ndarray, y: np.ndarray, near: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that are among the BEST of either component."""
    keep = np.zeros(len(x), bool)
    for of in (comp[x], comp[y]):
        order = np.lexsort((y, x, -near, of))
        place = np.arange(len(x))
        head = np.ones(len(x), bool)
        head[1:] = of[order][1:] != of[order][:-1]
        keep[order[place - np.maximum.accumulate(np.where(head, place, 0)) < BEST]] = True
    return x[keep], y[keep], near[keep]


def best(bits: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of across() what is among the BEST of either component, kept as blocks come, so that few candidates are held at once."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    for block in across(bits, comp):
        if len(block[0]):
            held = _foremost(*(np.concatenate(f) for f in zip(held, block, strict=True)), comp)
    return held


def _compare(first: bool):
    """Candidates in the regions of one share: with leaders (first), or the best across components."""

    def run(table: pa.Table) -> pa.Table:
        region, rep, comp = (table.column(c).to_numpy() for c in ("region", "rep", "comp"))
        order = np.lexsort((rep, region))
        region, rep, comp = region[order], rep[order], comp[order]
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(rep), -1)[order]
        cut = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True])))
        sizes, found = np.diff(cut), []
        two = cut[:-1][sizes == 2]
        near = ((bits[two] == bits[two + 1]).mean(1) - 1 / 256) / (1 - 1 / 256)
        ok = (near >= (THRESHOLD[0] / THRESHOLD[1] if first else SLACK)) & (comp[two] != comp[two + 1])
        found.append((rep[two][ok], rep[two + 1][ok], near[ok]))
        for lo, n in zip(cut[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            b, r = bits[lo : lo + n], rep[lo : lo + n]
            if first:
                c = comp[lo : lo + n]
                found += [(np.full((c[f] != c[k]).sum(), r[k]), r[f][c[f] != c[k]], s[c[f] != c[k]]) for k, f, s in led(b)]
            else:
                x, y, s = best(b, comp[lo : lo + n])
                found.append((np.minimum(r[x], r[y]), np.maximum(r[x], r[y]), s))
        a, b, near = (np.concatenate(f) for f in zip(*found, strict=True))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "near": pa.array(near, pa.float64())})

    return run


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two full sets (ascending) are similar."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return THRESHOLD[1] * both >= THRESHOLD[0] * (len(p) + len(q) - both)


def _settle(table: pa.Table) -> pa.Table:
    """Links that join components, by verifying every candidate across components of each region.

    A pair is left to the first tree in whose region it is compared: met has, of each document, the trees whose
    regions are, with these regions (whole, not in blocks). A dense region that went on to the next level is none.
    """
    region, tree, rep, comp = (table.column(c).to_numpy() for c in ("region", "tree", "rep", "comp"))
    order = np.lexsort((rep, region))
    region, tree, rep, comp = region[order], tree[order], rep[order], comp[order]
    reps, first = np.unique(rep, return_index=True)
    data, offs = tx.buffers(table.column("text").take(pa.array(order[first])))
    sets: list[np.ndarray] = []
    sigs = []
    for i, j in tx.steps(offs):
        h, bounds = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        sigs.append(minhashes(h, bounds, MINHASHES))
        sets += [h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    sig, of = np.concatenate(sigs), np.searchsorted(reps, rep)
    met = pc.take(table.column("met").combine_chunks(), pa.array(order[first]))
    row, one = pc.list_parent_indices(met).to_numpy(), pc.list_flatten(met)
    trees, col = np.unique(pc.struct_field(one, "tree").to_numpy(), return_inverse=True)
    at = np.zeros((len(reps), len(trees)), np.int64)
    at[row, col] = pc.struct_field(one, "whole").to_numpy()
    cut = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True])))
    found: list[tuple[int, int]] = []
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        mine = of[lo:hi]
        for x, y, near in across(sketch_bits(sig[mine]), comp[lo:hi]):
            fresh = np.ones(len(x), bool)
            for c in range(np.searchsorted(trees, tree[lo])):
                p, q = at[mine[x[fresh]], c], at[mine[y[fresh]], c]
                fresh[fresh] = (p != q) | (p == 0)
            for k in np.flatnonzero(fresh)[np.argsort(-near[fresh], kind="stable")].tolist():
                a, b = lo + int(x[k]), lo + int(y[k])
                one, two = root(int(comp[a])), root(int(comp[b]))
                if one != two and alike(sets[of[a]], sets[of[b]]):
                    joined[max(one, two)] = min(one, two)
                    found.append((int(rep[a]), int(rep[b])))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text of a, text of b) with whether they are similar, by their full sets."""
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        one, two = tx.buffers(batch.column(2)), tx.buffers(batch.column(3))
        for i, j in tx.steps(one[1] + two[1]):
            (x, xb), (y, yb) = (shingle_sets(d[o[i] : o[j]], o[i : j + 1] - o[i]) for d, o in (one, two))
            for k in range(j - i):
                ok[i + k] = alike(x[xb[k] : xb[k + 1]], y[yb[k] : yb[k + 1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "linked"])


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = store.written(docs.select("doc_id", "text").join(store.sized(store.written(ids, "pair-ids")), "doc_id", "left_semi"), "pair-texts")
    left, right = some.select(F.col("doc_id").alias("a"), F.col("text").alias("t1")), some.select(F.col("doc_id").alias("b"), F.col("text").alias("t2"))
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return store.written(both.select("a", "b", "t1", "t2").mapInArrow(tx.lean(_similar), "a long, b long, linked boolean"), "links")


def _tiles(docs: DataFrame, dense: DataFrame, region: int) -> tuple[DataFrame, DataFrame]:
    """Dense regions (rep, region, tree) in tiles (rep, region, tree, whole) of about region documents, and the links (a, b) found on the way.

    Each document is verified against one leader, the smallest document of its regions that shares most of them. In
    each region the component with most documents then needs no comparison inside: the blocks of the others meet each
    other and its blocks. Regions of one component go.
    """
    lead = store.sized(store.written(dense.groupBy("region").agg(F.min("rep").alias("a")), "leaders"))
    votes = dense.join(lead, "region").where("a <> rep").groupBy("rep", "a").agg(F.count("*").alias("n"))
    to = votes.groupBy("rep").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("to"))
    links = _verified(docs, store.written(to.select((-F.col("to.a")).alias("a"), F.col("rep").alias("b")), "led-dense")).where("linked").select("a", "b")
    parts = store.written(components(links), "dense-parts").select(F.col("id").alias("rep"), "component")
    named = store.written(dense.join(parts, "rep", "left").select("rep", "region", "tree", F.coalesce("component", "rep").alias("comp")), "dense-named")
    each = named.groupBy("region", "comp").agg(F.count("*").alias("n"))
    main = each.groupBy("region").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n")).where("n > main.n")
    main = main.select("region", F.col("main.comp").alias("main"), F.ceil((F.col("n") - F.col("main.n")) * 2 / region).alias("s"), F.ceil(F.col("main.n") * 2 / region).alias("m"))
    rows = named.join(store.sized(store.written(main, "dense-main")), "region")
    ours, place = F.col("comp") == F.col("main"), F.xxhash64("rep")
    rows = rows.withColumn("k", F.when(ours, F.col("s") + F.pmod(place, F.col("m"))).otherwise(F.pmod(place, F.col("s"))))
    last = F.when(ours, F.col("s")).otherwise(F.col("s") + F.col("m")) - 1
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.select("rep", F.xxhash64("region", F.least("k", "j"), F.greatest("k", "j")).alias("region"), "tree", F.col("region").alias("whole")), links


def _regions(docs: DataFrame, reps: DataFrame, region: int) -> tuple[DataFrame, DataFrame | None]:
    """(rep, region, tree, whole): the regions of every level that are to be compared; of a tile, whole is the region that it is of. And links (a, b), if some were found."""
    out, links, search = None, None, reps.select("rep", "sig")
    for level, (depth, trees) in enumerate(LEVELS):
        rows = search.mapInArrow(tx.lean(_prefixes(level, depth, trees)), "rep long, region long, tree int")
        rows = store.written(rows, "prefixes")
        size = rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
        met = store.written(rows.join(size, "region").select("rep", "region", "tree", "n"), "regions")
        store.drop(rows)
        fit = met.where(F.col("n") <= region).select("rep", "region", "tree", F.lit(None).cast("long").alias("whole"))
        dense = met.where(F.col("n") > region)
        out = fit if out is None else out.union(fit)
        if dense.isEmpty():
            break
        if level == len(LEVELS) - 1:
            tiles, links = _tiles(docs, dense, region)
            out = out.union(tiles)
            break
        ids = store.written(dense.select("rep").distinct(), "dense")
        search = docs.select(F.col("doc_id").alias("rep"), "text").join(store.sized(ids), "rep", "left_semi")
    return out, links


def near_duplicates(docs: DataFrame, *, region: int = REGION) -> DataFrame:
    """One row per document: n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    docs: doc_id, text; other columns are ignored. Null, empty and wordless texts have an empty set
    and are linked with nothing. Rows of equal doc_id: see store.keyed.
    """
    docs = store.keyed(docs)
    sketch = store.written(docs.mapInArrow(tx.lean(_sketch), SKETCH), "sketches")
    classes = store.written(sketch.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = sketch.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "sig", "bits")
    regions, early = _regions(docs, reps, region)
    met = store.written(regions, "met")
    some = store.written(reps.join(met.select("rep").distinct(), "rep", "left_semi").select("rep", "bits"), "met-bits")
    shares = max(24, met.count() // 50_000 + 1)

    def candidates(rows: DataFrame, first: bool) -> DataFrame:
        rows = rows.join(some, "rep").select("region", "rep", "comp", "bits", F.pmod(F.xxhash64("region"), F.lit(shares)).alias("share"))
        found = rows.groupBy("share").applyInArrow(tx.lean(_compare(first)), "a long, b long, near double")
        if first:
            one = found.groupBy("b").agg(F.max(F.struct("near", (-F.col("a")).alias("a"))).alias("to"))
            return one.select((-F.col("to.a")).alias("a"), "b")
        return found.select("a", "b").distinct()

    def mixed(parts: DataFrame) -> DataFrame:
        """Members of the regions that have several components."""
        named = met.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("region", "tree", "whole", "rep", F.coalesce("component", "rep").alias("comp"))
        several = named.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("region")
        return store.written(named.join(several, "region", "left_semi"), "mixed")

    def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
        return store.written(components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links)), "parts")

    alone = met.withColumn("comp", F.col("rep"))
    if early is not None:
        known = store.written(components(early), "early-parts")
        alone = met.join(known.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    led_by = _verified(docs, store.written(candidates(alone, True), "led"))
    links = led_by.where("linked").select("a", "b")
    parts = store.written(components(links if early is None else links.union(early)), "parts")
    rest = mixed(parts)
    if not rest.isEmpty():
        new = store.written(candidates(rest, False).join(led_by, ["a", "b"], "left_anti"), "best")
        parts = merged(parts, _verified(docs, new).where("linked").select("a", "b"))
        rest = mixed(parts)
    if not rest.isEmpty():
        ids = store.written(rest.select(F.col("rep").alias("doc_id")).distinct(), "unsettled")
        texts = store.written(docs.select("doc_id", "text").join(store.sized(ids), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep"), "unsettled-texts")
        trees = rest.groupBy("rep").agg(F.count("*").alias("n"), F.collect_set(F.struct("tree", F.coalesce("whole", "region").alias("whole"))).alias("met"))
        texts = store.written(trees.join(texts, "rep"), "unsettled-trees")
        size = texts.agg(F.sum(F.col("n") * (F.octet_length("text") + 12 * F.size("met")))).first()[0] or 0
        tasks = max(24, int(size // SETTLED) + 1)
        rows = rest.drop("whole").join(texts.drop("n").hint("merge"), "rep").withColumn("share", F.pmod(F.xxhash64("region"), F.lit(tasks)))
        parts = merged(parts, store.written(rows.groupBy("share").applyInArrow(tx.lean(_settle), "a long, b long"), "joins"))
    whole = parts
    to = classes.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("c"))
    out = store.spread_join(sketch.select("doc_id", "n_shingles", "d1", "d2"), to, ["d1", "d2"], "doc_id", "left")
    own = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("c")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (own == F.col("doc_id")).alias("kept"))
