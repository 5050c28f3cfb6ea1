"""Language ID by multilingual mixture inference.

Each language learned has a smoothed distribution of hashed character n-grams (letters lower-cased,
everything else a space). A document is a mixture of languages: expectation-maximisation estimates
its proportions from the n-grams' likelihoods. Then sets of one language, two and so on, in the order
of their proportions, are fitted again, and the set with the greatest penalised likelihood is taken;
the document's language is the one with the greatest share in it.

The distributions come from at most SAMPLE documents of each language, chosen by a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import linear, store
from trigrail.llm import text as tx

ORDERS, BITS, SMOOTH = (1, 2, 3), 16, 0.5
#: Most documents of a language that are learned from.
SAMPLE = 4000
#: Expectation-maximisation steps; what another language has to gain for each log of the number of n-grams.
ROUNDS, PENALTY = 12, 12.0
#: Characters that one step of the inference holds, about.
STEP = 500_000
#: Probabilities (n-grams times languages) that a block of documents holds, about.
BLOCK = 8_000_000
UNKNOWN = "und"


class Letters:
    """Which code points are letters."""

    def __init__(self) -> None:
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def counts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text (n-gram bins, counts); none for a text without letters."""
        points, offs = linear.characters(texts)
        points = np.where(self.is_letter[points], points, 32)
        h = tx.mix(points.astype(np.uint64) + np.uint64(1))
        grams = []
        for n in ORDERS:
            g = (tx.window_hashes(h, n, seed=n) >> np.uint64(64 - BITS)).astype(np.int64)
            solid = points != 32
            ok = solid[: len(g)].copy()
            for k in range(1, n):
                ok |= solid[k : len(g) + k]
            grams.append((n, g, ok))
        out = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            idx = np.concatenate([g[a : max(a, b - n + 1)][ok[a : max(a, b - n + 1)]] for n, g, ok in grams])
            c = np.bincount(idx, minlength=1 << BITS) if len(idx) > 2000 else None
            if c is None:
                bins, n_ = np.unique(idx, return_counts=True)
            else:
                bins = np.flatnonzero(c)
                n_ = c[bins]
            out.append((bins, n_))
        return out


def learn(docs: DataFrame, *, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [languages, bins]) from docs (doc_id, text, lang)."""
    known = docs.where("lang is not null and text is not null")
    n = known.groupBy("lang").agg(F.count("*").alias("n")).withColumn("most", sample / F.col("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) / 1e6  # the expected number is bounded
    rows = known.join(store.sized(store.written(n, "languages")), "lang").where(draw < F.col("most")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            _, offs = tx.buffers(batch.column(1))
            for i, j in tx.steps(offs, STEP):
                for lang, (bins, c) in zip(langs[i:j], letters.counts(batch.column(1).slice(i, j - i).to_pylist()), strict=True):
                    sums.setdefault(lang, np.zeros(1 << BITS))[bins] += c
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.astype("<f4").tobytes() for s in sums.values()], pa.binary())], names=["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BITS)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_py(), "<f4")
        return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    sums = rows.mapInArrow(tx.lean(count), "lang string, counts binary").groupBy("lang").applyInArrow(tx.lean(add), "lang string, counts binary")
    got = sorted((r.lang, np.frombuffer(r.counts, "<f4")) for r in store.written(sums, "ngrams").collect())  # a row a language
    if not got:
        return [], np.zeros((0, 1 << BITS), np.float32)
    c = np.stack([x for _, x in got]).astype(float) + SMOOTH
    return [lang for lang, _ in got], np.log(c / c.sum(1, keepdims=True)).astype(np.float32)


def mixture(p: np.ndarray, c: np.ndarray, of: np.ndarray, start: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [documents, languages], log-likelihood by document) by expectation-maximisation.

    p: probabilities of n-grams [n-grams, languages]; c: their counts; of: their document; start: the first
    of each document; use: which languages each document may have.
    """
    share = use / use.sum(1, keepdims=True)
    total = np.add.reduceat(c, start)[:, None]
    for _ in range(ROUNDS):
        each = p * share[of]
        each *= (c / each.sum(1))[:, None]
        share = np.add.reduceat(each, start, axis=0) / total
    return share, np.add.reduceat(c * np.log((p * share[of]).sum(1)), start)


def infer(rows: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, its share, number of languages) of each document; every one of rows has n-grams.

    Mixtures are fitted over all languages, in blocks of documents.
    """
    offs = np.concatenate(([0], np.cumsum([len(b) for b, _ in rows])))
    return tuple(np.concatenate(f) for f in zip(*(_infer(rows[i:j], logs) for i, j in tx.steps(offs, BLOCK // len(logs))), strict=True))


def _infer(rows: list[tuple[np.ndarray, np.ndarray]], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.concatenate(([0], np.cumsum([len(b) for b, _ in rows])))[:-1]
    of = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    bins = np.concatenate([b for b, _ in rows])
    c = np.concatenate([n for _, n in rows]).astype(np.float32)
    alone = np.stack([np.add.reduceat(c * log[bins], start) for log in logs], 1)
    order = np.argsort(-alone, axis=1, kind="stable")  # the likeliest languages first
    best, share, size = order[:, 0].copy(), np.ones(len(rows)), np.ones(len(rows), np.int64)
    top = alone[np.arange(len(rows)), best].astype(float)
    if order.shape[1] == 1:
        return best, share, size
    p = np.exp(np.stack([logs[order[of, k], bins] for k in range(order.shape[1])], 1))
    full, most = mixture(p, c, of, start, np.ones(order.shape, np.float32))
    price = PENALTY * np.log(np.add.reduceat(c, start))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    value = top - price
    open_ = most - 2 * price > value  # else no set of more languages can be better
    for k in range(2, order.shape[1] + 1):
        some = np.flatnonzero(open_)
        if not len(some):
            break
        at = np.flatnonzero(open_[of])
        new = np.searchsorted(some, of[at])
        s, ll = mixture(p[at], c[at], new, np.searchsorted(new, np.arange(len(some))), (rank[some] < k).astype(np.float32))
        better = ll - k * price[some] > value[some]
        win = some[better]
        value[win] = (ll - k * price[some])[better]
        lead = s[better].argmax(1)
        best[win], share[win], size[win] = order[win, lead], s[better].max(1), k
        open_[some] = most[some] - (k + 1) * price[some] > value[some]
    return best, np.clip(share, 0, 1), size


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score (the language's share), n_langs. Null texts and texts without letters: und, 0, 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = sent.value
        letters = Letters()
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            _, offs = tx.buffers(batch.column(1))
            for i, j in tx.steps(offs, STEP):
                rows = letters.counts([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                full = np.array([len(b) > 0 for b, _ in rows]) & (len(langs) > 0)
                lang, share, size = np.full(j - i, len(langs)), np.zeros(j - i), np.zeros(j - i, np.int64)
                if full.any():
                    lang[full], share[full], size[full] = infer([r for r, f in zip(rows, full, strict=True) if f], logs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(names[lang].tolist(), pa.string()), pa.array(share), pa.array(size)], names=["doc_id", "lang_pred", "score", "n_langs"])

    return docs.select("doc_id", "text").mapInArrow(tx.lean(run), "doc_id long, lang_pred string, score double, n_langs long")


def languages(docs: DataFrame, *, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per document: held_out (crc32 of doc_id as text leaves held by folds; not learned), lang_pred, score, n_langs.

    docs: doc_id, text, lang; other columns are ignored. lang is read of learned documents only. Rows of
    equal doc_id: see store.keyed. Without anything learned all is und.
    """
    docs = store.keyed(docs, "lang")
    out_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held
    out = predict(docs, learn(docs.where(~out_of)))
    return out.select("doc_id", out_of.alias("held_out"), "lang_pred", "score", "n_langs")
