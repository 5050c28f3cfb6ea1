"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are whether a text has a hashed character n-gram. Each is scaled by the logarithm of the
ratio of its (smoothed, normalised) counts in toxic and other documents, each text's vector is brought
to length 1, and a logistic model is trained on that. The fit reads at most SAMPLE labelled documents of each class, chosen by a
hash of their ids, and weighs them so that the classes keep their shares; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import linear, store
from trigrail.llm import text as tx

# ORDERS, SMOOTH, LEAST and STEPS were chosen by cross-validation inside the rows that are fitted.
ORDERS, BITS, SMOOTH = (2, 3, 4, 5), 19, 0.2
#: Fitted documents that must have a feature for it to count.
LEAST = 8
#: Batches that a fit takes at least: a small sample has few in an epoch.
STEPS = 1200
#: Bytes of text that one step holds, about.
STEP = 1 << 19
#: Most labelled documents of each class that are fitted.
SAMPLE = 2500


#: Ratios by feature, weights by feature, bias.
Model = tuple[np.ndarray, np.ndarray, float]


def _scaled(row: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a text's vector, of length 1 (or 0)."""
    value = ratio[row]
    row, value = row[value != 0], value[value != 0]
    return row, value / max(float(np.sqrt((value**2).sum())), 1e-9)


def _fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    offs = np.cumsum([0, *map(len, texts)])
    rows = [r.astype(np.int32) for i, j in tx.steps(offs, STEP) for r in linear.character_ngrams(texts[i:j], ORDERS, BITS)]
    counts = np.full((2, 1 << BITS), SMOOTH)
    for r, y, w in zip(rows, toxic, weight, strict=True):
        counts[int(y), r] += w
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[np.bincount(np.concatenate(rows), minlength=1 << BITS) < LEAST] = 0
    w, bias = linear.train([_scaled(r, ratio) for r in rows], toxic.astype(float), weight, 1 << BITS, steps=STEPS)
    return ratio, w, bias


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """The model from labels (doc_id, toxic) of docs (doc_id, text).

    Labels that are neither 0 nor 1 and ids without a document don't count; of several labels of an id the
    greatest does. With fewer than two classes all scores are the smoothed share of toxic ones.
    """
    known = store.columns(labels, "doc_id", "toxic").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = store.written(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    n = dict(known.groupBy("toxic").count().collect())
    if len(n) < 2:
        share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return np.zeros(1 << BITS), np.zeros(1 << BITS), float(np.log(share / (1 - share)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) / 1e6  # the expected number is bounded
    most = F.when(F.col("toxic") == 1, sample / n[1]).otherwise(sample / n[0])
    chosen = store.sized(store.written(known.where(draw < most), "sample"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "toxic", F.lit(0).alias("all"), "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        toxic = table.column("toxic").to_numpy()
        have = np.bincount(toxic, minlength=2)
        share = np.array([n[0], n[1]]) / (n[0] + n[1])
        weight = (share / np.maximum(have, 1) * len(toxic))[toxic]
        ratio, w, bias = _fit([t or "" for t in table.column("text").to_pylist()], toxic, weight)
        return pa.table({"ratio": pa.array([ratio.astype("<f4").tobytes()], pa.binary()), "w": pa.array([w.astype("<f4").tobytes()], pa.binary()), "bias": [float(bias)]})

    model = store.written(rows.groupBy("all").applyInArrow(tx.lean(run), "ratio binary, w binary, bias double"), "model").first()
    return np.frombuffer(model.ratio, "<f4"), np.frombuffer(model.w, "<f4"), model.bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5). Null texts count as empty; theirs is the bias."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w, bias = sent.value
        for batch in batches:
            _, offs = tx.buffers(batch.column(1))
            for i, j in tx.steps(offs, STEP):
                part = batch.slice(i, j - i)
                rows = linear.character_ngrams([t or "" for t in part.column(1).to_pylist()], ORDERS, BITS)
                s = linear.sigmoid(np.array([float(w[r] @ v) for r, v in (_scaled(r, ratio) for r in rows)]) + bias)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(tx.lean(run), "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5) -> DataFrame:
    """One row per document: held_out (crc32 of doc_id as text divides by folds; not fitted), score, predicted.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. Rows of equal doc_id: see store.keyed.
    """
    docs = store.keyed(docs)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0
    out = score(docs, fit(docs.where(~held), labels))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
