"""The corpus pipeline: quality, near-dedup, substring dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents, the last one what the encoder makes of them. docs may have other columns, of any
names, which are left out. Rows without doc_id go; of rows with one doc_id that with the smallest text stays (null last; see store.keyed).
Null and empty texts pass every stage as they are: they are not rejected, are nobody's copies, lose nothing and have no ids.
An empty table gives an empty one. Texts are worked on whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrail.llm import bpe, decontaminate, minhash_dedup, quality, store, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs, one of each doc_id, whose doc_id is in ids (left_anti: is not); ids are broadcast only if they are few."""
    return store.keyed(docs, *COLUMNS[2:]).join(store.sized(store.written(ids.select("doc_id"), "ids")), "doc_id", how).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _kept(docs, quality.quality(docs).where("not kept"), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return _kept(docs, minhash_dedup.near_duplicates(docs).where("not kept"), "left_anti")


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; a text that loses some is its other words with single spaces."""
    cut = store.written(substring_dedup.remove_repeats(docs).where("n_removed > 0").select("doc_id", "kept_text"), "cut")
    changed = _kept(docs, cut).drop("text", "n_chars").join(cut.hint("merge"), "doc_id")
    changed = changed.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))
    return _kept(docs, cut, "left_anti").unionByName(changed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _kept(docs, found.select("doc_id").distinct(), "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of these and of what they decode to."""
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=False)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]
#: The label model, the scorer and the merges are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
