"""Token counts with a digest cache.

The cache is a Parquet table of (content digest, tokenizer version digest, n_tokens). A run joins the
digests of its texts to it, encodes each distinct text it misses once, appends those counts, and joins
again. Content is normalised only where no tokenizer can tell: null becomes empty. The version digest
covers the model's bytes and the library's version, so another model never meets another's counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import store
from trigrail.llm import text as tx

LIMIT = 4096
#: Most pieces of text whose counts one task remembers.
REMEMBERED = 1_000_000
CACHE = "digest binary, version string, n_tokens long"


def piece_counter(model: bytes) -> Callable[[list[str]], list[int]]:
    """Counts as the sentencepiece library gives them, without begin or end tokens.

    If no piece of the vocabulary reaches over a word's start or a line's end, and the model doesn't
    rewrite text, merges never cross these, and counts of the parts add up: each distinct part is then
    encoded once. Otherwise texts are encoded whole.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    mark = "▁"
    probe = "a  b\néﬁ① \tÉ Ａ "
    apart = all(mark not in p.lstrip(mark) and "\n" not in p for p in pieces) and sp.is_unknown(sp.piece_to_id(mark)) is False
    apart = apart and sp.normalize(probe) == mark + probe.replace(" ", mark)
    part = re.compile(r" *[^ \n▁]+| +|\n")
    line = sp.encode("\n")
    apart = apart and len(line) == 2
    known: dict[str, int] = {}

    def learn(parts: list[str]) -> None:
        """Many parts are encoded as the lines of one text: the line ends' ids tell them apart."""
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            ids = np.array(sp.encode("\n" + "\n".join(some) + "\n"))
            known.update(zip(some, (np.diff(np.flatnonzero(ids == line[1])) - 1).tolist(), strict=True))
        known["\n"] = 1

    def count(texts: list[str]) -> list[int]:
        if not apart:
            return [len(x) for x in sp.encode(texts, num_threads=1)]
        if len(known) > REMEMBERED:
            known.clear()
        rows = [None if mark in t or "\0" in t else part.findall(" " + t) if t else [] for t in texts]
        new = set().union(*(r for r in rows if r)).difference(known, "\n")
        learn([*new])
        return [len(sp.encode(t)) if r is None else sum(map(known.__getitem__, r)) for t, r in zip(texts, rows, strict=True)]

    return count


def json_counter(model: bytes) -> Callable[[list[str]], list[int]]:
    """Counts as the tokenizers library gives them, without special tokens, truncation or padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model.decode())
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def version_of(path: str) -> tuple[bytes, str, Callable]:
    """(model bytes, version digest, counter) of a tokenizer file: .model or .json."""
    model = Path(path).read_bytes()
    if path.endswith(".model"):
        import sentencepiece as library

        counter = piece_counter
    else:
        import tokenizers as library

        counter = json_counter
    return model, hashlib.sha256(model + library.__name__.encode() + library.__version__.encode()).hexdigest(), counter


def _exists(df: DataFrame, path: str) -> bool:
    context = df.sparkSession.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p)


def _read(df: DataFrame, cache: str, version: str) -> DataFrame:
    """Cached counts of one version; a digest that two writers appended has one row."""
    rows = df.sparkSession.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, *, limit: int = LIMIT) -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit; what the cache lacked is appended to it.

    docs: doc_id, text; other columns are ignored. Null texts count as empty: 0 tokens. Rows of equal
    doc_id: see store.keyed. tokenizer: a .model or .json file on the driver; its bytes travel.
    """
    docs = store.keyed(docs)
    model, version, counter = version_of(tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    content = F.coalesce("text", F.lit(""))
    seen = store.written(docs.select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest")), "digests")
    misses = seen
    if _exists(docs, cache):
        misses = seen.join(_read(docs, cache, version), "digest", "left_anti")
    misses = store.written(misses.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "misses")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                texts = [t or "" for t in batch.column(0).slice(i, 500).to_pylist()]
                digests = [hashlib.sha256(t.encode()).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([version] * len(texts)), pa.array(np.array(count(texts), np.int64))], names=["digest", "version", "n_tokens"])

    fresh = docs.join(store.sized(misses), "doc_id", "left_semi").select("text").mapInArrow(tx.lean(encode), CACHE)
    fresh.write.mode("append").option("compression", "zstd").parquet(cache)
    out = store.spread_join(seen, _read(docs, cache, version), ["digest"], "doc_id")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
