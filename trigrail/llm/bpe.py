"""Byte-level BPE by corpus-level merge replay, and decoding.

Texts are cut into pre-tokens ("words") slice by slice (SLICE bytes of text); a slice is kept as the
list of its distinct words and, of each document, the places in that list. The words of all slices are dealt by hash to
buckets, packed, and a bucket's distinct words are replayed once: they are laid out together, an inverted index leads from each
mergeable pair, by its rank, to the places where it stands in any word; merges are replayed in rank
order over all words at once, and each touches only the two neighbours of the merged pair, whose new
pairs enter the index. The words' ids go back to the slices, and a slice and its list give the
documents' ids. Of all this only words and ids are shuffled: the slices lie in a bucketed table. There are FAN buckets at most, so that
rows grow as the corpus; a bucket of more than HELD bytes of words is replayed in parts.

A merge may make a pair of lower rank than its own, and then the word's other places of the current
rank have to wait: they re-enter the index and come up after the lower rank.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import fingerprints as fp
from trigrail.llm import store
from trigrail.llm import text as tx

#: Bytes of text in a slice (a longer text is one of its own); bytes of words that a task holds, and that it replays together; characters that are cut into words, and ids that are decoded, at once.
SLICE, HELD, REPLAYED, PIECE, DECODED = 8 << 20, 4 << 20, 1 << 20, 1 << 20, 1 << 16
#: Most buckets of words; bytes of distinct words in a byte of a slice, about (for the number of buckets only).
FAN, SHARE = 1024, 0.25
CODED = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("docs", "counts", "codes", "place", "lengths", "words"))])
WORD_IDS = pa.schema([("of", pa.int64()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("ids", pa.binary())])
RESULT = "doc_id long, n_tokens long, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


class Replay:
    """Encodes many words together. ranks: token bytes to rank, every single byte included."""

    NONE = 2**31 - 1

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[int, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the concatenations of tokens, NONE where there is none or a token is -1."""
        keys, which = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        out = []
        for k in keys.tolist():
            r = self.pairs.get(k)
            if r is None:
                x, y = self.token.get(k >> 32), self.token.get(k & 0xFFFFFFFF)
                r = self.NONE if k < 0 or x is None or y is None else self.ranks.get(x + y, self.NONE)
                self.pairs[k] = r
            out.append(r)
        return np.array(out, np.int32)[which]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Of each word its ids as little-endian unsigned 32-bit integers."""
        whole = [self.ranks.get(w) for w in words]
        todo = [w for w, r in zip(words, whole, strict=True) if r is None]
        lengths = np.array([len(w) for w in todo], np.int64)
        word, tok = np.repeat(np.arange(len(todo), dtype=np.int32), lengths), self._merged(todo, lengths)
        stays = tok >= 0
        ends = np.cumsum(np.bincount(word[stays], minlength=len(todo))) * 4
        raw = tok[stays].astype("<u4").tobytes()
        merged = iter([raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if todo else [])
        return [next(merged) if r is None else r.to_bytes(4, "little") for r in whole]

    def _merged(self, todo: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Tokens by place after all merges, -1 where a place went into the token before it."""
        n, ends = int(lengths.sum()), np.cumsum(lengths)
        none = self.NONE
        tok = np.append(self.byte[np.frombuffer(b"".join(todo), np.uint8)], np.int32(-1))  # place n stands for no neighbour
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[ends - 1], prv[ends - lengths] = n, n
        by = np.full(n + 1, none, np.int32)  # rank of the pair of a place and the next
        by[:n] = self.rank(tok[:n], tok[nxt[:n]]) if n else by[:n]
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(at: np.ndarray) -> None:
            r = by[at]
            at, r = at[r < none], r[r < none]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, some in zip(r[np.concatenate(([0], cut))].tolist() if len(r) else [], np.split(at, cut), strict=False):
                if k not in places:
                    places[k] = []
                    heapq.heappush(heap, k)
                places[k].append(some)

        word = np.repeat(np.arange(len(todo), dtype=np.int32), lengths)
        index(np.arange(n, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            at = np.concatenate(places.pop(r))
            at = np.unique(at[by[at] == r])
            if len(at) > 1 and (word[at[1:]] == word[at[:-1]]).any():
                at, rest = self._together(r, at, tok, nxt, prv, word)
                index(rest)
            if not len(at):
                continue
            gone = nxt[at]
            after, ahead = nxt[gone], prv[at]
            tok[at], tok[gone], by[gone] = r, -1, none
            nxt[at], prv[after] = after, at
            by[at] = self.rank(tok[at], tok[after])
            by[ahead] = self.rank(tok[ahead], tok[at])
            index(np.concatenate((at, ahead)))
        return tok[:n]

    def _together(self, r: int, at: np.ndarray, tok: np.ndarray, nxt: np.ndarray, prv: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places of rank r those to merge now, and those that have to come up again.

        In a run of overlapping places every second one merges. If that could make a pair of rank r or
        less on the way, only the first place of each word merges: what it makes may come before the rest.
        """
        here = np.full(len(at), r, np.int32)
        sides = np.concatenate((self.rank(here, tok[nxt[nxt[at]]]), self.rank(tok[prv[at]], here), self.rank(here[:1], here[:1])))
        if (sides > r).all():
            head = np.ones(len(at), bool)
            head[1:] = at[1:] != nxt[at[:-1]]
            first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            return at[(np.arange(len(at)) - first) % 2 == 0], at[:0]
        head = np.ones(len(at), bool)
        head[1:] = word[at[1:]] != word[at[:-1]]
        return at[head], at[~head]


def pretokens(pattern: str):
    """A function from a text to its units: strings that begin at the text's start or at a lone space between two other characters, neither of them white.

    Matches of the pattern never cross such a space: only the match after it can take it in. A unit's
    matches so don't depend on the rest of the text, and a unit met again need not be matched again.
    """
    import regex

    matches = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    uneven = re.compile(r" \s|\s ")

    def units(text: str) -> list[str]:
        if not text:
            return []
        if text[0].isspace() or text[-1].isspace() or uneven.search(text):
            return re.split(r"(?<=\S)(?= \S)", text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    return units, matches.findall


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about size characters, cut only where units begin."""
    begins, start = re.compile(r"(?<=\S) (?=\S)"), 0
    while len(text) - start > size:
        cut = begins.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def coder(pattern: str) -> Callable[[list[str]], tuple[list[bytes], np.ndarray, np.ndarray]]:
    """A function from the texts of a slice to (distinct words, words of each text, places in the list of distinct ones)."""
    units, matches = pretokens(pattern)

    def code(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        index: dict[str, int] = {}
        rows, lengths = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            for piece in pieces(text):
                u = units(piece)
                for x in set(u).difference(index):
                    index[x] = len(index)
                rows.append(np.fromiter(map(index.__getitem__, u), np.int32, len(u)))
                lengths[k] += len(u)
        words: dict[str, int] = {}
        parts = [[words.setdefault(w, len(words)) for w in matches(u)] for u in index]
        size = np.array([len(x) for x in parts], np.int64)
        unit = np.concatenate([np.zeros(0, np.int32), *rows])
        codes = np.array([w for x in parts for w in x], "<u4")[fp.ragged(np.cumsum(size) - size, size, unit)] if len(unit) else np.zeros(0, "<u4")
        ends = np.concatenate(([0], np.cumsum(size[unit]))) if len(unit) else np.zeros(1, np.int64)
        counts = np.diff(ends[np.concatenate(([0], np.cumsum(lengths)))])
        return [w.encode() for w in words], counts, codes

    return code


def together(counts: np.ndarray, codes: np.ndarray, size: np.ndarray, start: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """The ids of each text of a slice; size, start: of its distinct words' ids in ids."""
    for a, b in pairwise(np.concatenate(([0], np.cumsum(counts))).tolist()):
        yield ids[fp.ragged(start, size, codes[a:b])].tobytes() if b > a else b""


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts, as one slice, to the ids of each (bytes, little-endian unsigned 32-bit integers)."""
    replay, code = Replay(ranks), coder(pattern)

    def encode(texts: list[str]) -> list[bytes]:
        words, counts, codes = code(texts)
        ids = replay.encode(words)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        return list(together(counts, codes, size, np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")))

    return encode


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their lowest bytes first, then the next ones, compressed."""
    raw = np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def loosened(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def decoder(ranks: dict[bytes, int]) -> Callable[[bytes], Iterator[bytes]]:
    """A function from ids to the bytes that they stand for, in parts."""
    token = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        token[r] = t

    def decode(ids: bytes) -> Iterator[bytes]:
        for i in range(0, len(ids), 4 * DECODED):
            yield b"".join(map(token.__getitem__, np.frombuffer(ids[i : i + 4 * DECODED], "<u4").tolist()))

    return decode


def _coded(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(pattern)
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, counts, codes = code([t for _, t in held])
            docs = np.array([d for d, _ in held], "<i8")
            name = int(docs.min())  # of no other slice, and the same if the task runs again
            raw = np.frombuffer(b"".join(words), np.uint8)
            n = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(n)
            bucket = ((tx.word_hashes(raw, ends - n, ends) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            dealt = np.argsort(bucket, kind="stable")
            often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # so that most codes are small
            code_of, place = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            code_of[often], place[dealt] = np.arange(len(words)), np.arange(len(words))
            row = {"slice": name, "bucket": -1, "docs": docs.tobytes(), "counts": counts.astype("<i8").tobytes(), "codes": squeezed(code_of[codes]), "place": squeezed(place[often])}
            yield pa.RecordBatch.from_pylist([row], CODED)
            edge = fp.cuts(bucket[dealt])
            rows = []
            for lo, hi in pairwise(edge.tolist()):
                text = raw[fp.ragged(ends - n, n, dealt[lo:hi])].tobytes()
                rows.append({"slice": name, "bucket": int(bucket[dealt[lo]]), "lengths": squeezed(n[dealt[lo:hi]]), "words": len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)})
            yield pa.RecordBatch.from_pylist(rows, CODED)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            _, offs = tx.buffers(batch.column(1))
            for k, n in enumerate(np.diff(offs).tolist()):
                if held and size + n > SLICE:
                    yield from flush()
                    held, size = [], 0
                held.append((ids[k], batch.column(1)[k].as_py() or ""))
                size += n
        if held:
            yield from flush()

    return run


def _replayed(sent):
    """Rows of buckets, in their order, to their words' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = Replay(sent.value)
        held: list[tuple[int, int, list[bytes]]] = []
        size, now = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            known = dict.fromkeys(w for *_, words in held for w in words)
            new = list(known)
            for i, j in tx.steps(np.cumsum([0, *map(len, new)]), REPLAYED):
                known.update(zip(new[i:j], replay.encode(new[i:j]), strict=True))
            for name, bucket, words in held:
                ids = [known[w] for w in words]
                row = {"of": name, "bucket": bucket, "lengths": squeezed(np.array([len(x) // 4 for x in ids])), "ids": squeezed(np.frombuffer(b"".join(ids), "<u4"))}
                yield pa.RecordBatch.from_pylist([row], WORD_IDS)

        for batch in batches:
            for name, bucket, lengths, words in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                raw = pa.decompress(words[8:], int.from_bytes(words[:8], "little"), "zstd", asbytes=True)
                if held and (bucket != now or size + len(raw) > HELD):
                    yield from flush()
                    held, size = [], 0
                cut = np.concatenate(([0], np.cumsum(loosened(lengths), dtype=np.int64))).tolist()
                held.append((name, bucket, [raw[a:b] for a, b in pairwise(cut)]))
                size, now = size + len(raw), bucket
        if held:
            yield from flush()

    return run


def _joined(sent, ids: bool, decoded: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(slices: pa.Table, words: pa.Table) -> pa.Table:
        decode = decoder(sent.value)
        order = np.argsort(words.column("bucket").to_numpy(), kind="stable").tolist()
        none = np.zeros(0, "<u4")
        size = np.concatenate([none, *(loosened(words.column("lengths")[k].as_py()) for k in order)]).astype(np.int64)
        flat = np.concatenate([none, *(loosened(words.column("ids")[k].as_py()) for k in order)])
        start = np.cumsum(size) - size
        out: list[list] = [[] for _ in schema]
        for docs, counts, codes, place in zip(*(slices.column(c).to_pylist() for c in ("docs", "counts", "codes", "place")), strict=True):  # one row
            at = loosened(place).astype(np.int64)
            texts = together(np.frombuffer(counts, "<i8"), loosened(codes), size[at], start[at], flat)
            for doc, got in zip(np.frombuffer(docs, "<i8").tolist(), texts, strict=True):
                digest, back = hashlib.sha256(), []
                for part in decode(got):
                    digest.update(part)
                    if decoded:
                        back.append(part)
                row = (doc, len(got) // 4, got if ids else None, b"".join(back) if decoded else None, hashlib.sha256(got).hexdigest(), digest.hexdigest())
                for c, v in zip(out, row, strict=True):
                    c.append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def encode_decode(docs: DataFrame, ranks: str, pattern: str, *, ids: bool = True, decoded: bool = True) -> DataFrame:
    """One row per document: n_tokens, ids (ids=False: null), decoded (decoded=False: null), ids_sha256, decoded_sha256.

    docs: doc_id, text; other columns are ignored. Null texts count as empty: no ids. Rows of equal
    doc_id: see store.keyed. ranks: a rank file on the driver; its content travels.
    """
    docs = store.keyed(docs)
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, min(FAN, int(total * SHARE // HELD) + 1))
    kinds = "slice long, bucket int, docs binary, counts binary, codes binary, place binary, lengths binary, words binary"
    slices = store.bucketed(docs.mapInArrow(tx.lean(_coded(pattern, buckets)), kinds), "slices", "slice", int(total // (2 * SLICE)))
    words = slices.where("bucket >= 0").select("slice", "bucket", "lengths", "words").repartition("bucket").sortWithinPartitions("bucket")
    known = words.mapInArrow(tx.lean(_replayed(sent)), "of long, bucket int, lengths binary, ids binary")
    texts = slices.where("bucket < 0").select("slice", "docs", "counts", "codes", "place")
    return texts.groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(tx.lean(_joined(sent, ids, decoded)), RESULT)
