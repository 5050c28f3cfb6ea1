"""Tokens and decontamination against the libraries and plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from trigrail.llm import bpe, decontaminate, token_counts

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")
SIGNS = " \n\t▁aeé'stx1.,!ñ日本  \x1c\x00😀A<s>"


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(1)
    some = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    return [*some, "", " ", "  ", "\n", "a" * 5000, " " * 3000 + "x", "ababab" * 500, "</s><s> <unk>", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_pieces_count_as_the_library_counts(odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        assert token_counts.piece_counter(f.read())(odd) == [len(x) for x in sp.encode(odd)]


def test_token_counts_and_cache(spark, docs, corpus, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {d: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for d, t in corpus.items()}
    cache = f"{tmp_path}/cache"
    first = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs.where("doc_id < 30"), MODEL, cache, limit=100).collect()}
    assert first == {d: w for d, w in want.items() if d < 30}
    rows = spark.read.parquet(cache).count()
    assert rows == len({corpus[d] or "" for d in corpus if d < 30})
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, MODEL, cache, limit=100).collect()}
    assert got == want
    assert spark.read.parquet(cache).count() == len({t or "" for t in corpus.values()})
    token_counts.token_counts(docs, MODEL, cache).count()
    assert spark.read.parquet(cache).count() == len({t or "" for t in corpus.values()})
    path = P.path("byte_bpe_50k.json")
    other = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs.where("doc_id >= 1000"), path, cache).collect()}
    t = Tokenizer.from_file(path)
    assert other == {d: len(t.encode(corpus[d] or "", add_special_tokens=False).ids) for d in corpus if d >= 1000}


def test_merges_as_the_library(odd, own):
    ranks = bpe.read_ranks(RANKS)
    encode, decode = bpe.encoder(ranks, P.PATTERN), bpe.decoder(ranks)
    ids = encode(odd)
    assert ids == [np.array(own.encode_ordinary(t), "<u4").tobytes() for t in odd]
    assert [b"".join(decode(i)) for i in ids] == [t.encode() for t in odd]


def test_pieces_of_long_texts(odd, own, monkeypatch):
    monkeypatch.setattr(bpe, "DECODED", 3)
    long = " ".join(odd) + " a b c"
    assert all("".join(bpe.pieces(t, 7)) == t for t in [*odd, long])
    monkeypatch.setattr(bpe.pieces, "__defaults__", (50,))
    ranks = bpe.read_ranks(RANKS)
    ids = bpe.encoder(ranks, P.PATTERN)([long, "", long[:1000]])
    assert ids == [np.array(own.encode_ordinary(t), "<u4").tobytes() for t in (long, "", long[:1000])]
    assert b"".join(bpe.decoder(ranks)(ids[0])) == long.encode()


def test_squeezed_numbers_come_back():
    for x in ([], [0], [1, 2**32 - 1, 65536, 255]):
        assert bpe.loosened(bpe.squeezed(np.array(x, "<u4"))).tolist() == x


def test_merge_order_when_a_merge_makes_a_lower_rank():
    tokens = ["bc", "ab", "abc", "cab", "aa", "aaa", "aaaa", "ba", "ca", "cc"]
    for seed in range(30):
        rnd = random.Random(seed)
        rnd.shuffle(tokens)
        ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
        own = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30))) for _ in range(200)] + ["a" * 17, "abcabc"]
        assert bpe.Replay(ranks).encode([w.encode() for w in words]) == [np.array(own.encode_ordinary(w), "<u4").tobytes() for w in words]


@pytest.mark.parametrize(("size", "held", "fan"), [(bpe.SLICE, bpe.HELD, bpe.FAN), (2000, 300, 2)])
def test_encode_decode(docs, nothing, corpus, own, size, held, fan, monkeypatch):
    for name, value in (("SLICE", size), ("HELD", held), ("FAN", fan)):
        monkeypatch.setattr(bpe, name, value)
    got = {r.doc_id: r for r in bpe.encode_decode(docs, RANKS, P.PATTERN).collect()}
    assert got.keys() == corpus.keys()
    for d, r in got.items():
        ids = np.array(own.encode_ordinary(corpus[d] or ""), "<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4 and bytes(r.decoded) == (corpus[d] or "").encode()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
    assert bpe.encode_decode(nothing, RANKS, P.PATTERN).count() == 0


def plain_tiles(item, doc, least):
    """Greedy string tiling as published: again and again the longest common run of unmarked tokens."""
    i_free, d_free, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and i_free[a + n] and d_free[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return tiles
        i_free[a : a + n], d_free[b : b + n] = [False] * n, [False] * n
        tiles.append((a, b, n))


def test_tiles_like_the_published_algorithm():
    rnd = random.Random(4)
    for _ in range(150):
        item = [rnd.choice("abcd") for _ in range(rnd.randint(1, 25))]
        doc = [rnd.choice("abcd") for _ in range(rnd.randint(0, 20))] + item[len(item) // 2 :] + ["x"] + item[: len(item) // 2]
        least = min(3, len(item))
        items = decontaminate.Items([0], pa.array([" ".join(item)]), 3)
        h, _ = decontaminate.tokens(np.frombuffer(" ".join(doc).encode(), np.uint8), np.array([0, 2 * len(doc) - 1]))
        shared = items.shared(h)
        want = plain_tiles(item, doc, least)
        got = decontaminate.tile(shared[0][1], shared[0][0], len(item)) if 0 in shared else []
        assert sorted(got) == sorted(want)


def test_repeated_words_make_no_square_of_matches():
    items = decontaminate.Items([0], pa.array(["a " * 1000]), 5)
    h, _ = decontaminate.tokens(np.frombuffer(b"a " * 20000, np.uint8), np.array([0, 40000]))
    size, matches = items.shared(h)[0]
    assert len(matches) < 21000
    assert decontaminate.tile(matches, size, 1000) == [(0, 0, 1000)]


def test_tokens_of_other_scripts():
    say = "«Don’t» stop—now… ÉTÉ naïve 東京タワー x2 ไทย"
    raw = say.encode()
    _, bounds = decontaminate.tokens(np.frombuffer(raw + b"ab", np.uint8), np.array([0, len(raw), len(raw), len(raw) + 2]))
    assert bounds.tolist() == [0, 15, 15, 16]  # don t stop now été naïve, five alone, x2, three alone
    one, _ = decontaminate.tokens(np.frombuffer("été".encode(), np.uint8), np.array([0, 5]))
    two, _ = decontaminate.tokens(np.frombuffer("ÉTÉ!".encode(), np.uint8), np.array([0, 6]))
    assert (one == two).all()


def test_leaks_like_brute_force(spark):
    rnd = random.Random(8)
    say = lambda n: [rnd.choice("abcdefgh") + rnd.choice(["", "", "x", "東"]) for _ in range(n)]
    split = lambda t: t.replace("東", " 東 ").split()
    items = {k: " ".join(say(rnd.randint(1, 25))) for k in range(12)} | {12: "a " * 30, 13: "東" * 9}
    docs = {}
    for d in range(40):
        x = items[rnd.randrange(14)].split()
        cut = rnd.randint(0, len(x))
        docs[d] = " ".join([*say(rnd.randint(0, 15)), *x[cut:], *say(rnd.randint(0, 4)), *x[:cut], *say(rnd.randint(0, 10))])
    docs |= {40: "a " * 200, 41: None, 42: ""}
    want = {}
    for d, t in docs.items():
        for k, u in items.items():
            doc, item = split(t or ""), split(u)
            tiles = plain_tiles(item, doc, min(5, len(item)))
            if sum(n for *_, n in tiles) >= 0.5 * len(item):
                want[d, k] = (len(item), sum(n for *_, n in tiles), len(tiles), max(n for *_, n in tiles))
    found = decontaminate.leaks(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")).collect()
    assert len(want) > 40
    assert {(r.doc_id, r.item_id): (r.n_tokens, r.n_covered, r.n_tiles, r.longest_tile) for r in found} == want


def test_leaks(spark, docs, nothing, corpus):
    words = corpus[0].split()
    bench = [(1, " ".join(words[:30])), (2, " ".join(words[20:28] + ["q"] * 4 + words[3:12])), (3, "never seen anywhere at all in it"), (4, None), (5, ""), (None, corpus[0]), (6, "ONE, two!"), (7, " ".join(words[:6] + ["q"] * 20))]
    table = spark.createDataFrame([(*b, 1, "x") for b in bench], "item_id long, text string, doc_id long, n_tokens string")
    want = decontaminate.leaks(docs, table).collect()
    found = {(r.doc_id, r.item_id): r for r in want}
    assert {k for k in found if k[0] in (0, 1003, 1004)} == {(0, 1), (0, 2), (1003, 6), (1004, 6)}
    assert found[0, 1].coverage == 1.0 and found[0, 2].n_tiles == 2 and found[0, 2].n_covered == 17 and found[0, 1].longest_tile == 30
    assert {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, table, block=40).collect()} == found
    assert decontaminate.leaks(nothing, table).count() == decontaminate.leaks(docs, table.where("item_id < 0")).count() == 0
