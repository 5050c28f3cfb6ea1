"""The pipeline's stages, each against a plain version of what it has to do."""

import random

import numpy as np
import plain
import pytest
import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from trigrail.llm import bpe, registry

COMMON = "the of and to in is was that".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(900)]
    say = lambda k: " ".join(rnd.choice(COMMON) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(k))
    shared, leaked = say(60), say(30)
    docs = {d: say(rnd.randint(60, 150)) for d in range(60)}
    docs |= {60: docs[3], 61: docs[4] + " end", 62: say(40) + " " + shared + " " + say(40), 63: say(50) + " " + shared + " " + say(30), 64: say(30) + " " + leaked, 65: " ".join(w + "###" for w in say(60).split()), 66: None, 67: "", 68: "short one"}
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, leaked), (2, say(30))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), docs


def test_stages(spark, folder):
    top, docs = folder
    now = spark.read.parquet(f"{top}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        now = stage(spark, now, top).cache()
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != cp.STAGES[-1][0]:
            assert now.columns == list(cp.COLUMNS)
    assert seen["quality classifier"].keys() == docs.keys() - {65}
    left = {d: docs[d] for d in seen["quality classifier"]}
    assert seen["near-dedup"].keys() == {d for d, (_, c) in plain.near_documents(left).items() if c == d} == left.keys() - {60, 61}
    left = {d: left[d] for d in seen["near-dedup"]}
    cut = plain.cut_windows(left, 20)
    rows = seen["substring dedup"]
    assert rows.keys() == left.keys() and {d for d in left if rows[d].text != left[d]} == {d for d, c in cut.items() if c[1]} == {63}
    assert len(rows[63].text.split()) == cut[63][0] - cut[63][1] and rows[63].n_chars == len(rows[63].text)
    assert seen["decontamination"].keys() == rows.keys() - {64}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    last = seen["byte-level BPE"]
    assert last.keys() == seen["decontamination"].keys()
    assert all(bytes(r.ids) == np.array(own.encode_ordinary(seen["decontamination"][d].text or ""), "<u4").tobytes() for d, r in last.items())
    assert {r.doc_id: r.ids_sha256 for r in cp.run(spark, top).collect()} == {d: r.ids_sha256 for d, r in last.items()}


def test_repeated_ids_odd_texts_and_clashing_columns(spark, folder):
    """Each stage on its own: one row of an id, nulls and empty texts stay, a very long text is whole, other columns are left out."""
    top, docs = folder
    long = " ".join(f"{docs[d]}" for d in range(20, 50)) + " " + " ".join(f"the w{k}x of y{k}z in" for k in range(20000))
    rows = [(1, d, docs[d], 2, "a", "r") for d in range(10)] + [(1, 3, docs[5], 2, "a", "r"), (1, 4, None, 2, "b", "r"), (1, None, "no id", 2, "b", "r"), (1, 900, None, 2, "b", "r"), (1, 901, "", 2, "b", "r"), (1, 902, long, 2, "b", "r")]
    table = spark.createDataFrame(rows, "share long, doc_id long, text string, rep int, comp string, region string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars", "1L n", "'x' bucket")
    want = {d: docs[d] for d in range(10)} | {3: min(docs[3], docs[5]), 900: None, 901: "", 902: long}
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, table, top)
        assert got.columns == list(cp.COLUMNS)
        got = [(r.doc_id, r.text) for r in got.collect()]
        gone = {5} if name == "near-dedup" and want[3] == docs[5] else set()
        assert sorted(d for d, _ in got) == sorted(want.keys() - gone)
        assert all(t == want[d] or name == "substring dedup" for d, t in got)
    last = {r.doc_id: r for r in cp.STAGES[-1][1](spark, table, top).collect()}
    assert last.keys() == want.keys() and last[900].n_tokens == last[901].n_tokens == 0 and last[902].n_tokens > 60000


def test_empty_tables(spark, folder):
    now = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 0")
    for _, stage in cp.STAGES:
        now = stage(spark, now, folder[0])
        assert now.count() == 0


def test_registry():
    names = [*registry.queries(), *cp.queries()]
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 14)), "pipeline"]
    assert registry.oracle_sql().keys() <= registry.queries().keys()
