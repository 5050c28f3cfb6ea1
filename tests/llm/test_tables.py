"""Filter audit, conversation repair and line dedup against plain versions; queries against their SQL."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import plain
import pytest

from trigrail.llm import conversations, filter_audit, line_dedup, registry

SF = "/root/testdata/sf0.001"
BLANK = "\t\n\x0b\x0c\r "


@pytest.mark.parametrize("name", ["op2_embedding_near_dedup", "op7_substring_dedup", "op9_minhash_near_dedup", "op11_filter_audit", "op12_conversation_repair", "op13_line_dedup"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    got = registry.queries()[name](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.df()[columns].itertuples(index=False)))


# filter audit


def fails(docs):
    seen, out = set(), {}
    for d in sorted(docs):
        t = docs[d] or ""
        w = plain.WORD.findall(t)
        out[d] = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": t in seen,
        }
        seen.add(t)
    return out


def plain_audit(docs, langs, labels):
    bad, out = fails(docs), {}
    shapley = Counter()
    for part in set(langs.values()):
        ids = [d for d in docs if langs[d] == part]
        for order in itertools.permutations("ABCDE"):
            alive = set(ids)
            for step, x in enumerate(order, 1):
                here = {d for d in alive if bad[d][x]}
                early = sum(bad[d][x] for d in ids if d not in alive)
                alive -= here
                only = sum(bad[d][x] and sum(bad[d].values()) == 1 for d in ids)
                shapley[part, x] += len(here)
                good, toxic = (sum(labels.get(d, (0, 0))[k] == 1 for d in here) for k in (0, 1))
                out[part, "".join(order), step] = (len(alive), len(here), early, only, good, toxic)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def texts(corpus):
    rnd = random.Random(3)
    out = dict(corpus)
    for d in range(300, 360):
        words = [rnd.choice(["alpha", "Beta", "gamma", "x$", "DELTA", "é"]) + str(rnd.randint(0, rnd.choice([3, 400]))) for _ in range(rnd.choice([3, 150, 220]))]
        out[d] = " ".join(words)
    return out | {400: out[301], 401: out[301], 402: "", 403: out[5]}


def test_audit_like_plain_code(spark, texts):
    langs = {d: ["en", "de", None, ""][d % 4] for d in texts}
    labels = {d: (d % 2, [0, 1, None][d % 3]) for d in texts if d % 5} | {9999: (1, 1)}
    docs = spark.createDataFrame([(1, d, t, langs[d], 7) for d, t in texts.items()] + [(1, None, "x", "en", 7), (1, 3, "zzz", "fr", 7)], "part int, doc_id long, text string, lang string, mask int")
    marks = spark.createDataFrame([(d, *x, "p") for d, x in labels.items()] + [(1, 1, None, "p"), (1, 1, 1, "p"), (None, 1, 1, "p")], "doc_id long, quality int, toxic int, part string").repartition(3)
    labels[1] = (1, 1)
    want = plain_audit(texts, {d: x or "" for d, x in langs.items()}, labels)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.filter_audit(docs, marks).collect()}
    assert got == want
    assert filter_audit.filter_audit(docs.where("doc_id < 0"), marks).count() == 0
    counts, letters = filter_audit.masks(docs, marks.where("doc_id < 0"))
    left = {(r.part, r.filters): r.n for r in filter_audit.surviving(counts, letters).collect()}
    bad = fails(texts)
    for part, some in (("", "BD"), ("en", "ABCDE"), ("de", "")):
        assert left[part, some] == sum((langs[d] or "") == part and not any(bad[d][x] for x in some) for d in texts)


def test_zeta_of_any_number_of_filters():
    rnd = np.random.default_rng(2)
    for k in (1, 2, 3, 7):
        n = rnd.integers(0, 9, 1 << k)
        want = [sum(n[m] for m in range(1 << k) if m & s == 0) for s in range(1 << k)]
        assert filter_audit.survivors(n).tolist() == want


# conversation repair


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        out += [(c, t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """rows: (turn, role, text) in order. Every way to edit them, the cheapest and then least one."""
    seen, faults, found = set(), [], Counter()
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        found[fault] += 1
        faults.append(fault)
    found["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, *_ in rows if t is not None]
    found["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    @cache
    def best(i, said, new):
        """(cost, edits, lines) from row i on; said: initials so far, but for whole pairs; new: rows that may be put in here."""
        ways = []
        if i == len(rows) and said in ("", "ua"):
            ways.append((0, "", ()))
        forced = "assistant" if said in ("u", "su") else "user"

        def after(x):
            now = said.removeprefix("ua") + x if said != "s" else "s" + x
            return "ua" if now == "sua" else now

        if new:
            c, e, lines = best(i, after(forced[0]), new - 1)
            ways.append((c + conversations.INSERT, "I" + e, (forced + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, lines = best(i + 1, said, 3)
            ways.append((c + 2, "D" + e, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] == forced[0] or (role[:1] == "s" and said == ""):
                    c, e, lines = best(i + 1, after(role[:1]), 3)
                    ways.append((c + more, "K" + e, (f"{role}:{text}", *lines)))
                c, e, lines = best(i + 1, after(forced[0]), 3)
                ways.append((c + more + 1, "R" + e, (f"{forced}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, edits, lines = best(0, "", 3)
    return (*(found[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")), cost, edits, "\n".join(lines))


@pytest.mark.parametrize("insert", [conversations.INSERT, 1])
def test_repair_like_plain_code(spark, insert, monkeypatch):
    """At the price of INSERT a new turn is never among the cheapest edits (deleting its neighbour costs less); at a lower one it is."""
    monkeypatch.setattr(conversations, "ROWS", 40)
    monkeypatch.setattr(conversations, "INSERT", insert)
    rnd = random.Random(6)
    rows = []
    for c in [None, *range(400)]:
        n = rnd.choice([0, 1, 2, 3, 4, 6, 9, 14]) or 1
        good = rnd.random() < 0.3
        for t in range(n):
            role = "user" if t % 2 == 0 else "assistant"
            if not good:
                role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "User", "usher"])
            rows.append((c, None if rnd.random() < 0.05 else t * rnd.choice([1, 1, 1, 2]), role, rnd.choice(["One.", "two", "Three!  \n", " ", None, "Why?", "", "é", f"text {t}.", f"other {t}?", "cut, "])))
    rows += [(900, t, "user" if t % 3 else "assistant", f"{t}." if t % 7 else "again.") for t in range(100)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, fault int, gone string").repartition(3)
    by = defaultdict(list)
    for c, t, role, text in plain_damage(rows):
        by[c].append((t, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    want = {c: plain_repair(sorted(by[c], key=key)) for c in {r[0] for r in rows}}
    found = conversations.repair(conversations.damaged(table)).collect()
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(found) == len(got)
    assert got == want
    assert any("I" in w[6] for w in want.values()) == (insert == 1) and any("R" in w[6] for w in want.values())
    assert conversations.repair(conversations.damaged(table.where("conv_id < -1"))).count() == 0


# line dedup


def plain_lines(docs, least_chars, least_docs):
    key = lambda x: x.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})
    many = Counter(k for t in docs.values() for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least_chars)
    out = {}
    for d, t in docs.items():
        rows = (t or "").split("\n")
        kept = [x for x in rows if not (len(key(x)) >= least_chars and many[key(x)] >= least_docs)]
        text = "\n".join(kept)
        out[d] = (len(rows), len(rows) - len(kept), text, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("slice_", "chars", "docs_"), [(1 << 18, 1, 10), (50, 1, 3), (7, 4, 300)])
def test_lines_like_plain_code(spark, slice_, chars, docs_, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE", slice_)
    rnd = random.Random(chars)
    some = ["", " ", "\t", "License.", " license. ", "LICENSE.\r", "é", "É", "x", "日本", "\x0bab\x0c", "rare line"] + [f"line {k}" for k in range(30)]
    docs = {d: "\n".join(rnd.choice(some[: rnd.choice([5, 12, 42])]) for _ in range(rnd.randint(1, 12))) for d in range(400)}
    docs |= {500: None, 501: "", 502: "\n", 503: "\n\n\n", 504: "License.\n" * 400, 505: "x" * 100_000 + "\nLicense.", 506: "end\n"}
    table = spark.createDataFrame([(1, d, t, 2, "h") for d, t in docs.items()] + [(1, None, "License.", 2, "h"), (1, 3, None, 2, "h")], "slice int, doc_id long, text string, shard int, hashes string").repartition(6)
    want = plain_lines(docs, chars, docs_)
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.remove_lines(table, least_chars=chars, least_docs=docs_).collect()}
    assert got == want
    assert any(w[1] for w in want.values())
    assert line_dedup.remove_lines(table.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("levels", [32, 3])
def test_perfect_hash_is_minimal(levels, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEVELS", levels)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.random.default_rng(n).integers(0, 2**64, n, np.uint64)
        made = line_dedup.PerfectHash(keys)
        again = line_dedup.PerfectHash.unpacked(*made.packed())
        assert sorted(again.slots(keys).tolist()) == list(range(n))
        assert (again.slots(keys) == made.slots(keys)).all()
        other = again.slots(np.arange(1000, dtype=np.uint64))
        assert ((other >= -1) & (other < max(n, 1))).all()
        assert sum(map(len, made.packed())) * 8 <= (5 if levels > 3 else 20) * n + 4000
