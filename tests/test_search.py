"""Index search equals a full scan, literals are required, filters and scores by hand."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trigrail.functions import score, text
from trigrail.operators import catalog, longtext, permissions, postings
from trigrail.plans import boolean, choice
from trigrail.plans.search import Query, planned, search, tree_of

PATHS = ["", "a", "ab", "abc", "aaaaaaa", "//x", "/a//b", "/.hidden/f", "/né/ü.txt", "100%_x", "[x].log", "/" + "d/" * 64 + "f", "/" + "d/" * 65 + "f", "it's \\ here", "/Σας/ΣΑΣ", "/İx/Log.LOG", "/var/log/syslog.log"]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, p, 0o100644, 1000, 100, None) for i, p in enumerate(PATHS)] + [(len(PATHS), None, 0o100644, 1000, 100, None)]
    return spark.createDataFrame(rows, "id long, path string, permissions int, uid int, gid int, modified timestamp").cache()


@pytest.mark.parametrize("ignore_case", [False, True])
@pytest.mark.parametrize(("pattern", "regex"), [(p, False) for p in ("", "a", "ab", "aaa", "né/", "ΣΑΣ", "%_x", "LOG", "].l", "zzzz", "\\ h")] + [(p, True) for p in (r".*\.log$", "^/var", "a+b?c", "lo[gx]", "(var|a)/lo", "syslog|abc", r"\Qx].\E", "d{3}", "né.ü", r"\[x\]\.log", "LOG")])
def test_index_and_scan_agree(files, pattern, regex, ignore_case):
    q = Query((pattern,), ignore_case, regex, limit=None)
    with_index = {r.id for r in search(files, q, postings.build(files, ignore_case)).collect()}
    assert with_index == {r.id for r in search(files, q).collect()}


def test_several_patterns_limit_and_owner(files):
    q = Query(("abc", "log"), uid=5, gid=5, limit=2)
    assert [r.id for r in search(files, q, postings.build(files)).collect()] == [3, 10]
    assert search(files, Query(()), None).count() == 0


PIECE = st.sampled_from(["ab", "c", "x+", "y?", "z*", "d{2}", "d{1,3}", "[pq]", "[^p]", "[a-c]+", "(?:rs)", "(tu)", "(rs|tu)", "(?:ab|c|)", "(ab|cd)+", "(?:x(?:y|z)){2}", ".", ".*", "\\.", "\\d", "^", "$", "é", "(?=ab)", "(?i:aB)", "abcd", "(?>tu|t)", "a++"])
REGEX = st.lists(st.lists(PIECE, max_size=6).map("".join), min_size=1, max_size=3).map("|".join)


@settings(max_examples=500, deadline=None)
@given(REGEX, st.booleans(), st.lists(st.text("abcxyzdpqrstu.1éAB", max_size=40), min_size=1, max_size=20))
def test_every_match_has_what_the_tree_asks_for(pattern, ignore, subjects):
    tree = boolean.of_regex(pattern, ignore)
    for s in subjects:
        if re.search(pattern, s, re.I if ignore else 0):
            s = s.lower() if ignore else s
            assert boolean.holds(tree, {s[i : i + 3] for i in range(len(s) - 2)})


def asked(pattern, folded=False):
    return boolean.of_regex(pattern, folded)


def test_trees_of_expressions():
    some, every = boolean.some_, boolean.all_
    assert asked("(foo|bar)[0-9]x+") == some("foo", "bar") or boolean.leaves(asked("(foo|bar)[0-9]x+")) >= {"foo", "bar"}
    assert not boolean.holds(asked("(foo|bar)[0-9]x+"), {"fox", "ba0"}) and boolean.holds(asked("(foo|bar)[0-9]x+"), {"foo", "oo1", "o1x"})
    assert asked("abc|def") == some("abc", "def") and asked("abc.*def") == every("abc", "def")
    assert asked("ab[cd]e") == some(every("abc", "bce"), every("abd", "bde")) and asked("abcd?e") == some(every("abc", "bcd", "cde"), every("abc", "bce"))
    assert asked("(abc)+") == "abc" and asked("abc{2}") == every("abc", "bcc") and asked("x(abc)*") == boolean.ANY
    assert asked("(?:ab){2,}") == every("aba", "bab") and asked("a(?=bcd)") == boolean.ANY
    for nothing in (r"a\Qbcdef", "abc|d", "[[a]bcd]efg", "[a&&b]cde", r"\u0061bcd", "a{x}bcd", "(?<n>abc)", "(?x)a b c", "abc)", r"\1abc", "a(?i)bcd", "[]a]bcd"):
        assert asked(nothing) == boolean.ANY, nothing
    assert asked("(?i)abc") == some(*(a + b + c for a in "aA" for b in "bB" for c in "cC"))
    assert asked("Éabcd", True) == every("abc", "bcd") and asked("ABC", True) == "abc"
    assert len(boolean.leaves(asked("[a-j][a-j][a-j][a-j]"))) <= 3 * boolean.MANY**2
    assert asked("(" * 3000 + "a" + ")" * 3000) == boolean.ANY


@pytest.fixture(scope="module")
def names(spark):
    """Paths of words, some of which are rare."""
    rows = [(i, f"/{'common' if i % 2 else 'usual'}/{i % 7}/{['foo', 'bar', 'baz'][i % 3]}{i % 5}{'x' * (i % 3)}" + ("/needle" if i % 211 == 0 else "") + ("/ΑΣΒ" if i % 97 == 0 else "")) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, path string").withColumn("block", F.shiftright("id", choice.BLOCK).cast("int")).cache()


REGEXES = ["(foo|bar)[0-9]x+", "needle|ΑΣ", "(common|usual)/[1-3]/ba[rz]", "co(mm|nn)on/6", "[nm]eedl[ea]$", "(?:fo|ba)[or]4", "zzzz|needle", "qqqq", "fo{2}1", "(?i)NEED", "/(0|6)/foo", "x{2}/needle"]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_planned_searches_find_what_a_scan_finds(spark, names, ignore_case):
    index = postings.build(names, ignore_case).cache()
    lengths = postings.dictionary(index).cache()
    found = {}
    for q in [Query((p,), ignore_case, True, limit=None) for p in REGEXES] + [Query((p,), ignore_case, limit=None) for p in ("needle", "common", "baz1", "qqq", "αςβ", "o", "NEEDLE", "xx/needle")]:
        how = planned(spark, q, lengths, 2000)
        found[q.patterns[0]] = how
        want = {r.id for r in search(names, q).collect()}
        assert {r.id for r in search(names, q, index, how).collect()} == want, q
        assert {r.id for r in search(names.drop("block"), q, index, how).collect()} == want, q
        assert {r.id for r in search(names, q, index).collect()} == want, q
        assert how.bound is None or how.how == "scan" or len(want) <= how.bound
    assert found["needle"].how == "index" and len(boolean.leaves(found["needle"].tree)) == 4
    assert found["common"].how == "scan" and found["qqqq"].how == "nothing"
    assert boolean.leaves(found["xx/needle"].tree) == {"xx/", "x/n", "/ne", "nee"} or len(boolean.leaves(found["xx/needle"].tree)) <= 1 + choice.MORE
    assert found["co(mm|nn)on/6"].how != "nothing"


SHORT = ["", "a", "ab", "abc", "/é", "/x/é", "b.", "..", "/", "é", "a.b/c", "ßß", "xyz.é", "ABC", "/ΣΑΣ"]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_short_patterns_use_tails(spark, ignore_case):
    files = spark.createDataFrame([*enumerate(SHORT)], "id long, path string").withColumn("block", F.lit(0))
    index = postings.build(files, ignore_case).unionByName(postings.tails(files, ignore_case)).cache()
    lengths = postings.dictionary(index).cache()
    for patterns in (["ab"], ["é"], ["."], ["a"], ["b"], ["/"], [".é"], ["c"], ["ßß"], ["q"], ["Σ"], ["ab", "é"], ["abc", "."]):
        q = Query(tuple(patterns), ignore_case, limit=None)
        how = planned(spark, q, lengths, 10_000, tails=True)
        got = [search(files, q, index, how)] + [search(files, q, index, choice.choose(how.tree))] * (how.how == "index")
        want = {r.id for r in search(files, q).collect()}
        assert [{r.id for r in g.collect()} for g in got] == [want] * len(got)
        assert how.how == ("index" if want else "nothing")
        if want and all(len(p) < 3 for p in patterns):  # no others pass
            assert {r.file_id for r in choice.candidates(index, how.tree).collect()} == want


def test_plans_read_the_rarest_lists():
    tree, counts = boolean.of_strings(["abcdefg"]), {"abc": 900, "bcd": 10, "cde": 500, "def": 30, "efg": 41}
    how = choice.choose(tree, counts, 10_000)
    assert (how.how, how.bound, how.reads, boolean.leaves(how.tree)) == ("index", 10, 40, {"bcd", "def"})
    assert choice.choose(tree, counts, 100).how == "scan" and choice.choose(tree, {**counts, "efg": 0}, 10_000).how == "nothing"
    either = boolean.some_(tree, "xyz")
    assert choice.choose(either, {**counts, "xyz": 5}, 10_000).bound == 15 and choice.choose(either, {"xyz": 5}, 10_000).tree == "xyz"
    many = boolean.of_strings(["".join(chr(97 + i) for i in (a, b, c)) for a in range(5) for b in range(5) for c in range(5)])
    assert choice.choose(many, dict.fromkeys(boolean.leaves(many), 1), 10_000).how == "scan"
    assert choice.choose(boolean.all_(many, "xyz"), None).tree == "xyz"
    assert choice.choose(boolean.all_(many, "xyz"), dict.fromkeys([*boolean.leaves(many), "xyz"], 1), 10_000).how == "index"


@pytest.mark.parametrize("pattern", ["ΑΣ", "ας", "İ", "i̇x", "ﬁ", "ſ", "Σ", "ΣΑΣ", "ß", "İX/LOG"])
def test_letters_of_any_script_fold_alike_in_index_and_scan(spark, pattern):
    paths = ["/ΑΣΒ/x.log", "/ας", "/ΑΣ", "/αΣ.b", "/İx/log", "/ﬁle", "/ſet", "/STRASSE", "/straße", "/σ", "/xΣΑΣ"]
    files = spark.createDataFrame([*enumerate(paths)], "id long, path string")
    q = Query((pattern,), ignore_case=True, limit=None)
    fold = lambda s: "".join(c.lower() for c in s).replace("ς", "σ")
    want = {i for i, p in enumerate(paths) if fold(pattern) in fold(p)}
    assert {r.id for r in search(files, q).collect()} == {r.id for r in search(files, q, postings.build(files, True)).collect()} == want
    assert want


def test_text_functions(spark):
    rows = spark.createDataFrame([(p,) for p in ["aaaaaaa", "ab", "", "//a/b//", "aab\nb"]], "p string")
    got = rows.select(text.trigrams(F.col("p")), text.occurrences(F.col("p"), F.lit("aaa")), text.tokens(F.col("p")), text.runs(F.col("p")), text.depth(F.col("p"))).collect()
    assert [len(r[0]) for r in got] == [5, 0, 0, 5, 3]
    assert [r[1] for r in got] == [2, 0, 0, 0, 0]
    assert got[3][2] == ["a", "b"] and got[0][3] == "a*7" and got[3][3] == "/*2 a / b /*2" and got[4][3] == "a*2 b \n b"
    assert [r[4] for r in got] == [0, 0, 0, 1, 0]


def test_permissions(spark):
    rows = spark.createDataFrame([(0o004, 1, 1), (0o400, 7, 1), (0o040, 1, 8), (0o440, 1, 1), (0, 7, 8)], "m int, u int, g int")
    may = rows.select(permissions.readable(F.col("m"), F.col("u"), F.col("g"), 7, 8)).collect()
    assert [r[0] for r in may] == [True, True, True, False, False]
    assert all(r[0] for r in rows.select(permissions.readable(F.col("m"), F.col("u"), F.col("g"), 0, 0)).collect())
    packed = spark.createDataFrame([(7 << 16 | 0o400,), (8 << 8 | 0o040,), (3 << 16 | 0o400,)], "p int")
    assert [r[0] for r in packed.select(permissions.readable_packed(F.col("p"), 7, 8)).collect()] == [True, True, False]


def test_remainder_bits(spark):
    rows = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 5, 6)], "m double")
    assert [r[0] for r in rows.select(score.golomb_parameter(F.col("m"))).collect()] == [0, 0, 1, 2, 2, 3]


def test_gaps_and_back(files):
    index = postings.build(files)
    want = [tuple(r) for r in postings.gaps(index).orderBy("trigram", "pos").collect()]
    assert {r[0]: sum(x[3] for x in want if x[0] == r[0]) for r in want} == {r.trigram: r.last for r in index.groupBy("trigram").agg(F.max("file_id").alias("last")).collect()}
    for block in (1, 2, 3, postings.BLOCK):
        gaps = postings.gaps(index, block)
        assert [tuple(r) for r in gaps.orderBy("trigram", "pos").collect()] == want
        assert {(r.trigram, r.file_id) for r in postings.decoded(gaps, block).collect()} == {(r.trigram, r.file_id) for r in index.collect()}


def test_long_texts_count_like_paths(spark, files):
    want = {tuple(r) for r in postings.dictionary(postings.build(files)).collect()}
    docs = files.select(F.col("id").alias("doc_id"), F.col("path").alias("text"))
    assert {tuple(r) for r in longtext.trigram_stats(docs).collect()} == want


def test_dense_ids(spark):
    rows = spark.createDataFrame([(f"p{i:03}",) for i in range(100)], "path string").repartition(7)
    got = {r.path: r.id for r in catalog.dense_ids(rows, "path", 5).collect()}
    assert got == {f"p{i:03}": i + 5 for i in range(100)}
    assert catalog.dense_ids(rows.where("path = ''"), "path").count() == 0


def test_filters(files):
    deep = [r.path for r in files.where(~catalog.within_depth(F.col("path"))).collect()]
    assert deep == [PATHS[12]]
    assert files.where(catalog.is_hidden(F.col("path"))).count() == 0
    assert files.where(catalog.is_file(F.col("permissions"))).count() == len(PATHS) + 1
