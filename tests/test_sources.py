"""The file tree source, snapshots, the engine, streams and the command line."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from trigrail import cli
from trigrail import schema as S
from trigrail.operators import postings
from trigrail.plans import choice
from trigrail.plans.engine import Engine
from trigrail.plans.search import Query
from trigrail.sources import filesystem, segments, snapshots
from trigrail.streaming import changes


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub/deep").mkdir(parents=True)
    for p in ("notes.txt", ".dot", "sub/Report.log", "sub/deep/x.log"):
        (root / p).write_text("x")
    (root / "sub/loop").symlink_to(root)
    os.mkfifo(root / "sub/pipe")
    far = root
    for _ in range(66):
        far = far / "d"
    far.mkdir(parents=True)
    (far / "lost").write_text("x")
    return root


def names(df, root):
    return sorted(r.path.removeprefix(f"{root}/") for r in df.collect())


def test_scan(spark, tree):
    assert names(filesystem.scan(spark, str(tree)), tree) == [".dot", "notes.txt", "sub/Report.log", "sub/deep/x.log", "sub/loop"]
    plain = filesystem.scan(spark, str(tree), include_hidden="false", include_symlinks="false")
    assert names(plain, tree) == ["notes.txt", "sub/Report.log", "sub/deep/x.log"]
    assert names(filesystem.scan(spark, str(tree), max_depth="1"), tree) == [".dot", "notes.txt", "sub/Report.log", "sub/loop"]
    assert names(filesystem.scan(spark, str(tree), max_depth="0"), tree) == [".dot", "notes.txt"]
    for tasks in ("1", "3", "1000"):
        assert names(filesystem.scan(spark, str(tree), tasks=tasks), tree) == [".dot", "notes.txt", "sub/Report.log", "sub/deep/x.log", "sub/loop"]
    with pytest.raises(Exception, match="NotADirectory|missing"):
        filesystem.scan(spark, f"{tree}/missing").collect()


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, folder)
    assert [snapshots.save(spark.range(n), folder) for n in (3, 5)] == [0, 1]
    assert snapshots.load(spark, folder).count() == 5 and snapshots.load(spark, folder, 0).count() == 3


def test_skipped_folders_are_logged(tree, caplog):
    list(filesystem.entries(f"{tree}/gone", 0, 64, True, True))
    found = list(filesystem.entries(str(tree), 0, 64, True, True))
    assert len(found) == 5 and "gone" in caplog.text and "deeper than 64" in caplog.text


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert snapshots.save(spark.range(2), folder) == 0
    with pytest.raises(FileExistsError):
        snapshots.publish(spark, folder, 0, {})
    assert snapshots.load(spark, folder).count() == 2


@pytest.mark.parametrize("last", [0, 2, 5, 6])
def test_a_batch_that_fails_changes_nothing_and_counts_once(spark, tmp_path, last, monkeypatch):
    """The driver is lost after so many of the six tables, or before the commit; then the batch comes again, and again."""
    e = Engine(spark, f"file://{tmp_path}/db", scan_below=0)
    e.build(spark.createDataFrame([(0, "/a/old.log", 0o100644, 1, 1, None), (1, "/a/gone.log", 0o100644, 1, 1, None)], S.FILES))
    batch = spark.createDataFrame([(1, "create", "/a/newreport.txt", 0o100644, None), (2, "delete", "/a/gone.log", None, None)], S.CHANGES)
    count, write, publish = [0], type(batch.write).parquet, snapshots.publish

    def lost(self, *a, **k):
        if count[0] == last:
            raise RuntimeError("lost")
        count[0] += 1
        return write(self, *a, **k)

    def unpublished(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(type(batch.write), "parquet", lost)
    monkeypatch.setattr(snapshots, "publish", unpublished)
    with pytest.raises(RuntimeError, match="lost"):
        e.apply(batch, "s", 0)
    monkeypatch.setattr(type(batch.write), "parquet", write)
    monkeypatch.setattr(snapshots, "publish", publish)

    def both(*patterns):
        found = [sorted(r.path for r in e.search(Query(patterns), index).collect()) for index in (True, False)]
        assert found[0] == found[1]
        return found[0]

    assert both("/a/") == ["/a/gone.log", "/a/old.log"] and both("report") == []
    for _ in range(2):
        e.apply(batch, "s", 0)
        assert both("/a/") == ["/a/newreport.txt", "/a/old.log"] and both("newreport") == ["/a/newreport.txt"] and both("gone") == []
    assert snapshots.version(spark, e.database) == 1
    rows = e.table("postings")
    assert rows.groupBy("trigram", "file_id").count().where("count > 1").isEmpty()
    e.apply(batch)  # without a number it is merged again, to the same end
    assert both("newreport") == ["/a/newreport.txt"] and snapshots.version(spark, e.database) == 2
    folders = lambda: {p.name for p in (tmp_path / "db").glob("*/*=*")}
    named = {n for k in (*e.store.state().segments, *e.store.state().deletes) for n in [k]}
    assert e.vacuum() == 0 and both("/a/") == ["/a/newreport.txt", "/a/old.log"]  # what a writer may be at stays
    e.vacuum(idle=0)
    assert {f.split("=")[1] for f in folders()} == named and both("/a/") == ["/a/newreport.txt", "/a/old.log"]


def paths(rows):
    return sorted(r.path for r in rows.collect())


def random_batches(spark, n, seed):
    rnd, seq = random.Random(seed), 0
    for _ in range(n):
        rows = []
        for _ in range(rnd.randint(1, 40)):
            seq += 1
            rows.append((seq, rnd.choice(["create", "create", "modify", "delete", "moved_to", "moved_from", "attrib"]), f"/{rnd.choice('abc')}/name{rnd.randint(0, 40)}.{rnd.choice(['log', 'txt'])}", rnd.choice([0o100644, 0o100600, None]), None))
        yield spark.createDataFrame(rows, S.CHANGES)


@pytest.mark.parametrize("merge", [False, True])
def test_segments_hold_what_a_rebuild_holds(spark, tmp_path, merge, monkeypatch):
    """After every batch, catalog, postings and searches are those of one catalog to which all changes were applied."""
    first = spark.createDataFrame([(k, f"/a/name{k}.log", 0o100644, 1, 1, None) for k in range(30)], S.FILES)
    monkeypatch.setattr(segments, "FANOUT", 3)
    e = Engine(spark, f"{tmp_path}/db", scan_below=0)
    e.build(first)
    want = {r.path: r.permissions for r in first.collect()}
    merged = 0
    for k, batch in enumerate(random_batches(spark, 4, 4)):
        e.apply(batch)
        for r in {r.path: r for r in sorted(batch.collect()) if r.op != "attrib"}.values():
            if r.op in S.DELETES:
                want.pop(r.path, None)
            else:
                want[r.path] = r.permissions if r.permissions is not None else want.get(r.path)
        if merge:
            while e.compact():
                merged += 1
            if k == 2:
                e.compact(everything=True)
                assert len(e.store.state().segments) == 1 and not e.store.state().deletes
                assert not e.compact(everything=True)
            e.vacuum(keep=2, idle=0)
        files = e.table("files")
        assert {r.path: r.permissions for r in files.collect()} == want
        assert files.count() == files.select("id").distinct().count() == e.store.state().n_files
        for table, fold in (("postings", False), ("postings_folded", True)):
            assert sorted(map(tuple, e.table(table).collect())) == sorted(map(tuple, postings.build(files, fold).collect()))
        for q in (Query(("name1",), limit=None), Query((".LOG",), ignore_case=True, limit=None), Query(("(name3|b/n).*txt",), regex=True, limit=None)):
            assert paths(e.search(q)) == paths(e.search(q, use_index=False))
        assert paths(e.search(Query(("name1",), limit=None))) == sorted(p for p in want if "name1" in p)
    assert merged >= merge
    if merge:
        with pytest.raises(FileNotFoundError):
            e.table("files", 0)
    else:
        assert e.table("files", 0).count() == 30 and len(e.store.state().segments) > 3


def test_a_batch_writes_by_its_own_size(spark, tmp_path):
    def grown(n):
        e = Engine(spark, f"{tmp_path}/db{n}", scan_below=0)
        e.build(spark.range(n).select("id", F.concat(F.lit("/some/folder/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"), *[F.lit(None).cast(S.FILES[c].dataType).alias(c) for c in S.FILES.names[2:]]))
        before = e.store.size(e.store.state())
        batch = spark.range(200).select("id", F.lit("create"), F.concat(F.lit("/new/"), "id"), F.lit(None).cast("int"), F.lit(None).cast("timestamp")).toDF(*S.CHANGES.names)
        e.apply(batch)
        return before, e.store.size(e.store.state()) - before

    small, large = grown(2000), grown(20_000)
    assert large[0] > 6 * small[0] and large[1] < 1.1 * small[1]


def test_two_writers_cannot_both_commit(spark, tmp_path):
    e, f = (Engine(spark, f"file://{tmp_path}/db", scan_below=0) for _ in range(2))
    e.build(spark.createDataFrame([(0, "/a/old.log", 1, 1, 1, None)], S.FILES))
    record = lambda path: spark.createDataFrame([(1, "create", path, None, None)], S.CHANGES)
    base = f.store.state()
    f.store.latest = lambda: base  # it began before the other one's commit
    e.apply(record("/a/one.log"))
    with pytest.raises(FileExistsError):
        f.apply(record("/a/two.log"))
    assert paths(e.table("files")) == ["/a/old.log", "/a/one.log"]
    del f.store.latest
    f.apply(record("/a/two.log"))
    assert paths(e.table("files")) == ["/a/old.log", "/a/one.log", "/a/two.log"]


def test_a_stream_with_a_new_checkpoint_is_another_one(spark, tmp_path, caplog):
    e = Engine(spark, f"{tmp_path}/db", scan_below=0)
    e.build(spark.createDataFrame([(0, "/a/old.log", 1, 1, 1, None)], S.FILES))

    def add(path, checkpoint):
        spark.createDataFrame([(1, "create", path, None, None)], S.CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes.stop(e.follow(changes.read(spark, f"{tmp_path}/in"), f"{tmp_path}/{checkpoint}", 0))

    add("/a/one.log", "c")
    add("/a/two.log", "c")
    notes = e.store.state().notes
    shutil.rmtree(tmp_path / "c")
    add("/afterreset.log", "c")
    assert paths(e.table("files")) == ["/a/old.log", "/a/one.log", "/a/two.log", "/afterreset.log"]
    assert len(e.store.state().notes) == 2 and [*notes.values()] == [1]
    e.apply(spark.createDataFrame([(1, "delete", "/a/one.log", None, None)], S.CHANGES), *next(iter(notes.items())))
    assert "/a/one.log" in paths(e.table("files")) and "skipped" in caplog.text


def test_segments_without_a_match_are_not_opened(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/db", scan_below=0)
    e.build(spark.createDataFrame([(k, f"/x/{k}", 1, 1, 1, None) for k in range(50)], S.FILES))
    for path in ("/zebra/one", "/zeal/brass"):
        e.apply(spark.createDataFrame([(1, "create", path, None, None)], S.CHANGES))
    for pattern, regex, n, want in (("zebra", False, 1, 1), ("ze", False, 2, 2), ("zebra|x/1$", True, 2, 2), ("zebrass", False, 0, 0), ("x", False, 1, 50), ("", False, 3, 52)):
        q = Query((pattern,), regex=regex, limit=None)
        assert len(e.explain(q)[1]) == n and e.search(q).count() == want
    opened = {f.split("segment=")[1].split("/")[0] for f in e.search(Query(("zebra",), limit=None)).inputFiles()}
    assert opened == {*e.explain(Query(("zebra",)))[1]}
    assert e.explain(Query(("zebrass",)))[0].how == "nothing" and not e.may_match(Query(("zebrass",))) and e.may_match(Query(("bra",)))


def test_named_candidates_open_only_their_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(choice, "BLOCK", 6)
    monkeypatch.setattr(segments, "BLOCK", 6)
    e = Engine(spark, f"{tmp_path}/db", scan_below=0)
    e.build(spark.createDataFrame([(k, f"/x/{k}" + "/needle" * (k == 300), 1, 1, 1, None) for k in range(640)], S.FILES))
    assert e.explain(Query(("needle",)))[0].how == "index" and e.explain(Query(("/x/",)))[0].how == "scan"
    assert e.explain(Query(("dl",)))[0].how == "index" and [r.id for r in e.search(Query(("dl",))).collect()] == [300]
    lists = e.store.read("postings", e.store.state().segments).where(F.col("trigram").startswith("dl"))
    assert "StringStartsWith(trigram,dl)" in lists._jdf.queryExecution().executedPlan().toString()
    found = e.search(Query(("needle",), limit=None))
    assert [r.id for r in found.collect()] == [300]
    scan = next(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x or "Scan parquet" in x)
    assert "block" in scan and "4" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_engine_and_command_line(spark, tree, tmp_path, capsys):
    db = f"{tmp_path}/db"
    run = lambda *a: (cli.main(["-d", db, *a], spark), capsys.readouterr())
    assert run("--update", "--root", str(tree))[0] == 0
    code, said = run("-i", "report")
    assert code == 0 and said.out == f"Found 1 results:\n{tree}/sub/Report.log\n"
    assert run("report")[1].out == "No matching files found.\n"
    assert len(run("-r", r".*\.log$")[1].out.splitlines()) == 3
    assert run()[0] == run("--nonsense")[0] == 1 and run("--version")[0] == run("--help")[0] == 0
    e = Engine(spark, db)
    assert not e.may_match(Query(("qqqq",))) and e.may_match(Query(("report",), ignore_case=True))
    assert e.lookup(f"{tree}/notes.txt").count() == 1 and e.ranked("notes.txt", 1).count() == 1
    before = {r.path: r.id for r in e.table("files").collect()}
    batch = [(1, "create", f"{tree}/new.log", 0o100600, None), (2, "delete", f"{tree}/notes.txt", None, None), (3, "modify", f"{tree}/.dot", 0o100600, None)]
    e.apply(spark.createDataFrame(batch, S.CHANGES))
    assert e.search(Query((".log",)), True).count() == 3 and e.search(Query(("notes",))).count() == 0
    after = {r.path: r.id for r in e.table("files").collect()}
    assert after[f"{tree}/.dot"] == before[f"{tree}/.dot"] and after[f"{tree}/new.log"] == max(before.values()) + 1
    assert e.search(Query((".log",)), False).count() == 3
    assert e.results(e.lookup(f"{tree}/new.log")).first().permissions == 0o100600


LOG = [
    (1, "create", "/a"), (2, "modify", "/a"), (3, "create", "/b"), (4, "delete", "/b"), (5, "delete", "/c"), (6, "create", "/c"),
    (7, "delete", "/unknown"), (8, "moved_from", "/old"), (9, "moved_to", "/new"), (10, "create", "/a"), (11, "chmod", "/ignored"), (12, "create", None),
]


@pytest.fixture
def log(spark):
    return spark.createDataFrame([(*r, 0o100644, None) for r in LOG], S.CHANGES)


@pytest.fixture
def old(spark):
    return spark.createDataFrame([(0, "/old", 1, 1, 1, None), (4, "/a", 1, 7, 1, None)], S.FILES)


def test_changes(old, log):
    got = {r.path: r for r in changes.applied(old, log).collect()}
    assert {p: r.id for p, r in got.items()} == {"/a": 4, "/c": 5, "/new": 6}
    assert got["/a"].permissions == 0o100644 and got["/a"].uid == 7
    assert changes.classified(log.where("path is not null"), include_hidden=False).count() == 11
    assert changes.applied(old.where("id < 0"), log.where("seq < 0")).count() == 0


def test_stream_equals_batch(spark, old, log, tmp_path):
    state, records = f"{tmp_path}/state", f"{tmp_path}/in"
    snapshots.save(old, state)
    merge = lambda b, _: snapshots.save(changes.applied(snapshots.load(spark, state), b), state)
    for k in range(3):
        log.where((F.col("seq") > 4 * k) & (F.col("seq") <= 4 * k + 4)).coalesce(1).write.mode("append").parquet(records)
        changes.stop(changes.follow(changes.read(spark, records, 1), merge, f"{tmp_path}/checkpoint", 0))
    assert {r.path for r in snapshots.load(spark, state).collect()} == {r.path for r in changes.applied(old, log).collect()}


def test_resolved(spark):
    events = spark.createDataFrame([(1, "f"), (2, "g")], "wd int, name string")
    assert [r.path for r in changes.resolved(events, spark.createDataFrame([(1, "/d/")], "wd int, dir string")).collect()] == ["/d/f"]


def test_postings_are_counted_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Files that lie in one partition are dealt out before their trigrams are counted: a task holds about PART postings."""
    monkeypatch.setattr(segments, "PART", 1000)
    seen, build = [], postings.build
    monkeypatch.setattr(segments.postings, "build", lambda files, fold=False: seen.append(files.rdd.glom().map(len).collect()) or build(files, fold))
    files = spark.createDataFrame([(k, f"/a/file{k}", 1, 1, 1, None) for k in range(200)], S.FILES).coalesce(1)
    Engine(spark, f"{tmp_path}/db").build(files)
    assert len(seen) == 2 and all(sum(sizes) == 200 and len(sizes) == 9 and max(sizes) <= 1000 / segments.LONG + 9 for sizes in seen)
