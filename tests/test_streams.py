"""Streams of tree changes and of records in any order."""

import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from trigrail import schema as S
from trigrail.plans.engine import Engine
from trigrail.plans.search import Query
from trigrail.sources import filesystem, snapshots
from trigrail.streaming import changes, state, watch


def seen(n, time_=1, size=1, mode=0o100644):
    return (f"1:{n}", mode, 0, 0, time_, size)


def test_differences_of_listings():
    old = {"/a": seen(1), "/b": seen(2), "/c": seen(3), "/d": seen(4), "/e": seen(5)}
    new = {"/a": seen(1), "/b": seen(2, time_=2), "/c2": seen(3), "/d2": seen(4, size=9), "/f": seen(6)}
    got = {(op, p) for op, p, _ in watch.difference(old, new)}
    assert got == {("modify", "/b"), ("moved_from", "/c"), ("moved_to", "/c2"), ("delete", "/d"), ("create", "/d2"), ("delete", "/e"), ("create", "/f")}
    assert [*watch.difference(new, new)] == [] and len([*watch.difference({}, new)]) == 5
    links = {"/x": seen(7), "/y": seen(7)}
    assert sorted((op, p) for op, p, _ in watch.difference(links, {"/z": seen(7)})) == [("delete", "/y"), ("moved_from", "/x"), ("moved_to", "/z")]


@pytest.mark.parametrize("tasks", ["1", "4"])
def test_a_followed_tree_is_a_scanned_tree(spark, tmp_path, tasks):
    """Between the batches the tree changes and the query is started anew; one batch is lost after its merge and comes again."""
    root, db = tmp_path / "tree", f"{tmp_path}/db"
    (root / "sub/deep").mkdir(parents=True)
    (root / "other").mkdir()
    for p in ("notes.txt", ".dot", "sub/report.log", "sub/deep/x.log", "other/y", "other/z"):
        (root / p).write_text(p)
    e = Engine(spark, db, scan_below=0)

    def run(fails=False):
        stream = watch.changes_of(spark, str(root), f"{tmp_path}/listings", tasks=tasks)
        if fails:
            def merge(batch, number):
                e.apply(batch, changes.identity(spark, f"{tmp_path}/c"), number)
                raise RuntimeError("lost")

            with pytest.raises(Exception, match="lost"):
                changes.follow(stream, merge, f"{tmp_path}/c", once=True).awaitTermination()
        else:
            e.follow(stream, f"{tmp_path}/c", once=True).awaitTermination()

    def same():
        want = {(r.path, r.permissions, r.uid, r.modified) for r in filesystem.scan(spark, str(root)).collect()}
        assert {(r.path, r.permissions, r.uid, r.modified) for r in e.table("files").collect()} == want
        return len(want)

    run()
    assert same() == 6
    (root / "new/below").mkdir(parents=True)
    (root / "new/below/f.log").write_text("f")
    (root / "sub/fresh").mkdir()
    (root / "sub/fresh/g.log").write_text("g")
    (root / "notes.txt").chmod(0o600)
    (root / "sub/report.log").rename(root / "sub/moved.log")
    (root / "other/y").rename(root / "sub/y")
    (root / "other/z").unlink()
    run()
    assert same() == 7
    shutil.rmtree(root / "sub")
    (root / "new/below/f.log").write_text("longer")
    os.utime(root / "new/below/f.log", (1, 1))
    run(fails=True)
    (root / "late").write_text("comes after the lost batch")
    run()
    run()
    assert same() == 4
    assert [r.path for r in e.search(Query(("f.log",))).collect()] == [f"{root}/new/below/f.log"] and e.search(Query(("moved",))).count() == 0
    assert len(os.listdir(tmp_path / "listings")) <= 2


def test_records_in_any_order_end_as_the_log(spark, tmp_path):
    rnd = random.Random(7)
    log = [(k, rnd.choice(["create", "modify", "delete", "moved_from", "moved_to", "attrib"]), f"/p{rnd.randint(0, 30)}", 0o100600 + k % 64, None) for k in range(400)] + [(None, "create", "/never", 1, None), (401, "create", None, 1, None)]
    old = spark.createDataFrame([(k, f"/p{k}", 1, 1, 1, None) for k in range(10)], S.FILES)
    want = {(r.path, r.permissions) for r in changes.applied(old, spark.createDataFrame([r for r in log if r[0] is not None], S.CHANGES)).collect()}
    told = log + rnd.sample(log, 150)
    rnd.shuffle(told)
    place = f"{tmp_path}/state"
    snapshots.save(old, place)
    merge = lambda b, _: snapshots.save(changes.applied(snapshots.load(spark, place), b.drop("action")), place)
    for k in range(3):
        spark.createDataFrame(told[k::3], S.CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes.follow(state.latest(changes.read(spark, f"{tmp_path}/in", 1)), merge, f"{tmp_path}/c", once=True).awaitTermination()
    assert {(r.path, r.permissions) for r in snapshots.load(spark, place).collect()} == want


def test_only_news_goes_on_and_a_batch_is_worked_off_once(spark, tmp_path):
    """Repeated and overtaken records don't go on; a merge of a batch reads its source once, by tasks of the JVM alone."""
    batches = [[(1, "create", "/a", 1, None), (5, "modify", "/b", 1, None)], [(1, "create", "/a", 1, None), (4, "delete", "/b", 1, None), (7, "attrib", "/a", 1, None)], [(6, "delete", "/b", 1, None), (2, "modify", "/a", 2, None), (2, "modify", "/a", 2, None)]]
    place, got, read = f"{tmp_path}/files", [], spark.sparkContext.accumulator(0)
    os.makedirs(tmp_path / "in")
    snapshots.save(spark.createDataFrame([(0, "/a", 1, 1, 1, None)], S.FILES), place)
    news = state.latest(changes.read(spark, f"{tmp_path}/in", 100))

    def merge(batch, _):
        counted = batch.mapInArrow(lambda them: (read.add(b.num_rows) or b for b in them), batch.schema)
        snapshots.save(changes.applied(snapshots.load(spark, place), counted), place)
        got.append(sorted((r.path, r.seq, r.action) for r in batch.collect()))

    for rows in batches:
        spark.createDataFrame(rows, S.CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = changes.follow(news, merge, f"{tmp_path}/c", once=True)
        query.awaitTermination()
        assert "Python" not in query._jsq.explainInternal(False)
    assert got == [[("/a", 1, "upsert"), ("/b", 5, "upsert")], [], [("/a", 2, "upsert"), ("/b", 6, "delete")]]
    assert read.value == 4


def test_halves_of_moves_find_each_other(spark, tmp_path):
    kind = "seq long, op string, path string, cookie long"
    batches = [[(1, "moved_from", "/a", 7), (2, "moved_to", "/x", 8), (3, "create", "/c", 7)], [(4, "moved_to", "/b", 7), (1, "moved_from", "/a", 7), (5, "moved_from", "/gone", 9), (6, "moved_to", "/n", None)], [(4, "moved_to", "/b", 7)]]
    got = []
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep = lambda b, _: got.extend(tuple(r) for r in b.collect())
    query = state.moves(stream, 12_000).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()  # timers keep it busy: it never runs out of batches
    for rows in batches:  # a batch each
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.1)
    end = time.time() + 90
    while len(got) < 3 and time.time() < end:
        time.sleep(1)
    query.stop()
    assert sorted(got) == [(7, 4, "/a", "/b", True), (8, 2, None, "/x", False), (9, 5, "/gone", None, False)]

