"""Folders above paths: against a plain version, in both joins, and in a scanned tree."""

import os
import random

import pytest
from pyspark.sql import functions as F

from trigrail.operators import ancestors
from trigrail.plans.engine import Engine
from trigrail.plans.search import Query


def above(path):
    bare = path.rstrip("/")
    return [os.path.normpath(bare[:i].rstrip("/") or "/") for i in range(len(bare)) if bare[i] == "/"]


def may_enter(mode, owner, group, uid, gid):
    return uid == 0 or bool(mode & 0o001 or (owner == uid and mode & 0o100) or (group == gid and mode & 0o010))


def test_ancestors_of_odd_paths(spark):
    paths = ["", "a", "/", "/a", "/a/b/c", "a/b", "/a//b", "/a/b/", "/é ü/x", "/" + "d/" * 70 + "f", None]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", ancestors.ancestors(F.col("path")).alias("a")).collect()
    assert {r.path: r.a for r in rows if r.path is not None} == {p: list(dict.fromkeys(above(p))) for p in paths if p is not None}


@pytest.mark.parametrize("sent", [ancestors.SENT, 0])
def test_reachable_like_plain_code(spark, monkeypatch, sent):
    monkeypatch.setattr(ancestors, "SENT", sent)
    r = random.Random(5)
    folders = {f"/{'/'.join(r.choices('abc', k=n))}" for n in (1, 2, 3, 4) for _ in range(12)} | {"/"}
    modes = {f: (r.choice([0o40711, 0o40700, 0o40710, 0o40755]), r.choice([1, 2]), r.choice([5, 6])) for f in sorted(folders)}
    modes["/"] = (0o40755, 0, 0)
    files = [f"/{'/'.join(r.choices('abc', k=r.randint(1, 5)))}/f{i}" for i in range(200)] + ["/top", "bare", "", "/a/b/x", "/a/b/x"]
    rows = [(f + "/" * (i % 2) if f != "/" else f, *m) for i, (f, m) in enumerate(modes.items())] + [(f, 0o100600, 1, 5) for f in files] + [(None, None, None, None)]
    catalog = spark.createDataFrame(rows, "path string, permissions int, uid int, gid int")
    found = spark.createDataFrame([(f, f) for f in [*files, None]], "path string, folder string")
    for uid, gid in ((1, 5), (2, 6), (9, 9), (0, 0)):
        got = sorted(x.path for x in ancestors.reachable(found, catalog, uid, gid).collect() if x.path is not None)
        want = sorted(f for f in files if all(may_enter(*modes[a], uid, gid) for a in above(f) if a in modes))
        assert got == want
    assert ancestors.reachable(found, catalog.limit(0), 1, 5).count() == len(files) + 1
    assert ancestors.reachable(found.limit(0), catalog, 1, 5).count() == 0


def test_scanned_tree_with_a_closed_folder(spark, tmp_path):
    for name in ("open/a.log", "open/shut/b.log", "open/shut/deep/c.log"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).touch()
    for name, mode in (("open", 0o755), ("open/shut/deep", 0o755), ("open/shut", 0o700)):
        (tmp_path / "tree" / name).chmod(mode)
    engine = Engine(spark, f"{tmp_path}/db", scan_below=0)
    engine.update(f"{tmp_path}/tree", include_folders="true")
    names = lambda **k: sorted(os.path.basename(r.path) for r in engine.search(Query((".log",), uid=4321, gid=4321, **k)).collect())
    assert names() == ["a.log", "b.log", "c.log"]
    assert names(parents=True) == names(parents=True, limit=None) == ["a.log"]
    assert names(parents=True, limit=1) == ["a.log"]
