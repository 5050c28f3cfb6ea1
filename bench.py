"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from trigrail import schema as S
from trigrail import views
from trigrail.operators import longtext, postings, ranking
from trigrail.plans.engine import Engine
from trigrail.plans.search import Query
from trigrail.queries import PATTERN
from trigrail.session import session
from trigrail.sources import snapshots
from trigrail.streaming import changes

RUNS = 3
#: Paths that are searched for each one of the table; change records of a batch.
COPIES, BATCH = 100, 5000


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    conf = {"spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    place = tempfile.mkdtemp(prefix="bench-")
    atexit.register(shutil.rmtree, place, True)

    def saved(df, name):
        """df as a Parquet snapshot: what is timed reads files, so that pushed filters and skipped row groups count."""
        snapshots.save(df, f"file://{place}/{name}")
        return snapshots.load(spark, f"file://{place}/{name}")

    pages = views.files(spark, sf_dir)
    copies = spark.range(COPIES).withColumnRenamed("id", "copy")
    many = pages.join(F.broadcast(copies)).withColumn("path", F.concat("path", F.lit("/"), F.col("copy").cast("string"))).withColumn("id", F.col("id") * COPIES + F.col("copy")).drop("copy")
    engine = Engine(spark, f"file://{place}/database", scan_below=0)
    engine.build(many)
    files, index = engine.store.files(engine.store.state()), engine.table("postings")
    docs = saved(views.table(spark, sf_dir, "documents").select("doc_id", "text").repartition(cpus), "documents")
    records, pages = saved(views.changes(spark, sf_dir), "records"), saved(pages, "pages")
    batch = saved(records.where(F.col("seq") < BATCH).select(*S.CHANGES.names), "batch")
    rare = files.agg(F.max("path")).first()[0][8:]
    asked = {
        "substring": Query((PATTERN,), limit=None), "icase": Query(("EXAMPLE.ORG/EN/99",), ignore_case=True, limit=None), "rare": Query((rare,), limit=None),
        "regex": Query((r"\.org/(en|fr)/[0-9]+/77$",), regex=True, limit=None), "boolean": Query((r"(utm_source|utm_medium)=[a-z]+/17[0-9]$",), regex=True, limit=None), "short": Query(("qz",), limit=None),
    }
    todo = {
        "build_postings_pages": lambda: postings.build(pages),
        "trigram_stats_documents": lambda: longtext.trigram_stats(docs),
        **{f"search_{k}_{how}": (lambda q=q, how=how: engine.search(q, how == "index")) for k, q in asked.items() for how in ("index", "scan")},
        "relevance_topk": lambda: ranking.best(ranking.tfidf(files, index, PATTERN), 10),
        "apply_changes": lambda: changes.applied(pages, records),
    }
    times = {}
    for name, make in todo.items():
        runs = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    runs = []
    for _ in range(RUNS):  # the last: it changes the database, by a batch of the same size each time
        began = time.perf_counter()
        engine.apply(batch)
        runs.append(time.perf_counter() - began)
    times["engine_apply"] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
