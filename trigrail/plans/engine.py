"""The engine: a catalog with its index, kept in segments, and the calls on it."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrail import schema as S
from trigrail.operators import catalog, ranking
from trigrail.plans import boolean, choice
from trigrail.plans.search import Query, exact, search, trees
from trigrail.sources import filesystem, segments, snapshots
from trigrail.streaming import changes

log = logging.getLogger(__name__)


class Engine:
    """Search over one database folder. Updates add segments and versions and never change what older versions read.

    scan_below: catalogs of fewer files are scanned without a look at the index.
    """

    def __init__(self, spark: SparkSession, database: str, scan_below: int = choice.SCAN_FILES):
        self.spark, self.database, self.scan_below = spark, database.rstrip("/"), scan_below
        self.store = segments.Store(spark, self.database)

    def table(self, name: str, at: int | None = None) -> DataFrame:
        """Live rows of files, postings or postings_folded, now or of version at."""
        state = self.store.state(at)
        return self.store.files(state).select(*S.FILES.names) if name == "files" else self.store.postings(state, name).where(F.length("trigram") == S.TRIGRAM)

    def update(self, root: str, **options: str) -> None:
        """Scans the tree below root and replaces the catalog and the index."""
        scanned = filesystem.scan(self.spark, root, **options)
        self.build(catalog.dense_ids(scanned, "path").select(*S.FILES.names))

    def build(self, files: DataFrame) -> None:
        """Makes files the catalog, as one segment."""
        base = self.store.latest()
        files = snapshots.held(files)
        n, top = files.agg(F.count("*"), F.max("id")).first()
        self.store.commit(base, self.store.add(files, n), {}, 0 if top is None else top + 1, base.notes)

    def _planned(self, state: segments.State, query: Query) -> tuple[choice.Choice, list[str]]:
        """How to search, and in which segments: those without what every match needs aren't opened."""
        tree, every = trees(self.spark, query, tails=True), sorted(state.segments)
        if tree in (boolean.ANY, boolean.NONE) or state.n_files < self.scan_below:
            return choice.choose(tree) if tree == boolean.NONE else choice.Choice("scan", tree), every
        lengths = choice.measured(self.store.read(f"{self._index(query)}_lengths", every), tree)
        names = choice.opened(tree, lengths)
        counts = choice.summed({n: lengths[n] for n in names})
        return choice.choose(tree, counts, sum(state.segments[n] for n in names)), names

    @staticmethod
    def _index(query: Query) -> str:
        return "postings_folded" if query.ignore_case else "postings"

    def explain(self, query: Query) -> tuple[choice.Choice, list[str]]:
        """Whether a search scans or reads lists, which, and how many rows at most; and the segments that it opens."""
        return self._planned(self.store.state(), query)

    def search(self, query: Query, use_index: bool = True) -> DataFrame:
        """(id, path) of the readable matches. Lists of deleted rows are read too: their files are not in the catalog."""
        state = self.store.state()
        if not use_index:
            return search(self.store.files(state), query)
        how, names = self._planned(state, query)
        return search(self.store.files(state, names), query, self.store.read(self._index(query), names), how, self.store.files(state))

    def results(self, found: DataFrame) -> DataFrame:
        """Full catalog rows of found (id)."""
        return self.table("files").join(found.select("id"), "id", "left_semi")

    def lookup(self, path: str) -> DataFrame:
        return exact(self.table("files"), path)

    def ranked(self, pattern: str, k: int) -> DataFrame:
        """(file_id, score) of the k most relevant files."""
        return ranking.best(ranking.tfidf(self.table("files"), self.table("postings"), pattern), k)

    def may_match(self, query: Query) -> bool:
        """False if no path can match: of every pattern a trigram that it needs stands in no list."""
        state, tree = self.store.state(), trees(self.spark, query, tails=True)
        if tree == boolean.ANY:
            return True
        return bool(choice.opened(tree, choice.measured(self.store.read(f"{self._index(query)}_lengths", state.segments), tree)))

    def apply(self, batch: DataFrame, stream: str = "", number: int = -1) -> None:
        """Merges change records into a new version, at once or, if this fails, not at all.

        What is written is of the size of the batch: a segment of the rows that are new or changed, and the deletions of those that they replace;
        of the catalog the paths are read. Paths keep their ids; new ones get ids that none had, in the order of paths. Records may lack uid
        and gid: a known file keeps its own. A batch that a stream repeats (its number is not above the last one's) changes nothing.
        """
        state = self.store.latest()
        if stream and number <= state.notes.get(stream, -1):
            log.warning("batch %d of the stream %s is skipped: %d was merged before", number, stream, state.notes[stream])
            return
        final = snapshots.held(changes.last(batch if "action" in batch.columns else changes.classified(batch)))
        n = final.count()
        if not n:
            return
        sent = F.broadcast(final.alias("n")) if n <= segments.SENT else final.alias("n")
        met = snapshots.held(self.store.files(state).alias("o").join(sent, F.col("o.path") == F.col("n.path")).select(*[F.col(f"o.{c}").alias(f"o_{c}") for c in (*S.FILES.names, "segment")], *[F.col(f"n.{c}").alias(f"n_{c}") for c in final.columns]))
        new = {c: F.col(f"n_{c}") if c in final.columns else F.lit(None) for c in ("permissions", "uid", "gid", "modified")}
        kind = {c: S.FILES[c].dataType for c in new}
        changed = met.where("n_action = 'upsert'").select(F.col("o_id").alias("id"), F.col("o_path").alias("path"), *[F.coalesce(x, F.col(f"o_{c}")).cast(kind[c]).alias(c) for c, x in new.items()])
        unseen = final.where("action = 'upsert'").join(met.select(F.col("o_path").alias("path")), "path", "left_anti")
        unseen = unseen.select("path", *[(F.col(c) if c in final.columns else F.lit(None)).cast(kind[c]).alias(c) for c in new])
        added = snapshots.held(catalog.dense_ids(unseen, "path", state.next_id).select(*S.FILES.names).unionByName(changed.select(*S.FILES.names)))
        n, top = added.agg(F.count("*"), F.max("id")).first()
        made = self.store.add(added, n)
        gone = self.store.remove(met.select(F.col("o_segment").alias("segment"), F.col("o_id").alias("id")), met.count())
        notes = state.notes | ({stream: number} if stream else {})
        self.store.commit(state, state.segments | made, state.deletes | gone, max(state.next_id, -1 if top is None else top + 1), notes)

    def compact(self, everything: bool = False) -> bool:
        """Merges the segments of a full tier, or all of them, into one. Whether there was something to merge."""
        state = self.store.state()
        names = sorted(state.segments) if everything else self.store.due(state)
        if not names or (len(names) == 1 and not state.deletes):
            return False
        self.store.merge(state, names)
        return True

    def vacuum(self, keep: int = 1, idle: float = 3600) -> int:
        """Deletes older versions and what only they, or no version, have."""
        return self.store.vacuum(keep, idle)

    def follow(self, stream: DataFrame, checkpoint: str, seconds: int = 30, once: bool = False):
        """A started streaming query that applies every micro-batch once, also if one is repeated after a failure, and merges full tiers; stop it with changes.stop().

        Batches are known by the id of the query in its checkpoint: with a new checkpoint it is another stream, and starts anew.
        """

        def merge(batch: DataFrame, number: int) -> None:
            self.apply(batch, changes.identity(self.spark, checkpoint), number)
            while self.compact():
                pass

        return changes.follow(stream, merge, checkpoint, seconds, once)

    def close(self) -> None:
        self.spark.catalog.clearCache()

