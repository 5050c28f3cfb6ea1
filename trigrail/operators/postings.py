"""The inverted index from trigrams to files, kept long: one row for each trigram of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trigrail.functions import score, text


def exploded(files: DataFrame) -> DataFrame:
    """(file_id, pos from 0, trigram)."""
    return files.select(F.col("id").alias("file_id"), F.posexplode(text.trigrams(F.col("path"))).alias("pos", "trigram")).select("file_id", F.col("pos").cast("long"), "trigram")


def build(files: DataFrame, fold_case: bool = False) -> DataFrame:
    """(trigram, file_id, freq). Counts are per file and so bounded by its path, whatever the trigram's frequency."""
    if fold_case:
        files = files.withColumn("path", text.folded(F.col("path")))
    return exploded(files).groupBy("trigram", "file_id").agg(F.count("*").alias("freq"))


def tails(files: DataFrame, fold_case: bool = False) -> DataFrame:
    """(trigram, file_id, freq) of the last two characters of each path and of its last one, in place of the trigrams that would begin there.

    With them a string of one or two characters is in a path if, and only if, a row of the path begins with it.
    """
    path = text.folded(F.col("path")) if fold_case else F.col("path")
    rows = files.select(F.explode(F.array_distinct(F.array(F.right(path, F.lit(2)), F.right(path, F.lit(1))))).alias("trigram"), F.col("id").alias("file_id"), F.lit(1).cast("long").alias("freq"))
    return rows.where(F.length("trigram") > 0)


def laid_out(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """Postings (or blocks of them, by the key block) sorted by trigram, so that scans skip row groups; a trigram of very many files is dealt to several tasks."""
    return rows.repartitionByRange("trigram", key).sortWithinPartitions("trigram", key)


#: Most ids that are broadcast.
FEW = 1_000_000


def dictionary(postings: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(trigram, num_files, num_occurrences). again (file_id, each once): files whose path another one has too, of which num_files counts only that other one."""
    if again is not None:
        few = F.broadcast(again) if again.count() <= FEW else again.hint("merge")
        rows = postings.join(few.withColumn("again", F.lit(True)), "file_id", "left")
        return rows.groupBy("trigram").agg(F.count_if(F.col("again").isNull()).alias("num_files"), F.sum("freq").alias("num_occurrences"))
    return postings.groupBy("trigram").agg(F.count("*").alias("num_files"), F.sum("freq").alias("num_occurrences"))


def cardinality(postings: DataFrame) -> DataFrame:
    return postings.agg(F.countDistinct("trigram").alias("n_trigrams"))


#: Ids, or places in a list, of a block: a long list is dealt to tasks by blocks.
BLOCK = 1 << 20


def gaps(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """(trigram, pos from 1, file_id, gap to the last file_id, of the first one to 0).

    A posting list is dealt in blocks of ids; what lies before a block (a count and an id) comes from a row for each block.
    """
    rows = postings.select("trigram", "file_id", F.floor(F.col("file_id") / block).alias("block"))
    whole = W.partitionBy("trigram").orderBy("block")
    blocks = rows.groupBy("trigram", "block").agg(F.count("*").alias("n"), F.max("file_id").alias("last"))
    before = blocks.select("trigram", "block", (F.sum("n").over(whole) - F.col("n")).alias("done"), F.lag("last", 1, 0).over(whole).alias("left"))
    w = W.partitionBy("trigram", "block").orderBy("file_id")
    gap = F.col("file_id") - F.coalesce(F.lag("file_id").over(w), F.col("left"))
    return rows.join(before, ["trigram", "block"]).select("trigram", (F.col("done") + F.row_number().over(w)).cast("long").alias("pos"), "file_id", gap.alias("gap"))


def decoded(gap_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(trigram, pos, file_id) back from gaps, dealt in blocks of places."""
    rows = gap_rows.select("trigram", "pos", "gap", F.floor(F.col("pos") / block).alias("block"))
    whole = W.partitionBy("trigram").orderBy("block")
    blocks = rows.groupBy("trigram", "block").agg(F.sum("gap").alias("sum"))
    before = blocks.select("trigram", "block", (F.sum("sum").over(whole) - F.col("sum")).alias("left"))
    w = W.partitionBy("trigram", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(before, ["trigram", "block"]).select("trigram", "pos", (F.col("left") + F.sum("gap").over(w)).alias("file_id"))


def codec_stats(gap_rows: DataFrame) -> DataFrame:
    """(trigram, num_files, k, golomb_bytes): the remainder bits that suit a list's mean gap, and the bytes it then takes.

    A gap takes one byte for each whole 2**k in it, and one more.
    """
    k = score.golomb_parameter(F.avg("gap"))
    lists = gap_rows.groupBy("trigram").agg(F.count("*").alias("num_files"), k.alias("k"))
    each = gap_rows.join(lists, "trigram")
    size = F.sum(F.floor(F.col("gap") / F.pow(F.lit(2.0), F.col("k")))) + F.count("*")
    return each.groupBy("trigram", "num_files", "k").agg(size.cast("long").alias("golomb_bytes"))


def without(postings: DataFrame, deleted: DataFrame) -> DataFrame:
    """Postings of files whose id is not in deleted (file_id)."""
    return postings.join(deleted.select("file_id").distinct(), "file_id", "left_anti").select("trigram", "file_id", "freq")
