"""Column functions on paths and other short strings. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trigrail import schema as S


def trigrams(text: Column) -> Column:
    """Every run of three characters, in order, repeats included; shorter strings have none.

    For short strings: the cost of a substring grows with its place. Long texts: operators.longtext.
    """
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: i <= F.length(text) - 2)
    return F.transform(places, lambda i: F.substring(text, i, S.TRIGRAM))


def folded(text: Column) -> Column:
    """Lower case, letter by letter: the one letter that is lowered by its place in a word (the Greek sigma at an end) has one form. What contains a string so contains its folded form when folded."""
    return F.translate(F.lower(text), "ς", "σ")


def literal_trigrams(pattern: str) -> list[str]:
    """The distinct trigrams of a query string, in order of their first place."""
    return list(dict.fromkeys(pattern[i : i + S.TRIGRAM] for i in range(len(pattern) - S.TRIGRAM + 1)))


def packed(trigram: Column) -> Column:
    """A trigram of three one-byte characters as a number, the first character lowest."""
    part = [F.ascii(F.substring(trigram, i + 1, 1)).cast("long") for i in range(S.TRIGRAM)]
    return part[0] + F.shiftleft(part[1], 8) + F.shiftleft(part[2], 16)


def occurrences(text: Column, gram: Column) -> Column:
    """How often gram stands in text without overlaps, from the left."""
    return ((F.length(text) - F.length(F.replace(text, gram, F.lit("")))) / F.length(gram)).cast("long")


def tokens(path: Column) -> Column:
    """The components of a path, empty ones left out."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def depth(path: Column) -> Column:
    """Directories above the last component."""
    return F.greatest(F.size(tokens(path)) - 1, F.lit(0))


def joined(folder: Column, name: Column) -> Column:
    """folder/name with single slashes."""
    return F.regexp_replace(F.concat_ws("/", folder, name), "/+", "/")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def runs(text: Column) -> Column:
    """Run-length tokens: a character, or for a run of it the character, a star and the run's length, by spaces.

    Each run is matched as a whole by a back-reference; its length is that of the match.
    """
    each = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), 1)
    return F.array_join(F.transform(each, lambda r: F.when(F.length(r) > 1, F.concat(F.left(r, F.lit(1)), F.lit("*"), F.length(r).cast("string"))).otherwise(r)), " ")


def register(spark: SparkSession) -> None:
    """trigrams() as a table function for SQL: SELECT ... FROM t, LATERAL path_trigrams(path). Built-in expressions, as everywhere here."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION path_trigrams(path STRING) RETURNS TABLE (pos BIGINT, trigram STRING)
        RETURN SELECT i - 1, substring(path, CAST(i AS INT), 3) FROM (SELECT explode(filter(sequence(1L, greatest(length(path) - 2L, 1L)), i -> i <= length(path) - 2)) AS i)""")
