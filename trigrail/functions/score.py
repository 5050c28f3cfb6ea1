"""Relevance and posting-size formulas as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trigrail.functions.text import literal_trigrams, occurrences


def literal_relevance(file_id: Column, path: Column, pattern: str) -> Column:
    """Sum over the pattern's trigrams of frequency / (length - 2) * ln(id / (frequency + 1)), over the root of the length.

    The file's own id stands where a corpus size would, so it is defined for ids above 0 and paths of three
    characters or more, else null.
    """
    length = F.length(path).cast("double")

    def term(gram: str) -> Column:
        freq = occurrences(path, F.lit(gram)).cast("double")
        return F.when(freq > 0, freq / (length - 2) * F.ln(file_id / (freq + 1))).otherwise(0.0)

    total = reduce(lambda a, b: a + b, map(term, literal_trigrams(pattern)), F.lit(0.0))
    return F.when((file_id > 0) & (length >= 3), F.round(total / F.sqrt(length), 8))


def golomb_parameter(mean_gap: Column) -> Column:
    """Bits of the remainder for gaps of this mean: the rounded logarithm to base 2 of its whole part, 1 at least."""
    return F.floor(F.log2(F.greatest(F.floor(mean_gap), F.lit(1)).cast("double")) + 0.5).cast("long")
