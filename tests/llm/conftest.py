import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain

COLUMNS = "share long, doc_id long, text string, region string, rep int, lang string, bucket int, n long, source string, n_chars long, all int"


def table(spark, docs, lang="en"):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(1, d, t, "r", 2, lang if d % 7 else None, 3, 4, "s", len(t or ""), 5) for d, t in docs.items()], COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def corpus():
    return plain.corpus()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus, with a row without id, and one whose id stands twice, the greater text and a null."""
    extra = spark.createDataFrame([(1, None, "no id", "r", 2, "en", 3, 4, "s", 5, 5), (1, 3, None, "r", 2, "en", 3, 4, "s", 0, 5), (1, 3, "zzz", "r", 2, "en", 3, 4, "s", 3, 5)], COLUMNS)
    return table(spark, corpus).unionByName(extra).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id = -1")
