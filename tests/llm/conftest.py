import os

import pytest

from patchlight.llm.common import DOCUMENTS

SF = "/root/testdata/sf0.001"
LONG = "word " * 4000 + "x" * 30_000 + " Ünï " * 3000


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, repeated rows, equal texts, control strings."""
    passage = " ".join(f"shared{i}" for i in range(60))
    near = " ".join(f"near{i}" for i in range(80))
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", None, None),
        (3, LONG, None, "a", 1),
        (4, LONG + "!", "en", "a", 2),
        (5, "one two", "en", "a", 7),
        (6, "one two", "de", "b", 7),
        (6, "one two", "de", "b", 7),
        (7, f"begin {passage} end of seven", "en", "a", 1),
        (8, f"start {passage} stop of eight", "en", "a", 1),
        (9, near, "en", "a", 1),
        (10, near + " more", "en", "a", 1),
        (11, near.replace("near79", "far"), "en", "a", 1),
        (12, "a <|endoftext|> b <|im_end|> \\ <\\| é 😀 \x1c\x85 ³ İ", "en", "a", 1),
        (13, "   \n\t ", "en", "a", 1),
        (None, "no id here, only words", "en", "a", 1),
        (14, "same same same same\nsame same same same\n# | $", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest table of documents, as a list and as a table."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    frame = spark.read.schema(DOCUMENTS).parquet(f"{SF}/documents.parquet")
    return frame, [(r.doc_id, r.text or "") for r in frame.collect()]


@pytest.fixture(scope="session")
def crowded(edges):
    """The edge rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["row", "key", "name", "content", "score", "kept", "raw", "words", "_sealed", "component", "id", "left", "digest"]
    return edges.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
