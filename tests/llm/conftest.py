import os
import sys

import pytest

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from papyra.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, tied, repeated and very long texts, and columns with clashing names."""
    rows = [
        (1, None, "en", 1, "x"), (2, "", None, 2, None), (3, " \n\t ", "en", 3, "x"), (4, "One word", "en", 4, "x"),
        (4, "One word", "en", 4, "x"), (5, "One word", "fr", None, "y"), (None, "no id here at all", "en", 6, "x"),
        (6, "langé 日本語 \U0001f600 <|endoftext|> ▁ end", "en", 7, "x"),
        (7, "very long words " * 20_000, "en", 8, "x"), (8, "a" * 200_000, "en", 9, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long, score string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
