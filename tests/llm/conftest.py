import random

import pytest

SCHEMA = "doc_id long, text string, lang string, score string, n_tokens string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows and columns whose names operators use."""
    rnd = random.Random(8)
    words = ["the", "and", "of", "stone", "river", "was", "near", "Is", "ending", "here."]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    rows = [
        (1, "the river was near the stone and the ending of the river is here.", "en", "x", "y"),
        (1, "the river was near the stone and the ending of the river is here.", "en", "x", "y"),
        (2, None, "en", None, None),
        (3, "", None, "x", None),
        (4, "  \n\t ", "en", "x", "y"),
        (5, "12 34 !!", "en", "x", "y"),
        (6, long, "en", "x", "y"),
        (7, long, "en", "x", "y"),
        (None, "no id here at all, my friend", "en", "x", "y"),
        (None, None, None, None, None),
        (8, "one", None, "x", "y"),
        (9, "ünïcode ΑΣ 中文 😀 <|endoftext|> </s> don't", "de", "x", "y"),
        (10, "x" * 70_000, "en", "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
