import random

import pytest

from siltstone.llm.common import ready


@pytest.fixture
def docs(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows and a column whose name clashes."""
    ready(spark)
    rng = random.Random(5)
    vocabulary = ["the", "of", "Stone", "río", "straße", "loam", "silt", "clay", "sand", "x1"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = prose(4000)
    rows = [(0, None, "en", "a", 0), (1, "", None, None, 0), (2, long, "en", "a", 1), (3, long, "en", "b", 1), (4, " \n\t ", "en", "b", 1)]
    rows += [(5, long + " tail", None, "c", 2), (6, "one", "de", "c", 2), (6, "one", "de", "c", 2), (7, "€ 𝛼 \x1c ok", "fr", None, 2)]
    rows += [(8 + k, prose(rng.randrange(1, 60)) + ("\nShared  LINE\n" if k % 2 else "\nshared  line \r"), "en", "abc"[k % 3], k) for k in range(24)]
    rows += [(None, "no id here", "en", "a", None)]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, n_lines int")


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
