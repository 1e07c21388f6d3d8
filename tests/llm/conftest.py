import random

import pytest

SCHEMA = "doc_id long, text string, lang string, failed string, words string"


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names an operator uses itself, nulls among them."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, "x", None) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def noise(pieces, n, longest=40, seed=0, join=""):
    rng = random.Random(seed)
    return [join.join(rng.choices(pieces, k=rng.randint(0, longest))) for _ in range(n)]
