import random

import pytest
from llm_cases import SCHEMA


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows, **more):
        full = [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    """Invented words by number, the same in every run."""
    rng = random.Random(7)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]

    def make(n, seed=0):
        own = random.Random(seed)
        return [own.choice(pool) for _ in range(n)]

    return make
