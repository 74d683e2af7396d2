from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "an ther ing ed th re on st en or at es ly ou he nd is".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text) as a documents table."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], DOCS)

    return build


@pytest.fixture
def rng():
    return random.Random(7)
