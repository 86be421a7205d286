"""Documents for the operator tests: planted cases, odd cases and real rows."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents():
    """Nulls, empty, short and long texts, repeats in and across documents, ties."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, long = prose(60), prose(300)
    near = long.split()
    texts = [None, "", " \n\t ", "one", "One TWO three", prose(4), prose(5), prose(49), prose(50), passage, prose(30) + " " + passage,
             passage + "\n" + prose(20), long, long, long.upper(), " ".join(near[:100] + ["x"] + near[101:]), " ".join(near[:200]), "a" * 500, "ab" * 400,
             "la la " * 120, (prose(12) + "\n") * 6, prose(6000), "\U0001f600 é " * 60, "x\x00y \x1f z\x0b\x0cw " + passage, passage]
    return [(i, t, "en", "hot" if i % 3 else None, len(t) if t else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="session")
def sample_rows():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in t]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
