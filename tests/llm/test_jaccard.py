"""Jaccard components against brute force, and the R-tree's bound."""

from __future__ import annotations

import random

import numpy as np
import pytest

from docframe.llm import jaccard as jc
from tests.llm import brute
from tests.llm.conftest import SF, odd_documents, rows

COLUMNS = ("doc_id", "n_shingles", "component_id")
ODD = [(r[0], r[1]) for r in odd_documents()]


def near_copies():
    """Families of near copies around the threshold, chains, shared passages and equal texts."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    out = []
    for family in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 80, 150]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy))
        if family % 3 == 0:  # a chain: each a little further from the first
            for _ in range(15):
                base = base[2:] + [rng.choice(vocab), rng.choice(vocab)]
                out.append(" ".join(base).upper())
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    out += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    out += out[:10]
    rng.shuffle(out)
    return list(enumerate(out))


def test_odd_and_real_documents(spark, odd, sample_rows, empty):
    assert rows(jc.linked_components(odd), *COLUMNS) == brute.op10(ODD)
    assert rows(jc.linked_components(spark.read.parquet(f"{SF}/documents.parquet")), *COLUMNS) == brute.op10(sample_rows)
    assert jc.linked_components(empty).count() == 0


@pytest.mark.parametrize("block, crowd", [(2048, 64), (7, 3)])
def test_near_copies(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(jc, "BLOCK", block)
    monkeypatch.setattr(jc, "CROWD", crowd)
    docs = near_copies()
    assert rows(jc.linked_components(spark.createDataFrame(docs, "doc_id long, text string")), *COLUMNS) == brute.op10(docs)


def test_the_bound_never_loses_a_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, (40, 60)).astype(np.uint64)
    sets = [np.unique(np.concatenate([b[: rng.integers(30, 60)], rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)])) for b in base for _ in range(4)]
    size = np.array([len(s) for s in sets])
    point = jc.points(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    tree = jc.Tree(point, size)
    for i in range(len(sets)):
        near = set(tree.near(point[i], int(size[i]))[0].tolist())
        assert {j for j in range(len(sets)) if jc.linked(sets[i], sets[j])} <= near


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["c"]: r["label"] for r in jc.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
