"""Pseudo-likelihood scores: the network against a plain loop, and what it learns."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pyarrow as pa

from docframe.llm import lm_scoring as lm
from tests.llm.conftest import SF


def plain_probability(model, tables, symbols, i, word):
    """Probability of a word at a place, by loops over classes and tree nodes."""
    into, out, bias, tree = model
    h = np.zeros(lm.WIDTH)
    for k, s in enumerate(lm.OFFSETS):
        h += into[k * (lm.INPUTS + 1) + (symbols[i + s] if 0 <= i + s < len(symbols) else lm.OUTSIDE)]
    h = np.tanh(h)
    z = [math.exp(h @ out[:, c] + bias[c]) for c in range(lm.CLASSES)]
    p = z[tables.class_of[word]] / sum(z)
    for node, sign in zip(tables.nodes[tables.first[word] : tables.first[word + 1]], tables.signs[tables.first[word] : tables.first[word + 1]]):
        p /= 1 + math.exp(-sign * (h @ tree[node]))
    return p


def test_scores_equal_a_plain_loop_and_all_words_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "b c"), (3, None), (4, ""), (None, "b c")], "doc_id long, text string")
    flat, tables = lm.fit(docs)
    model = lm.parts(flat.astype(np.float64))
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    words = lm.bucket_ids([b"a b c d e f"])[0] % tables.buckets
    symbols = tables.input_of[words].tolist()
    total = sum(math.log(plain_probability(model, tables, symbols, i, w)) for i, w in enumerate(words.tolist()))
    assert abs(got[1]["log_likelihood"] - total) < 1e-3
    assert abs(sum(plain_probability(model, tables, symbols, 2, w) for w in range(tables.buckets)) - 1) < 1e-9
    assert got[3]["n_words"] == 0 and got[3]["log_likelihood"] == 0.0 and got[4]["n_words"] == 0 and got[None]["log_likelihood"] == got[2]["log_likelihood"]


def test_a_step_follows_the_gradient_of_the_plain_loss():
    rng = np.random.default_rng(4)
    tables = lm.Tables(rng.integers(0, 50, lm.MOST_BUCKETS) * (np.arange(lm.MOST_BUCKETS) < 200))
    flat = (lm.fresh(tables) + rng.normal(0, 0.05, len(lm.fresh(tables)))).astype(np.float64)
    words = np.array([3, 7, 3, 150, 9, 21, 3, 8])
    symbols = tables.input_of[words]
    loss = lambda f: -sum(math.log(plain_probability(lm.parts(f), tables, symbols.tolist(), i, int(words[i]))) for i in range(len(words)))
    after = flat.copy()
    lm.step(lm.parts(after), tables, words, lm.neighbours(symbols, np.array([0, len(words)]), np.arange(len(words))))
    moved = np.flatnonzero(after != flat)
    shared = range(len(lm.OFFSETS) * (lm.INPUTS + 1) * lm.WIDTH, len(flat) - tables.inner * lm.WIDTH)
    for i in rng.choice(moved, 60, replace=False).tolist():
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert abs((flat[i] - after[i]) / (lm.RATE if i in shared else lm.OWN_RATE) - slope) < 1e-4 * max(1, abs(slope))


def step_by_sorting(model, tables, words, around):
    """The same step with flat lists of nodes, whose shares are sorted by row and summed."""
    into, out, bias, tree = model
    hidden = np.tanh(sum(into.take(a, axis=0) for a in around))
    z = hidden @ out + bias
    grad = np.exp(z - z.max())
    grad /= grad.sum(axis=1, keepdims=True)
    grad[np.arange(len(words)), tables.class_of[words]] -= 1
    back = grad @ out.T
    begin, length = tables.first[words], tables.first[words + 1] - tables.first[words]
    owner = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(length) - length), length)
    nodes, signs = tables.flat_nodes.take(at), tables.flat_signs.take(at)
    there, rows = hidden.take(owner, axis=0), tree.take(nodes, axis=0)
    miss = -signs / (1 + np.exp(signs * np.einsum("ij,ij->i", there, rows)))
    some = np.flatnonzero(length)
    back[some] += np.add.reduceat(rows * miss[:, None], (np.cumsum(length) - length)[some], axis=0)
    back *= lm.OWN_RATE * (1 - hidden * hidden)
    out -= hidden.T @ (lm.RATE * grad)
    bias -= lm.RATE * grad.sum(axis=0)
    for table, places, shares in ((tree, nodes, there * (lm.OWN_RATE * miss)[:, None]), (into, around.ravel(), np.tile(back, (len(around), 1)))):
        order = np.argsort(places, kind="stable")
        ranked = places[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        table[ranked[first]] -= np.add.reduceat(shares.take(order, axis=0), first, axis=0)


def test_a_step_takes_less_time_than_one_by_sorting():
    rng = np.random.default_rng(6)
    tables = lm.Tables((1e6 / (1 + np.arange(lm.MOST_BUCKETS))).astype(np.int64))
    tables.flat_nodes, tables.flat_signs = tables.nodes, tables.signs
    words = np.minimum((lm.MOST_BUCKETS ** rng.random(20 * lm.BATCH)).astype(np.int64), lm.MOST_BUCKETS - 1)
    symbols, ends = tables.input_of[words], np.array([0, len(words)])
    batches = [(words[a : a + lm.BATCH], lm.neighbours(symbols, ends, np.arange(a, a + lm.BATCH))) for a in range(0, len(words), lm.BATCH)]
    best, after = {}, {}
    for f in (lm.step, step_by_sorting) * 4:
        after[f] = lm.fresh(tables)
        began = time.process_time()
        for some, around in batches:
            f(lm.parts(after[f]), tables, some, around)
        best[f] = min(best.get(f, 1e9), time.process_time() - began)
    assert np.allclose(after[lm.step], after[step_by_sorting], atol=1e-4)
    assert best[lm.step] < 0.8 * best[step_by_sorting]


def test_context_is_learned(spark):
    rng = random.Random(1)
    cycle = [f"w{i}" for i in range(12)]
    ordered = [(i, " ".join((cycle * 30)[j : j + 200])) for i, j in enumerate(rng.randrange(12) for _ in range(200))]
    shuffled = [(1000 + i, " ".join(rng.sample(t.split(), 200))) for i, t in ordered[:20]]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(spark.createDataFrame(ordered + shuffled, "doc_id long, text string")).collect()}
    assert np.mean([got[i] for i in range(200)]) > np.mean([got[1000 + i] for i in range(20)]) + 0.5


def test_odd_real_and_empty_inputs(spark, odd, empty):
    assert lm.score(odd).count() == odd.count() and lm.score(empty).count() == 0
    got = lm.score(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert np.isfinite(got.log_likelihood).all() and (got.log_likelihood <= 0).all()


def test_every_word_is_a_training_target_once():
    texts = ["a b c", "d e", "", None, "f", " ".join(f"w{i}" for i in range(700))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6)), "text": pa.array(texts)})
    tables = lm.Tables(np.zeros(lm.MOST_BUCKETS, dtype=np.int64))
    start = lm.fresh(tables)
    rounds = [next(lm.trained(iter([batch]), start, tables, turn)) for turn in range(lm.ROUNDS)]
    assert [set(r["weight"].to_pylist()) for r in rounds] == [{353.0}, {353.0}]
    after = np.frombuffer(b"".join(rounds[0]["payload"].to_pylist()), "<f4")
    assert len(after) == len(start) and np.abs(after - start).max() > 0


def test_averaging_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 3)
    values = [(b, p, float(p), np.full(4, 10 * b + p, "<f4").tobytes()) for b in range(2) for p in range(20)]
    got = lm.averaged(spark.createDataFrame(values, lm.UPDATE))
    mean = sum(p * p for p in range(20)) / sum(range(20))
    assert np.allclose(got, [mean] * 4 + [10 + mean] * 4)


def test_the_vocabulary_sizes_the_network():
    few, many = (lm.Tables((np.arange(lm.MOST_BUCKETS) < n).astype(np.int64)) for n in (10, 5000))
    assert few.buckets == lm.LEAST_BUCKETS and many.buckets == lm.MOST_BUCKETS and many.inner > few.inner


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 2, 0), (1, "a b", 2, 0), (None, None, 0, 1)], "doc_id long, text string, n_words int, log_likelihood int")
    got = lm.score(docs).collect()
    assert len(got) == 3 and len({r["log_likelihood"] for r in got if r["doc_id"] == 1}) == 1
