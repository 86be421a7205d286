"""Decontamination and personal data against brute force."""

from __future__ import annotations

import random

import numpy as np

from docframe.llm import decontamination as dc
from docframe.llm.pii import detect, reliabilities
from tests.llm import brute
from tests.llm.conftest import SF, odd_documents, rows

HITS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
BASE = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
ODD = [(r[0], r[1]) for r in odd_documents()]
PRIVATE = [
    "mail bob.smith@mail.example.com, a@b.c_d@e.f. x@y @z.com a@b.cc..dd", "ip 10.0.0.1 1.2.3 1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 99999999999.1.1.1",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 4242424242424242 " + "7" * 300, "+1 (743) 555-3824 +12 +49 30 1234567-89. ++33123456789 +1 2",
    "\U0001f600\U0001f600 é+44 20 7946 0958 call (743) 555-3824 or bob (at) example (dot) com", "a" * 5000 + "@", "1." * 4000, "+" * 3000 + "1", None, "",
]


def test_contamination(spark, odd, sample_rows):
    items = [(1, "la la la la la la la la"), (2, "ONE two; three"), (3, None), (4, ""), (5, ODD[12][1][:200]), (6, ODD[12][1][50:300]), (7, "one"), (8, "aaa la la")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(dc.contamination(odd, bench), *HITS) == brute.op3(ODD, items)
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = rows(dc.contamination(spark.read.parquet(f"{SF}/documents.parquet"), real), *HITS)
    assert got == brute.op3(sample_rows, [(r["item_id"], r["text"]) for r in real.collect()])
    assert rows(dc.contamination(odd, bench.limit(0)), *HITS) == brute.op3(ODD, [])
    assert dc.contamination(odd.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta z alpha"), (3, "alpha " + "x " * 20 + "beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "Alpha beta gamma")], "item_id long, text string")
    index = dc.index_of(docs, dc.phrases_of(bench).terms)
    near = dc.proximity_matches(index, bench, dc.lengths(index), 5).join(index.where("term = ''").select("row", "doc_id"), "row")
    assert rows(near, "doc_id", "start") == [(1, 0), (2, 0)]
    got = dc.contamination(docs, bench.union(bench).union(spark.createDataFrame([(8, "alpha unknown"), (7, "x beta")], "item_id long, text string")))
    assert rows(got, "doc_id", "n_near") == [(1, 2), (2, 1), (3, 2)]


def test_base_spans(spark, odd, sample_rows):
    private = list(enumerate(PRIVATE))
    assert rows(detect(spark.createDataFrame(private, "doc_id long, text string")), *BASE) == brute.op5(private)
    assert rows(detect(odd), *BASE) == brute.op5(ODD)
    assert rows(detect(spark.read.parquet(f"{SF}/documents.parquet")), *BASE) == brute.op5(sample_rows)
    assert detect(odd.limit(0)).count() == 0


def test_added_spans_follow_the_labelers(spark):
    texts = [(i, f"words and words, phone (7{i % 10}3) 555-38{i:02d} and more") for i in range(40)] + [(100 + i, f"order no 12{i}.345.{i:04d}7 items") for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in detect(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[i].startswith("phone:23:") for i in range(40)) and not any(got[100 + i] for i in range(40))


def luhn_number(rng, start, size=16):
    d = start + "".join(rng.choice("0123456789") for _ in range(size - 1 - len(start)))
    return next(d + x for x in "0123456789" if brute.luhn(d + x))


def planted(rng):
    """A span that the fixed patterns miss, its kind, and what stands before it."""
    kind = rng.choice(["email", "ip", "card", "phone"])
    if kind == "email":
        form = rng.choice(["{}.{} (at) {} (dot) com", "{}{}[at]{}[dot]org", "{}_{} [at] {}.net"])
        return kind, form.format(*(rng.choice(["ada", "grace", "hedy", "mail", "lab"]) for _ in range(3))), rng.choice(["write to ", "e-mail: ", "see "])
    if kind == "ip":
        parts = [str(rng.randint(1, 223)), *(str(rng.randint(0, 255)) for _ in range(3))]
        return kind, rng.choice(["[.]".join(parts), "(dot)".join(parts), ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))]), rng.choice(["server ", "host: ", "from "])
    if kind == "card":
        d = luhn_number(rng, rng.choice(["4", "51", "6011"]))
        return kind, rng.choice("._/").join(d[i : i + 4] for i in range(0, 16, 4)), rng.choice(["card ", "paid by visa: ", "with "])
    return kind, rng.choice(["({}) 555-{}", "{}-555-{}", "{} 555 {}"]).format(rng.randint(200, 989), rng.randint(1000, 9999)), rng.choice(["call ", "phone: ", "at "])


def test_planted_spans_of_all_kinds_are_found(spark):
    rng = random.Random(5)
    texts, wanted = [], {}
    for i in range(400):
        kind, span, before = planted(rng)
        begin = f"Some words, {before}"
        texts.append((i, f"{begin}{span} and more."))
        wanted[i] = f"{kind}:{len(begin)}:{len(begin) + len(span)}"
    clean = ["At 12:30:45 the build 10.2 of 2021.2022 ended.", "Serial 1234.5678.9012.3456x, page 12/14/2020.", "MAC 00:1a:2b:3c:4d:5e at the gate", "Order 555.1234 of 100-200-300"]
    texts += [(1000 + i, clean[i % len(clean)]) for i in range(200)]
    got = {r["doc_id"]: r for r in detect(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for kind in ("email", "ip", "card", "phone"):
        mine = [i for i, w in wanted.items() if w.startswith(kind)]
        assert sum(wanted[i] in got[i]["spans"].split(",") for i in mine) >= 0.9 * len(mine), kind
    assert sum(got[i]["n_spans"] == 0 for i in range(1000, 1200)) >= 190


def test_many_numbers_in_one_text(spark):
    text = " ".join(f"{i % 90 + 10}" if i % 50 else "10.0.0.1 and +1 (743) 555-3824 é" for i in range(3000))
    assert rows(detect(spark.createDataFrame([(1, text)], "doc_id long, text string")), *BASE) == brute.op5([(1, text)])


def test_null_ids_clashing_columns_and_repeated_rows(spark):
    data = [(None, "mail a@b.cc", 3, 1), (None, "mail a@b.cc", 3, 1), (4, None, None, 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_email int, spans int")
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in detect(docs).collect()) == [(0, 1), (0, 1), (4, 0)]
    docs = spark.createDataFrame([(d, t, 7, 7) for d, t, *_ in data], "doc_id long, text string, term int, pos int")
    bench = spark.createDataFrame([(1, "mail a")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in dc.contamination(docs, bench).collect()) == [(0, 2), (0, 2), (4, 0)]


def plain_em(patterns, n, rounds=40):
    """Expectation-maximisation for one kind, with arrays: patterns x labelers of -1, 0, 1."""
    x, n = np.array(patterns), np.array(n, dtype=float)
    prior = 0.5
    rate = np.array([[[0.5 if v == y else 0.2 if v == -y else 0.3 for v in (-1, 0, 1)] for y in (-1, 1)]] * x.shape[1])
    for _ in range(rounds):
        like = np.stack([np.prod([rate[j, k, x[:, j] + 1] for j in range(x.shape[1])], axis=0) for k in (0, 1)])
        q = prior * like[1] / (prior * like[1] + (1 - prior) * like[0])
        prior = min(0.99, max(0.01, (1 + (n * q).sum()) / (2 + n.sum())))
        for j in range(x.shape[1]):
            for k, y in enumerate((-1, 1)):
                w = np.array([1.0 + 2.0 * (v == y) + (n * (q if y == 1 else 1 - q))[x[:, j] == v].sum() for v in (-1, 0, 1)])
                rate[j, k] = w / w.sum()
    return q


def test_expectation_maximisation_equals_a_plain_version():
    rng = np.random.default_rng(2)
    patterns = np.unique(rng.integers(-1, 2, (40, 5)), axis=0)
    n = rng.integers(1, 500, len(patterns))
    post = reliabilities([(2, tuple(p), int(c)) for p, c in zip(patterns.tolist(), n)])
    assert np.allclose([post[2, tuple(p)] for p in patterns.tolist()], plain_em(patterns, n))


def test_reliability_of_labelers_is_recovered():
    counts = [(0, (1, 1, 1, 0, 0), 900), (0, (-1, -1, -1, 0, 0), 900), (0, (1, -1, -1, 0, 0), 100), (0, (-1, 1, 1, 0, 0), 100)]
    post = reliabilities(counts)
    assert post[0, (1, 1, 1, 0, 0)] > 0.9 and post[0, (-1, 1, 1, 0, 0)] > 0.5 and post[0, (1, -1, -1, 0, 0)] < 0.5
