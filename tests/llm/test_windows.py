"""Substring deduplication by words and by bytes against brute force."""

from __future__ import annotations

import random
import time
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from docframe.llm import bwt, repeats, rolling, sharding, substring_dedup, suffix_dedup
from docframe.llm.quality import judge
from docframe.llm.sharding import grid, shard, write_shards
from docframe.llm.substring_dedup import dedup_substrings
from docframe.llm.suffix_dedup import dedup_suffixes
from tests.llm import brute
from tests.llm.conftest import SF, odd_documents, rows

ODD = [(r[0], r[1]) for r in odd_documents()]
CASES = [
    (dedup_substrings, brute.op2, ("doc_id", "n_words", "n_removed", "kept_sha256")),
    (dedup_suffixes, brute.op6, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
    (judge, brute.op8, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
    (shard, brute.op9, ("doc_id", "size", "text_crc32")),
]


@pytest.mark.parametrize("operator, plain, columns", CASES)
def test_odd_documents(odd, operator, plain, columns):
    assert rows(operator(odd), *columns) == plain(ODD)


@pytest.mark.parametrize("operator, plain, columns", CASES)
def test_real_documents(spark, sample_rows, operator, plain, columns):
    assert rows(operator(spark.read.parquet(f"{SF}/documents.parquet")), *columns) == plain(sample_rows)


@pytest.mark.parametrize("operator, plain, columns", CASES)
def test_empty_table(empty, operator, plain, columns):
    assert rows(operator(empty), *columns) == []


@pytest.mark.parametrize("operator, plain, columns", CASES)
def test_null_ids_repeated_rows_and_clashing_columns(spark, operator, plain, columns):
    data = [(None, "a b c", "en", "s", 5, 1, 1), (None, "a b c", "en", None, 5, 1, 1), (1, None, None, None, None, 2, 2), (1, None, None, None, None, 2, 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, g int, row long")
    assert operator(df).count() == 4


def test_texts_and_spans_are_given(odd):
    texts = {d: t or "" for d, t in ODD}
    parts = lambda s, spans: [x for i, x in enumerate(s) if not any(p["start"] <= i < p["end"] for p in spans)]
    by_words, by_bytes = dedup_substrings(odd).collect(), dedup_suffixes(odd).collect()
    assert any(r["spans"] for r in by_words) and any(r["spans"] for r in by_bytes)
    for r in by_words:
        assert r["kept_text"] == " ".join(parts(brute.words(texts[r["doc_id"]]), r["spans"])) and brute.sha(r["kept_text"]) == r["kept_sha256"]
    for r in by_bytes:
        assert bytes(r["kept_bytes"]) == bytes(parts(texts[r["doc_id"]].encode(), r["spans"])) and brute.sha(bytes(r["kept_bytes"])) == r["kept_sha256"]
    keyed = odd.selectExpr("doc_id", "xxhash64(doc_id, coalesce(text, '')) AS row")
    assert keyed.join(dedup_substrings(odd), ["doc_id", "row"]).count() == keyed.join(dedup_suffixes(odd), ["doc_id", "row"]).count() == len(ODD)


@pytest.mark.parametrize("hot", [0, 40])
def test_hot_minimisers_and_repeated_rows(spark, odd, hot):
    rng = random.Random(6)
    line = " ".join(f"licence{i}" for i in range(70))
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))
    docs = [(i, f"{prose(rng.randint(0, 30))} {line} {prose(rng.randint(0, 60))}") for i in range(150)] + ODD
    docs += [(docs[5][0], docs[5][1])] * 60
    df = spark.createDataFrame([(1000 + i if k >= 150 else i, t) for k, (i, t) in enumerate(docs)], "doc_id long, text string").repartition(7)
    held = [tuple(r) for r in df.collect()]
    assert rows(dedup_substrings(df, replace(substring_dedup.RULE, hot=hot)), *CASES[0][2]) == brute.op2(held)
    assert rows(dedup_suffixes(df, replace(suffix_dedup.RULE, hot=hot)), *CASES[1][2]) == brute.op6(held)


def test_a_message_costs_the_same_in_a_large_corpus():
    """A group sends to as many buckets as the corpus asks for; over 768 at 6 GB of texts."""
    rng = np.random.default_rng(4)
    texts = pa.array([bytes(rng.integers(97, 123, 20_000, dtype=np.uint8)).decode() for _ in range(75)])
    ids = pa.array(range(75), pa.int64())
    group = pa.table({"doc_id": ids, "text": texts, "row": ids, "g": pa.array([0] * 75, pa.int32())})
    rule = suffix_dedup.RULE
    minis = np.unique(repeats.runs_of(group, rule)[1]["mini"])
    answer = repeats.messages([(0, 0, repeats.pack(minis.tobytes(), b""))])

    def sent(buckets):
        began = time.process_time()
        out = repeats.shipped(group, answer, rule, buckets)
        took = time.process_time() - began
        runs = np.concatenate([np.frombuffer(repeats.unpack(p)[0], repeats.RUN) for p in out["payload"].to_pylist()])
        return took, out.num_rows, np.sort(runs, order=["row", "start"])

    (few_s, few, a), (many_s, many, b) = sent(4), sent(3000)
    assert (few, many) == (4, 3000) and (a == b).all() and len(a) > 40_000
    assert many_s < 4 * few_s + 1


def test_minimiser_runs_partition_the_windows():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    valid = np.ones(500 - 42, dtype=bool)
    valid[200:230] = False
    first, count, mini = rolling.super_runs(grams, valid, 43)
    assert sorted(i for a, n in zip(first, count) for i in range(a, a + n)) == np.flatnonzero(valid).tolist()
    assert (count <= 43).all()


def test_column_wise_transform_orders_all_suffixes():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randint(1, 30))) for _ in range(20)]
    lengths = np.array([len(s) for s in strings])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    cat = b"".join(strings)
    _, order = bwt.collection_order(np.frombuffer(cat, np.uint8), starts, lengths)
    ends = np.repeat(starts + lengths, lengths)
    suffixes = [cat[i : ends[i]] for i in order[len(strings) :]]
    assert suffixes == sorted(suffixes) and len(suffixes) == len(cat)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 41, 97, 1000, 10_007, 123_456_789, 10**12])
def test_grid_is_tight(n):
    a, b = grid(n)
    assert n <= a * b <= n + 7


def test_shards_are_even_and_slots_gapless(spark):
    got = shard(spark.read.parquet(f"{SF}/documents.parquet"), 7).toPandas()
    assert got.shard.value_counts().max() - got.shard.value_counts().min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    again = shard(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), 7).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_shards_hold_whole_rows(spark, tmp_path):
    data = [(None, "a", "x"), (None, "a", None), (None, "a", None), (1, "b", "y"), (1, "b", "z"), (2, None, "w")]
    df = spark.createDataFrame(data, "doc_id long, text string, shard string")
    write_shards(df, str(tmp_path / "out"), 2)
    placed = {}
    for k in (0, 1):
        got = spark.read.parquet(str(tmp_path / "out" / f"shard={k}")).collect()
        assert [r["slot"] for r in got] == list(range(3))
        placed[k] = [tuple(r["document"]) for r in got]
    assert sorted(placed[0] + placed[1], key=str) == sorted(data, key=str)


def test_a_failing_host_loses_its_documents(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "good") for i in range(50)]
    bad = [(100 + i, "short text", "bad") for i in range(49)] + [(149, " ".join(f"v{j}" for j in range(40)), "bad")]
    got = {r["doc_id"]: r["kept"] for r in judge(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(50)) and not any(got[100 + i] for i in range(50))


def test_a_row_of_many_copies_is_dealt_in_stretches(spark, monkeypatch):
    documents = [(1, "a"), (None, None), (2, "b c")] + [(7, "hot")] * 53
    df = spark.createDataFrame(documents, "doc_id long, text string")
    columns = ("doc_id", "size", "text_crc32", "shard", "slot", "row_number")
    want = sorted(map(str, shard(df, 5).select(*columns).collect()))
    monkeypatch.setattr(sharding, "STRETCH", 10)
    assert sorted(map(str, shard(df, 5).select(*columns).collect())) == want and len(want) == 56


def test_places_follow_a_plain_permutation(spark):
    """Shard and slot of every row against a Feistel network written out in Python."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(211)], "doc_id long, text string")
    got = shard(df, 7).select("row_number", "shard", "slot").collect()
    assert sorted(r["row_number"] for r in got) == list(range(211))
    places = [r["slot"] * 7 + r["shard"] for r in got]
    assert sorted(places) == list(range(211))
    for r in got:
        assert r["slot"] * 7 + r["shard"] == brute.feistel(r["row_number"], 211, 0)


def test_only_hot_hosts_are_copied(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(25)) if i % 5 else "short", "hot" if i % 3 else f"h{i}") for i in range(1500)]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    counts = {}
    for i, _, host in rows:
        n, bad = counts.get(host, (0, 0))
        counts[host] = (n + 1, bad + (i % 5 == 0))
    assert len(got) == 1500 and all((r["host_docs"], r["host_failures"]) == counts[rows[r["doc_id"]][2]] for r in got)
