"""The pipeline against brute force, stage by stage, on a small fixture."""

from __future__ import annotations

import shutil

import pytest
import sentencepiece

import corpus_pipeline as cp
from docframe.llm.common import materialise
from docframe.llm.tokenising import MODEL
from tests.llm import brute
from tests.llm.conftest import SCHEMA, SF, odd_documents


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Real documents with private data and benchmark passages planted, a few odd ones, repeats."""
    path = tmp_path_factory.mktemp("sf")
    shutil.copy(f"{SF}/benchmark.parquet", path / "benchmark.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    filler = real[0][1][:400]
    more = [(1000, filler + " mail a.b@c.org or +1 (743) 555-3824, " + real[5][1][:300]), (1001, real[7][1][:500] + " " + items[0] + " " + items[1]), (1002, real[8][1][:600] + " " + items[2])]
    rows = real + [(d, t, "en", "src", len(t)) for d, t in more] + [(2000 + r[0], *r[1:]) for r in odd_documents()] + [real[3], (None, real[4][1], None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    kept = materialise(cp.quality_rules(spark, docs, folder))
    before = pairs(docs)
    good = {i for i, r in enumerate(brute.op8([(i, t) for i, (_, t) in enumerate(before)])) if not r[-1]}
    assert kept.columns == columns and key(pairs(kept)) == key([x for i, x in enumerate(before) if i in good])

    alone = materialise(cp.near_duplicates(spark, kept, folder))
    before = key(pairs(kept))
    groups = {}
    for i, n, c in brute.op10([(i, t) for i, (_, t) in enumerate(before)]):
        groups.setdefault(c if n else ("empty", i), []).append(before[i])
    left = pairs(alone)
    assert alone.columns == columns and len(left) == len(groups)
    assert {min(((d is None, d) for d, _ in g)) for g in groups.values()} == {(d is None, d) for d, _ in left}

    clean = materialise(cp.decontaminate(spark, alone, folder))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = key(pairs(alone))
    bad = {r[0] for r in brute.op3(list(enumerate(t for _, t in before)), items) if r[-1]}
    assert clean.columns == columns and key(pairs(clean)) == [x for i, x in enumerate(before) if i not in bad]
    ids = {d for d, _ in pairs(clean)}
    assert 1001 not in ids and 1002 in ids

    masked = materialise(cp.mask_private(spark, clean, folder))
    assert masked.columns == columns and masked.count() == clean.count()
    out = dict(pairs(masked))
    for d, t in pairs(clean):
        expected, at = "", 0
        for start, _, kind, end in brute.base_spans(t):
            if start >= at:
                expected += t[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert d is None or out[d] == expected + t[at:]
    assert "[EMAIL]" in out[1000] and "[PHONE]" in out[1000]

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r["ids"] for r in cp.tokenise(spark, masked, folder).collect()}
    assert all(got[d] == library.encode(t) for d, t in pairs(masked))


def test_run_is_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = materialise(stage(spark, docs, folder))
    want = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in cp.run(spark, folder).collect()) == want


def test_an_empty_table_goes_through(spark, folder, empty):
    docs = empty
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
