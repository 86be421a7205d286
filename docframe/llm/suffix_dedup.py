"""Exact byte-substring deduplication by a collection Burrows-Wheeler transform.

Windows of 100 bytes that may repeat meet in bounded buckets (see ``repeats``); a bucket's
strings are indexed column by column, one symbol of every string a round, and windows that
share 100 bytes are neighbours in the resulting order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.bwt import window_classes
from docframe.llm.common import documents
from docframe.llm.repeats import NO_SPANS, Rule, Symbols, between, merged, repeats
from docframe.llm.rolling import gram_hash

WINDOW = 100
GRAM = 40
#: Bytes of strings indexed at once, so that a round's arrays stay in a processor's cache.
BATCH_BYTES = 1 << 18


def byte_symbols(texts: list[bytes]) -> Symbols:
    line = b"".join(texts)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return Symbols(offsets, gram_hash(np.frombuffer(line, dtype=np.uint8), GRAM), lambda i, j: line[i:j])


def transform_windows(strings: list[bytes], minis: np.ndarray, docs: np.ndarray, starts: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """Flag windows that also start earlier: in a smaller document, or before in the same one.

    Equal windows have one minimiser, so strings are indexed by the batch, a minimiser's
    strings never apart.
    """
    flags: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(strings)
    order = np.argsort(minis, kind="stable")
    batch, size = [], 0
    for k, i in enumerate(order.tolist()):
        batch.append(i)
        size += len(strings[i])
        last = k + 1 == len(order)
        if last or (size >= BATCH_BYTES and minis[order[k + 1]] != minis[i]):
            for j, f in zip(batch, flagged([strings[x] for x in batch], docs[batch], starts[batch], rule.window)):
                flags[j] = f
            batch, size = [], 0
    return flags


def flagged(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int) -> list[np.ndarray]:
    rows, group = window_classes(strings, window)
    sizes = np.array([len(x) for x in strings], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    owner = np.searchsorted(offsets, rows, side="right") - 1
    doc, start = docs[owner], starts[owner] + rows - offsets[owner]
    order = np.lexsort((start, doc, group))
    ranked = group[order]
    head = order[np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), np.arange(len(order)), 0))]
    late = (doc[head] < doc[order]) | ((doc[head] == doc[order]) & (start[head] < start[order]))
    flags = np.zeros(offsets[-1], dtype=bool)
    flags[rows[order[late]]] = True
    return [flags[a : b - window + 1] for a, b in zip(offsets[:-1], offsets[1:])]


def keep(text: bytes, spans: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    if not len(spans):
        return len(text), NO_SPANS, text
    cut = merged(spans)
    return len(text), cut, b"".join(text[a:b] for a, b in between(cut, len(text)))


RULE = Rule(window=WINDOW, gram=GRAM, symbols=byte_symbols, within=True, kernel=transform_windows, keep=keep)


def dedup_suffixes(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Remove bytes covered by a 100-byte string that also starts earlier.

    A null text is empty; a null ``doc_id`` comes after all others; equal rows get equal
    results; an empty table gives no rows; other columns are left out, whatever their names; texts may
    be of any length that a row can hold.
    Gives ``kept_bytes`` (what is left; a cut may part a character), ``spans`` (removed bytes, as
    places from ``start`` up to ``end``) and ``row`` (the key in ``repeats.OUTPUT``), besides counts and digest.
    """
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return repeats(docs, rule).select("doc_id", "row", F.col("kept").alias("kept_bytes"), "spans", F.col("n_symbols").alias("n_bytes"),
                                      lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_collection_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
