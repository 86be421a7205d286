"""Exact substring deduplication over windows of words, by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's
bucket, where the windows are sorted and counted exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.common import documents
from docframe.llm.repeats import NO_SPANS, Rule, Symbols, between, merged, repeats
from docframe.llm.rolling import gram_hash, prefix_hash, span_hash

WINDOW = 50
GRAM = 8
SPACE = 32


def word_symbols(texts: list[bytes]) -> Symbols:
    """Words of texts; ``bytes.split`` parts at exactly the six white-space bytes."""
    split = [t.split() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    line = b" ".join(b" ".join(w) for w in split if w)
    data = np.frombuffer(line, dtype=np.uint8)
    gaps = np.flatnonzero(data == SPACE)
    begin = np.append(0, gaps + 1) if len(data) else np.zeros(0, dtype=np.int64)
    end = np.append(gaps, len(data)) if len(data) else begin
    words = span_hash(prefix_hash(data), begin, end)
    return Symbols(offsets, gram_hash(words, GRAM), lambda i, j: line[begin[i] : end[j - 1]])


def sorted_windows(strings: list[bytes], minis: np.ndarray, docs: np.ndarray, starts: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """Sort the windows of each minimiser; flag those that a document with a smaller id has too."""
    flags: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(strings)
    order = np.argsort(minis, kind="stable")
    cuts = np.flatnonzero(np.append(True, minis[order][1:] != minis[order][:-1])).tolist()
    for low, high in zip(cuts, [*cuts[1:], len(order)]):
        table = []
        for s in order[low:high].tolist():
            text, doc = strings[s], int(docs[s])
            gaps = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == SPACE)
            begin, end = np.append(0, gaps + 1).tolist(), np.append(gaps, len(text)).tolist()
            n = len(begin) - rule.window + 1
            table += [(text[begin[i] : end[i + rule.window - 1]], doc, s, i) for i in range(n)]
            flags[s] = np.zeros(n, dtype=bool)
        table.sort()
        last, least = None, 0
        for text, doc, s, i in table:
            if text != last:
                last, least = text, doc
            elif doc > least:
                flags[s][i] = True
    return flags


def keep(text: bytes, spans: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    words = text.split()
    if not len(spans):
        return len(words), NO_SPANS, b" ".join(words)
    cut = merged(spans)
    return len(words), cut, b" ".join(w for a, b in between(cut, len(words)) for w in words[a:b])


RULE = Rule(window=WINDOW, gram=GRAM, symbols=word_symbols, within=False, kernel=sorted_windows, keep=keep)


def dedup_substrings(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Remove words covered by a 50-word window that starts in a document with a smaller id.

    A null text has no words; a null ``doc_id`` comes after all others; rows with one
    ``doc_id`` never remove from each other; an empty table gives no rows; other columns are left
    out, whatever their names; texts may be of any length that a row can hold.
    Gives ``kept_text`` (the other words, one space between them), ``spans`` (removed words, as
    numbers from ``start`` up to ``end``) and ``row`` (the key in ``repeats.OUTPUT``), besides counts and digest.
    """
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return repeats(docs, rule).select("doc_id", "row", F.col("kept").cast("string").alias("kept_text"), "spans",
                                      F.col("n_symbols").alias("n_words"), lost.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
