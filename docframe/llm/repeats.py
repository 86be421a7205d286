"""Long repeats across a corpus: windows of symbols that also start earlier.

Two operators share this flow and differ in their symbols (words or bytes), their rule for
"earlier" and the exact kernel inside a bucket.

* Documents are dealt once into groups of a few MB by a hash of the row and its input partition, so
  that equal rows spread; that one exchange serves all three passes.
* Pass 1: each group sends the minimisers of its windows, once each, to hashed buckets; a
  bucket answers each group with the minimisers that occur elsewhere as well.
* Pass 2: runs of consecutive windows under such a minimiser travel as one packed string to
  the minimiser's bucket.  Of equal strings in a group only the earliest travels: the others
  are settled on the spot, so copies of one passage cost a bucket one string a group however
  many there are.  The bucket compares all windows exactly.
* A minimiser of very many runs, such as one inside a licence line, would fill its bucket: the answer
  marks it as hot, and each of its windows then travels by itself, keyed by its first and last gram.
* Pass 3: the covered ranges go back to their group and are cut out of the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import modest_batches, release
from docframe.llm.rolling import mix, super_runs

GROUP_BYTES = 4 << 20
MESSAGE = "key long, g int, payload binary"
#: ``row`` is ``xxhash64(doc_id, text)``, a null text being empty; equal rows have equal results.
OUTPUT = "doc_id long, row long, n_symbols long, spans array<struct<start: long, end: long>>, kept binary"
#: Stands for a null doc_id, after all others.
LAST = np.iinfo(np.int64).max
RUN = np.dtype([("mini", "<u8"), ("row", "<i8"), ("doc", "<i8"), ("start", "<i8"), ("g", "<i4"), ("size", "<i4")])
RANGE = np.dtype([("row", "<i8"), ("start", "<i8"), ("end", "<i8")])
NO_SPANS = np.zeros((0, 2), dtype=np.int64)


@dataclass
class Symbols:
    """Texts of a group as one array of symbols.

    ``offsets[i]`` is where text ``i`` begins, ``grams`` hashes the run of ``gram`` symbols at
    each position, ``cut(i, j)`` gives symbols ``i .. j`` as bytes that are equal exactly if
    the symbols are.
    """

    offsets: np.ndarray
    grams: np.ndarray
    cut: Callable[[int, int], bytes]


@dataclass(frozen=True)
class Rule:
    """What an operator plugs in."""

    window: int
    gram: int
    symbols: Callable[[list[bytes]], Symbols]
    #: Whether an earlier start in the same document counts.
    within: bool
    #: ``(strings, minimisers, docs, starts, rule) -> per string, flags of the windows that start earlier elsewhere``
    kernel: Callable
    #: ``(text, ranges) -> number of symbols, removed spans, text that is kept``
    keep: Callable[[bytes, np.ndarray], tuple[int, np.ndarray, bytes]]
    #: Runs under one minimiser beyond which it is hot.
    hot: int = 4_000


def pack(*parts: bytes) -> bytes:
    sizes = np.array([len(x) for x in parts], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(parts)).tobytes() + sizes + b"".join(parts))


def unpack(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    at, out = 8 + 8 * n, []
    for size in np.frombuffer(raw[8:at], "<i8"):
        out.append(raw[at : at + size])
        at += size
    return out


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    keys, groups, payloads = zip(*rows) if rows else ((), (), ())
    return pa.table({"key": pa.array(keys, pa.int64()), "g": pa.array(groups, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def read_group(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """Texts, document ids and row keys of a group, equal rows once, in a fixed order."""
    texts = table["text"].cast(pa.binary()).to_pylist()
    docs = table["doc_id"].fill_null(LAST).to_numpy()
    rows = table["row"].to_numpy()
    _, first = np.unique(rows, return_index=True)
    return [texts[i] for i in first], docs[first].astype(np.int64), rows[first].astype(np.int64), int(table["g"][0].as_py())


def runs_of(table: pa.Table, rule: Rule) -> tuple[Symbols, np.ndarray] | None:
    """Super-runs of a group's windows as ``RUN`` records; ``start`` is still group-wide."""
    if not table.num_rows:
        return None
    texts, docs, rows, g = read_group(table)
    sym = rule.symbols(texts)
    total = int(sym.offsets[-1])
    n = total - rule.window + 1
    if n <= 0:
        return None
    owner = np.repeat(np.arange(len(texts)), np.diff(sym.offsets))
    first, count, mini = super_runs(sym.grams, owner[:n] == owner[rule.window - 1 :], rule.window - rule.gram + 1)
    out = np.zeros(len(first), dtype=RUN)
    out["mini"], out["start"], out["size"], out["g"] = mini, first, count + rule.window - 1, g
    out["row"], out["doc"] = rows[owner[first]], docs[owner[first]]
    return sym, out


def offered(table: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    """Pass 1, in a group: its distinct minimisers with least and greatest doc and how many runs."""
    got = runs_of(table, rule)
    if got is None:
        return messages([])
    runs = got[1]
    order = np.lexsort((runs["doc"], runs["mini"]))
    mini, doc = runs["mini"][order], runs["doc"][order]
    first = np.flatnonzero(np.append(True, mini[1:] != mini[:-1]))
    last = np.append(first[1:], len(mini)) - 1
    lo, hi, many = doc[first], doc[last], last - first + 1
    mini = mini[first]
    key = (mini % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(order))
    g = int(runs["g"][0])
    return messages([(int(key[order[a]]), g, pack(*(x[order[a:b]].tobytes() for x in (mini, lo, hi, many)))) for a, b in zip(cuts[:-1], cuts[1:])])


def answered(table: pa.Table, rule: Rule) -> pa.Table:
    """Pass 1, in a bucket: to each group its minimisers that occur elsewhere too."""
    groups = table["g"].to_pylist()
    parts = [[np.frombuffer(x, kind) for x, kind in zip(unpack(p), ("<u8", "<i8", "<i8", "<i8"))] for p in table["payload"].to_pylist()]
    mini = np.concatenate([p[0] for p in parts])
    lo, hi, many = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    values, inverse = np.unique(mini, return_inverse=True)
    least, most = np.full(len(values), LAST), np.full(len(values), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, lo)
    np.maximum.at(most, inverse, hi)
    shared = least < most
    runs = np.bincount(inverse, weights=many, minlength=len(values))
    if rule.within:
        shared |= runs > 1
    keep, hot, out, at = shared[inverse], (runs > rule.hot)[inverse], [], 0
    for g, p in zip(groups, parts):
        here = slice(at, at + len(p[0]))
        at += len(p[0])
        if keep[here].any():
            out.append((0, g, pack(p[0][keep[here]].tobytes(), p[0][keep[here] & hot[here]].tobytes())))
    return messages(out)


def single(sym: Symbols, runs: np.ndarray, rule: Rule) -> np.ndarray:
    """Runs as windows of their own, each keyed by the minimiser and the grams at its two ends."""
    count = runs["size"] - rule.window + 1
    out = np.repeat(runs, count)
    out["start"] += np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    out["size"] = rule.window
    first, last = sym.grams[out["start"]], sym.grams[out["start"] + rule.window - rule.gram]
    out["mini"] = mix(out["mini"] + mix(first) * np.uint64(3) + mix(last) * np.uint64(5))
    return out


def shipped(table: pa.Table, answers: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    """Pass 2, in a group: strings under shared minimisers, equal ones once; the rest as ranges."""
    got = runs_of(table, rule) if answers.num_rows else None
    if got is None:
        return messages([])
    sym, runs = got
    wanted, hot = (np.concatenate([np.frombuffer(p[k], "<u8") for p in map(unpack, answers["payload"].to_pylist())]) for k in (0, 1))
    runs = runs[np.isin(runs["mini"], wanted)]
    if len(hot):
        apart = np.isin(runs["mini"], hot)
        runs = np.concatenate([runs[~apart], single(sym, runs[apart], rule)])
    local = runs["start"] - sym.offsets[np.searchsorted(sym.offsets, runs["start"], side="right") - 1]
    order = np.lexsort((local, runs["doc"]))
    runs, local = runs[order], local[order]
    begin, end = runs["start"].copy(), runs["start"] + runs["size"]
    seen: dict[bytes, int] = {}
    twin, same = np.arange(len(runs)), alike(runs["mini"], runs["size"])
    for at in range(0, len(same), 1 << 16):
        some = same[at : at + (1 << 16)]
        texts = map(sym.cut, begin[some].tolist(), end[some].tolist())
        twin[some] = [seen.setdefault(text, i) for text, i in zip(texts, some.tolist())]
    # Of a tie neither is earlier: both are sent to be judged.
    settled = runs["doc"][twin] < runs["doc"]
    if rule.within:
        settled |= local[twin] < local
    g = int(runs["g"][0]) if len(runs) else 0
    runs["start"] = local
    out = []
    if settled.any():
        done = np.zeros(int(settled.sum()), dtype=RANGE)
        done["row"], done["start"] = runs["row"][settled], runs["start"][settled]
        done["end"] = done["start"] + runs["size"][settled]
        out.append((-1 - g, g, pack(done.tobytes())))
    send = np.flatnonzero(~settled)
    key = (runs["mini"][send] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, send = key[order], send[order]
    # There is a message to a bucket, so what a message costs must not grow with the group.
    runs, strings = runs[send], list(map(sym.cut, begin[send].tolist(), end[send].tolist()))
    lengths = np.array([len(x) for x in strings], dtype="<i8")
    cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)).tolist() if len(key) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        out.append((int(key[a]), g, pack(runs[a:b].tobytes(), lengths[a:b].tobytes(), b"".join(strings[a:b]))))
    return messages(out)


def alike(minis: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which runs share minimiser and size with another one, in order; no others can be equal strings."""
    order = np.lexsort((sizes, minis))
    same = (minis[order][1:] == minis[order][:-1]) & (sizes[order][1:] == sizes[order][:-1])
    return np.sort(order[np.append(same, False) | np.append(False, same)])


def covered(flags: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Symbol ranges covered by the flagged windows, merged."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.append(0, new + 1)].tolist(), (at[np.append(new, len(at) - 1)] + window).tolist()))


def compared(table: pa.Table, rule: Rule) -> pa.Table:
    """Pass 2, in a bucket: ranges covered by windows that also start earlier, by group."""
    if table["key"][0].as_py() < 0:
        return table
    runs, strings = [], []
    for p in table["payload"].to_pylist():
        head, lengths, text = unpack(p)
        runs.append(np.frombuffer(head, RUN))
        at = 0
        for size in np.frombuffer(lengths, "<i8").tolist():
            strings.append(text[at : at + size])
            at += size
    runs = np.concatenate(runs)
    order = np.lexsort((runs["start"], runs["doc"]))
    runs = runs[order]
    first: dict[bytes, int] = {}
    which = np.array([first.setdefault(strings[i], len(first)) for i in order.tolist()], dtype=np.int64)
    lead = np.unique(which, return_index=True)[1]  # each string's earliest run
    distinct = list(first)
    # A minimiser with one string has nothing to compare it with.
    minis, inverse = np.unique(runs["mini"][lead], return_inverse=True)
    busy = np.flatnonzero(np.bincount(inverse, minlength=len(minis))[inverse] > 1)
    flags = rule.kernel([distinct[i] for i in busy.tolist()], runs["mini"][lead[busy]], runs["doc"][lead[busy]], runs["start"][lead[busy]], rule) if len(busy) else []
    head = lead[which]
    late = runs["doc"][head] < runs["doc"]
    if rule.within:
        late |= (runs["doc"][head] == runs["doc"]) & (runs["start"][head] < runs["start"])
    whole = np.flatnonzero(late)
    found = [np.column_stack([whole, np.zeros(len(whole), dtype=np.int64), runs["size"][whole]])]
    rest = np.flatnonzero(~late)
    rest = rest[np.argsort(which[rest], kind="stable")]
    ranked = which[rest]
    for w, f in zip(busy.tolist(), flags):
        if f.any():
            parts = np.array(covered(f, rule.window), dtype=np.int64)
            mine = rest[np.searchsorted(ranked, w) : np.searchsorted(ranked, w, side="right")]
            found.append(np.column_stack([np.repeat(mine, len(parts)), np.tile(parts, (len(mine), 1))]))
    found = np.concatenate(found)
    found = found[np.argsort(runs["g"][found[:, 0]], kind="stable")]
    owner = runs[found[:, 0]]
    ranges = np.zeros(len(found), dtype=RANGE)
    ranges["row"], ranges["start"], ranges["end"] = owner["row"], owner["start"] + found[:, 1], owner["start"] + found[:, 2]
    cuts = np.append(np.flatnonzero(np.append(True, owner["g"][1:] != owner["g"][:-1])), len(owner)).tolist() if len(owner) else [0]
    return messages([(0, int(owner["g"][a]), pack(ranges[a:b].tobytes())) for a, b in zip(cuts[:-1], cuts[1:])])


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans as rows of start and end, in order, those that meet or overlap made one."""
    spans = spans[np.argsort(spans["start"], kind="stable")]
    end = np.maximum.accumulate(spans["end"])
    first = np.flatnonzero(np.append(True, spans["start"][1:] > end[:-1]))
    return np.column_stack([spans["start"][first], end[np.append(first[1:] - 1, len(spans) - 1)]])


def between(spans: np.ndarray, n: int) -> list[tuple[int, int]]:
    """What merged spans leave of ``0 .. n``."""
    return list(zip([0, *spans[:, 1].tolist()], [*spans[:, 0].tolist(), n]))


def removed(table: pa.Table, answers: pa.Table, rule: Rule) -> pa.Table:
    """Pass 3, in a group: the texts without the covered ranges, and the ranges."""
    texts = table["text"].cast(pa.binary()).to_pylist()
    ranges = [np.frombuffer(unpack(p)[0], RANGE) for p in answers["payload"].to_pylist()]
    spans = np.concatenate(ranges) if ranges else np.zeros(0, dtype=RANGE)
    spans = spans[np.argsort(spans["row"], kind="stable")]
    rows = table["row"].to_numpy()
    a, b = np.searchsorted(spans["row"], rows), np.searchsorted(spans["row"], rows, side="right")
    done = [rule.keep(t, spans[i:j]) for t, i, j in zip(texts, a.tolist(), b.tolist())]
    offsets = np.concatenate([[0], np.cumsum([len(x[1]) for x in done])]).astype(np.int32)
    cut = np.concatenate([NO_SPANS, *(x[1] for x in done)])
    structs = pa.StructArray.from_arrays([pa.array(cut[:, 0]), pa.array(cut[:, 1])], names=["start", "end"])
    return pa.table({"doc_id": table["doc_id"], "row": table["row"], "n_symbols": pa.array([x[0] for x in done], pa.int64()),
                     "spans": pa.ListArray.from_arrays(pa.array(offsets), structs), "kept": pa.array([x[2] for x in done], pa.binary())})


def repeats(docs: DataFrame, rule: Rule) -> DataFrame:
    """Run the three passes over ``doc_id`` and ``text`` of ``docs``; the result is as ``OUTPUT`` says."""
    spark = docs.sparkSession
    modest_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    buckets = max(4, groups // 2)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.xxhash64("doc_id", text)
    dealt = docs.select("doc_id", text.alias("text"), row.alias("row"), F.pmod(F.hash(row, F.spark_partition_id()), F.lit(groups)).cast("int").alias("g")).repartition(parts, "g")
    asked = dealt.groupBy("g").applyInArrow(lambda t: release(offered(t, rule, buckets)), MESSAGE)
    shared = asked.groupBy("key").applyInArrow(lambda t: release(answered(t, rule)), MESSAGE)
    sent = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(lambda t, a: release(shipped(t, a, rule, buckets)), MESSAGE)
    found = sent.groupBy("key").applyInArrow(lambda t: release(compared(t, rule)), MESSAGE)
    return dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(lambda t, a: release(removed(t, a, rule)), OUTPUT)
