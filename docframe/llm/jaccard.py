"""N-gram Jaccard self-join and its components, by R-trees over count vectors.

Documents with equal shingle sets form a class and are compared once.  Two linked classes share
one of the least hashes of each set (a prefix of a quarter), so only classes listed under one
such hash can link.  Inside a list, hashed tokens fall into groups; a class's group counts are
a point, points go into an R-tree, and the summed minima of coordinates bound the overlap from
above for single points and whole nodes alike.  Pairs that survive are verified on their sets.

Lists of much the same members become one.  Links are looked for in rounds, as a pair whose ends
are already connected needs no test: first each class with many shared hashes meets the others
under its two least ones; then the nearest classes of other components are tried, and all pairs
of short lists; last, all pairs that are left in long lists.
A list longer than a block, in members or in bytes of sets, is split into bands of set size,
and a band into blocks; only blocks of one band or of neighbouring ones meet, as other sizes
cannot link.  Pairs that the bound lets through are verified where their list's sets are, so a
set travels once a list and not once a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.common import discard, documents, materialise, modest_batches, release
from docframe.llm.rolling import gram_hash, mix, prefix_hash, span_hash

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
GROUPS = 64
FANOUT = 16
PIECE_BYTES = 1 << 19
#: Members of a list that are compared in one task, and shingles of their sets.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19
#: Set sizes of a band span at most this ratio, so linked sets are in one band or in neighbours.
BAND = 1.34
#: Classes with one hash in a piece of the input that are passed on at once, not gathered.
CROWD = 64
#: Rows up to which a side of a join is sent to all executors: any table, and bare keys that pick texts.
BROADCAST_ROWS, BROADCAST_KEYS = 20_000, 500_000
NEAREST = 3
#: Rows of lists that one call handles, about; shingles of sets that one call verifies.
LIST_ROWS, CALL_SHINGLES = 4096, 1 << 20
#: Pairs that are bounded at once.
PAIRS = 1 << 18
#: Hashes of so many classes in a piece of the input are reported as common, and at most
#: ``COMMON`` of all reported ones come last in every prefix.  Any order that all share is
#: exact; this one keeps what many unrelated documents share out of the lists.
OFTEN = 4
COMMON = 1 << 16
#: Bound on the classes whose names are sent to all executors at the end.
HOT_CLASSES = 10_000


# -- shingles ---------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within a text, and where each begins."""
    split = [t.lower().split() for t in texts]  # bytes: A-Z only, and the six white-space bytes
    counts = np.array([len(w) for w in split], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    line = b" ".join(b" ".join(w) for w in split if w)
    data = np.frombuffer(line, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    gaps = np.flatnonzero(data == 32)
    words = span_hash(prefix_hash(data), np.append(0, gaps + 1), np.append(gaps, len(data)))
    owner = np.repeat(np.arange(len(texts)), counts)
    grams = gram_hash(words, SHINGLE)
    inside = owner[: len(grams)] == owner[SHINGLE - 1 :][: len(grams)]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = span_hash(prefix_hash(words), first[short], first[short + 1])
    h = np.concatenate([grams[inside], whole])
    o = np.concatenate([owner[: len(grams)][inside], short])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(texts) + 1))


def class_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key per set, equal for equal sets; empty sets get 0."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    size = np.diff(offsets).astype(np.uint64)
    return np.where(size > 0, mix(total[offsets[1:]] - total[offsets[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)), 0).astype(np.int64)


def points(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Group counts of every set, in ``GROUPS`` groups."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(owner * GROUPS + (hashes % np.uint64(GROUPS)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)


def point_of(hashes: np.ndarray) -> bytes:
    """Group counts of one set, in more groups the larger it is, a power of two of them.

    Group numbers are remainders, so halving the groups adds the two halves up.  With about
    two tokens to a group, sets that share under three quarters of their tokens mostly fall short of
    the bound.  The first byte tells the bytes of a count.
    """
    groups = GROUPS
    while groups * 2 < len(hashes) and groups < 8192:
        groups *= 2
    counts = np.bincount((hashes % np.uint64(groups)).astype(np.int64), minlength=groups)
    width = 1 if counts.max() < 256 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


class Points:
    """Group counts of many sets, each in as many groups as suits its size."""

    def __init__(self, raw: list[bytes]):
        self.groups = np.array([(len(x) - 1) // x[0] for x in raw], dtype=np.int64)
        self.values = [np.frombuffer(x, f"<u{x[0]}", offset=1) for x in raw]

    def folded(self, rows: np.ndarray, groups: int) -> np.ndarray:
        out = np.empty((len(rows), groups), dtype=np.int32)
        for k, i in enumerate(rows.tolist()):
            out[k] = self.values[i].reshape(-1, groups).sum(axis=0)
        return out

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most tokens that the sets at ``a`` and ``b`` can share, in the finest groups that both have."""
        out = np.zeros(len(a), dtype=np.int64)
        common = np.minimum(self.groups[a], self.groups[b])
        for groups in np.unique(common).tolist():
            mine = np.flatnonzero(common == groups)
            rows, where = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
            table, x, y = self.folded(rows, groups), where[: len(mine)], where[len(mine) :]
            step = max(1, (1 << 20) // groups)
            for k in range(0, len(mine), step):
                out[mine[k : k + step]] = np.minimum(table[x[k : k + step]], table[y[k : k + step]]).sum(axis=1)
        return out


def needed(size: np.ndarray) -> np.ndarray:
    """Least overlap with any linked set: ``size`` times the threshold, rounded up."""
    return -(-NUMERATOR * size // DENOMINATOR)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = [t if t is not None else b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        at = size = 0
        for i, t in enumerate([*texts, None]):
            if t is None or (size and size + len(t) > PIECE_BYTES):
                if i > at:
                    yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t or b"")


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of every document; rows with ``n`` of -1 report common hashes, in ``c``, with counts in ``row``."""
    kinds = {"doc_id": pa.int64(), "row": pa.int64(), "n": pa.int64(), "c": pa.int64(), "point": pa.binary()}
    for batch, texts in pieces(batches):
        h, offsets = shingle_sets(texts)
        c = class_keys(h, offsets)
        point = [point_of(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        first = np.unique(c, return_index=True)[1]
        once = np.concatenate([h[offsets[i] : offsets[i + 1]] for i in first]) if len(first) else h
        often, count = np.unique(once, return_counts=True)
        often, count = often[count >= OFTEN].view(np.int64), count[count >= OFTEN]
        columns = {"doc_id": batch.column("doc_id").to_pylist() + [None] * len(often), "row": batch.column("row").to_pylist() + count.tolist(), "n": np.append(np.diff(offsets), np.full(len(often), -1)),
                   "c": np.append(c, often), "point": point + [None] * len(often)}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))
    release()


# -- which classes share a prefix hash ---------------------------------------------------------


def pack(h: np.ndarray, c: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(h)).tobytes() + h.tobytes() + c.tobytes())


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    return np.frombuffer(raw[8 : 8 + 8 * n], "<u8"), np.frombuffer(raw[8 + 8 * n :], "<i8")


def postings(batches: Iterator[pa.RecordBatch], buckets: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Prefix hashes with their classes, packed by bucket of the hash; crowded hashes apart."""
    for _, texts in pieces(batches):
        h, offsets = shingle_sets(texts)
        size = np.diff(offsets)
        c = class_keys(h, offsets)
        take = np.where(size > 0, size - needed(size) + 1, 0)
        rank = np.arange(len(h)) - np.repeat(offsets[:-1], size)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((np.isin(h, common), owner))  # stable: hashes stay ascending on either side
        keep = rank < np.repeat(take, size)
        ph, pc = h[order][keep], c[owner[order][keep]]
        both = np.unique(np.stack([ph, pc.view(np.uint64)], axis=1), axis=0) if len(ph) else np.zeros((0, 2), np.uint64)
        ph, pc = both[:, 0], both[:, 1].view(np.int64)
        keys, payloads = [], []
        values, start, count = np.unique(ph, return_index=True, return_counts=True)
        crowded = np.repeat(count >= CROWD, count)
        if crowded.any():
            keys.append(-1 - int(ph[crowded][0] % np.uint64(1 << 40)))
            payloads.append(pack(ph[crowded], pc[crowded]))
            mark = start[count >= CROWD]  # the bucket still learns that the hash is shared
            rest = ~crowded
            rest[mark] = rest[mark + 1] = True
            ph, pc = ph[rest], pc[rest]
        key = (ph % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        cuts = np.append(np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])), len(order)) if len(order) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            keys.append(int(ranked[a]))
            payloads.append(pack(ph[order[a:b]], pc[order[a:b]]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], names=["key", "payload"])
    release()


def shared(table: pa.Table) -> pa.Table:
    """In a bucket: the hashes with more than one class, and those classes."""
    parts = [unpack(p) for p in table["payload"].to_pylist()]
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    both = np.unique(np.stack([h, c.view(np.uint64)], axis=1), axis=0)
    _, count = np.unique(both[:, 0], return_counts=True)
    both = both[np.repeat(count > 1, count)]
    return pa.table({"h": pa.array(both[:, 0].view(np.int64)), "c": pa.array(both[:, 1].view(np.int64))})


# -- R-tree ------------------------------------------------------------------------------------


class Tree:
    """R-tree over points, packed by size and then by the widest coordinates.

    A node keeps the upper corner of its points and their least and greatest size.
    """

    def __init__(self, point: np.ndarray, size: np.ndarray):
        wide = np.argsort(-point.var(axis=0))[:2] if len(point) > 1 else np.zeros(2, dtype=int)
        order = np.lexsort((point[:, wide[1]], point[:, wide[0]], size))
        self.levels = [(order, point[order], size[order], size[order])]
        while len(self.levels[-1][0]) > FANOUT:
            _, corner, low, high = self.levels[-1]
            at = np.arange(0, len(corner), FANOUT)
            self.levels.append((at, np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def near(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose bound allows a link, and the bounds."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            _, corner, low, high = self.levels[depth]
            low, high = low[at], high[at]
            bound = np.minimum(corner[at], point).sum(axis=1)
            # A link needs DENOMINATOR * overlap >= NUMERATOR * (sum of sizes - overlap).
            ok = ((NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (size + low)) & (DENOMINATOR * high >= NUMERATOR * size) & (NUMERATOR * low <= DENOMINATOR * size)
            at, bound = at[ok], bound[ok]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.levels[0][0][at], bound


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets reach the threshold, exactly."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def parts_of(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal keys in sorted columns."""
    if not len(keys[0]):
        return []
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.append(np.flatnonzero(new), len(new)).tolist()
    return list(zip(at[:-1], at[1:]))


def clustered(table: pa.Table) -> pa.Table:
    """Link classes inside every block of a list; edges from members to one of their component."""
    h, block, c = (table[k].to_numpy() for k in ("h", "block", "c"))
    order = np.lexsort((c, block, h))
    texts = table["hashes"].to_pylist()
    a, b = [], []
    for low, high in parts_of(h[order], block[order]):
        mine = order[low:high]
        mine = mine[np.unique(c[mine], return_index=True)[1]]
        if len(mine) < 2:
            continue
        roots = forest([np.frombuffer(texts[i], "<u8") for i in mine])
        some = roots != np.arange(len(mine))
        a.append(c[mine][some])
        b.append(c[mine][roots[some]])
    none = [np.zeros(0, np.int64)]
    return pa.table([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], schema=EDGE)


def forest(sets: list[np.ndarray]) -> np.ndarray:
    """For every set, a set that it is connected with; sets that give up stay for later rounds."""
    size = np.array([len(s) for s in sets])
    point = points(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    tree, parent = Tree(point, size), list(range(len(sets)))
    for i in range(len(sets)):
        other, bound = tree.near(point[i], int(size[i]))
        failed = 0
        for j in other[np.argsort(-bound, kind="stable")].tolist():
            if failed > FANOUT:
                break
            a, b = find(parent, i), find(parent, j)
            if a != b:
                if linked(sets[i], sets[j]):
                    parent[max(a, b)] = min(a, b)
                else:
                    failed += 1
    return np.array([find(parent, i) for i in range(len(sets))])


def near_pairs(table: pa.Table, nearest: int | None) -> pa.Table:
    """Pairs of classes in two components that meet in a cell and that the bound lets through.

    Short lists give all pairs; in others an R-tree finds them, each class's ``nearest`` or all.
    """
    cell, side, c, label, size = (table[k].to_numpy() for k in ("cell", "side", "c", "label", "n"))
    order = np.lexsort((c, side, cell))
    cell, side, c, label, size = (x[order] for x in (cell, side, c, label, size))
    raw = table["point"].to_pylist()
    points = Points([raw[k] for k in order.tolist()])
    found, waiting, held = [], [], 0

    def bounded() -> None:
        a, b = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
        waiting.clear()
        ok = (label[a] != label[b]) & (DENOMINATOR * np.minimum(size[a], size[b]) >= NUMERATOR * np.maximum(size[a], size[b]))
        a, b = a[ok], b[ok]
        ok = (NUMERATOR + DENOMINATOR) * points.bounds(a, b) >= NUMERATOR * (size[a] + size[b])
        a, b = a[ok], b[ok]
        found.append(np.stack([np.minimum(c[a], c[b]), np.maximum(c[a], c[b]), cell[a]], axis=1))

    for low, high in parts_of(cell):
        split = low + int(np.searchsorted(side[low:high], 1))
        two = split < high
        if not two and high - low <= 2 * FANOUT:
            x, y = np.triu_indices(high - low, 1)
            waiting.append((low + x, low + y))
            held += len(x)
        else:
            start = split if two else low
            coarse = points.folded(np.arange(low, high), GROUPS)
            tree = Tree(coarse[start - low :], size[start:high])
            for k in range(low, split if two else high):
                near, bound = tree.near(coarse[k - low], int(size[k]))
                near = near + start
                ok = label[near] != label[k]
                near, bound = near[ok], bound[ok]
                if nearest is not None:
                    near = near[np.argsort(-bound, kind="stable")[:nearest]]
                if len(near):
                    waiting.append((np.full(len(near), k), near))
                    held += len(near)
                if held >= PAIRS:
                    bounded()
                    held = 0
        if held >= PAIRS:
            bounded()
            held = 0
    if waiting:
        bounded()
    both = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    both = both[np.unique(both[:, :2], axis=0, return_index=True)[1]] if len(both) else both
    return pa.table([pa.array(both[:, k]) for k in range(3)], names=["a", "b", "cell"])


def settled(members: pa.Table, pairs: pa.Table) -> pa.Table:
    """The pairs that link, verified on the sets; one whose ends others connect is left out."""
    sets = dict(zip(members["c"].to_pylist(), members["hashes"].to_pylist()))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for x, y in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
        p, q = root(x), root(y)
        if p != q and linked(np.frombuffer(sets[x], "<u8"), np.frombuffer(sets[y], "<u8")):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    a, b = zip(*out) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE)


# -- flow --------------------------------------------------------------------------------------


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its rows, counted here, are few enough."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """``c, label``: the least class of each component, by least labels and pointer jumping."""
    both = materialise(edges.union(edges.select("b", "a")).distinct())
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("c"), "label"))
    while True:
        seen = both.join(labels.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels["c"] == seen["a"], "left").select("c", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("c").alias("label"), F.col("label").alias("next"))
        moved = materialise(lower.join(jump, "label", "left").select("c", F.least("label", "next").alias("label"), "was"))
        discard(labels)
        if not moved.where("label != was").take(1):
            discard(both)
            return moved.select("c", "label")
        labels = moved.select("c", "label")
        labels.scratch_path = moved.scratch_path


def sets_of(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``c, hashes`` of the wanted ``classes`` (``c, row``), from the texts that stand for them."""

    def make(batches):
        for batch, found in pieces(batches):
            h, offsets = shingle_sets(found)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([h[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["c", "hashes"])
        release()

    wanted = materialise(classes.select("c", "row").distinct())
    found = texts.select("row", "text").join(small(wanted, BROADCAST_KEYS), "row").select("c", "text").mapInArrow(make, "c long, hashes binary")
    return materialise(found.dropDuplicates(["c"]))


def cells_of(members: DataFrame) -> DataFrame:
    """``cell, side, c, n, label``: where each member of a list meets others.

    ``members`` has ``h, c, n, label`` and, of the list, ``size`` and ``volume`` (shingles).  Lists
    of one block are one cell; in others every two blocks of a band, or of a band and the next, are one.
    """
    wide = (F.col("size") > BLOCK) | (F.col("volume") > BLOCK_SHINGLES)
    narrow = members.where(~wide).select(F.xxhash64("h").alias("cell"), F.lit(0).alias("side"), "c", "n", "label")
    banded = members.where(wide).withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    bands = banded.groupBy("h", "band").agg(blocks.alias("blocks")).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    dealt = banded.join(small(materialise(bands)), "h").withColumn("own", F.pmod(F.xxhash64("c"), F.try_element_at("blocks", F.col("band"))).cast("int"))

    def met(step: int, entry) -> Column:
        others = F.coalesce(F.try_element_at("blocks", F.col("band") + step), F.lit(0))
        numbers = F.when(others > 0, F.sequence(F.lit(0), others - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, entry)

    def cell(low, one, high, other, side):
        return F.struct(F.xxhash64("h", low, one, high, other).alias("cell"), side.cast("int").alias("side"))

    band, own = F.col("band"), F.col("own")
    every = F.concat(met(0, lambda j: cell(band, F.least(own, j), band, F.greatest(own, j), own > j)),
                     met(1, lambda j: cell(band, own, band + 1, j, F.lit(0))), met(-1, lambda j: cell(band - 1, j, band, own, F.lit(1))))
    return narrow.union(dealt.select(F.explode(every).alias("at"), "c", "n", "label").select("at.cell", "at.side", "c", "n", "label"))


def closer(lists: DataFrame, kinds: DataFrame, texts: DataFrame, edges: DataFrame, nearest: int | None, least: int) -> DataFrame:
    """``edges`` and the links found between components that meet in a list of over ``least`` members."""
    labels = components(edges)
    named = materialise(lists.where(F.col("size") > least).join(small(labels), "c", "left").select("h", "c", "n", "size", F.coalesce("label", "c").alias("label")))
    open_lists = named.groupBy("h").agg(F.sum("n").alias("volume"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h", "volume")
    members = materialise(named.join(small(materialise(open_lists)), "h"))
    met = cells_of(members).join(kinds.select("c", "point"), "c")
    tasks = max(1, members.count() // LIST_ROWS)
    pairs = met.groupBy(F.pmod(F.xxhash64("cell"), F.lit(tasks)).alias("task")).applyInArrow(lambda t: release(near_pairs(t, nearest)), "a long, b long, cell long")
    pairs = materialise(pairs.groupBy("a", "b").agg(F.min("cell").alias("cell")))
    discard(named, members)
    ends = materialise(pairs.select("cell", F.col("a").alias("c")).union(pairs.select("cell", "b")).distinct().join(kinds.select("c", "n", "row"), "c"))
    calls = max(1, (ends.agg(F.sum("n")).first()[0] or 0) // CALL_SHINGLES)
    sets = sets_of(texts, ends)
    task = F.pmod(F.xxhash64("cell"), F.lit(calls)).alias("task")
    there = ends.join(sets, "c").select(task, "c", "hashes").groupBy("task")
    out = materialise(edges.union(there.cogroup(pairs.select(task, "a", "b").groupBy("task")).applyInArrow(lambda m, p: release(settled(m, p)), "a long, b long")))
    discard(pairs, ends, sets, edges)
    return out


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document ``doc_id, row, n, c``, and links between classes that connect what links."""
    modest_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    found = materialise(texts.mapInArrow(summaries, "doc_id long, row long, n long, c long, point binary"))
    facts = found.where("n >= 0")
    top = found.where("n < 0").groupBy("c").agg(F.sum("row").alias("count")).orderBy(F.desc("count"), "c").limit(COMMON).select("c").toArrow()
    common = np.sort(top["c"].to_numpy().view(np.uint64))  # at most COMMON hashes
    kinds = materialise(facts.where("n > 0").groupBy("c").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("point").alias("point")))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(8, size // (8 << 20))
    sent = texts.select("text").mapInArrow(lambda b: postings(b, buckets, common), "key long, payload binary")
    every = sent.groupBy("key").applyInArrow(lambda t: release(shared(t)), "h long, c long").distinct()
    every = materialise(every.join(small(kinds.select("c", "n")), "c"))
    # Lists of much the same members (two least hashes of them, and the size's order) become one list
    # of all their members, so that a pair is looked at once and not under each hash it shares.
    alike = every.groupBy("h").agg(F.floor(F.log2(F.count(F.lit(1)))).alias("order"), F.min(F.xxhash64("c")).alias("x"), F.min(F.xxhash64("c", F.lit(1))).alias("y"))
    owner = alike.groupBy("order", "x", "y").agg(F.min("h").alias("own"), F.collect_list("h").alias("h")).select("own", F.explode("h").alias("h"))
    lists = materialise(every.join(owner, "h").select(F.col("own").alias("h"), "c", "n").distinct())
    sizes = materialise(lists.groupBy("h").agg(F.count(F.lit(1)).alias("size")))
    lists = materialise(lists.join(small(sizes), "h"))
    # First round: classes that share a fifth of their prefix meet under their two least hashes.
    prefix = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    own = every.groupBy("c", "n").agg(F.count(F.lit(1)).alias("shared"), F.slice(F.sort_array(F.collect_list("h")), 1, 2).alias("least"))
    close = own.where(5 * F.col("shared") >= prefix).join(kinds.select("c", "row"), "c").select("c", "n", "row", F.explode("least").alias("h"))
    close = materialise(close)
    discard(every)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = close.groupBy("h").agg(blocks.alias("blocks"), F.min("c").alias("pivot"))
    dealt = close.join(small(materialise(sizes)), "h").select("h", "c", F.explode(F.when(F.col("c") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")))).alias("block"))
    sets = sets_of(texts, close)
    tasks = max(1, (close.agg(F.sum("n")).first()[0] or 0) // CALL_SHINGLES)
    met = dealt.join(sets, "c").groupBy(F.pmod(F.xxhash64("h", "block"), F.lit(tasks)).alias("task"))
    edges = materialise(met.applyInArrow(lambda t: release(clustered(t)), "a long, b long").distinct())
    discard(close, sets)
    edges = closer(lists, kinds, texts, edges, NEAREST, 1)
    edges = closer(lists, kinds, texts, edges, None, 2 * FANOUT)
    discard(lists)
    return facts, edges


def linked_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the least id reachable by links.

    ``row`` hashes ``doc_id`` and text, ``label`` tells components apart whatever their ids.

    A null or empty text has an empty set and is linked with nothing; a text of fewer than
    five words is one shingle; a null ``doc_id`` never names a component unless all of it is
    null; repeated rows link; an empty table gives no rows.
    """
    facts, edges = links(docs)
    labels = components(edges)
    least = facts.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs"))
    named = least.join(small(labels), "c", "left").select("c", "least", "docs", F.coalesce("label", "c").alias("label"))
    named = materialise(named)
    whole = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = materialise(named.join(whole, "label").select("c", "docs", "component_id", "label"))
    # A class may hold a third of all rows: the largest, at most HOT_CLASSES, are joined without a shuffle.
    hot = of_class.where(F.col("docs") > max(1, facts.count() // HOT_CLASSES)).drop("docs")
    rest = facts.join(F.broadcast(hot.select("c")), "c", "left_anti").join(of_class.drop("docs"), "c", "left")
    both = rest.unionByName(facts.join(F.broadcast(hot), "c"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row", "label")


def op10_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(documents(spark, sf_dir))
