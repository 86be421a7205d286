"""Documents scored by masked pseudo-likelihood.

A small network predicts a masked word from the words on both sides: first its class, by a
softmax over classes of about equal mass, then the word inside the class, by a walk down the
class's Huffman tree with a yes-or-no unit at every node.  Both see the context, and the
probabilities of all words sum to one.  Words are hashed into buckets, whose number follows the
vocabulary that the counts show, up to ``MOST_BUCKETS``.  Counts and training cover all documents:
each word is masked in one of the rounds; each group of documents trains its own copy for a
round, and the copies are averaged by weight.  Scoring masks every word in turn and sums the
log-probabilities.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.common import discard, documents, materialise, modest_batches, release
from docframe.llm.rolling import prefix_hash, span_hash

LEAST_BUCKETS, MOST_BUCKETS = 1 << 10, 1 << 15
#: Input symbols of the network: the frequent buckets by themselves, the others hashed together.
INPUTS = 2048
CLASSES = 64
WIDTH = 16
#: Neighbours looked at, in words from the masked one.
OFFSETS = (-2, -1, 1, 2)
#: Each word is a target in one of the rounds.
ROUNDS = 2
BATCH = 2048
#: Steps for what all words share, and for what belongs to one word or node.
RATE, OWN_RATE = 6.0 / BATCH, 0.03
PIECE_BYTES = 1 << 20
OUTSIDE = INPUTS
#: Parameters to a row that is sent for averaging, and rows averaged at once.
BLOCK, FAN = 1 << 14, 64
UPDATE = "block int, part int, weight double, payload binary"


def bucket_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of the texts, and where each text's begin."""
    split = [t.split() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    line = b" ".join(b" ".join(w) for w in split if w)
    data = np.frombuffer(line, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64), offsets
    gaps = np.flatnonzero(data == 32)
    begin, end = np.append(0, gaps + 1), np.append(gaps, len(data))
    return (span_hash(prefix_hash(data), begin, end) % np.uint64(MOST_BUCKETS)).astype(np.int64), offsets


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to a bounded amount of text, with their buckets."""
    for batch in batches:
        texts = [t if t is not None else b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        at = size = 0
        for i, t in enumerate([*texts, None]):
            if t is None or (size and size + len(t) > PIECE_BYTES):
                if i > at:
                    yield batch.slice(at, i - at), *bucket_ids(texts[at:i])
                at, size = i, 0
            size += len(t or b"")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(MOST_BUCKETS, dtype=np.int64)
    for _, ids, _ in pieces(batches):
        total += np.bincount(ids, minlength=MOST_BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


class Tables:
    """What the counts fix: buckets, classes of about equal mass, input symbols, a tree in each class.

    ``nodes[first[w] : first[w + 1]]`` are the nodes on the way to bucket ``w`` from the root of
    its class, ``signs`` the turns taken there; ``codes`` holds both.  A class of one bucket has no
    node.  A node lies at one depth only.
    """

    def __init__(self, counts: np.ndarray):
        used = max(1, int(np.count_nonzero(counts)))
        self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (4 * used - 1).bit_length()))
        counts = counts.reshape(-1, self.buckets).sum(axis=0)
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(counts[order] + 1.0)
        self.class_of = np.empty(self.buckets, dtype=np.int64)
        self.class_of[order] = np.minimum(CLASSES - 1, (mass - (counts[order] + 1.0)) * CLASSES / mass[-1]).astype(np.int64)
        self.input_of = np.empty(self.buckets, dtype=np.int16)
        head = min(INPUTS, self.buckets) // 2
        self.input_of[order[:head]] = np.arange(head)
        self.input_of[order[head:]] = head + np.arange(self.buckets - head) % (INPUTS - head)
        self.trees(counts + 1)

    def trees(self, counts: np.ndarray) -> None:
        ways: list[list[tuple[int, int]]] = [[] for _ in counts]
        self.inner = 0
        for c in range(CLASSES):
            mine = np.flatnonzero(self.class_of == c).tolist()
            heap = [(int(counts[w]), w) for w in mine]  # ties by bucket; joined nodes come after all buckets
            heapq.heapify(heap)
            below: dict[int, tuple[int, int, int]] = {}
            while len(heap) > 1:
                (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
                key = len(counts) + self.inner
                below[key] = (self.inner, a, b)
                self.inner += 1
                heapq.heappush(heap, (n + m, key))
            todo = [(heap[0][1], [])] if heap else []
            while todo:
                at, way = todo.pop()
                if at in below:
                    node, a, b = below[at]
                    todo += [(a, [*way, (node, 1)]), (b, [*way, (node, -1)])]
                else:
                    ways[at] = way
        self.first = np.concatenate([[0], np.cumsum([len(w) for w in ways])]).astype(np.int64)
        self.codes = np.array([2 * node + (sign > 0) for w in ways for node, sign in w], dtype=np.uint16)  # fewer nodes than MOST_BUCKETS

    @property
    def nodes(self) -> np.ndarray:
        return (self.codes >> 1).astype(np.int64)

    @property
    def signs(self) -> np.ndarray:
        return (self.codes & 1).astype(np.float32) * 2 - 1

    def longest_first(self, words: np.ndarray) -> np.ndarray:
        """The order of the words by the lengths of their ways."""
        length = self.first.take(words + 1) - self.first.take(words)
        return np.argsort((255 - length).astype(np.uint8), kind="stable")  # a way is shorter than 100 even for 2 ** 63 words

    def levels(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By depth, nodes and turns of the words whose ways go so deep; these lead, as ``longest_first`` has them."""
        begin = self.first.take(words)
        length = self.first.take(words + 1) - begin
        for depth, shorter in enumerate(np.cumsum(np.bincount(length))[:-1].tolist()):
            code = self.codes.take(begin[: len(words) - shorter] + depth)
            yield (code >> 1).astype(np.int64), (code & 1).astype(np.float32) * 2 - 1


def fresh(tables: Tables, seed: int = 11) -> np.ndarray:
    """Starting parameters: input embeddings by side, output weights, output biases, tree nodes."""
    rng = np.random.default_rng(seed)
    into = rng.normal(0, 0.1, (len(OFFSETS) * (INPUTS + 1), WIDTH))
    out = rng.normal(0, 0.1, (WIDTH, CLASSES))
    return np.concatenate([into.ravel(), out.ravel(), np.zeros(CLASSES + tables.inner * WIDTH)]).astype(np.float32)


def parts(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a = len(OFFSETS) * (INPUTS + 1) * WIDTH
    b = a + WIDTH * CLASSES
    c = b + CLASSES
    return flat[:a].reshape(-1, WIDTH), flat[a:b].reshape(WIDTH, CLASSES), flat[b:c], flat[c:].reshape(-1, WIDTH)


def neighbours(symbols: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the input embeddings around positions; beyond a document's ends there is ``OUTSIDE``."""
    doc = np.searchsorted(offsets, at, side="right") - 1
    low, high = offsets.take(doc), offsets.take(doc + 1)
    out = np.empty((len(OFFSETS), len(at)), dtype=np.int16)
    for k, step in enumerate(OFFSETS):
        p = at + step
        inside = (p >= low) & (p < high)
        out[k] = np.where(inside, symbols.take(p, mode="clip"), OUTSIDE) + k * (INPUTS + 1)
    return out


def forward(model, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and log-probabilities of the classes, but for a constant of each row."""
    into, out, bias, _ = model
    hidden = into.take(around[0], axis=0)  # take is several times faster here than indexing
    for k in range(1, len(OFFSETS)):
        hidden += into.take(around[k], axis=0)
    np.tanh(hidden, out=hidden)
    z = hidden @ out
    z += bias
    z -= z.max()  # one shift for all rows: hidden values are in -1 .. 1, so rows are of one magnitude
    return hidden, z


def subtract_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``np.subtract.at(table, at, rows)``, which is several times faster on a flat array, and again in pairs of numbers."""
    pairs, half = np.result_type(table, np.complex64), table.shape[1] // 2
    places = at.astype(np.int64)[:, None] * half + np.arange(half)
    np.subtract.at(table.reshape(-1).view(pairs), places.reshape(-1), rows.reshape(-1).view(pairs))


def step(model, tables: Tables, words: np.ndarray, around: np.ndarray) -> None:
    """One gradient step of a batch."""
    into, out, bias, tree = model
    order = tables.longest_first(words)
    words, around = words.take(order), around.take(order, axis=1)
    hidden, grad = forward(model, around)
    np.exp(grad, out=grad)
    grad /= grad.sum(axis=1, keepdims=True)
    grad[np.arange(len(words)), tables.class_of[words]] -= 1.0
    back = grad @ out.T
    for nodes, signs in tables.levels(words):
        here, rows = hidden[: len(nodes)], tree.take(nodes, axis=0)
        miss = -signs / (1 + np.exp(signs * np.einsum("ij,ij->i", here, rows)))
        subtract_rows(tree, nodes, here * (OWN_RATE * miss)[:, None])
        rows *= miss[:, None]
        back[: len(nodes)] += rows
    back *= OWN_RATE * (1 - hidden * hidden)
    grad *= RATE
    out -= hidden.T @ grad
    bias -= grad.sum(axis=0)
    for rows in around:
        subtract_rows(into, rows, back)


def trained(batches: Iterator[pa.RecordBatch], flat: np.ndarray, tables: Tables, turn: int) -> Iterator[pa.RecordBatch]:
    """One partition's round of gradient steps from the shared parameters, over the words whose turn it is."""
    flat = flat.copy()
    model = parts(flat)
    seen = 0
    for _, ids, offsets in pieces(batches):
        words = ids & (tables.buckets - 1)
        symbols = tables.input_of[words]
        masked = np.random.default_rng(seen).permutation(np.arange(turn, len(ids), ROUNDS))  # so that a batch mixes documents
        for at in range(0, len(masked), BATCH):
            now = masked[at : at + BATCH]
            step(model, tables, words.take(now), neighbours(symbols, offsets, now))
        seen += len(masked)
    context = TaskContext.get()
    values = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
    columns = [pa.array(range(len(values)), pa.int32()), pa.array([context.partitionId() if context else 0] * len(values), pa.int32()),
               pa.array([float(seen)] * len(values)), pa.array(values, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "weight", "payload"])
    release()


def mean(table: pa.Table) -> pa.Table:
    """One row for up to about ``FAN`` of a block: their mean by weight, and the sum of the weights."""
    weights = table["weight"].to_numpy()
    order = np.argsort(table["part"].to_numpy(), kind="stable")  # a fixed order gives fixed sums
    payloads, total = table["payload"].to_pylist(), float(weights.sum())
    out = sum(np.frombuffer(payloads[i], "<f4").astype(np.float64) * (weights[i] / total if total else 1 / len(order)) for i in order.tolist())
    return pa.table({"block": table["block"][:1], "part": pa.array([int(table["part"].to_numpy().min())], pa.int32()), "weight": pa.array([total]), "payload": pa.array([out.astype("<f4").tobytes()], pa.binary())})


def averaged(updates: DataFrame) -> np.ndarray:
    """Parameters averaged over partitions by their number of masked words, a few at a time."""
    updates = materialise(updates)
    many = updates.where("block = 0").count()
    while many > 1:
        many = -(-many // FAN)
        fewer = materialise(updates.groupBy("block", F.pmod(F.hash("part"), F.lit(many))).applyInArrow(mean, UPDATE))
        discard(updates)
        updates = fewer
        many = updates.where("block = 0").count()
    rows = sorted((r["block"], bytes(r["payload"])) for r in updates.select("block", "payload").collect())  # one copy of the parameters
    discard(updates)
    return np.frombuffer(b"".join(x for _, x in rows), "<f4").copy()


def log_probabilities(model, tables: Tables, words: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Of each word, given its neighbours."""
    order = tables.longest_first(words)
    words = words.take(order)
    hidden, classes = forward(model, around.take(order, axis=1))
    own = classes[np.arange(len(words)), tables.class_of[words]] - np.log(np.exp(classes, out=classes).sum(axis=1))
    sums = own.astype(np.float64)
    for nodes, signs in tables.levels(words):
        turns = signs * np.einsum("ij,ij->i", hidden[: len(nodes)], model[3].take(nodes, axis=0))
        sums[: len(nodes)] += np.minimum(turns, 0) - np.log1p(np.exp(-np.abs(turns)))
    out = np.empty(len(words))
    out[order] = sums
    return out


def scored(batches: Iterator[pa.RecordBatch], flat: np.ndarray, tables: Tables) -> Iterator[pa.RecordBatch]:
    model = parts(flat)
    for batch, ids, offsets in pieces(batches):
        words = ids & (tables.buckets - 1)
        symbols = tables.input_of[words]
        logp = np.zeros(len(ids))
        order = tables.longest_first(words)  # ways of much the same length go together
        for at in range(0, len(ids), 1 << 12):
            now = order[at : at + (1 << 12)]
            logp[now] = log_probabilities(model, tables, words.take(now), neighbours(symbols, offsets, now))
        total = np.concatenate([[0.0], np.cumsum(logp)])
        count = np.diff(offsets)
        sums = np.where(count > 0, total[offsets[1:]] - total[offsets[:-1]], 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(sums), pa.array(sums / np.maximum(count, 1))],
                                         names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])
    release()


def fit(docs: DataFrame) -> tuple[np.ndarray, Tables]:
    """Counts and parameters from all documents."""
    modest_batches(docs.sparkSession)
    text = docs.select("doc_id", "text")
    counts = np.zeros(MOST_BUCKETS, dtype=np.int64)
    sums = text.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most MOST_BUCKETS rows
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    tables = Tables(counts)
    flat = fresh(tables)
    for turn in range(ROUNDS):
        updates = text.mapInArrow(lambda b, f=flat, t=turn: trained(b, f, tables, t), UPDATE)
        flat = averaged(updates)
    return flat, tables


def score(docs: DataFrame) -> DataFrame:
    """Sum and mean of the conditional log-probabilities of every document's words.

    A null or empty text scores 0 over 0 words; null ids and repeated rows are scored as they
    are; ties need no rule; other columns are left out, whatever their names; texts may be of any
    length that a row can hold; an empty table gives no rows.
    """
    flat, tables = fit(docs)
    return docs.select("doc_id", "text").mapInArrow(lambda b: scored(b, flat, tables), "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
