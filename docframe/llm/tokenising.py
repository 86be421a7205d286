"""SentencePiece encoding and decoding by a max-plus parallel scan.

A giant text is split into chunks.  Each chunk yields a matrix from the states at its first
boundary to those at its last (see ``pieces``); the matrices of a text are combined with an
associative product in a tree, whose way down fixes the state at every boundary, and each chunk
is then traced back on its own.  A text of one chunk needs no boundary.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.common import documents, materialise, modest_batches, release
from docframe.llm.pieces import MARK, MEMORY, NEVER, Vocabulary, times

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters to a chunk, and so the longest text that is encoded in one go.
CHUNK = 32_768
#: Characters of context on either side of a chunk; no piece is longer.
MARGIN = 64
BATCH_BYTES = 1 << 20
#: Nodes that one product combines.
FAN = 64


@functools.lru_cache(maxsize=1)
def vocabulary(model: bytes, memory: int = MEMORY) -> Vocabulary:
    """The model's vocabulary, which remembers about ``memory`` bytes of words in a generation, and pairs in proportion."""
    return Vocabulary(model, memory=memory, many=memory // 100)


def lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"), pa.int32()))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds a bounded amount of text (or one row)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        at = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > BATCH_BYTES:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if batch.num_rows:
            yield batch.slice(at)


def whole_texts(batches: Iterator[pa.RecordBatch], model: bytes, back: bool, memory: int) -> Iterator[pa.RecordBatch]:
    """Encode texts of one chunk; with ``back``, decode the numbers in the same pass."""
    v = vocabulary(model, memory)
    for batch in slices(batches, "text"):
        done = [v.encode(t) for t in batch.column("text").to_pylist()]
        columns = {"doc_key": batch.column("doc_key"), "ids": lists(done)}
        if back:
            columns["decoded"] = pa.array([v.decode(np.frombuffer(x, "<i4")).decode("utf-8", "replace") for x in done], pa.string())
        yield pa.RecordBatch.from_pydict(columns)
    release()


def matrices(batches: Iterator[pa.RecordBatch], model: bytes, memory: int) -> Iterator[pa.RecordBatch]:
    """Per chunk of a giant text: its states at both ends and its matrix."""
    v = vocabulary(model, memory)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            m = v.transfer(r["text"], r["begin"], r["end"])
            out.append({"doc_key": r["doc_key"], "chunk": r["chunk"], "rows": m.shape[0], "matrix": (m == 0.0).astype(np.uint8).tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=NODE)


NODE = pa.schema([("doc_key", pa.binary()), ("chunk", pa.int32()), ("rows", pa.int32()), ("matrix", pa.binary())])
ENDS = pa.schema([("doc_key", pa.binary()), ("chunk", pa.int32()), ("enter", pa.int32()), ("leave", pa.int32())])


def weights(row: dict) -> np.ndarray:
    return np.where(np.frombuffer(row["matrix"], np.uint8).reshape(row["rows"], -1) == 1, 0.0, NEVER)


def combined(table: pa.Table, fan: int) -> pa.Table:
    """One node for up to ``fan`` consecutive ones: the product of their matrices."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    m = functools.reduce(times, map(weights, rows))
    return pa.Table.from_pylist([{"doc_key": rows[0]["doc_key"], "chunk": rows[0]["chunk"] // fan, "rows": m.shape[0], "matrix": (m == 0.0).astype(np.uint8).tobytes()}], schema=NODE)


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the node of a whole text: it is entered at the start and left by the last piece of the best path."""
    for batch in batches:
        out = [{"doc_key": r["doc_key"], "chunk": r["chunk"], "enter": 0, "leave": reached(weights(r)[0])} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(out, schema=ENDS)


def reached(weight: np.ndarray) -> int:
    to = int(np.argmax(weight))
    if weight[to] == NEVER:
        raise ValueError("no path through a chunk")
    return to


def parted(table: pa.Table, above: pa.Table) -> pa.Table:
    """The states at both ends of each node, from those of the node that combines them.

    Products from the right say which states can still reach the end; going forward, the one
    state that is reachable and can finish is taken.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    ms = list(map(weights, rows))
    last = np.full((ms[-1].shape[1], 1), NEVER)
    last[above["leave"][0].as_py()] = 0.0
    rest = [last]
    for m in reversed(ms[1:]):
        rest.append(times(m, rest[-1]))
    state, out = above["enter"][0].as_py(), []
    for r, m, after in zip(rows, ms, rest[::-1]):
        to = reached(m[state] + after[:, 0])
        out.append({"doc_key": r["doc_key"], "chunk": r["chunk"], "enter": state, "leave": to})
        state = to
    return pa.Table.from_pylist(out, schema=ENDS)


def traced(batches: Iterator[pa.RecordBatch], model: bytes, memory: int) -> Iterator[pa.RecordBatch]:
    v = vocabulary(model, memory)
    for batch in batches:
        rows = batch.to_pylist()
        done = []
        for r in rows:
            enter = v.states(r["text"], r["begin"])[r["enter"]] if r["begin"] else (0, 0)
            done.append(v.backtrace(r["text"], r["begin"], r["end"], enter, v.states(r["text"], r["end"])[r["leave"]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_key"), batch.column("chunk"), lists(done)], names=["doc_key", "chunk", "ids"])
    release()


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def split_by_length(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk, and giant ones; a null text is empty."""
    if chunk <= 2 * MARGIN:
        raise ValueError(f"chunk must exceed {2 * MARGIN} characters")
    texts = docs.select("doc_key", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.where(F.length("text") <= chunk), texts.where(F.length("text") > chunk)


def encode(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK, memory: int = MEMORY) -> DataFrame:
    """``doc_key, ids``: the model's piece numbers of every text.

    ``docs`` has ``doc_key`` (binary) and ``text``.  A null or empty text has no pieces; keys
    of giant texts must differ.
    """
    short, giant = split_by_length(docs, chunk)
    model = read_model(model_path)
    return short.mapInArrow(lambda b: whole_texts(b, model, False, memory), "doc_key binary, ids array<int>").union(encode_giant(giant, model, chunk, memory))


def encode_giant(giant: DataFrame, model: bytes, chunk: int, memory: int) -> DataFrame:
    """The parallel scan: chunks, their matrices, a tree of products up and down, the traces.

    The giant texts are written first, as their keys must not change if a task runs again.
    """
    marked = F.concat(F.lit(MARK), F.replace("text", F.lit(" "), F.lit(MARK)))
    giant = materialise(giant.select("doc_key", marked.alias("text")))
    size = F.length("text")
    longest = giant.agg(F.max(size)).first()[0] or 0
    parts = giant.select("doc_key", "text", size.alias("size"), F.explode(F.sequence(F.lit(0), ((size - MARGIN) / chunk).cast("int"))).alias("chunk"))
    last = ((F.col("size") - MARGIN) / chunk).cast("int")
    begin = F.col("chunk") * chunk
    end = F.when(F.col("chunk") == last, F.col("size")).otherwise(begin + chunk)
    left = F.greatest(F.lit(0), begin - MARGIN)
    parts = parts.select("doc_key", "chunk", F.substring("text", left + 1, end + MARGIN - left).alias("text"), (begin - left).cast("int").alias("begin"), (end - left).cast("int").alias("end"))
    parts = parts.repartition(int(giant.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_key", "chunk")
    found = parts.mapInArrow(lambda b: matrices(b, model, memory), "doc_key binary, chunk int, rows int, matrix binary")
    levels, nodes, fan = [materialise(found)], -(-longest // chunk), FAN
    group = F.floor(F.col("chunk") / fan).cast("int").alias("group")
    while nodes > 1:
        levels.append(levels[-1].groupBy("doc_key", group).applyInArrow(lambda t: combined(t, fan), "doc_key binary, chunk int, rows int, matrix binary"))
        nodes = -(-nodes // fan)
    fixed = levels.pop().mapInArrow(ended, "doc_key binary, chunk int, enter int, leave int")
    while levels:
        below = levels.pop().groupBy("doc_key", group)
        fixed = below.cogroup(fixed.groupBy("doc_key", F.col("chunk").alias("group"))).applyInArrow(parted, "doc_key binary, chunk int, enter int, leave int")
    pieces = parts.join(fixed, ["doc_key", "chunk"]).select("doc_key", "chunk", "text", "begin", "end", "enter", "leave").mapInArrow(lambda b: traced(b, model, memory), "doc_key binary, chunk int, ids array<int>")
    joined = pieces.groupBy("doc_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    return joined


def decoded(batches: Iterator[pa.RecordBatch], model: bytes, memory: int) -> Iterator[pa.RecordBatch]:
    v = vocabulary(model, memory)
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        texts = [v.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_key"), ids, pa.array(texts, pa.string())], names=["doc_key", "ids", "decoded"])


def decode(encoded: DataFrame, model_path: str = MODEL, memory: int = MEMORY) -> DataFrame:
    """Add ``decoded``, the text of every row's ``ids``."""
    model = read_model(model_path)
    return encoded.mapInArrow(lambda b: decoded(b, model, memory), "doc_key binary, ids array<int>, decoded string")


def with_tokens(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK, memory: int = MEMORY) -> DataFrame:
    """Encode and decode documents: ``doc_id, n_tokens, ids, decoded_sha256``.

    Null texts have no pieces; null ids and repeated rows are kept; an empty table gives no rows;
    other columns are left out, whatever their names; texts may be of any length that a row can
    hold.  A worker remembers up to two generations of about ``memory`` bytes of words.
    """
    modest_batches(docs.sparkSession)
    # The key carries doc_id through; equal rows are told apart, so that no two giant texts meet.
    key = F.encode(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.monotonically_increasing_id().cast("string")), "UTF-8")
    keyed = docs.select(key.alias("doc_key"), "text")
    short, giant = split_by_length(keyed, chunk)
    model = read_model(model_path)
    both = short.mapInArrow(lambda b: whole_texts(b, model, True, memory), "doc_key binary, ids array<int>, decoded string")
    out = both.union(decode(encode_giant(giant, model, chunk, memory), model_path, memory))
    name = F.split_part(F.decode("doc_key", "UTF-8"), F.lit(":"), F.lit(1))
    return out.select(F.when(name != "null", name.cast("long")).alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_max_plus_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(documents(spark, sf_dir))
