"""Cost-balanced packing of documents into sequences of a fixed token capacity."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import text_or_empty, trim_memory
from incidentry.llm.tokens import Encoder
from incidentry.session import pickle_by_value

#: Pieces shorter than a sequence that are packed together; bounds a task's memory (8 kB of ids each at most).
POOL_PIECES = 4096
#: Bytes of text encoded at a time.
SLICE_CHARS = 1_000_000


def piece_cost(length: np.ndarray | int, linear: float, quadratic: float):
    """Estimated cost of a piece: what grows with its tokens plus attention within it."""
    return linear * length + quadratic * length * length


def pack_pieces(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 256):
    """Rows (piece, start in the piece, length, sequence, offset in the sequence) that place all pieces.

    The fewest sequences that can hold the tokens are open. Pieces in descending length go to the sequence of the lowest
    estimated cost among those with room for them; a piece that fits nowhere is cut, filling the roomiest first.
    """
    room = np.full(-(-sum(lengths) // capacity), capacity, np.int64)
    cost = np.zeros(len(room))
    placed = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[piece]
        while left:
            best = int(np.argmin(np.where(room >= left, cost, np.inf)))
            if room[best] < left:
                best = int(np.argmax(room))
            take = min(left, int(room[best]))
            placed.append((piece, start, take, best, capacity - int(room[best])))
            room[best] -= take
            cost[best] += piece_cost(take, linear, quadratic)
            start, left = start + take, left - take
    return placed, len(room)


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, capacity: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text", linear: float = 1.0,
                   quadratic: float = 1 / 256, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost and, ``with_ids``,
    the ids themselves (they leave the Python worker only then).

    A document is its token ids and ``end_id``. Runs of ``capacity`` ids fill sequences of their own; the rests are
    pooled within the task (at most ``POOL_PIECES``) and packed by :func:`pack_pieces`, so a pool pads less than one
    sequence in all. Nothing is shuffled, memory is bounded by the pool, and a lost task gives the same sequences again
    (their ids are made from the partition's number and a counter).

    Edge cases: null text counts as empty and gives the end id alone; very long texts are cut freely; every row is a
    document of its own, whether its id is null or repeated; an empty table gives no rows; other columns of
    ``docs`` are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    width = len(NAMES) if with_ids else len(NAMES) - 1

    def pieces(batches):
        encoder = Encoder.of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        pool: list[tuple] = []

        def emit(ident, start, ids, doc_tokens, where, offset):
            out.append((ident, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, where, offset,
                        piece_cost(len(ids) // 4, linear, quadratic), ids))

        def flush():
            nonlocal sequence
            placed, used = pack_pieces([len(p[2]) // 4 for p in pool], capacity, linear, quadratic)
            for piece, begin, length, where, offset in placed:
                ident, start, ids, doc_tokens = pool[piece]
                emit(ident, start + begin, ids[4 * begin:4 * (begin + length)], doc_tokens, sequence + where, offset)
            sequence += used
            pool.clear()

        def batch():
            columns = list(zip(*out, strict=True))[:width]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW[:width], strict=True)],
                                              NAMES[:width])

        for rows_in in batches:
            for ident, ids in encoded(rows_in, encoder):
                ids += end
                n = len(ids) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    emit(ident, start, ids[4 * start:4 * (start + capacity)], n, sequence, 0)
                    sequence += 1
                if n > whole:
                    pool.append((ident, whole, ids[4 * whole:], n))
                if len(pool) >= POOL_PIECES:
                    flush()
                if len(out) >= POOL_PIECES:
                    yield batch()
        if pool:
            flush()
        if out:
            yield batch()
        trim_memory()

    return rows.mapInArrow(pieces, "_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                   "sequence_id long, offset long, cost double" + ", ids binary" * with_ids
                           ).withColumnRenamed("_id", id_col)


NAMES = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", "ids"]
ARROW = [pa.int64()] * 7 + [pa.float64(), pa.binary()]


def encoded(batch: pa.RecordBatch, encoder):
    """(id, ids) of each row (id, text) of a batch, some texts at a time."""
    idents = batch.column(0).to_pylist()
    lengths = np.asarray(pa.compute.binary_length(batch.column(1)))
    start = size = 0
    for i, n in enumerate(lengths):
        size += int(n)
        if size >= SLICE_CHARS or i == len(idents) - 1:
            texts = batch.column(1).slice(start, i + 1 - start).to_pylist()
            yield from zip(idents[start:i + 1], encoder.encode(texts), strict=True)
            start, size = i + 1, 0


pickle_by_value(__name__)
