"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.llm.common import checkpointed, running_total, text_or_empty, trim_memory
from incidentry.llm.packing import SLICE_CHARS, encoded
from incidentry.llm.tokens import Encoder
from incidentry.session import pickle_by_value

#: Rows between two entries of the row index, and bytes of a stripe: a lookup reads one row group of one stripe.
INDEX_STRIDE, STRIPE_BYTES = 1000, 16 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (id_col, part, row, ids) to ORC under ``path``, documents in ascending id order over the files.

    Rows are range-partitioned by (id, hash of the text), sorted, tokenised and written by Spark's ORC writer: the ids
    as an integer array (run-length encoded, version 2), a row index every ``INDEX_STRIDE`` rows and Bloom filters
    on the id. Each partition is one file, its stripes can be read in parallel, and min/max statistics and
    Bloom filters prune lookups by id.

    Edge cases: null text counts as empty (the end id alone); null ids come first; rows repeated with one id are
    each written; an empty table writes no rows; other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    ordered = rows.repartitionByRange(F.col("_id").asc_nulls_first(), F.xxhash64("_text")).sortWithinPartitions(
        F.col("_id").asc_nulls_first(), F.xxhash64("_text"))

    def encode(batches):
        from pyspark import TaskContext
        encoder, part, row = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()

        def batch(idents, pieces):
            joined = b"".join(pieces)
            offsets = np.cumsum([0, *map(len, pieces)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(joined, "<i4")))
            return pa.RecordBatch.from_arrays(
                [pa.array(idents, pa.int64()), pa.array([part] * len(idents), pa.int32()),
                 pa.array(range(row - len(idents), row), pa.int64()), ids], ["_id", "part", "row", "ids"])

        for rows_in in batches:
            idents, pieces, size = [], [], 0
            for ident, ids in encoded(rows_in, encoder):
                idents.append(ident)
                pieces += [ids, end]
                size += len(ids)
                row += 1
                if size > 4 * SLICE_CHARS:
                    yield batch(idents, [a + b for a, b in zip(pieces[::2], pieces[1::2], strict=True)])
                    idents, pieces, size = [], [], 0
            if idents:
                yield batch(idents, [a + b for a, b in zip(pieces[::2], pieces[1::2], strict=True)])
        trim_memory()

    (ordered.mapInArrow(encode, "_id long, part int, row long, ids array<int>").withColumnRenamed("_id", id_col)
     .write.option("orc.bloom.filter.columns", id_col).option("orc.bloom.filter.fpp", "0.01")
     .option("orc.row.index.stride", str(INDEX_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES))
     .option("compression", "zstd").orc(path))


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The files of :func:`write_token_files`: (id_col, part, row, ids), stripes read in parallel."""
    return spark.read.schema(f"`{id_col}` long, part int, row long, ids array<int>").orc(path)


def token_digest(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document read back: ``id_col``, start (ids of all documents before it), n_tokens, ids_crc32."""

    def digest(batches):
        for b in batches:
            ids = b.column(3)
            offsets = np.asarray(ids.offsets)
            raw = np.asarray(ids.values).astype("<i4", copy=False).tobytes()
            at = offsets.astype(np.int64) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets), pa.int64()),
                 pa.array([zlib.crc32(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.int64())],
                ["_id", "part", "row", "n_tokens", "ids_crc32"])

    rows = files.select(F.col(id_col).alias("_id"), "part", "row", "ids").mapInArrow(
        digest, "_id long, part int, row long, n_tokens long, ids_crc32 long")
    return running_total(checkpointed(rows), [F.col("part"), F.col("row")], "n_tokens", "start").select(
        F.col("_id").alias(id_col), "start", "n_tokens", "ids_crc32")


pickle_by_value(__name__)
