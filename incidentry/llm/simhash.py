"""SimHash near-dedup with covering locality-sensitive hashing (no pair within the radius is missed)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import checkpointed, drop_rows, text_or_empty, with_row_key
from incidentry.llm.graph import connected_components
from incidentry.session import pickle_by_value

BITS = 64
#: Distinct fingerprints of a bucket that are compared in one task; larger buckets are split by further masks.
BUCKET_LIMIT = 8192
#: Shingles hashed at a time.
SHINGLE_BLOCK = 1 << 16


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of the ``words``-word shingles (repeats included) of the text with A-Z in lower case: bit b is 1 if it is
    set in over half the shingles' XXH64. Fewer words: the whole sequence is the shingle; no word: 0."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[len(ends) - n:].tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLE_BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in
                           zip(first[at:at + SHINGLE_BLOCK], last[at:at + SHINGLE_BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """2^(radius+1) - 1 masks over ``positions`` such that any set of at most ``radius`` of them is left out entirely by
    some mask: position i has a code c(i) of radius+1 bits, mask v has the positions whose code has odd overlap with
    v, and for any ``radius`` codes some v <> 0 is orthogonal to them all."""
    codes = 2 ** (radius + 1) - 1
    return [sum(1 << p for i, p in enumerate(positions) if ((1 + i % codes) & v).bit_count() % 2)
            for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                   max_bits: int = 3, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, fingerprint (16 hex digits), component_id, component_root (the
    smallest fingerprint of the component as a signed number, in hex) and the row key.

    Fingerprints at ``max_bits`` or fewer differing bits are linked; component_id is the smallest id reachable over
    links. Rows of equal fingerprint collapse to one first. Each distinct fingerprint is posted in one bucket per covering
    mask, so every pair within the radius shares a bucket; buckets of over ``BUCKET_LIMIT`` are posted again under masks
    over their free bits (at most 2^15 fingerprints can share those, so no bucket is unbounded). A bucket is compared in
    numpy blocks and gives only a spanning forest of its links, never all pairs. Links meet in
    :func:`connected_components`.

    Edge cases: null, empty and blank texts have fingerprint 0 and are linked like any other; null ids are ignored by
    the minimum (all null: null); rows repeated with one id share a component; an empty table gives no rows;
    other columns of ``docs`` are ignored whatever their names.
    """
    if key is None:
        docs, key = with_row_key(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(key[0]).alias("_k1"), F.col(key[1]).alias("_k2"),
                       text_or_empty(text_col).alias("_text"))

    def prints(batches):
        for b in batches:
            found = [_signed(fingerprint(x.as_py(), shingle_words, seed)) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.int64())], ["_id", "_k1", "_k2", "fp"])

    marked = checkpointed(rows.mapInArrow(prints, "_id long, _k1 long, _k2 long, fp long"))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("_id").alias("least")))
    roots = connected_components(fingerprint_links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    reach = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = checkpointed(rooted.join(reach, "root").select(F.col("fp").alias("_fp"), "root", "component_id"))
    def hexed(c):
        return F.lower(F.lpad(F.hex(c), 16, "0"))

    return marked.join(classes, F.col("fp") == F.col("_fp"), "left").select(
        F.col("_id").alias(id_col), hexed("fp").alias("fingerprint"), "component_id",
        hexed("root").alias("component_root"),
        F.col("_k1").alias(key[0]), F.col("_k2").alias(key[1]))


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``prints`` (fp: distinct longs) within ``radius``
    bits."""
    outer = covering_masks(radius, list(range(BITS)))
    buckets = _post(prints, [(i, _signed(m)) for i, m in enumerate(outer)])
    crowded = checkpointed(buckets.groupBy("mask", "part").count().where(f"count > {BUCKET_LIMIT}")
                           .select("mask", "part"))
    if not crowded.isEmpty():
        inner = []
        for i, m in enumerate(outer):
            free = [p for p in range(BITS) if not m >> p & 1]
            inner += [(i, len(outer) * (i + 1) + j, _signed(m | x))
                      for j, x in enumerate(covering_masks(radius, free))]
        table = F.array(*[F.struct(F.lit(o).alias("outer"), F.lit(i).alias("mask"), F.lit(m).cast("long").alias("bits"))
                          for o, i, m in inner])
        hot = buckets.join(crowded, ["mask", "part"], "left_semi")
        split = (hot.select("fp", F.inline(F.filter(table, lambda t: t["outer"] == F.col("mask"))))
                 .select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("part"), "fp"))
        buckets = buckets.join(crowded, ["mask", "part"], "left_anti").unionByName(split)

    def links(batches):
        carry = None
        for b in batches:
            rows = [np.asarray(c) for c in b.columns]
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
            change = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            last = int(change[-1]) if len(change) else 0
            carry = [x[last:] for x in rows]
            yield _forest(rows[2][:last], change[:-1])
        if carry is not None:
            yield _forest(carry[2], np.zeros(0, np.int64))

    def _forest(fps, cuts):
        a, b = bucket_forest(fps.view(np.uint64), cuts, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return (buckets.repartition("mask", "part").sortWithinPartitions("mask", "part")
            .mapInArrow(links, "a long, b long"))


def _post(prints: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    table = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(m).cast("long").alias("bits")) for i, m in masks])
    return prints.select("fp", F.inline(table)).select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("part"), "fp")


def bucket_forest(fps: np.ndarray, cuts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect what pairs within ``radius`` connect in each bucket; ``cuts`` are the positions
    at which a new bucket starts in ``fps``."""
    starts = np.concatenate(([0], cuts)).astype(np.int64)
    sizes = np.diff(np.concatenate((starts, [len(fps)])))
    label = np.arange(len(fps))
    small = 64
    bucket = np.repeat(np.arange(len(starts)), sizes)
    for step in range(1, min(small, int(sizes.max(initial=0)))):
        left = np.flatnonzero(bucket[:-step] == bucket[step:])
        left = left[sizes[bucket[left]] <= small]
        near = left[np.bitwise_count(fps[left] ^ fps[left + step]) <= radius]
        _union(label, near, near + step)
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        own = fps[s:s + n]
        for at in range(0, n, 512):
            i, j = np.nonzero(np.bitwise_count(own[at:at + 512, None] ^ own[None, at:]) <= radius)
            _union(label, s + at + i, s + at + j)
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of i and j; ``label`` points to the smallest position of a class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                     max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component of :func:`simhash_groups`, that of the smallest id (among rows repeated
    with that id, one), columns unchanged."""
    keyed, key = with_row_key(docs)
    groups = checkpointed(simhash_groups(keyed, id_col, text_col, shingle_words, max_bits, key=key))
    named = groups.select(F.col(id_col).alias("_id"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
                          "component_root")
    order = F.struct(F.col("_id").isNull(), "_id", "_k0", "_k1")
    stays = (named.groupBy("component_root").agg(F.min_by(F.struct("_k0", "_k1"), order).alias("_first"))
             .select("_first._k0", "_first._k1"))
    dropped = named.join(stays, ["_k0", "_k1"], "left_anti")
    return drop_rows(keyed, key, dropped.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)]))


pickle_by_value(__name__)
