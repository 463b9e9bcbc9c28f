"""Removal of byte strings that occur twice, with per-shard suffix arrays.

Sorting every suffix of a corpus would move its bytes hundreds of times over, so suffixes are sorted only where a
repeat is possible. Every string of ``length`` bytes holds an anchor (a window minimum of a rolling hash, so equal
strings have equal anchors) followed by at least half of it. Anchors whose following bytes occur once are
done. Anchors with equal surroundings (all bytes that a string with this anchor can cover) are repeats as a whole. What is
left, the edges of repeated passages, goes with its surroundings to shards that keep equal anchors together, and there
suffix arrays (Larsson-Sadakane refinement) with common prefixes (Kasai) tell which strings repeat. An anchor with more
different surroundings than a shard holds is dealt over several, which are merged by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import text_or_empty, with_row_key
from incidentry.session import pickle_by_value, scratch_path

#: Bytes hashed at each position, and surroundings (each 1.5 times the length) of a shard.
GRAM, SHARD_CONTEXTS = 16, 2048


def anchors(data: bytes, length: int) -> np.ndarray:
    """Positions that are the leftmost minimum of a hash of ``GRAM`` bytes over some window of length/2 + 1 positions,
    for every string of ``length`` bytes: one in each, with length/2 bytes of it to the right."""
    n, half = len(data), length // 2
    if n < length:
        return np.zeros(0, np.int64)
    positions = n - half + 1
    eight = np.empty(n - 7, np.uint64)
    for j in range(8):
        part = np.frombuffer(data, "<u8", (n - j) // 8, j)
        eight[j::8] = part[:len(eight[j::8])]
    x = eight[:positions] * np.uint64(0x9E3779B97F4A7C15) ^ eight[8:positions + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    ranked = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(positions, dtype=np.uint64)
    window = half + 1
    rows = np.full(-(-positions // window) * window, np.iinfo(np.uint64).max, np.uint64)
    rows[:positions] = ranked
    rows = rows.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:positions - window + 1], ahead[window - 1:positions])
    least &= np.uint64(0xFFFFFFFF)
    return least[np.concatenate(([True], least[1:] != least[:-1]))].astype(np.int64)


def suffix_ranks(text: np.ndarray, depth: int, step: int = 1) -> np.ndarray:
    """Rank of each suffix that starts at a multiple of ``step`` (1 or 8), by its first ``depth`` bytes (a power of two,
    8 or more): the number of smaller ones, so equal prefixes share a rank and ranks are places in the suffix array. By
    doubling: each round refines only the groups that are not yet single (Larsson-Sadakane)."""
    n = len(text) // step
    padded = np.concatenate((text, np.zeros(8, np.uint8))).tobytes()
    eight = np.empty(n, np.uint64)
    for j in range(8 // step):
        part = np.frombuffer(padded, ">u8", (len(text) + 8 - j) // 8, j)
        eight[j::8 // step] = part[:len(eight[j::8 // step])]
    rank = np.empty(n, np.int64)
    open_ = np.argsort(eight)
    _number(rank, open_, eight[open_], np.zeros(n, np.int64))
    reach = 8
    while reach < depth:
        open_ = open_[np.bincount(rank, minlength=n)[rank[open_]] > 1]
        keys = rank[open_] * (n + 1) + _rank_at(rank, open_ + reach // step)
        order = np.argsort(keys)
        open_, keys = open_[order], keys[order]
        _number(rank, open_, keys, keys // (n + 1))
        reach *= 2
    return rank


def _rank_at(rank: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Ranks from 1, and 0 beyond the end of the text."""
    return np.where(suffixes < len(rank), rank[np.minimum(suffixes, len(rank) - 1)] + 1, 0)


def _number(rank: np.ndarray, suffixes: np.ndarray, keys: np.ndarray, group: np.ndarray) -> None:
    """Give each of the sorted ``suffixes`` its group's rank and the number of those before its own key in the group."""
    if len(suffixes):
        place = np.arange(len(suffixes))
        own = np.maximum.accumulate(np.where(np.concatenate(([True], keys[1:] != keys[:-1])), place, 0))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), place, 0))
        rank[suffixes] = group + own - first


def common_prefixes(text: np.ndarray, order: np.ndarray, runs: np.ndarray, length: int, step: int = 1) -> np.ndarray:
    """Kasai: common prefix, up to ``length`` bytes, of each suffix of ``order`` with the one before it.

    ``runs`` (runs x places) are the suffixes of ``order`` by text, ``step`` bytes apart: the runs advance together, each
    carrying its common prefix less ``step`` to the next place whenever the neighbour's next suffix still comes before it.
    """
    where = np.full(len(text) + step, -1, np.int64)
    where[order] = np.arange(len(order))
    padded = np.concatenate((text, np.zeros(length + 8, np.uint8)))
    out = np.zeros(len(order), np.int64)
    have = np.zeros(len(runs), np.int64)
    before = np.full(len(runs), -1, np.int64)
    for t in range(runs.shape[1]):
        here = runs[:, t]
        real = here >= 0
        spot = where[np.where(real, here, len(text))]
        ahead = where[np.where(before >= 0, before + step, len(text))]
        have = np.where((before >= 0) & (ahead >= 0) & (ahead < spot), np.maximum(have - step, 0), 0)
        before = np.where(real & (spot > 0), order[np.maximum(spot - 1, 0)], -1)
        live = np.flatnonzero(before >= 0)
        while len(live):
            a, b = here[live] + have[live], before[live] + have[live]
            same = padded[a[:, None] + _EIGHT] == padded[b[:, None] + _EIGHT]
            more = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            have[live] = np.minimum(have[live] + more, length)
            live = live[(more == 8) & (have[live] < length)]
        have = np.where(before >= 0, have, 0)
        out[spot[real]] = have[real]
    return out


_EIGHT = np.arange(8)


def sorted_rows(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings (zeros fill them up to ``width``, a multiple of 8), and the common prefix of each with the
    one before it in that order, from a suffix array over the words of 8 bytes of all of them."""
    text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8)
    places = len(text) // 8
    depth = 1 << (width.bit_length() - 1)
    rank = suffix_ranks(text, depth, 8)
    # by the first `depth` bytes, then by the `depth` bytes that end a string of `width`
    order = np.argsort(rank * (places + 1) + _rank_at(rank, np.arange(places) + (width - depth) // 8), kind="stable")
    prefix = common_prefixes(text, order * 8, np.arange(0, len(text), 8).reshape(len(rows), -1), width, 8)
    heads = np.flatnonzero(order % (width // 8) == 0)  # suffixes that are whole strings
    least = np.minimum.reduceat(np.append(prefix, 0), np.concatenate((heads[:1], heads + 1)))[:-1]
    least[0] = 0
    return order[heads] // (width // 8), least


def shard_repeats(contexts: list[bytes], offsets: np.ndarray, length: int) -> np.ndarray:
    """For each context (bytes around an anchor at ``offsets``), which strings of ``length`` bytes that hold the anchor
    also occur, at the same distance from it, in another context: booleans, contexts x (length/2 + 1), by the anchor's
    distance from the string's start.

    Contexts lie side by side at their anchors, so a string is a piece that ends before the anchor and one that starts at
    it. The common prefixes of the sorted right sides name the right pieces of any length, those of the sorted left
    sides, read backwards, the left pieces; strings are equal when both names are.
    """
    half = length // 2
    if not contexts:
        return np.zeros((0, half + 1), bool)
    distance = np.arange(half + 1)
    sizes = np.array([len(c) for c in contexts])
    real = (distance <= offsets[:, None]) & (offsets[:, None] + length - distance <= sizes[:, None])

    def names(sides: list[bytes], pieces: np.ndarray) -> np.ndarray:
        order, prefix = sorted_rows(sides, -(-int(pieces.max()) // 8) * 8)
        out = np.empty(real.shape, np.int64)
        out[order] = np.cumsum(prefix[:, None] < pieces, axis=0)
        return out

    left = names([c[:o][::-1] for c, o in zip(contexts, offsets.tolist(), strict=True)], distance)
    right = names([c[o:] for c, o in zip(contexts, offsets.tolist(), strict=True)], length - distance)
    row, column = np.nonzero(real)
    keys = ((left * (len(contexts) + 1) + right) * (half + 1) + distance)[real]
    sort = np.argsort(keys)
    equal = keys[sort][1:] == keys[sort][:-1]
    again = np.concatenate(([False], equal)) | np.concatenate((equal, [False])) if len(keys) else equal
    out = np.zeros(real.shape, bool)
    out[row[sort], column[sort]] = again
    return out


def string_digests(contexts: list[bytes], offsets: np.ndarray, length: int) -> np.ndarray:
    """64-bit polynomial digests of the strings that hold the anchor, mixed with their distance from it (contexts x
    distances); 0 where there is none. All contexts advance in step."""
    half = length // 2
    sizes = np.array([len(c) for c in contexts])
    width = int(sizes.max(initial=0))
    text = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in contexts), np.uint8).reshape(len(contexts), width)
    values = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93)
    base, power = np.uint64(0xBF58476D1CE4E5B9), pow(0xBF58476D1CE4E5B9, length, 1 << 64)
    sums = np.zeros((width + 1, len(contexts)), np.uint64)
    for i in range(width):
        sums[i + 1] = sums[i] * base + values[:, i]
    distance = np.arange(half + 1)
    start = offsets[:, None] - distance[None]
    real = (start >= 0) & (start + length <= sizes[:, None])
    begin, row = np.where(real, start, 0), np.arange(len(contexts))[:, None]
    found = sums[np.minimum(begin + length, width), row] - sums[begin, row] * np.uint64(power)
    found ^= found >> np.uint64(31)
    found *= np.uint64(0x94D049BB133111EB)
    found ^= (distance + 1).astype(np.uint64)[None] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.where(real, np.maximum(found, np.uint64(1)), np.uint64(0))


def merge_spans(own: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """A shard's sorted digests by the span of digests in which they meet those of the anchor's other shards; spans
    without any are left out. There are as many spans as shards, so one span of all shards holds about what one shard
    has in all spans, however many shards there are."""
    cuts = np.searchsorted(own, np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts))
    return [(span, x) for span, x in enumerate(np.split(own, cuts)) if len(x)]


def _spans(repeated: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges relative to the anchor that the repeated strings (by distance) cover."""
    edge = np.diff(np.concatenate(([0], repeated.astype(np.int8), [0])))
    return [(1 - int(b), length - int(a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1),
                                                          strict=True)]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept (binary) of each row of ``docs``: its text's UTF-8 bytes without
    each byte covered by a string of ``length`` bytes that also starts anywhere else, in this or another document.

    Overlaps count, and strings are judged on the input. Results are exact but for collisions of 64-bit
    (half strings, only to find candidates) and 128-bit (whole surroundings) hashes; in the merge of an anchor's shards
    64-bit digests decide. Memory is bounded by a shard's surroundings and by a document's own bytes; the shards of
    an anchor are merged over as many spans of digests as there are shards, each about one shard's digests.

    Edge cases: null text counts as empty; texts shorter than ``length`` lose nothing; strings may repeat within one
    document, overlapping themselves (runs of one character); rows repeated with one id are documents of their own, so
    their texts repeat; an empty table gives no rows; other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    half = length // 2
    if length < 64 or length % 2:
        raise ValueError("length must be even and at least 64")
    keyed, key = with_row_key(docs)
    rows = keyed.select(F.col(key[0]).alias("k1"), F.col(key[1]).alias("k2"), F.col(id_col).alias("id"),
                        F.encode(text_or_empty(text_col), "UTF-8").alias("body"))

    def find(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for k1, k2, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = body.as_py()
                for x in anchors(data, length).tolist():
                    around = xxhash.xxh128_intdigest(data[max(0, x - half):x + length], min(x, half))
                    for column, v in zip(out, (k1, k2, x, _signed(xxhash.xxh64_intdigest(data[x:x + half])),
                                               _signed(around >> 64), _signed(around & _LOW)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["k1", "k2", "x", "key", "a", "b"])

    found = _written(rows.select("k1", "k2", "body").mapInArrow(
        find, "k1 long, k2 long, x long, key long, a long, b long"))

    twice = found.groupBy("key").count().where("count > 1").select("key")
    repeated = _written(found.join(twice, "key", "left_semi"))
    classes = _written(repeated.groupBy("key", "a", "b").agg(F.count("*").alias("n"),
                                                            F.min(F.struct("k1", "k2", "x")).alias("first")))
    whole = repeated.join(classes.where("n > 1").select("key", "a", "b"), ["key", "a", "b"], "left_semi").select(
        "k1", "k2", (F.col("x") - half).alias("start"), (F.col("x") + length).alias("end"))

    mixed = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).where(
        "kinds > 1 AND fewest = 1").select(F.col("key").alias("mixed_key"), "kinds")
    wanted = _written(classes.join(mixed, F.col("key") == F.col("mixed_key")).select(
        "first.*", "key", F.ceil(F.col("kinds") / SHARD_CONTEXTS).cast("int").alias("parts")))
    compact = _compressed(rows)
    edges = _edge_spans(compact, wanted, length)

    spans = whole.unionByName(edges).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = compact.join(_written(spans), ["k1", "k2"], "left").select("id", "body", "spans")
    kind = joined.schema["id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            out = []
            for body, spans_ in zip(b.column(1), b.column(2), strict=True):
                data = zstandard.decompress(body.as_py())
                change = np.zeros(len(data) + 1, np.int32)
                if spans_.as_py():
                    ends = spans_.values
                    np.add.at(change, np.maximum(np.asarray(ends.field("start")), 0), 1)
                    np.add.at(change, np.minimum(np.asarray(ends.field("end")), len(data)), -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), len(data) - len(kept), starts, kept))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
                             ).withColumnRenamed("id", id_col)


_LOW = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder (compressed, unlike a checkpoint)."""
    path = scratch_path(df.sparkSession, "suffix")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _compressed(rows: DataFrame) -> DataFrame:
    """``rows`` with each body compressed, as it goes through the shuffles."""
    at = rows.columns.index("body")

    def compress(batches):
        packer = zstandard.ZstdCompressor()
        for b in batches:
            bodies = pa.array([packer.compress(x.as_py()) for x in b.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([bodies if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return rows.mapInArrow(compress, rows.schema)


def _edge_spans(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, end) from compressed ``rows``: what the strings around the anchors of ``wanted`` cover that repeat in other surroundings
    of equal anchors."""
    half = length // 2
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("x", "key", "parts")).alias("asked"))

    def fetch(batches):
        for b in batches:
            columns = [[] for _ in range(7)]
            for k1, k2, body, asked_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3),
                                            strict=True):
                data = zstandard.decompress(body.as_py())
                for a in asked_.as_py():
                    x = a["x"]
                    context = data[max(0, x - half):x + length]
                    salt = xxhash.xxh64_intdigest(context) % a["parts"]
                    for column, v in zip(columns, (k1, k2, x, a["key"], a["parts"], salt, context), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]],
                                              pa.array(columns[6], pa.binary())],
                                             ["k1", "k2", "x", "key", "parts", "salt", "context"])

    contexts = _written(rows.join(asked, ["k1", "k2"]).select("k1", "k2", "body", "asked").mapInArrow(
        fetch, "k1 long, k2 long, x long, key long, parts long, salt long, context binary"))
    shards = max(1, -(-wanted.count() // SHARD_CONTEXTS))
    schema = "k1 long, k2 long, start long, end long"

    def spans_table(table: pa.Table, repeated: np.ndarray) -> pa.Table:
        out = [(k1, k2, x + a, x + b) for k1, k2, x, r in
               zip(table["k1"].to_pylist(), table["k2"].to_pylist(), table["x"].to_pylist(), repeated, strict=True)
               for a, b in _spans(r, length)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "start", "end"])

    def offsets(table: pa.Table) -> np.ndarray:
        return np.minimum(np.asarray(table["x"]), half)

    def sort_shard(table: pa.Table) -> pa.Table:
        bodies = table["context"].to_pylist()
        found = np.zeros((len(bodies), half + 1), bool)
        keys = np.asarray(table["key"])
        order = np.argsort(keys, kind="stable")  # groups stay together when a shard got more than its share
        at = 0
        while at < len(order):
            end = min(len(order), at + SHARD_CONTEXTS)
            if end < len(order):
                end = int(np.searchsorted(keys[order], keys[order[end - 1]], "right"))
            part = order[at:end]
            found[part] = shard_repeats([bodies[i] for i in part], offsets(table)[part], length)
            at = end
        return spans_table(table, found)

    cold = contexts.where("parts = 1").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    out = cold.groupBy("shard").applyInArrow(sort_shard, schema)
    hot = contexts.where("parts > 1")
    if hot.isEmpty():
        return out
    out = out.unionByName(hot.groupBy("key", "salt").applyInArrow(sort_shard, schema))

    def digests(table: pa.Table) -> pa.Table:
        own = np.unique(string_digests(table["context"].to_pylist(), offsets(table), length))
        dealt = merge_spans(own[own > 0], table["parts"][0].as_py())
        return pa.table({"key": pa.array([table["key"][0].as_py()] * len(dealt), pa.int64()),
                         "salt": pa.array([table["salt"][0].as_py()] * len(dealt), pa.int64()),
                         "span": pa.array([span for span, _ in dealt], pa.int64()),
                         "sorted": pa.array([x.tobytes() for _, x in dealt], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in table["sorted"].to_pylist()]
        every = np.sort(np.concatenate(lists))
        shared = [x[np.searchsorted(every, x, "right") - np.searchsorted(every, x, "left") > 1] for x in lists]
        return pa.table({"key": table["key"], "salt": table["salt"],
                         "shared": pa.array([x.tobytes() for x in shared], pa.binary())})

    shared = (hot.groupBy("key", "salt").applyInArrow(digests, "key long, salt long, span long, sorted binary")
              .groupBy("key", "span").applyInArrow(merge, "key long, salt long, shared binary")
              .toDF("m_key", "m_salt", "shared"))

    def mark(table: pa.Table, lists: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64)
                                                                   for x in lists["shared"].to_pylist()]]))
        return spans_table(table, _among(string_digests(table["context"].to_pylist(), offsets(table), length), known))

    return out.unionByName(hot.groupBy("key", "salt").cogroup(shared.groupBy("m_key", "m_salt")).applyInArrow(mark, schema))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``known``, by binary search."""
    if not len(known):
        return np.zeros(values.shape, bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


pickle_by_value(__name__)
