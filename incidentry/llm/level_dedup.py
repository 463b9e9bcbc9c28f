"""Substring dedup by level-wise doubling: windows of words repeated at one length are extended to twice that length."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentry.llm.common import text_or_empty, with_row_key
from incidentry.session import pickle_by_value

#: Doublings before the full length, bytes looked at together, and words of a longer text looked at together.
DOUBLINGS, SLICE_BYTES, PIECE_WORDS = 2, 1 << 20, 200_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def level_lengths(length: int, doublings: int = DOUBLINGS) -> list[int]:
    """Window lengths, each at most twice the one before, that end at ``length``: 9, 18, 35 for 35."""
    first = -(-length // (1 << doublings))
    return [first << i for i in range(doublings) if first << i < length] + [length]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of some texts side by side, one space between any two, with digests of any run of words from prefix sums of
    a polynomial in odd powers modulo 2^64."""

    _powers: dict = {}

    def __init__(self, pieces: list[list[bytes]]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.data = np.frombuffer(b" ".join(chain.from_iterable(pieces)), np.uint8)
        count = int(sizes.sum())
        self.begin = np.concatenate((np.zeros(min(count, 1), np.int64), np.flatnonzero(self.data == 32) + 1))
        self.end = np.append(self.begin[1:] - 1, len(self.data))[:count]
        self.owner = np.repeat(np.arange(len(pieces)), sizes)  # piece of each word
        self.last = np.repeat(np.cumsum(sizes), sizes)  # where the words of that piece end
        self.first = self.last - np.repeat(sizes, sizes)
        self._sums: dict = {}

    @classmethod
    def powers(cls, base: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Powers of the base, of its inverse, and the values of the 256 bytes; kept up to a slice's size."""
        known = cls._powers.get(base)
        if known is None or len(known[0]) < count:
            room = max(count, SLICE_BYTES * 2)
            known = []
            for factor in (base, pow(base, -1, 1 << 64)):
                out = np.full(room, factor, np.uint64)
                out[0] = 1
                known.append(np.multiply.accumulate(out))
            known.append(_mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(base)))
            cls._powers = {**cls._powers, base: known} if room <= SLICE_BYTES * 2 else cls._powers
        return known

    def digests(self, start: np.ndarray, length: int, base: int = _BASES[0]) -> np.ndarray:
        """Digest of the ``length`` words from each of the word numbers ``start``."""
        powers, inverse, values = self.powers(base, len(self.data))
        if base not in self._sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(values[self.data] * powers[:len(self.data)], out=sums[1:])
            self._sums[base] = sums
        sums, a, b = self._sums[base], self.begin[start], self.end[start + length - 1]
        return _mixed((sums[b] - sums[a]) * inverse[a])

    def windows(self, length: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, anchor) of every window of ``length`` words: the anchor is its run of ``first`` words of the smallest
        digest, so equal windows have theirs at the same distance, and one run serves many windows."""
        starts = np.flatnonzero(self.last - np.arange(len(self.last)) >= length)
        if not len(starts):
            return starts, starts
        runs, width = len(self.last) - first + 1, length - first + 1
        ranked = self.digests(np.arange(runs), first) & np.uint64(0xFFFFFFFF00000000) | np.arange(runs, dtype=np.uint64)
        rows = np.full(-(-runs // width) * width, np.iinfo(np.uint64).max, np.uint64)
        rows[:runs] = ranked
        rows = rows.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[starts], ahead[starts + width - 1]) & np.uint64(0xFFFFFFFF)
        return starts, least.astype(np.int64)


def candidates(words: Words, levels: list[int], level: int, repeated: np.ndarray) -> np.ndarray:
    """Starts of the windows of length ``levels[level]`` that may repeat: of those of the full length, the parts that
    hold the anchor at a multiple of the first length from their start, and whose half with the anchor is among the
    ``repeated`` digests of the level before."""
    length, first, size = levels[-1], levels[0], levels[level]
    starts, anchor = words.windows(length, first)
    if level == 0:
        return np.unique(anchor)
    before = levels[level - 1]
    distance = anchor - starts

    def survives(at: np.ndarray) -> np.ndarray:
        unique, where = np.unique(at, return_inverse=True)
        return np.isin(words.digests(unique, before), repeated)[where] if len(at) else np.zeros(0, bool)

    if size < length:
        found = []
        for ahead in range(0, size - first + 1, first):
            inside = (ahead <= distance) & (ahead >= distance - (length - size))
            at = np.unique(anchor[inside]) - ahead
            found.append(at[survives(at if ahead < before else at + before)])
        return np.unique(np.concatenate(found))
    alive = np.ones(len(starts), bool)
    for ahead in range(0, before - first + 1, first):
        inside = (ahead <= distance) & (ahead >= distance - (length - before))
        alive[inside] &= survives(anchor[inside] - ahead)
    return starts[alive]


def _pieces(texts: list[str], length: int):
    """(text's number, first word's number, words) of texts, long ones in pieces that share ``length`` - 1 words, so that
    each window lies in one piece."""
    for i, text in enumerate(texts):
        words = text.encode().split()
        if len(words) >= length:
            for at in range(0, len(words) - length + 1, PIECE_WORDS):
                yield i, at, words[at:at + PIECE_WORDS + length - 1]


def _slices(lengths: list[int]):
    start = size = 0
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= SLICE_BYTES or i == len(lengths) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def _level(docs: DataFrame, levels: list[int], level: int) -> DataFrame:
    """One level over ``docs`` (_k0, _k1, _text, _copies, _known: digests of the level before): the digests (or, at the
    full length, starts) of a row's windows that also occur elsewhere, as (_k0, _k1, _known). Other columns of ``docs``
    come last and are not used.

    A window leaves a slice of texts once, with the number of times it occurs there (2 for more); only if that is once
    its row waits for the answer, otherwise it has it already. So a window that very many texts share
    arrives as one row a slice; rows that have their answer travel under a number of their own.
    """
    length, last = levels[-1], level == len(levels) - 1

    def find(batches):
        for b in batches:
            keys = [np.asarray(b.column(i)) for i in (0, 1)]
            for start, stop in _slices(pa.compute.binary_length(b.column(2)).to_pylist()):
                pieces = list(_pieces(b.column(2).slice(start, stop - start).to_pylist(), length))
                words = Words([p[2] for p in pieces])
                known = b.column(4).slice(start, stop - start)
                at = candidates(words, levels, level, np.asarray(known.flatten()).view(np.uint64))
                if not len(at):
                    continue
                owner = words.owner[at]
                row = np.array([p[0] for p in pieces])[owner] + start
                times = np.minimum(np.asarray(b.column(3))[row], 2)  # whole copies of the text
                digest = words.digests(at, levels[level])
                second = words.digests(at, length, _BASES[1]) if last else np.zeros(len(at), np.uint64)
                order = np.lexsort((at, second, digest))
                digest, second, times, row, at, owner = (x[order] for x in (digest, second, times, row, at, owner))
                head = np.concatenate(([True], (digest[1:] != digest[:-1]) | (second[1:] != second[:-1])))
                heads = np.flatnonzero(head)
                sums = np.add.reduceat(times, heads)[np.cumsum(head) - 1]
                # one row a digest; rows that have their answer under a spread number (a text known to have whole copies
                # needs none in the end, but its windows go on to meet those of other texts)
                told = np.flatnonzero((sums > 1) & ((times == 1) | (not last)))
                # in the order of the texts, where neighbours have their row in common and compress
                heads, told = (x[np.argsort(at[x], kind="stable")] for x in (heads, told))
                publish = np.where(sums > 1, 2, 1)[heads]
                waits = sums[heads] == 1
                value = np.array([p[1] for p in pieces])[owner] + at - words.first[at] if last else np.zeros(len(at), np.int64)

                def column(values, kind, at=heads, told=told):
                    return pa.array(np.concatenate((values[at], values[told])), kind)

                empty = np.concatenate((~waits, np.zeros(len(told), bool)))
                yield pa.RecordBatch.from_arrays(
                    [column(digest.view(np.int64), pa.int64()), column(second.view(np.int64), pa.int64()),
                     pa.array(np.concatenate((np.zeros(len(heads), np.int64), 1 + told)), pa.int64()),
                     pa.array(np.concatenate((publish, np.full(len(told), 2))), pa.int8()),
                     *[pa.array(np.concatenate((k[row[heads]], k[row[told]])), pa.int64(), mask=empty) for k in keys],
                     column(value, pa.int64())], NAMES)

    rows = docs.mapInArrow(find, "d0 long, d1 long, spread long, times tinyint, _k0 long, _k1 long, value long")
    times = F.sum("times").over(Window.partitionBy("d0", "d1", "spread"))
    answered = rows.withColumn("times", times).where("times > 1 AND _k0 IS NOT NULL")
    return answered.groupBy("_k0", "_k1").agg(F.collect_list("value" if last else "d0").alias("_known"))


NAMES = ["d0", "d1", "spread", "times", "_k0", "_k1", "value"]


def remove_repeated_windows(docs: DataFrame, length: int = 35, id_col: str = "doc_id",
                            text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_removed, n_spans, kept of each row of ``docs``: its words (cut at ASCII white space) without
    those covered by a run of ``length`` words that also starts anywhere else; kept words joined by one space.

    Windows are tested at 1/4, 1/2 and the whole of the length (9, 18 and 35 words). At the first only anchors are
    looked at (the smallest digest of each full window, some 7 % of all places); each level extends what repeated at the
    one before to twice its length, and the last one decides for every window, by 128-bit digests. Texts that are
    equal as a whole are settled first: one of them is searched for all. Texts are shuffled once, by row; all levels and
    the cut read that shuffle. Each level sends a window's digest once from a slice of texts (see ``_level``), so
    no key gathers its rows in one task; the list a row gets back is bounded by its own words.

    Edge cases: null text counts as empty and has no words; texts of fewer than ``length`` words keep all; repeated rows
    are copies of each other whatever their ids; windows may overlap and lie in the same text; texts of more than
    ``PIECE_WORDS`` words are searched in pieces that miss no window; an empty table gives no rows; other columns
    are ignored whatever their names.
    """
    levels = level_lengths(length)
    keyed, key = with_row_key(docs)
    # never null and the same columns wherever texts are read, so that all levels reuse one shuffle of them
    rows = keyed.select(F.coalesce(key[0], F.lit(0)).alias("_k0"), F.coalesce(key[1], F.lit(0)).alias("_k1"),
                        F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    copies = rows.groupBy(F.sha2("_text", 256).alias("_same")).agg(
        F.min(F.struct("_k0", "_k1")).alias("_one"), F.count("*").alias("_copies"))
    copies = copies.select("_one._k0", "_one._k1", "_copies")
    texts = rows.repartition("_k0", "_k1")
    searched = texts.join(copies, ["_k0", "_k1"])
    known = None
    for level in range(len(levels)):
        if known is None:
            start = searched.withColumn("_known", F.array().cast("array<long>"))
        else:
            start = searched.join(known, ["_k0", "_k1"])
        known = _level(start.select("_k0", "_k1", "_text", "_copies", "_known", "_id"), levels, level)
    ends = texts.join(copies, ["_k0", "_k1"], "left").join(known, ["_k0", "_k1"], "left")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for b in batches:
            out = []
            for text, copies, starts in zip(b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                words = text.as_py().encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if len(words) >= length and copies != 1:  # one of several copies
                    gone[0] = 1
                elif starts.is_valid:
                    at = np.asarray(starts.values)
                    gone[at] += 1
                    gone += np.bincount(at + length, minlength=len(gone)) * -1
                covered = np.cumsum(gone)[:-1] > 0
                spans = int(np.count_nonzero(np.diff(np.concatenate(([0], covered))) == 1))
                kept = [w for w, c in zip(words, covered, strict=True) if not c] if spans else words
                out.append((len(words), int(covered.sum()), spans, b" ".join(kept).decode() if kept else ""))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, ARROW, strict=True)]],
                                             ["_id", "n_words", "n_removed", "n_spans", "kept"])

    return ends.select("_id", "_text", "_copies", "_known").mapInArrow(
        cut, f"_id {kind}, n_words long, n_removed long, n_spans long, kept string").withColumnRenamed("_id", id_col)


ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string()]


def oracle_sql(length: int = 35) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT row, w, unnest(range(1, len(w) - {length - 2})) AS pos FROM d WHERE len(w) >= {length}),
h AS (SELECT row, pos, md5(array_to_string(w[pos:pos + {length - 1}], ' ')) AS h FROM s),
r AS (SELECT row, pos FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
x AS (SELECT row, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
c AS (SELECT x.row, doc_id, word, x.pos,
             coalesce(max(r.pos) OVER (PARTITION BY x.row ORDER BY x.pos), -{length}) > x.pos - {length} AS gone
      FROM x LEFT JOIN r ON x.row = r.row AND x.pos = r.pos)
SELECT any_value(d.doc_id) AS doc_id, count(pos) AS n_words, coalesce(sum(gone::INT), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256,
       coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept
FROM d LEFT JOIN c USING (row) GROUP BY d.row
"""


pickle_by_value(__name__)
