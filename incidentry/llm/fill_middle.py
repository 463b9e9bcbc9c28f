"""Fill-in-the-middle: texts cut at unit boundaries found by a wavelet matrix over character classes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import text_or_empty
from incidentry.session import pickle_by_value

#: Classes of code points; three bits each, the levels of the wavelet matrix.
OTHER, LINE_FEED, SPACE, LETTER, DIGIT, STOP, PUNCTUATION, BEYOND_ASCII = range(8)
LEVELS = 3
#: What ends a unit, by the classes of its last character.
UNIT_ENDS = {"line": (LINE_FEED,), "sentence": (STOP, LINE_FEED), "word": (SPACE, LINE_FEED),
             "character": tuple(range(8))}
SENTINELS = ("<P>", "<S>", "<M>")
#: Characters of the texts that share one matrix (a longer text has its own): about 20 bytes of memory each.
SLICE_CHARS = 1_000_000


def _class_table() -> np.ndarray:
    table = np.full(129, OTHER, np.uint8)
    table[128] = BEYOND_ASCII
    for i in range(33, 127):
        c = chr(i)
        table[i] = LETTER if c.isalpha() else DIGIT if c.isdigit() else STOP if c in ".!?" else PUNCTUATION
    table[[9, 11, 12, 13, 32]] = SPACE
    table[10] = LINE_FEED
    return table


CLASS_OF = _class_table()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return CLASS_OF[np.minimum(points, 128)]


class WaveletMatrix:
    """Ranks over a sequence of classes: per bit, from the highest, how many ones stand before each place of the sequence
    as the bits above have sorted it (zeros before ones, stably)."""

    def __init__(self, classes: np.ndarray):
        self.ones, self.zeros = [], []
        for level in reversed(range(LEVELS)):
            bit = (classes >> level) & 1
            before = np.zeros(len(bit) + 1, np.int32 if len(bit) < 2**31 else np.int64)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(bit) - int(before[-1]))
            classes = np.concatenate((classes[bit == 0], classes[bit == 1]))

    def rank(self, kind: int, places: np.ndarray) -> np.ndarray:
        """Occurrences of class ``kind`` before each of ``places``."""
        begin, at = 0, places
        for level, ones, zeros in zip(reversed(range(LEVELS)), self.ones, self.zeros, strict=True):
            if kind >> level & 1:
                begin, at = zeros + int(ones[begin]), zeros + ones[at]
            else:
                begin, at = begin - int(ones[begin]), at - ones[at]
        return at - begin

    def count(self, kinds: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """Characters of any of ``kinds`` before each of ``places``: their ranks added up."""
        return np.sum([self.rank(k, places) for k in kinds], axis=0, dtype=np.int64)

    def after(self, kinds: tuple[int, ...], nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place behind the ``nth`` character of ``kinds`` from ``low`` on, ``low`` for the 0th, ``high`` where there
        are fewer: bisection on the ranks, for all texts at once."""
        begin, low, high = self.count(kinds, low), low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = self.count(kinds, middle) - begin >= nth
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def cut_texts(texts: list[str], draws: list[tuple[int, int]], unit: str) -> list[tuple[int, int, int]]:
    """(units n, end of the prefix, end of the middle) of each text, in characters. Two draws modulo n + 1 give the units
    before either cut."""
    kinds = UNIT_ENDS[unit]
    classes = [classes_of(t) for t in texts]
    sizes = np.array([len(c) for c in classes], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    matrix = WaveletMatrix(np.concatenate(classes) if classes else np.zeros(0, np.uint8))
    whole = matrix.count(kinds, ends) - matrix.count(kinds, starts)
    # a last unit that nothing ends
    open_end = (sizes > 0) & (matrix.count(kinds, ends) == matrix.count(kinds, np.maximum(ends - 1, 0)))
    n = whole + open_end
    drawn = np.array(draws, np.int64).reshape(-1, 2) % (n + 1)[:, None]
    cuts = [matrix.after(kinds, drawn.min(axis=1), starts, ends) - starts,
            matrix.after(kinds, drawn.max(axis=1), starts, ends) - starts]
    return list(zip(n.tolist(), cuts[0].tolist(), cuts[1].tolist(), strict=True))


def numbers_of(seed: str, ident) -> list[int]:
    """The first four 32-bit numbers of SHA-256 of ``seed``, a colon and the id (nothing for a null id)."""
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: str = "7",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n (units), form, prefix_chars, middle_chars, output (string) of each row of ``docs``.

    A text's units are counted and both cuts located on a :class:`WaveletMatrix` over the character classes of a slice
    of texts: ranks of the classes that end a unit add up to boundary counts, bisection on them finds the cuts. The
    forms are ``psm`` (prefix, suffix, middle behind their sentinels), ``spm`` (suffix, prefix, middle; ``spm_rate``
    percent) and ``plain`` (the text as it is: 100 - ``rate`` percent, empty texts, and texts that hold a sentinel, so
    that :func:`restored` is exact). All draws come from the id, so reruns agree; nothing is shuffled.

    Edge cases: null text counts as empty, which has no units; a null id is drawn for as an empty one; rows repeated with
    one id are each transformed alike; a very long text has a matrix of its own (about 20 bytes a character); an empty
    table gives no rows; other columns of ``docs`` are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    first, second, third = SENTINELS

    def transform(idents: list, texts: list[str]) -> list[tuple]:
        drawn = [numbers_of(seed, i) for i in idents]
        out = []
        for text, h, (n, a, b) in zip(texts, drawn, cut_texts(texts, [h[:2] for h in drawn], unit), strict=True):
            if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
                out.append((n, "plain", None, None, text))
            elif h[3] % 100 < spm_rate:
                out.append((n, "spm", a, b - a, second + text[b:] + first + text[:a] + third + text[a:b]))
            else:
                out.append((n, "psm", a, b - a, first + text[:a] + second + text[b:] + third + text[a:b]))
        return out

    def run(batches):
        for b in batches:
            lengths = np.asarray(pa.compute.utf8_length(b.column(1)))
            start = size = 0
            for i, length in enumerate(lengths):
                size += int(length)
                if size >= SLICE_CHARS or i == len(lengths) - 1:
                    idents = b.column(0).slice(start, i + 1 - start)
                    found = transform(idents.to_pylist(), b.column(1).slice(start, i + 1 - start).to_pylist())
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), ARROW, strict=True)]
                    yield pa.RecordBatch.from_arrays([idents, *columns], NAMES)
                    start, size = i + 1, 0

    return rows.mapInArrow(run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
                           ).withColumnRenamed("_id", id_col)


NAMES = ["_id", "n", "form", "prefix_chars", "middle_chars", "output"]
ARROW = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` of, from the output and its form alone. Transformed texts
    hold each sentinel once."""
    first, second, third = SENTINELS

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, third, -1)
    return (F.when(form == "psm", F.concat(between(first, second), middle, between(second, third)))
            .when(form == "spm", F.concat(between(first, third), middle, between(second, first))).otherwise(output))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h,
                  regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
r AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM r),
s AS (SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m,
             coalesce(array_to_string(u[hi + 1:], ''), '') AS x,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100
                  THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
                        ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""

pickle_by_value(__name__)
