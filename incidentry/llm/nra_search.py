"""Ranked lexical search by NRA (no random access): impact-sorted lists read in step, a score interval per document."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentry.llm.common import text_or_empty
from incidentry.session import pickle_by_value

#: Documents and postings whose lists are read together; bounds a task's memory (some 40 bytes a posting).
SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000
#: Bytes of query text searched for in one pass over the documents.
BLOCK_BYTES = 4 << 20
#: Entries read from each list in the first round; every round reads as many as all before it.
FIRST_DEPTH = 128

#: Bytes outside terms become spaces, A-Z lower case; bytes of characters beyond ASCII stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))
NO_ID = -(1 << 63)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def weight_of(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, size: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to the score of a document of ``size`` terms that holds it ``tf`` times; whole numbers."""
    norm = 100 - 50 + (50 * size * documents) // max(total, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm))


class Shard:
    """Impact-sorted lists of some documents: a run of ``places`` and ``adds`` for each term."""

    def __init__(self, places: np.ndarray, terms: np.ndarray, adds: np.ndarray, width: int, vocabulary: int):
        order = np.lexsort((places, -adds, terms))
        self.places, self.adds, self.width = places[order], adds[order], width
        self.begin = np.searchsorted(terms[order], np.arange(vocabulary + 1))

    def nra(self, terms: list[int], top: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all documents that may be among the ``top`` best, ties with the last one included, of
        those with a score of at least ``floor`` and above 0.

        Rounds of sorted reads, the same depth in each list. A document's lower bound is what was read of it; its upper
        bound adds, for each list it was not met in, the last value read there. Reading stops when no document not
        yet met, and no met one whose interval is open, can reach the ``top``-th best lower bound: then membership,
        ties and scores are settled.
        """
        begin = np.array([self.begin[t] for t in terms], np.int64)
        end = np.array([self.begin[t + 1] for t in terms], np.int64)
        lower = np.zeros(self.width, np.int64)
        met = np.zeros((len(terms), self.width), bool)
        at, depth = begin.copy(), FIRST_DEPTH
        while True:
            ahead = np.zeros(len(terms), np.int64)  # the most an unread entry of each list can add
            for i in range(len(terms)):
                stop = min(begin[i] + depth, end[i])
                seen = self.places[at[i]:stop]
                lower[seen] += self.adds[at[i]:stop]
                met[i, seen] = True
                at[i] = stop
                if stop < end[i]:
                    ahead[i] = self.adds[stop - 1]
            bar = max(int(np.partition(lower, -top)[-top]) if self.width >= top else 0, floor, 1)
            unmet = int(ahead.sum())
            if unmet < bar:  # documents not met at all cannot come in any more
                wanted = np.flatnonzero(lower + unmet >= bar)
                upper = lower[wanted] + unmet - ahead @ met[:, wanted]
                wanted, upper = wanted[upper >= bar], upper[upper >= bar]
                if (upper == lower[wanted]).all():
                    return wanted, lower[wanted]
            depth *= 2


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_col``, rank, ``id_col``, score: for each item its ``top`` documents of the highest score above 0.

    A first pass counts, for the items' terms, the documents that hold them, and sums documents and terms (partial
    counts per task). The second builds impact-sorted lists of the items' terms over shards of at most
    ``SHARD_DOCS`` documents and reads them by :meth:`Shard.nra`; the best found so far in the task raise the bar for
    its later shards. A task returns at most ``top`` rows an item, and a window ranks them. Postings are never shuffled.
    Items are taken in blocks of about ``BLOCK_BYTES`` of text, by hash of their id, each searched against all documents.

    Edge cases: null and empty texts have no terms and are not found; an item without terms has no rows; rows of
    ``items`` with one id are one item of all their terms; null item ids are an item of their own; every row of ``docs``
    is a document, repeated ids included; a null id is returned and comes first among ties; equal scores go by
    ascending id; empty tables give no rows; other columns are ignored whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    items = items.select(F.col(item_col).alias("_item"), text_or_empty(item_text).alias("_text"))
    size = items.agg(F.sum(F.octet_length("_text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block) if blocks > 1 else items
        terms: dict = {}
        for item, text in part.toLocalIterator():
            terms.setdefault(item, set()).update(terms_of(text))
        rows = _search_block(docs, terms, items.schema["_item"].dataType.simpleString(), top)
        found = rows if found is None else found.unionByName(rows)
    return found.select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")


def _search_block(docs: DataFrame, items: dict, kind: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted(set().union(*items.values())))}
    width = len(number)
    vocabulary = spark.sparkContext.broadcast(number)

    def count(batches):
        """(term, documents that hold it); behind the terms: documents with a term, and all their terms."""
        get = vocabulary.value.get
        held = np.zeros(width + 2, np.int64)
        for b in batches:
            for text in b.column(0):
                words = terms_of(text.as_py())
                if words:
                    held[list({i for i in map(get, words) if i is not None})] += 1
                    held[width:] += 1, len(words)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 2)), pa.array(held)], ["term", "n"])

    counts = dict(docs.select("_text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    documents, total = counts.get(width, 0), counts.get(width + 1, 0)
    weights = np.array([weight_of(documents, counts.get(i, 0)) for i in range(width)], np.int64)
    wanted = {k: sorted(number[t] for t in ts if weights[number[t]] > 0) for k, ts in items.items()}
    plan = spark.sparkContext.broadcast(([(k, ts) for k, ts in wanted.items() if ts], weights))
    keys = pa.array([k for k, ts in wanted.items() if ts])

    def run(batches):
        get = vocabulary.value.get
        queries, weight = plan.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries)
        idents, sizes, places, terms, tfs = [], [], [], [], []
        postings = 0

        def flush():
            ids = np.array([NO_ID if i is None else i for i in idents], np.int64)
            none = np.array([i is None for i in idents], bool)
            place, term = np.concatenate(places), np.concatenate(terms)
            adds = impacts(weight[term], np.concatenate(tfs), np.array(sizes, np.int64)[place], documents, total)
            shard = Shard(place, term, adds, len(idents), width)
            for q, (_, wanted) in enumerate(queries):
                old = best[q]
                at, score = shard.nra(wanted, top, int(old[1][top - 1]) if len(old[1]) >= top else 0)
                if len(at):
                    every = [np.concatenate(x) for x in zip(old, (ids[at], score, none[at]), strict=True)]
                    order = np.lexsort((~every[2], every[0], -every[1]))
                    # ids order the ties, null ids first
                    best[q] = tuple(x[order][:top] for x in every)
            for column in (idents, sizes, places, terms, tfs):
                column.clear()

        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(text.as_py())
                known = [i for i in map(get, words) if i is not None]
                if known:
                    term, tf = np.unique(np.array(known, np.int64), return_counts=True)
                    places.append(np.full(len(term), len(idents), np.int64))
                    terms.append(term)
                    tfs.append(tf.astype(np.int64))
                    idents.append(ident)
                    sizes.append(len(words))
                    postings += len(term)
                if len(idents) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    flush()
                    postings = 0
        if idents:
            flush()
        found = [q for q, x in enumerate(best) if len(x[0])]
        if found:
            lengths = [len(best[q][0]) for q in found]
            ids, scores, none = (np.concatenate([best[q][i] for q in found]) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(found, lengths), pa.int32()), pa.array(ids, mask=none), pa.array(scores)],
                ["query", "_id", "score"])

    hits = docs.mapInArrow(run, "query int, _id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("_id").asc_nulls_first())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(keys)), pa.int32()), "_item": keys.cast(
        keys.type if len(keys) else pa.int64())}))
    return ranked.join(F.broadcast(names), "query").select(F.col("_item").cast(kind), "rank", "_id", "score")


def oracle_sql(top: int = 50) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(text, '{upper}', '{upper.lower()}')"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
t AS (SELECT row, doc_id, unnest(regexp_extract_all({lowered}, '{term}')) AS term FROM d),
p AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY row, doc_id, term),
n AS (SELECT row, sum(tf)::BIGINT AS n FROM p GROUP BY row),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lowered}, '{term}')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
      FROM p, g WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT item_id, row, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (row), g GROUP BY item_id, row, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {top}
"""


pickle_by_value(__name__)
