"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the inverted files of its first pivots; a query
reads the files of its own first pivots, takes each vector in the first of them that holds it, ranks by the footrule
distance of the two orders, and only what lies within the query's footrule cut is scored on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentry.llm.common import checkpointed
from incidentry.session import pickle_by_value

#: Vectors and queries of one cell of an inverted file; larger files are split into blocks of about this many.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024
#: Pivots of small tables and at most; between, they grow with the square root of the table.
FEWEST_PIVOTS, MOST_PIVOTS = 256, 1024
#: Pivot number of the file that holds every vector, for queries that found too few.
EVERY = -1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec array<double>) of rows with an id and a finite non-zero vector of the most common length."""
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & vec.isNotNull() & F.exists(vec, lambda x: x != 0.0) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).dropDuplicates()
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (common.n if common else 0))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with one more component that brings all to the largest norm (squared: ``largest``). A query's is 0, so
    inner products stay as they are, and the largest is then also the smallest angle."""
    return np.column_stack((vectors, np.sqrt(np.maximum(0.0, largest - (vectors * vectors).sum(1)))))


def pivot_orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` pivots of largest inner product, nearest first, ties to the smaller number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix].astype("<u2")


def footrule(ranks: np.ndarray, order: np.ndarray, columns=slice(None)) -> np.ndarray:
    """Footrule distance, up to a constant, of each vector's order to ``order``. ``ranks`` (pivots x vectors) has the
    place of a pivot in a vector's order; pivots that are not in it count as just after its end. Of ``columns`` alone."""
    got = ranks[order] if isinstance(columns, slice) else ranks[np.ix_(order, columns)]
    places = np.arange(len(order), dtype=np.int16)[:, None]
    return (np.abs(got - places) + got).sum(0, dtype=np.int32)


def order_ranks(orders: np.ndarray, pivots: int) -> np.ndarray:
    """(pivots x vectors): the place of a pivot in a vector's order, the order's length for pivots that are not in it."""
    ranks = np.full((pivots, len(orders)), orders.shape[1], np.int16)
    ranks[orders, np.arange(len(orders))[:, None]] = np.arange(orders.shape[1], dtype=np.int16)
    return ranks


def pivots_for(rows: int) -> int:
    return int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, round(2.5 * rows ** 0.5))))


def files_for(pivots: int) -> int:
    """Files a vector is posted in: they grow slower than the pivots, so a query reads a smaller share of larger tables."""
    return max(16, int(np.ceil(0.75 * pivots ** 0.5)))


def survivors(ranks: np.ndarray, order: np.ndarray, file: int, posted: int, cut: float) -> np.ndarray:
    """Vectors of the inverted file ``file`` that a query with ``order`` scores: those posted in none of the files it
    reads before this one, within ``cut`` by footrule."""
    if file == EVERY:
        return np.arange(ranks.shape[1])
    before = order[:int(np.flatnonzero(order == file)[0])]
    pick = np.flatnonzero((ranks[before] >= posted).all(axis=0))
    return pick[footrule(ranks, order, pick) <= cut]


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
            pivots: int | None = None, prefix: int = 128, posted: int | None = None, share: float = 0.2) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` found nearest each row of ``queries`` (same
    columns), by largest inner product in double precision, ties to the smaller id, the query's own id left out.

    Pivot orders are those of the vectors lifted to one norm, so that they follow the inner product, not the angle alone.
    The index is fitted on a documented, bounded sample, the rows of the smallest hashes of their ids, brought to the
    driver: ``pivots`` vectors (``pivots_for`` the table: 256 to 1024) and as many more to set the cuts by. Every vector
    is indexed. Each is posted under its first ``posted`` pivots (``files_for`` the pivots) and a query reads the files of
    its own first ``posted`` pivots. Its footrule cut is the ``share`` quantile of its distances to the further sample, so
    about that share of the table, less what the files leave out, can be scored; products are taken of nothing else.
    Files of frequent pivots are split into blocks of about ``BLOCK_VECTORS`` vectors by ``BLOCK_QUERIES`` queries, so a
    cell is bounded whatever the skew, and a cell gives at most ``k`` rows a query. A query that found fewer than ``k``
    (nor all) is compared with every vector, in the same blocks.

    Edge cases: rows without an id and vectors that are null, empty, zero, of another length than most, or hold null
    or non-finite components take no part; rows repeated alike count once; an id with several vectors is one candidate
    with the best of their scores, and as a query it asks with each of them and is answered once; fewer than ``k`` candidates give all of
    them; empty tables give no rows; other columns are ignored whatever their names.
    """
    valid = usable(vectors, id_col, vector_col)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id")).distinct()
    pivots = pivots or pivots_for(valid.count())
    sample = valid.orderBy(F.xxhash64("id"), "id", F.xxhash64("vec")).limit(2 * pivots).collect()
    largest = valid.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    centres = lifted(np.array([r.vec for r in sample], dtype=np.float64).reshape(len(sample), -1), largest) if (
        sample) else np.zeros((0, 1))
    centres = centres[np.sort(np.unique(centres, axis=0, return_index=True)[1])]  # copies of a vector are one pivot
    centres, others = centres[:pivots], centres[pivots:]
    prefix, posted = min(prefix, len(centres)), min(posted or files_for(len(centres)), len(centres))
    others = order_ranks(pivot_orders(others if len(others) else centres, centres, prefix), len(centres))

    def index(batches):
        for b in batches:
            if not len(b):
                continue
            vec = matrix(b.column(1))
            orders = [pivot_orders(lifted(vec, largest), centres, prefix),
                      pivot_orders(vec, centres[:, :-1], prefix)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.tobytes() for x in vec], pa.binary()),
                 *[pa.array([x.tobytes() for x in o], pa.binary()) for o in orders],
                 *[pa.array(o[:, :posted].astype(np.int32).tolist(), pa.list_(pa.int32())) for o in orders]],
                ["id", "vec", "perm", "asked_perm", "files", "asked_files"])

    built = checkpointed(valid.mapInArrow(index, "id long, vec binary, perm binary, asked_perm binary, "
                                                 "files array<int>, asked_files array<int>"))
    indexed = built.select("id", "vec", "perm", "files")
    total = indexed.select("id").distinct().count()
    probes = built.join(asked, F.col("id") == F.col("query_id"), "left_semi").select(
        "id", "vec", F.col("asked_perm").alias("perm"), F.col("asked_files").alias("files"))
    found = _search(indexed.withColumn("file", F.explode("files")), probes.withColumn("file", F.explode("files")),
                    k, posted, share, others)
    best = checkpointed(_best(found, k))
    counts = best.groupBy(F.col("query_id").alias("q")).count()
    short = checkpointed(probes.join(counts.where(F.col("count") >= min(k, total - 1)), F.col("id") == F.col("q"),
                                     "left_anti"))
    if total > 1 and not short.isEmpty():
        every = _search(indexed.withColumn("file", F.lit(EVERY)), short.withColumn("file", F.lit(EVERY)),
                        k, posted, share, others)
        best = _best(best.drop("rank").unionByName(every), k)
    return best.select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k))


def may_be_best(rough: np.ndarray, norms: np.ndarray, dimension: int, k: int) -> np.ndarray:
    """Which products may be among the ``k`` best once computed exactly, copies of one vector all alike: those that
    reach the k-th within the rounding noise of a BLAS product, which grows with the two vectors' ``norms``
    (multiplied) and the dimension."""
    noise = 1e-12 * dimension * norms
    lowest = rough - noise
    return rough + noise >= np.partition(lowest, len(lowest) - k)[len(lowest) - k]


def _search(postings: DataFrame, probes: DataFrame, k: int, posted: int, share: float, others: np.ndarray) -> DataFrame:
    """Rows (query_id, vec_id, score) of all cells (file, block of vectors, block of queries). ``others``: the pivots'
    places in the orders of the further sample."""
    def blocks(rows, size):
        counts = {r.file: -(-r["count"] // size) for r in rows.groupBy("file").count().collect()}  # a row per pivot
        table = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]) if counts else F.lit(None).cast(
            "map<int,int>")
        return F.coalesce(table[F.col("file")], F.lit(1))

    vector_blocks, query_blocks = blocks(postings, BLOCK_VECTORS), blocks(probes, BLOCK_QUERIES)

    def own(n):
        return F.pmod(F.xxhash64("id"), n).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    cells = ["file", "vblock", "qblock"]
    left = postings.select("file", own(vector_blocks).alias("vblock"), each(query_blocks).alias("qblock"),
                           "id", "vec", "perm")
    right = probes.select("file", each(vector_blocks).alias("vblock"), own(query_blocks).alias("qblock"),
                          "id", "vec", "perm").toDF("q_file", "q_vblock", "q_qblock", "q_id", "q_vec", "q_perm")

    def cell(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(vectors) and len(queries):
            vectors = vectors.sort_by("id")
            ids, file = np.asarray(vectors["id"].combine_chunks()), vectors["file"][0].as_py()
            vec, perm = _unpack(vectors["vec"], vectors["perm"])
            ranks = order_ranks(perm, len(others))
            asked = np.asarray(queries["q_id"].combine_chunks())
            query_vec, query_perm = _unpack(queries["q_vec"], queries["q_perm"])
            norms, asked_norms = np.linalg.norm(vec, axis=1), np.linalg.norm(query_vec, axis=1)
            repeated = len(ids) > 1 and bool((ids[1:] == ids[:-1]).any())
            for query, order, ident, norm in zip(query_vec, query_perm, asked, asked_norms, strict=True):
                pick = survivors(ranks, order, file, posted, np.quantile(footrule(others, order), share))
                pick = pick[ids[pick] != ident]
                kept = vec[pick]
                if len(pick) > k and not repeated:
                    best = may_be_best(kept @ query, norms[pick] * norm, vec.shape[1], k)
                    pick, kept = pick[best], kept[best]
                score = (kept * query).sum(axis=1)
                top = np.lexsort((ids[pick], -score))
                if repeated:  # an id's best vector alone
                    top = top[np.sort(np.unique(ids[pick[top]], return_index=True)[1])]
                top = top[:k]
                out[0].append(np.full(len(top), ident))
                out[1].append(ids[pick[top]])
                out[2].append(score[top])
        joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)),
                         "score": pa.array(joined[2].astype(np.float64))})

    return left.groupBy(*cells).cogroup(right.groupBy("q_file", "q_vblock", "q_qblock")).applyInArrow(
        cell, "query_id long, vec_id long, score double")


def _unpack(vec, perm) -> tuple[np.ndarray, np.ndarray]:
    n = len(vec)
    return (np.frombuffer(b"".join(vec.to_pylist()), "<f8").reshape(n, -1),
            np.frombuffer(b"".join(perm.to_pylist()), "<u2").reshape(n, -1).astype(np.int64))


pickle_by_value(__name__)
