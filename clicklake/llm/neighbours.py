"""Nearest neighbours by inner product through a permutation index.

A vector is represented by its nearest pivots in order. Each block of vectors posts them in
the inverted files of these pivots, with the place that the pivot has; a query adds up its
pivots' lists to the footrule distance of every posted vector, and the share of them that is
nearest by it is ranked by the true inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import buckets_for, ship_code

NEAREST = 20
PIVOTS = 512
PREFIX = 96
# Fitting: vectors at most, queries at most, vectors a pivot at least, and the part of true
# neighbours that the reranked share must hold.
SAMPLE, SAMPLE_QUERIES, ROWS_PER_PIVOT, REACH = 4096, 256, 4, 0.95
BLOCK, QUERY_BLOCK = 16384, 16384
# Vectors that are held against all pivots at once.
ORDERED_AT_ONCE = 2048


def _lifted(vectors: np.ndarray, length: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the norm ``length``.

    The nearest of the lifted vectors to a query is then the one of largest inner product.
    """
    rest = np.maximum(length**2 - np.einsum("ij,ij->i", vectors, vectors), 0)
    return np.hstack([vectors, np.sqrt(rest)[:, None]])


def prefixes(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first; ties to the first pivot."""
    half = 0.5 * np.einsum("ij,ij->i", pivots, pivots)
    orders = np.empty((len(vectors), prefix), np.int16)
    for start in range(0, len(vectors), ORDERED_AT_ONCE):
        part = slice(start, start + ORDERED_AT_ONCE)
        orders[part] = np.argsort(half - vectors[part] @ pivots.T, axis=1, kind="stable")[:, :prefix]
    return orders


class InvertedFiles:
    """Posting lists of a block: for each pivot the vectors that have it, and at which place."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.rows, self.prefix = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.vectors = (by_pivot // self.prefix).astype(np.int32)
        # What a place is worth to a query that has the pivot no later.
        self.worth = (self.prefix - by_pivot % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """The footrule distance of one query's prefix to all vectors; absent pivots stand last.

        A vector that shares no pivot has the largest distance, prefix * (prefix + 1); one at
        places a and b takes 2 * (prefix - max(a, b)) from it.
        """
        shared = np.zeros(self.rows, np.int32)
        for place, pivot in enumerate(order):
            part = slice(self.starts[pivot], self.starts[pivot + 1])
            shared[self.vectors[part]] += np.minimum(self.worth[part], self.prefix - place)
        return self.prefix * (self.prefix + 1) - 2 * shared


def nearest_share(distances: np.ndarray, share: float, least: int) -> np.ndarray:
    """The rows of the smallest distances: the share of them, ``least`` at least, and all ties of the last."""
    wanted = max(least, int(np.ceil(share * len(distances))))
    if wanted >= len(distances):
        return np.arange(len(distances))
    return np.flatnonzero(distances <= np.partition(distances, wanted - 1)[wanted - 1])


def fit(vectors: np.ndarray, length: float, rows: int, nearest: int, pivots: int, prefix: int) -> dict:
    """Pivots and the share to rerank, from a sample of at most ``SAMPLE`` vectors.

    The first vectors of the sample are the pivots, one for ``ROWS_PER_PIVOT`` of it at most.
    The share is the least that holds ``REACH`` of the sample's true neighbours of its last
    vectors, as many of each as ``nearest`` of all ``rows`` come to in the sample.
    """
    lifted = _lifted(vectors, length)
    chosen = lifted[: max(1, min(pivots, len(lifted) // ROWS_PER_PIVOT))]
    prefix = min(prefix, len(chosen))
    queries = vectors[-SAMPLE_QUERIES:]
    few = min(max(1, -(-nearest * len(vectors) // max(rows, 1))), max(1, len(vectors) - 1))
    files = InvertedFiles(prefixes(lifted, chosen, prefix), len(chosen))
    orders = prefixes(np.hstack([queries, np.zeros((len(queries), 1))]), chosen, prefix)
    scores = queries @ vectors.T
    first = len(vectors) - len(queries)
    shares = []
    for number, order in enumerate(orders):
        others = np.arange(len(vectors)) != first + number
        best = np.argsort(-scores[number][others], kind="stable")[:few]
        distances = files.footrule(order)[others]
        # A neighbour is reached by the share of all rows that are strictly nearer, and itself.
        shares.append((np.searchsorted(np.sort(distances), distances[best]) + 1) / max(len(distances), 1))
    share = float(np.quantile(np.concatenate(shares), REACH, method="higher"))
    return {"pivots": chosen, "prefix": prefix, "share": share, "length": length}


RESULT = "query_id long, vec_id long, score double"


def _search(index: dict, nearest: int):
    """The search of one block of queries in one block of vectors."""

    def search(rows: pa.Table) -> pa.Table:
        vectors = np.asarray(rows["_vector"].combine_chunks().flatten(), np.float64).reshape(len(rows), -1)
        ids = rows["_id"].to_numpy()
        asks = rows["_asks"].to_numpy(zero_copy_only=False).astype(bool)
        queries, query_ids, vectors, ids = vectors[asks], ids[asks], vectors[~asks], ids[~asks]
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            pivots, prefix = index["pivots"], index["prefix"]
            files = InvertedFiles(prefixes(_lifted(vectors, index["length"]), pivots, prefix), len(pivots))
            orders = prefixes(np.hstack([queries, np.zeros((len(queries), 1))]), pivots, prefix)
            for query, own, order in zip(queries, query_ids, orders, strict=True):
                # Rows of the query's own id are out of the way behind all others.
                distances = files.footrule(order)
                distances[ids == own] = np.iinfo(np.int32).max
                near = nearest_share(distances, index["share"], nearest)
                near = near[ids[near] != own]
                scores = np.einsum("ij,j->i", vectors[near], query)
                best = np.lexsort((ids[near], -scores))[:nearest]
                out["query_id"].append(np.full(len(best), own))
                out["vec_id"].append(ids[near][best])
                out["score"].append(scores[best])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({name: np.concatenate(parts or [np.empty(0, kinds[name])]) for name, parts in out.items()})

    return search


def nearest(
    vectors: DataFrame,
    query: str,
    key: str = "vec_id",
    vector: str = "embedding",
    count: int = NEAREST,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
) -> DataFrame:
    """The ``count`` nearest rows found for each row that ``query`` (a condition) selects.

    Gives ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the inner product in
    double precision; ties go to the smaller id. Rows of the query's own id are not its
    candidates; repeated rows each are candidates, and repeated queries ask once. Rows
    without an id, and vectors that are null, zero, or hold null or non-finite components,
    take no part. Vectors of each length are searched by themselves: a query's neighbours
    have as many components as it has. An empty table gives an empty result. Of each block the
    share of vectors nearest by footrule is ranked by inner product, ``count`` of them at least,
    and all that are as near as the last.

    The index holds every row; its pivots and the share are fitted on ``SAMPLE`` rows of the
    length. The queries meet all rows in blocks: a task has ``BLOCK`` vectors and ``QUERY_BLOCK``
    queries. Rows are dealt by a hash of id and vector, so equal vectors spread.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    finite = F.forall(F.col("_vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = F.coalesce(F.expr(query), F.lit(False))
    # Single precision is widened where it is used, and moves as it is.
    single = vectors.schema[vector].dataType == ArrayType(FloatType(), vectors.schema[vector].dataType.containsNull)
    given = F.col(vector) if single else F.col(vector).cast("array<double>")
    all_rows = vectors.select(
        F.col(key).cast("long").alias("_id"), given.alias("_vector"), asked.alias("_asked")
    ).filter(F.col("_id").isNotNull() & finite & F.exists(F.col("_vector"), lambda x: x != 0))
    hashed = F.xxhash64("_id", "_vector")
    norm = F.sqrt(F.aggregate(F.col("_vector").cast("array<double>"), F.lit(0.0), lambda total, x: total + x * x))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(hashed, F.lit(n)).cast("int")
    # A search for each length that vectors have, so that a stray one takes no other's place.
    counted = all_rows.groupBy(F.size("_vector").alias("_size")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(norm).alias("longest"), F.count_if(F.col("_asked")).alias("asked")
    )
    found = spark.createDataFrame([], RESULT)
    for facts in counted.filter("rows > 1 AND asked > 0").orderBy("_size").collect():
        rows = all_rows.filter(F.size("_vector") == facts["_size"])
        sample = rows.select("_vector", hashed.alias("_hash")).orderBy("_hash").limit(SAMPLE).collect()
        index = fit(np.array([row["_vector"] for row in sample]), facts["longest"], facts["rows"], count, pivots, prefix)
        queries = rows.filter("_asked").dropDuplicates(["_id", "_vector"])
        blocks, query_blocks = buckets_for(facts["rows"], BLOCK), buckets_for(facts["asked"], QUERY_BLOCK)
        posted = rows.select("_id", "_vector", F.lit(False).alias("_asks"), part(blocks).alias("_block"), all_of(query_blocks).alias("_queries"))
        asking = queries.select("_id", "_vector", F.lit(True).alias("_asks"), all_of(blocks).alias("_block"), part(query_blocks).alias("_queries"))
        together = posted.unionByName(asking).groupBy("_block", "_queries")
        found = found.unionByName(together.applyInArrow(_search(index, count), RESULT))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` for each row whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
