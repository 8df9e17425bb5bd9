"""Whitening by Golub-Kahan-Lanczos bidiagonalisation.

The distinct vectors are packed into blocks and stored once. Each step is one Spark pass: a
task multiplies its centred rows with a direction (Xv), and its share of the result back with
the rows and with all earlier left vectors (X'u, U'u); Spark adds the shares. The driver keeps
vectors as long as the dimension only. A left vector has an entry per row, so it is never
stored: it is Xy for a vector y that the driver keeps. Left and right vectors are made
orthogonal to all earlier ones in every step; the singular values and vectors of the small
bidiagonal matrix give deviations and components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, ship_code, stored

COMPONENTS = 4
SCALE = 256
# Up to so many dimensions, steps go on until the space is spanned, which finds equal
# eigenvalues too; beyond, until the wanted components have converged.
MOST_STEPS = 256
CONVERGED = 1e-14
# Smaller than this against the largest, a length is rounding, and a direction is at its end.
ROUNDING = 1e-13
# Rows of a packed block, and the memory it may take.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
# Exact sums and squares above this are done with integers of any size.
EXACT = 2**62

BLOCKS = "rows long, dimension long, x binary"


def _matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    """Rows of integers; entries that a row lacks are 0."""
    out = np.zeros((len(lists), dimension), np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _pack(dimension: int):
    rows_at_once = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dimension, 1))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_pieces(batches, rows_at_once):
            x = _matrix(part.column("x"), dimension)
            columns = [pa.array([len(x)], pa.int64()), pa.array([dimension], pa.int64()), pa.array([x.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rows", "dimension", "x"])

    return pack


def _read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for rows, dimension, x in zip(*(batch.column(c).to_pylist() for c in ("rows", "dimension", "x")), strict=True):
        yield np.frombuffer(x, np.int64).reshape(rows, dimension)


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each dimension, exact: a row per dimension and task."""
    total = None
    for batch in batches:
        for x in _read(batch):
            small = x.size == 0 or int(np.abs(x.astype(np.float64)).max()) * len(x) < EXACT
            part = x.sum(0).tolist() if small else [sum(column) for column in x.T.tolist()]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
    if total:
        values = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), values], ["place", "value"])


def _added(blocks: DataFrame, share) -> np.ndarray:
    """The sum over all blocks of ``share(x)``, a short vector: a row per entry and task is shuffled."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _read(batch):
                part = share(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "value"])

    summed = blocks.select("rows", "dimension", "x").mapInArrow(told, "place int, value double")
    rows = summed.groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for row in rows:
        out[row["place"]] = row["value"]
    return out


def bidiagonal(blocks: DataFrame, mean: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (rows) and singular values of the centred rows, largest first.

    One pass over the rows a step. Where a direction ends (its left or right vector is
    rounding only), the search goes on from a random direction that is orthogonal to all.
    """
    dimension = len(mean)
    chance = np.random.default_rng(13)
    right, left, back = (np.zeros((0, dimension)) for _ in range(3))  # v, y with u = Xy, and X'u
    alphas, betas = [], []
    largest = 0.0

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right.T @ (right @ v)
        return v

    def fresh() -> np.ndarray:
        v = orthogonal(chance.standard_normal(dimension))
        return orthogonal(v / np.linalg.norm(v))

    v = fresh()
    v /= np.linalg.norm(v)
    while True:
        beta = betas[-1] if betas else 0.0
        t = v - beta * left[-1] if len(left) else v
        earlier = left

        def share(x: np.ndarray) -> np.ndarray:
            z = x - mean
            u = z @ t
            return np.concatenate([(z @ earlier.T).T @ u, [u @ u], z.T @ u])

        got = _added(blocks, share)
        # The share of earlier left vectors goes, here and in what X' makes of the rest.
        known, norm2, product = got[: len(left)], got[len(left)], got[len(left) + 1 :]
        t = t - left.T @ known
        product = product - back.T @ known
        alpha = np.sqrt(max(norm2 - known @ known, 0.0))
        largest = max(largest, alpha)
        if alpha <= ROUNDING * largest:
            alpha, t, product = 0.0, np.zeros(dimension), np.zeros(dimension)
        else:
            t, product = t / alpha, product / alpha
        right, left, back = np.vstack([right, v]), np.vstack([left, t]), np.vstack([back, product])
        alphas.append(alpha)
        v = orthogonal(product - alpha * v)
        beta = np.linalg.norm(v)
        largest = max(largest, beta)
        ended = beta <= ROUNDING * largest
        matrix = np.diag(alphas) + np.diag(betas, 1)
        if len(right) == dimension:
            break
        if len(right) >= MOST_STEPS:
            p, values, _ = np.linalg.svd(matrix)
            if (beta * np.abs(p[-1, :count]) <= CONVERGED * max(values[0], 1e-300)).all():
                break
        if ended:
            v, beta = fresh(), 0.0
            v /= np.linalg.norm(v)
        else:
            v = orthogonal(v / beta)
            v /= np.linalg.norm(v)
        betas.append(beta)
    _, values, turned = np.linalg.svd(matrix)
    return turned @ right, values


def _whiten(total: int, sums: list[int], components: np.ndarray, roots: np.ndarray):
    """Deviation and whitened coordinates of rows; ``x`` is exact, and so is ``total * x - sums``."""
    dimension, mean = len(sums), np.array([s / total for s in sums])

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = max(map(abs, sums), default=0)
        for part in in_pieces(batches, max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dimension, 1))))):
            x = _matrix(part.column("_x"), dimension)
            reach = total * int(np.abs(x.astype(np.float64)).max() if x.size else 0) + bound + 1
            if reach < EXACT and reach * reach * dimension < EXACT:
                z = total * x - np.array(sums, np.int64)
                deviations = pa.array((z * z).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                rows = [sum((total * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
                deviations = pa.array([Decimal(d) if d < 10**38 else None for d in rows], pa.decimal128(38, 0))
            white = ((x - mean) @ components.T) / roots
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1) * len(roots), white.ravel())
            yield pa.RecordBatch.from_arrays([part.column("_id"), deviations, lists], ["_id", "deviation", "_white"])

    return whiten


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Rows whitened: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    An entry c counts as ``floor(256 c)``, a long (the nearest one, if it is none). The fit is
    on each distinct vector once; every row that takes part is whitened, repeated rows and
    rows without an id as well. Vectors that are null or hold null or non-finite entries take
    no part; a vector that is shorter than the longest counts as 0 in the entries it lacks.
    Components are as many as ``count``, but only those of a deviation above rounding: one
    vector alone, or an empty table, gives no rows. ``deviation`` is exact, a decimal of 38
    digits (null beyond). Other columns are not read.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    there = F.col(f"`{vector}`").isNotNull() & F.forall(
        F.col(f"`{vector}`"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    scaled = F.transform(F.col(f"`{vector}`"), lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.filter(F.coalesce(there, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("_id"), scaled.alias("_x"))
    nothing = spark.createDataFrame([], f"`{key}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    dimension = rows.agg(F.max(F.size("_x"))).first()[0]
    if not dimension:
        return nothing
    # Vectors that differ only in zeros at their end are one vector.
    padded = F.concat("_x", F.array_repeat(F.lit(0).cast("long"), F.lit(dimension) - F.size("_x"))).alias("x")
    blocks = stored(rows.select(padded).distinct().mapInArrow(_pack(dimension), BLOCKS), "whitening-fit")
    total = blocks.agg(F.sum("rows")).first()[0]
    exact = blocks.mapInArrow(_exact_sums, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value"))
    sums = [int(row["value"]) for row in sorted(exact.collect(), key=lambda row: row["place"])]
    mean = np.array([s / total for s in sums])

    found, values = bidiagonal(blocks, mean, count)
    used = int((values[:count] > ROUNDING * 10 * max(values[0], 1e-300)).sum())
    if not used:
        return nothing
    components, roots = found[:used], values[:used] / np.sqrt(total)

    def spread(x: np.ndarray) -> np.ndarray:
        z = x - mean
        white = (z @ components.T) / roots
        return np.concatenate([[(z * z).sum()], (white.T @ white).ravel(), white.sum(0)])

    got = _added(blocks, spread)
    centre = got[1 + used * used :] / total
    error = float(np.abs(got[1 : 1 + used * used].reshape(used, used) / total - np.outer(centre, centre) - np.eye(used)).max())
    explained = [float(e) for e in roots**2 / (got[0] / total)]

    white = rows.mapInArrow(_whiten(total, sums, components, roots), "_id long, deviation decimal(38,0), _white array<double>")
    one = white.select("_id", "deviation", F.posexplode("_white").alias("_place", "whitened"))
    return one.select(
        F.col("_id").alias(key),
        (F.col("_place") + 1).alias("component"),
        F.lit(total).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*map(F.lit, explained)), F.col("_place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The first four whitened coordinates of every row of ``embeddings``; a deviation beyond a long is null."""
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
