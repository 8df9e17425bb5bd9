"""Mixing sources to target weights with a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, documents, running_sum, stored, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK = 64
SLOTS_PER_BUCKET = 4096
GOLDEN = 0.6180339887498949
# The fraction of 2^26 times the golden ratio: points of large slot numbers lose no digits.
FAR, FAR_GOLDEN = 2**26, 0.8983942233824622
# Lengths are added up in parts of this many key values, the first 24 bits of a hash.
KEYS = 2**24


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """The words that each source should give, as ``target``; ``number`` counts the sources.

    ``sources`` has ``source`` and ``source_size``, a row per source. Sources in code-point
    order, null last, weigh ``weights`` in turn and share the sum of all sizes. None gives
    more than ``most`` times its size; the excess goes to the others by weight. Level by
    level, the share of one unit of weight is the largest of what is left for the sources
    from some point on, in order of size by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    numbered = sources.withColumn("number", (F.row_number().over(by_name) - 1).cast("long"))
    weighed = numbered.withColumn(
        "_weight", F.element_at(table, (F.col("number") % len(weights) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "number")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    left = F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    levels = weighed.withColumn("_all", F.sum("source_size").over(whole)).withColumn(
        "_level", left / F.sum("_weight").over(after)
    )
    share = F.max("_level").over(whole) * F.col("_weight")
    return levels.withColumn("target", F.least(F.col("_cap"), share).cast("double")).drop("_all", "_level", "_cap", "_weight")


def schedule(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """Slots dealt to sources in proportion to their targets: ``number``, ``rank``.

    Slot t stands at the golden-ratio point frac((t + 1/2) / phi), which is mapped through
    the cumulative targets; it is computed from the upper and lower bits of t apart, so that
    points stay spread over 10^15 slots; ``rank`` counts the slots of a source from 0. Any run of slots
    has each source close to its share. Points find their source by the cell of [0, 1)
    that both fall into.
    """
    in_order = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    low = F.coalesce(F.sum("target").over(in_order), F.lit(0.0)) / F.sum("target").over(whole)
    spans = (
        sources.filter("target > 0")
        .withColumn("_low", low)
        .withColumn("_high", F.coalesce(F.lead("_low").over(Window.orderBy("number")), F.lit(1.0)))
        .withColumn("_cells", F.greatest(F.lit(64), 4 * F.count(F.lit(1)).over(whole)))
    )
    cells = spans.select(
        "number",
        "_low",
        "_high",
        F.explode(
            F.sequence(
                F.floor(F.col("_low") * F.col("_cells")),
                F.least(F.floor(F.col("_high") * F.col("_cells")), F.col("_cells") - 1),
            )
        ).alias("_cell"),
    )
    count = spans.select(F.max("_cells")).first()[0]
    if count is None:
        return spark.createDataFrame([], "number long, rank long")
    far = F.call_function("div", F.col("id"), F.lit(FAR)) * F.lit(FAR_GOLDEN)
    point = far - F.floor(far) + (F.col("id") % FAR + 0.5) * GOLDEN
    points = spark.range(slots).withColumn("_point", point - F.floor(point))
    points = points.withColumn("_cell", F.floor(F.col("_point") * count))
    dealt = points.join(cells, "_cell").filter("_low <= _point AND _point < _high")
    dealt = dealt.select("number", "id", F.call_function("div", F.col("id"), F.lit(SLOTS_PER_BUCKET)).alias("_bucket"))
    return running_sum(dealt, ["number"], "_bucket", ["id"], F.lit(1), "rank").select("number", "rank")


def _hex_key(key: Column, text: Column) -> Column:
    """A hash in hex as text; rows are shuffled by sorting on it, and those of one key spread."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.md5(name.cast("binary"))


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_REPEATS,
    block: int = BLOCK,
) -> DataFrame:
    """How many words of each document the mix takes.

    Gives ``key``, ``size``, ``source_size``, ``target`` and ``taken`` (long), a row per
    row of ``docs``. A source's documents are shuffled by the hash of their key and text and
    laid end to end; the words are cut into blocks of ``block``. The slots of the schedule
    that fall to a source take its blocks in turn, again from the first after the last,
    ``most`` times at most. A null or empty text has size 0 and nothing is taken of it;
    null sources are one source, the last; rows that are alike count each; an empty table
    gives an empty result.
    """
    sized = stored(
        docs.select(
            F.col(key).alias("_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            _hex_key(F.col(key), F.col(text)).alias("_key"),
        ),
        "mixing-sizes",
    )
    spark, rows = docs.sparkSession, sized.count()
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(sums, weights, most), "mixing-targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    slots = schedule(spark, sources, -(-total // block))
    blocks = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1))
    taken = (
        slots.join(sources.select("number", blocks.alias("_blocks")), "number")
        .filter(F.col("rank") < F.col("_blocks") * most)
        .groupBy("number", (F.col("rank") % F.col("_blocks")).alias("_block"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    buckets = buckets_for(rows)
    part = F.floor(F.conv(F.substring("_key", 1, 6), 16, 10).cast("long") * buckets / KEYS)
    known = sources.withColumnRenamed("source", "_source")
    lined = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_bucket", part)
    lined = running_sum(lined, ["number"], "_bucket", ["_key", "size"], F.col("size"), "_start")
    last = F.col("_start") + F.greatest(F.col("size"), F.lit(1)) - 1
    div = lambda column: F.call_function("div", column, F.lit(block))
    parts = lined.withColumn("_block", F.explode(F.sequence(div(F.col("_start")), div(last))))
    inside = F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block) - F.greatest(
        F.col("_start"), F.col("_block") * block
    )
    # Empty documents share a start; they are alike but for their number of rows.
    same = ["_id", "_key", "size", "source_size", "target", "number", "_start"]
    empty, full = lined.filter("size = 0"), parts.filter("size > 0")
    summed = (
        full.join(taken, ["number", "_block"], "left")
        .groupBy(*same)
        .agg(F.sum(inside * F.coalesce(F.col("_times"), F.lit(0))).cast("long").alias("taken"))
    )
    result = ["_id", "size", "source_size", "target"]
    both = summed.select(*result, "taken").unionByName(empty.select(*result, F.lit(0).cast("long").alias("taken")))
    return both.withColumnRenamed("_id", key)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: sizes, targets and the words taken of each."""
    return mixed(documents(spark, sf_dir))


OP5_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sums),
caps AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END w,
    source_size * 3.0::DOUBLE cap FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER
      (ORDER BY cap / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lvl
  FROM caps),
sources AS (SELECT source, source_size, number, least(cap, max(lvl) OVER () * w) target FROM levels),
spans AS (
  SELECT *, coalesce(lead(lo) OVER (ORDER BY number), 1.0) hi FROM (
    SELECT *, coalesce(sum(target) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) / sum(target) OVER () lo FROM sources WHERE target > 0)),
points AS (
  SELECT id, p - floor(p) u FROM (
    SELECT id, f - floor(f) + (id % {FAR} + 0.5::DOUBLE) * {GOLDEN}::DOUBLE p FROM (
      SELECT id, (id // {FAR}) * {FAR_GOLDEN}::DOUBLE f
      FROM range((SELECT CAST(ceil(sum(size) / {BLOCK}.0) AS BIGINT) FROM sized)) t(id)))),
dealt AS (
  SELECT number, source_size, row_number() OVER (PARTITION BY number ORDER BY id) - 1 AS r
  FROM points JOIN spans ON lo <= u AND u < hi),
takes AS (
  SELECT number, r % greatest(1, CAST(ceil(source_size / {BLOCK}.0) AS BIGINT)) b, count(*) times
  FROM dealt WHERE r < 3 * greatest(1, CAST(ceil(source_size / {BLOCK}.0) AS BIGINT)) GROUP BY 1, 2),
lined AS (
  SELECT doc_id, size, source_size, target, number, coalesce(sum(size) OVER (PARTITION BY number
    ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT st
  FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source),
parts AS (SELECT *, unnest(range(st // {BLOCK}, (st + greatest(size, 1) - 1) // {BLOCK} + 1)) b FROM lined)
SELECT doc_id, size, source_size, target,
  CAST(sum(CASE WHEN size = 0 THEN 0 ELSE (least(st + size, (b + 1) * {BLOCK}) - greatest(st, b * {BLOCK}))
    * coalesce(times, 0) END) AS BIGINT) taken
FROM parts LEFT JOIN takes USING (number, b)
GROUP BY doc_id, size, source_size, target, number, st
"""
