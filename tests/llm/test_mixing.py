import math
import re
from collections import defaultdict
from decimal import Decimal, localcontext

import duckdb
import pytest
from pyspark.sql import functions as F

from clicklake.llm import mixing


def expected_targets(sizes):
    """Shares by weight; what exceeds a limit goes to the others, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_} | {s: 3.0 * sizes[s] for s in full}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        full.update(over)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("weights", [(5, 2, 1)])
def test_targets_equal_repeated_sharing(spark, weights):
    sizes = {"b": 100, "a": 3, "ä": 40, "z": 0, None: 7, "Z": 1000, "aa": 1}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), weights).collect()
    expected = expected_targets(sizes)
    for row in rows:
        assert row["target"] == pytest.approx(expected[row["source"]], rel=1e-9)


def test_mix_of_all_documents(spark, sf_dir):
    rows = mixing.op5_mixing(spark, sf_dir).collect()
    table = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sums, taken = defaultdict(int), defaultdict(int)
    for r in table.values():
        sums[r["source"]] += words(r["text"])
    target = expected_targets(sums)
    assert len(rows) == len(table)
    for r in rows:
        source = table[r["doc_id"]]["source"]
        assert r["size"] == words(table[r["doc_id"]]["text"]) and r["source_size"] == sums[source]
        assert r["target"] == pytest.approx(target[source], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 4 * mixing.BLOCK
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op5_mixing(spark, sf_dir).collect()))


def test_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = connection.execute(mixing.OP5_SQL)
    names = [c[0] for c in cursor.description]
    rows = mixing.op5_mixing(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(cursor.fetchall())


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, 50.0), (1, 30.0), (2, 0.0), (3, 20.0)], "number long, target double")
    for slots in (100, 1000, 20000):
        rows = mixing.schedule(spark, sources, slots).groupBy("number").count().collect()
        assert {r["number"]: round(r["count"] / slots, 2) for r in rows} == {0: 0.5, 1: 0.3, 3: 0.2}
    ranks = mixing.schedule(spark, sources, 10000).filter("number = 0").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(len(ranks)))


def test_odd_documents(odd_documents, no_documents, spark):
    rows = mixing.mixed(odd_documents).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in rows) == sorted((r["doc_id"] or 0, words(r["text"])) for r in odd_documents.collect())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixed(no_documents).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.mixed(empty).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_rows_of_one_key_are_spread(spark):
    """A third of the ids are null: no bucket of the hash has over twice the mean."""
    rows = spark.range(30000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    bucket = F.floor(F.conv(F.substring(mixing._hex_key(F.col("doc_id"), F.col("text")), 1, 6), 16, 10).cast("long") * 10 / mixing.KEYS)
    counts = [r["count"] for r in rows.groupBy(bucket.alias("b")).count().collect()]
    assert len(counts) == 10 and max(counts) < 2 * sum(counts) / 10


def test_points_of_far_slots_stay_spread(spark):
    """Points equal those of exact arithmetic, also where a product of doubles has lost its digits."""
    with localcontext() as exact_to:
        exact_to.prec = 50
        golden = (Decimal(5).sqrt() - 1) / 2
    assert abs(Decimal(mixing.FAR_GOLDEN) - (golden * mixing.FAR) % 1) < Decimal("1e-15")
    for slot in (0, 5, 2**26 - 1, 2**26, 10**11 + 7, 10**13 + 1):
        far = (slot // mixing.FAR) * mixing.FAR_GOLDEN
        point = far - math.floor(far) + (slot % mixing.FAR + 0.5) * mixing.GOLDEN
        exact = (slot + Decimal("0.5")) * golden % 1
        apart = abs(Decimal(point % 1) - exact)
        assert min(apart, 1 - apart) < Decimal("1e-7")
