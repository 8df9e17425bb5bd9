import math

import numpy as np

from clicklake.llm import neighbours


def brute_force(rows, asks, count):
    out = {}
    for query, vector in {(i, tuple(v)) for i, v in rows if asks(i)}:
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in rows if i != query)
        out[query] = [(i, -s) for s, i in scored[:count]]
    return out


def test_recall_on_the_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    expected = brute_force([(r["vec_id"], r["embedding"]) for r in table], lambda i: i % 20 == 0, 20)
    found = {}
    for row in neighbours.op9_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append(row)
    assert found.keys() == expected.keys()
    hits = 0
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in table}
    for query, rows in found.items():
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        for r in rows:
            assert math.isclose(r["score"], float(vectors[query] @ vectors[r["vec_id"]]), abs_tol=1e-12)
        hits += len({r["vec_id"] for r in rows} & {i for i, _ in expected[query]})
    assert hits >= 0.9 * 20 * len(expected)


def test_footrule_equals_its_definition():
    generator = np.random.default_rng(1)
    orders = np.stack([generator.permutation(12)[:5] for _ in range(30)]).astype(np.int16)
    files = neighbours.InvertedFiles(orders, 12)

    def places(order):
        return [list(order).index(p) if p in order else 5 for p in range(12)]

    for order in orders[:4]:
        expected = [sum(abs(a - b) for a, b in zip(places(order), places(o))) for o in orders]
        assert files.footrule(order).tolist() == expected


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, _id string, _vector int"
    rows = [(i, [1.0, float(i % 3), 0.5], None, 1) for i in range(60)]
    odd = [(100, None, "a", 1), (120, [0.0, 0.0, 0.0], "a", 1), (140, [1.0, None, 1.0], "a", 1), (160, [1.0, float("nan"), 1.0], "a", 1)]
    odd += [(180, [float("inf"), 1.0, 1.0], "a", 1), (200, [1.0], "a", 1), (220, [], "a", 1), (None, [1.0, 1.0, 1.0], "a", 1)]
    table = spark.createDataFrame(rows + rows[:1] + odd, schema)
    found = {}
    for r in neighbours.nearest(table, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    valid = [(i, v) for i, v, *_ in rows]
    expected = brute_force(valid, lambda i: i % 20 == 0, 20)
    assert found.keys() == expected.keys() == {0, 20, 40}
    for query in found:
        others = found[query] if query == 0 else [x for n, x in enumerate(found[query]) if x not in found[query][:n]]
        wanted = [x for x in expected[query] if x in others]
        assert [s for _, s in found[query]] == sorted((s for _, s in found[query]), reverse=True)
        assert others == wanted
    few = spark.createDataFrame(rows[:3], schema)
    assert neighbours.nearest(few, "vec_id % 20 = 0").count() == 2
    assert neighbours.nearest(few.limit(1), "vec_id % 20 = 0").count() == 0
    assert neighbours.nearest(few.limit(0), "vec_id % 20 = 0").count() == 0


def test_vectors_of_each_length_are_searched(spark):
    rows = [(i, [1.0, float(i % 7), 0.5 * (i % 3)]) for i in range(60)]
    longer = [(i, [2.0, 1.0, float(i % 5), 0.25]) for i in range(80, 90)]
    table = spark.createDataFrame([*rows, *longer, (200, [1.0] * 65)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(table, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = brute_force(rows, lambda i: i % 20 == 0, 20) | brute_force(longer, lambda i: i % 20 == 0, 20)
    assert found.keys() == expected.keys() == {0, 20, 40, 80}
    for query in found:
        assert len(found[query]) == len(expected[query])
        if query == 80:
            assert found[query] == expected[query]
        assert max(s for _, s in found[query]) == max(s for _, s in expected[query])


def test_the_nearest_share_with_all_ties():
    distances = np.array([5, 1, 3, 3, 9, 3, 2], np.int32)
    assert neighbours.nearest_share(distances, 0.4, 1).tolist() == [1, 2, 3, 5, 6]
    assert neighbours.nearest_share(distances, 0.1, 2).tolist() == [1, 6]
    assert neighbours.nearest_share(distances, 0.1, 20).tolist() == list(range(7))
    assert neighbours.nearest_share(distances[:0], 0.1, 20).tolist() == []


def test_the_fitted_share_finds_neighbours_with_little_reranked():
    generator = np.random.default_rng(3)
    vectors = generator.normal(size=(4000, 16))
    length = float(np.linalg.norm(vectors, axis=1).max())
    index = neighbours.fit(vectors[:2000], length, len(vectors), 20, neighbours.PIVOTS, neighbours.PREFIX)
    assert index["share"] < 0.1
    lifted = neighbours._lifted(vectors, length)
    files = neighbours.InvertedFiles(neighbours.prefixes(lifted, index["pivots"], index["prefix"]), len(index["pivots"]))
    queries = vectors[2000:2100]
    orders = neighbours.prefixes(np.hstack([queries, np.zeros((100, 1))]), index["pivots"], index["prefix"])
    hits = 0
    for query, order in zip(queries, orders, strict=True):
        near = neighbours.nearest_share(files.footrule(order), index["share"], 20)
        hits += len(set(near.tolist()) & set(np.argsort(-(vectors @ query), kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * 100
