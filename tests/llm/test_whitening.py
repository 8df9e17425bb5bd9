import math

import numpy as np
import pytest

from clicklake.llm import whitening


def brute_force(rows):
    """Facts of the rows that take part, by plain numpy on all of them."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    longest = max((len(v) for _, v in kept), default=0)
    exact = [(i, [math.floor(256 * c) for c in v] + [0] * (longest - len(v))) for i, v in kept]
    fit = sorted({tuple(x) for _, x in exact})
    total, sums = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    x = np.array(fit, float).reshape(total, longest)
    centred = x - np.array(sums) / max(total, 1)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(total, 1)) if total else ([], None)
    return exact, total, sums, values[::-1], vectors.T[::-1] if total else None


def check(found, rows, count=4):
    exact, total, sums, values, vectors = brute_force(rows)
    used = sum(v > 1e-9 * values[0] for v in values[:count])
    assert len(found) == len(exact) * used
    by_row = {}
    for r in found:
        by_row.setdefault(r["vec_id"], []).append(r)
    expected_ids = {}
    for i, x in exact:
        expected_ids.setdefault(i, []).append(x)
    signs = {}
    for i, given in expected_ids.items():
        deviations = sorted(sum((total * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in given)
        for component in range(1, used + 1):
            mine = [r for r in by_row[i] if r["component"] == component]
            assert sorted(int(r["deviation"]) for r in mine) == deviations
            assert {r["n"] for r in mine} == {total}
            direction, root = vectors[component - 1], math.sqrt(values[component - 1])
            expected = sorted(float((np.array(x) - np.array(sums) / total) @ direction) / root for x in given)
            got = sorted(r["whitened"] for r in mine)
            if component not in signs and abs(expected[0]) > 1e-3:
                signs[component] = 1 if np.allclose(got, expected, atol=1e-8) else -1
            if component in signs:
                assert np.allclose(got, sorted(signs[component] * e for e in expected), atol=1e-8)
    assert len({r["identity_error"] for r in found}) <= 1
    for r in found:
        assert r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[r["component"] - 1] / sum(values), rel_tol=1e-9)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "r", 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, _x string, whitened double")


def test_query_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    found = whitening.op13_whitening(spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(found.dtypes)["deviation"] == "bigint"
    check(found.collect(), [(r["vec_id"], r["embedding"]) for r in table])


def test_odd_vectors(spark):
    chance = np.random.default_rng(5)
    rows = [(n, chance.normal(0, 1, 5).tolist()) for n in range(60)]
    rows += [rows[3], rows[3], (100, rows[3][1]), (None, rows[4][1]), (None, chance.normal(0, 1, 5).tolist())]
    rows += [(101, None), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows += [(105, [0.5, -0.25]), (106, []), (107, [0.0] * 5), (108, [2.0] * 5)]
    found = whitening.whitened(frame(spark, rows, "double").repartition(4)).collect()
    check(found, rows)


@pytest.mark.parametrize("rank", [1, 2, 3])
def test_rank_below_the_dimension(spark, rank):
    chance = np.random.default_rng(rank)
    rows = [(n, (chance.integers(-8, 8, rank) @ np.eye(rank, 6)).tolist()) for n in range(40)]
    check(whitening.whitened(frame(spark, rows, "double")).collect(), rows)


def test_equal_eigenvalues(spark):
    """Plus and minus each unit vector: all eigenvalues are equal, any basis is right."""
    rows = [(2 * n + (s > 0), [s if m == n else 0.0 for m in range(5)]) for n in range(5) for s in (1.0, -1.0)]
    found = whitening.whitened(frame(spark, rows)).collect()
    assert len(found) == 40 and {r["component"] for r in found} == {1, 2, 3, 4}
    assert all(r["identity_error"] < 1e-9 and math.isclose(r["explained"], 0.2) for r in found)


def test_tables_without_spread(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_deviation_is_exact_beyond_64_bits(spark):
    rows = [(n, [float(v) * 2**30, 1.0]) for n, v in enumerate([1, -3, 7, 12345])]
    _, total, sums, _, _ = brute_force(rows)
    expected = {i: sum((total * math.floor(256 * c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in rows}
    found = whitening.whitened(frame(spark, rows, "double")).collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == expected and max(expected.values()) > 2**63


def test_more_dimensions_than_steps(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_STEPS", 12)
    chance = np.random.default_rng(9)
    rows = [(n, (chance.normal(0, 1, 40) * 1.5 ** -np.arange(40.0) * 8).tolist()) for n in range(300)]
    check(whitening.whitened(frame(spark, rows, "double")).collect(), rows)
