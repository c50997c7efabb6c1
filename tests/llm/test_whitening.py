import math

import numpy as np
import pytest
from plantflow.llm.whitening import above, feast, intervals, leading, tridiagonal, whitened

SCHEMA = "vec_id long, embedding array<float>, component string"


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [[9, 8, 7, 6, 5, 4, 3, 2, 1, 0.5], [5, 5, 5, 5, 5, 1, 1, 1], [1e6, 1, 1e-3, 0], [3], [4, 4], [2, 1.999999999, 1], list(np.linspace(1, 1.2, 40)), [-1, -2, 3]])
def test_feast_finds_what_inertia_counts(values):
    v = symmetric(values)
    want = np.sort(values)[::-1]
    d, off = tridiagonal(v)
    assert [above(d, off, x) for x in (want.max() + 1, want.min() - 1)] == [0, len(values)]
    parts = intervals(v, min(8, len(values)))
    assert sum(p[2] for p in parts) >= min(8, len(values))
    found = []
    for low, high, held in parts:
        e, u = feast(v, low, high, held)
        assert np.abs(v @ u - u * e).max() < 1e-12 * np.abs(v).max() * len(values)
        assert np.abs(u.T @ u - np.eye(held)).max() < 1e-12
        found += list(e)
    assert np.allclose(sorted(found)[::-1], want[: len(found)], rtol=0, atol=1e-12 * np.abs(want).max())


def test_a_missed_eigenvalue_is_an_error():
    with pytest.raises(ValueError, match="by inertia"):
        feast(symmetric([5, 4, 3, 2, 1, 0, -1, -2, -3]), 2.5, 5.5, 4)


def plain(rows, most=8):
    """By numpy's dense solver over exact integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    n = len(kept)
    x = np.array([e for _, e in kept], dtype=object)
    s = x.sum(axis=0)
    dev = ((n * x - s) ** 2).sum(axis=1)
    y = ((n * x - s) / n).astype(float)
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return [i for i, _ in kept], n, dev, y @ u / np.sqrt(e), e / np.trace(v)


def check(got, rows, most=8):
    ids, n, dev, white, explained = plain(rows, most)
    assert len(got) == n * white.shape[1]
    sign = {}
    at = {i: k for k, i in enumerate(ids)}
    for r in got:
        k, c = at[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, dev[k])
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-8
        if abs(white[k, c]) > 1e-3:
            s = sign.setdefault(c, np.sign(white[k, c] * r["whitened"]))
            assert r["whitened"] == pytest.approx(s * white[k, c], rel=1e-6, abs=1e-7)


def test_whole_table_against_dense_solver(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    check(whitened(table).collect(), [tuple(r) for r in table.collect()])


def test_odd_vectors_are_left_out(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(3) * [3, 2, 1]]) for i in range(50)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0]), (106, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows + odd], SCHEMA)
    check(whitened(df).collect(), rows)


def test_repeated_equal_and_no_vectors(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0], "")], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], SCHEMA)).collect() == []
    rows = [(None, [0.0, 1.0], ""), (7, [2.0, 1.0], ""), (7, [2.0, 1.0], "")]
    got = whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (7, 1), (7, 1)]
    assert [r["explained"] for r in got] == pytest.approx([1.0] * 3)


def test_deviations_beyond_a_long(spark):
    big = 2.0**40
    df = spark.createDataFrame([(1, [big], ""), (2, [-big], "")], SCHEMA)
    got = whitened(df).collect()
    assert [r["deviation"] for r in got] == [None, None]
    assert {int(r["deviation_exact"]) for r in got} == {(2 * 2**50) ** 2}


def test_leading_runs_in_tasks(spark):
    e, u = leading(spark, symmetric([4, 3, 2, 1]), 2)
    assert np.allclose(e, [4, 3]) and u.shape == (4, 2)
