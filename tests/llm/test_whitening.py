import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partcast.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, cast="float"):
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], SCHEMA.replace("float", cast)).repartition(3)
    for name in ("x", "n", "d", "component", "cell", "i", "v"):
        df = df.withColumn(name, F.lit("own"))
    return df


def plain(vectors, count=4):
    """Everything from the whole covariance, in numpy."""
    whole = {k: [math.floor(256 * c) for c in v] for k, v in enumerate(vectors)
             if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, whole.values()))), dtype=float)
    n, centred = len(fit), fit - fit.mean(axis=0)
    e, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:count]
    sums = [int(s) for s in fit.sum(axis=0)]
    out = {}
    for k, x in whole.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        white = (np.array(x) - fit.mean(axis=0)) @ vectors_[:, order] / np.sqrt(np.maximum(e[order], 1e-300))
        for c in range(len(order)):
            out[k, c + 1] = (n, deviation, white[c], e[order][c] / e.sum() if e.sum() else None)
    return out


def check(got, expected, tolerance=1e-9):
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert set(rows) == set(expected) and len(got) == len(rows)
    signs = {}
    for (k, c), (n, deviation, white, explained) in sorted(expected.items()):
        r = rows[k, c]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        if c not in signs and abs(white) > 1e-3:
            signs[c] = math.copysign(1, white * r["whitened"])
        assert r["whitened"] == pytest.approx(signs.get(c, 1) * white, abs=tolerance)
        assert r["identity_error"] < 1e-9


def test_against_the_whole_covariance(spark):
    rng = np.random.default_rng(7)
    spread = np.exp(-np.arange(12) / 2)
    vectors = [[float(np.float32(c)) for c in row] for row in rng.normal(size=(400, 12)) * spread]
    vectors += [vectors[0]] * 50 + [None, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11]
    check(whitening.whiten(table(spark, vectors)).collect(), plain(vectors))


def test_badly_scaled_and_dependent_dimensions(spark):
    """Directions 10 million times weaker than others, constant and repeated dimensions."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=300) * 3e5, rng.normal(size=300)
    vectors = [[float(v) for v in row] for row in np.stack([a, b * 0.05, a, np.full(300, 2.0), b, a + b], axis=1)]
    got = whitening.whiten(table(spark, vectors, "double")).collect()
    expected = plain(vectors)
    for r in got:
        n, deviation, white, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation if deviation < 2**63 else None)
        if r["component"] <= 2:
            assert abs(r["whitened"]) == pytest.approx(abs(white), abs=1e-4)
            assert r["explained"] == pytest.approx(explained, rel=1e-6, abs=1e-13)
        assert r["identity_error"] < 1e-4


def test_cases_without_directions(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [[], []])).collect() == []
    same = whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(same) == 10 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)}
    line = whitening.whiten(table(spark, [[float(k), 2.0 * k, 0.0] for k in range(9)] + [[1.0]])).collect()
    assert {r["vec_id"] for r in line} == set(range(9))              # the vector of another length is left out
    assert {r["component"]: r["explained"] for r in line} == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0}
    assert {r["whitened"] for r in line if r["component"] > 1} == {None}


def test_large_entries(spark):
    vectors = [[1e15 * k, 1.0 * (k % 3)] for k in range(40)] + [[3e30, 0.0]]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(table(spark, vectors, "double")).collect()}
    assert len(got) == 82 and all(r["deviation"] is None for r in got.values())
    assert got[0, 1]["identity_error"] < 1e-4


def test_whole_numbers_beyond_longs():
    x = np.array([[2**62, -2**62], [1, 2]])
    dev = whitening.deviations(x, 4, [2**62 + 1, -2**62 + 2])
    assert dev.tolist() == [[4 * 2**62 - 2**62 - 1, -4 * 2**62 + 2**62 - 2], [4 - 2**62 - 1, 8 + 2**62 - 2]]
    assert whitening.squared_lengths(np.array([[3, 4]])) == [25]
    assert whitening.squared_lengths(np.array([[2**40, 1]])) == [None]
