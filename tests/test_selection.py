import itertools
import math

import numpy as np
import pytest

from chronoloom.operators.selection import _inversions, benjamini_hochberg, correlated_features, kendall_p, kendall_p_values, select_features, t_test_p


def test_t_p_values():
    # one and two degrees of freedom have closed forms
    for t in (0.0, 0.3, 1.0, 5.0, 40.0):
        assert t_test_p(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert t_test_p(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)


def test_kendall_exact_against_permutations():
    def score(y):
        return sum(np.sign(b - a) for a, b in itertools.combinations(y, 2))

    for y in ([0, 1, 2, 3, 4], [1, 0, 2, 4, 3], [4, 2, 0, 1, 3]):
        every = [abs(score(p)) for p in itertools.permutations(range(5))]
        assert kendall_p(list(range(5)), y) == pytest.approx(np.mean([s >= abs(score(y)) for s in every]))
    assert _inversions([3, 1, 2, 2]) == 3
    assert kendall_p([1.0] * 5, list(range(5))) == 1.0


def test_kendall_with_ties():
    x, y = [1, 2, 2, 3, 4, 4], [1, 1, 2, 3, 3, 4]
    n, m = 6, 30
    score = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for a, b in itertools.combinations(zip(x, y), 2))
    tie = 2 * 1 * 9
    var = (m * 17 - 2 * tie - 2 * tie) / 18 + 2 * 2 * 2 / m
    assert kendall_p(x, y) == pytest.approx(math.erfc(abs(score) / math.sqrt(2 * var)))


def test_benjamini_hochberg():
    assert benjamini_hochberg({"a": 0.04, "b": 0.01, "c": 0.03, "d": 0.9}, 0.05) == ["b"]
    assert benjamini_hochberg({"a": 0.02, "b": 0.01, "c": 0.03}, 0.05) == ["b", "a", "c"]
    assert benjamini_hochberg({"a": 0.5}) == [] and benjamini_hochberg({}) == []


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 120
    y = np.arange(n) % 2
    good = y + rng.normal(0, 0.3, n)
    rows = zip(y.tolist(), (np.arange(n) / n).tolist(), [1.0] * n, good.tolist(), (2 * good + 1).tolist(), rng.normal(size=n).tolist(), (np.arange(n) + rng.normal(0, 5, n)).tolist())
    return spark.createDataFrame(list(rows), "y long, z double, const double, good double, twin double, noise double, drift double")


FEATURES = ["const", "good", "twin", "noise", "drift"]


def test_selection(table):
    s = select_features(table, FEATURES)
    assert (s.constant, s.correlated, s.kept) == (["const"], ["twin"], ["good", "noise", "drift"])
    s = select_features(table, FEATURES, "y")
    assert s.kept == ["good"] and s.frame.columns == ["y", "z", "good"]
    s = select_features(table, FEATURES, "z")
    assert s.kept == ["drift"] and s.p_values["drift"] < 1e-6
    assert select_features(table, ["const"], "y").kept == []


def test_kendall_in_blocks_equals_one_task(spark):
    rng = np.random.default_rng(4)
    n = 400
    y = rng.integers(0, 30, n)
    hot = np.where(rng.random(n) < 0.5, 3, rng.integers(0, 9, n))  # a value that half of the rows have
    rows = zip(y.tolist(), (y + rng.normal(0, 30, n)).tolist(), hot.tolist(), rng.normal(size=n).tolist())
    df = spark.createDataFrame(list(rows), "y long, a double, hot long, c double")
    whole, cut = (kendall_p_values(df, ["a", "hot", "c"], "y", k) for k in (10**6, 60))
    assert cut == pytest.approx(whole, rel=1e-12)


def test_inversions():
    import random

    from chronoloom.operators.selection import _inversions

    rng = random.Random(5)
    for n in (0, 1, 2, 3, 7, 8, 33, 100):
        x = [rng.randint(0, 20) / 4 for _ in range(n)]
        assert _inversions(x) == sum(a > b for i, a in enumerate(x) for b in x[i + 1 :])


def test_kendall_leaves_out_nulls(spark):
    from chronoloom.operators.selection import kendall_p, kendall_p_values

    rows = [(float(i * 7 % 11), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, 1.0), (2.0, None), (float("nan"), 3.0)], "f double, y double").selectExpr("f", "y", "cast(null as double) as none")
    want = kendall_p(*zip(*rows))
    for rows_in_task in (100, 10):
        p = kendall_p_values(df, ["f", "none"], "y", rows_in_task)
        assert abs(p["f"] - want) < 1e-12 and p["none"] == 1.0


def test_correlations_in_blocks_with_nulls(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(1e6, 1, (400, 3))
    x = np.column_stack([base, base[:, 0] * -2 + 1, base[:, 1] + rng.normal(0, 0.05, 400), rng.normal(0, 1, 400)])
    rows = [[None if rng.random() < 0.1 else float(v) for v in r] for r in x]
    rows[7][5] = float("nan")
    names = [f"x.{k}" for k in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(3)
    for at_once in (2, 4, 512):
        assert correlated_features(df, names, 0.98, at_once) == ["x.3", "x.4"]
    assert correlated_features(df.limit(0), names) == []
