"""Tests against published and hand-computed values."""

import math

import pytest

from tabvox.functions import dist
from tabvox.operators import stats as T


def long(spark, groups, paired=False):
    rows = [("m", chr(65 + i), str(j) if paired else f"{i}-{j}", float(v)) for i, g in enumerate(groups) for j, v in enumerate(g)]
    return spark.createDataFrame(rows, "metric string, condition string, subject string, value double")


def one(df):
    return df.first().asDict()


def test_welch(spark):
    r = one(T.welch(long(spark, [range(1, 6), range(2, 11, 2)])))
    assert r["t"] == pytest.approx(-1.8974, abs=1e-4) and r["p"] == pytest.approx(0.1075, abs=1e-4)
    assert r["difference"] == 3.0 and r["low"] < 3 < r["high"]


def test_welch_constant_groups(spark):
    assert one(T.welch(long(spark, [[1, 1, 1], [1, 1, 1]])))["p"] == 1.0
    assert one(T.welch(long(spark, [[1, 1, 1], [2, 2, 2]])))["p"] == 0.0


def test_anova(spark):
    r = one(T.anova(long(spark, [range(1, 6), range(2, 11, 2), range(3, 16, 3)])))
    assert r["f"] == pytest.approx(3.8571, abs=1e-4) and r["p"] == pytest.approx(0.0509, abs=1e-4)


def test_paired(spark):
    d = long(spark, [[2, 4, 6, 8, 10], [3, 5, 5, 9, 12]], paired=True)
    r = one(T.paired_t(d))
    assert r["t"] == pytest.approx(-1.6330, abs=1e-4) and r["p"] == pytest.approx(0.1778, abs=1e-4)
    w = one(T.wilcoxon(d))
    assert w["w"] == 2.5 and w["p"] == pytest.approx(0.3125, abs=1e-4)


def test_repeated_measures(spark):
    d = long(spark, [(10, 17, 5, 17), (22, 24, 10, 21), (27, 29, 15, 22)], paired=True)
    r, f = one(T.rm_anova(d)), one(T.friedman(d))
    assert r["f"] == pytest.approx(18.0, abs=1e-3) and r["p"] == pytest.approx(0.0029, abs=1e-4)
    assert f["chi2"] == pytest.approx(8.0)


def test_ranks_with_ties(spark):
    assert one(T.kruskal(long(spark, [[0, 0, 0], [0, 1, 1], [1, 1, 1]])))["h"] == pytest.approx(5.6)
    r = one(T.mann_whitney(long(spark, [[0, 0, 0], [0, 1, 1]])))
    assert r["u"] == 1.5 and r["p"] == pytest.approx(0.11384630, abs=1e-6)
    assert one(T.kruskal(long(spark, [[1] * 3] * 3)))["h"] == 0
    assert one(T.mann_whitney(long(spark, [[1] * 3] * 2)))["p"] == pytest.approx(1.0)


A = [12, 15, 18, 16, 14]
FOUR = [A, [x + 10 for x in A], [x + 20 for x in A], [x + 1 for x in A]]


def test_tukey(spark):
    q = {(r["a_condition"], r["b_condition"]): r["q"] for r in T.tukey(long(spark, FOUR)).collect()}
    want = {("A", "B"): 10, ("A", "C"): 20, ("A", "D"): 1, ("B", "C"): 10, ("B", "D"): 9, ("C", "D"): 19}
    for pair, value in want.items():
        assert q[pair] == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("q, k, df, p", [(4.046, 4, 16, 0.05), (5.193, 4, 16, 0.01), (3.578, 3, 20, 0.05), (4.642, 3, 20, 0.01)])
def test_studentised_range(q, k, df, p):
    assert dist.range_upper(q, k, df) == pytest.approx(p, abs=5e-3)


def test_dunn(spark):
    p = {(r["a_condition"], r["b_condition"]): r["adjusted"] for r in T.dunn(long(spark, FOUR)).collect()}
    for pair, value in {("A", "B"): 0.16979, ("A", "C"): 0.00248, ("A", "D"): 1, ("B", "C"): 1, ("B", "D"): 0.41380, ("C", "D"): 0.00959}.items():
        assert p[pair] == pytest.approx(value, abs=2e-4)


def test_eligibility_and_router(spark):
    d = long(spark, [[1, 2], [3, 4, 5]])
    assert one(T.eligibility(d))["reason"] == "a group has fewer than 3"
    assert one(T.route(d))["test"].startswith("skipped")
    assert one(T.route(long(spark, FOUR)))["test"] == "kruskal"


def test_distribution_tails():
    assert dist.t_two_sided(2.0, 10.0) == pytest.approx(0.07338803, abs=1e-7)
    assert dist.f_upper(3.0, 2.0, 10.0) == pytest.approx(1.6**-5, abs=1e-9)
    assert dist.t_quantile(0.975, 5.0) == pytest.approx(2.570582, abs=1e-5)
    assert math.isclose(float(dist.beta_inc(2, 3, 0.4)), 0.5248, abs_tol=1e-4)
