"""Selection among all differences of two samples, against forming them."""

import time

import numpy as np
import pytest

from quantgrid.functions import pairwise as pw
from quantgrid.operators import de


def differences(x, y):
    return np.sort((x[:, None] - y[None, :]).ravel())


@pytest.mark.parametrize("kind", ["normal", "ties", "far", "equal", "one"])
def test_selection(kind):
    rng = np.random.default_rng(3)
    for n, m in ((3, 5), (80, 90), (400, 333), (1, 9000), (700, 30)):
        x, y = rng.normal(0, 1, n), rng.normal(0.2, 1, m)
        if kind == "ties":
            x, y = x.round(1), y.round(1)
        elif kind == "far":
            x[0], y[-1] = 1e12, -1e9
        elif kind == "equal":
            x, y = np.full(n, 20.1), np.full(m, 0.3)
        elif kind == "one":
            x[:], y = 7.0, np.exp(5 * y)
        x, y = np.sort(x), np.sort(y)
        d = differences(x, y)
        ks = sorted({0, 1, len(d) // 7, (len(d) - 1) // 2, len(d) // 2, len(d) - 2, len(d) - 1})
        assert pw.kth_differences(x, y, ks) == [d[k] for k in ks]
        assert pw.u_statistic(x, y) == (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2
        assert (pw.count_up_to(x, y, d[ks] + 2 * pw.slack(x, y)) >= np.array(ks) + 1).all()
    t = np.array([1.0, 1, 1, 2, 3, 3])
    assert pw.tie_sum(t) == 24 + 6 and pw.tie_sum(np.array([5.0])) == 0


def test_large_arms_are_quick(spark):
    rng = np.random.default_rng(4)
    x, y = np.sort(rng.normal(size=200_000)), np.sort(rng.normal(size=200_000))
    start = time.perf_counter()
    got = pw.kth_differences(x, y, [2 * 10**10])
    assert time.perf_counter() - start < 10 and abs(got[0]) < 0.02


def test_five_hundred_runs_an_arm(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(20, 1, (6, 1000))
    v[:, 500:] += np.arange(6)[:, None] / 5
    v[5] = v[5].round(1)
    cells = spark.createDataFrame([("s" if i < 5 else "t", f"f{i}", f"r{j}", float(v[i, j])) for i in range(6) for j in range(1000)], "study_id string, feature_id string, sample_id string, value double")
    samples = spark.createDataFrame([(s, f"r{j}", "b" if j >= 500 else "a") for s in "st" for j in range(1000)], "study_id string, sample_id string, condition string")
    got = {r.feature_id: r for r in de.mannwhitney(cells, samples, "condition", "a").collect()}
    k = int(np.floor(500 * 500 / 2 - 1.959963984540054 * np.sqrt(500 * 500 * 1001 / 12)))
    for i in range(6):
        d = differences(v[i, 500:], v[i, :500])
        r = got[f"f{i}"]
        assert (r.effect, r.ci_low, r.ci_high) == ((d[124999] + d[125000]) / 2, d[k], d[250000 - 1 - k])
        assert 0 <= r.p <= 1


@pytest.mark.parametrize("small", [False, True])
def test_class_shift(spark, monkeypatch, small):
    from quantgrid.operators import pairs, ranks

    if small:  # groups of several value ranges
        monkeypatch.setattr(ranks, "SMALL_GROUP", 60)
    rng = np.random.default_rng(6)
    groups = {"base": rng.normal(0, 1, 300), "up": rng.normal(0.5, 2, 200), "tied": rng.normal(0, 1, 150).round(1), "far": np.r_[rng.normal(0, 1, 90), 1e6], "few": np.array([1.0, 2.0])}
    groups["base"][:50] = groups["base"][:50].round(1)
    rows = [("s", g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "study_id string, g string, v double").repartition(6)
    got = {r.g: r for r in pairs.mw_shift(df, ["study_id"], "g", "base", "v").collect()}
    y = groups["base"]
    for g in ("up", "tied", "far", "few"):
        x = groups[g]
        d, m = differences(x, y), len(x) * len(y)
        k = max(int(np.floor(m / 2 - 1.959963984540054 * np.sqrt(m * (len(x) + len(y) + 1) / 12))), 0)
        span = x.max() - x.min() + y.max() - y.min()
        want = [(d[(m - 1) // 2] + d[m // 2]) / 2, d[k], d[m - 1 - k]]
        assert np.allclose([got[g].hl_shift, got[g].hl_ci_low, got[g].hl_ci_high], want, rtol=0, atol=1e-11 * span if small else 0)
        assert got[g].mw_u == (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2


def test_law_of_u():
    from itertools import combinations

    from quantgrid.functions import special

    for a, b in ((1, 1), (3, 4), (5, 2), (4, 4)):
        u = [sum(c) - a * (a - 1) // 2 for c in combinations(range(a + b), a)]
        assert np.allclose(special._u_law(a, b), np.bincount(u, minlength=a * b + 1) / len(u), rtol=1e-13)
    start = time.perf_counter()
    law = special._u_law(500, 500)
    assert time.perf_counter() - start < 3 and np.isclose(law.sum(), 1) and (law >= 0).all()
    mean, var = (law * np.arange(len(law))).sum(), (law * (np.arange(len(law)) - 125_000.0) ** 2).sum()
    assert np.isclose(mean, 125_000) and np.isclose(var, 500 * 500 * 1001 / 12)


def test_laws_of_large_samples():
    from quantgrid.functions import special
    from quantgrid.operators.design import _order_result

    # A small arm against a huge one: close to the exact law where both can be had.
    for few, many in ((1, 5000), (3, 3000), (8, 2000)):
        law = special._u_law(few, many)
        for u in (few * many // 2 + 1, int(few * many * 0.8), int(few * many * 0.97)):
            exact = min(1.0, 2 * law[u:].sum())
            scale = np.sqrt(many * (few + many + 1.0))
            assert abs(min(1.0, 2 * special.uniform_sum_cdf(few / 2 - (u - few * many / 2 - 0.5) / scale, few)) - exact) < 1e-3 * exact + 1e-9
    assert 0 < special.mann_whitney_p([8e8], [3], [4e8], [0], [True])[0] < 1  # no array as long as the product
    # Batches: the product of laws against plain convolution.
    shapes, law = [(3, 4), (5, 2), (6, 6), (0, 3)], np.ones(1)
    for k, m in shapes[:3]:
        law = np.convolve(law, special._u_law(k, m))
    for us in ((3, 1, 9, 0), (12, 10, 36, 0), (0, 0, 0, 0)):
        got, u = _order_result(us, shapes), sum(us)
        assert np.isclose(got["p_two_sided"], min(1.0, law[np.abs(2 * np.arange(59) - 58) >= abs(2 * u - 58)].sum()), atol=1e-13)
    start = time.perf_counter()
    big = _order_result([130_000] * 2 + [2_000_000], [(500, 500)] * 2 + [(2000, 2000)])
    assert time.perf_counter() - start < 1 and 0 < big["p_two_sided"] < 1
    near = _order_result([130_000] * 2, [(500, 500)] * 2)
    spread = np.sqrt(2 * 500 * 500 * 1001 / 12)
    assert np.isclose(near["p_two_sided"], 2 * special.norm_sf((10_000 - 0.5) / spread), rtol=1e-3)
