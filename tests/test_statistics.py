"""Planted truth and equivalences for the statistics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantgrid.functions import special
from quantgrid.model import ScaleError, complete_grid, tag_scale
from quantgrid.operators import agreement as ag
from quantgrid.operators import batch, de, missing, normalize, smooth
from quantgrid.operators.bootstrap import bootstrap_pearson, percentile_ci
from quantgrid.operators.design import exact_perm_stratified, pair_roles
from quantgrid.operators.pairs import moderated_one_sample, pair_diff


def sheet(spark):
    rows = [("s", f"r{i}", "treated" if i % 2 else "control", f"P{i // 2}", "B1" if i < 6 else "B2", i) for i in range(8)]
    return spark.createDataFrame(rows, "study_id string, sample_id string, condition string, candidate_pair string, batch string, seq_number int")


def cells(spark, m, scale="log2"):
    f, s = m.shape
    pdf = pd.DataFrame({
        "study_id": "s", "feature_id": np.repeat([f"f{i:05d}" for i in range(f)], s),
        "sample_id": np.tile([f"r{j}" for j in range(s)], f), "value": m.ravel(),
    })
    return tag_scale(spark.createDataFrame(pdf), scale)


@pytest.fixture(scope="module")
def paired(spark):
    rng = np.random.default_rng(3)
    f, d0, s0 = 600, 6.0, 0.15
    sd = np.sqrt(s0**2 * d0 / rng.chisquare(d0, f))
    base = rng.uniform(18, 30, f)[:, None] + np.repeat(rng.normal(0, 1, (f, 4)), 2, axis=1)
    y = base + rng.normal(size=(f, 8)) * sd[:, None]
    shift = np.zeros(f)
    shift[:8], shift[8:15] = 1.0, -1.0
    y[:, 1::2] += shift[:, None]
    return cells(spark, y).persist(), y, shift


def test_paired_model_is_paired_t_and_finds_the_plant(spark, paired):
    c, y, shift = paired
    table, info = de.differential_abundance(c, sheet(spark), "condition", ["candidate_pair"], {"condition": "control"})
    got = table.where("is_contrast").toPandas().sort_values("feature_id").reset_index(drop=True)
    d = y[:, 1::2] - y[:, ::2]
    assert np.allclose(got.effect, d.mean(1), atol=1e-10)
    assert np.allclose(got.sigma**2, d.var(1, ddof=1) / 2, rtol=1e-9)
    i = info.first()
    assert i.residual_df == 3 and 3 < i.d0 < 14 and i.s0_sq == pytest.approx(0.15**2, rel=0.3)
    hit = got.q < 0.05
    assert (hit & (shift != 0)).sum() >= 13 and (hit & (shift == 0)).sum() <= 3
    assert (np.sign(got.effect[hit & (shift != 0)]) == np.sign(shift[hit & (shift != 0)])).all()
    one, _ = moderated_one_sample(pair_diff(c, pair_roles(sheet(spark), "control", "treated")), pair_roles(sheet(spark), "control", "treated"))
    other = one.toPandas().sort_values("feature_id").reset_index(drop=True)
    assert np.allclose(other.p, got.p, rtol=1e-6, atol=1e-12)


def test_prior_equation(spark, paired):
    c, y, _ = paired
    proj, terms = de.design(sheet(spark), "condition", ["candidate_pair"], {"condition": "control"})
    fits = de.add_variance(de.ols(c, proj), terms)
    p = de.eb_prior(fits).first()
    z = np.log((y[:, 1::2] - y[:, ::2]).var(1, ddof=1) / 2)
    left = special.trigamma(np.array([p.d0 / 2]))[0]
    assert left == pytest.approx(z.var(ddof=1) - special.trigamma(np.array([1.5]))[0], rel=1e-8)


def test_trend_prior_follows_the_mean(spark):
    rng = np.random.default_rng(8)
    f, d0 = 3000, 6.0
    mu = rng.uniform(18, 30, f)
    true = 0.30 + (mu - 18) / 12 * (0.075 - 0.30)
    sd = np.sqrt(true**2 * d0 / rng.chisquare(d0, f))
    y = mu[:, None] + rng.normal(size=(f, 8)) * sd[:, None]
    t, info = de.differential_abundance(cells(spark, y), sheet(spark), "condition", [], {"condition": "control"}, trend=True)
    got = t.where("is_contrast").toPandas().sort_values("feature_id")
    err = np.abs(got.prior_sd.to_numpy() / true - 1)
    assert np.median(err) < 0.10 and err.max() < 0.5
    assert info.first().spline_df == 4


def test_guards(spark, paired):
    c, _, _ = paired
    with pytest.raises(ScaleError):
        normalize.log2_transform(c)
    with pytest.raises(ScaleError):
        de.differential_abundance(tag_scale(c, "linear"), sheet(spark), "condition")
    with pytest.raises(ValueError):
        de.differential_abundance(c, sheet(spark), "condition", ["batch"], method="welch")


def test_normalisation_recovers_a_doubling(spark):
    m = np.full((11, 8), 500.0)
    m[0] = [1000, 2000] * 4
    m *= np.array([1, 1.5, 0.7, 1, 2, 1, 1.2, 0.9])[None, :]
    out = normalize.normalize(cells(spark, m, "linear")).where("feature_id = 'f00000'").toPandas().sort_values("sample_id")
    assert np.allclose(np.log2(out.value.to_numpy()[1::2] / out.value.to_numpy()[::2]), 1)


def test_grid_and_knn(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(20, 1, (30, 8))
    hidden = [(3, 2), (7, 5), (3, 6)]
    c = cells(spark, m)
    features = c.select("study_id", "feature_id").distinct()
    seen = c.where(" and ".join(f"not (feature_id = 'f{i:05d}' and sample_id = 'r{j}')" for i, j in hidden))
    assert complete_grid(seen, features, sheet(spark)).where("value is null").count() == 3
    out = missing.impute(seen, features, sheet(spark), "knn", k=2).toPandas().pivot(index="feature_id", columns="sample_id", values="value").to_numpy()
    x = m.copy()
    for i, j in hidden:
        x[i, j] = np.nan
    for i, j in hidden:
        dist = []
        for k in range(8):
            ok = np.isfinite(x[:, j]) & np.isfinite(x[:, k])
            dist.append(np.sqrt(((x[ok, j] - x[ok, k]) ** 2).sum() * 30 / ok.sum()) if k != j and np.isfinite(x[i, k]) else np.inf)
        assert out[i, j] == pytest.approx(x[i, np.argsort(dist)[:2]].mean())


def test_knn_lays_features_out_in_place(spark):
    """Cells were joined to the grid and shuffled again by feature before; samples that the sheet lacks take no part."""
    m = np.random.default_rng(3).normal(20, 1, (12, 8))
    c = cells(spark, m)
    features = c.select("study_id", "feature_id").distinct()
    seen = c.where("not (feature_id = 'f00003' and sample_id = 'r2')")
    stray = seen.select("study_id", "feature_id").distinct().selectExpr("study_id", "feature_id", "'zz' AS sample_id", "1e6 AS value")
    out = missing.impute(seen.unionByName(stray), features, sheet(spark), "knn", k=3)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.toPandas()
    assert len(got) == 96 and got.value.max() < 1e3
    near = np.argsort([np.sqrt(((np.delete(m, 3, 0)[:, 2] - np.delete(m, 3, 0)[:, j]) ** 2).sum()) if j != 2 else np.inf for j in range(8)])[:3]
    assert got[(got.feature_id == "f00003") & (got.sample_id == "r2")].value.iloc[0] == pytest.approx(m[3, near].mean())


def test_batch_correction_removes_a_shift(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(20, 0.3, (300, 8)) + rng.normal(0, 2, 300)[:, None]
    m[:, 6:] += rng.normal(1.5, 0.2, 300)[:, None]
    out = batch.combat(cells(spark, m), sheet(spark))
    gap = out.join(sheet(spark), ["study_id", "sample_id"]).groupBy("batch").agg(F.avg("value").alias("m")).toPandas().m
    assert abs(gap.diff().iloc[-1]) < 0.05


def test_variance_stabilising_offsets(spark):
    rng = np.random.default_rng(4)
    truth = np.exp(rng.normal(6, 1.5, 400))
    scale = np.array([1, 2, 0.5, 1.5, 1, 3, 0.8, 1])
    m = np.maximum((truth[:, None] * np.exp(rng.normal(0, 0.1, (400, 8))) + rng.normal(0, 20, (400, 8))) * scale, 1.0)
    p = normalize.fit_vsn(cells(spark, m, "linear")).toPandas().sort_values("sample_id")
    rel = p.log_b.to_numpy() + np.log(scale)
    assert np.ptp(rel) < 0.1


def test_lowess_close_to_pointwise_smoother(spark):
    rng = np.random.default_rng(6)
    x = np.sort(rng.uniform(0, 10, 800))
    y = np.sin(x) + rng.normal(0, 0.2, 800)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y}))
    fit = smooth.lowess_grid(df, ["k"], "x", "y", 0.3, 0).first()
    grid = fit.low + np.arange(200) * fit.step
    want = []
    for g in grid:
        d = np.abs(x - g)
        h = np.sort(d)[int(0.3 * 800) - 1]
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        b = np.polyfit(x - g, y, 1, w=np.sqrt(w))
        want.append(b[1])
    assert np.abs(np.array(fit.fitted) - want).max() < 5e-3


def test_lowess_with_one_far_point(spark):
    rng = np.random.default_rng(6)
    x = np.append(np.sort(rng.uniform(0, 10, 800)), 1e6)
    y = np.append(np.sin(x[:-1]) + rng.normal(0, 0.2, 800), 0.0)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y}))
    fit = smooth.lowess_grid(df, ["k"], "x", "y", 0.3, 0)
    got = smooth.add_trend_residual(df, fit, ["k"], "x", "y", "rest").toPandas().sort_values("x")
    want = []
    for g in x[:-1]:
        d = np.abs(x - g)
        h = np.sort(d)[int(0.3 * 801) - 1]
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        want.append(np.polyfit(x - g, y, 1, w=np.sqrt(w))[1])
    assert np.abs((got.y - got.rest).to_numpy()[:-1] - want).max() < 5e-3
    table = smooth.grid_table(fit, ["k"]).toPandas()
    assert (table.x < 10).sum() > 150 and np.ptp(table.fitted[table.x < 10]) > 1


def test_trend_is_read_by_steps(spark):
    """Rows carried an array of all knots before; ends are held, a null stays."""
    fit = spark.createDataFrame([("a", [0.0, 0.001, 1.0, 50.0], [1.0, 3.0, 2.0, 7.0])], "k string, knots array<double>, at_knots array<double>")
    xs = [-3.0, 0.0, 0.0005, 0.001, 0.4, 1.0, 30.0, 50.0, 99.0]
    df = spark.createDataFrame([("a", x) for x in [*xs, None]], "k string, x double")
    out = smooth.interpolated(df, fit, ["k"], "x", "t")
    assert "knots" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    got = {r.x: r.t for r in out.collect()}
    assert got.pop(None) is None and np.allclose([got[x] for x in xs], np.interp(xs, [0, 0.001, 1, 50], [1, 3, 2, 7]))


def test_two_way_fit_recovers_lengths(spark):
    rng = np.random.default_rng(7)
    length, run = rng.normal(0, 1, 200), rng.normal(0, 0.3, 8)
    psm = rng.poisson(20, (200, 8)) + 1
    nsaf = psm / 2.0 ** (length[:, None] + run[None, :] + 24)
    pdf = pd.DataFrame({"study_id": "s", "feature_id": np.repeat([f"f{i:03d}" for i in range(200)], 8), "sample_id": np.tile([f"r{j}" for j in range(8)], 200), "psm": psm.ravel(), "nsaf": nsaf.ravel()})
    t, off = smooth.two_way_median_fit(spark.createDataFrame(pdf))
    got = t.toPandas().sort_values("feature_id").log2_length.to_numpy()
    assert np.abs(got - (length - np.median(length))).max() < 1e-9


def test_permutation_identities(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 6))
    y = 0.5 * x + rng.normal(size=(20, 6))
    pdf = pd.DataFrame({"study_id": "s", "feature_id": np.repeat([f"f{i:02d}" for i in range(20)], 6), "sample_id": np.tile([f"r{j}" for j in range(6)], 20), "x": x.ravel(), "y": y.ravel()})
    df = spark.createDataFrame(pdf).persist()
    rows = ag.perm_p_rowwise(df, "x", "y").toPandas().sort_values("feature_id")
    r = np.array([np.corrcoef(a, b)[0, 1] for a, b in zip(x, y)])
    assert np.allclose(rows.r, r) and rows.p.min() >= 1 / 720
    null = ag.perm_null_shared(df, "x", "y").first()
    assert null.mean_r == pytest.approx(r.mean()) and null.null_mean == pytest.approx(0, abs=1e-12) and null.n_null == 720
    ci = percentile_ci(bootstrap_pearson(df, ["study_id"], "feature_id", "x", "y", 200, 1), ["study_id"]).first()
    assert ci.ci_low < np.corrcoef(x.ravel(), y.ravel())[0, 1] < ci.ci_high


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(10)
    a, b = rng.normal(size=300), rng.normal(size=300)
    y = 1 + 2 * a - b + rng.normal(size=300) * (1 + np.abs(a))
    pdf = pd.DataFrame({"study_id": "s", "feature_id": [f"f{i}" for i in range(300)], "a": a, "b": b, "y": y})
    t = ag.regression_hc3(spark.createDataFrame(pdf), "y", ["a", "b"]).toPandas().set_index("term")
    x = np.column_stack([np.ones(300), (a - a.mean()) / a.std(ddof=1), (b - b.mean()) / b.std(ddof=1)])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    se = np.sqrt(np.diag(inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv))
    assert np.allclose(t.loc[["a", "b"]].coef_per_sd, beta[1:]) and np.allclose(t.loc[["a", "b"]].se_hc3, se[1:])


def test_run_order_exact(spark):
    s = spark.createDataFrame([("s", "A", i, "control" if i < 3 else "treated") for i in range(6)] + [("s", "B", 0, "control"), ("s", "B", 1, "treated")], "study_id string, batch string, seq_number int, condition string")
    r = exact_perm_stratified(s, "control").first()
    assert (r.u, r.u_max) == (10, 10) and r.p_two_sided == pytest.approx(0.05)
