"""Pairs swept out of a design against the full model and the paired t."""

import numpy as np
import pytest

from quantgrid.model import tag_scale
from quantgrid.operators import de


def sheet(spark, rows):
    return spark.createDataFrame(rows, "study_id string, sample_id string, condition string, candidate_pair string, batch string, age double")


def table(spark, rows):
    return tag_scale(spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double"), "log2")


def test_a_thousand_pairs_equal_the_paired_t(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(20, 1, (60, 1000))[:, :, None] + rng.normal(0, 0.3, (60, 1000, 2))
    y[:10, :, 1] += 0.05
    samples = sheet(spark, [("s", f"r{2 * j + t}", ["control", "treated"][t], f"P{j}", "B", 1.0) for j in range(1000) for t in (0, 1)])
    cells = table(spark, [("s", f"f{i}", f"r{2 * j + t}", float(y[i, j, t])) for i in range(60) for j in range(1000) for t in (0, 1)])
    projection, terms = de.design_within(samples, "condition", "candidate_pair", (), {"condition": "control"})
    assert projection.selectExpr("max(size(proj))").first()[0] == 2  # however many pairs
    fits = {r.feature_id: r for r in de.add_variance(de.ols(cells, projection), terms).collect()}
    one = terms.first()
    d = y[:, :, 1] - y[:, :, 0]
    for i in range(60):
        r = fits[f"f{i}"]
        se = np.sqrt(r.sigma2 * one.inv_diag)
        assert np.isclose(r.coef[1], d[i].mean()) and np.isclose(se, d[i].std(ddof=1) / np.sqrt(1000)) and one.df == 999
    plan = de.ols(cells, projection)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowexpression") + plan.count("Window [") < 12
    t, info = de.differential_abundance(cells, samples, "condition", (), {"condition": "control"}, "moderated", absorb="candidate_pair")
    assert t.count() == 60 and info.first().residual_df == 999


@pytest.mark.parametrize("method", ["ols", "moderated"])
def test_equal_to_the_full_model(spark, method):
    rng = np.random.default_rng(2)
    samples = [("s", f"r{i}", ["control", "treated", "other"][i % 3], f"P{i // 3}", "B1" if i % 2 else "B2", float(rng.normal())) for i in range(24)]
    cells = [("s", f"f{j}", f"r{i}", float(rng.normal() + i / 9)) for j in range(70) for i in range(24)]
    samples, cells = sheet(spark, samples), table(spark, cells)
    ref = {"condition": "control"}
    full, _ = de.differential_abundance(cells, samples, "condition", ["batch", "age", "candidate_pair"], ref, method)
    less, _ = de.differential_abundance(cells, samples, "condition", ["batch", "age"], ref, method, absorb="candidate_pair")
    key = lambda r: (r.feature_id, r.term)
    whole = {key(r): r for r in full.collect() if "pair" not in r.term}
    got = {key(r): r for r in less.collect()}
    assert whole.keys() == got.keys() and len(got) == 70 * 4
    for k, r in got.items():
        assert np.allclose([r.effect, r.se, r.t, r.p, r.ci_low], [whole[k][c] for c in ("effect", "se", "t", "p", "ci_low")], atol=1e-9)


def test_terms_within_levels(spark):
    rows = [("s", f"r{i}", "control" if i < 4 else "treated", f"P{i // 2}", "B", 1.0) for i in range(8)]
    with pytest.raises(Exception, match="singular"):  # the condition is constant within each pair
        de.design_within(sheet(spark, rows), "condition", "candidate_pair")
    two = [("s", f"r{i}", ["control", "treated"][i % 2], f"P{i // 2}", "B", 1.0) for i in range(2)]
    with pytest.raises(Exception, match="cannot fit"):
        de.design_within(sheet(spark, two), "condition", "candidate_pair")


def test_level_means(spark):
    rows = [("s", f"r{i}", ["control", "treated"][i % 2], f"P{i // 2}", "B", 1.0) for i in range(8)]
    cells = table(spark, [("s", "f", f"r{i}", float(i * i)) for i in range(8)])
    projection, _ = de.design_within(sheet(spark, rows), "condition", "candidate_pair")
    got = {r.block: r.level_mean for r in de.block_effects(cells, projection, de.ols(cells, projection)).collect()}
    assert got == {f"P{j}": ((2 * j) ** 2 + (2 * j + 1) ** 2) / 2 for j in range(4)}
