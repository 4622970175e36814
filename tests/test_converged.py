"""Iterations tell, for each group, whether they came to an end."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from quantgrid.operators import ids, matrix, normalize, smooth

_SCHEMA = "study_id string, parent_id string, feature_id string, sample_id string, value double"


def test_parents_settle_one_by_one(spark):
    rng = np.random.default_rng(2)
    rows = [("s", "even", f"c{i}", f"r{j}", float(i + 2 * j)) for i in range(3) for j in range(4)]
    rows += [("s", "odd", f"d{i}", f"r{j}", float(v)) for (i, j), v in np.ndenumerate(rng.normal(size=(9, 7)))]
    children = spark.createDataFrame(rows, _SCHEMA)
    short = smooth.median_polish(children, rounds=2).toPandas()
    assert short[short.parent_id == "even"].converged.all() and not short[short.parent_id == "odd"].converged.any()
    alone = smooth.median_polish(children.where("parent_id = 'even'"), rounds=2).toPandas()
    pd.testing.assert_frame_equal(*[t[t.parent_id == "even"].sort_values("sample_id").reset_index(drop=True) for t in (short, alone)])
    assert np.allclose(alone.sort_values("sample_id").column_effect.diff().dropna(), 2.0)


def test_studies_settle_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = [("flat", f"f{i}", f"r{j}", 4.0, 2.0**-12) for i in range(4) for j in range(3)]
    rows += [("rough", f"f{i}", f"r{j}", float(rng.integers(1, 90)), float(2.0 ** -rng.uniform(11, 16))) for i in range(9) for j in range(6)]
    table, offsets = smooth.two_way_median_fit(spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, psm double, nsaf double"), rounds=2)
    for t in (table.toPandas(), offsets.toPandas()):
        assert t[t.study_id == "flat"].converged.all() and not t[t.study_id == "rough"].converged.any()


def test_rounds_look_near_the_last_medians(spark, monkeypatch):
    """Each round sought all medians anew before; offsets are those of plain rounds."""
    rng = np.random.default_rng(14)
    y = rng.normal(14, 2, (60, 1)) + rng.normal(0, 0.4, (1, 7)) + rng.normal(0, 0.5, (60, 7))
    y[rng.random(y.shape) < 0.3] = np.nan
    rows = [("s", f"f{i}", f"r{j}", 1.0, float(2.0**-v)) for (i, j), v in np.ndenumerate(y) if np.isfinite(v)]
    y = np.where([[np.isfinite(v) and 2.0**-v < 1e-3 for v in row] for row in y], y, np.nan)
    y = y[~np.isnan(y).all(axis=1)]
    c = np.zeros(7)
    for turn in range(100):
        new = np.nanmedian(y - np.nanmedian(y - c, axis=1, keepdims=True), axis=0)
        new -= new.mean()
        done, c = np.abs(new - c).max() < 1e-12, new
        if done:
            break
    sought, seek = [], smooth.group_median
    monkeypatch.setattr(smooth, "group_median", lambda *a: sought.append(1) or seek(*a))
    _, offsets = smooth.two_way_median_fit(spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, psm double, nsaf double"))
    got = offsets.toPandas().sort_values("sample_id")
    assert turn > 2 and len(sought) == 2 and got.converged.all()
    assert np.abs(got.run_offset.to_numpy() - c).max() < 1e-9


def test_vsn_rounds_do_not_shuffle_cells(spark):
    rng = np.random.default_rng(6)
    v = np.exp(rng.normal(6, 1, (60, 1))) * np.exp(rng.normal(0, 0.1, (60, 4))) + rng.normal(0, 20, (60, 4))
    cells = spark.createDataFrame([("s", f"f{i}", f"r{j}", float(x)) for (i, j), x in np.ndenumerate(v) if (i + j) % 5], "study_id string, feature_id string, sample_id string, value double")
    packed, places = matrix.packed_features(cells, "value")
    assert packed.count() == 60 and places.count() == 4
    p = normalize.fit_vsn(cells, max_rounds=1).toPandas().sort_values("sample_id")
    start = -np.log([np.mean([x for (i, j), x in np.ndenumerate(v) if (i + j) % 5 and j == k]) for k in range(4)])
    assert np.allclose(p.log_b, start) and (p.a == 0).all()
    plan = normalize._vsn_round(packed, places.withColumns({c: F.lit(0.0) for c in ("a", "log_b", "damp", "best", "a0", "log_b0", "moved")}))._jdf.queryExecution().optimizedPlan().toString()
    assert "feature_id" not in plan


def test_vsn_tells_when_it_stopped_early(spark):
    rng = np.random.default_rng(6)
    v = np.exp(rng.normal(6, 1, (60, 1))) * np.exp(rng.normal(0, 0.1, (60, 4))) + rng.normal(0, 20, (60, 4))
    cells = spark.createDataFrame([("s", f"f{i}", f"r{j}", float(x)) for (i, j), x in np.ndenumerate(v)], "study_id string, feature_id string, sample_id string, value double")
    assert not any(r.converged for r in normalize.fit_vsn(cells, max_rounds=1).collect())
    assert all(r.converged for r in normalize.fit_vsn(cells, max_rounds=60).collect())


def test_letters_of_rows(spark):
    rows = [("s", "f", "x", "1", "KA", True), ("s", "f", "y", "2", "AC", True), ("s", "f", "z", "3", "", True), ("s", "f", "w", "4", None, True)]
    t = spark.createDataFrame(rows, "study_id string, feature_id string, localized_sequence string, site_text string, adduct_residues string, unique boolean")
    assert ids.aggregate_isoforms(t).first().adduct_residues == "ACK"
