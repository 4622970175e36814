"""Tables of samples by samples against numpy, with tiles smaller than the samples and few cells a feature."""

import numpy as np
import pandas as pd
import pytest

from quantgrid.operators import ids, matrix, qc


def _cells(spark, values, study="s"):
    rows = [(study, f"f{i}", f"r{j:03d}", float(v)) for (i, j), v in np.ndenumerate(values) if not np.isnan(v)]
    return spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double")


@pytest.mark.parametrize("tile", [3, 1024])
@pytest.mark.parametrize("share", [0.1, 0.9])
def test_moments_of_all_pairs(spark, tile, share):
    rng = np.random.default_rng(5)
    v = np.where(rng.random((60, 11)) < share, rng.normal(size=(60, 11)), np.nan)
    w = np.where(rng.random((60, 11)) < share, rng.normal(size=(60, 11)), np.nan)
    df = pd.DataFrame([("s", f"f{i}", f"r{j:03d}", v[i, j], w[i, j]) for i in range(60) for j in range(11)], columns=["study_id", "feature_id", "sample_id", "value", "w"])
    cells = spark.createDataFrame(df)  # absent values are NaN here
    for y, b in ((None, v), ("w", w)):
        got = {(r.sample_a, r.sample_b): r for r in matrix.cross_moments(cells, "value", y, tile=tile).collect()}
        seen = 0
        for i in range(11):
            for j in range(11):
                ok = ~np.isnan(v[:, i]) & ~np.isnan(b[:, j])
                if not ok.any():
                    assert (f"r{i:03d}", f"r{j:03d}") not in got
                    continue
                seen += 1
                x, z, r = v[ok, i], b[ok, j], got[f"r{i:03d}", f"r{j:03d}"]
                assert np.allclose([r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy], [ok.sum(), x.sum(), z.sum(), x @ x, z @ z, x @ z])
        assert seen == len(got)


def test_studies_with_other_numbers_of_samples(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(20, 7)), rng.normal(size=(30, 4))
    cells = _cells(spark, a, "a").union(_cells(spark, b, "b"))
    got = matrix.cross_moments(cells, centre=True, tile=3).toPandas()
    for name, v in (("a", a), ("b", b)):
        c = v - v.mean(axis=1, keepdims=True)
        part = got[got.study_id == name].pivot(index="sample_a", columns="sample_b", values="sxy").sort_index().sort_index(axis=1)
        assert np.allclose(part, c.T @ c)


def test_many_runs_with_few_cells_each(spark):
    rng = np.random.default_rng(7)
    n_features, n_runs, own = 3000, 2500, 30
    runs = np.concatenate([rng.choice(n_runs, own, replace=False) for _ in range(n_features)])
    df = pd.DataFrame({"study_id": "s", "feature_id": np.repeat([f"f{i}" for i in range(n_features)], own), "sample_id": [f"r{j:05d}" for j in runs], "value": rng.normal(size=len(runs))})
    got = matrix.cross_moments(spark.createDataFrame(df)).toPandas()
    assert got.n.sum() == n_features * own**2 and np.isclose(got.sxx.sum(), own * (df.value**2).sum())
    dense = np.zeros((n_features, n_runs))
    dense[np.repeat(np.arange(n_features), own), runs] = df.value
    gram = dense.T @ dense
    i, j = got.sample_a.str[1:].astype(int), got.sample_b.str[1:].astype(int)
    assert np.allclose(got.sxy, gram[i, j])


def test_labels_find_their_samples(spark):
    rng = np.random.default_rng(8)
    truth = np.where(rng.random((80, 9)) < 0.5, rng.lognormal(-6, 3, (80, 9)), 0.0)
    shown = np.array([[float(f"{v:.2e}") for v in row] for row in truth])
    order = rng.permutation(9)
    u = _cells(spark, shown[:, order]).withColumnRenamed("sample_id", "label")
    c = _cells(spark, truth)
    got = {(r.label, r.sample_id): r for r in ids.label_scores(u, c).collect()}
    assert len(got) == 81
    ref = np.array([[float(f"{v:.2e}") for v in row] for row in truth])
    for (label, sample), r in got.items():
        a, b = shown[:, order[int(label[1:])]], ref[:, int(sample[1:])]
        assert r.n == 80 and np.isclose(r.match_fraction, np.mean(np.abs(a - b) <= 1e-8 + 1e-6 * b))
    for r in ids.resolve_labels(u, c).collect():
        assert r.resolved and int(r.sample_id[1:]) == order[int(r.label[1:])]


def test_a_missing_reference_matches_nothing(spark):
    u = spark.createDataFrame([("s", "f", "L", 1.0), ("s", "g", "L", 2.0), ("s", "h", "L", None)], "study_id string, feature_id string, label string, value double")
    c = spark.createDataFrame([("s", "f", "r", 1.0), ("s", "g", "r", None), ("s", "h", "r", 3.0)], "study_id string, feature_id string, sample_id string, value double")
    row = ids.label_scores(u, c).first()
    assert row.n == 2 and row.match_fraction == 0.5


def test_components_of_samples_that_share_no_feature(spark):
    v = np.full((6, 4), np.nan)
    v[:3, :2], v[3:, 2:] = [[1, 2], [3, 5], [2, 7]], [[4, 1], [2, 2], [9, 3]]
    out = qc.pca(_cells(spark, v)).toPandas()
    assert len(out) == 8 and np.isfinite(out.score).all()
