"""The tracking report against numpy: every variant, method, bin and null."""

import hashlib
import itertools

import numpy as np
from pyspark.sql import functions as F

from quantgrid.functions.numeric import count_bin_labels
from quantgrid.operators import agreement as ag

DRAWS, BIN_DRAWS = 60, 25
VARIANTS = {"plain": "y", "other": "z"}


def ranks(m):
    out = np.empty(m.shape)
    for i, v in enumerate(m):
        s = np.sort(v)
        out[i] = (np.searchsorted(s, v, "left") + np.searchsorted(s, v, "right") + 1) / 2
    return out


def scores(m):
    return (m - m.mean(1, keepdims=True)) / m.std(1, keepdims=True)


def shuffled(x, y, names, draws, seed):
    digests = [hashlib.md5(n.encode()).hexdigest() for n in names]
    words = np.array([[int(d[:8], 16), int(d[8:16], 16)] for d in digests], np.uint32)
    return ag._shuffled_r(scores(x), scores(y), words, draws, seed)


def bh(p):
    order = np.argsort(p)
    q = np.empty(len(p))
    q[order] = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    return q


def test_report_has_all_variants_methods_bins_and_nulls(spark):
    rng = np.random.default_rng(4)
    n, k = 24, 6
    names = [f"f{i}" for i in range(n)]
    count = rng.poisson(np.where(np.arange(n) < 12, 2, 9)[:, None], (n, k)) + 1
    x = rng.normal(size=(n, k)) + np.log2(count)
    data = {"y": np.log2(count) + 0.0, "z": x / 3 + rng.normal(size=(n, k))}
    data["z"][5] = 1.0  # constant: has no r
    rows = [("s", names[i], f"r{j}", float(x[i, j]), float(data["y"][i, j]), float(data["z"][i, j]), int(count[i, j])) for i in range(n) for j in range(k)]
    df = spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, x double, y double, z double, count long")
    roles = spark.createDataFrame([("s", f"r{j}", f"P{j // 2}", j % 2 == 1) for j in range(k)], "study_id string, sample_id string, pair_id string, treated boolean")
    report, bins, features = ag.tracking_report(df, VARIANTS, "x", roles, draws=DRAWS, seed=3, bin_draws=BIN_DRAWS)
    report = {(r.variant, r.method): r for r in report.collect()}
    bins = {(r.variant, r.method, r.mean_count_bin): r for r in bins.collect()}
    features = {(r.variant, r.method, r.feature_id): r for r in features.collect()}
    methods = ("pearson", "spearman", "pearson_within_pair", "pearson_pair_means")
    assert set(report) == set(itertools.product(VARIANTS, methods)) and len(features) == 2 * 4 * n

    labels = count_bin_labels()
    bin_of = np.array([labels[int(np.searchsorted((1, 2, 4, 8, 16, 32), c, "right")) - 1] for c in count.mean(1)])
    orders = np.array(list(itertools.permutations(range(k))))
    share = lambda m: 2 * ((lambda pm: ((pm - pm.mean(1, keepdims=True)) ** 2).sum(1))((m[:, ::2] + m[:, 1::2]) / 2)) / ((m - m.mean(1, keepdims=True)) ** 2).sum(1)
    for variant, column in VARIANTS.items():
        ok = data[column].std(1) > 0
        names_ok = [f for f, o in zip(names, ok) if o]
        for method in ("pearson", "spearman"):
            a, b = (m if method == "pearson" else ranks(m) for m in (x[ok], data[column][ok]))
            r = (scores(a) * scores(b)).mean(1)
            null = np.einsum("fk,fok->fo", scores(a), scores(b)[:, orders]) / k
            p = (np.abs(null) >= np.abs(r)[:, None] - 1e-12).mean(1)
            own = shuffled(a, b, names_ok, DRAWS, 3)
            means, got = own.mean(0), report[variant, method]
            assert np.allclose((got.mean_r, got.median_r, got.share_positive), (r.mean(), np.median(r), (r > 0).mean()))
            assert (got.n_finite, got.n_constant, got.n_null, got.n_indep) == (ok.sum(), (~ok).sum(), len(orders), DRAWS)
            assert np.allclose((got.null_q025, got.null_q975), np.quantile(null.mean(0), [0.025, 0.975]))
            assert np.allclose((got.indep_mean_q025, got.indep_mean_q975), np.quantile(means, [0.025, 0.975]))
            assert np.allclose((got.indep_median_q025, got.indep_median_q975), np.quantile(np.median(own, 0), [0.025, 0.975]))
            assert np.isclose(got.indep_p_two_sided, (1 + (np.abs(means) >= abs(r.mean())).sum()) / (1 + DRAWS))
            assert (got.n_p05, got.n_q05, got.n_q10) == ((p < 0.05).sum(), (bh(p) < 0.05).sum(), (bh(p) < 0.1).sum())
            assert np.allclose([features[variant, method, f].q for f in names_ok], bh(p))
            for label in set(bin_of[ok]):
                at, got = bin_of[ok] == label, bins[variant, method, label]
                own = shuffled(a[at], b[at], np.array(names_ok)[at], BIN_DRAWS, 4)
                assert got.n_finite == at.sum() and np.allclose((got.mean_r, got.median_r), (r[at].mean(), np.median(r[at])))
                assert np.allclose((got.indep_median_q025, got.indep_median_q975), np.quantile(np.median(own, 0), [0.025, 0.975]))
                assert np.allclose((got.median_sd_x, got.median_sd_y), [np.median(m[ok][at].std(1, ddof=1)) for m in (x, data[column])])
        got = report[variant, "pearson_pair_means"]
        assert np.allclose((got.between_share_x, got.between_share_y, got.between_share_expected), (np.median(share(x)), np.median(share(data[column][ok])), 2 / 5))
        assert report[variant, "pearson_within_pair"].n_null == 8


def test_query_reports_counts_normalised_counts_and_fractions(spark, sf, monkeypatch):
    seen = {}

    def kept(df, variants, x, roles, **more):
        seen.update(variants)
        assert {*variants.values(), x, "count"} <= set(df.columns)
        made = ag.rowwise_corr(df, x, variants["fraction"]).select("study_id", F.lit("a").alias("variant"), F.lit("b").alias("method"), *[F.lit(0).alias(c) for c in ("n_features", "n_finite", "n_constant", "n_null", "n_p05", "n_q05", "n_q10", "n_indep")])
        return made, made.select("study_id", "variant", "method", F.lit("1").alias("mean_count_bin")), made

    from quantgrid.catalog import QUERIES

    monkeypatch.setattr(ag, "tracking_report", kept)
    out = QUERIES["tracking_report"](spark, sf)
    assert set(seen) == {"count", "count_run_normalized", "fraction"}
    assert out.where("mean_count_bin is null").count() == out.where("mean_count_bin = '1'").count() > 0
