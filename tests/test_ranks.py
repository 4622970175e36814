"""Quantiles, ranks and BH against numpy, with groups in one range and in many."""

import numpy as np
import pandas as pd
import pytest

from quantgrid.operators import ranks as R
from quantgrid.operators.correlation import correlate
from quantgrid.operators.pairs import mw_shift


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    # One group and one value hold most rows.
    v = np.where(rng.random(6000) < 0.3, 0.25, np.round(rng.random(6000), 3))
    pdf = pd.DataFrame({"k": ["a"] * 5900 + ["b"] * 100, "v": v, "id": np.arange(6000)})
    return spark.createDataFrame(pdf).persist(), pdf


@pytest.fixture(params=["one range", "ranges"])
def path(request, monkeypatch):
    if request.param == "ranges":
        monkeypatch.setattr(R, "SMALL_GROUP", 100)
        monkeypatch.setattr(R, "ACCURACY", 1000)


def test_quantiles(frame, path):
    df, pdf = frame
    probs = [0, 0.1, 0.5, 0.9, 0.999, 1]
    got = R.group_quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k].to_numpy(float), np.quantile(g.v, probs), atol=1e-12)


def test_average_ranks(frame, path):
    df, pdf = frame
    got = R.average_ranks(df, ["k"], "v").toPandas().set_index("id")["rank"].sort_index()
    assert np.allclose(got, pdf.groupby("k").v.rank())


def test_positions_and_bins(frame, path):
    df, pdf = frame
    got = R.row_positions(df, ["k"], "v", ["id"], descending=True).toPandas().set_index("id").position.sort_index()
    want = pdf.sort_values(["k", "v", "id"], ascending=[True, False, True])
    want = (want.groupby("k").cumcount() + 1).sort_index()
    assert (got.to_numpy() == want.to_numpy()).all()
    sizes = R.equal_count_bins(df, ["k"], "v", ["id"], 7).groupBy("k", "bin").count().toPandas()
    for _, g in sizes.groupby("k"):
        assert list(g.sort_values("bin")["count"]) == [len(a) for a in np.array_split(np.arange(g["count"].sum()), 7)]


def test_benjamini_hochberg(frame, path):
    df, pdf = frame
    got = R.benjamini_hochberg(df, "v", ["k"]).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("v")
        m = len(g)
        q = np.minimum.accumulate((g.v.to_numpy() * m / np.arange(1, m + 1))[::-1])[::-1]
        assert np.allclose(g.q, np.minimum(q, 1), atol=1e-12)


def test_spearman(frame, path):
    df, pdf = frame
    got = correlate(df, "v", "id", ["k"], "spearman").toPandas().set_index("k").r
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(g.v.rank().corr(g.id.rank()), abs=1e-10)


def test_top_per_group(frame):
    from pyspark.sql import functions as F

    df, pdf = frame
    got = R.top_per_group(df, ["k"], [F.col("v").desc(), F.col("id")], 5, "id").toPandas()
    for k, g in pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("k"):
        assert list(got[got.k == k].sort_values("place").id) == list(g.id[:5])


def test_mann_whitney_shift(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(0.4, 1, 40), rng.normal(0, 1, 55)
    pdf = pd.DataFrame({"s": "a", "g": ["x"] * 40 + ["unmodified"] * 55, "e": np.concatenate([x, y])})
    row = mw_shift(spark.createDataFrame(pdf), ["s"], "g", "unmodified", "e").first()
    diffs = np.sort(np.subtract.outer(x, y).ravel())
    assert row.mw_u == (diffs > 0).sum()
    assert row.hl_shift == pytest.approx(np.median(diffs), abs=1e-8)
    k = int(np.floor(len(diffs) / 2 - 1.959963984540054 * np.sqrt(40 * 55 * 96 / 12)))
    assert row.hl_ci_low == pytest.approx(diffs[k], abs=1e-8)
    assert row.hl_ci_high == pytest.approx(diffs[-1 - k], abs=1e-8)
