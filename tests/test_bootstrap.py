"""Draws by hashed weights against the same draws in numpy."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantgrid.operators import bootstrap as bs


def words(names):
    digests = [hashlib.md5(n.encode()).hexdigest() for n in names]
    return np.array([[int(d[:8], 16), int(d[8:16], 16)] for d in digests], np.uint32)


def ranks(v):
    order = np.sort(v)
    return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(5)
    rows = []
    for study, features in (("a", 60), ("b", 9), ("c", 1)):
        for f in range(features):
            for r in range(int(rng.integers(1, 5))):
                x = float(rng.normal() + f / 20)
                rows.append((study, f"f{f}", f"r{r}", round(x, 1), x / 2 + float(rng.normal())))
    return rows, spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, x double, y double").repartition(5)


def copies(rows, draws, seed):
    names = sorted({r[1] for r in rows})
    w = bs.draw_counts(words(names), draws, seed)
    return w[[names.index(r[1]) for r in rows]].astype(int)


def test_copies_are_poisson():
    w = bs.draw_counts(words([f"c{i}" for i in range(3000)]), 500, 7).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15
    share = [(w == k).mean() for k in range(4)]
    assert np.allclose(share, [0.3679, 0.3679, 0.1839, 0.0613], atol=0.003)
    assert (bs.draw_counts(words(["a"]), 500, 7) != bs.draw_counts(words(["a"]), 500, 8)).any()


def test_sums_of_draws(cells):
    rows, df = cells
    per = df.groupBy("study_id", "feature_id").agg(F.sum("x").alias("sx"), F.count(F.lit(1)).alias("n"))
    got = {(r.study_id, r.draw): (r.sx, r.n) for r in bs.bootstrap_sums(per, ["study_id"], "feature_id", ["sx", "n"], 40, 3).collect()}
    for study in "abc":
        own = [r for r in rows if r[0] == study]
        w = copies(own, 40, 3)
        for d in range(40):
            assert np.allclose(got[study, d + 1], ((w[:, d] * [r[3] for r in own]).sum(), w[:, d].sum()))
    one = bs.bootstrap_sums(per, [], "feature_id", ["n"], 10, 3)
    assert one.count() == 10


@pytest.mark.parametrize("small", [False, True])
def test_correlations_of_draws(cells, monkeypatch, small):
    rows, df = cells
    if small:  # groups of many blocks
        monkeypatch.setattr(bs, "CELLS", 40)
    draws = 230
    p = {(r.study_id, r.draw): r.stat for r in bs.bootstrap_pearson(df, ["study_id"], "feature_id", "x", "y", draws, 2).collect()}
    s = {(r.study_id, r.draw): r.stat for r in bs.bootstrap_spearman(df, ["study_id"], "feature_id", "x", "y", draws, 2).collect()}
    for study in "ab":
        own = [r for r in rows if r[0] == study]
        x, y, w = np.array([r[3] for r in own]), np.array([r[4] for r in own]), copies(own, draws, 2)
        for d in range(draws):
            a, b = np.repeat(x, w[:, d]), np.repeat(y, w[:, d])
            if len(a) < 2 or a.std() < 1e-9 or b.std() < 1e-9:
                continue
            assert np.isclose(p[study, d + 1], np.corrcoef(a, b)[0, 1])
            assert np.isclose(s[study, d + 1], np.corrcoef(ranks(a), ranks(b))[0, 1])


def test_classes_of_ranks_are_close(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    y = x + rng.normal(size=3000)
    df = spark.createDataFrame([("s", f"f{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "study_id string, feature_id string, x double, y double")
    got = {r.draw: r.stat for r in bs.bootstrap_spearman(df, ["study_id"], "feature_id", "x", "y", 30, 2).collect()}
    w = bs.draw_counts(words([f"f{i}" for i in range(3000)]), 30, 2)
    for d in range(30):
        a, b = np.repeat(x, w[:, d]), np.repeat(y, w[:, d])
        assert abs(got[d + 1] - np.corrcoef(ranks(a), ranks(b))[0, 1]) < 2e-4


def test_interval(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("a", float("nan")), ("a", None)], "g string, stat double")
    r = bs.percentile_ci(df, ["g"]).first()
    assert (r.ci_low, r.ci_high) == (2.5, 97.5)


def test_a_block_is_ranked_in_bounded_memory():
    rng = np.random.default_rng(8)
    n, draws = 150_000, 300  # a copy a cell and draw as doubles would be 360 MB
    w1 = rng.integers(0, 2**32, n // 3).repeat(3)
    cx = np.where(rng.random(n) < 0.4, 7, rng.integers(0, bs.CLASSES, n)).astype(np.int32)
    cy = ((cx + rng.integers(0, 60, n)) % bs.CLASSES).astype(np.int32)
    table = pa.table({"_w1": w1, "_w2": w1[::-1].copy(), "_cx": cx, "_cy": cy}).slice(0)
    tracemalloc.start()
    pieces = bs._pieces(table)
    sums = [bs._class_sums(pieces, min(bs._STRETCH, draws - s), 5, s) for s in range(0, draws, bs._STRETCH)]
    cross = np.concatenate([bs._cross_products(pieces, 5, s * bs._STRETCH, part) for s, part in enumerate(sums)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    w = bs.draw_counts(np.stack([w1, w1[::-1]], axis=1).astype(np.uint32), draws, 5)[:, [0, 249, 250, 299]].astype(float)
    for i, d in enumerate((0, 249, 250, 299)):
        a, b = (np.bincount(c, w[:, i], bs.CLASSES) for c in (cx, cy))
        rx, ry = (np.cumsum(s) - (s - 1) / 2 - (s.sum() + 1) / 2 for s in (a, b))
        assert (np.concatenate(sums, axis=2)[:, :, d] == np.stack([a, b])).all()
        assert np.isclose(cross[d], (w[:, i] * rx[cx] * ry[cy]).sum())
