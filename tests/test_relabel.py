"""Relabelled paired tests against numpy, feature by feature and labelling by labelling."""

import numpy as np
import pandas as pd
import pytest

from quantgrid.functions import special
from quantgrid.model import tag_scale
from quantgrid.operators.de import _solve_prior
from quantgrid.plans import relabel as rl


def brute(d, signs, level=0.1):
    """pi0, first bin, low quarter, hits, d0, s0 of one labelling."""
    m, k = d.shape
    v = d * signs
    effect, s2 = v.mean(1), v.var(1, ddof=1) / 2
    z = np.log(np.maximum(s2, 1e-5 * np.median(s2)))
    p = _solve_prior(pd.Series([z.var(ddof=1)]), pd.Series([float(k - 1)]))
    d0, s0 = p.d0[0], np.exp(z.mean() + p.log_shift[0])
    post = s0 if np.isinf(d0) else (d0 * s0 + (k - 1) * s2) / (d0 + k - 1)
    pv = special.t_two_sided(effect / np.sqrt(post * 2 / k), np.full(m, d0 + k - 1))
    order = np.sort(pv)
    good = np.flatnonzero(order < level * np.arange(1, m + 1) / m)
    hits = good[-1] + 1 if len(good) else 0
    return min(1.0, (pv > 0.5).mean() / 0.5), (pv < 0.05).mean() * 20, (pv < 0.25).mean() * 4, hits, d0, s0


def study(spark, d, name="s"):
    m, k = d.shape
    rng = np.random.default_rng(0)
    base = rng.normal(20, 2, (m, k))
    samples = [(name, f"r{2 * j + t}", ["control", "treated"][t], f"P{j:02d}", "B1") for j in range(k) for t in (0, 1)]
    cells = [(name, f"f{i}", f"r{2 * j + t}", float(base[i, j] + t * d[i, j])) for i in range(m) for j in range(k) for t in (0, 1)]
    c = tag_scale(spark.createDataFrame(cells, "study_id string, feature_id string, sample_id string, value double"), "log2")
    return c, spark.createDataFrame(samples, "study_id string, sample_id string, condition string, candidate_pair string, batch string")


def differences(m, k, seed, zeros=0):
    rng = np.random.default_rng(seed)
    d = rng.normal(0, 1, (m, k)) * np.sqrt(rng.chisquare(6, (m, 1)) / 6) * 0.3
    d[: m // 8] += 1.0
    if zeros:
        d[-zeros:] = 2.0 ** -np.arange(1, zeros + 1)[:, None]  # constant over pairs: a variance of zero as observed
    return d


@pytest.mark.parametrize(("k", "zeros", "slices"), [(4, 0, None), (5, 3, 40), (3, 0, 70)])
def test_all_labellings(spark, monkeypatch, k, zeros, slices):
    if slices:
        monkeypatch.setattr(rl, "SLICE", slices)
        monkeypatch.setattr(rl, "RANKS", 16)
    d = differences(200, k, k, zeros)
    out, ranked = rl.relabel_pairs(*study(spark, d), "control", "treated")
    rows = {r.labelling: r for r in out.collect()}
    assert sorted(rows) == list(range(2 ** (k - 1)))
    for lab, r in rows.items():
        signs = np.array([1.0] + [-1.0 if lab >> (i - 1) & 1 else 1.0 for i in range(1, k)])
        pi0, first, low, hits, d0, s0 = brute(d, signs)
        assert (r.n, r.hits) == (200, hits) and r.observed == (lab == 0)
        assert np.allclose([r.pi0, r.density_first_bin, r.density_low_quarter, r.s0_sq], [pi0, first, low, s0])
        assert np.isclose(r.d0, d0) or (np.isinf(r.d0) and np.isinf(d0))
    one = ranked.first()
    assert one.n_labellings == len(rows) and one.observed_rank == 1 + sum(r.pi0 < rows[0].pi0 for r in rows.values())
    assert rows[0].hits > 10


def test_many_pairs_are_sampled(spark):
    d = differences(120, 20, 1)
    out, ranked = rl.relabel_pairs(*study(spark, d), "control", "treated", most=64, seed=3)
    rows = {r.labelling: r for r in out.collect()}
    signs = rl.sign_patterns(20, 64, 3)
    assert len(rows) == 64 and ranked.first().n_labellings == 64 and (signs[0] == 1).all() and (signs[:, 0] == 1).all()
    for lab in (0, 1, 63):
        want = brute(d, signs[lab])
        assert np.allclose([rows[lab].pi0, rows[lab].density_first_bin, rows[lab].density_low_quarter, rows[lab].hits], want[:4])
    assert rows[0].hits >= max(r.hits for r in rows.values())


def test_butterflies():
    d = np.random.default_rng(1).normal(size=(3, 6))
    got = rl.signed_sums(d, None)
    for lab in range(32):
        signs = np.array([1.0] + [-1.0 if lab >> i & 1 else 1.0 for i in range(5)])
        assert np.allclose(got[:, lab], d @ signs)
