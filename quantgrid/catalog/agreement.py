"""Agreement of values and counts over the same cells.

x is the log2 normalised value, y the log2 count, f the log2 fraction.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgrid.catalog.base import R, query, rd, with_sql
from quantgrid.catalog.preparation import FRACTION, _fractions, complete
from quantgrid.functions.numeric import count_bin
from quantgrid.model import CELL_KEY, FEATURE, SAMPLE, STUDY, tag_scale
from quantgrid.operators import agreement as ag
from quantgrid.operators import smooth as sm
from quantgrid.operators.bootstrap import CLASSES, DRAWS, GOLDEN, MIX_A, MIX_B, bootstrap_pearson, bootstrap_sd, bootstrap_spearman, bootstrap_weights, percentile_ci, poisson_steps
from quantgrid.operators.design import pair_roles
from quantgrid.operators.missing import complete_cells
from quantgrid.operators.normalize import median_factors, round_fraction
from quantgrid.plans import testbed as tb
from quantgrid.session import materialise


def cells(spark, d, study="one", more=None):
    """All cells with x, y, f and count; factors come from the complete features. ``more`` names columns made of value and count."""
    made = materialise(tb.base_cells(spark, d, study))
    whole_features = complete_cells(tag_scale(made.select(*CELL_KEY, "value"), "linear"), tb.samples(spark, d, study))
    factors = materialise(median_factors(whole_features).select(STUDY, SAMPLE, "factor"))
    # Each cell is a row of its own: its fraction needs its feature's size and its sample's sum, no join of cells.
    sized = made.join(tb.features(spark, d, study).select(STUDY, FEATURE, "p_size"), [STUDY, FEATURE], "left")
    part = materialise(sized.withColumn("_f", F.col("count") / F.col("p_size")))
    sums = materialise(part.groupBy(STUDY, SAMPLE).agg(F.sum("_f").alias("_t")))
    f = F.log2(F.col("_f") / F.col("_t")).alias("f")
    out = part.join(sums, [STUDY, SAMPLE]).join(factors, [STUDY, SAMPLE])
    return materialise(out.select(*CELL_KEY, F.log2(F.col("value") * F.col("factor")).alias("x"), F.log2("count").alias("y"), "count", f, *[c.alias(name) for name, c in (more or {}).items()]))


def whole(spark, d, study="one"):
    """Cells of complete features only."""
    c = cells(spark, d, study)
    return materialise(ag.mark_complete(c, tb.samples(spark, d, study)).where("complete").drop("complete"))


def roles(spark, d, study="one"):
    return materialise(pair_roles(tb.samples(spark, d, study), "control", "treated"))


_XY = """,
xy AS (SELECT b.study_id, b.feature_id, b.sample_id, log2(b.value * factor) AS x, log2(b.count) AS y, b.count AS count, log2(fraction) AS f FROM base b JOIN fac USING (study_id, sample_id) LEFT JOIN frac USING (study_id, feature_id, sample_id)),
cx AS (SELECT * FROM xy SEMI JOIN comp USING (study_id, feature_id))"""


def xy_sql(study: str, body: str) -> str:
    frac = FRACTION.replace("SELECT study_id, feature_id, sample_id, count, (count / p_size)", "SELECT study_id, feature_id, sample_id, (count / p_size)")
    return with_sql(study, "").rstrip() + frac + _XY + "\n" + body


#: Two columns each: normalised value, raw value, count, count plus one and fraction, all as log2.
_COMPARISONS = {"value_vs_count": ("x", "y"), "raw_vs_count": ("raw", "y"), "value_vs_count_plus_one": ("x", "y1"), "value_vs_fraction": ("x", "f"), "count_vs_fraction": ("y", "f")}
_GROUP = "study_id, comparison, subset, scope, scope_sample"
_LONG = f""", xr AS (SELECT xy.*, log2(b.value) AS raw, log2(b.count + 1) AS y1 FROM xy JOIN base b USING (study_id, feature_id, sample_id)),
cm AS ({" UNION ALL ".join(f"SELECT study_id, '{name}' AS comparison, feature_id, sample_id, {x} AS x, {y} AS y FROM xr WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for name, (x, y) in _COMPARISONS.items())}),
lng AS (SELECT study_id, comparison, unnest(CASE WHEN count(*) OVER (PARTITION BY study_id, comparison, feature_id) = n_samples THEN ['all_common', 'complete'] ELSE ['all_common'] END) AS subset, feature_id, sample_id, x, y FROM cm JOIN nsmp USING (study_id)),
sc AS (SELECT study_id, comparison, subset, 'pooled_cells' AS scope, 'all' AS scope_sample, feature_id, x, y FROM lng UNION ALL SELECT study_id, comparison, subset, 'per_sample', sample_id, feature_id, x, y FROM lng
 UNION ALL SELECT study_id, comparison, subset, 'feature_mean', 'mean_over_runs', feature_id, avg(x), avg(y) FROM lng GROUP BY study_id, comparison, subset, feature_id),
rk AS (SELECT *, {", ".join(f"rank() OVER (PARTITION BY {_GROUP} ORDER BY {c}) + (count(*) OVER (PARTITION BY {_GROUP}, {c}) - 1) / 2.0 AS r{c}" for c in "xy")} FROM (SELECT * REPLACE (round(x, 9) AS x, round(y, 9) AS y) FROM sc)),
res AS (SELECT {_GROUP}, count(*) AS n_cells, count(DISTINCT feature_id) AS n_features, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM rk GROUP BY ALL)"""


@query("agreement_correlations", xy_sql("one", _LONG + f" SELECT study_id, comparison, subset, scope, scope_sample, n_cells, n_features, 'pearson' AS method, {R('pearson')} AS r FROM res UNION ALL SELECT study_id, comparison, subset, scope, scope_sample, n_cells, n_features, 'spearman', {R('spearman')} FROM res"))
def agreement_correlations(spark, d):
    c = cells(spark, d, more={"raw": F.log2("value"), "y1": F.log2(F.col("count") + 1)})
    t = ag.agreement_corr(c, _COMPARISONS, tb.samples(spark, d))
    return t.select(STUDY, "comparison", "subset", "scope", "scope_sample", "n_cells", "n_features", "method", rd("r"))


@query("bootstrap_weights", xy_sql("one", "SELECT study_id, draw, cast(count(DISTINCT feature_id) AS double) AS total FROM xy CROSS JOIN (SELECT unnest(range(1, 21)) AS draw) GROUP BY ALL"))
def bootstrap_draws(spark, d):
    """Every draw holds as many features as there are."""
    w = bootstrap_weights(tb.base_cells(spark, d), [STUDY], FEATURE, 20, 7)
    return w.groupBy(STUDY, "draw").agg(F.sum("weight").cast("double").alias("total"))


def _drawn(source: str, seed: int, draws: int = DRAWS) -> str:
    """``wt`` (feature_id, draw, w): the copies of each feature of ``source`` in each draw, those above 0; the hash of ``operators.bootstrap``."""
    copies = " + ".join(f"(h >= {t}::ubigint)::int" for t in poisson_steps())
    return f""", dk AS (SELECT draw, xor(k, k >> 16) AS k FROM (SELECT draw, (xor(k, k >> 13) * {MIX_B}::ubigint) & 4294967295 AS k FROM (SELECT draw, (xor(k, k >> 16) * {MIX_A}::ubigint) & 4294967295 AS k
 FROM (SELECT draw, (draw * {GOLDEN}::ubigint + {seed}) & 4294967295 AS k FROM (SELECT unnest(range(1, {draws + 1}))::ubigint AS draw))))),
nw AS (SELECT feature_id, ('0x' || substr(md5(feature_id), 1, 8))::ubigint AS w1, ('0x' || substr(md5(feature_id), 9, 8))::ubigint AS w2 FROM (SELECT DISTINCT feature_id FROM {source})),
h0 AS (SELECT feature_id, draw, (xor(w1, k) + w2 * (k | 1)) & 4294967295 AS h FROM nw CROSS JOIN dk),
h1 AS (SELECT feature_id, draw, (xor(h, h >> 16) * {MIX_A}::ubigint) & 4294967295 AS h FROM h0),
h2 AS (SELECT feature_id, draw, (xor(h, h >> 13) * {MIX_B}::ubigint) & 4294967295 AS h FROM h1),
h3 AS (SELECT feature_id, draw, xor(h, h >> 16) AS h FROM h2),
wt AS (SELECT feature_id, draw, ({copies})::double AS w FROM h3 WHERE h >= {poisson_steps()[0]}::ubigint)"""


_CI = "quantile_cont({0}, 0.025) AS ci_low, quantile_cont({0}, 0.975) AS ci_high"
#: Weighted moments of x and y over all cells of ``{src}``, a row a draw; x and y are centred on their means first.
_MOMENTS = """, ce AS (SELECT study_id, feature_id, x - avg(x) OVER (PARTITION BY study_id) AS x, y - avg(y) OVER (PARTITION BY study_id) AS y FROM {src}),
cs AS (SELECT study_id, feature_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM ce GROUP BY ALL),
ds AS (SELECT study_id, draw, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * syy) AS syy, sum(w * sxy) AS sxy FROM cs JOIN wt USING (feature_id) GROUP BY ALL),
dm AS (SELECT study_id, draw, n, (sxx - sx * sx / n) / (n - 1) AS vx, (syy - sy * sy / n) / (n - 1) AS vy, (sxy - sx * sy / n) / (n - 1) AS cxy FROM ds WHERE n > 1)"""
_CLASS = f"least(floor((rank() OVER (PARTITION BY study_id ORDER BY {{0}}) + (count(*) OVER (PARTITION BY study_id, {{0}}) - 1) / 2.0 - 0.5) / greatest(1.0, count(*) OVER (PARTITION BY study_id) / {CLASSES}.0)), {CLASSES - 1})::int"
_RHO = f""", kc AS (SELECT study_id, feature_id, {_CLASS.format("x")} AS cx, {_CLASS.format("y")} AS cy FROM xy),
fx AS (SELECT study_id, feature_id, cx, count(*) AS k FROM kc GROUP BY ALL), fy AS (SELECT study_id, feature_id, cy, count(*) AS k FROM kc GROUP BY ALL),
mx AS (SELECT study_id, draw, cx, sum(w * k) AS t FROM fx JOIN wt USING (feature_id) GROUP BY ALL), my AS (SELECT study_id, draw, cy, sum(w * k) AS t FROM fy JOIN wt USING (feature_id) GROUP BY ALL),
rx AS (SELECT study_id, draw, cx, t, sum(t) OVER (PARTITION BY study_id, draw ORDER BY cx) - (t - 1) / 2 - (sum(t) OVER (PARTITION BY study_id, draw) + 1) / 2 AS r FROM mx),
ry AS (SELECT study_id, draw, cy, t, sum(t) OVER (PARTITION BY study_id, draw ORDER BY cy) - (t - 1) / 2 - (sum(t) OVER (PARTITION BY study_id, draw) + 1) / 2 AS r FROM my),
cr AS (SELECT kc.study_id, wt.draw, sum(w * rx.r * ry.r) AS s FROM kc JOIN wt USING (feature_id) JOIN rx ON rx.study_id = kc.study_id AND rx.draw = wt.draw AND rx.cx = kc.cx JOIN ry ON ry.study_id = kc.study_id AND ry.draw = wt.draw AND ry.cy = kc.cy GROUP BY ALL),
rho AS (SELECT study_id, s / sqrt(vx) / sqrt(vy) AS r FROM cr JOIN (SELECT study_id, draw, sum(t * r * r) AS vx FROM rx GROUP BY ALL) USING (study_id, draw) JOIN (SELECT study_id, draw, sum(t * r * r) AS vy FROM ry GROUP BY ALL) USING (study_id, draw))"""


@query("bootstrap_correlation", xy_sql("one", _drawn("xy", 1) + _MOMENTS.format(src="xy") + _RHO + f""" SELECT study_id, method, {R('ci_low')} AS ci_low, {R('ci_high')} AS ci_high FROM (
SELECT study_id, 'pearson' AS method, {_CI.format("cxy / sqrt(vx) / sqrt(vy)")} FROM dm GROUP BY ALL UNION ALL SELECT study_id, 'spearman', {_CI.format("r")} FROM rho GROUP BY ALL)"""))
def bootstrap_correlation(spark, d):
    c = cells(spark, d)
    p = percentile_ci(bootstrap_pearson(c, [STUDY], FEATURE, "x", "y", DRAWS, 1), [STUDY]).withColumn("method", F.lit("pearson"))
    s = percentile_ci(bootstrap_spearman(c, [STUDY], FEATURE, "x", "y", DRAWS, 1), [STUDY]).withColumn("method", F.lit("spearman"))
    return p.unionByName(s).select(STUDY, "method", rd("ci_low"), rd("ci_high"))


@query("bootstrap_spread", xy_sql("one", _drawn("xy", 3) + _MOMENTS.format(src="xy") + f" SELECT study_id, {R('ci_low')} AS ci_low, {R('ci_high')} AS ci_high FROM (SELECT study_id, {_CI.format('sqrt(vy)')} FROM dm GROUP BY ALL)"))
def bootstrap_spread(spark, d):
    return percentile_ci(bootstrap_sd(cells(spark, d), [STUDY], FEATURE, "y", DRAWS, 3), [STUDY]).select(STUDY, rd("ci_low"), rd("ci_high"))


_SHOWN = "CASE WHEN fraction < 1e-3 THEN round_even(fraction * 10 ^ (2 - floor(log10(fraction))), 0) / 10 ^ (2 - floor(log10(fraction))) ELSE round_even(fraction, 3) END"
_FIT_ROUNDS = 100


def _fit_sql() -> str:
    """``o<n>``: offsets after round n. A settled study stays as it is in the rounds that follow."""
    out = f""", sn AS MATERIALIZED (SELECT *, log2(n / q) AS y, q < 1e-3 AS precise FROM (SELECT study_id, feature_id, sample_id, cast(count AS double) AS n, {_SHOWN} AS q FROM frac WHERE fraction > 0)),
o0 AS (SELECT DISTINCT study_id, sample_id, cast(0 AS double) AS c FROM sn)"""
    for i in range(1, _FIT_ROUNDS + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT study_id, feature_id, median(y - c) AS a FROM sn JOIN o{i - 1} USING (study_id, sample_id) WHERE precise GROUP BY ALL),
o{i} AS MATERIALIZED (SELECT study_id, sample_id, v - avg(v) OVER (PARTITION BY study_id) AS c FROM (SELECT study_id, sample_id, coalesce(m, c) AS v FROM o{i - 1} LEFT JOIN (
  SELECT study_id, sample_id, median(y - a) AS m FROM sn JOIN a{i} USING (study_id, feature_id) WHERE precise GROUP BY ALL) USING (study_id, sample_id)))"""
    return out


_LENGTH = f""",
fe AS (SELECT study_id, feature_id, median(y - c) FILTER (precise) AS a, count(*) FILTER (precise) AS n_precise_cells, max(log2(n) - c - log2(q + 5e-4)) FILTER (NOT precise) AS lo,
  min(log2(n) - c - log2(greatest(q - 5e-4, 1e-3))) FILTER (NOT precise) AS hi, median(log2(n) - c - (log2(q + 5e-4) + log2(greatest(q - 5e-4, 1e-3))) / 2) FILTER (NOT precise) AS mid
  FROM sn JOIN o{_FIT_ROUNDS} USING (study_id, sample_id) GROUP BY ALL),
fv AS (SELECT *, CASE WHEN n_precise_cells > 0 THEN 'precise' WHEN lo <= hi THEN 'interval' ELSE 'interval_empty' END AS length_method, CASE WHEN n_precise_cells > 0 THEN a WHEN lo <= hi THEN (lo + hi) / 2 ELSE mid END AS v FROM fe),
cv AS (SELECT study_id, max(abs(x.c - w.c)) < 1e-12 AS converged FROM o{_FIT_ROUNDS} x JOIN o{_FIT_ROUNDS - 1} w USING (study_id, sample_id) GROUP BY ALL)
SELECT study_id, feature_id, {R('v - median(v) OVER (PARTITION BY study_id)')} AS log2_length, length_method, n_precise_cells, converged FROM fv JOIN cv USING (study_id)"""


@query("relative_length", "WITH " + with_sql("one", "", False)[5:] + FRACTION + _fit_sql() + _LENGTH)
def relative_length(spark, d):
    c = _fractions(spark, d).select(*CELL_KEY, F.col("count").alias("psm"), round_fraction(F.col("value")).alias("nsaf"))
    t, _ = sm.two_way_median_fit(c, rounds=_FIT_ROUNDS)
    return t.select(STUDY, FEATURE, rd("log2_length"), "length_method", "n_precise_cells", "converged")


@query("fraction_rounding", "WITH " + with_sql("one", "", False)[5:] + FRACTION + f""" SELECT study_id, feature_id, sample_id, {R(_SHOWN, 9)} AS shown FROM frac""")
def fraction_rounding(spark, d):
    return _fractions(spark, d).where("value is not null").select(*CELL_KEY, rd(round_fraction(F.col("value")), 9, "shown"))


def _trend(spark, d, c=None):
    return sm.lowess_grid(cells(spark, d) if c is None else c, [STUDY], "x", "y", 0.3, 3)


@query("lowess_trend")
def lowess_trend(spark, d):
    return sm.grid_table(_trend(spark, d), [STUDY]).select(STUDY, rd("x", 4), rd("fitted", 4), rd("local_slope", 4))


_NOISE = """, w AS (SELECT study_id, avg(vx) AS wx, avg(vy) AS wy FROM (SELECT study_id, feature_id, var_samp(x) AS vx, var_samp(y) AS vy FROM cx GROUP BY ALL) GROUP BY ALL),
pm AS (SELECT study_id, feature_id, avg(x) AS x, avg(y) AS y FROM cx GROUP BY ALL),
s AS (SELECT study_id, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy, any_value(wy / wx) AS lam, any_value(wx) / 8 AS ex FROM pm JOIN w USING (study_id) GROUP BY ALL)"""


def _points(spark, d):
    c = whole(spark, d)
    means = c.groupBy(STUDY, FEATURE).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    w = ag.within_variances(c, ["x", "y"])
    noise = w.select(STUDY, (F.col("w_y") / F.col("w_x")).alias("lam"), (F.col("w_x") / 8).alias("err_x"))
    return materialise(means), materialise(noise)


@query("slope_estimates", xy_sql("one", _NOISE + f""" SELECT study_id, 'ols_y_on_x' AS estimator, {R('sxy / sxx')} AS slope FROM s UNION ALL SELECT study_id, 'inverse_ols_x_on_y', {R('syy / sxy')} FROM s UNION ALL SELECT study_id, 'sma', {R('sign(sxy) * sqrt(syy / sxx)')} FROM s
UNION ALL SELECT study_id, 'orthogonal', {R('(syy - sxx + sqrt((syy - sxx) ^ 2 + 4 * sxy ^ 2)) / (2 * sxy)')} FROM s UNION ALL SELECT study_id, 'deming', {R('(syy - lam * sxx + sqrt((syy - lam * sxx) ^ 2 + 4 * lam * sxy ^ 2)) / (2 * sxy)')} FROM s
UNION ALL SELECT study_id, 'ols_attenuation_corrected', {R('sxy / sxx / (1 - ex / sxx)')} FROM s"""))
def slope_estimates(spark, d):
    return ag.slopes(*_points(spark, d)).select(STUDY, "estimator", rd("slope"))


_SLOPE_CI = _NOISE + _drawn("pm", 5) + _MOMENTS.format(src="pm") + """, de AS (SELECT study_id, cxy / vx AS ols_y_on_x, vy / cxy AS inverse_ols_x_on_y, sign(cxy) * sqrt(vy / vx) AS sma,
 (vy - vx + sqrt((vy - vx) ^ 2 + 4 * cxy ^ 2)) / (2 * cxy) AS orthogonal, (vy - lam * vx + sqrt((vy - lam * vx) ^ 2 + 4 * lam * cxy ^ 2)) / (2 * cxy) AS deming, cxy / vx / (1 - ex / sxx) AS ols_attenuation_corrected FROM dm JOIN s USING (study_id)),
du AS (UNPIVOT de ON ols_y_on_x, inverse_ols_x_on_y, sma, orthogonal, deming, ols_attenuation_corrected INTO NAME estimator VALUE slope)"""


@query("slope_intervals", xy_sql("one", _SLOPE_CI + f" SELECT study_id, estimator, {R('ci_low')} AS ci_low, {R('ci_high')} AS ci_high FROM (SELECT study_id, estimator, {_CI.format('slope')} FROM du GROUP BY ALL)"))
def slope_intervals(spark, d):
    return ag.slopes(*_points(spark, d), draws=DRAWS, seed=5).select(STUDY, "estimator", rd("ci_low"), rd("ci_high"))


@query("reliability", xy_sql("three", f"""SELECT study_id, {R('1 - avg(vx) / 8 / var_samp(mx)')} AS reliability_x, {R('1 - avg(vy) / 8 / var_samp(my)')} AS reliability_y FROM (SELECT study_id, feature_id, var_samp(x) AS vx, var_samp(y) AS vy, avg(x) AS mx, avg(y) AS my FROM cx GROUP BY ALL) GROUP BY ALL"""))
def reliability(spark, d):
    return ag.reliability(whole(spark, d, "three"), ["x", "y"]).select(STUDY, rd("reliability_x"), rd("reliability_y"))


@query("spread_summary", xy_sql("one", f"""SELECT study_id, sample_id, count(x) AS n, {R('stddev_samp(x)')} AS sd, {R('max(x) - min(x)')} AS "range", {R('quantile_cont(x, 0.99) - quantile_cont(x, 0.01)')} AS span_q01_q99, {R('(quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) * log10(2)')} AS span_q05_q95_log10 FROM xy GROUP BY ALL"""))
def spread_summary(spark, d):
    return ag.spread(cells(spark, d), [STUDY, SAMPLE], "x").select(STUDY, SAMPLE, "n", rd("sd"), rd("range"), rd("span_q01_q99"), rd("span_q05_q95_log10"))


_BIN = "CASE WHEN {c} >= 32 THEN '>=32' WHEN {c} >= 16 THEN '16-31' WHEN {c} >= 8 THEN '8-15' WHEN {c} >= 4 THEN '4-7' WHEN {c} >= 2 THEN '2-3' WHEN {c} >= 1 THEN '1' END"


@query("count_bins", "WITH " + with_sql("flag", "", False)[5:] + f" SELECT study_id, {_BIN.format(c='n')} AS bin, count(*) AS features FROM (SELECT study_id, feature_id, sum(count) AS n FROM base GROUP BY ALL) GROUP BY ALL")
def count_bins(spark, d):
    t = tb.base_cells(spark, d, "flag").groupBy(STUDY, FEATURE).agg(F.sum("count").alias("n"))
    return t.groupBy(STUDY, count_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("features"))


@query("poisson_log2_variance")
def poisson_log2_variance(spark, d):
    m = tb.base_cells(spark, d).groupBy(STUDY, FEATURE).agg(F.avg("count").alias("mean_count"))
    return ag.poisson_log2_variance(m, "mean_count").select(STUDY, FEATURE, rd("mean_count"), rd("poisson_var"))


def _residual_cells(spark, d):
    c = cells(spark, d)
    return materialise(sm.add_trend_residual(c, _trend(spark, d, c), [STUDY], "x", "y", "resid"))


@query("residual_by_count_bin", xy_sql("one", f"SELECT study_id, {_BIN.format(c='count')} AS count_bin, count(*) AS n_cells, count(DISTINCT feature_id) AS n_features, {R('median(x)')} AS x_median, {R('stddev_samp(x - 2 * y)')} AS resid_sd, {R('quantile_cont(x, 0.9)')} AS x_q90 FROM xy GROUP BY ALL"))
def residual_by_count_bin(spark, d):
    c = cells(spark, d).withColumn("r", F.col("x") - 2 * F.col("y"))
    return ag.residual_bins_by_count(c, "r").select(STUDY, "count_bin", "n_cells", "n_features", rd("x_median"), rd("resid_sd"), rd("x_q90"))


@query("residual_by_decile", xy_sql("one", f"""SELECT study_id, decile, count(*) AS n_cells, {R('stddev_samp(y - x / 2)')} AS resid_sd, {R('avg(cast(count = 1 AS int))')} AS share_count_1, {R('median(count)')} AS median_count FROM (
SELECT *, 1 + len(list_filter(e, lambda v: x >= v)) AS decile FROM (SELECT *, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) OVER (PARTITION BY study_id) AS e FROM xy)) GROUP BY ALL"""))
def residual_by_decile(spark, d):
    c = cells(spark, d).withColumn("r", F.col("y") - F.col("x") / 2)
    return ag.residual_bins_by_value(c, "r").select(STUDY, F.col("decile").cast("bigint").alias("decile"), "n_cells", rd("resid_sd"), rd("share_count_1"), rd("median_count"))


@query("residual_trend_by_decile")
def residual_trend_by_decile(spark, d):
    out = ag.residual_bins_by_value(_residual_cells(spark, d), "resid", draws=DRAWS, seed=2)
    return out.select(STUDY, "decile", "n_cells", rd("resid_sd", 4), rd("poisson_sd"), rd("poisson_var_share", 4), rd("spearman"))


@query("variance_partition", xy_sql("three", f"SELECT study_id, {R('any_value(tv)')} AS total_var, {R('var_samp(m)')} AS between_var, {R('avg(v)')} AS within_var FROM (SELECT study_id, feature_id, avg(y - x) AS m, var_samp(y - x) AS v FROM cx GROUP BY ALL) JOIN (SELECT study_id, var_samp(y - x) AS tv FROM cx GROUP BY ALL) USING (study_id) GROUP BY ALL"))
def variance_partition(spark, d):
    c = whole(spark, d, "three").withColumn("r", F.col("y") - F.col("x"))
    return ag.variance_partition(c, "r").select(STUDY, rd("total_var"), rd("between_var"), rd("within_var"))


@query("count_noise", xy_sql("one", f""", o AS (SELECT study_id, sample_id, median(y - m) AS o FROM (SELECT *, avg(y) OVER (PARTITION BY study_id, feature_id) AS m FROM cx) GROUP BY ALL),
v AS (SELECT study_id, feature_id, avg(count) AS mc, var_samp(y - o) AS vy FROM cx JOIN o USING (study_id, sample_id) GROUP BY ALL)
SELECT study_id, {_BIN.format(c='mc')} AS mean_count_bin, count(*) AS n_features, {R('sqrt(avg(vy))')} AS y_rms_sd, {R('median(sqrt(vy))')} AS y_sd_median FROM v GROUP BY ALL"""))
def count_noise(spark, d):
    return ag.count_noise(whole(spark, d)).select(STUDY, "mean_count_bin", "n_features", rd("y_rms_sd"), rd("y_sd_median"))


@query("count_overdispersion")
def count_overdispersion(spark, d):
    return ag.count_noise(whole(spark, d, "three")).select(STUDY, "mean_count_bin", rd("poisson_rms_sd"), rd("overdispersion", 5))


def _properties(spark, d):
    c = whole(spark, d)
    p = tb.features(spark, d).select(STUDY, FEATURE, F.col("p_size").cast("double").alias("size"), F.length("p_type").cast("double").alias("len"))
    m = c.groupBy(STUDY, FEATURE).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_samp("x").alias("sx"))
    return materialise(m.join(p, [STUDY, FEATURE]).withColumn("resid", F.col("my") - F.col("mx")))


_PROP = """, pr AS (SELECT study_id, feature_id, avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, any_value(cast(p_size AS double)) AS size, any_value(cast(length(p_type) AS double)) AS len, avg(y) - avg(x) AS resid FROM cx JOIN feat USING (study_id, feature_id) WHERE p_size IS NOT NULL GROUP BY ALL)"""


def _rank_sql(c):
    return f"rank() OVER (PARTITION BY study_id ORDER BY {c}) + (count(*) OVER (PARTITION BY study_id, {c}) - 1) / 2.0 AS r_{c}"


@query("residual_drivers", xy_sql("one", _PROP + f""", rr AS (SELECT study_id, {_rank_sql('resid')}, {_rank_sql('size')}, {_rank_sql('len')} FROM pr) SELECT study_id, 'resid' AS residual, 'size' AS property, count(*) AS n, {R('corr(r_resid, r_size)')} AS r FROM rr GROUP BY ALL UNION ALL SELECT study_id, 'resid', 'len', count(*), {R('corr(r_resid, r_len)')} FROM rr GROUP BY ALL"""))
def residual_drivers(spark, d):
    return ag.residual_drivers(_properties(spark, d), ["resid"], ["size", "len"]).select(STUDY, "residual", "property", "n", rd("r"))


@query("residual_driver_tests")
def residual_driver_tests(spark, d):
    return ag.residual_drivers(_properties(spark, d), ["resid", "my"], ["size", "len", "sx"]).select(STUDY, "residual", "property", rd("r"), rd("p", 9), rd("q", 9))


@query("regression_two_terms", xy_sql("one", _PROP + f""", c AS (SELECT study_id, count(*) AS n, corr(resid, size) AS ya, corr(resid, sx) AS yb, corr(size, sx) AS ab, stddev_samp(resid) AS sy FROM pr GROUP BY ALL)
SELECT study_id, 'size' AS term, n, {R('sy * (ya - yb * ab) / (1 - ab ^ 2)')} AS coef_per_sd, {R('ya ^ 2')} AS r2_alone, {R('(ya ^ 2 + yb ^ 2 - 2 * ya * yb * ab) / (1 - ab ^ 2)')} AS model_r2 FROM c
UNION ALL SELECT study_id, 'sx', n, {R('sy * (yb - ya * ab) / (1 - ab ^ 2)')}, {R('yb ^ 2')}, {R('(ya ^ 2 + yb ^ 2 - 2 * ya * yb * ab) / (1 - ab ^ 2)')} FROM c"""))
def regression_two_terms(spark, d):
    return ag.regression_hc3(_properties(spark, d), "resid", ["size", "sx"]).select(STUDY, "term", "n", rd("coef_per_sd"), rd("r2_alone"), rd("model_r2"))


@query("regression_hc3")
def regression_hc3(spark, d):
    t = ag.regression_hc3(_properties(spark, d), "resid", ["size", "len", "sx"], draws=DRAWS, seed=9)
    return t.select(STUDY, "term", rd("coef_per_sd"), rd("se_hc3"), rd("p", 9), rd("q", 9), rd("delta_r2_drop"), rd("ci_low"), rd("ci_high"))


@query("partial_residuals", xy_sql("one", _PROP + f""", g AS (SELECT study_id, corr(resid, size) AS ya, corr(resid, sx) AS yb, corr(size, sx) AS ab, stddev_samp(resid) AS sy, avg(resid) AS mr, avg(sx) AS m2, stddev_samp(sx) AS s2 FROM pr GROUP BY ALL)
SELECT study_id, feature_id, {R('resid - mr - sy * (yb - ya * ab) / (1 - ab ^ 2) * (sx - m2) / s2')} AS partial_residual FROM pr JOIN g USING (study_id)"""))
def partial_residuals(spark, d):
    p = _properties(spark, d)
    stored = materialise(ag.regression_hc3(p, "resid", ["size", "sx"])).select(STUDY, "term", "coef_per_sd")
    return ag.partial_residuals(p, "resid", "size", ["sx"], stored=stored).select(STUDY, FEATURE, rd("partial_residual"))


def _detect(spark, d, least=40_000):
    """Cells by return flag; a value needs two line items, a count is always there."""
    c = tb.base_cells(spark, d, "flag", sparse=True)
    return materialise(c.withColumn("v", F.when(F.col("value") > least, F.log2("value"))))


_DET = """, dt AS (SELECT *, CASE WHEN value > 40000 THEN log2(value) END AS v FROM base), ev AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY study_id, feature_id) = 1 AS ever FROM dt)"""


def _n_features(spark, d, study="flag"):
    return tb.features(spark, d, study).groupBy(STUDY).agg(F.count(F.lit(1)).alias("n_features"))


@query("detection_classes", "WITH " + with_sql("flag", "", False, sparse=True)[5:] + _DET + f""" SELECT study_id, sample_id, count_if(v IS NOT NULL) AS n_both, count_if(v IS NULL) AS n_count_only, count_if(v IS NULL AND NOT ever) AS n_count_only_never, any_value(nf) - count(*) AS n_neither, {R('median(CASE WHEN v IS NOT NULL THEN count END)')} AS median_count_both
FROM ev JOIN (SELECT study_id, count(*) AS nf FROM feat GROUP BY ALL) USING (study_id) GROUP BY ALL""")
def detection_classes(spark, d):
    t = ag.detection_classes(_detect(spark, d), "v", "count", tb.samples(spark, d, "flag", sparse=True), _n_features(spark, d))
    return t.select(STUDY, SAMPLE, "n_both", "n_count_only", "n_count_only_never", "n_neither", rd("median_count_both"))


@query("count_distribution", "WITH " + with_sql("flag", "", False, sparse=True)[5:] + _DET + f" SELECT study_id, sample_id, CASE WHEN v IS NOT NULL THEN 'both' WHEN ever THEN 'count_only_other_runs' ELSE 'count_only_never' END AS class, {_BIN.format(c='count')} AS count_bin, count(*) AS n_features FROM ev GROUP BY ALL")
def count_distribution(spark, d):
    return ag.count_distribution(_detect(spark, d), "v", "count")


@query("auc", "WITH " + with_sql("flag", "", False)[5:] + f""", a AS (SELECT study_id, count, value > 60000 AS g, rank() OVER (PARTITION BY study_id ORDER BY count) + (count(*) OVER (PARTITION BY study_id, count) - 1) / 2.0 AS r FROM base)
SELECT study_id, count_if(g) AS nx, count_if(NOT g) AS ny, {R('(sum(CASE WHEN g THEN r ELSE 0 END) - count_if(g) * (count_if(g) + 1) / 2) / (count_if(g) * count_if(NOT g))')} AS auc FROM a GROUP BY ALL""")
def auc(spark, d):
    c = tb.base_cells(spark, d, "flag").withColumn("g", F.col("value") > 60000)
    return ag.auc(c, [STUDY], "g", "count").select(STUDY, F.col("nx").cast("bigint").alias("nx"), F.col("ny").cast("bigint").alias("ny"), rd("auc"))


# --- children and sharing: a child is a part and return flag; its members are its brand
# and, for some parts, the type as a second member


def _children(spark, d):
    line = tb.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    part = tb.table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    keyed = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    members = F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type")).otherwise(F.array("p_brand"))
    c = keyed.select(
        F.lit("s0").alias(STUDY), F.concat_ws("_", F.col("l_partkey").cast("string"), "l_returnflag").alias(FEATURE), members.alias("members"),
        tb.sample_key(False).alias(SAMPLE), "l_extendedprice",
    ).groupBy(*CELL_KEY, "members").agg(F.sum("l_extendedprice").alias("value"), F.count(F.lit(1)).alias("psm"))
    return materialise(c.withColumn("detection_type", F.when(F.col("psm") > 1, "MSMS").otherwise("MBR")))


_KID = """WITH ch AS (SELECT 's0' AS study_id, l_partkey || '_' || l_returnflag AS feature_id, 'r' || (l_suppkey % 8) AS sample_id, CASE WHEN p_size % 3 = 0 THEN [p_brand, p_type] ELSE [p_brand] END AS members, sum(l_extendedprice) AS value, count(*) AS psm,
 CASE WHEN count(*) > 1 THEN 'MSMS' ELSE 'MBR' END AS dt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), rw AS (SELECT DISTINCT study_id, feature_id, members FROM ch), lk AS (SELECT study_id, feature_id, len(members) AS k, unnest(members) AS parent_id FROM rw)"""


#: Detection by size: small cells of a child carry no value, and not always for the same reason.
_KINDS = (("NotDetected", 10_000), ("MSMSIdentifiedButNotQuantified", 15_000), ("MSMSAmbiguousPeakfinding", 20_000))
_TYPES = ("MSMS", "MBR", *[t for t, _ in _KINDS])


def _graded(children):
    kind = F.col("detection_type")
    for name, below in reversed(_KINDS):
        kind = F.when(F.col("value") < below, name).otherwise(kind)
    return children.withColumn("detection_type", kind).withColumn("value", F.when(F.col("value") >= _KINDS[-1][1], F.col("value")))


@query("child_summary", _KID + f""", ck AS (SELECT *, CASE {" ".join(f"WHEN value < {below} THEN '{name}'" for name, below in _KINDS)} ELSE dt END AS kind FROM ch),
lq AS (SELECT feature_id, q, len(members) AS k, unnest(members) AS parent_id FROM (SELECT feature_id, members, max(value) >= {_KINDS[-1][1]} AS q FROM ck GROUP BY ALL)),
ta AS (SELECT parent_id, count_if(k = 1) AS n_unique_rows, count_if(k = 1 AND q) AS n_unique_quantified, count_if(k > 1) AS n_shared_rows, count_if(k > 1 AND q) AS n_shared_quantified FROM lq GROUP BY ALL),
kt AS (SELECT members[1] AS parent_id, {", ".join(f"count_if(kind = '{t}') AS det_{t}" for t in _TYPES)} FROM ck WHERE len(members) = 1 GROUP BY ALL),
mk AS (SELECT DISTINCT parent_id FROM lq SEMI JOIN (SELECT feature_id FROM lq WHERE k > 1 AND parent_id IN (SELECT p_type FROM part WHERE p_size > 40)) USING (feature_id)),
pa AS (SELECT p_brand AS parent_id FROM part UNION SELECT p_type FROM part)
SELECT 's0' AS study_id, parent_id, coalesce(n_unique_rows, 0) AS n_unique_rows, coalesce(n_unique_quantified, 0) AS n_unique_quantified, coalesce(n_shared_rows, 0) AS n_shared_rows, coalesce(n_shared_quantified, 0) AS n_shared_quantified,
 {", ".join(f"coalesce(det_{t}, 0) AS det_{t}" for t in _TYPES)}, parent_id IN (SELECT parent_id FROM mk) AS shares_with_flagged FROM pa LEFT JOIN ta USING (parent_id) LEFT JOIN kt USING (parent_id)""")
def child_summary(spark, d):
    part = tb.table(spark, d, "part")
    parents = part.select(F.col("p_brand").alias("parent_id")).unionByName(part.select(F.col("p_type").alias("parent_id"))).distinct().withColumn(STUDY, F.lit("s0"))
    s, _ = ag.child_summary(_graded(_children(spark, d)), parents, part.where("p_size > 40").select(F.col("p_type").alias("member")))
    return s


@query("child_runs", _KID + f" SELECT study_id, members[1] AS parent_id, sample_id, count_if(dt = 'MSMS') AS n_unique_msms, count_if(dt = 'MBR') AS n_unique_mbr, {R('''sum(CASE WHEN dt = 'MBR' THEN value ELSE 0 END) / sum(value)''')} AS mbr_share FROM ch WHERE len(members) = 1 GROUP BY ALL")
def child_runs(spark, d):
    c = _children(spark, d)
    _, runs = ag.child_summary(c, c.select(STUDY, F.col("members")[0].alias("parent_id")).distinct())
    return runs.select(STUDY, "parent_id", SAMPLE, "n_unique_msms", "n_unique_mbr", rd("mbr_share"))


@query("sharing_partners", _KID + """, pt AS (SELECT a.study_id, a.parent_id, b.parent_id AS partner, count(*) AS n FROM lk a JOIN lk b USING (study_id, feature_id) WHERE a.parent_id <> b.parent_id GROUP BY ALL)
SELECT study_id, parent_id, string_agg(partner || '(' || n || ')', ';' ORDER BY n DESC, partner) AS sharing_partners FROM (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY study_id, parent_id ORDER BY n DESC, partner) <= 3) GROUP BY ALL""")
def sharing_partners(spark, d):
    return ag.sharing_partners(_children(spark, d))


@query("shared_fraction", _KID + f""", gk AS (SELECT DISTINCT p_brand AS member, p_brand AS group_id FROM part), ow AS (SELECT study_id, feature_id, k > 1 AS shared, parent_id AS group_id FROM lk SEMI JOIN gk ON gk.member = lk.parent_id)
SELECT study_id, group_id, sample_id, cast(sum(psm) AS bigint) AS psm_total, {R('sum(CASE WHEN shared THEN psm ELSE 0 END) / sum(psm)')} AS shared_fraction FROM ch JOIN ow USING (study_id, feature_id) GROUP BY ALL""")
def shared_fraction(spark, d):
    g = tb.table(spark, d, "part").select(F.lit("s0").alias(STUDY), F.col("p_brand").alias("group_id"), F.array("p_brand").alias("members")).distinct()
    s, _, _ = ag.shared_fraction(g, _children(spark, d))
    return s.select(STUDY, "group_id", SAMPLE, "psm_total", rd("shared_fraction"))


@query("contaminant_sharing", _KID + """, fl AS (SELECT DISTINCT p_type AS member FROM part), pc AS (SELECT study_id, feature_id, count_if(parent_id NOT IN (SELECT member FROM fl)) AS nr, count_if(parent_id IN (SELECT member FROM fl)) AS nc FROM lk GROUP BY ALL)
SELECT study_id, parent_id, count(*) AS n_rows, count_if(nr = 1 AND nc > 0) AS n_gained, count_if(nr = 1 AND nc > 0) = count(*) AS exclusive FROM lk JOIN pc USING (study_id, feature_id) WHERE parent_id NOT IN (SELECT member FROM fl) GROUP BY ALL HAVING count_if(nr = 1 AND nc > 0) > 0""")
def contaminant_sharing(spark, d):
    c = _children(spark, d).groupBy(STUDY, FEATURE, "members").agg(F.max(F.col("value") > 0).alias("quantified"))
    flagged = tb.table(spark, d, "part").select(F.col("p_type").alias("member")).distinct()
    runs = flagged.withColumn(STUDY, F.lit("s0")).withColumn("n_runs", F.lit(1))
    return ag.contaminant_sharing(c, flagged, runs).select(STUDY, "parent_id", "n_rows", "n_gained", "exclusive")


def _line_children(spark, d):
    """Children of parts: a line number of a part, every third shared with the part's brand, with a value from 20,000 on."""
    line = tb.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    part = tb.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    own = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    members = F.when((F.col("l_linenumber") % 3 == 0) & F.col("p_brand").isNotNull(), F.array(own, F.col("p_brand"))).otherwise(F.array(own))
    keyed = line.join(part, "l_partkey", "left").select(
        F.col("l_returnflag").alias(STUDY), F.concat_ws("_", own, F.col("l_linenumber").cast("string")).alias(FEATURE), members.alias("members"), tb.sample_key(True).alias(SAMPLE), "l_extendedprice",
    )
    cells = keyed.groupBy(*CELL_KEY, "members").agg(F.max("l_extendedprice").alias("_v"), F.count(F.lit(1)).alias("_n"))
    seen = F.col("_v") >= 20_000
    return cells.select(*CELL_KEY, "members", F.when(seen, F.col("_v")).alias("value"), F.when(~seen, "NotDetected").when(F.col("_n") > 1, "MSMS").otherwise("MBR").alias("detection_type"))


@query("no_value_reasons", "WITH " + with_sql("flag", "", False, sparse=True)[5:] + _DET.replace("40000", "80000") + """, kid AS (SELECT l_returnflag AS study_id, 'p' || l_partkey AS feature_id, l_linenumber, any_value(l_linenumber % 3 = 0 AND p_brand IS NOT NULL) AS shared, max(l_extendedprice) >= 20000 AS q
 FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL),
kt AS (SELECT study_id, feature_id, count_if(NOT shared) AS n_unique_rows, count_if(NOT shared AND q) AS n_unique_quantified, count_if(shared) AS n_shared_rows, count_if(shared AND q) AS n_shared_quantified FROM kid GROUP BY ALL),
nv AS (SELECT study_id, feature_id, cast(sum(count) AS bigint) AS total_count, max(count) AS max_count, count(*) AS n_runs_with_count FROM ev WHERE NOT ever GROUP BY ALL)
SELECT nv.*, n_unique_rows, n_unique_quantified, n_shared_rows, n_shared_quantified, CASE WHEN is_contaminant THEN 'source_token' WHEN n_unique_rows = 0 THEN 'shared_children_only' WHEN n_unique_quantified = 0 THEN 'unique_children_never_quantified' ELSE 'unique_child_quantified_but_no_value' END AS reason
FROM nv JOIN feat USING (study_id, feature_id) JOIN kt USING (study_id, feature_id)""")
def no_value_reasons(spark, d):
    f = tb.features(spark, d, "flag")
    kids, _ = ag.child_summary(_line_children(spark, d), f.select(STUDY, F.col(FEATURE).alias("parent_id")))
    return ag.no_value_reasons(_detect(spark, d, 80_000), "v", "count", kids, f.where("is_contaminant"))


@query("value_without_count", "WITH " + with_sql("flag", "", False)[5:] + f", m AS (SELECT *, CASE WHEN count > 1 THEN count END AS c2 FROM base) SELECT study_id, feature_id, sample_id, {R('log2(value)')} AS v, k AS n_runs_with_count FROM m JOIN (SELECT study_id, feature_id, count(c2) AS k FROM m GROUP BY ALL) USING (study_id, feature_id) WHERE c2 IS NULL")
def value_without_count(spark, d):
    c = tb.base_cells(spark, d, "flag").withColumn("v", F.log2("value")).withColumn("c2", F.when(F.col("count") > 1, F.col("count")))
    kids = c.select(STUDY, F.col(FEATURE).alias("parent_id"), SAMPLE)
    return ag.value_without_count(c, "v", "c2", kids).select(*CELL_KEY, rd("v"), "n_runs_with_count")


# --- tracking ------------------------------------------------------------------------------


@query("rowwise_correlation", xy_sql("three", f"SELECT study_id, feature_id, count(*) AS n, {R('CASE WHEN var_pop(y) > 1e-20 THEN corr(x, y) END')} AS r FROM cx GROUP BY ALL"))
def rowwise_correlation(spark, d):
    return ag.rowwise_corr(whole(spark, d, "three"), "x", "y").select(STUDY, FEATURE, "n", rd("r"))


@query("rowwise_permutation_p")
def rowwise_permutation_p(spark, d):
    return ag.perm_p_rowwise(whole(spark, d), "x", "y").select(STUDY, FEATURE, rd("r"), rd("p", 9))


@query("shared_permutation_null", xy_sql("three", f"SELECT study_id, count(r) AS n_features, {R('avg(r)')} AS mean_r, 40320 AS n_null FROM (SELECT study_id, feature_id, CASE WHEN var_pop(y) > 1e-20 THEN corr(x, y) END AS r FROM cx GROUP BY ALL) GROUP BY ALL"))
def shared_permutation_null(spark, d):
    return ag.perm_null_shared(whole(spark, d, "three"), "x", "y").select(STUDY, "n_features", rd("mean_r"), F.col("n_null").cast("int").alias("n_null"))


@query("shared_permutation_tests")
def shared_permutation_tests(spark, d):
    return ag.perm_null_shared(whole(spark, d), "x", "y", "spearman").select(STUDY, rd("mean_r"), rd("null_mean"), rd("null_q025"), rd("null_q975"), rd("p_one_sided", 9), rd("p_two_sided", 9))


def _partner(i: int, factor: int, addend: int, k: int) -> str:
    taken = f"(((((h * {factor}::ubigint + {addend}::ubigint) & 4294967295) >> 8) * {k - i}::ubigint) >> 24)"
    return f"[{taken}::double, zx[{i + 1}], {k - 1 - i}.0]"


_LEFT = "lambda a, e: [a[1] + e[2] * a[(e[1] + 2)::int]] || a[2:(e[1] + 1)::int] || (CASE WHEN e[1] < e[3] THEN [a[(e[3] + 2)::int]] ELSE [] END) || a[(e[1] + 3)::int:(e[3] + 1)::int]"


@query("independent_permutation_null", xy_sql("one", _drawn("cx", 4) + f""", us AS (SELECT study_id, feature_id, sample_id, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS zx, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS zy
 FROM cx WINDOW w AS (PARTITION BY study_id, feature_id) QUALIFY stddev_pop(x) OVER w > 1e-12 AND stddev_pop(y) OVER w > 1e-12),
vec AS (SELECT study_id, feature_id, list(zx ORDER BY sample_id) AS zx, list(zy ORDER BY sample_id) AS zy FROM us GROUP BY ALL),
sh AS (SELECT study_id, draw, list_reduce([{", ".join(_partner(i, a, c, 8) for i, (a, c) in enumerate(ag.order_steps(8)))}], {_LEFT}, [0.0::double] || zy)[1] / 8 AS r FROM vec JOIN h3 USING (feature_id))
SELECT study_id, draw::int AS draw, {R('avg(r)')} AS mean_r, {R('median(r)')} AS median_r FROM sh GROUP BY ALL"""))
def independent_permutation_null(spark, d):
    return ag.perm_null_independent(whole(spark, d), "x", "y", draws=DRAWS, seed=4).select(STUDY, "draw", rd("mean_r"), rd("median_r"))


_PDX = """, pdx AS (SELECT cx.study_id, feature_id, candidate_pair AS pair_id, max(CASE WHEN condition = 'treated' THEN x END) - max(CASE WHEN condition = 'control' THEN x END) AS dx, max(CASE WHEN condition = 'treated' THEN y END) - max(CASE WHEN condition = 'control' THEN y END) AS dy FROM cx JOIN smp USING (study_id, sample_id) GROUP BY ALL),
wp AS (SELECT study_id, feature_id, CASE WHEN sum(dx * dx) * sum(dy * dy) > 0 THEN sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)) END AS r FROM pdx GROUP BY ALL)"""


@query("within_pair_correlation", xy_sql("one", _PDX + f" SELECT study_id, feature_id, {R('r')} AS r FROM wp"))
def within_pair_correlation(spark, d):
    return ag.within_pair_corr(ag.pair_differences(whole(spark, d), roles(spark, d), "x", "y")).select(STUDY, FEATURE, rd("r"))


@query("sign_flip_null", xy_sql("three", _PDX + f""", nm AS (SELECT *, dx * dy / sqrt(sum(dx * dx) OVER w * sum(dy * dy) OVER w) AS c FROM pdx WINDOW w AS (PARTITION BY study_id, feature_id) QUALIFY sum(dx * dx) OVER w * sum(dy * dy) OVER w > 0),
s AS (SELECT study_id, cast(substr(pair_id, 2) AS int) AS i, sum(c) / (SELECT count(r) FROM wp w2 WHERE w2.study_id = nm.study_id) AS c FROM nm GROUP BY study_id, pair_id),
fl AS (SELECT study_id, m, sum(CASE WHEN (m >> i) & 1 = 1 THEN -c ELSE c END) AS v FROM s CROSS JOIN range(16) AS r(m) GROUP BY ALL)
SELECT study_id, {R('any_value(o)')} AS mean_r, 16 AS n_null, {R('avg(cast(v >= o - 1e-12 AS int))')} AS p_one_sided, {R('avg(cast(abs(v) >= abs(o) - 1e-12 AS int))')} AS p_two_sided FROM fl JOIN (SELECT study_id, v AS o FROM fl WHERE m = 0) USING (study_id) GROUP BY ALL"""))
def sign_flip_null(spark, d):
    n = ag.signflip_null(ag.pair_differences(whole(spark, d, "three"), roles(spark, d, "three"), "x", "y"))
    return n.select(STUDY, rd("mean_r"), F.col("n_null").cast("int").alias("n_null"), rd("p_one_sided"), rd("p_two_sided"))


@query("between_pair_share", xy_sql("one", f"SELECT study_id, feature_id, {R('2 * b / (2 * b + w)')} AS between_pair_share FROM (SELECT study_id, feature_id, var_pop(m) * 4 AS b, sum(2 * v) AS w FROM (SELECT cx.study_id, feature_id, candidate_pair, avg(x) AS m, var_pop(x) AS v FROM cx JOIN smp USING (study_id, sample_id) GROUP BY ALL) GROUP BY ALL)"))
def between_pair_share(spark, d):
    return ag.between_pair_share(whole(spark, d), roles(spark, d), "x").select(STUDY, FEATURE, rd("between_pair_share"))


@query("tracking_report")
def tracking_report(spark, d):
    """Counts, counts without run offsets and fractions against values; rows by bin of the mean count have that bin."""
    c = materialise(ag.subtract_run_offsets(whole(spark, d).withColumn("y_run", F.col("y")), ["y_run"]))
    t, bins, _ = ag.tracking_report(c, {"count": "y", "count_run_normalized": "y_run", "fraction": "f"}, "x", roles(spark, d))
    t = t.unionByName(bins, allowMissingColumns=True)
    plain = ("variant", "method", "mean_count_bin", STUDY, "n_features", "n_finite", "n_constant", "n_null", "n_p05", "n_q05", "n_q10", "n_indep")
    return t.select(*plain, *[rd(c, 9) for c in t.columns if c not in plain])


def _bin_sql(method: str, x: str, y: str) -> str:
    return f"""SELECT study_id, 'count' AS variant, '{method}' AS method, b AS mean_count_bin, count(*) AS n_features, {R('avg(r)')} AS mean_r, {R('median(r)')} AS median_r
 FROM (SELECT study_id, feature_id, CASE WHEN var_pop({x}) > 1e-20 AND var_pop({y}) > 1e-20 THEN corr({x}, {y}) END AS r FROM rw GROUP BY ALL) JOIN mb USING (study_id, feature_id) WHERE r IS NOT NULL AND b IS NOT NULL GROUP BY ALL"""


@query("tracking_bins", xy_sql("one", f""", rw AS (SELECT study_id, feature_id, x, y, {", ".join(f"rank() OVER (PARTITION BY study_id, feature_id ORDER BY {c}) + (count(*) OVER (PARTITION BY study_id, feature_id, {c}) - 1) / 2.0 AS r{c}" for c in "xy")} FROM cx),
mb AS (SELECT study_id, feature_id, {_BIN.format(c="avg(count)")} AS b FROM cx GROUP BY ALL) {_bin_sql("pearson", "x", "y")} UNION ALL {_bin_sql("spearman", "rx", "ry")}"""))
def tracking_bins(spark, d):
    b = ag.tracking_bins(whole(spark, d), {"count": "y"}, "x")
    return b.select(STUDY, "variant", "method", "mean_count_bin", "n_features", rd("mean_r"), rd("median_r"))


_POLISH_ROUNDS = 20


def _polish_sql() -> str:
    """``p<n>``: level and overall of each parent and sample after round n."""
    key = "study_id, parent_id"
    out = f""", kd AS MATERIALIZED (SELECT study_id, members[1] AS parent_id, feature_id, sample_id, log2(value) AS v, value AS raw FROM ch WHERE len(members) = 1),
p0 AS (SELECT DISTINCT {key}, sample_id, cast(0 AS double) AS lv FROM kd)"""
    for i in range(1, _POLISH_ROUNDS + 1):
        out += f""",
e{i} AS MATERIALIZED (SELECT {key}, feature_id, median(v - lv) AS e FROM kd JOIN p{i - 1} USING ({key}, sample_id) GROUP BY ALL),
p{i} AS MATERIALIZED (SELECT {key}, sample_id, m + c AS lv, b + c AS ov FROM (SELECT {key}, sample_id, median(v - e) AS m FROM kd JOIN e{i} USING ({key}, feature_id) GROUP BY ALL)
  JOIN (SELECT {key}, median(e) AS c FROM e{i} GROUP BY ALL) USING ({key}) JOIN (SELECT {key}, median(lv) AS b FROM p{i - 1} GROUP BY ALL) USING ({key}))"""
    return out + f""",
nk AS (SELECT {key}, count(DISTINCT feature_id) AS n_children FROM kd GROUP BY ALL),
mp AS (SELECT x.*, n_children, bool_and(abs(x.lv - w.lv) <= 1e-12) OVER (PARTITION BY x.study_id, x.parent_id) AS converged
  FROM p{_POLISH_ROUNDS} x JOIN p{_POLISH_ROUNDS - 1} w USING ({key}, sample_id) JOIN nk USING ({key}))"""


def _unique_children(spark, d):
    c = _children(spark, d).where(F.size("members") == 1)
    return c.select(STUDY, FEATURE, F.col("members")[0].alias("parent_id"), SAMPLE, F.log2("value").alias("value"), F.col("value").alias("raw"))


@query("median_polish", _KID + _polish_sql() + f" SELECT study_id, parent_id, sample_id, {R('ov')} AS overall, {R('lv - ov')} AS column_effect, n_children, converged FROM mp")
def median_polish(spark, d):
    fit = sm.median_polish(_unique_children(spark, d), rounds=_POLISH_ROUNDS)
    return fit.select(STUDY, "parent_id", SAMPLE, rd("overall"), rd("column_effect"), "n_children", "converged")


@query("rollup_check", _KID + _polish_sql() + f""" SELECT study_id, parent_id, max(n_children) AS n_children, {R('stddev_pop(p - (lv - ov))')} AS profile_dev_sd, {R('avg(p - lv)')} AS offset
FROM mp JOIN (SELECT study_id, parent_id, sample_id, log2(sum(raw)) AS p FROM kd GROUP BY ALL) USING (study_id, parent_id, sample_id) GROUP BY ALL""")
def rollup_check(spark, d):
    c = _unique_children(spark, d)
    parents = c.groupBy(STUDY, "parent_id", SAMPLE).agg(F.log2(F.sum("raw")).alias("value")).withColumnRenamed("parent_id", FEATURE)
    return ag.rollup_check(c, parents).select(STUDY, "parent_id", "n_children", rd("profile_dev_sd"), rd("offset"))


@query("flagged_table", "WITH " + with_sql("flag", "", False)[5:] + f" SELECT study_id, feature_id, count(*) AS n_runs_value, count(*) AS n_runs_count, {R('avg(log2(value))')} AS mean_value, cast(sum(count) AS bigint) AS total_count, max(count) AS max_count FROM base SEMI JOIN (SELECT * FROM feat WHERE is_contaminant) USING (study_id, feature_id) GROUP BY ALL")
def flagged_table(spark, d):
    c = tb.base_cells(spark, d, "flag").withColumn("v", F.log2("value"))
    t = ag.flagged_table(c, tb.features(spark, d, "flag").where("is_contaminant"), "v", "count")
    return t.select(STUDY, FEATURE, "n_runs_value", "n_runs_count", rd("mean_value"), "total_count", "max_count")


@query("cells_table")
def cells_table(spark, d):
    c = cells(spark, d)
    back = sm.lowess_grid(c, [STUDY], "y", "x", 0.3, 1)
    t = ag.cells_table(c, {"resid_y": (_trend(spark, d, c), "x", "y"), "resid_x": (back, "y", "x")}, tb.samples(spark, d), tb.features(spark, d))
    return t.select(*CELL_KEY, "condition", "p_brand", "count_bin", "decile", rd("resid_y", 3), rd("resid_x", 3))
