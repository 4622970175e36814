"""Differential abundance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgrid.catalog.base import R, prior_sql, query, rd, t_critical_sql, t_tail_sql, with_sql
from quantgrid.catalog.preparation import normalized_log
from quantgrid.model import CELL_KEY, FEATURE, STUDY, tag_scale
from quantgrid.operators import de
from quantgrid.operators.design import pair_roles
from quantgrid.operators.ranks import benjamini_hochberg
from quantgrid.plans import testbed as tb
from quantgrid.plans.de_runs import run_designs, run_quantities
from quantgrid.plans.relabel import relabel_pairs

REF = {"condition": "control"}


def roles(spark, d, study="one"):
    return pair_roles(tb.samples(spark, d, study), "control", "treated")


def paired(spark, d, study="one", method="moderated", trend=False):
    return de.differential_abundance(normalized_log(spark, d, study), tb.samples(spark, d, study), "condition", (), REF, method, trend=trend, absorb="candidate_pair")


def contrast(spark, d, study="one", **kw):
    return paired(spark, d, study, **kw)[0].where("is_contrast")


@query("design_terms", with_sql("one", f"SELECT study_id, t AS term, i AS is_contrast, 3 AS df, {R('v')} AS inv_diag FROM nsmp CROSS JOIN (VALUES ('condition[treated vs control]', true, 0.5), ('candidate_pair[P1 vs P0]', false, 1.0), ('candidate_pair[P2 vs P0]', false, 1.0), ('candidate_pair[P3 vs P0]', false, 1.0)) AS x(t, i, v)", False))
def design_terms(spark, d):
    _, terms = de.design(tb.samples(spark, d), "condition", ["candidate_pair"], REF)
    return terms.where("term_index > 0").select(STUDY, "term", "is_contrast", "df", rd("inv_diag"))


@query("ols_paired", with_sql("three", f"SELECT study_id, feature_id, {R('effect')} AS effect, {R('sqrt(sigma2)')} AS sigma, {R('se')} AS se, {R('effect / se')} AS t FROM fit", paired=True))
def ols_paired(spark, d):
    return contrast(spark, d, "three", method="ols").select(STUDY, FEATURE, rd("effect"), rd("sigma"), rd("se"), rd("t"))


@query("ols_numeric_slope", with_sql("one", f"""SELECT study_id, feature_id, {R('regr_slope(value, seq_number)', 8)} AS effect, {R('regr_intercept(value, seq_number)')} AS level FROM nlog JOIN smp USING (study_id, sample_id) GROUP BY ALL"""))
def ols_numeric_slope(spark, d):
    c, s = normalized_log(spark, d), tb.samples(spark, d)
    proj, terms = de.design(s, "seq_number")
    return de.ols(c, proj).select(STUDY, FEATURE, rd(F.col("coef")[1], 8, "effect"), rd(F.col("coef")[0], 6, "level"))


@query("eb_prior_moments", with_sql("three", f"""SELECT study_id, count(*) AS n_features, {R('avg(z)')} AS mean_log, {R('var_samp(z)')} AS var_log FROM (SELECT study_id, ln(greatest(sigma2, 1e-5 * median(sigma2) OVER (PARTITION BY study_id))) AS z FROM fit) GROUP BY ALL""", paired=True))
def eb_prior_moments(spark, d):
    c, s = normalized_log(spark, d, "three"), tb.samples(spark, d, "three")
    proj, terms = de.design(s, "condition", ["candidate_pair"], REF)
    fits = de.add_variance(de.ols(c, proj), terms)
    z = de._log_variances(fits, [STUDY], 3)
    return z.groupBy(STUDY).agg(F.count(F.lit(1)).alias("n_features"), rd(F.avg("_z"), 6, "mean_log"), rd(F.var_samp("_z"), 6, "var_log"))


#: ``md``: the moderated paired test of each feature, and ``bh`` with its q.
_BH = """bh AS (SELECT study_id, feature_id, p, least(1, min(p * m / rk) OVER (PARTITION BY study_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q0 FROM (
SELECT *, rank() OVER (PARTITION BY study_id ORDER BY p) + count(*) OVER (PARTITION BY study_id, p) - 1 AS rk, count(*) OVER (PARTITION BY study_id) AS m FROM pv))"""
_MOD = ", f3 AS (SELECT study_id, feature_id, effect, sigma2 AS s2 FROM fit),\n" + prior_sql("f3", "study_id", "3") + f""",
pe AS (SELECT *, d0 + 3 AS df, sqrt((d0 * s0_sq + 3 * s2) / (d0 + 3) / 2) AS se FROM f3 JOIN pr USING (study_id)),
md AS (SELECT *, effect / se AS t, {t_tail_sql("(effect / se)", "df")} AS p FROM pe), pv AS (SELECT study_id, feature_id, p FROM md), {_BH},
cv AS (SELECT study_id, {t_critical_sql("(d0 + 3)")} AS c FROM pr)
"""


@query("moderated_paired", with_sql("one", _MOD + f"""SELECT study_id, feature_id, {R('effect')} AS effect, {R('se')} AS se, {R('t')} AS t, {R('md.p', 7)} AS p, {R('min(q0) OVER (PARTITION BY study_id, bh.p)', 7)} AS q,
{R('effect - c * se')} AS ci_low, {R('effect + c * se')} AS ci_high, {R('df', 4)} AS df_total FROM md JOIN bh USING (study_id, feature_id) JOIN cv USING (study_id)""", paired=True))
def moderated_paired(spark, d):
    t = contrast(spark, d)
    return t.select(STUDY, FEATURE, rd("effect"), rd("se"), rd("t"), rd("p", 7), rd("q", 7), rd("ci_low"), rd("ci_high"), rd("df_total", 4))


@query("moderated_fit_info", with_sql("one", _MOD + f"""SELECT study_id, 'design' AS design_id, {R('d0', 4)} AS d0, {R('s0_sq', 8)} AS s0_sq, n AS n_features,
(SELECT count(*) FROM (SELECT s2 < 1e-5 * median(s2) OVER () AS low FROM f3) WHERE low) AS n_floored, 3 AS residual_df, 8 AS n_samples, 0 AS n_incomplete_features FROM pr""", paired=True))
def moderated_fit_info(spark, d):
    return paired(spark, d)[1].select(STUDY, "design_id", rd("d0", 4), rd("s0_sq", 8), "n_features", "n_floored", "residual_df", "n_samples", "n_incomplete_features")


@query("moderated_trend")
def moderated_trend(spark, d):
    return contrast(spark, d, trend=True).select(STUDY, FEATURE, rd("effect"), rd("prior_sd"), rd("se"), rd("p", 9), rd("q", 9))


_W = """w AS (SELECT study_id, feature_id, avg(value) FILTER (condition = 'treated') AS m1, avg(value) FILTER (condition = 'control') AS m0, var_samp(value) FILTER (condition = 'treated') / 4 AS a, var_samp(value) FILTER (condition = 'control') / 4 AS b
FROM nlog JOIN smp USING (study_id, sample_id) GROUP BY ALL)"""


@query("welch_statistic", with_sql("one", "")[:-1] + f", {_W} SELECT study_id, feature_id, {R('m1 - m0')} AS effect, {R('sqrt(a + b)')} AS se, {R('(m1 - m0) / sqrt(a + b)')} AS t FROM w")
def welch_statistic(spark, d):
    return de.welch(normalized_log(spark, d), tb.samples(spark, d), "condition", "control").select(STUDY, FEATURE, rd("effect"), rd("se"), rd("t"))


@query("welch_p_values", with_sql("one", "")[:-1] + f""", {_W}, wd AS (SELECT *, sqrt(a + b) AS se, (a + b) ^ 2 / (a ^ 2 / 3 + b ^ 2 / 3) AS df FROM w), wp AS (SELECT *, {t_tail_sql("((m1 - m0) / se)", "df")} AS p, {t_critical_sql("df")} AS c FROM wd),
pv AS (SELECT study_id, feature_id, p FROM wp), {_BH} SELECT study_id, feature_id, {R('wp.p', 7)} AS p, {R('min(q0) OVER (PARTITION BY study_id, bh.p)', 7)} AS q, {R('m1 - m0 - c * se')} AS ci_low, {R('m1 - m0 + c * se')} AS ci_high FROM wp JOIN bh USING (study_id, feature_id)""")
def welch_p_values(spark, d):
    return de.welch(normalized_log(spark, d), tb.samples(spark, d), "condition", "control").select(STUDY, FEATURE, rd("p", 7), rd("q", 7), rd("ci_low"), rd("ci_high"))


@query("mannwhitney_statistic", with_sql("three", f"""SELECT t.study_id, t.feature_id, count_if(t.value > c.value) + 0.5 * count_if(t.value = c.value) AS u, {R('median(t.value - c.value)')} AS effect FROM
(SELECT * FROM nlog JOIN smp USING (study_id, sample_id) WHERE condition = 'treated') t JOIN (SELECT * FROM nlog JOIN smp USING (study_id, sample_id) WHERE condition = 'control') c USING (study_id, feature_id) GROUP BY ALL"""))
def mannwhitney_statistic(spark, d):
    t = de.mannwhitney(normalized_log(spark, d, "three"), tb.samples(spark, d, "three"), "condition", "control")
    return t.select(STUDY, FEATURE, F.col("u").cast("double").alias("u"), rd("effect"))


#: Without ties, four samples an arm: the exact law of U over all 70 choices of four ranks.
_LAW = """law AS (SELECT s - 10 AS u, count(*) / 70.0 AS w FROM (SELECT list_sum(list_transform(range(0, 8), lambda i: ((m >> i) & 1) * (i + 1))) AS s FROM range(256) r(m) WHERE bit_count(m) = 4) GROUP BY ALL)"""


@query("mannwhitney_p_values", with_sql("one", "")[:-1] + f""", df AS (SELECT t.study_id, t.feature_id, count_if(t.value > c.value) AS u, list_sort(list(t.value - c.value)) AS d FROM (SELECT * FROM nlog JOIN smp USING (study_id, sample_id) WHERE condition = 'treated') t
JOIN (SELECT * FROM nlog JOIN smp USING (study_id, sample_id) WHERE condition = 'control') c USING (study_id, feature_id) GROUP BY ALL), {_LAW},
pv AS (SELECT study_id, feature_id, (SELECT least(1.0, 2 * least(sum(w) FILTER (law.u <= df.u), sum(w) FILTER (law.u >= df.u))) FROM law) AS p FROM df), {_BH}
SELECT study_id, feature_id, {R('bh.p', 9)} AS p, {R('min(q0) OVER (PARTITION BY study_id, bh.p)', 9)} AS q, {R('d[2]')} AS ci_low, {R('d[15]')} AS ci_high FROM df JOIN bh USING (study_id, feature_id)""")
def mannwhitney_p_values(spark, d):
    t = de.mannwhitney(normalized_log(spark, d), tb.samples(spark, d), "condition", "control")
    return t.select(STUDY, FEATURE, rd("p", 9), rd("q", 9), rd("ci_low"), rd("ci_high"))


@query("multi_level_welch", with_sql("one", f"""SELECT x.study_id, x.feature_id, 'grp[' || x.g || ' vs g0]' AS term, {R('x.m - y.m')} AS effect, x.k + y.k AS n FROM
(SELECT study_id, feature_id, 'g' || (seq_number % 3) AS g, avg(value) AS m, count(*) AS k FROM nlog JOIN smp USING (study_id, sample_id) GROUP BY ALL) x JOIN
(SELECT study_id, feature_id, 'g' || (seq_number % 3) AS g, avg(value) AS m, count(*) AS k FROM nlog JOIN smp USING (study_id, sample_id) GROUP BY ALL) y ON x.study_id = y.study_id AND x.feature_id = y.feature_id AND y.g = 'g0' AND x.g <> 'g0'"""))
def multi_level_welch(spark, d):
    s = tb.samples(spark, d).withColumn("grp", F.concat(F.lit("g"), (F.col("seq_number") % 3).cast("string")))
    t, _ = de.differential_abundance(normalized_log(spark, d), s, "grp", reference={"grp": "g0"}, method="welch")
    return t.select(STUDY, FEATURE, "term", rd("effect"), "n")


_PV = "pv AS (SELECT study_id, feature_id, 1 / (1 + abs(effect / se)) AS p FROM fit)"


def _pv(spark, d, study="three"):
    return contrast(spark, d, study, method="ols").withColumn("p", 1 / (1 + F.abs("t")))


@query("benjamini_hochberg", with_sql("three", "", paired=True)[:-1] + f", {_PV}, {_BH} SELECT study_id, feature_id, {R('p')} AS p, {R('min(q0) OVER (PARTITION BY study_id, p)')} AS q FROM bh")
def bh(spark, d):
    t = benjamini_hochberg(_pv(spark, d).select(STUDY, FEATURE, "p"), "p", [STUDY])
    return t.select(STUDY, FEATURE, rd("p"), rd("q"))


@query("hit_counts", with_sql("three", "", paired=True)[:-1] + f""", {_PV}, {_BH} SELECT study_id, threshold, count_if(q0 < threshold) AS n_hits, count_if(q0 < threshold AND effect > 0) AS n_up, count_if(q0 < threshold AND effect < 0) AS n_down
FROM bh JOIN fit USING (study_id, feature_id) CROSS JOIN (SELECT unnest([0.2, 0.5, 0.8]) AS threshold) GROUP BY ALL""")
def hit_counts(spark, d):
    t = benjamini_hochberg(_pv(spark, d).drop("q"), "p", [STUDY])
    return de.hits(t, [0.2, 0.5, 0.8])


@query("storey_pi0", with_sql("three", "", paired=True)[:-1] + f""", {_PV} SELECT study_id, count(*) AS n, {R('count_if(p > 0.5) / (count(*) * 0.5)')} AS pi0_raw, {R('least(1, count_if(p > 0.5) / (count(*) * 0.5))')} AS pi0 FROM pv GROUP BY ALL""")
def storey_pi0(spark, d):
    return de.pi0(_pv(spark, d)).select(STUDY, "n", rd("pi0_raw"), rd("pi0"))


@query("p_calibration", with_sql("one", "", paired=True)[:-1] + f""", {_PV}, k AS (SELECT study_id, max(greatest(rk / m - p, p - (rk - 1) / m)) AS ks FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY p) AS rk, count(*) OVER (PARTITION BY study_id) AS m FROM pv) GROUP BY ALL)
SELECT study_id, count(*) AS m, {R('count_if(p < 0.05) * 20 / count(*)')} AS density_first_bin, {R('count_if(p < 0.25) * 4 / count(*)')} AS density_low_quarter, {R('count_if(p >= 0.9) * 10 / count(*)')} AS density_top, {R('any_value(ks)')} AS ks_distance FROM pv JOIN k USING (study_id) GROUP BY ALL""")
def p_calibration(spark, d):
    c = de.calibration(_pv(spark, d, "one"))
    return c.select(STUDY, "m", rd("density_first_bin"), rd("density_low_quarter"), rd("density_top"), rd("ks_distance"))


@query("p_calibration_flags", with_sql("three", _MOD + f""", bi AS (SELECT study_id, least(floor(p * 20), 19)::int AS b, row_number() OVER (PARTITION BY study_id ORDER BY p) AS rk, count(*) OVER (PARTITION BY study_id) AS m, p FROM md),
ca AS (SELECT study_id, count(*) AS m, count_if(b = 0) * 20 / count(*) AS d1, count_if(b < 5) * 4 / count(*) AS d5, count_if(b > 17) * 10 / count(*) AS d2, 3 * sqrt(19 / count(*)) AS e, max(greatest(rk / m - p, p - (rk - 1) / m)) AS ks FROM bi GROUP BY ALL)
SELECT study_id, m, CASE WHEN d1 > 1 + e THEN 'high' WHEN d1 < 1 - e THEN 'low' ELSE 'uniform' END AS flag_first_bin, CASE WHEN d5 > 1 + e / sqrt(5) THEN 'high' WHEN d5 < 1 - e / sqrt(5) THEN 'low' ELSE 'uniform' END AS flag_low_quarter,
CASE WHEN d2 > 1 + e / sqrt(2) THEN 'high' WHEN d2 < 1 - e / sqrt(2) THEN 'low' ELSE 'uniform' END AS flag_top, {R('ks')} AS ks_distance FROM ca""", paired=True))
def p_calibration_flags(spark, d):
    return de.calibration(contrast(spark, d, "three")).select(STUDY, "m", "flag_first_bin", "flag_low_quarter", "flag_top", rd("ks_distance"))


@query("contrast_table", with_sql("one", f"SELECT study_id, feature_id, p_brand, {R('effect')} AS effect FROM fit JOIN feat USING (study_id, feature_id)", paired=True))
def contrast_table(spark, d):
    t, _ = paired(spark, d, method="ols")
    return de.contrast_table(t, tb.features(spark, d).select(STUDY, FEATURE, "p_brand")).select(STUDY, FEATURE, "p_brand", rd("effect"))


@query("design_summary", with_sql("three", _MOD + f"""SELECT study_id, count(*) AS n_tested, {R('avg((effect > 0)::int)')} AS share_positive, {R('median(effect)')} AS median_effect, {R('median(sqrt(s2))')} AS median_sigma, {R('median(se)')} AS median_se,
{R('least(1, count_if(p > 0.5) / count(*) / 0.5)')} AS pi0, {R('any_value(d0)', 4)} AS d0, 3 AS residual_df FROM md GROUP BY ALL""", paired=True))
def design_summary(spark, d):
    t, i = paired(spark, d, "three")
    out = de.design_summary(t, i)
    return out.select(STUDY, "n_tested", rd("share_positive"), rd("median_effect"), rd("median_sigma"), rd("median_se"), rd("pi0"), rd("d0", 4), "residual_df")


_TWO = """fit2 AS (SELECT study_id, feature_id, avg(d) AS effect, stddev_samp(d) / sqrt(count(*)) AS se FROM (SELECT study_id, feature_id, candidate_pair,
 max(CASE WHEN condition = 'treated' THEN y END) - max(CASE WHEN condition = 'control' THEN y END) AS d FROM (SELECT *, log2(value + 1) AS y FROM comp) JOIN smp USING (study_id, sample_id) GROUP BY ALL) GROUP BY ALL)"""


def _raw_log(spark, d, study="one"):
    from quantgrid.catalog.preparation import complete
    from quantgrid.operators.normalize import log2_transform

    return log2_transform(complete(spark, d, study))


@query("result_concordance", with_sql("three", "", paired=True)[:-1] + f""", {_TWO}, j AS (SELECT a.study_id, a.effect AS ea, b.effect AS eb, a.effect / a.se AS ta, b.effect / b.se AS tb FROM fit a JOIN fit2 b USING (study_id, feature_id)),
r AS (SELECT study_id, ea, eb, rank() OVER (PARTITION BY study_id ORDER BY ea) AS x, rank() OVER (PARTITION BY study_id ORDER BY eb) AS y, rank() OVER (PARTITION BY study_id ORDER BY ta) AS u, rank() OVER (PARTITION BY study_id ORDER BY tb) AS v FROM j)
SELECT study_id, count(*) AS n_features, {R('max(abs(ea - eb))')} AS max_abs_effect_diff, {R('corr(x, y)')} AS spearman_effect, {R('corr(u, v)')} AS spearman_t FROM r GROUP BY ALL""")
def result_concordance(spark, d):
    other, _ = de.differential_abundance(_raw_log(spark, d, "three"), tb.samples(spark, d, "three"), "condition", ["candidate_pair"], REF, "ols")
    c = de.concordance(contrast(spark, d, "three", method="ols"), other.where("is_contrast"))
    return c.select(STUDY, "n_features", rd("max_abs_effect_diff"), rd("spearman_effect"), rd("spearman_t"))


@query("common_result_table", with_sql("one", "", paired=True)[:-1] + f", {_TWO} SELECT study_id, feature_id, {R('a.effect')} AS norm_effect, {R('b.effect')} AS raw_effect FROM fit a JOIN fit2 b USING (study_id, feature_id)")
def common_result_table(spark, d):
    q = run_quantities({"norm": normalized_log(spark, d), "raw": _raw_log(spark, d)}, tb.samples(spark, d), {"paired": ("condition", ["candidate_pair"])}, method="ols", reference=REF)
    t = de.common_table({n: x[0].where("is_contrast") for n, x in q.items()})
    return t.select(STUDY, FEATURE, rd("norm_effect"), rd("raw_effect"))


@query("several_designs", with_sql("one", "", paired=True)[:-1] + f""", {_W} SELECT study_id, feature_id, 'paired' AS design_id, {R('effect')} AS effect, {R('se')} AS se FROM fit
UNION ALL SELECT study_id, feature_id, 'unpaired', {R('m1 - m0')}, {R('sqrt((a + b) * 4 / 2 * 0.5)')} FROM w""")
def several_designs(spark, d):
    t, _ = run_designs(normalized_log(spark, d), tb.samples(spark, d), {"paired": ("condition", ["candidate_pair"]), "unpaired": ("condition", [])}, "ols", reference=REF)
    return t.where("is_contrast").select(STUDY, FEATURE, "design_id", rd("effect"), rd("se"))


def _trend_pair(spark, d):
    trend, _ = paired(spark, d, trend=True)
    plain, _ = paired(spark, d)
    return de.trend_table(trend.where("is_contrast"), plain.where("is_contrast"))


@query("trend_hit_changes")
def trend_hit_changes(spark, d):
    return de.hit_changes(_trend_pair(spark, d))


@query("trend_se_ratio")
def trend_se_ratio(spark, d):
    return de.se_ratio(_trend_pair(spark, d)).select(STUDY, "tertile", "n", rd("low"), rd("high"), rd("median_se_ratio"))


@query("trend_summary")
def trend_summary(spark, d):
    b = de.trend_block(_trend_pair(spark, d))
    return b.select(STUDY, "n_tested", *[rd(c) for c in ("prior_sd_min", "prior_sd_max", "prior_sd_median", "spearman_prior_abundance", "spearman_p", "pi0_trend", "pi0_plain")])


@query("abundance_tertiles", with_sql("three", f"""SELECT study_id, tertile, count(*) AS n, {R('min(x)')} AS low, {R('max(x)')} AS high FROM (SELECT *, CASE WHEN x > e[2] THEN 2 WHEN x > e[1] THEN 1 ELSE 0 END AS tertile FROM (
SELECT study_id, feature_id, x, quantile_cont(x, [1.0/3, 2.0/3]) OVER (PARTITION BY study_id) AS e FROM (SELECT study_id, feature_id, avg(value) AS x FROM nlog GROUP BY ALL))) GROUP BY ALL"""))
def abundance_tertiles(spark, d):
    m = normalized_log(spark, d, "three").groupBy(STUDY, FEATURE).agg(F.avg("value").alias("x"))
    b = de.value_quantile_bins(m, [STUDY], "x", 3, "tertile")
    return b.groupBy(STUDY, "tertile").agg(F.count(F.lit(1)).alias("n"), rd(F.min("x"), 6, "low"), rd(F.max("x"), 6, "high"))


@query("top_features", with_sql("three", "", paired=True)[:-1] + f""", {_PV}, {_BH}, b2 AS (SELECT *, min(q0) OVER (PARTITION BY study_id, p) AS q FROM bh) SELECT study_id, feature_id, row_number() OVER (PARTITION BY study_id ORDER BY round(q, 9), round(p, 9), feature_id) AS place FROM b2 QUALIFY place <= 15""")
def top_features(spark, d):
    t = benjamini_hochberg(_pv(spark, d).drop("q"), "p", [STUDY]).withColumn("q", F.round("q", 9)).withColumn("p", F.round("p", 9))
    return de.top_n(t, 15).select(STUDY, FEATURE, F.col("place").cast("bigint").alias("place"))


@query("pair_differences", with_sql("one", f"SELECT study_id, feature_id, candidate_pair AS pair_id, {R('d')} AS difference FROM pd", paired=True))
def pair_differences(spark, d):
    return de.pair_rows(normalized_log(spark, d), roles(spark, d)).select(STUDY, FEATURE, "pair_id", rd("difference"))


@query("pair_summary", with_sql("three", f"SELECT study_id, feature_id, count(d) AS n_pairs, {R('avg(d)')} AS mean_difference, {R('stddev_samp(d)')} AS sd_difference, {R('min(d)')} AS min_difference, {R('max(d)')} AS max_difference FROM pd GROUP BY ALL", paired=True))
def pair_summary(spark, d):
    s = de.pair_summary(de.pair_rows(normalized_log(spark, d, "three"), roles(spark, d, "three")))
    return s.select(STUDY, FEATURE, "n_pairs", *[rd(c) for c in ("mean_difference", "sd_difference", "min_difference", "max_difference")])


_CP = """cp AS (SELECT study_id, feature_id, candidate_pair, max(CASE WHEN condition = 'treated' THEN count END) AS t, max(CASE WHEN condition = 'control' THEN count END) AS c FROM base JOIN smp USING (study_id, sample_id) GROUP BY ALL)"""


@query("pair_log_ratio", "WITH " + with_sql("one", "", False)[5:] + f", {_CP} SELECT study_id, feature_id, candidate_pair AS pair_id, {R('log2(t / c)')} AS difference FROM cp")
def pair_log_ratio(spark, d):
    c = tb.base_cells(spark, d).withColumn("value", F.col("count").cast("double"))
    return de.pair_rows(c, roles(spark, d), ratio=True).select(STUDY, FEATURE, "pair_id", rd("difference"))


@query("direction_tally", "WITH " + with_sql("three", "", False)[5:] + f", {_CP} SELECT study_id, feature_id, count_if(t > c) AS n_up, count_if(t < c) AS n_down, count_if(t = c) AS n_tie FROM cp GROUP BY ALL")
def direction_tally(spark, d):
    c = tb.base_cells(spark, d, "three").withColumn("value", F.col("count").cast("double"))
    return de.direction_tally(de.pair_rows(c, roles(spark, d, "three")))


@query("volcano_table", with_sql("three", "", paired=True)[:-1] + f""", {_PV}, {_BH}, b2 AS (SELECT *, min(q0) OVER (PARTITION BY study_id, p) AS q FROM bh)
SELECT study_id, feature_id, CASE WHEN q < 0.6 AND effect > 0 THEN 'up' WHEN q < 0.6 AND effect < 0 THEN 'down' ELSE 'NS' END AS bucket, {R('-log10(b2.p)')} AS neg_log10_p FROM b2 JOIN fit USING (study_id, feature_id)""")
def volcano_table(spark, d):
    t = benjamini_hochberg(_pv(spark, d).drop("q"), "p", [STUDY])
    return de.volcano_table(t, 0.6).select(STUDY, FEATURE, "bucket", rd("neg_log10_p"))


_TERC = "t3 AS (SELECT p.*, ntile(3) OVER (PARTITION BY study_id ORDER BY x, feature_id) - 1 AS tercile FROM pv p JOIN (SELECT study_id, feature_id, avg(value) AS x FROM nlog GROUP BY ALL) USING (study_id, feature_id))"


@query("p_histogram_by_tercile", with_sql("one", "", paired=True)[:-1] + f", {_PV}, {_TERC} SELECT study_id, tercile, least(cast(floor(p * 20) AS int), 19) AS bin, count(*) AS n FROM t3 GROUP BY ALL")
def p_histogram_by_tercile(spark, d):
    return de.pvalue_by_tercile(_pv(spark, d, "one"))[0]


@query("pi0_by_tercile", with_sql("three", "", paired=True)[:-1] + f", {_PV}, {_TERC} SELECT study_id, tercile, count(*) AS n, {R('count_if(p > 0.5) / (count(*) * 0.5)')} AS pi0_raw FROM t3 GROUP BY ALL")
def pi0_by_tercile(spark, d):
    return de.pvalue_by_tercile(_pv(spark, d))[1].select(STUDY, "tercile", "n", rd("pi0_raw"))


@query("residual_sd_histogram", with_sql("three", "SELECT study_id, 'design' AS design_id, cast(floor(sqrt(sigma2) / 0.05) AS int) AS bin, count(*) AS n FROM fit GROUP BY ALL", paired=True))
def residual_sd_histogram(spark, d):
    return de.sd_hist(contrast(spark, d, "three", method="ols"))


@query("precision_comparison", with_sql("one", "", paired=True)[:-1] + f""", fc AS (SELECT study_id, feature_id, sqrt(var_samp(dd) / 2) AS sigma FROM (SELECT study_id, feature_id, candidate_pair, max(CASE WHEN condition = 'treated' THEN log2(count + 1) END) - max(CASE WHEN condition = 'control' THEN log2(count + 1) END) AS dd FROM nlog JOIN smp USING (study_id, sample_id) GROUP BY ALL) GROUP BY ALL)
SELECT 'count' AS quantity, study_id, count(*) AS n_features, {R('median(sigma)')} AS median_sigma FROM fc GROUP BY ALL UNION ALL SELECT 'value', study_id, count(*), {R('median(sqrt(sigma2))')} FROM fit GROUP BY ALL""")
def precision_comparison(spark, d):
    counts = tb.base_cells(spark, d).join(normalized_log(spark, d).select(*CELL_KEY), CELL_KEY, "left_semi")
    counts = tag_scale(counts.withColumn("value", F.log2(F.col("count") + 1)), "log2")
    q = run_quantities({"value": normalized_log(spark, d), "count": counts}, tb.samples(spark, d), {"paired": ("condition", ["candidate_pair"])}, method="ols", reference=REF)
    s, _ = de.precision({n: x[0].where("is_contrast") for n, x in q.items()})
    return s.select("quantity", STUDY, "n_features", rd("median_sigma"))


_FLIPPED = """, lb AS (SELECT study_id, feature_id, l, avg(e) AS effect, var_samp(e) / 2 AS s2, count(*) AS k FROM
 (SELECT *, CASE WHEN candidate_pair <> 'P0' AND (l >> (cast(substr(candidate_pair, 2) AS int) - 1)) & 1 = 1 THEN -d ELSE d END AS e FROM pd CROSS JOIN range(8) AS r(l)) GROUP BY ALL),
"""


@query("relabelling_null", with_sql("one", _FLIPPED + prior_sql("lb", "study_id, l", "3") + f""",
lp AS (SELECT study_id, l, d0, n, {t_tail_sql("(effect / sqrt((d0 * s0_sq + 3 * s2) / (d0 + 3) * 2 / k))", "(d0 + 3)")} AS p FROM lb JOIN pr USING (study_id, l)),
rk AS (SELECT *, row_number() OVER (PARTITION BY study_id, l ORDER BY p) AS i FROM lp)
SELECT study_id, lpad(cast(l AS varchar), 6, '0') AS design_id, l = 0 AS observed, {R('least(1.0, count_if(p > 0.5) / count(*) / 0.5)')} AS pi0, coalesce(max(CASE WHEN p < 0.1 * i / n THEN i END), 0) AS hits_q10,
 {R('count_if(p < 0.25) * 4 / count(*)')} AS density_low_quarter, {R('any_value(d0)', 4)} AS d0 FROM rk GROUP BY study_id, l""", paired=True))
def relabelling_null(spark, d):
    out, _ = relabel_pairs(normalized_log(spark, d), tb.samples(spark, d), "control", "treated")
    return out.select(STUDY, F.lpad(F.col("labelling").cast("string"), 6, "0").alias("design_id"), "observed", rd("pi0"), F.col("hits").alias("hits_q10"), rd("density_low_quarter"), rd("d0", 4))


@query("relabelling_effects", with_sql("one", f"""SELECT study_id, feature_id, lpad(cast(l AS varchar), 6, '0') AS design_id, {R("avg(CASE WHEN candidate_pair <> 'P0' AND (l >> (cast(substr(candidate_pair, 2) AS int) - 1)) & 1 = 1 THEN -d ELSE d END)")} AS effect FROM pd CROSS JOIN range(8) AS r(l) GROUP BY ALL""", paired=True))
def relabelling_effects(spark, d):
    from quantgrid.plans.de_runs import labellings

    proj, terms = de.design(labellings(tb.samples(spark, d), "control", "treated"), "condition", ["candidate_pair"], REF)
    fits = de.add_variance(de.ols(normalized_log(spark, d), proj), terms)
    return fits.select(STUDY, FEATURE, "design_id", rd(F.col("coef")[1], 6, "effect"))


@query("display_labels", with_sql("one", """SELECT study_id, feature_id, p_brand || ' +1' AS member_label, CASE WHEN length(seq) > 12 THEN substr(seq, 1, 9) || '...' ELSE seq END || CASE WHEN count(*) OVER (PARTITION BY study_id, seq) > 1 THEN ' [+' || printf('%.2f', p_size * 1.5) || ']' ELSE '' END AS sequence_label
FROM (SELECT *, upper(replace(p_type || p_brand, '#', '')) AS seq FROM feat WHERE p_brand IS NOT NULL)""", False))
def display_labels(spark, d):
    f = tb.features(spark, d).where("p_brand is not null").select(
        STUDY, FEATURE, F.concat(F.col("p_brand"), F.lit(";"), F.col("p_type")).alias("members"),
        F.upper(F.replace(F.concat("p_type", "p_brand"), F.lit("#"), F.lit(""))).alias("base_sequence"), (F.col("p_size") * 1.5).alias("total_mod_mass"),
    )
    return de.display_label(f).select(STUDY, FEATURE, "member_label", "sequence_label")
