"""Quality-control summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgrid.catalog.base import R, query, rd, with_sql
from quantgrid.catalog.preparation import complete, normalized_log
from quantgrid.model import FEATURE, SAMPLE, STUDY, tag_scale
from quantgrid.operators import normalize as nz
from quantgrid.operators import qc
from quantgrid.operators.correlation import correlate
from quantgrid.plans import testbed as tb

SK = "study_id, sample_id"


@query("value_profile", with_sql("flag", f"""SELECT {SK}, count(*) AS n, 0 AS n_nan, 0 AS n_zero, count(*) AS n_pos, {R('min(value)', 4)} AS min_pos, {R('max(value)', 4)} AS max_pos,
{R('median(value)', 3)} AS median_pos, {R('log10(max(value)) - log10(min(value))')} AS log10_range FROM base GROUP BY ALL""", False))
def value_profile(spark, d):
    p = qc.profile(tb.cells(spark, d, "flag"))
    return p.select(STUDY, SAMPLE, "n", "n_nan", "n_zero", "n_pos", rd("min_pos", 4), rd("max_pos", 4), rd("median_pos", 3), rd("log10_range"))


@query("id_patterns", with_sql("one", """SELECT study_id, pattern, n FROM (SELECT study_id, count_if(regexp_matches(p_type, '^STAND')) AS standard, count_if(regexp_matches(p_brand, '[05]$')) AS round_brand FROM feat GROUP BY ALL)
UNPIVOT (n FOR pattern IN (standard, round_brand))""", False))
def id_patterns(spark, d):
    f = tb.features(spark, d).withColumn("id", F.concat_ws("|", "p_type", "p_brand"))
    return qc.pattern_counts(f, "id", {"standard": r"^STAND", "round_brand": r"[05]$"})


@query("features_by_runs", with_sql("flag", "SELECT study_id, k AS n_runs, count(*) AS n_features FROM (SELECT f.study_id, f.feature_id, count(b.value) AS k FROM feat f LEFT JOIN base b USING (study_id, feature_id) GROUP BY ALL) GROUP BY ALL", False, sparse=True))
def features_by_runs(spark, d):
    return qc.features_by_runs(tb.cells(spark, d, "flag", sparse=True), tb.features(spark, d, "flag"))


@query("duplicate_value_rows", with_sql("flag", """SELECT study_id, count(*) AS n_groups, cast(sum(k) AS bigint) AS n_features FROM (SELECT study_id, rw, count(*) AS k FROM (
SELECT study_id, feature_id, list(struct_pack(s := sample_id, c := count) ORDER BY sample_id) AS rw FROM base GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL""", False))
def duplicate_value_rows(spark, d):
    c = tb.base_cells(spark, d, "flag").withColumn("value", F.col("count").cast("double"))
    return qc.duplicate_value_rows(c)


@query("token_counts", """SELECT source AS study_id, token, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '\\b(th[a-z]+)\\b', 1)) AS token FROM documents) GROUP BY ALL""")
def token_counts(spark, d):
    docs = tb.table(spark, d, "documents").select(F.col("source").alias(STUDY), "text")
    return qc.token_counts(docs, "text", r"\b(th[a-z]+)\b")


@query("source_agreement", with_sql("one", f"""SELECT {SK}, count(*) AS n, {R('corr(log2(a), log2(b))')} AS r_log2, {R('median(abs(a - b) / b)')} AS median_rel_diff FROM
(SELECT study_id, p_brand, sample_id, sum(value) AS a, sum(count * 50000.5) AS b FROM base JOIN feat USING (study_id, feature_id) WHERE p_brand IS NOT NULL GROUP BY ALL) GROUP BY ALL""", False))
def source_agreement(spark, d):
    c = tb.base_cells(spark, d).join(tb.features(spark, d).select(STUDY, FEATURE, "p_brand"), [STUDY, FEATURE]).where("p_brand is not null")
    out = qc.source_agreement(c, c.withColumn("value", F.col("count") * 50000.5), "p_brand")
    return out.select(STUDY, SAMPLE, "n", rd("r_log2"), rd("median_rel_diff"))


@query("id_depth", with_sql("flag", f"""SELECT s.study_id, s.sample_id, coalesce(n, 0) AS n_detected, {R('median(CASE WHEN batch = $$B1$$ THEN coalesce(n, 0) END) OVER (PARTITION BY s.study_id)')} AS reference_median
FROM smp s LEFT JOIN (SELECT {SK}, count(*) AS n FROM base GROUP BY ALL) USING (study_id, sample_id)""".replace("$$B1$$", "'B1'"), False))
def id_depth(spark, d):
    depth, ref = qc.id_depth(tb.cells(spark, d, "flag"), tb.samples(spark, d, "flag"), reference=F.col("batch") == "B1")
    return depth.join(ref, STUDY).select(STUDY, SAMPLE, "n_detected", rd("reference_median"))


@query("contiguous_groups", """WITH s AS (SELECT 'n' || (s_nationkey % 5) AS study_id, CASE WHEN s_acctbal > 4000 THEN 'hi' ELSE 'lo' END AS label, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) AS p FROM supplier),
c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY study_id ORDER BY p) THEN 1 ELSE 0 END AS chg FROM s), g AS (SELECT *, sum(chg) OVER (PARTITION BY study_id ORDER BY p) AS gi FROM c)
SELECT study_id, cast(gi AS bigint) AS group_index, label, min(p) AS first_position, max(p) AS last_position, count(*) AS n FROM g GROUP BY ALL""")
def contiguous_groups(spark, d):
    s = tb.table(spark, d, "supplier").select(
        F.concat(F.lit("n"), (F.col("s_nationkey") % 5).cast("string")).alias(STUDY), F.when(F.col("s_acctbal") > 4000, "hi").otherwise("lo").alias("label"), "s_suppkey"
    )
    return qc.contiguous_groups(s, "label", ["s_suppkey"])


@query("completeness_by_feature", with_sql("one", f"SELECT f.study_id, f.feature_id, count(b.value) AS n_detected, {R('count(b.value) / any_value(n_samples)')} AS detection_rate FROM feat f JOIN nsmp USING (study_id) LEFT JOIN base b USING (study_id, feature_id) GROUP BY ALL", False, sparse=True))
def completeness_by_feature(spark, d):
    f, _ = qc.completeness(tb.cells(spark, d, sparse=True), tb.features(spark, d), tb.samples(spark, d, sparse=True))
    return f.select(STUDY, FEATURE, "n_detected", rd("detection_rate"))


@query("completeness_by_sample", with_sql("one", f"SELECT s.study_id, s.sample_id, count(b.value) AS n_detected, {R('count(b.value) / any_value(nf)')} AS detection_rate FROM smp s JOIN (SELECT study_id, count(*) AS nf FROM feat GROUP BY ALL) USING (study_id) LEFT JOIN base b USING (study_id, sample_id) GROUP BY ALL", False, sparse=True))
def completeness_by_sample(spark, d):
    _, s = qc.completeness(tb.cells(spark, d, sparse=True), tb.features(spark, d), tb.samples(spark, d, sparse=True))
    return s.select(STUDY, SAMPLE, "n_detected", rd("detection_rate"))


@query("retention", with_sql("one", f"""SELECT g.study_id, g.condition AS "group", fraction, cast(ceil(fraction * n - 1e-9) AS bigint) AS needed, n AS n_samples, count_if(k >= ceil(fraction * n - 1e-9)) AS n_features
FROM (SELECT study_id, condition, count(*) AS n FROM smp GROUP BY ALL) g CROSS JOIN (SELECT unnest([0.25, 0.5, 1.0]) AS fraction)
JOIN (SELECT study_id, condition, feature_id, count(*) AS k FROM base JOIN smp USING (study_id, sample_id) GROUP BY ALL) USING (study_id, condition) GROUP BY ALL""", False, sparse=True))
def retention(spark, d):
    out = qc.retention(tb.cells(spark, d, sparse=True), tb.samples(spark, d, sparse=True), [0.25, 0.5, 1.0], "condition")
    return out.select(STUDY, "group", "fraction", F.col("needed").cast("bigint").alias("needed"), "n_samples", "n_features")


@query("retention_curve", with_sql("flag", """SELECT study_id, 'all' AS "group", kk AS k, count_if(c >= kk) AS n_features FROM (SELECT study_id, feature_id, count(*) AS c FROM base GROUP BY ALL) CROSS JOIN (SELECT unnest(range(1, 9)) AS kk) GROUP BY ALL""", False))
def retention_curve(spark, d):
    return qc.retention_curve(tb.cells(spark, d, "flag"), tb.samples(spark, d, "flag"))


@query("mnar_correlation", with_sql("flag", f"SELECT study_id, count(*) AS n, {R('corr(m, k / n_samples)')} AS r FROM (SELECT study_id, feature_id, avg(log2(value)) AS m, count(*) AS k FROM base GROUP BY ALL) JOIN nsmp USING (study_id) GROUP BY ALL", False, sparse=True))
def mnar_correlation(spark, d):
    return qc.mnar(tb.cells(spark, d, "flag", sparse=True), tb.samples(spark, d, "flag", sparse=True)).select(STUDY, "n", rd("r"))


_PTS = "pts AS (SELECT study_id, feature_id, avg(log2(value)) AS x, count(*) AS y FROM base GROUP BY ALL)"


@query("binned_median", "WITH " + with_sql("one", "", False, sparse=True)[5:] + f""", {_PTS},
e AS (SELECT study_id, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS ed FROM pts GROUP BY ALL)
SELECT study_id, bin, count(*) AS n, {R('median(x)')} AS x_median, {R('median(y)')} AS y_median FROM (
SELECT *, least(len(list_filter(ed, lambda v: v <= x)), len(ed) - 1) - 1 AS bin FROM pts JOIN e USING (study_id)) GROUP BY ALL""")
def binned_median(spark, d):
    p = qc.mnar_points(tb.cells(spark, d, sparse=True), tb.samples(spark, d, sparse=True))
    return qc.binned_median(p, [STUDY], "mean_log2", "k", 10).select(STUDY, F.col("bin").cast("bigint").alias("bin"), "n", rd("x_median"), rd("y_median"))


@query("ntile_median", "WITH " + with_sql("flag", "", False, sparse=True)[5:] + f""", {_PTS}
SELECT study_id, bin, count(*) AS n, {R('median(x)')} AS x_median, {R('median(y)')} AS y_median FROM (SELECT *, ntile(7) OVER (PARTITION BY study_id ORDER BY x, feature_id) - 1 AS bin FROM pts) GROUP BY ALL""")
def ntile_median(spark, d):
    p = qc.mnar_points(tb.cells(spark, d, "flag", sparse=True), tb.samples(spark, d, "flag", sparse=True))
    return qc.ntile_median(p, [STUDY], "mean_log2", "k", 7).select(STUDY, F.col("bin").cast("bigint").alias("bin"), "n", rd("x_median"), rd("y_median"))


_DR = """dr AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY med DESC, feature_id) AS rk, count(*) OVER (PARTITION BY study_id) AS nn FROM
(SELECT study_id, feature_id, median(value) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS k FROM base GROUP BY ALL))"""


@query("dynamic_range", "WITH " + with_sql("one", "", False)[5:] + f", {_DR} SELECT study_id, feature_id, rk AS rank, {R('log2(med)')} AS log2_median, {R('log2(q1)')} AS log2_q25, {R('log2(q3)')} AS log2_q75, k AS n_detected FROM dr")
def dynamic_range(spark, d):
    return qc.dynamic_range(tb.cells(spark, d)).select(STUDY, FEATURE, "rank", rd("log2_median"), rd("log2_q25"), rd("log2_q75"), "n_detected")


@query("dynamic_range_by_class", "WITH " + with_sql("one", "", False)[5:] + """ SELECT study_id, feature_id, p_type, row_number() OVER (PARTITION BY study_id, p_type ORDER BY median(value) DESC, feature_id) AS rank
FROM base JOIN feat USING (study_id, feature_id) GROUP BY study_id, feature_id, p_type""")
def dynamic_range_by_class(spark, d):
    return qc.dynamic_range(tb.cells(spark, d), tb.features(spark, d), "p_type").select(STUDY, FEATURE, "p_type", "rank")


@query("dynamic_range_summary", "WITH " + with_sql("flag", "", False)[5:] + f""", {_DR} SELECT study_id, count(*) AS n_detected, {R('log10(max(med) / min(med))')} AS orders, {R('log2(max(med))')} AS log2_median_max, {R('log2(min(med))')} AS log2_median_min,
count_if(k = n_samples) AS n_detected_all_samples, count_if(k = 1) AS n_detected_single_sample FROM dr JOIN nsmp USING (study_id) GROUP BY ALL""")
def dynamic_range_summary(spark, d):
    r = qc.dynamic_range(tb.cells(spark, d, "flag"))
    s = qc.dynamic_range_summary(r, tb.samples(spark, d, "flag"))
    return s.select(STUDY, "n_detected", rd("orders"), rd("log2_median_max"), rd("log2_median_min"), "n_detected_all_samples", "n_detected_single_sample")


@query("flagged_ranks", "WITH " + with_sql("three", "", False)[5:] + f""", {_DR}, nf AS (SELECT study_id, count_if(is_contaminant) AS n_flagged FROM feat GROUP BY ALL)
SELECT study_id, any_value(n_flagged) AS n_flagged, count(*) AS n_flagged_detected, count_if(rk <= 10) AS n_top_10, count_if(rk <= 100) AS n_top_100, count_if(rk <= ceil(nn / 10)) AS n_top_decile, {R('median(rk)')} AS median_rank
FROM dr JOIN (SELECT * FROM feat WHERE is_contaminant) USING (study_id, feature_id) JOIN nf USING (study_id) GROUP BY ALL""")
def flagged_ranks(spark, d):
    s, _ = qc.flagged_ranks(qc.dynamic_range(tb.cells(spark, d, "three")), tb.features(spark, d, "three"), "is_contaminant")
    return s.select(STUDY, "n_flagged", "n_flagged_detected", "n_top_10", "n_top_100", "n_top_decile", rd("median_rank"))


@query("flagged_top_list", "WITH " + with_sql("three", "", False)[5:] + f", {_DR} SELECT study_id, feature_id, rk AS rank FROM dr SEMI JOIN (SELECT * FROM feat WHERE is_contaminant) USING (study_id, feature_id) QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY rk) <= 10")
def flagged_top_list(spark, d):
    _, first = qc.flagged_ranks(qc.dynamic_range(tb.cells(spark, d, "three")), tb.features(spark, d, "three"), "is_contaminant")
    return first.select(STUDY, FEATURE, "rank")


def _states(spark, d, study="one"):
    raw = complete(spark, d, study)
    return qc.stack_states({"raw": raw, "normalized": nz.normalize(raw)})


_ST = "st AS (SELECT 'raw' AS state, study_id, feature_id, sample_id, value FROM comp UNION ALL SELECT 'normalized', study_id, feature_id, sample_id, value FROM norm)"


@query("box_summary", with_sql("one", "")[:-1] + f""", {_ST} SELECT state, {SK}, {R('min(value)', 2)} AS "min", {R('quantile_cont(value, 0.25)', 2)} AS q25, {R('median(value)', 2)} AS "median", {R('quantile_cont(value, 0.75)', 2)} AS q75, {R('max(value)', 2)} AS "max" FROM st GROUP BY ALL""")
def box_summary(spark, d):
    b = qc.box_summary(_states(spark, d))
    return b.select("state", STUDY, SAMPLE, *[rd(c, 2) for c in ("min", "q25", "median", "q75", "max")])


@query("median_range", with_sql("three", "")[:-1] + f""", {_ST} SELECT state, study_id, {R('max(m) - min(m)', 4)} AS median_range FROM (SELECT state, {SK}, median(log2(value + 1)) AS m FROM st GROUP BY ALL) GROUP BY ALL""")
def median_range(spark, d):
    s = _states(spark, d, "three").withColumn("value", F.log2(F.col("value") + 1))
    return qc.median_range(qc.box_summary(s)).select("state", STUDY, rd("median_range", 4))


@query("cv_per_feature", with_sql("one", "")[:-1] + f""", {_ST} SELECT state, study_id, feature_id, {R('stddev_samp(value) / avg(value)')} AS cv FROM st GROUP BY ALL""")
def cv_per_feature(spark, d):
    return qc.cv(_states(spark, d)).select("state", STUDY, FEATURE, rd("cv"))


@query("median_cv", with_sql("three", "")[:-1] + f""", {_ST} SELECT state, study_id, count(*) AS n_features, {R('median(cv)')} AS median_cv FROM (SELECT state, study_id, feature_id, stddev_samp(value) / avg(value) AS cv FROM st GROUP BY ALL) GROUP BY ALL""")
def median_cv(spark, d):
    return qc.cv_summary(qc.cv(_states(spark, d, "three"))).select("state", STUDY, "n_features", rd("median_cv"))


@query("cv_histogram", with_sql("one", "")[:-1] + f""", {_ST}, c AS (SELECT state, study_id, feature_id, stddev_samp(value) / avg(value) AS cv FROM st GROUP BY ALL), u AS (SELECT study_id, quantile_cont(cv, 0.995) AS up FROM c GROUP BY ALL)
SELECT state, study_id, {R('up')} AS upper, CASE WHEN cv > up THEN 60 ELSE least(cast(floor(cv * 60 / up) AS int), 59) END AS bin, count(*) AS n FROM c JOIN u USING (study_id) GROUP BY ALL""")
def cv_histogram(spark, d):
    h = qc.cv_histogram(qc.cv(_states(spark, d)))
    return h.select("state", STUDY, rd("upper"), "bin", "n")


@query("cv_alignment", with_sql("one", """SELECT study_id, feature_id FROM feat ANTI JOIN comp USING (study_id, feature_id)""", True, False))
def cv_alignment(spark, d):
    s = qc.stack_states({"raw": tb.cells(spark, d), "complete": complete(spark, d)})
    return qc.cv_alignment(qc.cv(s)).select(STUDY, FEATURE)


@query("sample_correlation", with_sql("three", f"SELECT a.study_id, a.sample_id AS sample_a, b.sample_id AS sample_b, count(*) AS n, {R('corr(a.value, b.value)')} AS r FROM nlog a JOIN nlog b USING (study_id, feature_id) GROUP BY ALL"))
def sample_correlation(spark, d):
    return qc.sample_corr(normalized_log(spark, d, "three")).select(STUDY, "sample_a", "sample_b", "n", rd("r"))


_RANKED = "rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY study_id, sample_id, value) - 1) / 2.0 AS r FROM base WINDOW w AS (PARTITION BY study_id, sample_id ORDER BY value))"


@query("sample_correlation_spearman", "WITH " + with_sql("one", "", False)[5:] + f", nr AS (SELECT study_id, feature_id, sample_id, r FROM ({_RANKED[7:-1]})) SELECT a.study_id, a.sample_id AS sample_a, b.sample_id AS sample_b, count(*) AS n, {R('corr(a.r, b.r)')} AS r FROM nr a JOIN nr b USING (study_id, feature_id) GROUP BY ALL")
def sample_correlation_spearman(spark, d):
    return qc.sample_corr(tb.cells(spark, d), "spearman").select(STUDY, "sample_a", "sample_b", "n", rd("r"))


_SC = "sc AS (SELECT a.study_id, a.sample_id AS sa, b.sample_id AS sb, corr(a.value, b.value) AS r FROM nlog a JOIN nlog b USING (study_id, feature_id) GROUP BY ALL)"


@query("nearest_partner", with_sql("three", "")[:-1] + f""", {_SC} SELECT sc.study_id, sa AS sample_a, sb AS nearest, {R('r')} AS r, x.candidate_pair = y.candidate_pair AS own_pair FROM sc JOIN smp x ON x.study_id = sc.study_id AND x.sample_id = sa JOIN smp y ON y.study_id = sc.study_id AND y.sample_id = sb WHERE sa <> sb QUALIFY row_number() OVER (PARTITION BY sc.study_id, sa ORDER BY r DESC, sb) = 1""")
def nearest_partner(spark, d):
    out = qc.nearest_partner(qc.sample_corr(normalized_log(spark, d, "three")), tb.samples(spark, d, "three"))
    return out.select(STUDY, "sample_a", "nearest", rd("r"), "own_pair")


@query("correlation_summary", with_sql("three", "")[:-1] + f""", {_SC} SELECT study_id, count(*) AS n_pairs, {R('min(r)')} AS min_r, arg_min(sa || '/' || sb, r) AS min_pair, {R('max(r)')} AS max_r, arg_max(sa || '/' || sb, r) AS max_pair, {R('median(r)')} AS median_r FROM sc WHERE sa < sb GROUP BY ALL""")
def correlation_summary(spark, d):
    s = qc.corr_summary(qc.sample_corr(normalized_log(spark, d, "three")))
    return s.select(STUDY, "n_pairs", rd("min_r"), "min_pair", rd("max_r"), "max_pair", rd("median_r"))


@query("pca_scores")
def pca_scores(spark, d):
    return qc.pca(normalized_log(spark, d, "three"), 3).select(STUDY, "component", SAMPLE, rd("score", 5), rd("explained"))


@query("pca_explained_total", with_sql("one", f"""SELECT study_id, 1.0 AS total, {R('sum((value - m) ^ 2)', 4)} AS sum_squares FROM (SELECT *, avg(value) OVER (PARTITION BY study_id, feature_id) AS m FROM nlog) GROUP BY ALL"""))
def pca_explained_total(spark, d):
    """All components together explain everything; their scores carry the total variation."""
    p = qc.pca(normalized_log(spark, d), 8)
    shares = p.select(STUDY, "component", "explained").distinct().groupBy(STUDY).agg(rd(F.sum("explained"), 6, "total"))
    return shares.join(p.groupBy(STUDY).agg(rd(F.sum(F.col("score") * F.col("score")), 4, "sum_squares")), STUDY)


@query("pca_standardized")
def pca_standardized(spark, d):
    return qc.pca(normalized_log(spark, d), 2, True).select(STUDY, "component", SAMPLE, rd("score", 5), rd("explained"))


@query("align_states", with_sql("flag", "SELECT study_id, sample_id, 'left_only' AS side, 'big' AS state FROM (SELECT DISTINCT study_id, sample_id FROM base) ANTI JOIN (SELECT * FROM base WHERE count >= 4) USING (study_id, sample_id)", False, sparse=True))
def align_states(spark, d):
    c = tb.base_cells(spark, d, "flag", sparse=True)
    return qc.align_states({"all": c, "big": c.where("count >= 4")}).select(STUDY, SAMPLE, "side", "state")


@query("acquisition_order_check", """SELECT study_id, k FROM (SELECT 's' || (s_suppkey % 3) AS study_id, s_suppkey AS k, s_nationkey AS v, lag(s_nationkey) OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS pv FROM supplier) WHERE pv > v""")
def acquisition_order_check(spark, d):
    s = tb.table(spark, d, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 3).cast("string")).alias(STUDY), F.col("s_suppkey").alias("k"), "s_nationkey")
    return qc.check_order(s, "k", ["s_nationkey"]).select(STUDY, "k")


@query("same_detection", with_sql("one", """SELECT study_id, sample_id, count_if(value > 0) AS n_detected, count_if(value > 0 AND NOT is_contaminant) AS n_detected_unflagged, count_if(count < 2) AS n_conflicts
FROM base JOIN feat USING (study_id, feature_id) GROUP BY ALL""", False))
def same_detection(spark, d):
    c = tb.base_cells(spark, d)
    twice = c.withColumn("value", F.when(F.col("count") >= 2, F.col("count").cast("double")))
    conflicts, depth = qc.same_detection(c, twice, tb.features(spark, d).where("is_contaminant"))
    n = conflicts.groupBy(STUDY, SAMPLE).agg(F.count(F.lit(1)).alias("n_conflicts"))
    return depth.join(n, [STUDY, SAMPLE], "left").na.fill(0)


@query("rank_correlation_pooled", "WITH " + with_sql("one", "", False)[5:] + f""", rk AS (SELECT study_id, rank() OVER (PARTITION BY study_id ORDER BY value) + (count(*) OVER (PARTITION BY study_id, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY study_id ORDER BY count) + (count(*) OVER (PARTITION BY study_id, count) - 1) / 2.0 AS b FROM base)
SELECT study_id, count(*) AS n, {R('corr(a, b)')} AS r FROM rk GROUP BY ALL""")
def rank_correlation_pooled(spark, d):
    return correlate(tag_scale(tb.base_cells(spark, d), "linear"), "value", "count", [STUDY], "spearman").select(STUDY, "n", rd("r"))
