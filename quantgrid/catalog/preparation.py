"""Filters, missing values, normalisation, batch effects and design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.catalog.base import R, query, rd, with_sql
from quantgrid.model import CELL_KEY, FEATURE, SAMPLE, STUDY, tag_scale
from quantgrid.operators import batch as bt
from quantgrid.operators import design as ds
from quantgrid.operators import missing as ms
from quantgrid.operators import normalize as nz
from quantgrid.plans import testbed as tb
from quantgrid.plans.states import build_count_states, build_states, manifest
from quantgrid.session import materialise
from quantgrid.sources.text import add_run_half, with_run_position

GRID = "grid AS (SELECT f.study_id, f.feature_id, s.sample_id, b.value FROM feat f JOIN smp s USING (study_id) LEFT JOIN base b USING (study_id, feature_id, sample_id))"


def complete(spark: SparkSession, d: str, study: str = "one") -> DataFrame:
    return materialise(tag_scale(ms.complete_cells(tb.cells(spark, d, study), tb.samples(spark, d, study)), "linear"))


def normalized_log(spark: SparkSession, d: str, study: str = "one") -> DataFrame:
    return materialise(nz.log2_transform(nz.normalize(complete(spark, d, study))))


def cell_out(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*CELL_KEY, rd("value", digits))


CELL = "study_id, feature_id, sample_id, "


@query("complete_grid", f"WITH {with_sql('flag', '', False)[5:]}, {GRID} SELECT {CELL}{R('value', 4)} AS value FROM grid")
def complete_grid(spark, d):
    from quantgrid.model import complete_grid as op

    return cell_out(op(tb.cells(spark, d, "flag"), tb.features(spark, d, "flag"), tb.samples(spark, d, "flag")), 4)


@query("completeness_violations", f"WITH {with_sql('flag', '', False)[5:]}, {GRID} SELECT study_id, feature_id, sample_id FROM grid WHERE value IS NULL")
def completeness_violations(spark, d):
    """The cells for which an operator that needs complete features would refuse the table."""
    from quantgrid.model import complete_grid as op

    return nz.require_complete(op(tb.cells(spark, d, "flag"), tb.features(spark, d, "flag"), tb.samples(spark, d, "flag"))).select(*CELL_KEY)


@query("detection_mask", with_sql("flag", "SELECT study_id, sample_id, count_if(value > 50000) AS n_above, count_if(value > 0) AS n_detected FROM base GROUP BY ALL", False))
def detection_mask(spark, d):
    c = tb.cells(spark, d, "flag")
    return c.groupBy(STUDY, SAMPLE).agg(F.count_if(ms.detected(50000)).alias("n_above"), F.count_if(ms.detected()).alias("n_detected"))


@query("missing_filter", with_sql("one", f"""SELECT study_id, feature_id, {R('1 - k / n_samples')} AS missing_fraction, k / n_samples >= 0.5 AS kept
FROM (SELECT f.study_id, f.feature_id, count(b.value) AS k FROM feat f LEFT JOIN base b USING (study_id, feature_id) GROUP BY ALL) JOIN nsmp USING (study_id)""", False, sparse=True))
def missing_filter(spark, d):
    c, f, s = tb.cells(spark, d, sparse=True), tb.features(spark, d), tb.samples(spark, d, sparse=True)
    rates = ms.missing_fractions(c, f, s)
    kept, _, _ = ms.filter_missing(c, f, s, 0.5)
    ids = kept.select(STUDY, FEATURE).distinct().withColumn("k", F.lit(True))
    return rates.join(ids, [STUDY, FEATURE], "left").select(STUDY, FEATURE, rd("missing_fraction"), F.coalesce("k", F.lit(False)).alias("kept"))


@query("missing_filter_report", with_sql("flag", """SELECT study_id, count(*) AS n_features_in, count_if(k = n_samples) AS n_features_out, count_if(k < n_samples) AS n_dropped
FROM (SELECT f.study_id, f.feature_id, count(b.value) AS k FROM feat f LEFT JOIN base b USING (study_id, feature_id) GROUP BY ALL) JOIN nsmp USING (study_id) GROUP BY ALL""", False))
def missing_filter_report(spark, d):
    return ms.filter_missing(tb.cells(spark, d, "flag"), tb.features(spark, d, "flag"), tb.samples(spark, d, "flag"))[2]


@query("contaminant_subset", with_sql("one", f"SELECT {CELL}{R('value', 4)} AS value FROM base SEMI JOIN (SELECT * FROM feat WHERE NOT is_contaminant) USING (study_id, feature_id)", False))
def contaminant_subset(spark, d):
    return cell_out(ms.subset(tb.cells(spark, d), tb.features(spark, d), ~F.col("is_contaminant")), 4)


def _impute(spark, d, method, **kw):
    s = tb.samples(spark, d, "flag")
    out = ms.impute(tb.cells(spark, d, "flag"), tb.features(spark, d, "flag"), s, method, **kw)
    return cell_out(out.withColumn("value", F.log2(F.col("value") + 1)))


def _impute_sql(fill: str) -> str:
    return f"WITH {with_sql('flag', '', False)[5:]}, {GRID} SELECT {CELL}{R(f'log2(1 + coalesce(value, {fill}))')} AS value FROM grid"


@query("impute_zero", _impute_sql("0"))
def impute_zero(spark, d):
    return _impute(spark, d, "zero")


@query("impute_mean", _impute_sql("avg(value) OVER (PARTITION BY study_id, feature_id)"))
def impute_mean(spark, d):
    return _impute(spark, d, "mean")


@query("impute_median", _impute_sql("median(value) OVER (PARTITION BY study_id, feature_id)"))
def impute_median(spark, d):
    return _impute(spark, d, "median")


_KNN = f"""WITH {with_sql('flag', '', False)[5:]}, {GRID},
size AS (SELECT study_id, count(DISTINCT feature_id) AS nf FROM base GROUP BY ALL),
dist AS (SELECT a.study_id, a.sample_id AS sa, b.sample_id AS sb, sum((a.value - b.value) ^ 2) * any_value(nf) / count(*) AS dd
         FROM base a JOIN base b USING (study_id, feature_id) JOIN size USING (study_id) WHERE a.sample_id <> b.sample_id GROUP BY ALL),
cand AS (SELECT g.study_id, g.feature_id, g.sample_id, b.value AS v, row_number() OVER (PARTITION BY g.study_id, g.feature_id, g.sample_id ORDER BY dd, sb) AS rn
         FROM grid g JOIN dist ON dist.study_id = g.study_id AND sa = g.sample_id JOIN base b ON b.study_id = g.study_id AND b.feature_id = g.feature_id AND b.sample_id = sb WHERE g.value IS NULL),
fill AS (SELECT study_id, feature_id, sample_id, avg(v) AS v FROM cand WHERE rn <= 3 GROUP BY ALL)
SELECT {CELL}{R('log2(1 + coalesce(g.value, fill.v, avg(g.value) OVER (PARTITION BY g.study_id, g.feature_id)))')} AS value FROM grid g LEFT JOIN fill USING (study_id, feature_id, sample_id)"""


@query("impute_knn", _KNN)
def impute_knn(spark, d):
    return _impute(spark, d, "knn", k=3)


@query("fully_missing_features", """WITH hi AS (SELECT 's0' AS study_id, 'p' || l_partkey AS feature_id, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT study_id, feature_id FROM hi WHERE q <= 48""")
def fully_missing_features(spark, d):
    line = tb.table(spark, d, "lineitem").select(F.lit("s0").alias(STUDY), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias(FEATURE), F.col("l_quantity").alias("value"))
    return ms.fully_missing(line, tb.features(spark, d), 48.0)


@query("drop_constant", with_sql("flag", "SELECT study_id, feature_id FROM base GROUP BY ALL HAVING max(count) = min(count)", False))
def drop_constant(spark, d):
    c = tb.base_cells(spark, d, "flag").withColumn("value", F.col("count").cast("double"))
    return ms.drop_constant(c)[1]


@query("common_set", with_sql("three", "SELECT study_id, feature_id FROM comp INTERSECT SELECT study_id, feature_id FROM base WHERE count >= 4", True, False))
def common_set(spark, d):
    c = tb.base_cells(spark, d, "three")
    return ms.common_set([complete(spark, d, "three"), c.where("count >= 4")])


@query("median_normalize", with_sql("three", f"SELECT {CELL}{R('value', 2)} AS value FROM norm"))
def median_normalize(spark, d):
    return cell_out(nz.normalize(complete(spark, d, "three")), 2)


@query("mad_normalize", with_sql("one", f"""SELECT {CELL}{R('(y - m) / (1.4826 * mad)')} AS value FROM (
SELECT *, median(abs(y - m)) OVER (PARTITION BY study_id, sample_id) AS mad FROM (
SELECT *, median(y) OVER (PARTITION BY study_id, sample_id) AS m FROM (SELECT {CELL}log2(value + 1) AS y FROM comp)))""", True, False))
def mad_normalize(spark, d):
    return cell_out(nz.normalize(complete(spark, d), "mad"))


@query("vsn_normalize")
def vsn_normalize(spark, d):
    return cell_out(nz.normalize(complete(spark, d), "vsn"), 3)


@query("log2_states", with_sql("one", f"SELECT {CELL}{R('value')} AS value FROM nlog"))
def log2_states(spark, d):
    return cell_out(normalized_log(spark, d))


@query("to_linear", with_sql("one", f"SELECT {CELL}{R('2 ^ value', 2)} AS value FROM nlog"))
def to_linear(spark, d):
    return cell_out(nz.to_linear(normalized_log(spark, d)), 2)


@query("median_center", with_sql("one", f"SELECT {CELL}{R('y - median(y) OVER (PARTITION BY study_id, sample_id)')} AS value FROM (SELECT {CELL}log2(value + 1) AS y FROM comp)", True, False))
def median_center(spark, d):
    return cell_out(nz.median_center(nz.log2_transform(complete(spark, d))))


@query("recover_factors", with_sql("one", f"SELECT study_id, sample_id, {R('factor', 9)} AS factor, 0 AS n_bad, true AS is_constant FROM fac"))
def recover_factors(spark, d):
    raw = complete(spark, d)
    f = nz.recover_factors(raw, nz.normalize(raw))
    return f.select(STUDY, SAMPLE, rd("factor", 9), F.col("n_bad").cast("int").alias("n_bad"), (F.col("max_rel_spread") < 1e-9).alias("is_constant"))


@query("apply_factors", with_sql("one", f"SELECT b.study_id, b.feature_id, b.sample_id, {R('b.value * factor', 2)} AS value FROM base b JOIN fac USING (study_id, sample_id)"))
def apply_factors(spark, d):
    raw = complete(spark, d)
    return cell_out(nz.apply_factors(tb.cells(spark, d), nz.recover_factors(raw, nz.normalize(raw))), 2)


@query("run_offsets", with_sql("three", f"""SELECT study_id, sample_id, {R('median(y - m)')} AS "offset" FROM (
SELECT *, avg(y) OVER (PARTITION BY study_id, feature_id) AS m FROM (SELECT study_id, feature_id, sample_id, log2(count) AS y FROM comp)) GROUP BY ALL""", True, False))
def run_offsets(spark, d):
    c = tb.base_cells(spark, d, "three").join(complete(spark, d, "three").select(*CELL_KEY), CELL_KEY, "left_semi")
    return nz.run_offsets(c.withColumn("value", F.log2("count"))).select(STUDY, SAMPLE, rd("offset"))


@query("center_by_feature", with_sql("one", f"SELECT {CELL}{R('value - avg(value) OVER (PARTITION BY study_id, feature_id)')} AS value FROM nlog"))
def center_by_feature(spark, d):
    return cell_out(nz.center_by_feature(normalized_log(spark, d)))


_STATES = f"""WITH {with_sql('one', '', True, False)[5:]},
comp2 AS (SELECT * FROM comp SEMI JOIN (SELECT * FROM feat WHERE NOT is_contaminant) USING (study_id, feature_id)),
m2 AS (SELECT study_id, sample_id, median(value) AS m FROM comp2 GROUP BY ALL),
f2 AS (SELECT study_id, sample_id, avg(m) OVER (PARTITION BY study_id) / m AS factor FROM m2),
nlog AS (SELECT study_id, feature_id, sample_id, log2(value * factor + 1) AS value FROM comp2 JOIN f2 USING (study_id, sample_id))"""


@query("state_pipeline", _STATES + f" SELECT {CELL}{R('value')} AS value FROM nlog")
def state_pipeline(spark, d):
    return cell_out(build_states(tb.cells(spark, d), tb.features(spark, d), tb.samples(spark, d))["normalized_log"])


def _fractions(spark, d, study="one"):
    c = tb.base_cells(spark, d, study).join(tb.features(spark, d, study).select(STUDY, FEATURE, "p_size"), [STUDY, FEATURE])
    raw = F.col("count") / F.col("p_size")
    summed = c.withColumn("_f", raw).groupBy(STUDY, SAMPLE).agg(F.sum("_f").alias("_t"))
    return c.withColumn("_f", raw).join(summed, [STUDY, SAMPLE]).select(*CELL_KEY, (F.col("_f") / F.col("_t")).alias("value"), "count")


FRACTION = """,
frac AS (SELECT study_id, feature_id, sample_id, count, (count / p_size) / sum(count / p_size) OVER (PARTITION BY study_id, sample_id) AS fraction
         FROM base JOIN feat USING (study_id, feature_id) WHERE p_size IS NOT NULL)"""


@query("count_states", f"""WITH {with_sql('one', '', True, False)[5:]}{FRACTION}
SELECT c.study_id, c.feature_id, c.sample_id, {R('log2(fraction + 1e-9)')} AS fraction_log, {R('log2(f.count + 1)')} AS count_log
FROM comp c JOIN frac f USING (study_id, feature_id, sample_id) JOIN feat USING (study_id, feature_id) WHERE NOT is_contaminant""")
def count_states(spark, d):
    f = _fractions(spark, d)
    counts = f.select(*CELL_KEY, F.col("count").cast("double").alias("value"))
    st = build_count_states(f.drop("count"), counts, tb.features(spark, d), tb.samples(spark, d))
    a = st["fraction_log"].select(*CELL_KEY, rd("value", 6, "fraction_log"))
    return a.join(st["count_log"].select(*CELL_KEY, rd("value", 6, "count_log")), CELL_KEY)


@query("state_manifest", with_sql("one", """SELECT study_id, 'raw' AS state, count(DISTINCT feature_id) AS n_features, count(DISTINCT sample_id) AS n_samples, count(value) AS n_cells FROM base GROUP BY ALL
UNION ALL SELECT study_id, 'complete', count(DISTINCT feature_id), count(DISTINCT sample_id), count(value) FROM comp GROUP BY ALL""", True, False))
def state_manifest(spark, d):
    return manifest({"raw": tb.cells(spark, d), "complete": complete(spark, d)})


_STEP = "(n * tau2 * g + s[2] * bar) / (n * tau2 + s[2])"
_SCALE = f"CASE WHEN NOT v > 0 THEN d ELSE ((m * v + m * m * m) / v + 0.5 * ((n - 1) * d + n * (g - ({_STEP})) ^ 2)) / (n / 2 + (2 * v + m * m) / v - 1) END"


def _combat_sql(mask: str = "true") -> str:
    """``fx``: all cells of nlog after correction of the samples that ``mask`` takes. Both moments of a batch effect are iterated, each row until it changes by less than 1e-6."""
    return f""", kn AS (SELECT nlog.*, batch FROM nlog JOIN smp USING (study_id, sample_id) WHERE {mask}),
mo AS (SELECT study_id, feature_id, batch, count(value)::double AS n, avg(value) AS mean, var_samp(value) AS var FROM kn GROUP BY ALL),
po AS (SELECT study_id, feature_id, sum(n * mean) / sum(n) AS grand, sum(var * (n - 1)) / sum(n) AS pooled, sum(n * mean * mean) / sum(n) AS m2 FROM mo GROUP BY ALL),
ef AS (SELECT *, (mean - grand) / sqrt(pooled) AS g, var / pooled AS d FROM mo JOIN po USING (study_id, feature_id) WHERE pooled > 0 AND pooled + greatest(m2 - grand * grand, 0) > 1e-12),
pr AS (SELECT study_id, batch, avg(g) AS bar, var_samp(g) AS tau2, avg(d) AS m, var_samp(d) AS v FROM ef GROUP BY ALL),
eb AS (SELECT study_id, feature_id, batch, grand, pooled, list_reduce(list_transform(range(500), lambda i: [0.0::double]), lambda s, e: CASE WHEN s[3] = 0 THEN s
 ELSE [{_STEP}, {_SCALE}, (greatest(abs(({_STEP}) - s[1]) / greatest(abs(s[1]), 1e-12), abs(({_SCALE}) - s[2]) / greatest(s[2], 1e-12)) >= 1e-6)::int::double] END, [g, d, 1.0::double]) AS e FROM ef JOIN pr USING (study_id, batch)),
fx AS (SELECT c.study_id, c.feature_id, c.sample_id, CASE WHEN kn.batch IS NULL OR e IS NULL THEN c.value ELSE sqrt(pooled) * ((c.value - grand) / sqrt(pooled) - e[1]) / sqrt(e[2]) + grand END AS value, kn.batch IS NOT NULL AND e IS NOT NULL AS corrected
 FROM nlog c LEFT JOIN kn USING (study_id, feature_id, sample_id) LEFT JOIN eb ON eb.study_id = c.study_id AND eb.feature_id = c.feature_id AND eb.batch = kn.batch)"""


def _with_combat(study: str, digits: int, more: str = "", mask: str = "true") -> str:
    return with_sql(study, "").rstrip() + _combat_sql(mask) + f"\nSELECT {CELL}{R('value', digits)} AS value{more} FROM fx"


@query("combat_correct", _with_combat("three", 5, ", corrected"))
def combat_correct(spark, d):
    out = bt.combat(normalized_log(spark, d, "three"), tb.samples(spark, d, "three"))
    return out.select(*CELL_KEY, rd("value", 5), "corrected")


@query("batch_corrected_states", _STATES + _combat_sql() + f" SELECT {CELL}{R('value', 5)} AS value FROM fx")
def batch_corrected_states(spark, d):
    states = build_states(tb.cells(spark, d), tb.features(spark, d), tb.samples(spark, d))
    return cell_out(states["batch_corrected_log"], 5)


@query("combat_passed_through", with_sql("three", "SELECT study_id, feature_id FROM comp SEMI JOIN (SELECT * FROM feat WHERE is_contaminant) USING (study_id, feature_id) GROUP BY ALL"))
def combat_passed_through(spark, d):
    """Features that are made constant come through uncorrected, and only those."""
    flat = tb.features(spark, d, "three").where("is_contaminant").select(STUDY, FEATURE, F.lit(20.0).alias("_flat"))
    cells = normalized_log(spark, d, "three").join(flat, [STUDY, FEATURE], "left")
    cells = tag_scale(cells.withColumn("value", F.coalesce("_flat", "value")).drop("_flat"), "log2")
    return bt.passed_through(bt.combat(cells, tb.samples(spark, d, "three"))).select(STUDY, FEATURE)


@query("combat_masked", _with_combat("one", 5, ", corrected", "candidate_pair <> 'P1'"))
def combat_masked(spark, d):
    """Samples outside the mask come back as they went in; the others are corrected among themselves."""
    out = bt.combat(normalized_log(spark, d), tb.samples(spark, d), sample_mask=F.col("candidate_pair") != "P1")
    return out.select(*CELL_KEY, rd("value", 5), "corrected")


# --- design -----------------------------------------------------------------------------

_ORD = "SELECT 's0' AS study_id, o_orderpriority AS prio, o_orderstatus AS status, o_custkey % 11 AS seg FROM orders"


def _orders(spark, d):
    return tb.table(spark, d, "orders").select(
        F.lit("s0").alias(STUDY), F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 11).alias("seg")
    )


@query("crosstab", f"SELECT study_id, prio, count_if(status = 'F') AS F, count_if(status = 'O') AS O, count_if(status = 'P') AS P FROM ({_ORD}) GROUP BY ALL")
def crosstab(spark, d):
    return ds.crosstab(_orders(spark, d), "prio", "status").select(STUDY, "prio", "F", "O", "P")


_V = """WITH o AS ({src}), t AS (SELECT study_id, {a} AS a, {b} AS b, count(*) AS o FROM o GROUP BY ALL),
g AS (SELECT x.study_id, x.a, y.b, coalesce(t.o, 0) AS o, x.r, y.c, x.n FROM (SELECT *, sum(r) OVER (PARTITION BY study_id) AS n FROM (SELECT study_id, a, sum(o) AS r FROM t GROUP BY ALL)) x
  JOIN (SELECT study_id, b, sum(o) AS c FROM t GROUP BY ALL) y USING (study_id) LEFT JOIN t USING (study_id, a, b)),
s AS (SELECT study_id, any_value(n) AS n, count(DISTINCT a) AS ra, count(DISTINCT b) AS cb, sum((o - r * c / n) ^ 2 / (r * c / n)) AS chi2 FROM g GROUP BY ALL)"""


def _v_sql(src, a, b):
    corr = "sqrt(greatest(0, chi2 / n - (ra - 1) * (cb - 1) / (n - 1)) / least(ra - (ra - 1) ^ 2 / (n - 1) - 1, cb - (cb - 1) ^ 2 / (n - 1) - 1))"
    return _V.format(src=src, a=a, b=b) + f" SELECT study_id, cast(n AS bigint) AS n, ra AS n_a, cb AS n_b, {R('chi2', 5)} AS chi2, {R('sqrt(chi2 / n / least(ra - 1, cb - 1))')} AS v, {R(corr)} AS v_corrected FROM s"


@query("association", _v_sql(_ORD, "prio", "seg"))
def association(spark, d):
    v = ds.association(_orders(spark, d), "prio", "seg")
    return v.select(STUDY, F.col("n").cast("bigint").alias("n"), "n_a", "n_b", rd("chi2", 5), rd("v"), rd("v_corrected"))


@query("confounding_report", with_sql("three", "SELECT study_id, 'candidate_pair' AS covariate, 0.816497 AS cramers_v, false AS perfect, 'strong' AS grade FROM nsmp UNION ALL SELECT study_id, 'condition', 0.0, false, 'weak' FROM nsmp", False))
def confounding_report(spark, d):
    out = ds.assess_confounding(tb.samples(spark, d, "three"), "batch", ["candidate_pair", "condition"])
    return out.select(STUDY, "covariate", rd("cramers_v"), "perfect", "grade")


_SUP = """sup AS (SELECT 'n' || (s_nationkey % 5) AS study_id, 'b' || (s_nationkey // 5) AS batch, 'r' || s_suppkey AS sample_id, s_suppkey AS seq_number,
  CASE WHEN s_acctbal > 4000 THEN 'control' ELSE 'treated' END AS condition FROM supplier)"""


def _suppliers(spark, d):
    s = tb.table(spark, d, "supplier")
    return s.select(
        F.concat(F.lit("n"), (F.col("s_nationkey") % 5).cast("string")).alias(STUDY), F.concat(F.lit("b"), F.floor(F.col("s_nationkey") / 5).cast("string")).alias("batch"),
        F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias(SAMPLE), F.col("s_suppkey").alias("seq_number"),
        F.when(F.col("s_acctbal") > 4000, "control").otherwise("treated").alias("condition"),
    )


@query("run_order_counts", f"""WITH {_SUP} SELECT b.study_id, b.batch, count_if(condition = 'control') AS n_control, count_if(condition = 'treated') AS n_other,
coalesce(any_value(u), 0) AS u FROM sup b LEFT JOIN (SELECT c.study_id, c.batch, count(*) AS u FROM sup c JOIN sup t ON c.study_id = t.study_id AND c.batch = t.batch AND c.condition = 'control' AND t.condition = 'treated' AND c.seq_number < t.seq_number GROUP BY ALL) x USING (study_id, batch) GROUP BY ALL""")
def run_order_counts(spark, d):
    return ds.order_statistics(_suppliers(spark, d), "control")


#: All orders of a batch's conditions, as bit masks; batches are small here.
@query("run_order_exact", f"""WITH {_SUP}, ct AS (SELECT b.study_id, b.batch, count_if(condition = 'control') AS k, count_if(condition = 'treated') AS m, coalesce(any_value(u), 0) AS u FROM sup b LEFT JOIN
(SELECT c.study_id, c.batch, count(*) AS u FROM sup c JOIN sup t ON c.study_id = t.study_id AND c.batch = t.batch AND c.condition = 'control' AND t.condition = 'treated' AND c.seq_number < t.seq_number GROUP BY ALL) x USING (study_id, batch) GROUP BY ALL),
od AS (SELECT k, m, o, list_sum(list_transform(range(0, k + m), lambda i: ((o >> i) & 1) * (k + m - 1 - i - bit_count(o >> (i + 1))))) AS v FROM (SELECT k, m, unnest(range(0, 1::bigint << (k + m))) AS o FROM (SELECT DISTINCT k::bigint AS k, m::bigint AS m FROM ct)) WHERE bit_count(o) = k),
pp AS (SELECT study_id, batch, ct.k * ct.m AS u_max, any_value(u) AS u, avg((abs(2 * v - ct.k * ct.m) >= abs(2 * u - ct.k * ct.m))::int) AS two, avg((v >= u)::int) AS up, avg((v <= u)::int) AS down FROM ct JOIN od USING (k, m) GROUP BY ALL)
SELECT study_id, batch, u, u_max, {R('CASE WHEN u_max > 0 THEN 2 * u / u_max - 1 ELSE 0 END')} AS rank_biserial, CASE WHEN u_max = 0 THEN 'undetermined' WHEN 2 * u > u_max THEN 'control_earlier' WHEN 2 * u < u_max THEN 'control_later' ELSE 'no_difference' END AS direction,
{R('two', 9)} AS p_two_sided, {R('CASE WHEN 2 * u >= u_max THEN up ELSE down END', 9)} AS p_one_sided FROM pp""")
def run_order_exact(spark, d):
    return ds.exact_perm(_suppliers(spark, d), "control").select(STUDY, "batch", "u", "u_max", rd("rank_biserial"), "direction", rd("p_two_sided", 9), rd("p_one_sided", 9))


_RELABEL = with_sql("one", """SELECT study_id, 2 AS n_batches, obs AS u, 10 AS u_max, 'control_earlier' AS direction,
round(count_if(u >= obs) / count(*), 6) AS p_one_sided, round(count_if(abs(2 * u - 10) >= abs(2 * obs - 10)) / count(*), 6) AS p_two_sided
FROM (SELECT a.u + b.u AS u FROM law6 a CROSS JOIN (VALUES (0), (1)) AS b(u)) CROSS JOIN
(SELECT c.study_id, count(*) AS obs FROM smp c JOIN smp t ON c.study_id = t.study_id AND c.batch = t.batch AND c.condition = 'control' AND t.condition = 'treated' AND c.seq_number < t.seq_number GROUP BY ALL)
GROUP BY ALL""", False).replace("\nSELECT study_id, 2", """,
law6 AS (SELECT m, count(*) AS u FROM range(64) AS r(m) JOIN range(6) AS i(i) ON (m >> i) & 1 = 1 JOIN range(6) AS j(j) ON j > i AND (m >> j) & 1 = 0 WHERE bit_count(m) = 3 GROUP BY m
  UNION ALL SELECT 56, 0)
SELECT study_id, 2""", 1)


@query("run_order_stratified", _RELABEL)
def run_order_stratified(spark, d):
    """Alternating runs: batch one gives U 6 of 9, batch two 1 of 1."""
    out = ds.exact_perm_stratified(tb.samples(spark, d), "control")
    return out.select(STUDY, F.col("n_batches").cast("int").alias("n_batches"), F.col("u").cast("int").alias("u"), F.col("u_max").cast("int").alias("u_max"), "direction", rd("p_one_sided"), rd("p_two_sided"))


@query("design_hypotheses", with_sql("three", """SELECT study_id, h AS hypothesis, sc AS scope, p AS passed FROM nsmp CROSS JOIN (VALUES ('H1', 'overall', true), ('H2', 'overall', true), ('H3', 'overall', true),
('H4', 'batch=B1', false), ('H4', 'batch=B2', NULL), ('H4', 'stratified', false), ('H5', 'batch=B1', true), ('H5', 'batch=B2', true)) AS v(h, sc, p)""", False))
def design_hypotheses(spark, d):
    return ds.design_report(tb.samples(spark, d, "three"), "control", "treated").drop("statistic")


_POSITIONS = range(1, 7)


@query("run_layout", with_sql("one", f"""SELECT study_id, batch, {", ".join(f"coalesce(max(CASE WHEN run_position_within_batch = {i} THEN condition || '/' || sample_id END), '') AS position_{i}" for i in _POSITIONS)} FROM smp GROUP BY ALL""", False))
def run_layout(spark, d):
    return ds.run_layout(tb.samples(spark, d)).select(STUDY, "batch", *[F.col(str(i)).alias(f"position_{i}") for i in _POSITIONS])


@query("cohort_table", f"""WITH {_SUP}, s AS (SELECT *, row_number() OVER (PARTITION BY study_id, batch ORDER BY seq_number) AS pos FROM sup)
SELECT study_id, condition, count(*) AS n, min(seq_number) AS seq_number_min, max(seq_number) AS seq_number_max, {R('median(pos)')} AS median_run_position, string_agg(sample_id, ',' ORDER BY sample_id) AS sample_ids FROM s GROUP BY ALL""")
def cohort_table(spark, d):
    s = with_run_position(_suppliers(spark, d), "seq_number", (STUDY, "batch"))
    return ds.cohort_table(s).select(STUDY, "condition", "n", "seq_number_min", "seq_number_max", rd("median_run_position"), "sample_ids")


@query("run_halves", f"""WITH {_SUP} SELECT study_id, batch, sample_id, CASE WHEN row_number() OVER (PARTITION BY study_id, batch ORDER BY seq_number) <= ceil(count(*) OVER (PARTITION BY study_id, batch) / 2) THEN 'early' ELSE 'late' END AS run_half FROM sup""")
def run_halves(spark, d):
    s = with_run_position(_suppliers(spark, d), "seq_number", (STUDY, "batch"))
    return add_run_half(s, (STUDY, "batch")).select(STUDY, "batch", SAMPLE, "run_half")


@query("join_key", with_sql("one", "SELECT study_id, sample_id, condition, 'Intensity_search_scan_file_id_' || seq_number AS intensity_column, 'UNRESOLVED' AS label FROM smp", False))
def join_key(spark, d):
    s = tb.samples(spark, d).withColumn("file", F.col(SAMPLE)).withColumn("search_scan_file_id", F.col("seq_number"))
    return ds.join_key(s).select(STUDY, SAMPLE, "condition", "intensity_column", "label")


@query("pair_layout", with_sql("three", "SELECT study_id, candidate_pair AS pair_id, any_value(batch) AS batch, max(CASE WHEN condition = 'control' THEN sample_id END) AS control_sample, max(CASE WHEN condition = 'treated' THEN sample_id END) AS treated_sample FROM smp GROUP BY ALL", False))
def pair_layout(spark, d):
    return ds.pair_layout(tb.samples(spark, d, "three"), "control", "treated")


@query("design_violations", f"""WITH {_SUP} SELECT study_id, batch AS candidate_pair, count_if(condition = 'control') AS n_control, count_if(condition = 'treated') AS n_treated FROM sup GROUP BY ALL HAVING NOT (count_if(condition = 'control') = 1 AND count_if(condition = 'treated') = 1 AND count(*) = 2)""")
def design_violations(spark, d):
    s = _suppliers(spark, d).withColumn("candidate_pair", F.col("batch"))
    return ds.validate_design(s, "control", "treated").select(STUDY, "candidate_pair", "n_control", "n_treated")
