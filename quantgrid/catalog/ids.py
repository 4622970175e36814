"""Identifier parsing, labels and modification masses, on ids made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgrid.catalog.base import R, query, rd, with_sql
from quantgrid.model import CELL_KEY, FEATURE, SAMPLE, STUDY
from quantgrid.operators import ids as op
from quantgrid.operators.checks import check_round_trip
from quantgrid.plans import testbed as tb
from quantgrid.session import materialise, spread


def protein_ids(spark, d):
    """Every seventh size class is an id without accession, every thirteenth is malformed."""
    p = tb.table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    n = F.col("p_partkey").cast("string")
    entry = F.concat(F.lit("E"), n, F.lit("_X"))
    body = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("_sp|"), entry, F.lit("|"))).when(F.col("p_size") % 13 == 0, F.concat(F.lit("_tr|"), n)).otherwise(
        F.concat(F.lit("_sp|A"), n, F.lit("|"), entry)
    )
    return p.select("*", F.concat(F.lit("psvid_"), n, body).alias("id"))


PID = """pid AS (SELECT *, 'psvid_' || p_partkey || CASE WHEN p_size % 7 = 0 THEN '_sp|E' || p_partkey || '_X|' WHEN p_size % 13 = 0 THEN '_tr|' || p_partkey ELSE '_sp|A' || p_partkey || '|E' || p_partkey || '_X' END AS id FROM part)"""


@query("parse_protein_ids", f"""WITH {PID} SELECT id, CASE WHEN p_size % 7 = 0 OR p_size % 13 <> 0 THEN p_partkey END AS group_number, CASE WHEN p_size % 7 <> 0 AND p_size % 13 <> 0 THEN 'A' || p_partkey END AS accession,
CASE WHEN p_size % 7 = 0 OR p_size % 13 <> 0 THEN 'E' || p_partkey || '_X' END AS entry, p_size % 7 = 0 AS is_candidate, p_size % 7 <> 0 AND p_size % 13 = 0 AS bad_id FROM pid""")
def parse_protein_ids(spark, d):
    return op.parse_protein_id(protein_ids(spark, d), "id").select("id", "group_number", "accession", "entry", "is_candidate", "bad_id")


@query("id_round_trip", f"WITH {PID} SELECT id FROM pid WHERE p_size % 7 = 0 OR p_size % 13 = 0")
def id_round_trip(spark, d):
    """Ids that number, accession and entry do not rebuild: the short and malformed ones."""
    p = op.parse_protein_id(protein_ids(spark, d), "id")
    whole = F.concat(F.lit("psvid_"), "group_number", F.lit("_sp|"), "accession", F.lit("|"), "entry")
    return check_round_trip(p, whole, "id").select("id")


def _groups(spark, d):
    p = protein_ids(spark, d)
    second = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("sp|Q1|Q_X"))).when(F.col("p_partkey") % 3 == 0, F.array(F.lit("sp|BARE_X|"))).otherwise(F.array().cast("array<string>"))
    return p.select(F.concat(F.array(op.accession_key("id")), second).alias("members"))


@query("refine_contaminants", f"WITH {PID} SELECT id, p_size % 7 = 0 AND p_partkey % 2 <> 0 AS is_contaminant, p_size % 7 = 0 AND p_partkey % 2 = 0 AS grouped_with_real FROM pid")
def refine_contaminants(spark, d):
    f = op.parse_protein_id(protein_ids(spark, d), "id").withColumn("accession_key", op.accession_key("id"))
    refined, _ = op.refine_contaminants(f, _groups(spark, d))
    return refined.select("id", "is_contaminant", "grouped_with_real")


@query("align_first_member", f"WITH {PID} SELECT id, 1 + CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n_members FROM pid")
def align_first_member(spark, d):
    f = protein_ids(spark, d).withColumn("accession_key", op.accession_key("id"))
    both, _ = op.align_first_member(_groups(spark, d), f)
    return both.select("id", F.size("members").alias("n_members"))


@query("parse_peptide_ids", "SELECT p_partkey, p_size + 0.5 AS total_mod_mass, p_size % 9 = 0 AS bad_id FROM part")
def parse_peptide_ids(spark, d):
    p = tb.table(spark, d, "part").withColumn("id", F.concat(F.upper("p_type"), F.lit("[+"), F.col("p_size").cast("string"), F.lit(".5]")))
    p = p.withColumn("base", F.when(F.col("p_size") % 9 == 0, F.lit("OTHER")).otherwise(F.upper("p_type")))
    return op.parse_peptide_id(p, "id", "base").select("p_partkey", "total_mod_mass", "bad_id")


@query("explode_members", "SELECT doc_id, cast(generate_subscripts(w, 1) - 1 AS int) AS member_position, unnest(w) AS member FROM (SELECT doc_id, string_split(text, ';') AS w FROM documents)")
def explode_members(spark, d):
    return op.explode_members(tb.table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "member_position", "member")


@query("flag_any_member", "SELECT o_custkey, bool_or(p_size >= 48) AS is_contaminant FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def flag_any_member(spark, d):
    """Customers as rows, the parts they bought as members."""
    o, li = tb.table(spark, d, "orders"), tb.table(spark, d, "lineitem")
    part = tb.table(spark, d, "part")
    rows = o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(part, li["l_partkey"] == part["p_partkey"]).select("o_custkey", "l_partkey").distinct()
    lists = materialise(rows.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), ";").alias("members")))
    flagged = part.where("p_size >= 48").select(F.col("p_partkey").cast("string").alias("member"))
    return op.flag_any_member(lists, flagged, ["o_custkey"], "members").select("o_custkey", "is_contaminant")


@query("significant_figures", f"""SELECT l_orderkey, l_linenumber, {R('round_even(l_extendedprice / 10 ^ (floor(log10(l_extendedprice)) - 2), 0) * 10 ^ (floor(log10(l_extendedprice)) - 2)', 4)} AS shown FROM lineitem""")
def significant_figures(spark, d):
    return tb.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rd(op.sig_figs(F.col("l_extendedprice")), 4, "shown"))


_SIG = "round_even({x} / 10 ^ (floor(log10({x})) - 2), 0) * 10 ^ (floor(log10({x})) - 2)"


@query("label_scores", "WITH " + with_sql("three", "", False)[5:] + f""" SELECT a.study_id, 'L' || a.sample_id AS label, b.sample_id, {R('avg(cast(abs(a.v - b.v) <= 1e-8 + 1e-6 * b.v AS int))')} AS match_fraction, count(*) AS n FROM
(SELECT *, {_SIG.format(x='value')} AS v FROM base) a JOIN (SELECT *, {_SIG.format(x='value')} AS v FROM base) b USING (study_id, feature_id) GROUP BY ALL""")
def label_scores(spark, d):
    c = tb.cells(spark, d, "three")
    u = c.select(STUDY, FEATURE, F.concat(F.lit("L"), SAMPLE).alias("label"), op.sig_figs(F.col("value")).alias("value"))
    return op.label_scores(u, c).select(STUDY, "label", SAMPLE, rd("match_fraction"), "n")


@query("resolve_labels", with_sql("one", "SELECT study_id, 'L' || sample_id AS label, sample_id, 1.0 AS match_fraction, true AS resolved FROM smp", False))
def resolve_labels(spark, d):
    c = tb.cells(spark, d)
    u = c.select(STUDY, FEATURE, F.concat(F.lit("L"), SAMPLE).alias("label"), op.sig_figs(F.col("value")).alias("value"))
    return op.resolve_labels(u, c).select(STUDY, "label", SAMPLE, rd("match_fraction"), "resolved")


@query("check_label_map", with_sql("one", "SELECT study_id, 'L' || sample_id AS label FROM smp WHERE batch = 'B2'", False))
def check_label_map(spark, d):
    s = tb.samples(spark, d).withColumn("label", F.concat(F.lit("L"), SAMPLE))
    stored = s.withColumn(SAMPLE, F.when(F.col("batch") == "B2", F.lit("r0")).otherwise(F.col(SAMPLE)))
    return op.check_label_map(s, stored).select(STUDY, "label")


@query("counts_to_cells", with_sql("one", f"SELECT study_id, feature_id, sample_id, {R('nullif(count - 1, 0)')} AS value, is_contaminant FROM base JOIN feat USING (study_id, feature_id)", False))
def counts_to_cells(spark, d):
    c = tb.base_cells(spark, d).withColumn("psm", F.col("count") - 1).drop("value")
    return op.counts_to_cells(c, "psm", tb.features(spark, d).select(STUDY, FEATURE, "is_contaminant")).select(*CELL_KEY, rd("value"), "is_contaminant")


@query("formula_mass", "SELECT DISTINCT 'C' || p_size || 'H' || (p_size * 2) || 'NO' || (p_size % 5 + 1) AS formula, round(p_size * 12.0 + p_size * 2 * 1.00782503207 + 14.0030740048 + (p_size % 5 + 1) * 15.99491461956, 6) + 0.0 AS mass FROM part")
def formula_mass(spark, d):
    s = F.col("p_size")
    f = tb.table(spark, d, "part").select(F.concat(F.lit("C"), s, F.lit("H"), s * 2, F.lit("NO"), s % 5 + 1).alias("formula")).distinct()
    return op.formula_mass(f).select("formula", rd("mass"))


def masses(spark, d):
    """Mass of a known composition per part, off by 0.002 for every eleventh size."""
    s = F.col("p_size")
    cam, ox, ad = s % 4, s % 3, (s % 5 == 0).cast("int")
    mass = cam * op.CAM_DELTA + ox * op.OX_DELTA + ad * op.ADDUCT_DELTA + F.when(s % 11 == 0, 0.002).otherwise(0.0)
    return tb.table(spark, d, "part").select(
        F.lit("s0").alias(STUDY), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias(FEATURE), s.alias("p_size"),
        F.round(mass, 6).alias("total_mod_mass"), F.upper("p_type").alias("base_sequence"), cam.alias("cam"), ox.alias("ox"), ad.alias("ad"),
    )


_AD = f"{op.ADDUCT_DELTA!r}"
MASS = f"""mm AS (SELECT 's0' AS study_id, 'p' || p_partkey AS feature_id, upper(p_type) AS base_sequence, p_size, round(p_size % 4 * {op.CAM_DELTA} + p_size % 3 * {op.OX_DELTA} + CASE WHEN p_size % 5 = 0 THEN {_AD} ELSE 0 END + CASE WHEN p_size % 11 = 0 THEN 0.002 ELSE 0 END, 6) AS m FROM part),
op AS (SELECT a.i AS n_cam, b.i AS n_ox, c.i AS n_adduct, a.i * {op.CAM_DELTA} + b.i * {op.OX_DELTA} + c.i * {_AD} AS w FROM range(11) AS a(i) CROSS JOIN range(7) AS b(i) CROSS JOIN range(5) AS c(i)),
sol AS (SELECT study_id, feature_id, count(w) AS n_solutions, max(n_cam) AS n_cam, max(n_ox) AS n_ox, max(n_adduct) AS n_adduct FROM mm LEFT JOIN op ON abs(m - w) <= 0.001 GROUP BY ALL)"""


@query("decompose_mass", f"WITH {MASS} SELECT feature_id, n_solutions, CASE WHEN n_solutions = 1 THEN n_cam END AS n_cam, CASE WHEN n_solutions = 1 THEN n_ox END AS n_ox, CASE WHEN n_solutions = 1 THEN n_adduct END AS n_adduct FROM sol")
def decompose_mass(spark, d):
    return op.decompose_mass(masses(spark, d)).select(FEATURE, "n_solutions", "n_cam", "n_ox", "n_adduct")


_CLS = "CASE WHEN n_solutions <> 1 THEN 'unexplained' WHEN n_adduct > 0 THEN 'adduct' WHEN n_ox > 0 THEN 'oxidized' WHEN n_cam > 0 THEN 'CAM-only' ELSE 'unmodified' END"


@query("classify_modifications", f"""WITH {MASS} SELECT feature_id, {_CLS} AS mod_class, len(base_sequence) - len(replace(base_sequence, 'C', '')) AS n_cys, len(base_sequence) - len(replace(base_sequence, 'M', '')) AS n_met,
n_solutions = 1 AND n_cam > len(base_sequence) - len(replace(base_sequence, 'C', '')) AS cam_exceeds_cys FROM sol JOIN mm USING (study_id, feature_id)""")
def classify_modifications(spark, d):
    return op.classify(op.decompose_mass(masses(spark, d))).select(FEATURE, "mod_class", "n_cys", "n_met", "cam_exceeds_cys")


@query("mass_summary", f"WITH {MASS} SELECT {R('m', 6)} AS total_mod_mass, any_value({_CLS}) AS mod_class, max(n_solutions) AS n_solutions, count(*) AS n_features FROM sol JOIN mm USING (study_id, feature_id) GROUP BY m")
def mass_summary(spark, d):
    f = op.classify(op.decompose_mass(masses(spark, d)))
    return op.mass_summary(f).select(rd("total_mod_mass"), "mod_class", "n_solutions", "n_features")


@query("reference_forms", f"""WITH {MASS}, s1 AS (SELECT sol.*, CASE WHEN n_solutions = 1 THEN base_sequence END AS bs FROM sol JOIN mm USING (study_id, feature_id)), k AS (SELECT *, bs || (CASE WHEN true THEN substr(feature_id, 1, length(feature_id) - 1) END) AS fam FROM s1)
SELECT a.feature_id, b.feature_id AS reference_feature FROM k a LEFT JOIN k b ON a.fam = b.fam AND b.n_solutions = 1 AND b.n_adduct = 0 AND b.n_ox = 0 AND b.n_cam = CASE WHEN a.n_adduct > 0 THEN a.n_cam + a.n_adduct WHEN a.n_ox > 0 THEN a.n_cam ELSE 0 END
WHERE a.n_solutions = 1 AND (a.n_adduct > 0 OR a.n_ox > 0 OR a.n_cam > 0)""")
def reference_forms(spark, d):
    """A family is a type within ten consecutive parts; adducts sit on cysteine."""
    m = masses(spark, d).withColumn("base_sequence", F.concat("base_sequence", F.expr("substr(feature_id, 1, length(feature_id) - 1)")))
    f = materialise(op.classify(op.decompose_mass(m)).withColumn("adduct_residues", F.when(F.col("n_adduct") > 0, "C").otherwise("")))
    return op.reference_form(f).select(FEATURE, "reference_feature")


def localized(spark, d):
    s = F.col("p_size")
    seq = F.concat(F.lit("AM"), F.when(s % 2 == 0, "[15.99]").otherwise(""), F.lit("TC"), F.when(s % 3 == 0, "[57.02]").when(s % 5 == 0, "[471.15]").otherwise(""), F.when(s % 7 == 0, "Y[99.00]").otherwise("Y"), F.lit("K"))
    return spread(tb.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")).select("p_partkey", "p_brand", seq.alias("localized_sequence"))


@query("parse_sites", """SELECT p_partkey, 'AMTCYK' AS base_sequence, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS n_cam, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n_ox, CASE WHEN p_size % 3 <> 0 AND p_size % 5 = 0 THEN 1 ELSE 0 END AS n_adduct, p_size % 7 = 0 AS bad_sequence,
CASE WHEN p_size % 2 = 0 THEN 'M2:Ox' ELSE '' END AS ox_sites FROM part""")
def parse_sites(spark, d):
    p = op.parse_sites(localized(spark, d), "localized_sequence")
    return p.select("p_partkey", "base_sequence", "n_cam", "n_ox", "n_adduct", "bad_sequence", op.site_text("Ox").alias("ox_sites"))


def _isoform_rows(spark, d):
    p = op.parse_sites(localized(spark, d), "localized_sequence").where("not bad_sequence")
    p = p.withColumn("base_sequence", F.concat("base_sequence", "p_brand")).withColumn("key", op.composition_key())
    p = p.withColumn("site_text", op.site_text()).withColumn("adduct_residues", F.array_join(F.transform(F.filter("sites", lambda s: s["mod"] == "Adduct"), lambda s: s["residue"]), ""))
    return materialise(p.withColumn("unique", F.col("p_partkey") % 2 == 0))


_ISO = """iso AS (SELECT p_partkey, 'AMTCYK' || p_brand || '|' || CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END || '|' || CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END || '|' || CASE WHEN p_size % 3 <> 0 AND p_size % 5 = 0 THEN 1 ELSE 0 END AS key, p_partkey % 2 = 0 AS u, p_size % 3 <> 0 AND p_size % 5 = 0 AS ad FROM part WHERE p_size % 7 <> 0)"""


@query("join_by_composition", f"WITH {_ISO} SELECT key, count(*) AS n FROM iso WHERE NOT ad GROUP BY ALL")
def join_by_composition(spark, d):
    rows = _isoform_rows(spark, d)
    f = rows.where("n_adduct = 0").select("key").distinct().withColumn(STUDY, F.lit("s0")).withColumn(FEATURE, F.col("key"))
    both, _ = op.join_by_composition(rows, f)
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("aggregate_isoforms", f"WITH {_ISO} SELECT key AS feature_id, count(*) AS n_isoforms, CASE WHEN bool_or(ad) THEN 'C' ELSE '' END AS adduct_residues, CASE WHEN bool_and(u) = bool_or(u) THEN bool_and(u) END AS \"unique\" FROM iso GROUP BY ALL")
def aggregate_isoforms(spark, d):
    rows = _isoform_rows(spark, d).withColumn(STUDY, F.lit("s0")).withColumn(FEATURE, F.col("key"))
    return op.aggregate_isoforms(rows).select(FEATURE, "n_isoforms", "adduct_residues", "unique")


@query("aggregate_isoform_cells", with_sql("one", "SELECT study_id, p_brand AS feature_id, sample_id, cast(sum(count) AS bigint) AS psm, bool_or(count = 1) AS mbr FROM base JOIN feat USING (study_id, feature_id) WHERE p_brand IS NOT NULL GROUP BY ALL", False))
def aggregate_isoform_cells(spark, d):
    c = tb.base_cells(spark, d).join(tb.features(spark, d).select(STUDY, FEATURE, "p_brand"), [STUDY, FEATURE]).where("p_brand is not null")
    c = c.select(STUDY, F.col("p_brand").alias(FEATURE), SAMPLE, F.col("count").alias("psm"), (F.col("count") == 1).alias("mbr"))
    return op.aggregate_isoform_cells(c)


@query("select_feature", with_sql("one", f"SELECT 'raw' AS state, sample_id, {R('value - avg(value) OVER ()', 3)} AS \"offset\" FROM base WHERE feature_id = 'p7' UNION ALL SELECT 'log', sample_id, {R('log2(value) - avg(log2(value)) OVER ()')} FROM base WHERE feature_id = 'p7'", False))
def select_feature(spark, d):
    c = tb.cells(spark, d)
    t = op.select_feature({"raw": c, "log": c.withColumn("value", F.log2("value"))}, "p7")
    return t.select("state", SAMPLE, F.when(F.col("state") == "raw", rd("offset", 3)).otherwise(rd("offset", 6)).alias("offset"))
