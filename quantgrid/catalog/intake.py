"""Text scans, stores and integrity checks.

Scans read text that Spark has just written from the driver tables, so they cover every
row of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantgrid.catalog.base import R, query, rd, with_sql
from quantgrid.catalog.preparation import complete, normalized_log
from quantgrid.model import CELL_KEY, FEATURE, SAMPLE, STUDY, Study
from quantgrid.operators import checks as ck
from quantgrid.plans import testbed as tb
from quantgrid.session import materialise, shared_dir
from quantgrid.sources import store, text


def fresh(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/quantgrid/{uuid.uuid4().hex}/{name}"


def write_tsv(df, spark, name):
    path = fresh(spark, name)
    df.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
    return path


def wide_values(spark, d, prefix="Intensity_search_scan_file_id_"):
    """Feature by run, text cells, '0' where a run lacks the feature."""
    c = tb.base_cells(spark, d)
    runs = [f"r{i}" for i in range(tb.N_SAMPLES)]
    w = c.groupBy(FEATURE).pivot(SAMPLE, runs).agg(F.first("value"))
    return w.select(F.concat(F.lit("psvid_"), FEATURE).alias("Protein Groups"), *[F.coalesce(F.col(r).cast("string"), F.lit("0")).alias(f"{prefix}{i}") for i, r in enumerate(runs)])


def sheet(spark, d):
    return tb.samples(spark, d).withColumn("search_scan_file_id", F.col("seq_number").cast("string"))


_GRID = "grid AS (SELECT f.feature_id, s.sample_id, b.value, b.count FROM feat f JOIN smp s USING (study_id) LEFT JOIN base b USING (study_id, feature_id, sample_id))"
GRID = "WITH " + with_sql("one", "", False)[5:] + f", {_GRID} "


@query("scan_feature_table", GRID + f"SELECT 'psvid_' || feature_id AS feature_id, sample_id, {R('value', 4)} AS value, value IS NULL AS was_zero_token FROM grid")
def scan_feature_table(spark, d):
    path = write_tsv(wide_values(spark, d), spark, "features")
    cells, bad = text.read_feature_cells(spark, path, sheet(spark, d))
    ck.assert_empty(bad, "feature table")
    return cells.select(FEATURE, SAMPLE, rd("value", 4), "was_zero_token")


@query("scan_header", "SELECT count(*) AS n FROM (SELECT 'Protein Groups' AS c UNION SELECT DISTINCT 'r' || (l_suppkey % 8) FROM lineitem)")
def scan_header(spark, d):
    path = write_tsv(wide_values(spark, d), spark, "header")
    text.assert_unique_header(spark, path)
    return text.header_cells(spark, path).agg(F.count_distinct("name").alias("n"))


@query("scan_child_table", GRID + f"SELECT 'psvid_' || feature_id AS feature_id, sample_id, {R('value', 4)} AS value, CASE WHEN value IS NULL THEN 'NotDetected' WHEN count > 1 THEN 'MSMS' ELSE 'MBR' END AS detection_type FROM grid")
def scan_child_table(spark, d):
    c = tb.base_cells(spark, d)
    runs = [f"r{i}" for i in range(tb.N_SAMPLES)]
    kinds = c.groupBy(FEATURE).pivot(SAMPLE, runs).agg(F.first(F.when(F.col("count") > 1, "MSMS").otherwise("MBR")))
    kinds = kinds.select(F.concat(F.lit("psvid_"), FEATURE).alias("Protein Groups"), *[F.coalesce(F.col(r), F.lit("NotDetected")).alias(f"Detection Type_search_scan_file_id_{i}") for i, r in enumerate(runs)])
    wide = wide_values(spark, d).join(kinds, "Protein Groups").withColumn("Sequence", F.col("Protein Groups")).withColumn("Base Sequence", F.col("Protein Groups"))
    cells, bad = text.read_child_cells(spark, write_tsv(wide, spark, "children"), sheet(spark, d))
    ck.assert_empty(bad, "child table")
    return cells.select(FEATURE, SAMPLE, rd("value", 4), "detection_type")


@query("scan_count_dump", GRID + f"SELECT feature_id AS group_id, sample_id, coalesce(count * 1000, 0) AS psm, {R('coalesce(value, 0)', 4)} AS nsaf FROM grid")
def scan_count_dump(spark, d):
    """Counts with thousands separators and blanks, one labelled column family each."""
    c = tb.base_cells(spark, d)
    runs = [f"r{i}" for i in range(tb.N_SAMPLES)]
    shown = c.select(FEATURE, SAMPLE, F.format_number(F.col("count") * 1000, 0).alias("p"), F.col("value").cast("string").alias("q"))
    w = shown.groupBy(FEATURE).pivot(SAMPLE, runs).agg(F.first("p").alias("p"), F.first("q").alias("q"))
    cols = [F.coalesce(F.col(f"{r}_{k}"), F.lit("")).alias(f"{fam} (lab {r})") for r in runs for k, fam in (("p", "PSMs"), ("q", "NSAF"))]
    path = write_tsv(w.select(F.col(FEATURE).alias("Protein(s)"), *cols), spark, "dump")
    labels = tb.samples(spark, d).select(F.concat(F.lit("lab "), SAMPLE).alias("label"), SAMPLE)
    cells, _, bad = text.read_count_dump(spark, path, labels)
    ck.assert_empty(bad, "count dump")
    return cells.select("group_id", SAMPLE, "psm", rd("nsaf", 4))


@query("scan_localized_dump", GRID + "SELECT feature_id AS localized_sequence, sample_id, coalesce(count, 0) AS psm, coalesce(count = 1, false) AS mbr FROM grid")
def scan_localized_dump(spark, d):
    c = tb.base_cells(spark, d)
    runs = [f"r{i}" for i in range(tb.N_SAMPLES)]
    w = c.groupBy(FEATURE).pivot(SAMPLE, runs).agg(F.first(F.col("count").cast("string")).alias("p"), F.first(F.when(F.col("count") == 1, "(MBR)").otherwise("")).alias("m"))
    cols = [F.coalesce(F.col(f"{r}_{k}"), F.lit("")).alias(f"{fam} (lab {r})") for r in runs for k, fam in (("p", "PSMs"), ("m", "MBR"))]
    wide = w.select(F.col(FEATURE).alias("Peptide Sequence"), F.col(FEATURE).alias("Protein(s)"), F.lit("*").alias("Unique"), *cols)
    labels = tb.samples(spark, d).select(F.concat(F.lit("lab "), SAMPLE).alias("label"), SAMPLE)
    _, cells, bad = text.read_peptide_dump(spark, write_tsv(wide, spark, "localized"), labels)
    ck.assert_empty(bad, "localized dump")
    return cells.select("localized_sequence", SAMPLE, "psm", "mbr")


@query("parse_abundance_tokens", "SELECT event_type, count_if(tok = 'nan') AS n_nan, count_if(tok = 'zero') AS n_zero, count_if(tok = 'bad') AS n_bad, count_if(tok = 'ok') AS n_value FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'nan' WHEN event_id % 11 = 0 THEN 'zero' WHEN event_id % 13 = 0 THEN 'bad' ELSE CASE WHEN value > 0 THEN 'ok' ELSE 'zero' END END AS tok FROM events) GROUP BY ALL")
def parse_abundance_tokens(spark, d):
    e = tb.table(spark, d, "events")
    i = F.col("event_id")
    raw = F.when(i % 7 == 0, "NaN").when(i % 11 == 0, "0").when(i % 13 == 0, "-1.5").otherwise(F.col("value").cast("string"))
    p = text.parse_abundance(e.select("event_type", raw.alias("raw")))
    return p.groupBy("event_type").agg(F.count_if("was_nan_token").alias("n_nan"), F.count_if("was_zero_token").alias("n_zero"), F.count_if("bad_token").alias("n_bad"), F.count("value").alias("n_value"))


@query("parse_display_numbers", f"SELECT o_orderstatus, {R('sum(o_totalprice)', 2)} AS total, 0 AS n_bad FROM orders GROUP BY ALL")
def parse_display_numbers(spark, d):
    o = tb.table(spark, d, "orders").select("o_orderstatus", F.format_number("o_totalprice", 2).alias("shown"))
    p = text.parse_display_number(o, "shown", "price")
    return p.groupBy("o_orderstatus").agg(rd(F.sum("price"), 2, "total"), F.count_if("bad_price").cast("int").alias("n_bad"))


@query("parse_counts", "SELECT o_orderstatus, cast(sum(o_orderkey) AS bigint) AS total FROM orders GROUP BY ALL")
def parse_counts(spark, d):
    o = tb.table(spark, d, "orders").select("o_orderstatus", F.format_number("o_orderkey", 0).alias("shown"))
    return text.parse_count(o, "shown", "n").groupBy("o_orderstatus").agg(F.sum("n").alias("total"))


@query("read_samples", with_sql("one", "SELECT sample_id, batch, run_position_within_batch, condition FROM smp", False))
def read_samples(spark, d):
    s = sheet(spark, d).select(*text.SAMPLE_COLUMNS)
    return text.read_samples(spark, write_tsv(s, spark, "samples")).select("sample_id", "batch", "run_position_within_batch", "condition")


@query("read_mapping", "SELECT s_suppkey AS run_id, s_name || '.mzML' AS file, false AS bad FROM supplier")
def read_mapping(spark, d):
    s = tb.table(spark, d, "supplier").select(F.concat("s_suppkey", F.lit(" ("), "s_name", F.lit(".mzML)")).alias("e"))
    path = fresh(spark, "mapping")
    s.write.text(path)
    return text.read_mapping(spark, path).select("run_id", "file", "bad")


_RUN = "'X480_2021_05' || lpad(cast(s_nationkey + 1 AS varchar), 2, '0') || '_AZ_' || s_suppkey || '_AZ' || s_suppkey || '_AZ_c.mzML'"


def _runs(spark, d):
    s = tb.table(spark, d, "supplier")
    day = F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0")
    k = F.col("s_suppkey").cast("string")
    return s.select(F.concat(F.lit("X480_2021_05"), day, F.lit("_AZ_"), k, F.lit("_AZ"), k, F.lit("_AZ_c.mzML")).alias("file"))


@query("derive_design", f"""SELECT file, CAST(make_date(2021, 5, k + 1) AS varchar) AS acq_date, 'AZ' || s AS sample_id, 'P' || (s - 1 + s % 2) || '_' || (s + s % 2) AS candidate_pair, row_number() OVER (PARTITION BY k ORDER BY s) AS run_position_within_batch,
CASE WHEN row_number() OVER (PARTITION BY k ORDER BY s) <= ceil(count(*) OVER (PARTITION BY k) / 2) THEN 'early' ELSE 'late' END AS run_half FROM (SELECT {_RUN} AS file, s_nationkey AS k, s_suppkey AS s FROM supplier)""")
def derive_design(spark, d):
    return text.derive_design(_runs(spark, d)).select("file", F.col("acq_date").cast("string").alias("acq_date"), "sample_id", "candidate_pair", "run_position_within_batch", "run_half")


@query("pairing_check", "SELECT 'AZ' || s_suppkey AS sample_id, side FROM supplier CROSS JOIN (SELECT unnest(['left_only', 'right_only']) AS side) WHERE s_suppkey % 10 = 0")
def pairing_check(spark, d):
    derived = materialise(text.derive_design(_runs(spark, d)).select("sample_id", "candidate_pair", "file"))
    number = F.regexp_extract("sample_id", r"(\d+)", 1).cast("int")
    stored = derived.withColumn("candidate_pair", F.when(number % 10 == 0, "P_wrong").otherwise(F.col("candidate_pair")))
    return ck.check_pairing(stored, derived).select("sample_id", "side")


# --- stores -------------------------------------------------------------------------------


@query("save_load_state", with_sql("one", f"SELECT study_id, feature_id, sample_id, {R('value')} AS value, 'log2' AS scale FROM nlog"))
def save_load_state(spark, d):
    from quantgrid.model import scale_of

    path = fresh(spark, "state")
    cells = normalized_log(spark, d)
    store.save_state(Study(cells, tb.features(spark, d), tb.samples(spark, d)), path)
    back = store.load_state(spark, path)
    return back.cells.select(*CELL_KEY, rd("value"), F.lit(scale_of(back.cells)).alias("scale"))


@query("result_store", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def result_store(spark, d):
    root = fresh(spark, "results")
    counts = tb.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    for seed in (1, 2):
        store.save_result(counts.withColumn("n", F.col("n") * (3 - 2 * (seed % 2))), root, "tally", store.fingerprint("tally", "v1", {"by": "l_returnflag"}, seed))
    return store.load_result(spark, root, "tally", store.fingerprint("tally", "v1", {"by": "l_returnflag"}, 1))


@query("data_version")
def data_version(spark, d):
    return store.data_version(spark, {n: f"{d}/{n}.parquet" for n in ("lineitem", "part")})


@query("table_version")
def table_version(spark, d):
    return store.table_version(tb.table(spark, d, "lineitem"), ["l_returnflag"])


@query("write_tables", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def write_tables(spark, d):
    c, n = tb.table(spark, d, "customer"), tb.table(spark, d, "nation")
    t = c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    out = fresh(spark, "tables")
    store.write_tables({"nations": t}, out)
    return text.read_wide(spark, f"{out}/nations", check_header=False).select("n_name", F.col("n").cast("bigint").alias("n"))


# --- checks -------------------------------------------------------------------------------


@query("check_unique", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def check_unique(spark, d):
    return ck.check_unique(tb.table(spark, d, "lineitem"), ["l_orderkey"])


@query("check_bijection", "SELECT k, 'left_only' AS side FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'right_only' FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer)")
def check_bijection(spark, d):
    return ck.check_bijection(tb.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), tb.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("check_cells", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'blank' WHEN event_id % 7 = 0 THEN 'not a number' WHEN event_id % 11 = 0 THEN 'negative' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY ALL")
def check_cells(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, " ").when(i % 7 == 0, "x1").when(i % 11 == 0, "-2").when(i % 13 == 0, "NaN").otherwise("3.5")
    return ck.check_cells(tb.table(spark, d, "events").select(raw.alias("raw"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("check_domain", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY ALL")
def check_domain(spark, d):
    return ck.check_domain(tb.table(spark, d, "events"), "event_type", ["click", "view"])


@query("check_invariant", "SELECT doc_id FROM documents WHERE n_chars <> length(text) OR n_chars > 5000")
def check_invariant(spark, d):
    return ck.check_invariant(tb.table(spark, d, "documents"), (F.col("n_chars") == F.length("text")) & (F.col("n_chars") <= 5000)).select("doc_id")


@query("check_suite", "SELECT 'orders_unique' AS name, true AS passed, 0 AS n_violations UNION ALL SELECT 'lines_unique', false, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'sizes', (SELECT count(*) FROM part WHERE p_size < 1) = 0, (SELECT count(*) FROM part WHERE p_size < 1)")
def check_suite(spark, d):
    t = ck.run_checks({
        "orders_unique": ck.check_unique(tb.table(spark, d, "orders"), ["o_orderkey"]),
        "lines_unique": ck.check_unique(tb.table(spark, d, "lineitem"), ["l_orderkey"]),
        "sizes": ck.check_invariant(tb.table(spark, d, "part"), F.col("p_size") >= 1),
    })
    return t.select("name", "passed", "n_violations")


@query("check_family_ids", "SELECT run_id, reason FROM (SELECT cast(l_suppkey AS varchar) AS run_id, 'repeated' AS reason FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT cast(s_suppkey AS varchar), 'right_only' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem) UNION ALL SELECT DISTINCT cast(l_suppkey AS varchar), 'left_only' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def check_family_ids(spark, d):
    return ck.check_family_ids(tb.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id")), tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("run_id")))


@query("tally", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def tally(spark, d):
    return ck.tally(tb.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("check_crosstab", "SELECT lang, source, count(*) AS found, 0 AS expected FROM documents WHERE lang <> 'en' GROUP BY ALL")
def check_crosstab(spark, d):
    docs = tb.table(spark, d, "documents")
    stored = ck.tally(docs.where("lang = 'en'"), ["lang", "source"])
    return ck.check_crosstab(stored, docs, "lang", "source")


def _two_parses(spark, d):
    a = complete(spark, d)
    b = a.withColumn("value", F.when(F.col(SAMPLE) == "r3", F.col("value") * (1 + 1e-6)).otherwise(F.col("value")))
    return a, b


@query("reconcile_cells", with_sql("one", "SELECT study_id, feature_id, sample_id FROM comp WHERE sample_id = 'r3'", True, False))
def reconcile_cells(spark, d):
    a, b = _two_parses(spark, d)
    return ck.reconcile(a, b, CELL_KEY, ["value"], 1e-9).select(*CELL_KEY)


@query("reconcile_report", with_sql("one", "SELECT study_id, sample_id, count(*) AS n_compared, count_if(sample_id = 'r3') AS n_mismatch, 0 AS n_one_sided FROM comp GROUP BY ALL", True, False))
def reconcile_report(spark, d):
    a, b = _two_parses(spark, d)
    return ck.reconcile_report(a, b, CELL_KEY, "value", 1e-9, [STUDY, SAMPLE])


@query("reconcile_sample", "SELECT 200 AS n, true AS all_match")
def reconcile_sample(spark, d):
    a, _ = _two_parses(spark, d)
    t = ck.reconcile_sample(a, a, CELL_KEY, "value", 200, 11)
    return t.agg(F.count(F.lit(1)).alias("n"), F.bool_and("match").alias("all_match"))


@query("reconcile_totals", with_sql("one", "SELECT DISTINCT study_id, sample_id FROM comp WHERE sample_id = 'r3'", True, False))
def reconcile_totals(spark, d):
    return ck.reconcile_totals(*_two_parses(spark, d)).select(STUDY, SAMPLE)


@query("check_shape", with_sql("flag", "SELECT study_id, count(DISTINCT feature_id) AS found_features, count(DISTINCT sample_id) AS found_samples, count(*) AS found_cells FROM base GROUP BY ALL", False))
def check_shape(spark, d):
    """The sparse studies have all ids but not all cells, so each is reported."""
    c = tb.base_cells(spark, d, "flag")
    e = c.groupBy(STUDY).agg(F.count_distinct(FEATURE).alias("n_features"), F.count_distinct(SAMPLE).alias("n_samples"))
    return ck.check_shape(c, e).select(STUDY, "found_features", "found_samples", "found_cells")


@query("check_counts", "SELECT 'part' AS name, (SELECT count(*) FROM part) AS found, 1 AS expected UNION ALL SELECT 'ghost', 0, 5")
def check_counts(spark, d):
    parts = [tb.table(spark, d, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in ("part", "region")]
    found = parts[0].unionByName(parts[1])
    region = tb.table(spark, d, "region").agg(F.lit("region").alias("name"), F.count(F.lit(1)).alias("n"))
    rest = found.sparkSession.createDataFrame([("part", 1), ("ghost", 5)], "name string, n bigint")
    return ck.check_counts(found, region.unionByName(rest)).select("name", "found", "expected")


@query("check_against_baseline", with_sql("one", "SELECT study_id, feature_id FROM comp WHERE sample_id = 'r3'", True, False))
def check_against_baseline(spark, d):
    a, b = _two_parses(spark, d)
    total = lambda c: c.groupBy(STUDY, FEATURE).agg(F.max(F.when(F.col(SAMPLE) == "r3", F.col("value"))).alias("p"), F.max(F.when(F.col(SAMPLE) == "r2", F.col("value"))).alias("q"))
    return ck.check_against(total(a), total(b), [STUDY, FEATURE], ["p", "q"]).select(STUDY, FEATURE)


@query("check_inputs", with_sql("one", "SELECT 'complete' AS state, count(*) AS n FROM (SELECT study_id, feature_id FROM feat ANTI JOIN comp USING (study_id, feature_id))", True, False))
def check_inputs(spark, d):
    t = ck.check_inputs({"raw": tb.cells(spark, d), "complete": complete(spark, d)}, "linear")
    return t.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("check_summary", "SELECT l_returnflag FROM lineitem GROUP BY ALL HAVING count(*) > 0 AND l_returnflag = 'R'")
def check_summary(spark, d):
    s = tb.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean_quantity"))
    published = s.withColumn("mean_quantity", F.when(F.col("l_returnflag") == "R", F.col("mean_quantity") + 0.5).otherwise(F.col("mean_quantity")))
    return ck.check_summary(s, published, ["l_returnflag"], ["mean_quantity"], 1e-3).select("l_returnflag")


@query("max_difference", with_sql("one", "SELECT 'value' AS \"column\", 0 AS n_one_sided, round(max(value) * 1e-6, 6) + 0.0 AS max_abs_diff, round(1e-6 / (1 + 1e-6), 9) + 0.0 AS max_rel_diff FROM comp WHERE sample_id = 'r3'", True, False))
def max_difference(spark, d):
    t = ck.max_diff(*_two_parses(spark, d), CELL_KEY, ["value"])
    return t.select("column", "n_one_sided", rd("max_abs_diff"), rd("max_rel_diff", 9))
