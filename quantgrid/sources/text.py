"""Scans of wide text tables and their parsing into cells.

Every reader returns lazy DataFrames. Problems in the data are not repaired: each parse
comes with a violations DataFrame, to be handed to ``checks.assert_empty``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantgrid.model import SAMPLE, STUDY, CheckFailed
from quantgrid.operators.checks import assert_empty

#: Files whose first lines are read at a time.
HEADER_READS = 32

# What a sample sheet must carry.
SAMPLE_COLUMNS = (
    "sample_id",
    "search_scan_file_id",
    "batch",
    "run_position_within_batch",
    "condition",
)

# Detection types and whether a cell of that type carries a value.
DETECTED_TYPES = ("MSMS", "MBR")
UNDETECTED_TYPES = ("NotDetected", "MSMSIdentifiedButNotQuantified", "MSMSAmbiguousPeakfinding")


def named(column: str) -> Column:
    """A column by literal name (headers contain dots, blanks and parentheses)."""
    return F.col("`" + column.replace("`", "``") + "`")


def first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of one file, by a short read through the file system that Spark reads it with; None if it is empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


def _first_header(spark: SparkSession, files: Sequence[str]) -> str | None:
    return next((line for f in files if (line := first_line(spark, f)) is not None), None)


def header_cells(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """The header as ``position, name``; of several files the one that is listed first."""
    line = _first_header(spark, spark.read.text(path).inputFiles())
    return spark.createDataFrame(list(enumerate([] if line is None else line.split(sep))), "position int, name string")


def assert_unique_header(spark: SparkSession, path: str, sep: str = "\t") -> None:
    """Refuse blank or repeated header names before the CSV reader renames them.

    And files whose headers differ, as columns are assigned by position. One short read a file, no scan.
    """
    files = spark.read.text(path).inputFiles()
    line = _first_header(spark, files)
    if line is None:
        return
    with ThreadPoolExecutor(HEADER_READS) as pool:
        other = pool.map(lambda f: f if first_line(spark, f) not in (line, None) else None, files)
        wrong = next((f for f in other if f), None)
    if wrong:
        raise CheckFailed(f"header of {wrong} is unlike that of another file in {path}")
    names = sorted(n for n, k in Counter(line.split(sep)).items() if k > 1 or not n.strip())
    if names:
        raise CheckFailed(f"header of {path}: blank or repeated names {names[:10]}")


def read_wide(spark: SparkSession, path: str, sep: str = "\t", check_header: bool = True) -> DataFrame:
    """Scan a delimited table with every cell as text; a blank cell is ``''``, not NULL.

    Columns are assigned by position: a file whose header differs from another's is refused, here or,
    without ``check_header``, by the scan that meets it.
    """
    if check_header:
        assert_unique_header(spark, path, sep)
    raw = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("quote", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return raw.select(*[F.coalesce(named(c), F.lit("")).alias(c) for c in raw.columns])


def in_study(df: DataFrame, study: str | None) -> DataFrame:
    """``df`` with ``study_id`` in front, if a study is named."""
    return df if study is None else df.select(F.lit(study).alias(STUDY), "*")


def of_study(df: DataFrame, study: str | None) -> DataFrame:
    """The rows of ``study``, where both are given."""
    return df if study is None or STUDY not in df.columns else df.where(F.col(STUDY) == study)


def family_columns(columns: Sequence[str], pattern: str) -> dict[str, str]:
    """``{captured id: column}`` for the columns that match a one-group pattern."""
    found: dict[str, str] = {}
    for column in columns:
        m = re.fullmatch(pattern, column)
        if m:
            if m.group(1) in found:
                raise CheckFailed(f"two columns carry id {m.group(1)!r} of family {pattern!r}")
            found[m.group(1)] = column
    return found


def melt(
    df: DataFrame, id_columns: Sequence[str], families: Mapping[str, str], key: str = "run_id"
) -> DataFrame:
    """Unpivot aligned column families in one scan: one row per id and run.

    ``families`` maps each output measure to a pattern with one group, the run id. All
    families must cover the same runs.
    """
    found = {m: family_columns(df.columns, p) for m, p in families.items()}
    runs = {m: set(ids) for m, ids in found.items()}
    expected = next(iter(runs.values()))
    for measure, ids in runs.items():
        if not ids or ids != expected:
            raise CheckFailed(f"family {measure!r} covers runs {sorted(ids)}, expected {sorted(expected)}")
    rows = [
        F.struct(F.lit(run).alias(key), *[named(found[m][run]).alias(m) for m in families])
        for run in sorted(expected)
    ]
    ids = [named(c).alias(c) for c in id_columns]
    out = df.select(*ids, F.explode(F.array(*rows)).alias("_cell"))
    return out.select(*[named(c) for c in id_columns], f"_cell.{key}", *[f"_cell.{m}" for m in families])


def melt_labelled(
    df: DataFrame, id_columns: Sequence[str], families: Mapping[str, str], key: str = "label"
) -> DataFrame:
    """As ``melt`` for headers of the form ``family (label)``."""
    patterns = {m: re.escape(name) + r" \((.+)\)" for m, name in families.items()}
    return melt(df, id_columns, patterns, key)


def parse_abundance(df: DataFrame, raw: str = "raw", nan_token: str | None = "NaN") -> DataFrame:
    """Add ``value, was_zero_token, was_nan_token, bad_token`` from a text column.

    Zero and the NaN token both mean "not quantified" and become NULL with their
    provenance kept. Other text, and negatives, are marked in ``bad_token``. With
    ``nan_token=None`` no such token is documented and it is bad too.
    """
    text = F.trim(F.col(raw))
    is_nan = F.lit(False) if nan_token is None else text == nan_token
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    number = F.when(plain, text.try_cast("double"))
    positive = (number > 0) & (number < float("inf"))
    return df.withColumns(
        {
            "value": F.when(positive, number),
            "was_zero_token": F.coalesce(number == 0, F.lit(False)),
            "was_nan_token": is_nan,
            "bad_token": ~(is_nan | F.coalesce(number >= 0, F.lit(False))),
        }
    )


def parse_display_number(
    df: DataFrame, raw: str, name: str, missing_tokens: Sequence[str] = ()
) -> DataFrame:
    """Add ``name`` and ``bad_<name>``: thousands separators dropped, blank is 0."""
    text = F.trim(F.col(raw))
    is_missing = text.isin(list(missing_tokens)) if missing_tokens else F.lit(False)
    grouped = text.rlike(r"^[+-]?(\d{1,3}(,\d{3})+|\d+)?(\.\d*)?([eE][+-]?\d+)?$")
    number = F.when(text == "", F.lit(0.0)).when(
        grouped, F.regexp_replace(text, ",", "").try_cast("double")
    )
    return df.withColumns(
        {name: F.when(~is_missing, number), f"bad_{name}": ~is_missing & number.isNull()}
    )


def parse_count(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Add ``name`` (BIGINT) and ``bad_<name>``: ``1,234`` is 1234, blank is 0."""
    text = F.trim(F.col(raw))
    shaped = text.rlike(r"^(\d{1,3}(,\d{3})+|\d+)$")
    number = F.when(text == "", F.lit(0)).when(shaped, F.regexp_replace(text, ",", "").try_cast("bigint"))
    return df.withColumns({name: number.cast("bigint"), f"bad_{name}": number.isNull()})


def read_samples(spark: SparkSession, path: str, sep: str = "\t", study: str | None = None) -> DataFrame:
    """Sample sheet in acquisition order; required columns and unique ids are enforced.

    A sheet of several studies names them in ``study_id``; ids are unique within each. ``study`` names the only one.
    """
    sheet = in_study(read_wide(spark, path, sep), study)
    own = [STUDY] if STUDY in sheet.columns else []
    absent = [c for c in SAMPLE_COLUMNS if c not in sheet.columns]
    if absent:
        raise CheckFailed(f"{path} lacks columns {absent}")
    for key in ("sample_id", "search_scan_file_id"):
        repeated = sheet.groupBy(*own, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        assert_empty(repeated, f"repeated {key} in {path}")
    position = F.col("run_position_within_batch").try_cast("int")
    assert_empty(sheet.where(position.isNull()), f"run position in {path}")
    return sheet.withColumn("run_position_within_batch", position).orderBy(
        *own, "batch", "run_position_within_batch"
    )


def read_mapping(spark: SparkSession, path: str, study: str | None = None) -> DataFrame:
    """``run_id, file`` from lines like ``1 (fileA), 2 (fileB)``; ``bad`` marks other text. ``study`` goes in front."""
    entries = spark.read.text(path).select(
        F.explode(F.split(F.trim("value"), r"\s*,\s*")).alias("entry")
    )
    pattern = r"^(\d+) \((.+)\)$"
    parsed = entries.select(
        "entry",
        F.regexp_extract("entry", pattern, 1).try_cast("bigint").alias("run_id"),
        F.nullif(F.regexp_extract("entry", pattern, 2), F.lit("")).alias("file"),
        (~F.col("entry").rlike(pattern)).alias("bad"),
    )
    return in_study(parsed, study)


# Fixed value: how a run name encodes date, sequence number and sample.
RUN_NAME = r"^[^_]+_(\d{4})_(\d{4})_[A-Z]+_(\d+)_([A-Z]+(\d+))_.*$"


def derive_design(runs: DataFrame, name: str = "file", pattern: str = RUN_NAME) -> DataFrame:
    """Add date, batch, sequence, sample, pair, run position and half to run names.

    An odd sample number opens the pair (n, n + 1); the first ceil(n / 2) positions of a
    batch are early. A name without the pattern, or with no such date, has NULL
    ``acq_date``; keep those out with ``design_violations``.
    """
    part = lambda i: F.regexp_extract(name, pattern, i)
    number = part(5).try_cast("int")
    low = F.when(number % 2 == 1, number).otherwise(number - 1)
    day = F.try_to_timestamp(F.concat(part(1), part(2)), F.lit("yyyyMMdd")).cast("date")
    named_runs = runs.withColumns(
        {
            "acq_date": day,
            "seq_number": part(3).try_cast("int"),
            "sample_id": F.nullif(part(4), F.lit("")),
            "sample_number": number,
            "candidate_pair": F.concat(F.lit("P"), low, F.lit("_"), low + 1),
        }
    ).withColumn("batch", F.concat(F.lit("B"), F.col("acq_date").cast("string")))
    keys = ["study_id", "batch"] if "study_id" in runs.columns else ["batch"]  # two studies may share a date
    return add_run_half(with_run_position(named_runs, "seq_number", keys), keys)


def with_run_position(runs: DataFrame, order: str, keys: Sequence[str] = ("batch",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return runs.withColumn("run_position_within_batch", F.row_number().over(w))


def add_run_half(runs: DataFrame, keys: Sequence[str] = ("batch",)) -> DataFrame:
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    early = F.col("run_position_within_batch") <= F.ceil(size / 2)
    return runs.withColumn("run_half", F.when(early, "early").otherwise("late"))


def design_violations(design: DataFrame, name: str = "file", pattern: str = RUN_NAME) -> DataFrame:
    """Run names off the pattern or with an impossible date."""
    shaped = F.col(name).rlike(pattern)
    reason = F.when(~shaped, "pattern").when(F.col("acq_date").isNull(), "date")
    return design.select(name, reason.alias("reason")).where(F.col("reason").isNotNull())


def read_feature_cells(spark: SparkSession, path: str, samples: DataFrame, study: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Feature-level intensities as cells; returns ``(cells, violations)``.

    With ``study`` all results of a reader carry it as ``study_id``; samples and labels are then those of that study,
    where their table has the column.
    """
    wide = read_wide(spark, path)
    long = melt(wide, ["Protein Groups"], {"raw": r"Intensity_search_scan_file_id_(\d+)"}, "search_scan_file_id")
    cells = _to_samples(parse_abundance(long), of_study(samples, study)).withColumnRenamed("Protein Groups", "feature_id")
    keep = cells.select("feature_id", SAMPLE, "value", "was_zero_token", "was_nan_token")
    return in_study(keep, study), in_study(cells.where("bad_token or sample_id is null or trim(feature_id) = ''"), study)


def read_child_cells(spark: SparkSession, path: str, samples: DataFrame, study: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Child-level intensities with detection types; returns ``(cells, violations)``.

    No NaN token is documented for this table. A positive value needs a detected type and
    a zero needs an undetected one.
    """
    wide = read_wide(spark, path)
    ids = ["Sequence", "Base Sequence", "Protein Groups"]
    families = {
        "raw": r"Intensity_search_scan_file_id_(\d+)",
        "detection_type": r"Detection Type_search_scan_file_id_(\d+)",
    }
    long = melt(wide, ids, families, "search_scan_file_id")
    cells = _to_samples(parse_abundance(long, nan_token=None), of_study(samples, study))
    cells = cells.withColumnsRenamed(
        {"Sequence": "feature_id", "Base Sequence": "base_sequence", "Protein Groups": "parents"}
    )
    keep = cells.select("feature_id", "base_sequence", "parents", SAMPLE, "value", "detection_type")
    bad = cells.where(F.col("bad_token") | F.col(SAMPLE).isNull() | detection_conflict())
    return in_study(keep, study), in_study(bad, study)


def detection_conflict(value: str = "value", kind: str = "detection_type") -> Column:
    """True where a type is unknown or disagrees with the presence of a value."""
    known = F.col(kind).isin(*DETECTED_TYPES, *UNDETECTED_TYPES)
    return ~known | (F.col(value).isNotNull() != F.col(kind).isin(*DETECTED_TYPES))


def _to_samples(cells: DataFrame, samples: DataFrame, key: str = "search_scan_file_id") -> DataFrame:
    return cells.join(samples.select(F.col(key).cast("string").alias(key), SAMPLE), key, "left")


def read_count_dump(spark: SparkSession, path: str, label_map: DataFrame, study: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Group-level counts and fractions; returns ``(cells, members, violations)``."""
    wide, label_map = read_wide(spark, path), of_study(label_map, study)
    long = melt_labelled(wide, ["Protein(s)"], {"psm_raw": "PSMs", "nsaf_raw": "NSAF"})
    long = parse_display_number(parse_count(long, "psm_raw", "psm"), "nsaf_raw", "nsaf")
    named_cells = long.withColumnRenamed("Protein(s)", "group_id").join(
        label_map.select("label", SAMPLE), "label", "left"
    )
    members = wide.select(
        named("Protein(s)").alias("group_id"), F.split(named("Protein(s)"), ",").alias("members")
    )
    bad = named_cells.where(F.col("bad_psm") | F.col("bad_nsaf") | F.col(SAMPLE).isNull())
    return tuple(in_study(t, study) for t in (named_cells.select("group_id", SAMPLE, "psm", "nsaf"), members, bad))


def read_peptide_dump(spark: SparkSession, path: str, label_map: DataFrame, study: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Localized child rows; returns ``(rows, cells, violations)``.

    The labels of the file and of ``label_map`` must be the same set, one sample each.
    """
    wide, label_map = read_wide(spark, path), of_study(label_map, study)
    rows = wide.select(
        named("Peptide Sequence").alias("localized_sequence"),
        named("Protein(s)").alias("proteins"),
        (F.trim(named("Unique")) == "*").alias("unique"),
    )
    long = melt_labelled(wide, ["Peptide Sequence"], {"psm_raw": "PSMs", "mbr_raw": "MBR"})
    labels = long.select("label").distinct()
    assert_empty(label_map.join(labels, "label", "left_anti"), f"mapped labels absent from {path}")
    repeated = label_map.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    assert_empty(repeated, "labels that share a sample")
    cells = (
        parse_count(long, "psm_raw", "psm")
        .withColumnRenamed("Peptide Sequence", "localized_sequence")
        .withColumn("mbr", F.trim("mbr_raw") == "(MBR)")
        .join(label_map.select("label", SAMPLE), "label", "left")
    )
    bad_flag = ~F.trim("mbr_raw").isin("", "(MBR)")
    bad = cells.where(F.col("bad_psm") | bad_flag | F.col(SAMPLE).isNull())
    return tuple(in_study(t, study) for t in (rows, cells.select("localized_sequence", SAMPLE, "psm", "mbr"), bad))
