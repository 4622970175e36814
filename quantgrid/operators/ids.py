"""Identifier parsing, group members, label resolution and modification masses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantgrid.model import FEATURE, SAMPLE, STUDY
from quantgrid.operators.checks import check_bijection
from quantgrid.operators.matrix import match_counts

# Id patterns.
PROTEIN_ID = r"^psvid_(\d+)_sp\|([^|]*)\|([^|]*)$"
PEPTIDE_ID = r"^([A-Z]+)\[([+-][0-9.]+)\]$"
LOCALIZED = r"^([A-Z](\[[0-9.]+\])?)+$"
LOCALIZED_TOKEN = r"([A-Z])(?:\[([0-9.]+)\])?"
NO_ACCESSION = r"^sp\|[^|]+\|$"

# Monoisotopic element masses, the adduct's formula and known mass shifts.
ELEMENT_MASS = {
    "C": 12.0,
    "H": 1.00782503207,
    "N": 14.0030740048,
    "O": 15.99491461956,
    "S": 31.97207100,
}
ADDUCT_FORMULA = {"C": 28, "H": 27, "N": 1, "O": 4, "S": 1}
CAM_DELTA = 57.021464
OX_DELTA = 15.994915
MAX_CAM, MAX_OX, MAX_ADDUCT = 10, 6, 4
MASS_TOLERANCE = 0.001
DISPLAY_TOLERANCE = 0.006

# The adduct attaches whole and loses two hydrogens.
ADDUCT_DELTA = sum(ELEMENT_MASS[e] * n for e, n in ADDUCT_FORMULA.items()) - 2 * ELEMENT_MASS["H"]
MOD_DELTAS = {"CAM": CAM_DELTA, "Ox": OX_DELTA, "Adduct": ADDUCT_DELTA}


def parse_protein_id(df: DataFrame, column: str) -> DataFrame:
    """Add ``group_number, accession, entry, is_candidate, bad_id``.

    ``psvid_7_sp|P1|X_HUMAN`` has an accession; in ``psvid_7_sp|X_HUMAN|`` the middle part
    is the entry, the form a contaminant candidate has.
    """
    middle, last = F.regexp_extract(column, PROTEIN_ID, 2), F.regexp_extract(column, PROTEIN_ID, 3)
    shaped = F.col(column).rlike(PROTEIN_ID) & (middle != "")
    bare = last == ""
    return df.withColumns(
        {
            "group_number": F.when(shaped, F.regexp_extract(column, PROTEIN_ID, 1).try_cast("bigint")),
            "accession": F.when(shaped & ~bare, middle),
            "entry": F.when(shaped, F.when(bare, middle).otherwise(last)),
            "is_candidate": F.coalesce(shaped & bare, F.lit(False)),
            "bad_id": ~F.coalesce(shaped, F.lit(False)),
        }
    )


def accession_key(column: str) -> Column:
    """The id without its numbered prefix: what a dump's first member is written as."""
    return F.regexp_replace(column, r"^psvid_\d+_", "")


def refine_contaminants(features: DataFrame, groups: DataFrame, key: str = "accession_key") -> tuple[DataFrame, DataFrame]:
    """Keep a candidate as contaminant only if no later group member has an accession.

    ``groups`` has ``members ARRAY<STRING>``; its first member equals the feature's key.
    Returns features with ``is_contaminant, grouped_with_real`` and the candidates that
    have no group.
    """
    by_first = groups.select(F.col("members")[0].alias(key), F.col("members").alias("_members"))
    joined = features.join(by_first, key, "left")
    later = F.slice("_members", F.lit(2), F.greatest(F.size("_members"), F.lit(1)))
    real = F.exists(later, lambda m: ~m.rlike(NO_ACCESSION))
    sibling = F.col("is_candidate") & F.coalesce(real, F.lit(False))
    refined = joined.withColumns(
        {"is_contaminant": F.col("is_candidate") & ~sibling, "grouped_with_real": sibling}
    )
    lost = joined.where(F.col("is_candidate") & F.col("_members").isNull()).select(features["*"])
    return refined.drop("_members"), lost


def parse_peptide_id(df: DataFrame, column: str, base: str) -> DataFrame:
    """Add ``parsed_base, total_mod_mass, bad_id`` from ``BASE[+mass]``."""
    shaped = F.col(column).rlike(PEPTIDE_ID)
    parsed = F.regexp_extract(column, PEPTIDE_ID, 1)
    mass = F.regexp_extract(column, PEPTIDE_ID, 2).try_cast("double")
    return df.withColumns(
        {
            "parsed_base": F.when(shaped, parsed),
            "total_mod_mass": F.when(shaped, mass),
            "bad_id": ~F.coalesce(shaped & mass.isNotNull() & (parsed == F.col(base)), F.lit(False)),
        }
    )


def explode_members(df: DataFrame, column: str, sep: str = ";", name: str = "member") -> DataFrame:
    """One row per listed member with its 0-based position."""
    parts = F.split(F.col(column), sep) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.select("*", F.posexplode(parts).alias("member_position", name))


def flag_any_member(features: DataFrame, flagged: DataFrame, keys: Sequence[str], members: str, sep: str = ";", name: str = "is_contaminant") -> DataFrame:
    """Flag a feature when any of its members is in ``flagged`` (column ``member``)."""
    hit = (
        explode_members(features.select(*keys, members), members, sep)
        .join(flagged.select("member").distinct(), "member", "left_semi")
        .select(*keys)
        .distinct()
        .withColumn(name, F.lit(True))
    )
    return features.join(hit, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def align_first_member(counts: DataFrame, features: DataFrame, members: str = "members", key: str = "accession_key") -> tuple[DataFrame, DataFrame]:
    """Join count rows to features by first member; also the keys found on one side only."""
    first = counts.withColumn(key, F.col(members)[0])
    return first.join(features, key), check_bijection(first, features, [key])


def sig_figs(column: Column, n: int = 3) -> Column:
    """Round half-even to ``n`` significant figures; zero stays zero."""
    size = F.abs(column)
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.when(size > 0, size))) - (n - 1))
    return F.when(column == 0, F.lit(0.0)).otherwise(F.bround(column / power, 0) * power)


def label_scores(unlabelled: DataFrame, reference: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """Share of features whose labelled value equals a sample's value at 3 figures.

    ``unlabelled``: study, feature, ``label``, value; ``reference``: cells where a true zero
    is kept as 0. Each feature's values look themselves up among its sorted references inside a task; only counts for
    label and sample are shuffled beside the cells.
    """
    ref = reference.select(STUDY, FEATURE, SAMPLE, sig_figs(F.col("value")).alias("value"))
    counts = match_counts(unlabelled, ref, "label", 1e-8, rtol)
    return counts.select(STUDY, "label", SAMPLE, (F.col("n_match") / F.col("n")).alias("match_fraction"), "n")


def resolve_labels(unlabelled: DataFrame, reference: DataFrame, accept: float = 0.999, rival: float = 0.9) -> DataFrame:
    """Best sample per label with ``match_fraction, second_best, resolved``.

    A label is resolved when its best share reaches ``accept``, the runner-up stays at or
    below ``rival`` and no other label claims the same sample.
    """
    scores = label_scores(unlabelled, reference)
    w = Window.partitionBy(STUDY, "label").orderBy(F.col("match_fraction").desc(), SAMPLE)
    top = scores.withColumn("_rn", F.row_number().over(w)).withColumn(
        "second_best", F.lead("match_fraction").over(w)
    ).where("_rn = 1")
    claims = F.count(F.lit(1)).over(Window.partitionBy(STUDY, SAMPLE))
    good = (F.col("match_fraction") >= accept) & (F.coalesce("second_best", F.lit(0.0)) <= rival) & (claims == 1)
    return top.select(STUDY, "label", SAMPLE, "match_fraction", "second_best", good.alias("resolved"))


def check_label_map(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """Labels whose stored sample differs, or that only one side has."""
    both = resolved.select(STUDY, "label", F.col(SAMPLE).alias("resolved_sample")).join(
        stored.select(STUDY, "label", F.col(SAMPLE).alias("stored_sample")), [STUDY, "label"], "full_outer"
    )
    return both.where(~F.col("resolved_sample").eqNullSafe(F.col("stored_sample")))


def counts_to_cells(counts: DataFrame, measure: str, flags: DataFrame | None = None) -> DataFrame:
    """A count or fraction column as cells: 0 is missing; feature flags joined if given."""
    cells = counts.withColumn("value", F.nullif(F.col(measure).cast("double"), F.lit(0.0)))
    return cells if flags is None else cells.join(flags, [STUDY, FEATURE], "left")


def formula_mass(formulas: DataFrame, key: str = "formula") -> DataFrame:
    """Monoisotopic mass of formulas such as ``C28H27NO4S``; ``bad_formula`` otherwise."""
    atoms = formulas.select(
        key, F.explode(F.regexp_extract_all(key, F.lit(r"([A-Z][a-z]?\d*)"), F.lit(1))).alias("atom")
    )
    symbol = F.regexp_extract("atom", r"^([A-Z][a-z]?)", 1)
    amount = F.coalesce(F.regexp_extract("atom", r"(\d+)$", 1).try_cast("int"), F.lit(1))
    mass = F.create_map(*[x for e, m in ELEMENT_MASS.items() for x in (F.lit(e), F.lit(m))])
    weighed = atoms.select(key, amount.alias("n"), F.try_element_at(mass, symbol).alias("unit"))
    shaped = F.first(F.col(key).rlike(r"^([A-Z][a-z]?\d*)+$"))
    known = (F.count_if(F.col("unit").isNull()) == 0) & shaped
    summed = weighed.groupBy(key).agg(
        F.when(known, F.sum(F.col("n") * F.col("unit"))).alias("mass"), (~known).alias("bad_formula")
    )
    return formulas.join(summed, key, "left")


def compositions(spark: SparkSession) -> DataFrame:
    """All (CAM, Ox, adduct) counts within their limits with their summed mass; 385 rows."""
    n = spark.range((MAX_CAM + 1) * (MAX_OX + 1) * (MAX_ADDUCT + 1))
    ox_adduct = (MAX_OX + 1) * (MAX_ADDUCT + 1)
    rows = n.select(
        F.floor(F.col("id") / ox_adduct).cast("int").alias("n_cam"),
        F.floor((F.col("id") % ox_adduct) / (MAX_ADDUCT + 1)).cast("int").alias("n_ox"),
        (F.col("id") % (MAX_ADDUCT + 1)).cast("int").alias("n_adduct"),
    )
    mass = F.col("n_cam") * CAM_DELTA + F.col("n_ox") * OX_DELTA + F.col("n_adduct") * ADDUCT_DELTA
    return rows.withColumn("mass", mass)


def decompose_mass(features: DataFrame, mass: str = "total_mod_mass", tolerance: float = MASS_TOLERANCE) -> DataFrame:
    """Add the unique composition that explains each mass, or why there is none.

    The range join is an equi-join on mass buckets of the tolerance's width (a composition
    enters its own and both neighbouring buckets), over distinct masses only.
    """
    spark = features.sparkSession
    bucket = lambda c: F.floor(c / (2 * tolerance)).cast("long")
    distinct = features.where(F.col(mass).isNotNull()).select(F.col(mass).alias("_m")).distinct()
    options = compositions(spark).withColumn(
        "_b", F.explode(F.array(*[bucket(F.col("mass")) + d for d in (-1, 0, 1)]))
    )
    near = (
        distinct.withColumn("_b", bucket(F.col("_m")))
        .join(F.broadcast(options), "_b")  # 1,155 rows by construction
        .where(F.abs(F.col("_m") - F.col("mass")) <= tolerance)
    )
    found = near.groupBy("_m").agg(
        F.count(F.lit(1)).alias("n_solutions"),
        *[F.max(c).alias(c) for c in ("n_cam", "n_ox", "n_adduct")],
        F.max(F.col("_m") - F.col("mass")).alias("mass_error"),
    )
    single = F.col("n_solutions") == 1
    one = lambda c: F.when(single, F.col(c)).alias(c)
    solved = found.select("_m", "n_solutions", one("n_cam"), one("n_ox"), one("n_adduct"), one("mass_error"))
    return (
        features.join(solved, features[mass] == solved["_m"], "left")
        .drop("_m")
        .withColumn("n_solutions", F.coalesce("n_solutions", F.lit(0)))
    )


def residue_count(sequence: str, residue: str) -> Column:
    return F.length(sequence) - F.length(F.replace(F.col(sequence), F.lit(residue), F.lit("")))


def composition_label() -> Column:
    part = lambda n, tag: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(tag)))
    text = F.concat_ws("+", part("n_cam", "CAM"), part("n_ox", "Ox"), part("n_adduct", "Adduct"))
    return F.when(text == "", "none").otherwise(text)


def classify(features: DataFrame, sequence: str = "base_sequence") -> DataFrame:
    """Add ``mod_class, composition``, residue counts and ``cam_exceeds_cys``."""
    single = F.col("n_solutions") == 1
    kind = (
        F.when(~single, "unexplained")
        .when(F.col("n_adduct") > 0, "adduct")
        .when(F.col("n_ox") > 0, "oxidized")
        .when(F.col("n_cam") > 0, "CAM-only")
        .otherwise("unmodified")
    )
    text = F.when(single, composition_label()).when(F.col("n_solutions") == 0, "unexplained").otherwise("ambiguous")
    counts = {f"n_{name}": residue_count(sequence, r) for name, r in (("cys", "C"), ("met", "M"), ("tyr", "Y"))}
    return features.withColumns(
        {
            "mod_class": kind,
            "composition": text,
            **counts,
            "cam_exceeds_cys": F.coalesce(F.col("n_cam") > counts["n_cys"], F.lit(False)),
        }
    )


def modification_of(mass: Column) -> Column:
    """Name of the one known shift within the display tolerance of a shown mass."""
    near = {name: F.abs(mass - delta) <= DISPLAY_TOLERANCE for name, delta in MOD_DELTAS.items()}
    names = F.filter(F.array(*[F.when(hit, F.lit(n)) for n, hit in near.items()]), lambda x: x.isNotNull())
    return F.when(F.size(names) == 1, F.get(names, 0))


def parse_sites(df: DataFrame, column: str) -> DataFrame:
    """Add ``base_sequence, sites, n_cam, n_ox, n_adduct, bad_sequence``.

    ``sites`` is ``ARRAY<STRUCT<position, residue, mod>>`` with 1-based positions.
    """
    residues = F.regexp_extract_all(column, F.lit(LOCALIZED_TOKEN), F.lit(1))
    shown = F.regexp_extract_all(column, F.lit(LOCALIZED_TOKEN), F.lit(2))
    tokens = F.arrays_zip(residues.alias("residue"), shown.alias("shown"))
    # Residues without a mark are left out before marks are read: a cast that fails costs more than all the rest.
    numbered = F.transform(tokens, lambda t, i: F.struct((i + 1).alias("position"), t["residue"].alias("residue"), t["shown"].alias("shown")))
    marked = F.transform(
        F.filter(numbered, lambda t: t["shown"] != ""),
        lambda t: F.struct(t["position"].alias("position"), t["residue"].alias("residue"), t["shown"].try_cast("double").alias("mass")),
    )
    placed = F.transform(marked, lambda t: F.struct(t["position"].alias("position"), t["residue"].alias("residue"), modification_of(t["mass"]).alias("mod")))
    shaped = F.coalesce(F.col(column).rlike(LOCALIZED), F.lit(False))
    out = df.withColumn("_residues", residues).withColumn("sites", placed)
    count = lambda m: F.size(F.filter("sites", lambda s: s["mod"] == m))
    return (
        out.withColumn("bad_sequence", ~shaped | F.exists("sites", lambda s: s["mod"].isNull()))
        .withColumn("base_sequence", F.array_join("_residues", ""))
        .withColumns({"n_cam": count("CAM"), "n_ox": count("Ox"), "n_adduct": count("Adduct")})
        .drop("_residues")
    )


def composition_key(sequence: str = "base_sequence") -> Column:
    return F.concat_ws("|", sequence, "n_cam", "n_ox", "n_adduct")


def site_text(mod: str | None = None) -> Column:
    """Sites as ``C5:CAM`` joined by ``;``, optionally of one modification."""
    sites = F.col("sites") if mod is None else F.filter("sites", lambda s: s["mod"] == mod)
    return F.array_join(
        F.transform(sites, lambda s: F.concat(s["residue"], s["position"].cast("string"), F.lit(":"), s["mod"])), ";"
    )


def join_by_composition(rows: DataFrame, features: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Many localized rows to one feature; also unmatched keys of both sides."""
    return rows.join(features.select(key, STUDY, FEATURE), key), check_bijection(rows, features, [key])


def aggregate_isoforms(joined: DataFrame, keys: Sequence[str] = (STUDY, FEATURE)) -> DataFrame:
    """Texts of a feature's localized rows, its adducted residues and whether it is unique."""
    collect = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), " | ")
    letters = F.flatten(F.collect_set(F.array_sort(F.array_distinct(F.split("adduct_residues", "")))))  # sets of letters, not rows
    flat = F.array_join(F.array_sort(F.array_distinct(F.filter(letters, lambda x: x != ""))), "")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_isoforms"),
        collect("localized_sequence").alias("localized_sequences"),
        collect("site_text").alias("sites"),
        flat.alias("adduct_residues"),
        F.when(F.min("unique") == F.max("unique"), F.min("unique")).alias("unique"),
    )


def aggregate_isoform_cells(cells: DataFrame, keys: Sequence[str] = (STUDY, FEATURE, SAMPLE)) -> DataFrame:
    """Counts summed and transfer flags OR-ed over a feature's localized rows."""
    return cells.groupBy(*keys).agg(F.sum("psm").alias("psm"), F.bool_or("mbr").alias("mbr"))


def reference_form(features: DataFrame) -> DataFrame:
    """Reference form (no oxidation, no adduct) of each modified form, same base sequence.

    A CAM-only form refers to the unmodified one and an oxidized form to the one with its
    own CAM count. An adduct on cysteine blocks CAM there, so its reference has that many
    more CAM groups; on other residues the count is its own; where the localized rows
    disagree there is no reference.
    """
    residues = F.coalesce(F.col("adduct_residues"), F.lit(""))
    want_cam = (
        F.when(F.col("mod_class") == "CAM-only", F.lit(0))
        .when(F.col("n_adduct") == 0, F.col("n_cam"))
        .when(residues == "C", F.col("n_cam") + F.col("n_adduct"))
        .when((residues != "") & ~residues.contains("C"), F.col("n_cam"))
    )
    wanted = features.where(~F.col("mod_class").isin("unmodified", "unexplained")).select(
        STUDY, FEATURE, "base_sequence", want_cam.alias("n_cam")
    )
    plain = features.where("n_solutions = 1 and n_adduct = 0 and n_ox = 0").select(
        STUDY, "base_sequence", "n_cam", F.col(FEATURE).alias("reference_feature")
    )
    return wanted.join(plain, [STUDY, "base_sequence", "n_cam"], "left").select(
        STUDY, FEATURE, "reference_feature"
    )


def mass_summary(features: DataFrame, keys: Sequence[str] = ("total_mod_mass",)) -> DataFrame:
    """One row per distinct mass: composition, class, features and contaminants."""
    return features.groupBy(*keys).agg(
        F.min("composition").alias("composition"),
        F.min("mod_class").alias("mod_class"),
        F.max("n_solutions").alias("n_solutions"),
        F.max(F.abs("mass_error")).alias("abs_mass_error"),
        F.count(F.lit(1)).alias("n_features"),
        F.sum(F.col("cam_exceeds_cys").cast("int")).alias("n_cam_exceeds_cys"),
    )


def select_feature(states: Mapping[str, DataFrame], feature: str) -> DataFrame:
    """Cells of one feature in every state with their offset from the feature's mean."""
    parts = [df.where(F.col(FEATURE) == feature).select(F.lit(n).alias("state"), STUDY, FEATURE, SAMPLE, "value") for n, df in states.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    mean = F.avg("value").over(Window.partitionBy("state", STUDY, FEATURE))
    return out.withColumn("offset", F.col("value") - mean)


