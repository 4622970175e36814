"""Scans and fail-loud paths on small files."""

import gzip

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantgrid.model import CheckFailed
from quantgrid.operators import ids
from quantgrid.operators.checks import assert_empty, raise_failures, run_checks
from quantgrid.sources import text


def write(tmp_path, name, *lines):
    p = tmp_path / name
    p.write_text("\n".join("\t".join(row) for row in lines) + "\n")
    return str(p)


def samples(spark):
    return spark.createDataFrame([("1", "A"), ("2", "B")], "search_scan_file_id string, sample_id string")


HEAD = ("Protein Groups", "Intensity_search_scan_file_id_1", "Intensity_search_scan_file_id_2")


def test_feature_table(spark, tmp_path):
    path = write(tmp_path, "a.tsv", HEAD, ("p1", "0", "12.5"), ("p2", "NaN", "3"))
    cells, bad = text.read_feature_cells(spark, path, samples(spark))
    rows = {(r.feature_id, r.sample_id): r for r in cells.collect()}
    assert rows["p1", "A"].was_zero_token and rows["p1", "A"].value is None
    assert rows["p2", "A"].was_nan_token and rows["p2", "B"].value == 3
    assert bad.count() == 0


@pytest.mark.parametrize("cell", ["-1", "abc", "", "Infinity"])
def test_bad_cells_are_reported(spark, tmp_path, cell):
    path = write(tmp_path, "b.tsv", HEAD, ("p1", cell, "1"))
    _, bad = text.read_feature_cells(spark, path, samples(spark))
    assert bad.count() == 1
    with pytest.raises(CheckFailed):
        assert_empty(bad, "cells")


def test_duplicate_header_and_unknown_run(spark, tmp_path):
    with pytest.raises(CheckFailed):
        text.read_wide(spark, write(tmp_path, "c.tsv", ("a", "a"), ("1", "2")))
    path = write(tmp_path, "d.tsv", ("Protein Groups", "Intensity_search_scan_file_id_9"), ("p1", "1"))
    assert text.read_feature_cells(spark, path, samples(spark))[1].count() == 1


def test_child_conflicts(spark, tmp_path):
    head = ("Sequence", "Base Sequence", "Protein Groups", "Intensity_search_scan_file_id_1", "Detection Type_search_scan_file_id_1")
    rows = [("a", "A", "p", "5", "MSMS"), ("b", "B", "p", "5", "NotDetected"), ("c", "C", "p", "0", "MBR"), ("d", "D", "p", "0", "Odd"), ("e", "E", "p", "NaN", "NotDetected")]
    _, bad = text.read_child_cells(spark, write(tmp_path, "e.tsv", head, *rows), samples(spark))
    assert {r.feature_id for r in bad.collect()} == {"b", "c", "d", "e"}


def test_blank_is_kept_and_design_dates(spark, tmp_path):
    wide = text.read_wide(spark, write(tmp_path, "f.tsv", ("a", "b"), ("", "x")))
    assert wide.first().a == ""
    runs = spark.createDataFrame([("X_2021_0506_AZ_034_AZ905_z.mzML",), ("X_2021_1350_AZ_1_AZ2_z.mzML",), ("nope",)], "file string")
    d = text.derive_design(runs)
    first = d.where("sample_number = 905").first()
    assert str(first.acq_date) == "2021-05-06" and first.candidate_pair == "P905_906" and first.run_half == "early"
    assert {r.reason for r in text.design_violations(d).collect()} == {"date", "pattern"}


def test_all_checks_are_listed(spark):
    one = spark.range(1)
    with pytest.raises(CheckFailed, match="first.*second|second.*first"):
        raise_failures(run_checks({"first": one, "fine": one.where("id > 5"), "second": one}))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4), st.integers(0, 3)), min_size=1, max_size=20, unique=True))
def test_mass_round_trip(spark, combos):
    rows = [("s", f"f{i}", a * ids.CAM_DELTA + b * ids.OX_DELTA + c * ids.ADDUCT_DELTA, a, b, c) for i, (a, b, c) in enumerate(combos)]
    df = spark.createDataFrame(rows, "study_id string, feature_id string, total_mod_mass double, a int, b int, c int")
    out = ids.decompose_mass(df)
    assert out.where("n_solutions <> 1 or n_cam <> a or n_ox <> b or n_adduct <> c").count() == 0


def test_contaminant_rule_looks_after_the_first_member(spark):
    f = spark.createDataFrame([("sp|A_X|", True), ("sp|B_X|", True), ("sp|C_X|", True)], "accession_key string, is_candidate boolean")
    g = spark.createDataFrame([(["sp|A_X|"],), (["sp|B_X|", "sp|P1|B_Y"],)], "members array<string>")
    refined, lost = ids.refine_contaminants(f, g)
    got = {r.accession_key: r.is_contaminant for r in refined.collect()}
    assert got["sp|A_X|"] and not got["sp|B_X|"]
    assert [r.accession_key for r in lost.collect()] == ["sp|C_X|"]


def test_half_even_figures(spark):
    v = spark.createDataFrame([(0.0,), (12.345,), (99999.0,), (0.001225,)], "v double").select(ids.sig_figs(F.col("v")).alias("s"))
    assert [r.s for r in v.collect()] == pytest.approx([0.0, 12.3, 100000.0, 0.00122], rel=1e-9)


def test_a_header_costs_a_short_read(spark, tmp_path):
    folder = tmp_path / "with blank"
    folder.mkdir()
    for name in "ab":
        (folder / f"{name}.tsv").write_text("id\tx\n" + "f\t1\n" * 200_000)
    (folder / "none.tsv").write_text("")
    with gzip.open(folder / "c.tsv.gz", "wt") as f:
        f.write("id\tx\ng\t2\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("header", "header")
    text.assert_unique_header(spark, str(folder))
    assert not tracker.getJobIdsForGroup("header")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in text.header_cells(spark, str(folder)).collect()] == [(0, "id"), (1, "x")]
    assert text.read_wide(spark, str(folder)).count() == 400_001


def test_a_scan_refuses_another_header_too(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tx\nf\t1\n")
    (tmp_path / "b.tsv").write_text("x\tid\n2\tg\n")
    with pytest.raises(Exception, match="header"):
        text.read_wide(spark, str(tmp_path), check_header=False).collect()


def test_readers_carry_the_study(spark, tmp_path):
    head = ("Protein Groups", "Intensity_search_scan_file_id_1")
    path = write(tmp_path, "s.tsv", head, ("p1", "5"), ("p2", "x"))
    sheet = spark.createDataFrame([("A", "1", "r1"), ("B", "1", "other")], "study_id string, search_scan_file_id string, sample_id string")
    cells, bad = text.read_feature_cells(spark, path, sheet, study="A")
    assert {(r.study_id, r.feature_id, r.sample_id) for r in cells.collect()} == {("A", "p1", "r1"), ("A", "p2", "r1")}
    assert [r.study_id for r in bad.collect()] == ["A"]
    columns = ("study_id", "sample_id", "search_scan_file_id", "batch", "run_position_within_batch", "condition")
    two = write(tmp_path, "m.tsv", columns, ("A", "r1", "1", "B1", "1", "c"), ("B", "r1", "1", "B1", "1", "c"))
    assert [(r.study_id, r.sample_id) for r in text.read_samples(spark, two).collect()] == [("A", "r1"), ("B", "r1")]
    with pytest.raises(CheckFailed):
        text.read_samples(spark, write(tmp_path, "n.tsv", columns, ("A", "r1", "1", "B1", "1", "c"), ("A", "r1", "2", "B1", "2", "c")))
    labels = spark.createDataFrame([("A", "one", "r1"), ("B", "one", "r2")], "study_id string, label string, sample_id string")
    dump = write(tmp_path, "d2.tsv", ("Protein(s)", "PSMs (one)", "NSAF (one)"), ("p", "1,000", "0.5"))
    cells, members, bad = text.read_count_dump(spark, dump, labels, study="B")
    assert [tuple(r) for r in cells.collect()] == [("B", "p", "r2", 1000, 0.5)] and members.first().study_id == "B" and not bad.count()
