"""Defects that once passed in silence."""

import numpy as np
import pandas as pd
import pytest

from quantgrid.operators import batch, qc
from quantgrid.operators.checks import CheckFailed
from quantgrid.sources import store, text


def test_results_keep_their_own_columns(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 2.0)], "id int, x double"), spark.createDataFrame([(1, "o")], "id int, other string")
    store.save_result(a, str(tmp_path), "one", "k")
    store.save_result(b, str(tmp_path), "two", "k")
    assert store.load_result(spark, str(tmp_path), "one", "k").columns == ["id", "x"]
    assert store.load_result(spark, str(tmp_path), "two", "k").collect() == b.collect()


@pytest.mark.parametrize("second", ["id\ty\tx", "id\tx\tx", "id\tx\ty\tz"])
def test_files_with_other_headers_are_refused(spark, tmp_path, second):
    (tmp_path / "a.tsv").write_text("id\tx\ty\nf\t1\t2\n")
    (tmp_path / "b.tsv").write_text("id\tx\ty\ng\t3\t4\n")
    assert {tuple(r) for r in text.read_wide(spark, str(tmp_path)).collect()} == {("f", "1", "2"), ("g", "3", "4")}
    (tmp_path / "c.tsv").write_text(second + "\nh\t5\t6\n")
    with pytest.raises(CheckFailed):
        text.read_wide(spark, str(tmp_path)).collect()


def test_a_row_converges_by_itself():
    rng = np.random.default_rng(3)
    n = 400
    cols = [pd.Series(np.full(n, 5.0)), pd.Series(rng.normal(size=n)), pd.Series(rng.gamma(3, size=n)), pd.Series(np.full(n, 0.1)), pd.Series(np.full(n, 0.5)), pd.Series(np.full(n, 4.0)), pd.Series(np.full(n, 3.0))]
    solve = batch._posterior(1e-4).func
    whole = solve(*cols)
    alone = pd.concat([solve(*[c.iloc[i : i + 7] for c in cols]) for i in range(0, n, 7)], ignore_index=True)
    pd.testing.assert_frame_equal(whole, alone)


def test_histogram_keeps_every_value(spark):
    rows = [("raw", "s", f"f{i}", float(v)) for i, v in enumerate(np.random.default_rng(1).lognormal(size=2000))]
    h = qc.cv_histogram(spark.createDataFrame(rows, "state string, study_id string, feature_id string, cv double")).collect()
    assert sum(r.n for r in h) == 2000 and sum(r.n for r in h if r.bin == 60) == 10


def test_batches_of_two_studies_stay_apart(spark):
    runs = [(s, f"X_2021_0506_AZ_{i:03d}_AZ{900 + i}_AZ_c") for s in ("a", "b") for i in range(1, 5)]
    design = text.derive_design(spark.createDataFrame(runs, "study_id string, file string")).collect()
    for s in "ab":
        own = sorted((r.seq_number, r.run_position_within_batch, r.run_half) for r in design if r.study_id == s)
        assert own == [(1, 1, "early"), (2, 2, "early"), (3, 3, "late"), (4, 4, "late")]
