"""Cells of both measures are aggregated from the lines once."""

from quantgrid.catalog import agreement
from quantgrid.plans import testbed


def test_lines_are_read_once(spark, sf, monkeypatch):
    made, calls = testbed.base_cells, []

    def counted(*args, **kwargs):
        calls.append(args)
        return made(*args, **kwargs)

    monkeypatch.setattr(testbed, "base_cells", counted)
    out = agreement.cells(spark, sf)
    assert out.columns == ["study_id", "feature_id", "sample_id", "x", "y", "count", "f"]
    assert out.count() == made(spark, sf).count()
    assert len(calls) == 1
