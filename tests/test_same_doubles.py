"""Results that must not hang on the order in which doubles are added."""

import random

from pyspark.sql import functions as F

from quantgrid.functions.numeric import order_free_sum
from quantgrid.operators import ranks


def test_sum_in_any_order(spark):
    rng = random.Random(5)
    values = [rng.uniform(900, 105_000) * (1 - rng.randint(0, 10) / 100) for _ in range(400)]
    rows = [(copy, v) for copy in range(40) for v in rng.sample(values, len(values))]
    df = spark.createDataFrame(rows, "copy int, v double").repartition(7)
    out = df.groupBy("copy").agg(F.sum("v").alias("plain"), order_free_sum(F.col("v")).alias("s")).collect()
    assert len({r["plain"] for r in out}) > 1
    assert len({r["s"] for r in out}) == 1
    assert abs(out[0]["s"] - sum(values)) < 1e-6


def test_sum_of_odd_values(spark):
    rows = [(1, 1e300), (1, 1.0), (2, float("nan")), (2, 1.0), (3, None), (4, -0.5), (4, 0.25), (5, float("inf"))]
    out = dict(spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(order_free_sum(F.col("v"))).collect())
    assert out[1] == 1e300 and out[2] != out[2] and out[3] is None and out[4] == -0.25 and out[5] == float("inf")


def _unsteady(spark, n):
    """Values whose last digits differ each time they are worked out, as those of sums in any order do."""

    @F.udf("double")
    def noisy(i):
        return float(i) + 1e-9 * random.random()

    return spark.range(n).select(F.lit("a").alias("k"), "id", noisy.asNondeterministic()("id").alias("v"))


def test_ranks_of_values_that_change(spark):
    got = ranks.average_ranks(_unsteady(spark, 300), ["k"], "v").orderBy("id").collect()
    assert [r["rank"] for r in got] == list(range(1, 301))


def test_positions_of_values_that_change(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL_GROUP", 20)
    got = ranks.row_positions(_unsteady(spark, 300), ["k"], "v", ["id"]).orderBy("id").collect()
    assert [r["position"] for r in got] == list(range(1, 301))


def test_quantiles_of_values_that_change(spark):
    got = ranks.group_quantiles(_unsteady(spark, 301), ["k"], "v", [0, 0.5, 1]).first()
    assert [round(got[c], 6) for c in ("q0", "q0.5", "q1")] == [0, 150, 300]
