"""Registry and the SQL fragments that mirror ``plans.testbed``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.session import ship

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(ship(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rd(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded output column; adding 0.0 folds negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits) + F.lit(0.0)
    return out.alias(name or c)


def R(expr: str, digits: int = 6) -> str:
    return f"(round(cast({expr} as double), {digits}) + 0.0)"


_STUDY = {"one": "'s0'", "three": "'s' || (l_partkey % 3)", "flag": "l_returnflag"}


def base_cte(study: str = "one", sparse: bool = False) -> str:
    """``base`` (cells), ``smp`` (samples) and ``feat`` (features) as in the testbed."""
    sid = _STUDY[study]
    num = "l_suppkey" if sparse else "l_suppkey % 8"
    return f"""
base AS (SELECT {sid} AS study_id, 'p' || l_partkey AS feature_id, 'r' || ({num}) AS sample_id,
           sum(l_extendedprice * (1 - l_discount)) AS value, count(*) AS count
         FROM lineitem GROUP BY ALL),
smp AS (SELECT study_id, 'r' || n AS sample_id, CASE WHEN n % 2 = 1 THEN 'treated' ELSE 'control' END AS condition,
          'P' || (n // 2) AS candidate_pair, CASE WHEN n < 6 THEN 'B1' ELSE 'B2' END AS batch, n AS seq_number,
          n + 1 AS sample_number, CASE WHEN n < 6 THEN n + 1 ELSE n - 5 END AS run_position_within_batch
        FROM (SELECT DISTINCT {sid} AS study_id, cast({num} AS int) AS n FROM lineitem)),
feat AS (SELECT study_id, 'p' || l_partkey AS feature_id, p_brand, p_size, p_type, coalesce(p_size >= 48, false) AS is_contaminant
         FROM (SELECT DISTINCT {sid} AS study_id, l_partkey FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey),
nsmp AS (SELECT study_id, count(*) AS n_samples FROM smp GROUP BY ALL)"""


COMPLETE = """,
comp AS (SELECT b.* FROM base b JOIN (
           SELECT study_id, feature_id, count(*) AS k FROM base WHERE value > 0 GROUP BY ALL) USING (study_id, feature_id)
         JOIN nsmp USING (study_id) WHERE k = n_samples)"""

NORMAL = """,
med AS (SELECT study_id, sample_id, median(value) AS m FROM comp GROUP BY ALL),
fac AS (SELECT study_id, sample_id, avg(m) OVER (PARTITION BY study_id) / m AS factor FROM med),
norm AS (SELECT study_id, feature_id, sample_id, value * factor AS value, count FROM comp JOIN fac USING (study_id, sample_id)),
nlog AS (SELECT study_id, feature_id, sample_id, log2(value + 1) AS value, count FROM norm)"""

# Paired design in closed form: with one control and one treated sample per pair the
# treatment effect is the mean pair difference and the residual its spread.
PAIRED = """,
pd AS (SELECT study_id, feature_id, candidate_pair,
         max(CASE WHEN condition = 'treated' THEN value END) - max(CASE WHEN condition = 'control' THEN value END) AS d
       FROM nlog JOIN smp USING (study_id, sample_id) GROUP BY ALL),
fit AS (SELECT study_id, feature_id, avg(d) AS effect, var_samp(d) / 2 AS sigma2, stddev_samp(d) / sqrt(count(*)) AS se
        FROM pd GROUP BY ALL)"""


def with_sql(study: str, body: str, complete: bool = True, normal: bool = True, paired: bool = False, sparse: bool = False) -> str:
    parts = base_cte(study, sparse)
    if complete:
        parts += COMPLETE
    if complete and normal:
        parts += NORMAL
    if paired:
        parts += PAIRED
    return f"WITH {parts}\n{body}"


# Laws in SQL: sums and quadrature that depend on nothing in the library.


def trigamma_sql(x: str) -> str:
    y = f"({x} + 30)"
    return f"(list_sum(list_transform(range(0, 30), lambda k: 1 / (({x} + k) * ({x} + k)))) + 1 / {y} + 1 / (2 * {y} ^ 2) + 1 / (6 * {y} ^ 3) - 1 / (30 * {y} ^ 5) + 1 / (42 * {y} ^ 7))"


def digamma_sql(x: str) -> str:
    y = f"({x} + 30)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ^ 2) + 1 / (120 * {y} ^ 4) - 1 / (252 * {y} ^ 6) - list_sum(list_transform(range(0, 30), lambda k: 1 / ({x} + k))))"


def t_tail_sql(t: str, df: str, steps: int = 800) -> str:
    """Two-sided t tail by Simpson's rule over the angle; ``df`` finite and above 2."""
    start = f"atan(abs({t}) / sqrt({df}))"
    width = f"((least(pi() / 2, {start} + 12 / sqrt({df})) - {start}) / {steps})"
    terms = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * greatest(cos({start} + i * {width}), 0.0) ^ ({df} - 1)))"
    return f"(2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {width} / 3 * {terms})"


def prior_sql(source: str, keys: str, df: str) -> str:
    """``pr`` (keys, n, d0, s0_sq) from the variances s2 of ``source``: the law of log variances by its first two moments, d0 by bisection of its logarithm."""
    target = f"(v - {trigamma_sql(f'({df} / 2.0)')})"
    steps = ", ".join(repr(2.0**k) for k in range(5, -48, -1))
    return f"""zz AS (SELECT *, ln(greatest(s2, 1e-5 * median(s2) OVER (PARTITION BY {keys}))) AS z FROM {source}),
pm0 AS (SELECT {keys}, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM zz GROUP BY ALL), pt AS (SELECT *, {target} AS target FROM pm0),
pd0 AS (SELECT *, CASE WHEN target > 1e-6 THEN 2 * pow(2, list_reduce([-24.0, {steps}]::double[], lambda a, s: CASE WHEN {trigamma_sql('pow(2, a + s)')} > target THEN a + s ELSE a END)) END AS d0 FROM pt),
pr AS (SELECT {keys}, n, d0, exp(m + ln({df} / 2.0) - {digamma_sql(f'({df} / 2.0)')} + CASE WHEN d0 IS NULL THEN 0 ELSE {digamma_sql('(d0 / 2)')} - ln(d0 / 2) END) AS s0_sq FROM pd0)"""


def t_critical_sql(df: str, alpha: float = 0.05) -> str:
    """Two-sided critical value of t, digit by digit."""
    steps = ", ".join(repr(2.0**k) for k in range(6, -44, -1))
    return f"list_reduce([0.0, {steps}]::double[], lambda a, s: CASE WHEN {t_tail_sql('(a + s)', df, 300)} > {alpha} THEN a + s ELSE a END)"
