"""Quality rules: counts of a text, and robust multivariate outliers among documents of one language and source.

A text's statistics are transformed to a vector. For each language and source the minimum-covariance-determinant
estimate of its centre and scatter comes from concentration steps: the three quarters of the documents that
are nearest to the present estimate give the next one. A document whose Mahalanobis distance is beyond the chi-square
quantile is rejected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.llm.common import documents, materialise
from quantgrid.llm.spans import let

_SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20

#: The vector's parts, and the least standard deviation that each is given: a group whose documents are all alike
#: shall not reject for a trifle.
PARTS = {"x_length": 0.06, "x_symbols": 0.35, "x_lines": 0.10, "x_repeats": 0.05}
#: Share of a group that concentration steps keep, their number at most, the documents that a group needs.
SUPPORT, STEPS, LEAST_ROWS = 0.75, 8, 60
#: A group may hold a third of all rows; joins with the small tables of groups deal it over so many salts.
SALTS = 64
#: Chi-square probability of the cut.
CONFIDENCE = 0.99999


def chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom, in closed form."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def _repeats(words: Column) -> Column:
    """Words in windows of five that are found twice or more, the first included."""
    none = F.lit(0).cast("long")
    starts = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def places(h: Column) -> Column:
        """First words of the repeated windows, in order."""
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        both = lambda o: F.zip_with(o, F.slice(o, F.lit(2), F.size(o)), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(let(ordered, both), lambda x: x.isNotNull()))))

    def covered(p: Column) -> Column:
        spans = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(spans, none, lambda t, x: t + x)

    repeated = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(places(h), covered)))
    return F.when(F.size(words) < WINDOW, none).otherwise(repeated)


def statistics(text: Column) -> Column:
    """The counts of a text as a struct."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    counted = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w).alias("n_repeat_words"))
    lined = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    return F.struct(let(words, counted).alias("w"), let(lines, lined).alias("l"), symbols.alias("n_symbols"))


def vector() -> dict[str, Column]:
    """The transformed statistics. Short texts are drawn to the usual values, as their shares vary by chance."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "x_length": F.log((chars + 6 * 30) / (words + 30)),
        "x_symbols": F.log1p(100 * F.col("n_symbols") / (chars + 200)),
        "x_lines": F.col("n_dup_lines") / (F.col("n_lines") + 8),
        "x_repeats": F.col("n_repeat_words") / (words + 60),
    }


_NAMES = list(PARTS)


def _entries() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(_NAMES)) for j in range(i + 1)]


def _lower(params: DataFrame) -> DataFrame:
    """Cholesky factor ``l_i_j`` of the scatter ``c_i_j``, column by column."""
    for i, j in _entries():
        inner = reduce(Column.__add__, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
        rest = F.col(f"c_{i}_{j}") - inner
        # The floor on the diagonal keeps the factor real.
        params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return params.select("grp", *[f"m_{i}" for i in range(len(_NAMES))], *[f"l_{i}_{j}" for i, j in _entries()])


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's parameters."""
    z: list[Column] = []
    for i, name in enumerate(_NAMES):
        inner = reduce(Column.__add__, [F.col(f"l_{i}_{k}") * z[k] for k in range(i)], F.lit(0.0))
        z.append((F.col(name) - F.col(f"m_{i}") - inner) / F.col(f"l_{i}_{i}"))
    return reduce(Column.__add__, [x * x for x in z])


def _join(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows, with their ``salt``, to one row a key, written once a salt."""
    return rows.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"], how)


def _floored(i: int, j: int, value: Column) -> Column:
    return value + F.lit(PARTS[_NAMES[i]] ** 2 if i == j else 0.0)


def concentrate(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant parameters of each ``grp``: centre, and Cholesky factor of the scatter.

    ``rows`` has a ``salt`` below SALTS. It starts from the medians and median deviations. Only per-group values
    leave the aggregations.
    """
    d = len(_NAMES)
    q = chi2_quantile(SUPPORT, d)
    scale = SUPPORT / chi2_cdf(q, d + 2)  # makes the scatter of the inner part that of the whole
    medians = rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(_NAMES)])
    medians = materialise(medians)
    spread = _join(rows, medians, "grp").groupBy("grp").agg(*[F.first(f"m_{i}").alias(f"m_{i}") for i in range(d)], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000).alias(f"s_{i}") for i, x in enumerate(_NAMES)])
    start = spread.select("grp", *[f"m_{i}" for i in range(d)], *[_floored(i, j, (1.4826 * F.col(f"s_{i}")) ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _entries()])
    params = materialise(_lower(start))
    for _ in range(steps):
        near = _join(rows, params, "grp").select("grp", "salt", *_NAMES, _distance().alias("d"))
        cut = materialise(near.groupBy("grp").agg(F.percentile_approx("d", SUPPORT, 2000).alias("cut")))
        inner = _join(near, cut, "grp").where("d <= cut")
        moments = inner.groupBy("grp").agg(*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(_NAMES)], *[F.covar_pop(_NAMES[i], _NAMES[j]).alias(f"v_{i}_{j}") for i, j in _entries()])
        fresh = materialise(_lower(moments.select("grp", *[f"m_{i}" for i in range(d)], *[_floored(i, j, scale * F.col(f"v_{i}_{j}")).alias(f"c_{i}_{j}") for i, j in _entries()])))
        moved = reduce(F.greatest, [F.abs(F.col(f"a.m_{i}") - F.col(f"b.m_{i}")) / F.col(f"a.l_{i}_{i}") for i in range(d)])
        most = fresh.alias("a").join(params.alias("b"), "grp").agg(F.max(moved)).first()[0]
        params = fresh
        if most is None or most < 1e-3:
            break
    return params


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the squared ``distance`` of each row.

    Null and empty texts have no words, and fail. A null language or source is a group of its own. A language
    and source with fewer than LEAST_ROWS texts that pass the base rules is judged with the others of its language, and if
    those are too few, with all such; if these are too few, nothing is rejected and the distance is null. Rows that
    repeat stay; an empty table gives none. Other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("a"), F.col(source_col).cast("string").alias("b"), text.alias("_text"))
    rows = rows.select("doc_id", "a", "b", statistics(F.col("_text")).alias("s")).select("doc_id", "a", "b", "s.w.*", "s.l.*", "s.n_symbols")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    pair, own = F.to_json(F.array("a", "b")), F.to_json(F.array("a"))
    rows = materialise(rows.withColumn("base_failed", failed).withColumns(vector()).withColumn("fine", pair).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")))
    # Which group judges each language and source.
    sizes = materialise(rows.groupBy("fine", "a").agg(F.sum(F.when(~F.col("base_failed"), 1).otherwise(0)).alias("n")))
    few = sizes.where(F.col("n") < LEAST_ROWS).groupBy(own.alias("lang")).agg(F.sum("n").alias("n_lang"))
    named = sizes.withColumn("lang", own).join(few, "lang", "left")
    grp = F.when(F.col("n") >= LEAST_ROWS, F.col("fine")).when(F.col("n_lang") >= LEAST_ROWS, F.col("lang")).otherwise("all")
    named = materialise(named.select("fine", grp.alias("grp")))
    rows = materialise(_join(rows, named, "fine").drop("fine"))
    passed = rows.where(~F.col("base_failed")).select("grp", "salt", *_NAMES)
    enough = passed.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).select("grp")
    params = concentrate(materialise(_join(passed, materialise(enough), "grp")))
    cut = chi2_quantile(CONFIDENCE, len(_NAMES))
    out = _join(rows, params, "grp", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op7_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
