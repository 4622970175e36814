"""Distribution tails as Arrow-batched column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quantgrid.functions import special


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided t tail; df = infinity is the normal law, NULL in gives NULL out."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(special.t_two_sided(a.to_numpy(float), b.to_numpy(float)))

    return F.nanvl(tail(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def t_critical(df: Column, alpha: float = 0.05) -> Column:
    @F.pandas_udf("double")
    def crit(a: pd.Series) -> pd.Series:
        return pd.Series(special.t_critical(alpha, a.to_numpy(float)))

    return F.nanvl(crit(df.cast("double")), F.lit(None).cast("double"))


def norm_critical(alpha: float = 0.05) -> float:
    return float(special.norm_isf(alpha / 2))


def mann_whitney_p(u: Column, n1: Column, n2: Column, tie_sum: Column, exact: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        keys = pd.DataFrame({"u": a, "n1": b, "n2": c, "t": d, "e": e}).astype(float)
        # Few distinct rows: each is evaluated once.
        uniq, back = np.unique(keys.to_numpy(), axis=0, return_inverse=True)
        p = special.mann_whitney_p(uniq[:, 0], uniq[:, 1], uniq[:, 2], uniq[:, 3], uniq[:, 4] > 0)
        return pd.Series(p[back.ravel()])

    d = [c.cast("double") for c in (u, n1, n2, tie_sum, exact)]
    return F.nanvl(tail(*d), F.lit(None).cast("double"))


def binomial_half(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """Struct ``p, ci_low, ci_high`` of k of n against one half."""

    @F.pandas_udf("p double, ci_low double, ci_high double")
    def exact(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        k, n = a.to_numpy(float), b.to_numpy(float)
        low, high = special.clopper_pearson(k, n, alpha)
        return pd.DataFrame({"p": special.binom_half_two_sided(k, n), "ci_low": low, "ci_high": high})

    return exact(k.cast("double"), n.cast("double"))


def fisher(a: Column, b: Column, c: Column, d: Column, alpha: float = 0.05) -> Column:
    """Struct ``p, odds_ratio, ci_low, ci_high`` of a 2 x 2 table."""

    @F.pandas_udf("p double, odds_ratio double, ci_low double, ci_high double")
    def exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [special.fisher_exact(*map(int, r), alpha) for r in zip(a, b, c, d)]
        return pd.DataFrame(rows, columns=["p", "odds_ratio", "ci_low", "ci_high"], dtype=float)

    return exact(*[x.cast("long") for x in (a, b, c, d)])


def truncated_poisson_log2_var(mean: Column) -> Column:
    @F.pandas_udf("double")
    def var(m: pd.Series) -> pd.Series:
        return m.map(special.truncated_poisson_log2_var)

    return var(mean.cast("double"))


def no_nan(c: Column) -> Column:
    """NaN from a tail function means not testable, which is NULL here."""
    return F.nanvl(c, F.lit(None).cast("double"))


def wilcoxon_p(w_plus: Column, n: Column, tie_sum: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([special.wilcoxon_p(w, int(m), t) for w, m, t in zip(a, b, c)], dtype=float)

    return no_nan(tail(*[x.cast("double") for x in (w_plus, n, tie_sum)]))


def chi2_one_tail(x: Column) -> Column:
    """Upper tail of chi square on one degree of freedom."""
    return t_two_sided(F.sqrt(x), F.lit(float("inf")))
