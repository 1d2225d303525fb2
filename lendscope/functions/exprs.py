"""Reusable column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``
so it stays inside whole-stage codegen (but for the exact KS p-value, one
number a test).  ANSI mode stays on: every cast
or division that can fail on bad input uses the ``try_`` form.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Plain decimal or scientific notation, optional sign and
# surrounding blanks; anything else is not a number (pandas to_numeric
# with errors='coerce').
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Decision ladder of the scoring service (upper bounds are
# inclusive) and the risk mix cut points of the monitor.
LADDER = [
    (0.15, "APPROVE", "HIGH"),
    (0.25, "APPROVE", "MEDIUM"),
    (0.40, "REVIEW", "MEDIUM"),
]
LADDER_TOP = ("REJECT", "HIGH")
RISK_LOW_MAX = 0.2
RISK_MEDIUM_MAX = 0.4


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_numeric(c) -> Column:
    """Text -> double the way pandas coerces; numbers pass through.

    ``try_cast`` alone would accept Spark-only forms such as '1d', so the
    text must first look like a plain number.
    """
    s = col_(c).cast("string")
    return F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))


def try_div(a, b) -> Column:
    return F.try_divide(col_(a), col_(b))


def seeded_u32(seed, c) -> Column:
    """md5 of '<seed>|<value>' -> 32 bit integer."""
    s = F.concat(F.lit(f"{seed}|"), col_(c).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def seeded_u60(seed, c) -> Column:
    """md5 of '<seed>|<value>' -> 60 bit integer, for draws from more than 2^32 rows."""
    s = F.concat(F.lit(f"{seed}|"), col_(c).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def decision(p) -> Column:
    p = col_(p)
    e = None
    for hi, d, _ in LADDER:
        e = F.when(p <= hi, F.lit(d)) if e is None else e.when(p <= hi, F.lit(d))
    return e.otherwise(F.lit(LADDER_TOP[0]))


def confidence(p) -> Column:
    p = col_(p)
    e = None
    for hi, _, c in LADDER:
        e = F.when(p <= hi, F.lit(c)) if e is None else e.when(p <= hi, F.lit(c))
    return e.otherwise(F.lit(LADDER_TOP[1]))


def kolmogorov_pvalue(lam) -> Column:
    """Asymptotic two-sided KS p-value Q(lambda), 100 series terms.

    1 for lambda < 0.2 (the series has not converged there), clamped to [0, 1].
    """
    lam = col_(lam)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0).cast("double"),
        lambda acc, k: acc + 2.0 * F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(-2.0 * k * k * lam * lam),
    )
    return (F.when(lam.isNull(), F.lit(None).cast("double"))
            .when(lam < 0.2, F.lit(1.0))
            .otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))))


def severity_from_p(p) -> Column:
    p = col_(p)
    return F.when(p < 0.01, "HIGH").when(p < 0.05, "MEDIUM").otherwise("LOW")


EXACT_KS_ROWS = 10_000  # fixed value: beyond so many rows in a sample the p-value is asymptotic


def exact_ks_pvalue(n1: int, n0: int, d: float) -> float:
    """P(D >= d) of the two-sided two-sample statistic, ties or not.

    Walks the lattice of the merged order, one diagonal at a time: the chance of
    being at (i, s - i) after s steps while i/n1 and (s - i)/n0 have differed by
    less than ``d``.  What leaves the band is added up, so small values keep
    their digits.  (n1 + n0) steps over a band of 2 d n1 n0 / (n1 + n0) places.
    """
    g = math.gcd(n1, n0)
    width = round(d * (n1 // g) * n0) * g
    if width <= 0:
        return 1.0
    n, p, lo, gone = n1 + n0, np.ones(1), 0, 0.0
    for s in range(n):
        i = np.arange(lo, lo + len(p))
        new = np.zeros(len(p) + 1)
        new[:-1] = p * (n0 - (s - i)) / (n - s)
        new[1:] += p * (n1 - i) / (n - s)
        t = s + 1
        first = max(0, t - n0, (t * n1 - width) // n + 1)
        end = max(first, min(n1, t, -(-(t * n1 + width) // n) - 1) + 1)
        gone += float(new[:first - lo].sum() + new[end - lo:].sum())
        p, lo = new[first - lo:end - lo], first
        if not len(p):
            break
    return min(1.0, gone)


@F.pandas_udf(DoubleType())
def _exact_ks(n1: pd.Series, n0: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([exact_ks_pvalue(int(a), int(b), float(x)) if 0 < a <= EXACT_KS_ROWS and 0 < b <= EXACT_KS_ROWS and x == x else None
                      for a, b, x in zip(n1.fillna(0), n0.fillna(0), d, strict=True)], dtype="float64")


def ks_pvalue(n1, n0, d) -> Column:
    """Exact where both samples have EXACT_KS_ROWS rows at most, the Kolmogorov series at sqrt(n1 n0 / (n1 + n0)) d above.

    Null where a sample is empty.  For frames of a few rows: one per test.
    """
    n1, n0, d = col_(n1), col_(n0), col_(d)
    lam = F.sqrt(n1 * n0 / (n1 + n0)) * d
    return F.when((n1 > 0) & (n0 > 0), F.when(F.greatest(n1, n0) <= EXACT_KS_ROWS, _exact_ks(n1, n0, d)).otherwise(kolmogorov_pvalue(lam)))
