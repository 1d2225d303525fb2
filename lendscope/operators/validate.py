"""Record validation with constraint tables (PRJ-8..11).

A constraint table lists (field, lower, upper, integral).  ``validate``
adds ``errors`` (array of messages, empty when valid) and ``is_valid``;
``split_valid`` returns the accepted rows and the quarantine.  Missing
and NaN values fail a required field, as in the reference's schema
check, and one breach rejects the whole record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType


@dataclass(frozen=True)
class Rule:
    field: str
    lo: float | None = None
    hi: float | None = None
    integral: bool = False
    allowed: tuple | None = None


# The application schema (20 features, inclusive ranges).
APPLICATION_RULES = [
    Rule("Credit_Amount", 0, 1_000_000), Rule("Client_Income_Type", 0, 10, True),
    Rule("Client_Education", 0, 10, True), Rule("Client_Gender", 0, 2, True),
    Rule("Age_Days", 0, 50_000, True), Rule("Employed_Days", 0, 20_000, True),
    Rule("Registration_Days", 0, 10_000, True), Rule("ID_Days", 0, 10_000, True),
    Rule("Cleint_City_Rating", 1, 5, True), Rule("Client_Permanent_Match_Tag", 0, 1, True),
    Rule("Type_Organization", 0, 20, True), Rule("Score_Source_1", 0, 1), Rule("Score_Source_2", 0, 1),
    Rule("Score_Source_3", 0, 1), Rule("Phone_Change", 0, 10, True), Rule("Age_Years", 18, 100, True),
    Rule("Employment_Years", 0, 50, True), Rule("Average_External_Score", 0, 1),
    Rule("Max_External_Score", 0, 1), Rule("Min_External_Score", 0, 1),
]
SELECTED_FEATURES = [r.field for r in APPLICATION_RULES]
FEEDBACK_RULES = [Rule("customer_id"), Rule("actual_outcome", allowed=(0, 1))]
PREDICTION_RULES = [Rule("customer_id"), Rule("probability", 0, 1), Rule("prediction", allowed=(0, 1)),
                    Rule("decision", allowed=("APPROVE", "REJECT", "REVIEW")),
                    Rule("confidence_level", allowed=("HIGH", "MEDIUM", "LOW"))]


def _breaches(r: Rule) -> list[tuple[Column, str]]:
    """Conditions that breach the rule and their messages; the first that holds is reported."""
    c = F.col(r.field)
    num = c.cast("double") if r.lo is not None or r.hi is not None or r.integral else None
    missing = c.isNull() | (F.isnan(num) if num is not None else F.lit(False))
    bad = []
    if r.lo is not None:
        bad.append(num < r.lo)
    if r.hi is not None:
        bad.append(num > r.hi)
    out = [(missing, f"{r.field}: required")]
    if bad:
        cond = bad[0]
        for b in bad[1:]:
            cond = cond | b
        out.append((cond, f"{r.field}: outside [{r.lo}, {r.hi}]"))
    if r.integral:
        out.append((num != F.floor(num), f"{r.field}: not an integer"))
    if r.allowed is not None:
        out.append((~c.isin(*r.allowed), f"{r.field}: not one of {list(r.allowed)}"))
    return out


def _check(r: Rule) -> Column:
    (cond, text), *more = _breaches(r)
    out = F.when(cond, F.lit(text))
    for cond, text in more:
        out = out.when(cond, F.lit(text))
    return out


def _holds(r: Rule, kind: DataType) -> Column:
    """Whether no breach of the rule holds, in few expressions for a column of numbers."""
    c = F.col(r.field)
    if not isinstance(kind, NumericType) or r.allowed is not None:
        out = F.lit(True)
        for cond, _ in _breaches(r):
            out = out & ~F.coalesce(cond, F.lit(False))
        return out
    out, num = c.isNotNull(), c.cast("double")
    whole = isinstance(kind, IntegralType)
    if r.lo is not None:
        out = out & (num >= r.lo)
    if r.hi is not None:
        out = out & (num <= r.hi)  # NaN is above every number
    elif not whole and (r.lo is not None or r.integral):
        out = out & ~F.isnan(num)
    return out & (num == F.floor(num)) if r.integral and not whole else out


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows plus ``errors`` (array<string>) and ``is_valid``.

    ``is_valid`` tests the rules themselves, not ``errors``: a filter on it
    builds no messages, and stops at the first breach.
    """
    errs = F.filter(F.array(*[_check(r) for r in rules]), lambda e: e.isNotNull())
    valid = F.lit(True)
    for r in rules:
        valid = valid & _holds(r, df.schema[r.field].dataType)
    return df.select("*", errs.alias("errors"), valid.alias("is_valid"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and, with their errors, the others; ``validated`` should be a written table, as both read it."""
    return validated.where("is_valid").drop("errors", "is_valid"), validated.where(~F.col("is_valid"))


def default_customer_id(customer_id: Column, received_at: Column) -> Column:
    """PRJ-11: missing or empty id -> 'customer_' + first 17 chars of yyyyMMdd_HHmmss_ffffff."""
    stamp = F.substring(F.date_format(received_at, "yyyyMMdd_HHmmss_SSSSSS"), 1, 17)
    return F.coalesce(F.nullif(customer_id, F.lit("")), F.concat(F.lit("customer_"), stamp))
