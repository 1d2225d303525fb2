"""Type repair and engineered loan features (row-local expressions only).

Every feature is added only when its input columns exist, as in the
reference; all are single ``select`` projections, so Catalyst prunes the
ones a later query does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .exprs import to_numeric, try_div

# Columns the loader repairs to numbers, and the second
# coercion before feature engineering.
NUMERIC_BY_INTENT = ["Client_Income", "Credit_Amount", "Loan_Annuity", "Population_Region_Relative",
                     "Age_Days", "Employed_Days", "Registration_Days", "ID_Days", "Score_Source_3"]
KEY_NUMERIC = ["Age_Days", "Employed_Days", "Client_Income", "Credit_Amount", "Loan_Annuity"]

# Right-closed bins (lowest edge included) and their labels.
AGE_BINS = [0, 25, 35, 45, 55, 100]
AGE_LABELS = ["Young", "Adult", "Middle", "Senior", "Elder"]
EMPLOYMENT_BINS = [0, 1, 5, 10, 50]
EMPLOYMENT_LABELS = ["New", "Stable", "Experienced", "Veteran"]
ASSET_COLUMNS = ["Car_Owned", "Bike_Owned", "House_Own"]
CONTACT_COLUMNS = ["Mobile_Tag", "Homephone_Tag", "Workphone_Working"]
WEEKEND_DAYS = [0, 6]
DAYS_PER_YEAR = 365.25
STRESS_PCT = 50
STRESS_CHILDREN = 2


def repair_types(df: DataFrame, columns: list[str] = NUMERIC_BY_INTENT) -> tuple[DataFrame, list[str]]:
    """PRJ-1: text columns meant to be numeric become double; bad text -> null.

    Returns the frame and the names of the converted columns (only text
    columns are converted; numeric ones pass untouched).
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    conv = [c for c in columns if c in types and isinstance(types[c], StringType)]
    out = df.select(*[to_numeric(c).alias(c) if c in conv else F.col(c) for c in df.columns])
    return out, conv


def cut(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins with the lowest edge included; outside -> null."""
    e = F.when((x >= edges[0]) & (x <= edges[1]), F.lit(labels[0]))
    for hi, lab in zip(edges[2:], labels[1:]):
        e = e.when(x <= hi, F.lit(lab))
    return e


def add_features(df: DataFrame) -> DataFrame:
    """FE-1..13 (and PRJ-2, the repeated coercion of the key columns)."""
    df, _ = repair_types(df, KEY_NUMERIC)
    cols = set(df.columns)
    new: list[tuple[str, Column]] = []
    years = {}
    if "Age_Days" in cols:
        years["Age_Years"] = F.abs(F.coalesce(F.col("Age_Days"), F.lit(0.0))) / DAYS_PER_YEAR
        new += [("Age_Years", years["Age_Years"]),
                ("Age_Group", cut(years["Age_Years"], AGE_BINS, AGE_LABELS))]
    if "Employed_Days" in cols:
        years["Employment_Years"] = F.abs(F.coalesce(F.col("Employed_Days"), F.lit(0.0))) / DAYS_PER_YEAR
        new += [("Employment_Years", years["Employment_Years"]),
                ("Employment_Stability", cut(years["Employment_Years"], EMPLOYMENT_BINS, EMPLOYMENT_LABELS))]
    inc, cred = F.col("Client_Income"), F.col("Credit_Amount")
    pct = None
    if {"Client_Income", "Credit_Amount"} <= cols:
        pct = try_div(cred, inc + 1) * 100
        new += [("Income_Credit_Ratio", try_div(inc, cred + 1)), ("Credit_Income_Percentage", pct)]
    if {"Client_Income", "Loan_Annuity"} <= cols:
        new.append(("Annuity_Income_Ratio", try_div(F.col("Loan_Annuity"), inc + 1)))
    for name, group in (("Asset_Score", ASSET_COLUMNS), ("Contact_Completeness", CONTACT_COLUMNS)):
        present = [c for c in group if c in cols]
        if present:
            s = F.coalesce(F.col(present[0]), F.lit(0))
            for c in present[1:]:
                s = s + F.coalesce(F.col(c), F.lit(0))
            new.append((name, s))
    scores = [c for c in df.columns if "Score_Source" in c]
    if len(scores) >= 2:
        tot = F.coalesce(F.col(scores[0]), F.lit(0.0))
        cnt = F.col(scores[0]).isNotNull().cast("int")
        for c in scores[1:]:
            tot = tot + F.coalesce(F.col(c), F.lit(0.0))
            cnt = cnt + F.col(c).isNotNull().cast("int")
        new += [("Average_External_Score", try_div(tot, cnt)),
                ("Max_External_Score", F.greatest(*[F.col(c) for c in scores])),
                ("Min_External_Score", F.least(*[F.col(c) for c in scores]))]
    if "Application_Process_Day" in cols:
        new.append(("Is_Weekend", F.coalesce(F.col("Application_Process_Day").isin(*WEEKEND_DAYS), F.lit(False))
                    .cast("int")))
    if pct is not None and "Active_Loan" in cols:
        s = F.coalesce(pct > STRESS_PCT, F.lit(False)).cast("double") + F.coalesce(F.col("Active_Loan"), F.lit(0))
        if "Child_Count" in cols:
            s = s + F.coalesce(F.col("Child_Count") > STRESS_CHILDREN, F.lit(False)).cast("int")
        new.append(("Financial_Stress_Score", s.cast("double")))
    return df.select("*", *[e.alias(n) for n, e in new])


FEATURE_NAMES = ["Age_Years", "Age_Group", "Employment_Years", "Employment_Stability", "Income_Credit_Ratio",
                 "Credit_Income_Percentage", "Annuity_Income_Ratio", "Asset_Score", "Contact_Completeness",
                 "Average_External_Score", "Max_External_Score", "Min_External_Score", "Is_Weekend",
                 "Financial_Stress_Score"]
