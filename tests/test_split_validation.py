"""Splitting without moving rows, and validity without messages."""

import pytest
from pyspark.sql import functions as F

from lendscope.operators import prep
from lendscope.operators import validate as V
from lendscope.operators.ranking import first_of_class, rank_in_class


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
@pytest.mark.parametrize("copies", [1, 3])
def test_first_of_class_is_what_the_ranks_say(spark, share, copies):
    rows = [(i // copies, i % 3 if i % 7 else None, float(i)) for i in range(900)] + [(None, 1, 0.5)]
    df = spark.createDataFrame(rows, "id long, y int, v double")
    got = first_of_class(df, "y", "id", share)
    assert got.columns == ["y", "id", "v", "is_first"]
    ranked = rank_in_class(df, "y", "id", 42, rank_col="rk", size_col="n").withColumn("is_first", F.col("rk") <= F.round(F.col("n") * share))
    count = lambda d: sorted(map(tuple, d.groupBy("y", "id", "is_first").count().collect()))
    assert count(got) == count(ranked)
    assert got.count() == len([r for r in rows if r[0] is not None and r[1] is not None])


def test_split_moves_no_rows(spark):
    df = spark.range(2000).select(F.col("id").alias("ID"), (F.col("id") % 2).cast("int").alias("Default"), F.lit("x").alias("wide"))
    text = plan(prep.stratified_split(df))
    assert "Window" not in text and "Aggregate" not in text


def test_validity_is_that_of_the_messages(spark):
    rules = [V.Rule("a", 0, 10), V.Rule("b", 0, 5, True), V.Rule("c", lo=1), V.Rule("d", integral=True), V.Rule("e", 0, 9),
             V.Rule("f", allowed=(0, 1)), V.Rule("g"), V.Rule("h", hi=3, integral=True)]
    nan, inf = float("nan"), float("inf")
    good = (1.0, 1, 2.0, 3.0, "4", 1, "x", 2.0)
    odd = [(None, nan, inf, -inf, -1.0, 10.0, 11.0), (None, 0, 5, 6, -1), (None, nan, 0.5, 1.0, inf), (None, nan, 0.5, inf, -2.0),
           (None, "10", "9", "-1"), (None, 0, 2), (None, ""), (None, nan, 3.0, 2.5, 4.0, -inf)]
    rows = [good] + [good[:i] + (v,) + good[i + 1:] for i, values in enumerate(odd) for v in values]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e string, f int, g string, h float")
    v = V.validate(df, rules)
    assert v.columns[-2:] == ["errors", "is_valid"]
    found = v.select("is_valid", F.size("errors").alias("n")).collect()
    assert all(r["is_valid"] is (r["n"] == 0) for r in found)
    assert {r["is_valid"] for r in found} == {True, False}
    assert "required" not in plan(v.where("is_valid").select("a"))
