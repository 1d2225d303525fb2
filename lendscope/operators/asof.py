"""Forward as-of join: for each left row, the earliest right row of the same
key at or after the left row's time.

Spark has no as-of join.  The plan here cuts time into buckets (hour or
day) per key.  Inside a (key, bucket) a forward-looking window over the
union of both sides finds the in-bucket match; a small per-key table of
bucket minima supplies the earliest right row of a later bucket for the
rest.  A key holding a third of all rows is spread over all of its
buckets instead of landing in one task, and nothing is ever collected per
key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(ts: Column, grain: str) -> Column:
    """A monotone bucket number of a timestamp (TIMESTAMP or TIMESTAMP_NTZ)."""
    day = F.unix_date(F.to_date(ts)).cast("bigint")
    if grain == "day":
        return day
    if grain == "hour":
        return day * 24 + F.hour(ts)
    raise ValueError(f"unknown grain {grain!r}")


def forward_asof(left: DataFrame, right: DataFrame, by: str, left_t: Column, right_t: str,
                 right_order: list[str], grain: str = "day", match: str = "_m") -> DataFrame:
    """Left rows (all columns) plus struct ``match`` of the matching right row.

    The match is the right row of the same ``by`` value with the smallest
    (``right_t``, *``right_order``) such that ``right_t >= left_t``; null if
    none.  A right row at exactly ``left_t`` matches.  A null key equals no
    other: such right rows are left out and such left rows have no match.
    """
    unkeyed, left = left.where(F.col(by).isNull()), left.where(F.col(by).isNotNull())
    right = right.where(F.col(by).isNotNull())
    rfields = [right_t, *right_order] + [c for c in right.columns if c not in (by, right_t, *right_order)]
    rstruct = F.struct(*[F.col(c) for c in rfields])
    rtype = right.select(rstruct).schema[0].dataType
    ltype = left.select(F.struct(*left.columns)).schema[0].dataType
    order_null = F.lit(None).cast(right.select(F.struct(*right_order)).schema[0].dataType)

    lt = left.select(F.col(by).alias("_c"), left_t.alias("_t"), F.struct(*left.columns).alias("_row"))
    lt = lt.select("_c", time_bucket(F.col("_t"), grain).alias("_b"), "_t", F.lit(0).alias("_k"),
                   order_null.alias("_o"), "_row", F.lit(None).cast(rtype).alias("_f"))
    rt = right.select(F.col(by).alias("_c"), time_bucket(F.col(right_t), grain).alias("_b"),
                      F.col(right_t).alias("_t"), F.lit(1).alias("_k"),
                      F.struct(*right_order).alias("_o"), F.lit(None).cast(ltype).alias("_row"),
                      rstruct.alias("_f"))
    w = (Window.partitionBy("_c", "_b").orderBy("_t", "_k", "_o")
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    inb = (lt.unionByName(rt)
           .withColumn(match, F.first("_f", ignorenulls=True).over(w))
           .where(F.col("_k") == 0)
           .select("_c", "_b", "_row", match))

    # Earliest right row of every later bucket.  Keys are (key, bucket):
    # the table grows with the time span, not with the row count.
    fmin = rt.groupBy("_c", "_b").agg(F.min("_f").alias("_fm")).withColumn("_k", F.lit(0))
    lkeys = lt.select("_c", "_b").distinct() \
        .select("_c", "_b", F.lit(None).cast(rtype).alias("_fm"), F.lit(1).alias("_k"))
    wn = Window.partitionBy("_c").orderBy("_b", "_k").rowsBetween(1, Window.unboundedFollowing)
    nxt = (fmin.unionByName(lkeys)
           .withColumn("_nx", F.first("_fm", ignorenulls=True).over(wn))
           .where(F.col("_k") == 1).select("_c", "_b", "_nx"))
    out = inb.join(nxt, ["_c", "_b"], "left")
    return out.select("_row.*", F.coalesce(match, "_nx").alias(match)) \
        .unionByName(unkeyed.withColumn(match, F.lit(None).cast(rtype)))
