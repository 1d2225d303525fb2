"""Alert cooldown (MON-9): an alert is sent unless an alert of the same type
was *sent* less than ``minutes`` before it.

The rule depends on the last sent alert, so it is a fold, not a window
``lag``.  Folding a whole type in one task would put a hot type (a third
of all alerts) on one core, so the fold is turned into graph steps:

1. ``next(a)``: the first alert of the type at or after a.ts + cooldown
   (forward as-of join, bucketed by hour).
2. The sent alerts are the chain first -> next -> next ...  Pointer
   doubling builds next^(2^k) for k = 0.. until every pointer runs past
   the end, then walks the chain top-down: O(log chain length) joins.
   The chain length is bounded by (time span / cooldown) per type, not by
   the number of alerts.

Each doubling level is checkpointed into the cluster's checkpoint folder
to cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .asof import forward_asof

# Fixed value: cooldown of the alerting system.
COOLDOWN_MINUTES = 60


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cooldown(alerts: DataFrame, type_col: str = "type", ts_col: str = "timestamp", id_col: str = "alert_id",
             minutes: int = COOLDOWN_MINUTES, grain: str = "hour") -> DataFrame:
    """Input rows plus boolean ``sent``."""
    ev = alerts.select(F.col(id_col).alias("_id"), F.col(type_col).alias("_ty"), F.col(ts_col).alias("_ts"))
    nxt = forward_asof(ev, ev.select("_ty", F.col("_ts").alias("_nts"), F.col("_id").alias("_nid")),
                       "_ty", F.col("_ts") + F.make_dt_interval(mins=F.lit(minutes)), "_nts", ["_nid"], grain)
    jump = _cut(nxt.select("_id", F.col("_m._nid").alias("_to")))
    levels = [jump]
    while jump.where(F.col("_to").isNotNull()).limit(1).count() > 0:
        a, b = jump.alias("a"), jump.alias("b")
        jump = _cut(a.join(b, F.col("a._to") == F.col("b._id"), "left")
                    .select(F.col("a._id").alias("_id"), F.col("b._to").alias("_to")))
        levels.append(jump)
    # First alert per type (one row per type).
    first = ev.groupBy("_ty").agg(F.min(F.struct("_ts", "_id")).alias("_f")).select(F.col("_f._id").alias("_id"))
    sent = first
    for lvl in reversed(levels[:-1]):
        step = sent.join(lvl, "_id").where(F.col("_to").isNotNull()).select(F.col("_to").alias("_id"))
        sent = _cut(sent.unionByName(step))
    flags = sent.select(F.col("_id").alias(id_col), F.lit(True).alias("sent"))
    return alerts.join(flags, id_col, "left").withColumn("sent", F.coalesce(F.col("sent"), F.lit(False)))
