"""Order statistics without a single-partition sort.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
The primitives here keep the work spread:

* ``prefix_sums``: running sums in value order.  The rows are dealt by
  ranges of the order that Spark samples from the values, so a range holds
  about as many distinct values as any other whatever the distribution;
  ranges are summed inside (one window partition each) and shifted by the
  running total of the range totals.
* ``quantile_rows``: rank selection by radix.  Doubles have 64-bit keys of
  the same order; every pass counts the next 16-bit digit of the values
  that begin like a wanted one, for all columns and ranks at once.  Four
  passes over a narrow written table give the exact order statistics.
* ``rank_in_class``: exact row numbers per class in seeded-hash order.
  The 32-bit hash is uniform, so its top bits split every class into even
  buckets whatever the class sizes are; a bucket's offset is the running
  count of the earlier buckets of its class.
* ``first_of_class``: whether a row is among the first of its class in that
  order.  Only the hash and id of the last such row are looked for, so no
  row is moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import seeded_u32
from ..session import written

NBUCKETS = 1024
HASH_BUCKET_BITS = 12
DIGITS = (16, 12, 12, 12, 12)  # bits of a key that each pass settles


def bucket_count(df: DataFrame, least: int = NBUCKETS) -> int:
    """Buckets of a rank operator: several for each shuffle partition, so parallelism follows the cluster's."""
    return max(least, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df``, evaluated once and written, with ``_b``, the number of the range of ``order`` that a row lies in."""
    return written(written(df, "prefix-rows").repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "prefix-ranges")


def prefix_sums(df: DataFrame, order_col: str, cols: list[str], suffix: str = "_cum", by: list[str] | None = None) -> DataFrame:
    """Inclusive running sums of ``cols`` in ascending ``order_col`` order.

    ``df`` should hold one row per distinct ``order_col`` value (group
    first), so ties are summed together as an ECDF needs.  ``by`` restarts
    the sums per group (e.g. per column of an unpivoted table).  ``df`` is
    evaluated once and written; its ranges are written too, so that totals
    and rows see the same ones.
    """
    by = list(by or [])
    d = ranged(df, [*by, order_col])
    tot = d.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"{c}_bt") for c in cols])
    # one row per range (and group): the window over range totals is bounded by the shuffle partitions
    w_off = (Window.partitionBy(*by) if by else Window).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "_b", *[F.coalesce(F.sum(f"{c}_bt").over(w_off), F.lit(0)).alias(f"{c}_off")
                                  for c in cols])
    w_in = Window.partitionBy(*by, "_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(c).over(w_in).alias(f"{c}_in") for c in cols]).join(F.broadcast(off), by + ["_b"])
    for c in cols:
        d = d.withColumn(f"{c}{suffix}", F.col(f"{c}_in") + F.col(f"{c}_off")).drop(f"{c}_in", f"{c}_off")
    return d.drop("_b")


def order_keys(v: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the doubles ``v`` (both zeros have one key)."""
    bits = (v + 0.0).view(np.uint64)
    negative = (bits >> np.uint64(63)).astype(bool)
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


def key_value(key: int) -> float:
    """The double whose key is ``key``."""
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(float)[0])


def as_doubles(df: DataFrame, cols: list[str], *more: str) -> DataFrame:
    """The columns as doubles v0, v1, ... (NaN is missing); ``more`` are kept as they are."""
    v = [F.col(c).cast("double") for c in cols]
    return df.select(*[F.when(~F.isnan(x), x).alias(f"v{i}") for i, x in enumerate(v)], *more)


def narrow(df: DataFrame, cols: list[str], *more: str) -> DataFrame:
    """``as_doubles``, written once."""
    return written(as_doubles(df, cols, *more), "narrow")


def _tables(batches: Iterator[pa.RecordBatch], size: int = 1 << 16) -> Iterator[pa.Table]:
    """The rows of a partition, about ``size`` at a time."""
    parts, n = [], 0
    for b in batches:
        parts.append(b)
        n += b.num_rows
        if n >= size:
            yield pa.Table.from_batches(parts)
            parts, n = [], 0
    if n:
        yield pa.Table.from_batches(parts)


def packed_keys(values: DataFrame, n_cols: int) -> DataFrame:
    """Keys of the columns v0, v1, ... (``as_doubles``), written: a row has the different keys (k0, k1, ...) of some 2 ** 16 rows and how
    often each occurs (n0, n1, ...), so the passes over them cost bytes, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tables(batches):
            out = []
            for i in range(n_cols):
                keys, n = np.unique(order_keys(t[f"v{i}"].drop_null().to_numpy()), return_counts=True)
                out += [pa.array([keys.tobytes()], pa.binary()), pa.array([n.astype(np.int32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names)

    names = [f"{c}{i}" for i in range(n_cols) for c in "kn"]
    return written(values.select(*[f"v{i}" for i in range(n_cols)]).mapInArrow(run, ", ".join(f"{c} binary" for c in names)), "order-keys")


Asked = dict[int, dict[int, list[tuple[int, int]]]]  # of each column: wanted prefixes, and the (rank, place among their values) in them


def _digits(packed: DataFrame, asked: Asked, done: int, bits: int, shares: list[float]) -> list:
    """(column, prefix, all, rank, digit, left): the digit of ``bits`` behind ``done`` settled bits of every wanted rank, and its place
    among the values that have it; without settled bits the ranks are those of ``shares``, and ``all`` is the number of values.

    A task adds up the digits that it meets; they are added up and looked through on the executors, prefix by prefix.
    """
    tables = {i: np.sort(np.array(list(prefixes), np.uint64)) for i, prefixes in asked.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: np.zeros(len(prefixes) << bits, np.int64) for i, prefixes in tables.items()}
        for b in batches:
            for i, prefixes in tables.items():
                for held, n in zip(b[f"k{i}"], b[f"n{i}"], strict=True):
                    keys, times = np.frombuffer(held.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int32)
                    cell = ((keys >> np.uint64(64 - bits - done)) & np.uint64((1 << bits) - 1)).view(np.int64)
                    if done:
                        head = keys >> np.uint64(64 - done)
                        at = np.minimum(np.searchsorted(prefixes, head), len(prefixes) - 1)
                        mine = np.flatnonzero(prefixes.take(at) == head)
                        cell, times = at.take(mine) << bits | cell.take(mine), times.take(mine)
                    totals[i] += np.bincount(cell, times, len(totals[i])).astype(np.int64)
        for i, total in totals.items():
            for slot, n in enumerate(total.reshape(-1, 1 << bits)):
                digit = np.flatnonzero(n)
                if len(digit):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (i, slot, digit.astype(np.int32).tobytes(), n[digit].tobytes())],
                                                     ["column", "slot", "digits", "n"])

    def choose(part: pa.Table) -> pa.Table:
        i, slot = part["column"][0].as_py(), part["slot"][0].as_py()
        total = np.zeros(1 << bits, np.int64)
        for digit, n in zip(part["digits"], part["n"], strict=True):
            total[np.frombuffer(digit.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int64)
        upto, prefix = np.cumsum(total), int(tables[i][slot])
        size = int(upto[-1])
        ranks = asked[i][prefix] if done else [(r, r) for r in sorted({f((size - 1) * share) for share in shares for f in (math.floor, math.ceil)})]
        left = np.array([place for _, place in ranks], np.int64)
        digit = np.searchsorted(upto, left, side="right")
        found = [np.full(len(ranks), i), np.full(len(ranks), slot), np.full(len(ranks), size), np.array([r for r, _ in ranks], np.int64),
                 digit, left - upto[digit] + total[digit]]
        return pa.table([pa.array(c) for c in found], names=["column", "slot", "all", "rank", "digit", "left"])

    # bounded by columns x shares x 2
    rows = (packed.select(*[c for i in asked for c in (f"k{i}", f"n{i}")]).mapInArrow(count, "column long, slot long, digits binary, n binary")
            .groupBy("column", "slot").applyInArrow(choose, "column long, slot long, all long, rank long, digit long, left long").collect())
    return [(r["column"], int(tables[r["column"]][r["slot"]]), r["all"], r["rank"], r["digit"], r["left"]) for r in rows]


def order_statistics(values: DataFrame, n_cols: int, shares: list[float]) -> tuple[list[int], dict[tuple[int, int], float]]:
    """(non-missing values of each column of ``as_doubles``, {(column, rank from 0): value}); ``values`` is evaluated once.

    The ranks are those on both sides of (n - 1) * share.  Counts stay on the
    executors: at most 2 ** 16 per column, then 2 ** 12 per prefix; one row per
    wanted rank comes to the driver.
    """
    packed = packed_keys(values, n_cols)
    sizes, state = [0] * n_cols, {}
    asked: Asked = {i: {0: []} for i in range(n_cols)}
    done = 0
    for bits in DIGITS:
        for i, prefix, size, rank, digit, left in _digits(packed, asked, done, bits, shares) if asked else []:
            if not done:
                sizes[i] = size
            state[i, rank] = prefix << bits | digit, left
        asked = {}
        for (i, rank), (prefix, left) in sorted(state.items()):
            asked.setdefault(i, {}).setdefault(prefix, []).append((rank, left))
        done += bits
    return sizes, {k: key_value(prefix) for k, (prefix, _) in state.items()}


def quantile_rows(values: DataFrame, n_cols: int, qs: list[float]) -> list[tuple[int, float, float | None, int]]:
    """(column index, q, quantile, n) with linear interpolation (pandas / numpy default); null for empty columns."""
    sizes, at = order_statistics(values, n_cols, qs)
    out = []
    for i, n in enumerate(sizes):
        for q in qs:
            if not n:
                out.append((i, q, None, 0))
                continue
            pos = (n - 1) * q
            lo, hi = at[i, math.floor(pos)], at[i, math.ceil(pos)]
            out.append((i, q, lo if lo == hi else lo + (pos - math.floor(pos)) * (hi - lo), n))
    return out


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    """``quantile_rows`` of the columns as a table (column, q, quantile, n); one row per column and quantile."""
    return df.sparkSession.createDataFrame(quantile_rows(as_doubles(df, cols), len(cols), qs), "column int, q double, quantile double, n long")


def rank_in_class(df: DataFrame, class_col: str | None, id_col: str, seed: int | str = 42,
                  rank_col: str = "rank", size_col: str | None = None) -> DataFrame:
    """1-based rank per class by md5('<seed>|<id>') then id.

    Optionally adds ``size_col`` with the class size.
    """
    h = seeded_u32(seed, F.col(id_col))
    bits = min(32, max(HASH_BUCKET_BITS, math.ceil(math.log2(bucket_count(df)))))
    d = df.withColumn("_h", h).withColumn("_hb", F.shiftright("_h", 32 - bits))
    keys = [class_col] if class_col else []
    cnt = d.groupBy(*keys, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    # at most 2^bits rows per class
    w_off = (Window.partitionBy(*keys) if keys else Window).orderBy("_hb") \
        .rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(*keys, "_hb", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"),
                     *([F.sum("_n").over(Window.partitionBy(*keys) if keys else Window.partitionBy())
                        .alias(size_col)] if size_col else []))
    w = Window.partitionBy(*keys, "_hb").orderBy("_h", id_col)
    d = d.withColumn("_rn", F.row_number().over(w))
    # the offsets table is bounded by classes x 2^bits
    d = d.join(F.broadcast(off), keys + ["_hb"])
    return d.withColumn(rank_col, (F.col("_rn") + F.col("_off")).cast("bigint")).drop("_h", "_hb", "_rn", "_off")


def first_of_class(df: DataFrame, class_col: str, id_col: str, share: float, seed: int | str = 42, flag: str = "is_first") -> DataFrame:
    """``flag``: whether ``rank_in_class`` is at most round(share * class size); rows without class or id are left out.

    The rank is not made: the class's bucket counts say in which bucket its
    last such row lies, and only that bucket is put in order.  Rows compare
    their hash and id with that row's (one row per class is broadcast).  Where
    copies of one id lie on both sides of it, the ranks decide.
    """
    bits = min(32, max(HASH_BUCKET_BITS, math.ceil(math.log2(bucket_count(df)))))
    slim = df.select(F.col(class_col).alias("_class"), F.col(id_col).alias("_id"), seeded_u32(seed, F.col(id_col)).alias("_h"))
    # rows without id come first in the order, as in the ranks, and are left out at the end
    d = written(slim.where("_class is not null"), "class-hashes").withColumn("_hb", F.shiftright("_h", 32 - bits))
    # at most 2^bits rows per class
    along = Window.partitionBy("_class").orderBy("_hb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cnt = d.groupBy("_class", "_hb").agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"_upto": F.sum("_n").over(along), "_size": F.sum("_n").over(Window.partitionBy("_class"))})
    left = F.round(F.col("_size") * share) - (F.col("_upto") - F.col("_n"))
    last = cnt.withColumn("_left", left).where("_left >= 1 and _left <= _n").select("_class", "_hb", "_left")
    # one row per class
    bucket = d.join(F.broadcast(last), ["_class", "_hb"]).withColumn("_rn", F.row_number().over(
        Window.partitionBy("_class", "_hb").orderBy("_h", "_id")))
    ends = written(bucket.where("_rn >= _left and _rn <= _left + 1").groupBy("_class").agg(
        F.min_by(F.struct("_h", "_id"), "_rn").alias("_last"),
        ((F.count(F.lit(1)) == 2) & (F.min(F.struct("_h", "_id")) == F.max(F.struct("_h", "_id")))).alias("_cut")), "class-ends")
    if not ends.where("_cut").isEmpty():
        r = rank_in_class(df, class_col, id_col, seed, rank_col="_rank", size_col="_size")
        return r.withColumn(flag, F.col("_rank") <= F.round(F.col("_size") * share)).drop("_rank", "_size")
    # one row per class: a bounded broadcast
    ends = ends.select(F.col("_class").alias(class_col), "_last")
    j = df.withColumn("_h", seeded_u32(seed, F.col(id_col))).where(F.col(class_col).isNotNull() & F.col("_h").isNotNull())
    j = j.join(F.broadcast(ends), class_col, "left")
    h, last_h = F.col("_h"), F.col("_last._h")
    first = (h < last_h) | ((h == last_h) & (F.col(id_col) <= F.col("_last._id")))
    return j.withColumn(flag, F.coalesce(first, F.lit(False))).drop("_h", "_last")
