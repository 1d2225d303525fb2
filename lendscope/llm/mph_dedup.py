"""Exact dedup against a minimal perfect hash over the distinct digests seen before.

The history (rows that arrived earlier) is reduced to one row per distinct
SHA-256 digest with its winner.  Each hash bucket of digests gets a minimal
perfect hash: level by level, keys whose position in a bit array of the level
is theirs alone are placed, the others go on to the next level; a key's slot
is the number of set bits before its own.  Slots hold the full digest and the
winner's locator.  Arrivals are reduced to distinct digests as well, looked up
in the bucket's hash and compared byte for byte with the slot's digest (a
perfect hash gives every stranger some slot too).  Members are repeats of the
slot's winner, nonmembers are grouped among themselves.

Scale: texts are read once and only (doc_id, 32-byte digest) goes on.  Groups
of copies are reduced map-side before any shuffle, so a digest with a third of
all rows reaches a bucket as one row; giving results back to the rows uses
``join_hot_split``.  A bucket holds about BUCKET_KEYS digests of each side at
any size, whichever side is the larger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot_split, materialize, table, with_row_key

BUCKET_KEYS = 1024
GAMMA = 2  # bits of a level for each key that reaches it


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _words(digests: list[bytes]) -> np.ndarray:
    """First 128 bits of each digest as two 64-bit words."""
    return np.frombuffer(b"".join(d[:16] for d in digests), dtype="<u8").reshape(-1, 2)


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mix(words[:, 0] ^ _mix(words[:, 1], 2 * level + 1), 2 * level + 2) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Minimal perfect hash: bit arrays of the levels, one after another."""

    sizes: list[int]
    bits: np.ndarray  # bool, all levels

    @classmethod
    def build(cls, digests: list[bytes]) -> PerfectHash:
        """Digests have to be distinct in their first 16 bytes."""
        rest, sizes, bits = _words(digests), [], []
        while len(rest):
            size = max(8, GAMMA * len(rest))
            at = _position(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool))

    def slots(self, digests: list[bytes]) -> np.ndarray:
        """Slot of each digest; strangers get any slot, or -1."""
        words, out = _words(digests), np.full(len(digests), -1, dtype=np.int64)
        before = np.cumsum(self.bits) - 1
        open_, start = np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes):
            at = start + _position(words[open_], level, size)
            here = self.bits[at]
            out[open_[here]] = before[at[here]]
            open_, start = open_[~here], start + size
        return out

    def pack(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=int(sum(sizes)))
        return cls([int(s) for s in sizes], bits.astype(bool))


INDEX_SCHEMA = "bucket long, sizes array<int>, bits binary, digests binary, winners array<long>, counts array<long>"
LOOKUP_SCHEMA = "digest binary, keep_id long, group_size long, member boolean"


def _build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = [bytes(d) for d in pdf["digest"]]
    mph = PerfectHash.build(digests)
    order = np.argsort(mph.slots(digests))
    return pd.DataFrame({
        "bucket": [int(pdf["bucket"].iloc[0])], "sizes": [mph.sizes], "bits": [mph.pack()],
        "digests": [b"".join(digests[i] for i in order)],
        "winners": [[None if pd.isna(v) else int(v) for v in pdf["keep_id"].iloc[order]]],
        "counts": [[int(v) for v in pdf["group_size"].iloc[order]]],
    })


def _lookup_bucket(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(new):
        return pd.DataFrame({"digest": [], "keep_id": [], "group_size": [], "member": []})
    digests = [bytes(d) for d in new["digest"]]
    keep = [None if pd.isna(v) else int(v) for v in new["keep_id"]]
    size = [int(v) for v in new["group_size"]]
    member = [False] * len(digests)
    if len(index):
        row = index.iloc[0]
        store, winners, counts = bytes(row["digests"]), row["winners"], row["counts"]
        slots = PerfectHash.unpack(list(row["sizes"]), bytes(row["bits"])).slots(digests)
        for i, s in enumerate(slots.tolist()):
            if s >= 0 and store[32 * s:32 * s + 32] == digests[i]:
                member[i] = True
                known = [v for v in (keep[i], winners[s]) if v is not None and not pd.isna(v)]
                keep[i], size[i] = int(max(known)) if known else None, size[i] + int(counts[s])
    return pd.DataFrame({"digest": digests, "keep_id": pd.array(keep, dtype="Int64"), "group_size": size, "member": member})


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest doc_id and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Minimal perfect hash of each bucket of distinct digests, with its slots."""
    keyed = history.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandas(_build_bucket, INDEX_SCHEMA)


def probe(arrivals: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Look distinct arrivals up; members come back with the winner over both sides."""
    keyed = arrivals.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return (keyed.groupBy("bucket").cogroup(index.groupBy("bucket"))
            .applyInPandas(_lookup_bucket, LOOKUP_SCHEMA))


def exact_dedup(docs: DataFrame, historical: Column, text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, in_history.

    ``historical`` tells the rows that arrived before the others.  Of equal
    texts the row with the largest doc_id stays.  Null texts count as empty.
    Rows repeated with one doc_id are one document: all of them stay or go.
    A null doc_id wins only where its group has no other.  An empty table
    gives an empty result; other columns of ``docs`` are not looked at, but
    ``row`` may name one that tells rows apart: it is given back as ``_row``.
    """
    keys = ["_row"] if row else []
    rows = materialize(docs.select(
        *[F.col(row).alias(k) for k in keys],
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"),
        F.coalesce(historical, F.lit(False)).alias("historical")), "dedup-digests")
    total, past = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("historical").cast("long")), F.lit(0))).first()
    buckets = max(1, max(past, total - past) // BUCKET_KEYS)
    history = distinct_digests(rows.where("historical"))
    index = materialize(build_index(history, buckets), "dedup-index")
    found = probe(distinct_digests(rows.where(~F.col("historical"))), index, buckets)
    # A member's row has the larger winner and the larger count of the two.
    groups = materialize(
        found.unionByName(history.withColumn("member", F.lit(False))).groupBy("digest")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
             F.max("member").alias("repeats_history")), "dedup-groups")
    return join_hot_split(rows, groups, "digest", "group_size", total).select(
        *keys, "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("historical").alias("in_history"), "repeats_history")


def earlier_arrivals(doc_id: str = "doc_id") -> Column:
    """The fixture's history: documents with an odd seeded hash arrived earlier."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(2)) == 1


def op2_mph_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: about half are history, the others arrive; every row is returned."""
    return exact_dedup(table(spark, sf_dir, "documents"), earlier_arrivals()).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row per distinct text, the one with the largest id (of equal ids the first row)."""
    keyed, key = with_row_key(docs, "dedup-rows")
    kept = (exact_dedup(keyed, earlier_arrivals(), row=key).where("kept")
            .groupBy("text_sha256").agg(F.min("_row").alias(key)).select(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
