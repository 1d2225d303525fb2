"""Prefix tree of conversations, built as a z-fast trie.

Every prefix of a conversation has a 128-bit fingerprint (``paths``).  The
compacted trie is a table: a node is the end of an edge (``pe``, ``e``] of the
path of its ``owner``, and its handle is the fingerprint of the owner's prefix
of the two-fattest length in that interval (the one divisible by the greatest
power of two).  Conversations are inserted in batches:

1. fat binary search: all pending conversations probe the handles at the
   two-fattest length of their open interval, log2(turns) times, which leaves
   the deepest node whose handle each has, and with it the exit edge;
2. the places that agree with that edge's path give the length shared with it;
3. of the conversations that leave an edge at one place by one turn, the least
   in a seeded order is inserted, and each that ends on an edge; edges split
   there, and the handles of the pieces are taken anew.

A random one of a group leaves at most half of it together in half the cases,
so the batches number O(log n), whatever the depth.  Then the edges are expanded:
the row of every turn that an inserted conversation added is one node, with the
figures of the compacted node its edge ends in.

Scale: no conversation is held in one row, no family in one group.  Paths are
rows (conversation, depth), numbered and summed in two levels, so a conversation
of a third of all turns spreads.  Members are added up by partial aggregates.  Lists of members are hashed in
order from pieces of 1,024 ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot_split, materialize, table, with_row_key

HEAD_TURNS, FAMILY = 9, 5  # fixed values of the contract: h = crc32 % 9, families of 5 conversations
BLOCK = 4096  # turns of one conversation that a window task takes together
SHORT = 1024  # turns up to which a conversation carries its fingerprints in one row
PIECE = 1024  # ids of one node's list in a row
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, n_bytes) of every turn with a conv_id, in order of turn, nulls first.

    Turns of one number are ordered by their digest; null role and text are empty.
    The rows are sorted over ranges of (conversation, turn), so a long
    conversation lies in several.
    """
    rows, key = with_row_key(conversations, "trie-turns")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.col(key).alias("_key"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "_key"]
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "digest", "n_bytes", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "trie-order")
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("conv_id", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).select(
        "conv_id", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(starts, ["conv_id", "_range"]).select("conv_id", (F.col("_at") + F.col("_shift")).alias("pos"), "digest", "n_bytes")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, n, pos, digest, n_bytes) and all conversations (conv_id, n), turnless ones too.

    Conversation c takes the first h turns of c - c % 5, then its own after its first h.
    """
    turns = materialize(turns, "trie-numbered")
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % HEAD_TURNS
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = materialize(
        lengths.select("conv_id", "own", (c - c % FAMILY).alias("base"), h.alias("h")).join(bases, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
        .select("conv_id", "own", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "trie-convs")
    total = turns.count()
    heads = turns.where(F.col("pos") < HEAD_TURNS).withColumnRenamed("conv_id", "base")
    taken = heads.join(convs, "base").where("pos <= taken").select("conv_id", "n", "pos", "digest", "n_bytes")
    rest = (join_hot_split(turns, convs.where("own > h"), "conv_id", "own", total).where("pos > h")
            .select("conv_id", "n", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_bytes"))
    return taken.unionByName(rest), convs.select("conv_id", "n")


def fingerprints(turns: DataFrame) -> DataFrame:
    """(conv_id, n, d, key, bytes, upto): the fingerprint of the first d turns and the bytes of their texts.

    Each turn and its place give two 64-bit hashes of its SHA-256 digest; a
    prefix has their sums, taken in blocks of BLOCK turns.
    """
    rows = turns.select("conv_id", "n", F.col("pos").alias("d"), F.col("n_bytes").alias("bytes"),
                        F.floor((F.col("pos") - 1) / BLOCK).alias("_block"),
                        *[F.xxhash64(F.lit(i), "pos", "digest").cast("decimal(20,0)").alias(f"_{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv_id", "_block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "n", "d", "bytes", "_block", *[F.sum(c).over(inside).cast("decimal(38,0)").alias(s)
                                                               for c, s in (("_1", "s1"), ("_2", "s2"), ("bytes", "s3"))])
    # Only conversations of several blocks carry sums over.
    long = rows.where((F.col("n") > BLOCK) & ((F.col("d") % BLOCK == 0) | (F.col("d") == F.col("n"))))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = long.select("conv_id", "_block", *[F.coalesce(F.sum(s).over(earlier).cast("decimal(38,0)"), F.lit(0)).alias(f"c{s}") for s in ("s1", "s2", "s3")])
    whole = (rows.where(F.col("n") > BLOCK).join(carried, ["conv_id", "_block"])
             .withColumns({s: (F.col(s) + F.col(f"c{s}")).cast("decimal(38,0)") for s in ("s1", "s2", "s3")}).select(rows.columns)
             .unionByName(rows.where(F.col("n") <= BLOCK)))
    return whole.select("conv_id", "n", "d", F.unhex(F.md5(F.concat_ws(":", "d", "s1", "s2"))).alias("key"), "bytes", F.col("s3").cast("long").alias("upto"))


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] divisible by the greatest power of two."""
    top = F.length(F.bin(a.bitwiseXOR(b))) - 1  # the highest bit in which they differ
    power = F.pow(F.lit(2.0), top).cast("long")
    return b - b % power


class Trie:
    """The compacted trie and the conversations not inserted yet; what several steps read is written.

    Where no conversation is longer than SHORT, each carries its fingerprints in
    one array; else they are joined from ``paths``, one row each.  Joins of many
    rows with one node are split by adaptive execution (one row a key on the
    node's side).
    """

    def __init__(self, paths: DataFrame, sequences: DataFrame, total: int) -> None:
        self.paths, self.total = paths.select("x", "d", "key"), total
        self.deepest = sequences.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        self.pending = sequences.select("x", "n", F.xxhash64(F.lit("trie"), "x").alias("r"))
        self.short = self.deepest <= SHORT
        if self.short:
            keys = self.paths.groupBy("x").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "key"))), lambda s: s["key"]).alias("keys"))
            self.whole = materialize(keys, "trie-keys")
            self.pending = self.pending.join(self.whole, "x")
        else:
            self.pending = self.pending.withColumn("keys", F.lit(None).cast("array<binary>"))
        self.pending = materialize(self.pending, "trie-pending")
        self.placed: list[DataFrame] = []
        self.nodes: DataFrame | None = None

    def mine(self, rows: DataFrame, d: Column, name: str, x: str = "x") -> DataFrame:
        """Adds ``name``, the fingerprint of the first ``d`` turns of ``x`` (whose array ``rows`` have); null for none."""
        if self.short:
            return rows.withColumn(name, F.get("keys", (d - 1).cast("int")))
        p = self.paths.select(F.col("x").alias("_x"), F.col("d").alias("_d"), F.col("key").alias(name))
        return rows.withColumn("_at", d).join(p, (F.col(x) == F.col("_x")) & (F.col("_at") == F.col("_d")), "left").drop("_x", "_d", "_at")

    def look_up(self, rows: DataFrame, probe: str, key: str, prefix: str) -> DataFrame:
        """Left join with the node that has ``key`` = ``probe``, under ``prefix``."""
        found = self.nodes.select(F.col(key).alias("_key"), *[F.col(c).alias(prefix + c) for c in ("owner", "pe", "e", "key", "f")])
        return rows.join(found, F.col(probe) == F.col("_key"), "left").drop("_key")

    def search(self) -> DataFrame:
        """Fat binary search: v_ holds the deepest node whose handle is a prefix (null: the root)."""
        names = {"v_owner": "long", "v_pe": "long", "v_e": "long", "v_key": "binary", "v_f": "long"}
        state = self.pending.select("x", "n", "r", "keys", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"),
                                    *[F.lit(None).cast(t).alias(c) for c, t in names.items()])
        for step in range(int(self.deepest).bit_length()):
            # A finished interval probes nothing.
            f = F.when(F.col("a") < F.col("b"), two_fattest(F.col("a"), F.col("b")))
            tried = self.look_up(self.mine(state.withColumn("f", f), F.col("f"), "h"), "h", "handle", "t_")
            hit = F.col("t_owner").isNotNull()
            # Beyond the conversation's end there is nothing to probe, so an extent that long ends the search.
            state = tried.select("x", "n", "r", "keys", F.when(hit, F.least("t_e", "b")).otherwise(F.col("a")).alias("a"),
                                 F.when(F.col("f").isNotNull() & ~hit, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
                                 *[F.when(hit, F.col(c.replace("v_", "t_"))).otherwise(F.col(c)).alias(c) for c in names])
            if step % 5 == 4:
                state = materialize(state, "trie-search")
        return state

    def exits(self) -> DataFrame:
        """(x, n, r, keys, shared, b_*): the edge each pending conversation leaves (null: none) and the length shared with it."""
        if self.nodes is None:
            return self.pending.select("*", F.lit(0).cast("long").alias("shared"), *[
                F.lit(None).cast("long").alias(c) for c in ("b_owner", "b_pe", "b_e")], F.lit(None).cast("binary").alias("b_key"))
        e = F.coalesce("v_e", F.lit(0).cast("long"))
        state = self.mine(self.mine(self.search(), F.col("v_e"), "here"), e + 1, "next")
        through = F.col("v_e").isNull() | F.coalesce(F.col("here") == F.col("v_key"), F.lit(False))
        state = self.look_up(state.withColumn("through", through).withColumn("next", F.when(through, F.col("next"))), "next", "first", "c_")
        inside = F.col("c_owner").isNotNull()
        edge = {c: F.when(inside, F.col(f"c_{c}")).when(~F.col("through"), F.col(f"v_{c}")) for c in ("owner", "pe", "e", "key")}
        low = F.when(inside, F.col("c_pe") + 1).when(~F.col("through"), F.col("v_f")).otherwise(e)
        state = state.select("x", "n", "r", "keys", *[v.alias(f"b_{c}") for c, v in edge.items()], low.alias("lo"))
        state = state.withColumn("hi", F.when(F.col("b_owner").isNull(), F.col("lo")).otherwise(F.least("n", F.col("b_e") - 1)))
        # Prefixes agree up to the place where two paths part, so the shared length is the number of places that agree.
        if self.short:
            theirs = self.whole.select(F.col("x").alias("b_owner"), F.col("keys").alias("theirs"))
            places = F.when(F.col("lo") < F.col("hi"), F.sequence(F.col("lo"), F.col("hi") - 1))
            same = F.size(F.filter(places, lambda i: F.get("keys", i.cast("int")) == F.get("theirs", i.cast("int"))))
            state = state.join(theirs, "b_owner", "left").withColumn("shared", F.col("lo") + F.coalesce(F.when(places.isNotNull(), same), F.lit(0)))
            return state.select("x", "n", "r", "keys", "shared", "b_owner", "b_pe", "b_e", "b_key")
        state = materialize(state, "trie-exit")
        theirs = self.paths.select(F.col("x").alias("b_owner"), "d", F.col("key").alias("theirs"))
        along = (join_hot_split(self.paths, state.where("lo < hi").select("x", "n", "b_owner", "lo", "hi"), "x", "n", self.total)
                 .where("d > lo and d <= hi").join(theirs, ["b_owner", "d"]))
        same = along.where(F.col("key") == F.col("theirs")).groupBy("x").agg(F.count(F.lit(1)).alias("same"))
        return state.join(same, "x", "left").withColumn("shared", F.col("lo") + F.coalesce("same", F.lit(0))).drop("lo", "hi", "same")

    def insert_batch(self) -> None:
        """One batch: splits, new leaves, handles; the inserted are kept in ``placed`` as (x, shared)."""
        out = materialize(self.mine(self.exits(), F.col("shared") + 1, "branch"), "trie-exits")
        row = ["r", "x", "n", "shared", "b_owner", "b_pe", "b_e", "b_key"]
        # The least of a branch in the seeded order; conversations that end on an edge or node are a branch each.
        chosen = (out.groupBy(F.coalesce("branch", F.unhex(F.hex("x"))).alias("_of"))
                  .agg(F.min(F.struct(*row)).alias("m")).select("m.*"))
        done = materialize(chosen, "trie-chosen")
        self.placed.append(done.select("x", "shared"))
        cuts = done.where("b_owner is not null").select("b_owner", "b_pe", "b_e", "b_key", F.col("shared").alias("e")).distinct()
        # Cuts of one edge are as many as its turns at most; the window streams over them.
        along = Window.partitionBy("b_key").orderBy("e")
        upper = cuts.select(F.col("b_owner").alias("owner"), F.coalesce(F.lag("e").over(along), F.col("b_pe")).alias("pe"), "e")
        lower = cuts.groupBy("b_owner", "b_e", "b_key").agg(F.max("e").alias("pe"))
        leaves = done.where("n > shared").select(F.col("x").alias("owner"), F.col("shared").alias("pe"), F.col("n").alias("e"))
        fresh = upper.unionByName(lower.select(F.col("b_owner").alias("owner"), "pe", F.col("b_e").alias("e"))).unionByName(leaves)
        fresh = fresh.withColumn("f", two_fattest(F.col("pe"), F.col("e")))
        if self.short:
            fresh = fresh.join(self.whole.withColumnRenamed("x", "owner"), "owner")
        for name, d in (("key", F.col("e")), ("first", F.col("pe") + 1), ("handle", F.col("f")), ("parent", F.col("pe"))):
            fresh = self.mine(fresh, d, name, "owner")
        fresh = fresh.select("owner", "pe", "e", "f", "key", "first", "handle", "parent")
        if self.nodes is not None:
            fresh = self.nodes.join(lower.select(F.col("b_key").alias("key")), "key", "left_anti").select(fresh.columns).unionByName(fresh)
        self.nodes = materialize(fresh, "trie-nodes")
        self.pending = materialize(out.select("x", "n", "r", "keys").join(done.select("x"), "x", "left_anti"), "trie-pending")

    def build(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, placed) of all sequences; some log2 of their number batches."""
        while not self.pending.isEmpty():
            self.insert_batch()
        return self.nodes, reduce(DataFrame.unionByName, self.placed)


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the decimal conv_ids that end at a node, ascending, comma-joined.

    Members are sorted over ranges of (key, conv_id) and cut into pieces of PIECE ids; the pieces of a
    key are hashed one after another, so no list is held whole.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []
        for batch in batches:
            out = []
            for key, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key != at or len(ids) == PIECE:
                    out += [(at, ids)] if ids else []
                    at, ids = key, []
                ids.append(c)
            yield _pieces(out)
        yield _pieces([(at, ids)] if ids else [])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = h = None
        for batch in batches:
            keys, found = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == at:
                    h.update(b",")
                else:
                    if h:
                        keys.append(at)
                        found.append(h.hexdigest())
                    at, h = key, hashlib.sha256()
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])
        last = [(at, h.hexdigest())] if h else []
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in last], pa.binary()), pa.array([s for _, s in last], pa.string())], ["key", "ends_sha256"])

    cut = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        pieces, "key binary, first long, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(digests, "key binary, ends_sha256 string")


def _pieces(rows: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([k for k, _ in rows], pa.binary()), pa.array([i[0] for _, i in rows], pa.int64()),
        pa.array([",".join(map(str, i)) for _, i in rows], pa.string())], ["key", "first", "ids"])


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations (see the contract's columns), the root included.

    ``turns``: conv_id, n (turns of the conversation), pos from 1, digest (of
    role and text), n_bytes; ``convs``: conv_id, n, once each, turnless ones
    too.  Without any conversation there is no root and the result is empty.
    Conversations equal in all turns are members of one end node.  Prefixes are
    told apart by their depth and 128 bits of fingerprint.
    """
    spark = turns.sparkSession
    prints = materialize(fingerprints(turns), "trie-prints")
    convs = materialize(convs, "trie-members")
    n_convs, least = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not n_convs:
        return spark.createDataFrame([], SCHEMA)
    members = prints.where("d = n").select("key", "conv_id", "n", "upto")
    sequences = materialize(members.groupBy("key").agg(
        F.min("conv_id").alias("x"), F.count(F.lit(1)).alias("w"), F.first("n").alias("n"), F.first("upto").alias("whole")), "trie-sequences")
    total = prints.count()
    paths = materialize(join_hot_split(prints.drop("n").withColumnRenamed("conv_id", "x"), sequences.select("x", "n"), "x", "n", total)
                        .select("x", "d", "key", "bytes", "upto"), "trie-paths")
    root = F.lit(b"")
    closing = members.select("key", "conv_id").unionByName(convs.where("n = 0").select(root.alias("key"), "conv_id"))
    lists = materialize(ends(closing), "trie-ends")
    if sequences.isEmpty():
        nodes = placed = None
        first_turns, leaves, saved = 0, 1, 0
    else:
        nodes, placed = Trie(paths, sequences, total).build()
        children = nodes.groupBy(F.coalesce("parent", root).alias("key")).agg(F.count(F.lit(1)).alias("children"))
        # Of every sequence: weight, whether its end has no child, bytes up to where it was inserted.
        head = paths.select("x", F.col("d").alias("shared"), F.col("upto").alias("headed"))
        info = materialize(
            sequences.join(placed, "x").join(head, ["x", "shared"], "left").join(children, "key", "left")
            .select("x", "n", "w", "whole", "shared", F.coalesce("headed", F.lit(0)).alias("headed"),
                    F.col("children").isNull().cast("long").alias("leaf")), "trie-info")
        first_turns = (children.where(F.col("key") == root).agg(F.sum("children")).first()[0])
        leaves, saved = info.agg(F.sum("leaf"), F.sum(F.col("w") * F.col("whole") - (F.col("whole") - F.col("headed")))).first()
    sha = lists.where(F.col("key") == root).agg(F.first("ends_sha256")).first()[0] or NOTHING
    top = spark.createDataFrame([(least, 0, None, n_convs, int(first_turns), int(leaves), int(saved), sha)], SCHEMA)
    if nodes is None:
        return top
    before = F.col("upto") - F.col("bytes")
    walked = materialize(join_hot_split(paths, info, "x", "n", total), "trie-walked")
    # A compacted node's figures are added up over the paths of the sequences through it; rows of
    # other prefixes meet no node and go.
    gain = F.col("w") * (F.col("whole") - before) - (F.col("whole") - F.greatest("headed", before))
    nothing = {c: F.lit(None).cast("long") for c in ("e", "pe")} | {"parent": F.lit(None).cast("binary")}
    through = walked.select("key", "w", "x", "leaf", gain.alias("gain"), *[v.alias(c) for c, v in nothing.items()])
    marked = nodes.select("key", *[F.lit(None).cast("long").alias(c) for c in ("w", "x", "leaf", "gain")], "e", "pe", "parent")
    stats = (through.unionByName(marked).groupBy("key").agg(
        F.sum("w").alias("n_convs"), F.min("x").alias("least"), F.sum("leaf").alias("n_leaves"), F.sum("gain").alias("gain"),
        F.max("e").alias("e"), F.max("pe").alias("pe"), F.max("parent").alias("parent")).where("e is not null")
        .join(children, "key", "left"))
    stats = materialize(stats.withColumn("children", F.coalesce("children", F.lit(0))).withColumn("parent", F.coalesce("parent", root)), "trie-stats")
    # The parent's least member; a parent may have a third of all nodes as children.
    above = stats.select(F.col("key").alias("parent"), F.col("least").alias("above"), F.col("children").alias("_n"))
    below = join_hot_split(stats.where(F.col("parent") != root), above, "parent", "_n", stats.count()).drop("_n").unionByName(
        stats.where(F.col("parent") == root).withColumn("above", F.lit(least)))
    full = below.join(lists, "key", "left").select("key", F.struct("e", "pe", "n_convs", "least", "n_leaves", "gain", "children", "above", "ends_sha256").alias("v"))
    # Expansion: each turn that a sequence added, with the node its edge ends in, the next one along the path.
    owned = walked.where("d > shared").select("x", "d", "key", before.alias("before"), F.floor((F.col("d") - 1) / BLOCK).alias("_block"))
    owned = owned.join(full, "key", "left").withColumn("v", F.when(F.col("v").isNotNull(), F.struct("v.*", F.col("before").alias("at_end"))))
    inside = Window.partitionBy("x", "_block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    owned = materialize(owned.withColumn("v", F.last("v", ignorenulls=True).over(inside)), "trie-owned")
    later = Window.partitionBy("x").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (owned.groupBy("x", "_block").agg(F.min_by("v", "d").alias("_v"))
               .select("x", "_block", F.last("_v", ignorenulls=True).over(later).alias("_v")))
    open_ = owned.where("v is null").drop("v").join(carried, ["x", "_block"]).withColumnRenamed("_v", "v")
    rows = owned.where("v is not null").unionByName(open_.select(owned.columns)).select("d", "before", "v.*")
    at_end = F.col("d") == F.col("e")
    return top.unionByName(rows.select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") - 1 == F.col("pe"), F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("gain") + (F.col("n_convs") - 1) * (F.col("at_end") - F.col("before"))).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256")))


def shared_head_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations.

    Rows without conv_id belong to no conversation.  Null turns come first, null
    role or text is empty, repeated rows are turns of their own, turns of one
    number are ordered by their digest.  An empty table gives an empty result;
    other columns are not read.
    """
    return prefix_trie(*with_shared_heads(numbered_turns(conversations)))


def op11_zfast_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rebuilt with the heads of their families."""
    return shared_head_trie(table(spark, sf_dir, "conversations"))
