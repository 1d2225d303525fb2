"""N-gram Jaccard join by parity sketches.

A document's tokens are its distinct five-word shingles, hashed to 64 bits.
Its parity sketch has one bit per hash value, flipped by every token with that
value, so two sketches differ in at most as many bits as the token sets differ
in tokens.  With 100 * |A and B| >= 75 * |A or B| the sets differ in at most
d = (|A| + |B|) // 7 tokens.  The sketch is cut into blocks (ranges of hash
values; how many depends on the size band), of which at most d differ: so two
linked documents agree in all but d of their non-empty blocks, and if each
passes on its d + 1 rarest blocks, in one order for all, they meet in one.
Blocks are passed on as 64-bit fingerprints.  A band is the number of blocks
that the smaller document's size asks for; a document joins the bands of all
smaller sizes it may be linked to, down to three quarters of its own.

First, documents that can't be linked with any are set apart: a linked one has
at least three quarters of its tokens in common with another document, so one
with fewer tokens that occur elsewhere (told by 32 bits and the bucket of their
hash: never too few) has no part in what follows.

Documents that meet form buckets.  A bucket is not expanded into pairs: all
members are compared with one hub, first by folded sketches of about as many
bits as tokens (their distance is a lower bound too), then by their whole sets.  Links make
components.  Buckets that reach over several components by then are opened:
their documents (which hold every link not found yet) pass on their rarest
tokens, the smaller of two linked documents n - ceil(6 n / 7) + 1 and the larger
m - ceil(3 m / 4) + 1 of them, in one order for all, of which the two share one.
Documents of different components that share one so are compared as before.
So no link between components is lost, and a passage that many documents share
brings two of them together only where it is most of the smaller one.

Scale: of every document's tokens 4 bytes each, and a gap to the token's
document, go to buckets of about BUCKET_BYTES of text; a chunk of documents gets
back which of its tokens occur elsewhere.  Tokens that occur twice in a chunk
are sent once.  The texts that are left are written.  Entries of blocks are
shuffled as packed arrays, 12 bytes an entry plus the documents' numbers.
Entries that meet within a task are joined there and one of them goes on, so a
fingerprint with a third of all documents comes as one entry a task.  The order
of blocks comes from counts over the documents that are left in 2^20 cells
(1 MB); it decides what is passed on, not what is found.  Texts are written or
shuffled only if their document may be in a pair: a bit map of MAP_BITS bits
(2 MB) holds hashes of those documents and is looked up while scanning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot_split, materialize, materialize_in_small_batches, table, with_row_key
from .components import connected_components
from .hashing import mix, shingle_sets

WORDS = 5
CELLS = 1 << 20
CELL_PARTS = 64
MIN_BITS = 512  # of the folded sketch that is compared first
BLOCK_BYTES = 400_000  # of texts that are hashed together
CHUNK_ENTRIES = 500_000
TOKEN_CHUNK = 1_000_000  # tokens of documents that are asked about together
BUCKET_BYTES = 32 << 20  # of text whose tokens come to one bucket
MAP_BITS = 1 << 24
MAP_PARTS = 64
PAIRS_PER_SALT = 2000
NO_ID = 1 << 62  # documents without id are numbered from here, by their text
U = np.uint64


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of one text's shingles."""
    return shingle_sets([text], WORDS)[0]


def text_blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about BLOCK_BYTES of text each, with their token sets."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_BYTES)) + 1
    for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(batch)].tolist(), strict=True):
        part = batch.slice(a, b - a)
        if len(part):
            yield part, *shingle_sets(part.column(column).to_pylist(), WORDS)


def band(n: int) -> int:
    """Blocks of a size's sketch are given by so many leading bits of the hash; 64: every token is a block."""
    if n < 64:
        return 64
    return (n - 1).bit_length() if n < 256 else (n - 1).bit_length() - 1


def bands(n: int) -> list[tuple[int, int]]:
    """(band, d) of each band a document of n tokens joins: d bounds the differing blocks there."""
    least, out = -(-3 * n // 4), []
    for b in sorted({band(least), band(n), *(band(x) for x in (64, 256) if least <= x <= n),
                     *(band(x) for x in (63, 255) if least <= x <= n)}):
        # The largest partner: a document of this band that is not larger, or any if n is the smaller one.
        partner = 4 * n // 3 if b == band(n) else n
        out.append((b, (n + partner) // 7))
    return out


@lru_cache(maxsize=100_000)
def _bands(n: int) -> tuple[tuple[int, int], ...]:
    return tuple(bands(n)) if n else ()


def blocks(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(fingerprints, entry bounds, document, band, d) of the non-empty blocks, for each document and each band it joins.

    A fingerprint is the XOR over a block's tokens, with band and block.
    """
    n = np.diff(bounds)
    joins = [(i, b, d) for i, k in enumerate(n.tolist()) for b, d in _bands(k)]
    if not joins:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), np.zeros(1, np.int64), none, none, none
    doc, band_, d = (np.array(x, dtype=np.int64) for x in zip(*joins, strict=True))
    size = n[doc]
    begin = np.concatenate([[0], np.cumsum(size)])
    entry = np.repeat(np.arange(len(doc)), size)
    t = tokens[np.arange(begin[-1]) + np.repeat(bounds[doc] - begin[:-1], size)]
    bits = band_[entry].astype(np.uint64)
    with np.errstate(over="ignore"):
        at = t >> (U(64) - bits)  # band 64: the token itself
        first = np.ones(len(t), dtype=bool)
        first[1:] = (at[1:] != at[:-1]) | (entry[1:] != entry[:-1])
        first = np.flatnonzero(first)
        prints = mix(np.bitwise_xor.reduceat(mix(t ^ U(0x5851F42D4C957F2D)), first) ^ mix(at[first] * U(128) + bits[first]))
    return prints, np.searchsorted(entry[first], np.arange(len(doc) + 1)), doc, band_, d


def passed_on(tokens: np.ndarray, bounds: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, document of each) under which the documents may meet others: the d + 1 rarest blocks."""
    prints, cuts, doc, band_, d = blocks(tokens, bounds)
    # Rarity first, then the fingerprint, in one word (its last 8 bits don't decide).
    key = (rarity[prints >> U(44)].astype(np.uint64) << U(56)) | (prints >> U(8))
    out, owner = [], []
    for i, (a, b, most) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), d.tolist(), strict=True)):
        if b - a <= most:  # too few blocks for the bound: all of them, and a mark that all such documents of the band share
            out += [prints[a:b], mix(np.array([band_[i] + (1 << 32)], dtype=np.uint64))]
            owner.append(b - a + 1)
        elif b - a == most + 1:
            out.append(prints[a:b])
            owner.append(b - a)
        else:
            out.append(prints[a:b][np.argpartition(key[a:b], most)[:most + 1]])
            owner.append(most + 1)
    return (np.concatenate(out), np.repeat(doc, owner)) if out else (prints, doc)


def sketches_of(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each document's parity sketch folded to a power of two of bits, at least its number of tokens, as 64-bit words."""
    n = np.diff(bounds)
    bits = np.array([max(MIN_BITS, 1 << (int(k) - 1).bit_length()) if k else MIN_BITS for k in n.tolist()], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    place = begin[:-1].repeat(n) + (tokens & (bits.repeat(n) - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=begin[-1]) & 1).astype(np.uint8)
    words = np.packbits(odd, bitorder="little").view(np.int64)
    return [words[a // 64:b // 64] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def node_of(doc_id: Column, text: Column) -> Column:
    """Number of a document: its id, or one from the text where there is none."""
    own = F.lit(NO_ID) + F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(NO_ID - 1))
    return F.coalesce(doc_id.cast("long"), own)


def _gaps(places: np.ndarray) -> bytes:
    """Rising numbers as their differences, one byte each if they fit, behind the width."""
    g = np.diff(places, prepend=0)
    width = 1 if g.max(initial=0) < 256 else 4
    return bytes([width]) + g.astype(f"<u{width}").tobytes()


def _from_gaps(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1), dtype=np.int64)


def _met(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted numbers: is it the first of its equals, and does it have equals."""
    first = np.ones(len(sorted_), dtype=bool)
    first[1:] = sorted_[1:] != sorted_[:-1]
    last = np.ones(len(sorted_), dtype=bool)
    last[:-1] = first[1:]
    return first, ~(first & last)


def with_linkable(docs: DataFrame) -> DataFrame:
    """(node, doc_id, n_shingles, linkable) of each row of ``docs`` (doc_id, text, node).

    ``linkable``: three quarters of its tokens occur in other rows too, so it may be linked.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES)
    of_chunk = ["nodes", "ids", "sizes", "shared"]
    of_chunk_types = "nodes array<long>, ids array<long>, sizes array<long>, shared array<long>"
    lists = [pa.list_(pa.int64())] * 4
    none = [None] * 4

    def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        nodes: list[pa.Array] = []
        ids: list[pa.Array] = []

        def flush() -> Iterator[pa.RecordBatch]:
            n, t = np.concatenate(sizes), np.concatenate(tokens)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.argsort(t)
            first, more = _met(t[order])
            shared = np.bincount(owner[order[more]], minlength=len(n))
            once, seen = np.sort(order[~more]), order[first & more]
            for x in (tokens, sizes):
                x.clear()
            bucket, bucket_seen = ((t[x] >> U(32)) % U(parts) for x in (once, seen))
            by, by_seen = np.argsort(bucket, kind="stable"), np.argsort(bucket_seen, kind="stable")
            cuts, cuts_seen = np.searchsorted(bucket[by], np.arange(parts + 1)), np.searchsorted(bucket_seen[by_seen], np.arange(parts + 1))
            once, seen = once[by], seen[by_seen]
            rows = [(int(chunk % parts), chunk, None, None, None, pa.concat_arrays(nodes).to_pylist(), pa.concat_arrays(ids).to_pylist(), n.tolist(), shared.tolist())]
            for k in np.flatnonzero(np.diff(cuts) + np.diff(cuts_seen)).tolist():
                asked = once[cuts[k]:cuts[k + 1]]
                rows.append((k, chunk, t[asked].astype(np.uint32).tobytes(), _gaps(owner[asked]),
                             t[seen[cuts_seen[k]:cuts_seen[k + 1]]].astype(np.uint32).tobytes(), *none))
            for x in (nodes, ids):
                x.clear()
            for k in range(0, len(rows), 64):
                yield batch_of(rows[k:k + 64], ["bucket", "chunk", "asked", "owner", "seen", *of_chunk],
                               [pa.int32(), pa.int64(), *[pa.binary()] * 3, *lists])

        held = 0
        for batch in batches:
            for part, t, bounds in text_blocks(batch, 2):
                tokens.append(t)
                sizes.append(np.diff(bounds))
                nodes.append(part.column(0))
                ids.append(part.column(1))
                held += len(t) + 32 * len(part)
                if held >= TOKEN_CHUNK:
                    yield from flush()
                    chunk, held = chunk + 1, 0
        if sizes:
            yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["chunk", "owner", *of_chunk], [pa.int64(), pa.binary(), *lists]
        buckets: dict[int, list[tuple]] = {}
        for batch in batches:
            own = batch.filter(pc.is_valid(batch.column(5)))
            if len(own):
                yield pa.RecordBatch.from_arrays([own.column(1), pa.nulls(len(own), pa.binary()), *own.columns[5:]], names)
            batch = batch.filter(pc.is_null(batch.column(5)))
            for k, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                buckets.setdefault(k, []).append(row)
        for k in list(buckets):
            chunks, asked, owner, seen = zip(*buckets.pop(k), strict=True)
            cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in asked])])
            t = np.frombuffer(b"".join([*asked, *seen]), dtype=np.uint32)
            order = np.argsort(t)
            more = np.zeros(len(t), dtype=bool)
            more[order] = _met(t[order])[1]
            # A hash that another chunk has seen twice is among its equals here; one that is only seen has no owner.
            rows = []
            for c, o, a, b in zip(chunks, owner, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if more[a:b].any():
                    rows.append((c, _gaps(_from_gaps(o)[more[a:b]]), *none))
            for i in range(0, len(rows), 64):
                yield batch_of(rows[i:i + 64], names, kinds)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        chunks: list[tuple] = []

        def add(chunk: int, more: np.ndarray) -> None:
            had = counts.get(chunk, more[:0])
            if len(had) < len(more):
                had, more = more, had
            had[:len(more)] += more
            counts[chunk] = had

        for batch in batches:
            for chunk, owner, nodes, ids, sizes, shared in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if owner is not None:
                    add(chunk, np.bincount(_from_gaps(owner)))
                else:
                    add(chunk, np.array(shared, dtype=np.int64))
                    chunks.append((chunk, nodes, ids, np.array(sizes, dtype=np.int64)))
        for chunk, nodes, ids, n in chunks:
            linkable = (n > 0) & (4 * counts.pop(chunk) >= 3 * n)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids, pa.int64()), pa.array(n), pa.array(linkable)],
                                             ["node", "doc_id", "n_shingles", "linkable"])

    return (docs.select("node", "doc_id", "text")
            .mapInArrow(scan, f"bucket int, chunk long, asked binary, owner binary, seen binary, {of_chunk_types}")
            .repartition(parts, "bucket").mapInArrow(answer, f"chunk long, owner binary, {of_chunk_types}")
            .repartition(parts, "chunk").mapInArrow(total, "node long, doc_id long, n_shingles long, linkable boolean"))


def measure(docs: DataFrame) -> DataFrame:
    """Rows (node, n_shingles, sketch) of all documents and (part, cells) counts of each task.

    Parts from CELL_PARTS on count tokens, those before blocks.
    """
    size = CELLS // CELL_PARTS
    names = ["node", "n_shingles", "sketch", "part", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * CELLS, dtype=np.int64)
        waiting: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part, tokens, bounds in text_blocks(batch, 1):
                waiting.append((blocks(tokens, bounds)[0] >> U(44)).astype(np.int64))
                waiting.append((tokens >> U(44)).astype(np.int64) + CELLS)
                held += len(waiting[-1]) + len(waiting[-2])
                if held > 1_000_000:
                    counts += np.bincount(np.concatenate(waiting), minlength=2 * CELLS)
                    waiting, held = [], 0
                n = len(part)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(bounds), pa.int64()),
                    pa.array(sketches_of(tokens, bounds), pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=2 * CELLS)
        small = np.minimum(counts, 65535).astype(np.uint16)  # a task's count; the sum over tasks is not cut
        k = 2 * CELL_PARTS
        parts = [small[i * size:(i + 1) * size].tobytes() for i in range(k)]
        none = [pa.nulls(k, pa.int64()) for _ in range(2)]
        yield pa.RecordBatch.from_arrays([*none, pa.nulls(k, pa.list_(pa.int64())), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select("node", "text").mapInArrow(run, "node long, n_shingles long, sketch array<long>, part int, cells binary")


def rarity_of(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Half-octave classes of the counts of blocks and of tokens, one byte a cell."""
    size = CELLS // CELL_PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.frombuffer(cells, dtype=np.uint16).astype(np.int64)
                sums[part] = sums[part] + a if part in sums else a
        # Classes, not sums: one byte a cell is all that the order needs.
        out = [np.floor(2 * np.log2(a + 1)).astype(np.uint8).tobytes() for a in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array(out, pa.binary())], ["part", "classes"])

    rows = (measured.where(F.col("part").isNotNull()).select("part", "cells").repartition(CELL_PARTS, "part")
            .mapInArrow(add, "part int, classes binary").collect())  # 2 * CELLS bytes in all
    out = np.zeros(2 * CELLS, dtype=np.uint8)
    for r in rows:
        out[r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(r["classes"], dtype=np.uint8)
    return out[:CELLS], out[CELLS:]


EDGE = "print long, a long, b long, n_a int, n_b int, same boolean"


def meetings(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Star edges (a, hub b) of every bucket, with fingerprint and sizes; ``same``: equal sets, surely linked."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(rarity)
    names = ["bucket", "kind", "prints", "owner", "nodes", "sizes"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def stars(prints: np.ndarray, owner: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the entries by fingerprint and node, and for each its run's first entry."""
        order = np.lexsort((nodes[owner], prints))
        p = prints[order]
        head = np.r_[True, p[1:] != p[:-1]]
        return order, np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        prints: list[np.ndarray] = []
        owners: list[np.ndarray] = []  # documents' numbers in ``nodes``
        nodes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        twins: list[tuple[int, int, int]] = []
        first_of: dict[bytes, int] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            node, size = np.concatenate(nodes), np.concatenate(sizes)
            p, owner = np.concatenate(prints), np.concatenate(owners)
            if not len(p):  # texts without words only
                return
            order, first = stars(p, owner, node)
            p, owner = p[order], owner[order]
            alone = first == np.arange(len(p))
            # Entries that meet here: edges to the least node, which alone goes on.
            joined = np.flatnonzero(~alone)
            a, b = owner[joined], owner[first[joined]]
            keep = node[a] != node[b]
            a, b, q = a[keep], b[keep], p[joined][keep]
            rows = []
            home = int(mix(node[:1].view(np.uint64))[0] % U(parts)) if len(node) else 0
            if len(a):
                rows.append((home, 1, q.tobytes(), b"", np.stack([node[a], node[b]]).tobytes(), np.stack([size[a], size[b]]).tobytes()))
            if twins:
                t = np.array(twins, dtype=np.int64)
                rows.append((home, 2, b"", b"", t[:, :2].T.tobytes(), t[:, 2].astype(np.uint32).tobytes()))
            p, owner = p[alone], owner[alone]
            bucket = (p % U(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(edges)):
                at = order[edges[k]:edges[k + 1]]
                need, place = np.unique(owner[at], return_inverse=True)
                rows.append((int(k), 0, p[at].tobytes(), place.astype(np.uint32).tobytes(), node[need].tobytes(), size[need].tobytes()))
            for x in (prints, owners, nodes, sizes, twins):
                x.clear()
            first_of.clear()
            for k in range(0, len(rows), 64):
                yield packed(rows[k:k + 64])

        for batch in batches:
            for part, tokens, bounds in text_blocks(batch, 1):
                node = np.array(part.column(0), dtype=np.int64)
                n = np.diff(bounds)
                once = n > 0
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if a < b:
                        twin = first_of.setdefault(xxhash.xxh3_128_digest(tokens[a:b]), int(node[i]))
                        if twin != node[i]:
                            twins.append((int(node[i]), twin, b - a))
                            once[i] = False
                kept = np.flatnonzero(once)
                tokens = tokens[np.repeat(once, n)]
                f, doc = passed_on(tokens, np.concatenate([[0], np.cumsum(n[kept])]), rare)
                prints.append(f)
                owners.append(doc + sum(map(len, nodes)))
                nodes.append(node[kept])
                sizes.append(n[kept].astype(np.uint32))
                held += len(f)
                if held >= CHUNK_ENTRIES:
                    yield from flush()
                    held = 0
        if prints:
            yield from flush()

    edge_names = ["print", "a", "b", "n_a", "n_b", "same"]

    def edges(prints: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), 100_000):
            s = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints[s].view(np.int64)), pa.array(a[s]), pa.array(b[s]), pa.array(n_a[s].astype(np.int32)),
                 pa.array(n_b[s].astype(np.int32)), pa.array(np.full(len(a[s]), same))], edge_names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, owner, nodes, sizes = [], [], [], []
        n = 0
        for batch in batches:
            for kind, p, o, v, s in zip(*[batch.column(i).to_pylist() for i in range(1, 6)], strict=True):
                p, v, s = np.frombuffer(p, dtype=np.uint64), np.frombuffer(v, dtype=np.int64), np.frombuffer(s, dtype=np.uint32)
                if kind == 0:
                    prints.append(p)
                    owner.append(np.frombuffer(o, dtype=np.uint32).astype(np.int64) + n)
                    nodes.append(v)
                    sizes.append(s)
                    n += len(v)
                elif kind == 1:
                    yield from edges(p, *v.reshape(2, -1), *s.reshape(2, -1), False)
                else:
                    pair = v.reshape(2, -1)
                    yield from edges(np.zeros(len(s), dtype=np.uint64), *pair, s, s, True)
        if not prints:
            return
        p, o, v, s = (np.concatenate(x) for x in (prints, owner, nodes, sizes))
        del prints, owner, nodes, sizes
        # Fingerprints of one document only (most of them) go first.
        order = np.argsort(p)
        p, o = p[order], o[order]
        twice = np.r_[False, p[1:] == p[:-1]]
        twice[:-1] |= twice[1:]
        p, o = p[twice], o[twice]
        if not len(p):
            return
        order, first = stars(p, o, v)
        p, o = p[order], o[order]
        a, b = o, o[first]
        differ = v[a] != v[b]
        a, b = a[differ], b[differ]
        yield from edges(p[differ], v[a], v[b], s[a], s[b], False)

    return (docs.select("node", "text").mapInArrow(scan, "bucket int, kind int, prints binary, owner binary, nodes binary, sizes binary")
            .repartition(parts, "bucket").mapInArrow(meet, EDGE))


def _places(nodes: np.ndarray) -> np.ndarray:
    return (mix(nodes.astype(np.int64).view(np.uint64)) % U(MAP_BITS)).astype(np.int64)


def _bits_at(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 > 0


def bit_map(wanted: DataFrame) -> np.ndarray:
    """One bit for each hash of a wanted node, MAP_BITS in all, packed."""
    size = MAP_BITS // MAP_PARTS
    names = ["part", "bits"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(MAP_BITS, dtype=bool)
        for batch in batches:
            on[_places(np.array(batch.column(0)))] = True
        if on.any():
            packed = [np.packbits(x).tobytes() for x in on.reshape(MAP_PARTS, size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(MAP_PARTS), pa.int32()), pa.array(packed, pa.binary())], names)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer(bits, dtype=np.uint8)
                found[part] = found[part] | b if part in found else b
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array([b.tobytes() for b in found.values()], pa.binary())], names)

    schema = "part int, bits binary"
    rows = wanted.mapInArrow(mark, schema).repartition(MAP_PARTS, "part").mapInArrow(union, schema).collect()  # MAP_BITS in all
    out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in rows:
        out[r["part"] * size // 8:(r["part"] + 1) * size // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the documents whose node's bit is set in the map of ``wanted``: all of them, and few others."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.select("node")))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _bits_at(shared.value, _places(np.array(batch.column(0))))
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.select("node", "text").mapInArrow(sift, "node long, text string")


def prefix_entries(docs: DataFrame, wanted: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(token, node, n, c, few) for the rarest tokens of each ``wanted`` (node, c) document.

    Of two linked documents the smaller has one of its n - ceil(6 n / 7) + 1
    rarest tokens (``few``) among the m - ceil(3 m / 4) + 1 rarest of the other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in batches:
            for part, tokens, bounds in text_blocks(batch, 2):
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(part)), n)
                order = np.lexsort((tokens, rare[(tokens >> U(44)).astype(np.int64)], owner))
                place, size = np.arange(len(tokens)) - bounds[owner], n[owner]
                kept = place < size + (-3 * size) // 4 + 1
                of = owner[kept]
                yield pa.RecordBatch.from_arrays([
                    pa.array(tokens[order][kept].view(np.int64)), pa.array(np.array(part.column(0))[of]), pa.array(size[kept].astype(np.int32)),
                    pa.array(np.array(part.column(1))[of]), pa.array((place < size + (-6 * size) // 7 + 1)[kept])], ["token", "node", "n", "c", "few"])

    return (texts_of(docs, wanted).join(wanted, "node").select("node", "c", "text")
            .mapInArrow(run, "token long, node long, n int, c long, few boolean"))


def pairs_across(entries: DataFrame) -> DataFrame:
    """(a, b), a > b: documents of different components that the prefixes leave as candidates; ``entries`` is a written table.

    Pairs inside the largest component of a token are never made: one side of
    the join holds the documents outside it.  A token's documents are dealt by
    PAIRS_PER_SALT.
    """
    per = entries.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"), F.max("few").alias("few"))
    tokens = per.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.sum("k").alias("_n"), F.count(F.lit(1)).alias("parts"),
                                      F.max("few").alias("few")).where("parts > 1 and few").select("token", "most", "_n")
    salts = F.ceil(F.col("_n") / PAIRS_PER_SALT).cast("int")
    kept = materialize(join_hot_split(entries, tokens, "token", "_n", max(1, entries.count()))
                       .select("token", "node", "n", "c", "few", (F.col("c") != F.col("most")).alias("outside"), salts.alias("_salts")), "jac-tokens")
    one = kept.where("outside").select("token", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "node", "n", "c", "few")
    other = kept.select("token", F.pmod(F.xxhash64("node"), F.col("_salts")).cast("int").alias("_salt"), F.col("node").alias("node2"),
                        F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("few").alias("few2"))
    smaller_has = F.when(F.col("n") < F.col("n2"), F.col("few")).when(F.col("n") > F.col("n2"), F.col("few2")).otherwise(F.col("few") | F.col("few2"))
    return (one.join(other, ["token", "_salt"]).where((F.col("c") != F.col("c2")) & _sizes_fit("n", "n2") & smaller_has)
            .select(F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b")).distinct())


def token_sets(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """``roles`` (node, b, _salt, hub) with the tokens of their documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tokens, bounds in text_blocks(batch, 4):
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], sets], ["node", "b", "_salt", "hub", "tokens"])

    return (texts_of(docs, roles).join(roles, "node").select("node", "b", "_salt", "hub", "text")
            .mapInArrow(run, "node long, b long, _salt int, hub boolean, tokens array<long>"))


def _salted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with a salt of their hub b, and the hubs once for each salt: PAIRS_PER_SALT pairs meet one copy."""
    per_hub = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_pairs"))
    salts = F.ceil(F.col("_pairs") / PAIRS_PER_SALT).cast("int")
    salted = (join_hot_split(pairs, per_hub, "b", "_pairs", max(1, pairs.count()))
              .withColumn("_salt", F.pmod(F.xxhash64("a"), salts).cast("int")).select("a", "b", "_salt"))
    return salted, per_hub.select("b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))


def verify(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, written: folded sketches first, then whole sets. ``pairs`` is a written table."""
    salted, hubs = _salted(pairs)
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")).join(hubs, "b")

    def fold(s: str, other: str) -> Column:
        """A sketch of twice the other's bits, folded once (sizes that fit differ by no more)."""
        half = F.size(s) / 2
        once = F.zip_with(F.slice(s, F.lit(1), half.cast("int")), F.slice(s, half.cast("int") + 1, half.cast("int")), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(s) > F.size(other), once).otherwise(F.col(s))

    bits = F.aggregate(F.zip_with(fold("s_a", "s_b"), fold("s_b", "s_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda t, x: t + x)
    near = materialize(salted.join(left, "a").join(right, ["b", "_salt"])
                       .where(_sizes_fit("n_a", "n_b") & (7 * bits <= F.col("n_a") + F.col("n_b")))
                       .select("a", "b").distinct(), "jac-near")
    if near.isEmpty():
        return near
    salted, hubs = _salted(near)
    roles = materialize(salted.select(F.col("a").alias("node"), "b", "_salt", F.lit(False).alias("hub"))
                        .unionByName(hubs.select(F.col("b").alias("node"), "b", "_salt", F.lit(True).alias("hub"))), "jac-roles")
    sets = materialize_in_small_batches(token_sets(docs, roles), "jac-sets")
    both = (sets.where(~F.col("hub")).select(F.col("node").alias("a"), "b", "_salt", F.col("tokens").alias("t_a"))
            .join(sets.where("hub").select("b", "_salt", F.col("tokens").alias("t_b")), ["b", "_salt"]))
    common = F.size(F.array_intersect("t_a", "t_b"))
    union = F.size("t_a") + F.size("t_b") - common
    return materialize(both.where(100 * common >= 75 * union).select("a", "b"), "jac-links").distinct()


def _sizes_fit(a: str, b: str) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and are linked with nothing.  Rows
    that share a doc_id are one document, linked if any of them is.  Rows
    without id are told apart by their texts; their component_id is the least
    id reachable, null if there is none.  An empty table gives an empty result.
    """
    out = linked_nodes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"),
                                   node_of(F.col("doc_id"), F.col(text)).alias("node")))
    return out.select("doc_id", "n_shingles", F.when(F.col("c") < NO_ID, F.col("c")).alias("component_id"))


def linked_nodes(rows: DataFrame) -> DataFrame:
    """(node, doc_id, n_shingles, c) of each of ``rows`` (doc_id, text, node); c is the least node reachable."""
    sizes = materialize_in_small_batches(with_linkable(rows), "jac-sizes")
    rows = materialize_in_small_batches(texts_of(rows, sizes.where("linkable")), "jac-texts")
    measured = materialize_in_small_batches(measure(rows), "jac-sketches")
    of_blocks, of_tokens = rarity_of(measured)
    edges = materialize_in_small_batches(meetings(rows, of_blocks), "jac-edges")
    same = edges.where("same").select("a", "b")
    pairs = materialize(edges.where(~F.col("same")).where(_sizes_fit("n_a", "n_b")).select("a", "b").distinct(), "jac-pairs")
    sketches = measured.where(F.col("part").isNull()).select("node", F.col("n_shingles").alias("n"), "sketch")
    links = verify(pairs, sketches, rows).unionByName(same)
    component = materialize(connected_components(links), "jac-components")

    def labelled(frame: DataFrame, node: str, label: str) -> DataFrame:
        c = component.select(F.col("node").alias(node), F.col("component").alias(label))
        return frame.join(c, node, "left").withColumn(label, F.coalesce(label, node))

    # Documents of buckets that reach over several components may have links that no hub showed.
    star = edges.where(~F.col("same"))
    across = labelled(labelled(star.select("a", "b").distinct(), "a", "c_a"), "b", "c_b").where("c_a <> c_b").select("a", "b")
    open_prints = star.join(across, ["a", "b"], "left_semi").select("print").distinct()
    left = star.join(open_prints, "print", "left_semi")
    wanted = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(labelled(wanted, "node", "c"), "jac-open")
    entries = materialize_in_small_batches(prefix_entries(rows, wanted, of_tokens), "jac-entries")
    fresh = materialize(pairs_across(entries).join(pairs, ["a", "b"], "left_anti"), "jac-across")
    found = verify(fresh, sketches, rows)
    if not found.isEmpty():
        component = materialize(connected_components(links.unionByName(found)), "jac-components")
    return labelled(sizes.select("node", "doc_id", "n_shingles"), "node", "c")


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents, whole texts."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of rows the one with the least id stays (none last; of equal ids the first row)."""
    keyed, key = with_row_key(docs, "near-rows")
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(key).alias("node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node"))
    kept = linked_nodes(rows).groupBy("c").agg(first.alias("first")).select(F.col("first.node").alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)
