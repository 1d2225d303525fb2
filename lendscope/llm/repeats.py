"""Removal of repeated passages by an enhanced suffix array and its interval tree.

A byte goes if a string of ``min_len`` bytes over it also starts earlier (in a
document of smaller id, or earlier in the same one).  All documents can't be
sorted as one suffix array, so equal windows of min_len bytes are first brought
together: every window belongs to the least hash of the GRAM-byte strings in it,
so equal windows belong to equal grams, and consecutive windows of one gram form
a super-window (about one for every 35 bytes).  Super-windows that are equal as
a whole are settled at once: all but the first go.  Where a gram has different
super-windows, one of each goes on with its text to the gram's group.

A group's texts are put into an enhanced suffix array: suffixes in order, common
prefixes of neighbours and the byte before each suffix.  A stack scan over the
common prefixes gives the tree of intervals of at least min_len; an interval
whose members are preceded by different bytes is a maximal repeat (else a longer
one covers it) and is given with all its occurrences, of which all but the first
are removed.

Scale: super-windows are shuffled as packed arrays, about 15 bytes each, and
equal ones of a task count once.  A gram with very many different super-windows
(a passage that a third of all documents quote) is split over salts; what the
splits have in common is found by window hashes, with a minimum that is partial
before the shuffle.  Texts are shuffled twice, compressed: to cut the groups'
texts and to cut the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot_split, materialize, table
from .hashing import Hashes, mix
from .parity_join import node_of

GRAM = 32
TILE = 1_000_000  # window starts that are hashed at once
MAX_RUN = 400  # starts of a super-window; longer runs (periodic texts) are cut
CHUNK_SUPERS = 1_000_000
HOT_LOCAL = 64  # different super-windows of one gram in a task from which the gram is split
GROUP = 2000  # super-windows of a group that is not split
SUFFIX_CHUNK = 400_000  # bytes of a suffix array
U = np.uint64
AT = U((1 << 21) - 1)  # positions in a tile
INNER = 1 << 15  # mark in the packed length


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def super_windows(data: np.ndarray, owner: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """(start, end, gram hash, content hash, inner) of the super-windows of a tile; windows stay in one owner.

    ``inner`` tells that the gram occurs more than once in the super-window:
    only then may windows within it be equal.
    """
    gram, width = min(GRAM, min_len), min_len - min(GRAM, min_len) + 1
    if len(data) < min_len:
        e = np.zeros(0, np.int64)
        return e, e, e.view(np.uint64), e.view(np.uint64), e.astype(bool)
    h = Hashes(data)
    grams = h.grams(gram)
    # Hash and position in one word: the least gram of every window, the first and the last of equals.
    at, high = np.arange(len(grams), dtype=np.uint64), grams & ~AT
    first_at = sliding_min(high | at, width) & AT
    last_at = AT - (sliding_min(high | (AT - at), width) & AT)
    least = grams[first_at.astype(np.int64)]
    valid = owner[:len(least)] == owner[min_len - 1:]
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (owner[1:len(least)] != owner[:len(least) - 1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(least)] - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    if len(first) and int((last - first).max()) >= MAX_RUN:
        n = (last - first) // MAX_RUN + 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, last = np.repeat(first, n) + step * MAX_RUN, np.repeat(last, n)
        last = np.minimum(last, first + MAX_RUN - 1)
    end = last + min_len
    return first, end, least[first], h.of(first, end), first_at[first] != last_at[last]


def tiles(texts: list[bytes], min_len: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, number of the text, offset in it) of tiles; a long text is cut with min_len - 1 bytes of overlap."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def join() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = [len(t) for _, _, t in held]
        owner = np.repeat(np.array([i for i, _, _ in held], dtype=np.int64), lengths)
        begin = np.cumsum([0, *lengths[:-1]])
        offset = np.arange(sum(lengths)) - np.repeat(begin - np.array([o for _, o, _ in held]), lengths)
        return np.frombuffer(b"".join(t for _, _, t in held), dtype=np.uint8), owner, offset

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - min_len + 1), TILE):
            part = t if len(t) <= TILE else t[a:a + TILE + min_len - 1]
            if held and size + len(part) > TILE:
                yield join()
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield join()


FOUND = "node long, start long, end long, grp long, split boolean"


def find_supers(docs: DataFrame, min_len: int) -> DataFrame:
    """Removed stretches (grp null) and the super-windows that go on to a group, by document."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["bucket", "kind", "grams", "contents", "places", "nodes"]
    place_type = np.dtype([("owner", "<u4"), ("start", "<u4"), ("n", "<u2")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            node, start, end, gram, content, inner = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((start, node, content, gram))
            node, start, end, gram, content, inner = (x[order] for x in (node, start, end, gram, content, inner))
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            new = new_gram | np.r_[True, content[1:] != content[:-1]]
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            gone = ~new & ((node != node[head]) | (start != start[head]))
            # How many different super-windows each gram has in this task.
            gram_no = np.cumsum(new_gram) - 1
            hot = (np.bincount(gram_no, new) > HOT_LOCAL)[gram_no]
            home = int(mix(node[:1].view(np.uint64))[0] % U(parts))
            rows = []

            def pack(bucket: int, kind: int, at: np.ndarray) -> tuple:
                at = at[np.lexsort((start[at], node[at]))]
                need, owner = np.unique(node[at], return_inverse=True)
                place = np.zeros(len(at), dtype=place_type)
                place["owner"], place["start"], place["n"] = owner, start[at], end[at] - start[at] + INNER * inner[at]
                with_gram = kind != 1
                return (bucket, kind, (gram[at] >> U(32)).astype(np.uint32).tobytes() if with_gram else b"",
                        content[at].tobytes() if with_gram else b"", squeeze.compress(place.tobytes()), need.tobytes())

            if gone.any():
                rows.append(pack(home, 1, np.flatnonzero(gone)))
            for kind, key, pick in ((0, gram, new & ~hot), (2, content, new & hot), (3, gram, new_gram & hot)):
                at = np.flatnonzero(pick)
                bucket = (key[at] % U(parts)).astype(np.int64)
                at = at[np.argsort(bucket, kind="stable")]
                edges = np.searchsorted(np.sort(bucket), np.arange(parts + 1))
                rows += [pack(int(k), kind, at[edges[k]:edges[k + 1]]) for k in np.flatnonzero(np.diff(edges))]
            held.clear()
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 64], strict=True), kinds, strict=True)], names)

        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                ids = np.array(part.column(0), dtype=np.int64)
                for data, owner, offset in tiles([(t.as_py() or "").encode() for t in part.column(1)], min_len):
                    first, end, gram, content, inner = super_windows(data, owner, min_len)
                    if len(first):
                        start = offset[first]
                        held.append((ids[owner[first]], start, start + end - first, gram, content, inner))
                        n_held += len(first)
                if n_held >= CHUNK_SUPERS:
                    yield from flush()
                    n_held = 0
        if held:
            yield from flush()

    out_names = ["node", "start", "end", "grp", "split"]

    def found(node: np.ndarray, start: np.ndarray, end: np.ndarray, grp: np.ndarray | None, split: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(node), 100_000):
            s = slice(k, k + 100_000)
            n = len(node[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[s]), pa.array(start[s].astype(np.int64)), pa.array(end[s].astype(np.int64)),
                 pa.nulls(n, pa.int64()) if grp is None else pa.array(grp[s].view(np.int64)),
                 pa.nulls(n, pa.bool_()) if split is None else pa.array(split[s])], out_names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        plain: list[tuple[np.ndarray, ...]] = []
        hot: list[tuple[np.ndarray, ...]] = []
        marks: list[np.ndarray] = []
        number = 0
        for batch in batches:
            for number, kind, gram, content, place, node in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                gram = np.frombuffer(gram, dtype=np.uint32)
                if kind == 3:
                    marks.append(gram)
                    continue
                at = np.frombuffer(expand.decompress(place), dtype=place_type)
                owner, start = np.frombuffer(node, dtype=np.int64)[at["owner"]], at["start"].astype(np.int64)
                end, inner = start + at["n"] % INNER, at["n"] >= INNER
                if kind == 1:
                    yield from found(owner, start, end, None, None)
                else:
                    (hot if kind == 2 else plain).append((owner, start, end, gram, np.frombuffer(content, dtype=np.uint64), inner))
        marked = np.unique(np.concatenate(marks)) if marks else np.zeros(0, dtype=np.uint32)
        for entries, is_hot in ((plain, False), (hot, True)):
            if not entries:
                continue
            node, start, end, gram, content, inner = (np.concatenate(x) for x in zip(*entries, strict=True))
            order = np.argsort(gram, kind="stable")
            g = gram[order]
            # Grams of one super-window only (most of them) are done, unless it repeats itself.
            more = np.r_[False, g[1:] == g[:-1]]
            more[:-1] |= more[1:]
            more |= is_hot | np.isin(g, marked) | inner[order]
            order = order[more]
            if not len(order):
                continue
            node, start, end, gram, content, inner = (x[order] for x in (node, start, end, gram, content, inner))
            order = np.lexsort((start, node, content, gram))
            node, start, end, gram, content, inner = (x[order] for x in (node, start, end, gram, content, inner))
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            new = new_gram | np.r_[True, content[1:] != content[:-1]]
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            gone = np.flatnonzero(~new & ((node != node[head]) | (start != start[head])))
            yield from found(node[gone], start[gone], end[gone], None, None)
            gram_no = np.cumsum(new_gram) - 1
            kinds = np.bincount(gram_no, new).astype(np.int64)[gram_no]
            split = is_hot | (kinds > GROUP) | np.isin(gram, marked)
            on = np.flatnonzero(new & ((kinds > 1) | split | inner))
            salts = np.maximum(1, -(-kinds[on] // GROUP)).astype(np.uint64)
            with np.errstate(over="ignore"):
                salt = np.where(split[on], mix(content[on]) % salts + U(1), U(0)) + (U(number) << U(32) if is_hot else U(0))
                grp = mix(gram[on].astype(np.uint64) + (U(0) if is_hot else U(number) << U(32)) ^ mix(salt))
            yield from found(node[on], start[on], end[on], grp, split[on])

    return (docs.select("node", "text").mapInArrow(scan, "bucket int, kind int, grams binary, contents binary, places binary, nodes binary")
            .repartition(parts, "bucket").mapInArrow(meet, FOUND))


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:end] by their first ``depth`` bytes, and each one's common
    prefix with the one before (0 for the first)."""
    room = np.concatenate([data, np.zeros(depth, dtype=np.uint8)])
    width = depth + 1
    rows = np.lib.stride_tricks.sliding_window_view(room, depth)[starts]
    left = ends - starts
    rows = np.where(np.arange(depth) < left[:, None], rows, 0).astype(np.uint8)
    # The closing byte keeps byte strings from being compared without their trailing zeros.
    closed = np.concatenate([rows, np.ones((len(rows), 1), dtype=np.uint8)], axis=1)
    order = np.argsort(np.ascontiguousarray(closed).view(f"S{width}").ravel(), kind="stable")
    sorted_ = rows[order]
    lcp = np.zeros(len(order), dtype=np.int64)
    differ = sorted_[1:] != sorted_[:-1]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    reach = np.minimum(left[order], depth)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(reach[1:], reach[:-1]))
    return order, lcp


def intervals(lcp: np.ndarray, min_len: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of the nodes of the interval tree with at least ``min_len`` in common, by a stack scan."""
    deep = np.flatnonzero(lcp >= min_len)
    if not len(deep):
        return
    cut = np.flatnonzero(np.diff(deep) > 1)
    for a, b in zip(np.r_[0, cut + 1].tolist(), np.r_[cut, len(deep) - 1].tolist(), strict=True):
        low, high = int(deep[a]), int(deep[b])
        if (lcp[low:high + 1] == lcp[low]).all():  # one node: nothing to stack
            yield low - 1, high, int(lcp[low])
            continue
        stack: list[tuple[int, int]] = []  # (first member, length)
        for i, n in enumerate([*lcp[low:high + 1].tolist(), 0], low):
            first = i - 1
            while stack and stack[-1][1] > n:
                first, length = stack.pop()
                yield first, i - 1, length
            if n >= min_len and (not stack or stack[-1][1] < n):
                stack.append((first, n))


def repeat_groups(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, min_len: int,
                  depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, int]]]:
    """The suffix array, its common prefixes, and the maximal repeats as (all members, length).

    ``left`` is the byte before each suffix, or a negative number of its own
    where that isn't known, which counts as different from all others.
    """
    order, lcp = suffix_array(data, starts, ends, depth)
    before = left[order]
    # Changes of the left byte along the array: an interval without any is extended by a longer repeat.
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    out = []
    for lo, hi, n in intervals(lcp, min_len):
        # (Where the array's depth cuts the common prefix, the longer one need not cover it.)
        if n >= depth or change[hi] > change[lo]:
            out.append((order[lo:hi + 1], n))
    return order, lcp, out


def settle_groups(contexts: DataFrame, min_len: int) -> DataFrame:
    """Removed stretches (hash null) within the groups, and of split groups the first of each window by hash."""
    names = ["node", "start", "end", "hash"]
    kinds = [pa.int64()] * 4

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        # rows: (grp, split, node, start, text)
        texts = [r[4] for r in rows]
        length = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        n_starts = length - min_len + 1
        which = np.repeat(np.arange(len(rows)), n_starts)
        step = np.arange(n_starts.sum()) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
        starts = begin[which] + step
        node, origin = np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64)
        doc, place = node[which], origin[which] + step
        rank = np.empty(len(which), dtype=np.int64)
        rank[np.lexsort((place, doc))] = np.arange(len(which))
        left = np.where(step > 0, data[starts - 1].astype(np.int64), -1 - np.arange(len(which)))
        order, lcp, groups = repeat_groups(data, starts, (begin + length)[which], left, min_len, 17 * min_len // 10)
        change = np.zeros(len(data) + 1, dtype=np.int64)
        for members, n in groups:
            first = members[rank[members].argmin()]
            others = members[(doc[members] != doc[first]) | (place[members] != place[first])]
            np.add.at(change, starts[others], 1)
            np.add.at(change, starts[others] + n, -1)
        covered = np.cumsum(change[:-1]) > 0
        inner = np.r_[False, covered[1:] & covered[:-1]]
        inner[begin] = False
        head = np.flatnonzero(covered & ~inner)
        tail = np.flatnonzero(covered & ~np.r_[inner[1:], False]) + 1
        at = np.searchsorted(begin, head, side="right") - 1
        gone = [node[at], origin[at] + head - begin[at], origin[at] + tail - begin[at]]
        yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in gone], pa.nulls(len(head), pa.int64())], names)
        split = np.array([r[1] for r in rows])[which[order]]
        if split.any():
            new = np.r_[True, lcp[1:] < min_len]
            # The first occurrence of each class of equal windows.
            by = np.lexsort((rank[order], np.cumsum(new)))
            firsts = order[by[np.flatnonzero(new)]]
            firsts = firsts[np.array([r[1] for r in rows])[which[firsts]]]
            h = Hashes(data).of(starts[firsts], starts[firsts] + min_len).view(np.int64)
            for k in range(0, len(firsts), 100_000):
                f = firsts[k:k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(doc[f]), pa.array(place[f]), pa.array(place[f] + min_len), pa.array(h[k:k + 100_000])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                # Groups stay whole; a split group may be cut anywhere.
                if size >= SUFFIX_CHUNK and (row[0] != last or row[1]):
                    yield from settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[0]
        if rows:
            yield from settle(rows)
        yield pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (contexts.repartition(2 * parts, "grp").sortWithinPartitions("grp")
            .select("grp", "split", "node", "start", "text").mapInArrow(run, "node long, start long, end long, hash long"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(node, doc_id, packed): texts compressed for the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([squeeze.compress((t.as_py() or "").encode()) for t in part.column(2)], pa.binary())],
                    ["node", "doc_id", "packed"])

    return docs.select("node", "doc_id", "text").mapInArrow(run, "node long, doc_id long, packed binary")


def contexts_of(docs: DataFrame, supers: DataFrame) -> DataFrame:
    """(grp, split, node, start, text) of the super-windows that go on."""
    lists = supers.groupBy("node").agg(F.collect_list(F.struct("start", "end", "grp", "split")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        names = ["grp", "split", "node", "start", "text"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows: list[tuple] = []
        for batch in batches:
            for node, packed, cuts in zip(*[batch.column(i) for i in range(3)], strict=True):
                text, number = expand.decompress(packed.as_py()), node.as_py()
                for c in cuts.as_py():
                    rows.append((c["grp"], c["split"], number, c["start"], text[c["start"]:c["end"]]))
                    if len(rows) >= 20_000:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return (packed_texts(docs).join(lists, "node").select("node", "packed", "cuts")
            .mapInArrow(run, "grp long, split boolean, node long, start long, text binary"))


def cut_texts(docs: DataFrame, gone: DataFrame, with_text: bool) -> DataFrame:
    """Each document without the stretches ``gone`` (node, start, end)."""
    lists = gone.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = expand.decompress(packed.as_py())
                kept, at, n_gone, n_spans = [], 0, 0, 0
                reach = -1
                for c in sorted((c["start"], c["end"]) for c in cuts.as_py() or ()):
                    if c[0] > reach:  # stretches that touch are one
                        n_spans += 1
                        kept.append(text[at:c[0]])
                        n_gone += c[1] - c[0]
                        reach = at = c[1]
                    elif c[1] > reach:
                        n_gone += c[1] - reach
                        reach = at = c[1]
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(text), n_gone, n_spans, hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = list(zip(*out, strict=True)) or [[]] * (5 + with_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[:len(columns)])

    return packed_texts(docs).join(lists, "node", "left").select("doc_id", "packed", "cuts").mapInArrow(run, schema)


def numbered(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, node): ``node`` tells distinct documents (id and text) apart, in the order of ids, none last.

    Where no id has two texts that is the id itself (``node_of``).  Otherwise
    distinct documents are ranked by id and a hash of both, and the texts are
    written once with their ranks.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), t.alias("_whole"))
    prints = rows.where(F.col("doc_id").isNotNull()).select("doc_id", F.sha2(F.col("_whole").cast("binary"), 256).alias("_print"))
    clashes = prints.groupBy("doc_id").agg(F.min("_print").alias("_lo"), F.max("_print").alias("_hi")).where("_lo <> _hi")
    if clashes.isEmpty():
        return rows.select("doc_id", "text", node_of(F.col("doc_id"), F.col("text")).alias("node"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("_whole"))
    keyed = rows.select("doc_id", "text", F.sha2(name.cast("binary"), 256).alias("_doc"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("_doc")]
    # Ranged parts are written first: their ids have to be the same for counts and rows.
    parts = materialize(keyed.groupBy("_doc").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n"))
                        .repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rep-documents")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_docs"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    starts = counts.select("_part", F.coalesce(F.sum("_docs").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_start")
    numbers = materialize(parts.join(starts, "_part").select("_doc", "_n", place.cast("long").alias("node")), "rep-numbers")
    total = numbers.agg(F.sum("_n")).first()[0]
    return materialize(join_hot_split(keyed, numbers, "_doc", "_n", total).select("doc_id", "text", "node"), "rep-texts")


def remove_repeats(docs: DataFrame, min_len: int = 100, text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` if asked for).

    Null texts are empty; texts of less than ``min_len`` bytes lose nothing.
    Rows repeated with one doc_id and text are one document and have the same
    result; different texts of one id are documents of their own, ordered by a
    hash, and so are rows without id, which come after all others.  An empty
    table gives an empty result.
    """
    rows = numbered(docs, text)
    found = materialize(find_supers(rows, min_len), "rep-supers")
    settled = materialize(settle_groups(contexts_of(rows, found.where(F.col("grp").isNotNull())), min_len), "rep-groups")
    windows = settled.where(F.col("hash").isNotNull())
    n = windows.count()
    firsts = (windows.groupBy("hash").agg(F.min(F.struct("node", "start")).alias("first"), F.count(F.lit(1)).alias("_n"))
              .where("_n > 1"))
    across = (join_hot_split(windows, firsts, "hash", "_n", max(n, 1))
              .where((F.col("node") != F.col("first.node")) | (F.col("start") != F.col("first.start"))))
    span = ["node", "start", "end"]
    gone = (found.where(F.col("grp").isNull()).select(*span)
            .unionByName(settled.where(F.col("hash").isNull()).select(*span)).unionByName(across.select(*span)))
    return cut_texts(rows, gone, with_text)


def op8_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeats of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))
