"""Repeated passages of words by difference-cover anchors.

A window is WINDOW consecutive words of one document.  With a difference cover
D modulo a period v, any two positions i and j have a d < v for which i + d and
j + d are both in D modulo v.  So two equal windows, wherever they begin, share
an anchor, a run of WINDOW - v + 1 words that begins at a cover position of
both, and only those runs are hashed (6 of 31 positions for 50 words).

An anchor found in two documents is extended by the WINDOW - ANCHOR words on
both sides: the stretch that holds every window around the anchor.

* Its whole stretch occurs in a smaller document too: all its windows repeat.
* All occurrences have one stretch: nothing more is to be settled.
* Otherwise (the ends of passages, edited copies) the windows around the anchor
  are compared one by one, by 128-bit fingerprints.

The least document holding a window is settled by no anchor of it, and shares
an anchor with any other document that holds the window: so either the stretches
agree or both offer the window, and the answer is exact in every case.

Scale: rows are taken in chunks of neighbours in their file.  A chunk asks once
for each of its (anchor, stretch), packed by hash bucket, whatever the number of
its documents that have it, so a passage that stands in a third of all documents
adds one entry a chunk.  Buckets hold equal shares of the hashes and their
number follows the bytes of text.  Answers go back packed by chunk.  No pair of
documents is ever made.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize_in_small_batches, table, with_row_key
from .hashing import mix

U = np.uint64
CHUNK_BITS = 8  # 256 neighbouring rows a chunk
BUCKET_TEXT = 32_000_000  # bytes of text whose hashes share a bucket
NO_ID = np.iinfo(np.int64).min  # a null id is less than any other
# Perfect difference sets (every difference modulo the period occurs once).
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers


@dataclass(frozen=True)
class Cover:
    """Window, period and cover; runs of ``anchor`` words are hashed where the position is in the cover."""

    window: int
    period: int
    cover: tuple[int, ...]

    @classmethod
    def of(cls, window: int) -> Cover:
        if window < 1:
            raise ValueError("a window has one word at least")
        period = max((v for v in COVERS if 8 * v <= 5 * window), default=1)
        return cls(window, period, COVERS.get(period, (0,)))

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1

    @property
    def reach(self) -> int:
        return self.window - self.anchor


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, base, U)]), dtype=U)


class Chunk:
    """Words of some texts, their prefix hashes and their anchors."""

    def __init__(self, texts: list[bytes | None], c: Cover) -> None:
        self.c = c
        # bytes.split() parts at \x20 and \x09-\x0D, no other byte.
        self.words = [(t or b"").split() for t in texts]
        self.n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        total = int(self.first[-1])
        number: dict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(self.words)), np.int64, total)
        of_word = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), dtype=U).reshape(-1, 2)
        self.sums, self.inverse = [], []
        with np.errstate(over="ignore"):
            for k, base in enumerate(BASES):
                h = of_word[ids, k] * _powers(base, total)[:total]
                self.sums.append(np.concatenate([np.zeros(1, U), np.cumsum(h, dtype=U)]))
                self.inverse.append(_powers(pow(base, -1, 1 << 64), total))
        owner = np.repeat(np.arange(len(texts)), self.n)
        place = np.arange(total) - self.first[owner]
        on = np.zeros(c.period, dtype=bool)
        on[list(c.cover)] = True
        lo_of, hi_of = self.first[owner], self.first[owner + 1]
        at = np.flatnonzero(on[place % c.period] & (place + c.anchor <= self.n[owner]) & (self.n[owner] >= c.window))
        self.at, self.owner = at, owner[at]
        # The stretch around an anchor, cut at the ends of its document.
        self.lo = np.maximum(lo_of[at], at - c.reach)
        self.hi = np.minimum(hi_of[at], at + c.anchor + c.reach)
        whole = self.hi - self.lo >= c.window  # it holds a window
        self.at, self.owner, self.lo, self.hi = self.at[whole], self.owner[whole], self.lo[whole], self.hi[whole]
        self.anchors = self.hash(0, self.at, self.at + c.anchor)
        left = (self.at - self.lo).astype(U)
        with np.errstate(over="ignore"):
            self.stretches = mix(self.hash(1, self.lo, self.hi) + left * U(BASES[0]) + (self.hi - self.lo).astype(U))

    def hash(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[k][end] - self.sums[k][start]) * self.inverse[k][start])


def _ask(keys: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, keys, least ids, many) of the distinct rows of ``keys`` (n, 2); many: several ids have the key."""
    order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    start = np.flatnonzero(new)
    last = np.concatenate([start[1:], [len(keys)]])[:len(start)] - 1
    keys, many, ids = keys[start], ids[start] != ids[last], ids[start]
    bucket = (mix(keys[:, 0] + U(1)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        part = order[edge[b]:edge[b + 1]]
        yield b, keys[part].T.tobytes(), ids[part].tobytes(), many[part].tobytes()


def _answer(t: pa.Table, by_first: bool) -> pa.Table:
    """Packed answers to the questions of one bucket, one row a chunk.

    A key's answer is the least id that has it; ``mixed`` says that another key
    has the same first half.  Keys whose first half (``by_first``) or whole
    stands with one id only are not answered.
    """
    sizes = [len(x) // 8 for x in t["ids"].to_pylist()]
    keys = np.concatenate([np.frombuffer(x, U).reshape(2, -1).T for x in t["keys"].to_pylist()])
    ids = np.frombuffer(b"".join(t["ids"].to_pylist()), np.int64)
    many = np.frombuffer(b"".join(t["many"].to_pylist()), bool)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
    k, i, m = keys[order], ids[order], many[order]
    new_first = np.ones(len(k), dtype=bool)
    new_first[1:] = k[1:, 0] != k[:-1, 0]
    new_key = new_first.copy()
    new_key[1:] |= k[1:, 1] != k[:-1, 1]
    key_no, first_no = np.cumsum(new_key) - 1, np.cumsum(new_first) - 1
    least = i[np.flatnonzero(new_key)][key_no]
    group = first_no if by_first else key_no
    start = np.flatnonzero(new_first if by_first else new_key)
    shared = (np.minimum.reduceat(i, start) != np.maximum.reduceat(i, start)) | np.logical_or.reduceat(m, start)
    mixed = np.bincount(first_no, new_key)[first_no] > 1
    back = np.flatnonzero(shared[group])
    of = row[order[back]]
    back, of = back[np.argsort(of, kind="stable")], np.sort(of)
    edge = np.searchsorted(of, np.arange(len(sizes) + 1))
    rows = [(r, back[edge[r]:edge[r + 1]]) for r in np.flatnonzero(np.diff(edge)).tolist()]
    chunks = t["chunk"].to_pylist()
    return pa.table({
        "chunk": pa.array([chunks[r] for r, _ in rows], pa.int64()),
        "keys": pa.array([k[b].T.tobytes() for _, b in rows], pa.binary()),
        "ids": pa.array([least[b].tobytes() for _, b in rows], pa.binary()),
        "mixed": pa.array([mixed[b].tobytes() for _, b in rows], pa.binary())})


ASKED = "bucket int, chunk long, keys binary, ids binary, many binary"
ANSWERED = "chunk long, keys binary, ids binary, mixed binary"


class Answers:
    """The answered keys of a chunk, looked up by key."""

    def __init__(self, t: pa.Table) -> None:
        parts = [np.frombuffer(x, U).reshape(2, -1).T for x in t["keys"].to_pylist()]
        keys = np.concatenate([np.zeros((0, 2), U), *parts])
        ids = np.frombuffer(b"".join(t["ids"].to_pylist()), np.int64)
        mixed = np.frombuffer(b"".join(t["mixed"].to_pylist()), bool)
        # Sorted by the mixed halves; a chunk that was read in two pieces has some keys twice.
        self.mark = self._marks(keys)
        order = np.argsort(self.mark, kind="stable")
        self.mark, self.keys, self.ids, self.mixed = self.mark[order], keys[order], ids[order], mixed[order]

    @staticmethod
    def _marks(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(keys[:, 0] + mix(keys[:, 1]))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, least id, mixed) of each key."""
        if not len(self.mark):
            no = np.zeros(len(keys), dtype=bool)
            return no, np.zeros(len(keys), np.int64), no
        at = np.minimum(np.searchsorted(self.mark, self._marks(keys)), len(self.mark) - 1)
        found = (self.keys[at] == keys).all(axis=1)
        return found, self.ids[at], self.mixed[at] & found


def _cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places some [start, end) covers."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:n] > 0


def _spans(covered: np.ndarray) -> np.ndarray:
    """Maximal runs of True as (k, 2)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], dtype=np.int64)


def _finished(words: list[bytes], covered: np.ndarray, texts: bool) -> tuple[int, int, list, bytes | None, str | None]:
    kept = b" ".join([w for w, gone in zip(words, covered.tolist(), strict=True) if not gone] if covered.any() else words)
    spans = [{"start": a, "end": b} for a, b in _spans(covered).tolist()]
    return len(words), int(covered.sum()), spans, kept if texts else None, hashlib.sha256(kept).hexdigest()


RESULT = ("doc_id long, n_words long, n_removed long, removed array<struct<start:long, end:long>>, "
          "kept_bytes binary, kept_sha256 string")
STATE = RESULT + ", chunk long, text binary, covered binary, bucket int, keys binary, ids binary, many binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
KINDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "removed": SPANS, "kept_bytes": pa.binary(),
         "kept_sha256": pa.string(), "chunk": pa.int64(), "text": pa.binary(), "covered": pa.binary(), "bucket": pa.int32(),
         "keys": pa.binary(), "ids": pa.binary(), "many": pa.binary()}


def _table(rows: list[dict], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], KINDS[n]) for n in names})


def _result(doc_id: int | None, done: tuple) -> dict:
    return dict(zip(list(KINDS)[:6], (doc_id, *done), strict=True))


def remove_repeats(docs: DataFrame, window: int = 50, texts: bool = True, text: str | Column = "text") -> DataFrame:
    """Removes each word that stands in a window of words which also begins in a document of smaller id.

    One row per row of ``docs``: doc_id, n_words, n_removed, removed (maximal
    spans of word numbers, end exclusive), kept_bytes (the kept words joined by
    one space; null without ``texts``, which spares writing them) and kept_sha256.

    Windows are judged on the input.  Words are runs of bytes other than \\x20
    and \\x09-\\x0D, unchanged; null and empty texts have none.  Rows with one
    id are no smaller than each other, so they lose nothing to each other; a
    null id is less than any other.  A repeat inside one document stays.  An
    empty table gives an empty result; other columns are not read.
    """
    c = Cover.of(window)
    rows, key = with_row_key(docs, "cover-docs")
    column = F.col(text) if isinstance(text, str) else text
    rows = rows.select(F.shiftright(F.col(key), CHUNK_BITS).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"),
                       column.cast("string").cast("binary").alias("text"))
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(1, -(-int(volume) // BUCKET_TEXT))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(chunks)) + 1, [len(chunks)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                x = Chunk(part.column("text").to_pylist(), c)
                if not len(x.at):
                    continue
                ids = _ids(pa.chunked_array([part.column("doc_id")]))[x.owner]
                out = [{"bucket": q[0], "chunk": int(chunks[a]), "keys": q[1], "ids": q[2], "many": q[3]}
                       for q in _ask(np.stack([x.anchors, x.stretches], axis=1), ids, buckets)]
                yield from _table(out, ["bucket", "chunk", "keys", "ids", "many"]).to_batches()

    asked = rows.mapInArrow(ask, ASKED)
    answers = materialize_in_small_batches(
        asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, True), ANSWERED), "cover-anchors", 1 << CHUNK_BITS)

    def extend(group: pa.Table, answered: pa.Table) -> pa.Table:
        """Settles whole stretches; documents with windows left to compare go on with their text."""
        x = Chunk(group["text"].to_pylist(), c)
        ids, found = _ids(group["doc_id"]), Answers(answered)
        hit, least, mixed = found.of(np.stack([x.anchors, x.stretches], axis=1))
        settled = hit & (least < ids[x.owner])
        total = int(x.first[-1])
        covered = _cover(total, x.lo[settled], x.hi[settled])
        # Starts of windows that lie in a settled stretch, and of those around the other anchors.
        gone = _cover(total, x.lo[settled], x.hi[settled] - c.window + 1)
        open_ = mixed & ~settled
        starts = np.flatnonzero(_cover(total, x.lo[open_], x.hi[open_] - c.window + 1) & ~gone)
        of = np.searchsorted(x.first, starts, side="right") - 1
        going = np.zeros(len(ids), dtype=bool)
        going[of] = True
        out = []
        for d, (doc_id, t) in enumerate(zip(group["doc_id"].to_pylist(), group["text"].to_pylist(), strict=True)):
            a, b = x.first[d], x.first[d + 1]
            if not going[d]:
                out.append(_result(doc_id, _finished(x.words[d], covered[a:b], texts)))
                continue
            mine = starts[np.searchsorted(of, d):np.searchsorted(of, d, side="right")] - a
            out.append({"doc_id": doc_id, "chunk": group["chunk"][d].as_py(), "text": t,
                        "covered": _spans(covered[a:b]).astype(np.int64).tobytes(), "many": mine.astype(np.int64).tobytes()})
        if len(starts):
            keys = np.stack([x.hash(0, starts, starts + c.window), x.hash(1, starts, starts + c.window)], axis=1)
            out += [{"bucket": q[0], "chunk": group["chunk"][0].as_py(), "keys": q[1], "ids": q[2], "many": q[3]}
                    for q in _ask(keys, ids[of], buckets)]
        return _table(out, list(KINDS))

    state = materialize_in_small_batches(
        rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(extend, STATE), "cover-state", 1 << CHUNK_BITS)
    again = (state.where("bucket is not null").select("bucket", "chunk", "keys", "ids", "many")
             .groupBy("bucket").applyInArrow(lambda t: _answer(t, False), ANSWERED))

    def finish(group: pa.Table, answered: pa.Table) -> pa.Table:
        """The windows compared one by one join the settled stretches."""
        x, found = Chunk(group["text"].to_pylist(), c), Answers(answered)
        ids, out = _ids(group["doc_id"]), []
        for d, doc_id in enumerate(group["doc_id"].to_pylist()):
            settled = np.frombuffer(group["covered"][d].as_py(), np.int64).reshape(-1, 2)
            mine = np.frombuffer(group["many"][d].as_py(), np.int64)
            at = mine + x.first[d]
            hit, least, _ = found.of(np.stack([x.hash(0, at, at + c.window), x.hash(1, at, at + c.window)], axis=1))
            mine = mine[hit & (least < ids[d])]
            covered = _cover(int(x.n[d]), np.concatenate([settled[:, 0], mine]), np.concatenate([settled[:, 1], mine + c.window]))
            out.append(_result(doc_id, _finished(x.words[d], covered, texts)))
        return _table(out, list(KINDS)[:6])

    open_docs = state.where("text is not null and bucket is null and kept_sha256 is null").select("chunk", "doc_id", "text", "covered", "many")
    names = list(KINDS)[:6]
    return (state.where("kept_sha256 is not null").select(names)
            .unionByName(open_docs.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(finish, RESULT)))


def op13_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 50 words."""
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = r"""
WITH w AS (
    SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS k, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT r, k, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50
), h AS (
    SELECT r, k, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h FROM s
), f AS (
    SELECT r, k, i, min(k) OVER (PARTITION BY h) AS first_k FROM h
), g AS (
    SELECT r, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM f WHERE first_k < k GROUP BY r
), o AS (
    SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
           CASE WHEN gone IS NULL THEN words
                ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END AS kept
    FROM w LEFT JOIN g USING (r)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
"""
