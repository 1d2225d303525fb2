"""Language-model scoring over subword lattices.

The pieces of an existing vocabulary carry probabilities of a unigram model.
A word (with its blank in front) is a lattice whose arcs are the pieces found
in it, bytes where no piece has one byte alone; its probability is the sum over
all segmentations, taken by a forward recursion in log space.  A document's
probability is the product over its words and one end.

Probabilities start from the vocabulary's own scores (a Zipf law over its
order) and are fitted to the training documents by expectation-maximisation
over the distinct words: a forward-backward pass gives every piece's expected
count, weighted by the word's count.

Scale: words are counted map-side before they are shuffled, and lattices are
walked once per distinct word, vectorised over words of one length.  Words
with more than 1/HOT_WORDS of all tokens (at most HOT_WORDS of them, of at
most HOT_BYTES bytes) go to every task as a table; the others' occurrences are
sent to the lexicon's partitions as packed (word hash, document, count) arrays
and answered with sums, so a word of every document is never a hot key and the
vocabulary is never held in one place.  Word hashes have 64 bits.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SMOOTH = 0.1  # fixed value of the base score
FOLDS = 10
HOT_WORDS = 1 << 18
HOT_BYTES = 48
FLUSH_WORDS = 200_000  # distinct words a task counts before it passes them on
CHUNK_PAIRS = 1_000_000  # (word, document) pairs of a task's packed arrays
SHORT_WORD = 64  # bytes; longer words are walked one by one
BATCH_WORDS = 20_000
PRIOR = 3200.0  # pseudo-counts spread over the vocabulary
FIXED_POINT = 65536.0  # expected counts are added as whole numbers, so their order doesn't matter
LN10 = math.log(10.0)
END = b""  # the end of a text among the words; no word is empty


class Pieces:
    """Pieces of a vocabulary as byte strings, blank sign written as a blank, looked up by hash."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, model_file: str) -> None:
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        found: dict[bytes, float] = {}
        last = float(lib.get_piece_size())
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or len(piece) > 1 and piece.strip("▁") == "":
                continue
            found[piece.replace("▁", " ").encode()] = 1.0 / (100.0 + min(last, -lib.get_score(i)))
        for b in range(256):
            found.setdefault(bytes([b]), 1.0 / (2.0 * last))
        self.names = sorted(found)
        weight = np.array([found[p] for p in self.names])
        self.start = weight / weight.sum()
        self.longest = max(map(len, self.names))
        keys = np.array([self._hash(p) for p in self.names], dtype=np.uint64)
        self.order = np.argsort(keys >> np.uint64(44), kind="stable")
        self.keys = keys[self.order]
        cell = (self.keys >> np.uint64(44)).astype(np.int64)
        self.first = np.full(1 << 20, -1, dtype=np.int32)
        heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.first[cell[heads]] = heads
        self.chain = int(np.diff(np.r_[heads, len(cell)]).max())
        self.keys = np.r_[self.keys, np.zeros(self.chain, dtype=np.uint64)]
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, self.BASE)], dtype=np.uint64)

    @classmethod
    def _hash(cls, piece: bytes) -> int:
        h = 0
        for c in piece:
            h = (h * int(cls.BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return cls._mix(np.array([h], dtype=np.uint64))[0]

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(32))

    def prefix(self, bytes_: np.ndarray) -> np.ndarray:
        """Prefix hashes along the last axis, one longer than it."""
        out = np.zeros((*bytes_.shape[:-1], bytes_.shape[-1] + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for t in range(bytes_.shape[-1]):
                out[..., t + 1] = out[..., t] * self.BASE + bytes_[..., t] + np.uint64(1)
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is a piece's, and the pieces."""
        at = self.first[(hashes >> np.uint64(44)).astype(np.int64)]
        rows = np.flatnonzero(at >= 0)
        at, want = at[rows], hashes[rows]
        piece = np.full(len(rows), -1, dtype=np.int64)
        for c in range(self.chain):
            hit = self.keys[at + c] == want
            piece[hit] = self.order[np.minimum(at[hit] + c, len(self.order) - 1)]
        ok = piece >= 0
        return rows[ok], piece[ok]

    def arcs(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position the (length, rows, pieces) of the arcs; ``words`` is a byte matrix."""
        h = self.prefix(words)
        out = []
        with np.errstate(over="ignore"):
            for j in range(1, words.shape[1] + 1):
                here = []
                for n in range(1, min(j, self.longest) + 1):
                    rows, piece = self.find(self._mix(h[:, j] - h[:, j - n] * self.power[n]))
                    if len(rows):
                        here.append((n, rows, piece))
                out.append(here)
        return out

    def forward(self, words: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, list]:
        """Log of the summed probability of all segmentations of each prefix."""
        arcs = self.arcs(words)
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0.0
        for j, here in enumerate(arcs, 1):
            for n, rows, piece in here:
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[j - n, rows] + logp[piece])
        return alpha, arcs

    def _long_arcs(self, word: bytes) -> list[list[tuple[int, int]]]:
        """For each end position the (start, piece) arcs of one long word, hashed over all positions at once."""
        data = np.frombuffer(word, dtype=np.uint8)
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(data) + 1)]
        h = np.zeros(len(data), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, min(self.longest, len(data)) + 1):
                h = h[:len(data) - n + 1] * self.BASE + data[n - 1:] + np.uint64(1)
                rows, piece = self.find(self._mix(h))
                for i, p in zip(rows.tolist(), piece.tolist(), strict=True):
                    out[i + n].append((i, p))
        return out

    def log_words(self, words: list[bytes], logp: np.ndarray, counts: np.ndarray | None = None,
                  expected: np.ndarray | None = None) -> np.ndarray:
        """Log marginal of each word (blank in front); with ``counts``, adds expected piece counts."""
        out = np.empty(len(words))
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w) + 1, []).append(i)
        for size, at in by_len.items():
            if size > SHORT_WORD:
                for i in at:
                    out[i] = self._long_word(b" " + words[i], logp, None if counts is None else counts[i], expected)
                continue
            for k in range(0, len(at), BATCH_WORDS):
                part = at[k:k + BATCH_WORDS]
                m = np.frombuffer(b"".join(b" " + words[i] for i in part), dtype=np.uint8).reshape(len(part), size)
                alpha, arcs = self.forward(m, logp)
                out[part] = alpha[-1]
                if counts is not None:
                    self._backward(alpha, arcs, logp, counts[part], expected)
        return out

    @staticmethod
    def _backward(alpha: np.ndarray, arcs: list, logp: np.ndarray, counts: np.ndarray, expected: np.ndarray) -> None:
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0.0
        whole = alpha[-1]
        for j in range(len(arcs), 0, -1):
            for n, rows, piece in arcs[j - 1]:
                step = beta[j, rows] + logp[piece]
                beta[j - n, rows] = np.logaddexp(beta[j - n, rows], step)
                share = np.exp(alpha[j - n, rows] + step - whole[rows])
                expected += np.bincount(piece, np.rint(share * counts[rows] * FIXED_POINT), len(expected))

    def _long_word(self, word: bytes, logp: np.ndarray, count: float | None, expected: np.ndarray | None) -> float:
        arcs = self._long_arcs(word)
        alpha = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            v = [alpha[i] + logp[p] for i, p in arcs[j]]
            top = max(v)
            alpha[j] = top + math.log(sum(math.exp(x - top) for x in v))
        if count is not None:
            beta = [-math.inf] * len(word) + [0.0]
            for j in range(len(word), 0, -1):
                for i, p in arcs[j]:
                    step = beta[j] + logp[p]
                    a, b = max(beta[i], step), min(beta[i], step)
                    beta[i] = a if b == -math.inf else a + math.log1p(math.exp(b - a))
                    expected[p] += np.rint(math.exp(alpha[i] + step - alpha[-1]) * count * FIXED_POINT)
        return alpha[-1]


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case; bytes.split cuts at \\x20 and \\x09-\\x0D only."""
    return (text or "").encode().lower().split()


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS != 0


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (occurrences in training documents), a (in all), h (64-bit hash) of every distinct word and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | other.keys())
            c = [train[w] for w in words]
            a = [n + other[w] for n, w in zip(c, words, strict=True)]
            train.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(a, pa.int64())], ["word", "c", "a"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                into = train if is_training(doc_id) else other
                into.update(tokens(text.as_py()))
                into[END] += 1
                if len(train) + len(other) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return (docs.mapInArrow(run, "word binary, c long, a long").groupBy("word")
            .agg(F.sum("c").alias("c"), F.sum("a").alias("a")))


def fit(counts: DataFrame, model_file: str, rounds: int) -> np.ndarray:
    """Log probabilities of the pieces and, last, of the end."""
    p = pieces(model_file)
    prob = np.r_[p.start, 1.0 / len(p.names)]
    prob /= prob.sum()
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    for _ in range(rounds):
        logp = np.log(prob)

        def run(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            table_ = pieces(model_file)
            expected = np.zeros(len(table_.names))
            for batch in batches:
                table_.log_words(batch.column(0).to_pylist(), logp, np.array(batch.column(1), dtype=np.float64), expected)
            at = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(expected[at].astype(np.int64))], ["piece", "n"])

        got = (counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c")
               .mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")))
        expected = np.zeros(len(prob))
        for row in got.collect():  # one row per piece of the vocabulary at most
            expected[row["piece"]] = row["n"] / FIXED_POINT
        expected[-1] = ends
        start = np.r_[p.start, 1.0 / len(p.names)]
        prob = expected + PRIOR * start / start.sum()
        prob /= prob.sum()
    return np.log(prob)


def lexicon(counts: DataFrame, model_file: str, logp: np.ndarray) -> DataFrame:
    """Adds h and the log10 marginal ``lp`` to the counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = pieces(model_file)
        for batch in batches:
            words = batch.column(0).to_pylist()
            lp = table_.log_words(words, logp) / LN10
            lp[[i for i, w in enumerate(words) if w == END]] = logp[-1] / LN10
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h), pa.array(lp)], ["word", "c", "a", "h", "lp"])

    return counts.mapInArrow(run, "word binary, c long, a long, h long, lp double")


CHUNK = "bucket int, kind int, home long, x binary, y binary, z binary, ids binary"
ANSWER = "home long, bucket int, kind int, ids binary, sums binary, docs binary, none binary"


def score_documents(docs: DataFrame, model_file: str, rounds: int = 1, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the rows whose crc32(doc_id as text) mod 10 is not 0 (a null id
    counts as the empty text: held out).  Null and empty texts are one end.
    Without any training row, probabilities are those of the vocabulary's own
    scores and every count is 0.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = materialize(count_words(rows), "lm-counts")
    n_train, n_kinds, n_all = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)),
        F.coalesce(F.sum("a"), F.lit(0))).first()
    logp = fit(counts, model_file, rounds)
    lex = materialize(lexicon(counts, model_file, logp), "lm-lexicon")
    below = n_train + SMOOTH * (n_kinds + 1)
    is_hot = (F.col("a") * HOT_WORDS > n_all) & (F.octet_length("word") <= HOT_BYTES) | (F.col("word") == F.lit(END))
    hot = {bytes(r["word"]): (math.log10((r["c"] + SMOOTH) / below), r["lp"], int(r["c"] > 0))
           for r in lex.where(is_hot).select("word", "c", "lp").collect()}
    shared = spark.sparkContext.broadcast(hot)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(kind: int, home: int, hashes: np.ndarray, y: np.ndarray, z: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        """Packed arrays by bucket; ``ids`` is what y points into, the part of it that the bucket needs."""
        bucket = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(parts + 1))
        for b in np.flatnonzero(np.diff(edges)):
            at = order[edges[b]:edges[b + 1]]
            if kind:
                yield int(b), kind, home, hashes[at].tobytes(), y[at].tobytes(), z[at].tobytes(), b""
            else:
                need, place = np.unique(y[at], return_inverse=True)
                yield int(b), kind, home, hashes[at].tobytes(), place.astype(np.uint32).tobytes(), z[at].tobytes(), ids[need].tobytes()

    def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_, strict=True), kinds, strict=True)],
                                          ["bucket", "kind", "home", "x", "y", "z", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        hashes: list[int] = []
        tf: list[int] = []
        docs_at: list[int] = []  # the number of pairs at which each document begins
        ids: list[int] = []
        sums: list[tuple] = []

        def flush() -> pa.RecordBatch:
            h = np.array(hashes, dtype=np.uint64)
            owner = np.repeat(np.arange(len(ids)), np.diff(np.r_[docs_at, len(hashes)]))
            out = list(cut(0, ids[0], h, owner, np.array(tf, dtype=np.uint32), np.array(ids, dtype=np.int64))) if len(h) else []
            numbers = np.array([x[2:] for x in sums], dtype=np.float64)
            doc_ids = np.array([x[1] or 0 for x in sums], dtype=np.int64)
            no_id = np.array([x[1] is None for x in sums])
            out.append((int(ids[0] % parts), 2, ids[0], np.array(ids, dtype=np.int64).tobytes(), numbers.tobytes(), no_id.tobytes(), doc_ids.tobytes()))
            for x in (hashes, tf, docs_at, ids, sums):
                x.clear()
            return batch_of(out)

        for batch in batches:
            for row, doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = tokens(value.as_py())
                seen = Counter(words)
                seen[END] = 1
                ids.append(row)
                docs_at.append(len(hashes))
                base = score = 0.0
                n_known = 0
                for w, n in seen.items():
                    v = known.get(w)
                    if v is None:
                        hashes.append(xxhash.xxh3_64_intdigest(w))
                        tf.append(n)
                    else:
                        base += n * v[0]
                        score += n * v[1]
                        n_known += n * v[2]
                sums.append((row, doc_id, len(words) + 1, n_known, base, score))
                if len(hashes) >= CHUNK_PAIRS or len(ids) >= 50_000:
                    yield flush()
        if ids:
            yield flush()

    def pack_lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array(batch.column(0), dtype=np.int64).view(np.uint64)
            if len(h):
                yield batch_of(list(cut(1, 0, h, np.array(batch.column(1), dtype=np.int64), np.array(batch.column(2), dtype=np.float64), h)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each document's words in the lexicon of this partition, packed for the chunk they belong to."""
        asked: list[tuple] = []
        lists: list[tuple] = []

        def out(rows_: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            names = ["home", "bucket", "kind", "ids", "sums", "docs", "none"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for bucket, kind, home, *packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 0:
                    asked.append((home, bucket, *packed))
                elif kind == 1:
                    lists.append(tuple(packed))
                else:
                    yield out([(home, -1, kind, packed[0], packed[1], packed[3], packed[2])])
        if not asked:
            return
        h = np.concatenate([np.frombuffer(x[0], dtype=np.uint64) for x in lists])
        order = np.argsort(h)
        h = h[order]
        c = np.concatenate([np.frombuffer(x[1], dtype=np.int64) for x in lists])[order]
        lp = np.concatenate([np.frombuffer(x[2]) for x in lists])[order]
        base = np.log10((c + SMOOTH) / below)
        for home, bucket, hashes, owner, n, ids in asked:
            at = np.searchsorted(h, np.frombuffer(hashes, dtype=np.uint64))
            owner, n = np.frombuffer(owner, dtype=np.uint32), np.frombuffer(n, dtype=np.uint32).astype(np.float64)
            sums = np.stack([np.bincount(owner, n * v[at], len(ids) // 8) for v in ((c > 0).astype(np.float64), base, lp)], axis=1)
            yield out([(home, bucket, 0, ids, sums.tobytes(), b"", b"")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunk's own sums plus the answers of all partitions, in the partitions' order."""
        chunks: dict[int, tuple] = {}
        answers: dict[int, list[tuple]] = {}
        for batch in batches:
            for home, bucket, kind, ids, sums, docs_, none in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 2:
                    chunks[home] = (ids, sums, docs_, none)
                else:
                    answers.setdefault(home, []).append((bucket, ids, sums))
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        for home, (ids, sums, docs_, none) in chunks.items():
            ids = np.frombuffer(ids, dtype=np.int64)
            s = np.frombuffer(sums).reshape(-1, 4).copy()
            for _, some, more in sorted(answers.pop(home, []), key=lambda x: x[0]):
                s[np.searchsorted(ids, np.frombuffer(some, dtype=np.int64)), 1:] += np.frombuffer(more).reshape(-1, 3)
            doc_ids = pa.array(np.frombuffer(docs_, dtype=np.int64), mask=np.frombuffer(none, dtype=bool))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(s[:, 0].astype(np.int64)), pa.array(np.rint(s[:, 1]).astype(np.int64)), pa.array(s[:, 2]), pa.array(s[:, 3])], names)

    # Rows are told apart by number, as ids may repeat; numbers rise within a task, so a chunk's are sorted.
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    asked = numbered.mapInArrow(scan, CHUNK)
    lists = lex.where(~is_hot).select("h", "c", "lp").mapInArrow(pack_lexicon, CHUNK)
    sums = (asked.unionByName(lists).repartition(parts, "bucket").mapInArrow(answer, ANSWER)
            .repartition(parts, "home").mapInArrow(
                finish, "doc_id long, n_tokens long, n_known long, base_score double, score double"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    return sums.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        "base_score", "score")


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model trained on nine tenths of them."""
    from .spm import merge_model
    return score_documents(table(spark, sf_dir, "documents"), merge_model())
