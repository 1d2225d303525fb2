"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

A text is normalised (a dummy blank in front, blanks written as the
vocabulary's blank sign) and cut at blanks and line ends, over which no piece
of the vocabulary reaches (checked when the vocabulary is loaded).  Each
distinct chunk is encoded by an agenda of adjacent symbol pairs: the pair whose
merged piece has the highest score is merged, the leftmost of equals first,
until no pair is a piece; symbols that are no piece become byte pieces.  Every
chunk's ids are compared with the sentencepiece library's, Arrow batch by
Arrow batch, and a difference fails the task.  Decoding joins the pieces of the
ids and is compared with the library's decoder in the same way.

Scale: one scan and no shuffle.  A worker keeps at most about twice CACHE_CHUNKS
encoded chunks, of which those that were not met again for longest go, and reads
the vocabulary file once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

BLANK = "▁"  # fixed value: the sign SentencePiece writes for a blank
CACHE_CHUNKS = 400_000
LONG_CHUNK = 64  # characters; longer chunks are not kept
SHORT_CHUNK = 32  # characters; below, a list is faster than a heap
NO_PIECE = float("inf")
BLOCK_CHARS = 1_000_000  # texts whose new chunks are encoded and checked together


class MergeVocabulary:
    """Pieces, scores and byte pieces of a merge-type model, with the agenda encoder."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.text: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.text.append(b"")
            else:
                self.ids[piece], self.rank[piece] = i, -lib.get_score(i)
                self.text.append(piece.replace(BLANK, " ").encode())
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        if any(BLANK in p.lstrip(BLANK) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("a piece reaches over a blank or a line end; texts can't be cut there")
        self.chunks = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
        self.cache: dict[str, bytes] = {}  # when it is full it becomes ``before``, from which chunks that come again are taken back
        self.before: dict[str, bytes] = {}

    def merge(self, chunk: str) -> list[int]:
        """Agenda encoding of one chunk; a short chunk's agenda is a plain list, a long one's a heap."""
        rank, symbols, n = self.rank, list(chunk), len(chunk)
        if n <= SHORT_CHUNK:
            get = rank.get
            agenda = list(map(get, map(add, chunk, chunk[1:]), repeat(NO_PIECE)))
            last = n - 2  # of the agenda
            while agenda:
                best = min(agenda)
                if best == NO_PIECE:
                    break
                i = agenda.index(best)  # the leftmost of equals
                symbols[i] = pair = symbols[i] + symbols.pop(i + 1)
                del agenda[i]
                last -= 1
                if i <= last:
                    agenda[i] = get(pair + symbols[i + 1], NO_PIECE)
                if i:
                    agenda[i - 1] = get(symbols[i - 1] + pair, NO_PIECE)
            out = list(map(self.ids.get, symbols))
            if None not in out:
                return out
        else:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = []
            for i in range(n - 1):
                pair = symbols[i] + symbols[i + 1]
                r = rank.get(pair)
                if r is not None:
                    agenda.append((r, i, i + 1, pair))
            heapq.heapify(agenda)
            while agenda:
                _, left, right, pair = heapq.heappop(agenda)
                # An entry is stale if one of its symbols has been merged since.
                if symbols[left] + symbols[right] != pair or not symbols[left] or not symbols[right] or after[left] != right:
                    continue
                symbols[left], symbols[right] = pair, ""
                after[left] = nxt = after[right]
                if nxt < n:
                    before[nxt] = left
                    longer = pair + symbols[nxt]
                    r = rank.get(longer)
                    if r is not None:
                        heapq.heappush(agenda, (r, left, nxt, longer))
                prev = before[left]
                if prev >= 0:
                    longer = symbols[prev] + pair
                    r = rank.get(longer)
                    if r is not None:
                        heapq.heappush(agenda, (r, prev, left, longer))
        out = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                if i is None:
                    out += [self.byte_ids[b] for b in s.encode()]
                else:
                    out.append(i)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 text of the ids of a whole document: pieces joined, less the dummy blank."""
        joined = b"".join(map(self.text.__getitem__, ids))
        return joined[1:] if joined[:1] == b" " else joined

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Encode new chunks, check them against the library, return their ids as little-endian words."""
        # A dummy blank stands in front of whatever the library encodes: it replaces a chunk's own
        # first blank; other chunks are put behind a line end, whose two ids are cut off again.
        # Plain chunks are those that begin with a blank and go on: they stand first here.
        plain = [c for c in chunks if c[0] == BLANK and len(c) > 1]
        other = [c for c in chunks if c[0] != BLANK or len(c) == 1]
        chunks = plain + other
        own = list(map(self.merge, chunks))
        theirs = self.library.encode([c[1:] for c in plain] + ["\n" + c for c in other], num_threads=1)
        lead = [self.ids[BLANK], self.byte_ids[10]]
        ours = own[:len(plain)] + [lead + a for a in own[len(plain):]]
        if ours != theirs:
            c = next(c for c, a, b in zip(chunks, ours, theirs, strict=True) if a != b)
            raise ValueError(f"the agenda's ids differ from the library's for {c[:80]!r}")
        decoded, back = list(map(self.decode, own)), list(map(str.encode, self.library.decode(own)))
        if decoded != back:
            c = next(c for c, a, b in zip(chunks, decoded, back, strict=True) if a != b)
            raise ValueError(f"the decoded text differs from the library's for {c[:80]!r}")
        ends = list(accumulate(map(len, own), initial=0))
        words = np.fromiter(chain.from_iterable(own), "<u4", ends[-1]).tobytes()
        return {c: words[4 * a:4 * b] for c, a, b in zip(chunks, ends, ends[1:])}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end ids, as little-endian 32-bit words."""
        cut = [self.chunks.findall((BLANK + t).replace(" ", BLANK)) if t else [] for t in texts]
        need = {c for cs in cut for c in cs}
        # a look-up per chunk: the difference of a set and a dictionary's keys would walk the whole dictionary
        new = [c for c in need if c not in self.cache]
        if len(self.cache) + len(new) > CACHE_CHUNKS:
            self.before, self.cache = self.cache, {c: self.cache[c] for c in need if c in self.cache}
        known, before = self.cache, self.before
        fresh = [c for c in new if c not in before]
        known.update((c, before[c]) for c in new if c in before)
        if fresh:
            known.update(self.learn(fresh))
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (self.begin, self.end))
        out = [begin + b"".join(map(known.__getitem__, cs)) + end for cs in cut]
        for c in fresh:
            if len(c) > LONG_CHUNK:
                del known[c]
        return out


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> MergeVocabulary:
    return MergeVocabulary(model_file)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cuts of a batch at about BLOCK_CHARS characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and ``ids`` if asked for.

    The file is read on the executors, so it has to be there (a vocabulary
    installed with the Python environment is).  Null and empty texts have the
    begin and end ids only and decode to the empty text.  Repeated rows give
    repeated results; an empty table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                n, sha, back, every = [], [], [], []
                for ids in v.encode([t or "" for t in texts[a:b]]):
                    words = np.frombuffer(ids, dtype="<u4").tolist()
                    n.append(len(words))
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(v.decode(words)).hexdigest())
                    if with_ids:
                        every.append(words)
                columns = [doc_ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(every, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", f"`{text}` as text").mapInArrow(run, schema)


def merge_model() -> str:
    """The public merge-type vocabulary of 32,000 pieces with byte fallback."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op5_agenda_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    return encode_documents(table(spark, sf_dir, "documents"), merge_model())


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the tokens of each document that is left, as counts and digests."""
    return encode_documents(docs, merge_model())
