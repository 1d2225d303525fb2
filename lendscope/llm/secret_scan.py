"""Secret scans: keyword prefilter, anchored expressions, checksums.

One Aho-Corasick automaton walks over each text's lower-cased bytes and reports
keywords.  Only where a keyword begins is the kind's regular expression tried,
anchored there; a match that is too short is dropped but still consumes its
characters, as a left-to-right search does.  Long hexadecimal runs have no
keyword and are searched on their own.  Tokens that carry a checksum (six
base-62 digits of the CRC-32 of the thirty characters before) are reported only
if it is right.

Scale: one scan, no shuffle; whole texts, one at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Kinds in their order, keywords, expressions and least lengths.
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
MIN_ASSIGN, MIN_ACCESS = 6, 20
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def base62_crc(body: bytes) -> bytes:
    n, out = zlib.crc32(body), bytearray()
    for _ in range(6):
        n, d = divmod(n, 62)
        out.append(BASE62[d])
    return bytes(reversed(out))


def byte_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every secret, in bytes, sorted."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton().iter(raw.lower().decode("latin-1")))
    reach = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < reach[kind]:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED).match(raw, start)
        if not m:
            continue
        if kind in ("github", "npm") and base62_crc(m[1]) != m[2]:
            continue
        reach[kind] = m.end()
        if kind == "assign" and len(m[2]) < MIN_ASSIGN or kind == "access" and len(m[0]) < MIN_ACCESS:
            continue
        found.append((start, KINDS.index(kind), m.end()))
    return sorted(found)


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    raw = (text or "").encode()
    spans = byte_spans(raw)
    if spans and len(raw) != len(text):
        heads = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, out=heads[1:])
        spans = [(int(heads[a]), k, int(heads[b])) for a, k, b in spans]
    return spans


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row.

    Spans are kind:start:end in code points, end exclusive, by start and then
    by kind, comma-joined; base_sha256 covers the three base kinds.  Null and
    empty texts have none (the digest of the empty string).  Rows are
    independent: repeated rows give repeated results, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            base, every = [], []
            for t in batch.column(1):
                spans = scan_text(t.as_py())
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in spans))
                written = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                kept = [w for w, s in zip(written, spans, strict=True) if s[1] < 3]
                base.append(hashlib.sha256(",".join(kept).encode()).hexdigest())
                every.append(",".join(written))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(every, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return (docs.selectExpr("cast(doc_id as long) as doc_id", f"`{text}` as text")
            .mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    return scan(table(spark, sf_dir, "documents"))
