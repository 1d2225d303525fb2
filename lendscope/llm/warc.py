"""WARC archives and their capture index.

Writing: pages become WARC/1.1 records.  Of equal payloads of MIN_REVISIT
bytes or more the smallest page id is the response, the others are revisit
records that refer to it and carry the HTTP head only.  Records are built and
written by Spark (text writer with the record trailer as separator, gzip), so
archives can lie in any store Spark reaches.

Reading: archives come back as binary files of bounded size; records are cut
by Content-Length.  Every archive's captures are sorted by URL key, time and id
into a run.  The runs are merged externally: ranges of the key order are dealt
to tasks, and a loser tree merges the slices of the runs that a range holds, so
the ranges in order are one globally ordered capture history.  A URL captured
very often is split over ranges by time and id.

Scale: digests are taken in one scan; equal payloads are reduced map-side
and given back with ``join_hot_split``.  HTML is joined with the revisits only.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import join_hot_split, materialize, table

MIN_REVISIT = 100
ARCHIVE_BYTES = 32_000_000  # of records before compression, about
CRLF = "\r\n"
TRAILER = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the standard
INDEX_SCHEMA = ("run string, url_key string, captured_at string, page_id long, payload_bytes long, "
                "payload_digest string, record_type string, refers_to long")


def plan_records(pages: DataFrame) -> tuple[DataFrame, int, int]:
    """(page_id, digest, refers_to) of the revisits; number of pages; bytes of all payloads."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = materialize(pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("long").alias("n_bytes")), "warc-digests")
    total, volume = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    large = rows.where(F.col("n_bytes") >= MIN_REVISIT)
    groups = (large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .where("n > 1"))
    revisits = (join_hot_split(large, groups, "digest", "n", total)
                .where(~F.col("page_id").eqNullSafe(F.col("first_id")))
                .select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct())
    return revisits, total, volume


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """One column ``value``: the WARC record of each page, without the trailer."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"))
    r = revisits.withColumnsRenamed({"page_id": "r_id", "digest": "r_digest"})
    j = p.join(r, p["page_id"].eqNullSafe(r["r_id"]) & (p["digest"] == r["r_digest"]), "left")
    revisit = F.col("r_digest").isNotNull()
    n = F.octet_length("html")
    # The capture time of the fixture: seconds after a fixed date, by page id.
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0)) % 31_536_000),
                       "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
                    n.cast("string"), F.lit(TRAILER))
    body = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    return j.select(F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("page_id"))), F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", at), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to")))))
        .otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit(CRLF), body).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write every page (page_id, url, html) as one record of gzip-compressed archives under ``path``."""
    revisits, total, volume = plan_records(pages)
    each = max(1, min(100_000, int(ARCHIVE_BYTES // max(1, volume // max(total, 1) + 500))))
    (records(pages, revisits).write.option("lineSep", TRAILER).option("compression", "gzip")
     .option("maxRecordsPerFile", each).text(path))


def url_key(url: str | None) -> str:
    """Sort-friendly key: host parts from the right, then path and query."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host = u.hostname or ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + ("?" + u.query if u.query else "")


def parse_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzip archive."""
    with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive))) as f:
        while version := f.readline():
            if version.rstrip() != b"WARC/1.1":
                raise ValueError(f"no record begins here: {version[:40]!r}")
            headers = {}
            while (h := f.readline().rstrip(b"\r\n")):
                name, _, value = h.decode().partition(": ")
                headers[name.lower()] = value
            block = f.read(int(headers["content-length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record's trailer is missing")
            yield headers, block


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive as a locally sorted run; payload digests of responses are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for h, block in parse_records(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "response":
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
                    else:  # the head states the length of the payload that is kept elsewhere
                        size = int(head.rpartition(b"Content-Length: ")[2])
                    rows.append((url_key(h.get("warc-target-uri")), h["warc-date"], _page(h["warc-record-id"]), size, digest,
                                 h["warc-type"], _page(h.get("warc-refers-to"))))
                rows.sort(key=order_key)
                names = ["run", "url_key", "captured_at", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[name] * len(rows), *columns], kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX_SCHEMA)


def order_key(row: tuple) -> tuple:
    """URL key (in UTF-8 order, as Spark sorts), time, page id with null first."""
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, the root's winner is next."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.keys = [order_key(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        return kb is None or ka is not None and (ka, a) < (kb, b)

    def _play(self, i: int, building: bool = False) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.losers[node]
            if building and other < 0:  # waits for its opponent
                self.losers[node] = winner
                return
            if not self._beats(winner, other):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[w := self.losers[0]] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            run = self.runs[w]
            self.keys[w] = order_key(run[self.at[w]]) if self.at[w] < len(run) else None
            self._play(w)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The globally ordered captures: ``range_no`` and ``place`` order all rows.

    ``runs`` has to be a written table, as its key ranges are found by sampling.
    """
    columns = ["url_key", "captured_at", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        number = None
        for batch in batches:
            d = batch.to_pydict()
            for name, no, *row in zip(d["run"], d["range_no"], *[d[c] for c in columns], strict=True):
                slices.setdefault(name, []).append(tuple(row))
                number = no
        for rows in slices.values():  # a slice may come in pieces whose order the exchange changed
            rows.sort(key=order_key)
        out, place = [], 0
        names = ["range_no", "place", *columns]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for row in LoserTree(list(slices.values())):
            out.append((number, place, *row))
            place += 1
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    dealt = runs.repartitionByRange("url_key", "captured_at", F.col("page_id").asc_nulls_first())
    return dealt.withColumn("range_no", F.spark_partition_id()).mapInArrow(
        run, "range_no int, place long, url_key string, captured_at string, page_id long, payload_bytes long, "
             "payload_digest string, record_type string, refers_to long")


def capture_history(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back, merge their index.

    Null html is an empty payload; null urls have no target (key '').  Rows
    repeated with one page id are records of their own.  A page without id is
    never referred to unless its whole group has none (then all are responses).
    An empty table gives an empty history.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    return merge_runs(materialize(read_runs(spark, path), "warc-runs"))


def op10_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    return capture_history(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p
)
SELECT page_id, n AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
