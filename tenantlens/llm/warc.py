"""Web archives: write and read WARC records, merge their capture indexes."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tenantlens.llm.common import partitions_for, stage, table
from tenantlens.settings import checkpoint_root

REVISIT_BYTES = 1000  # smaller payloads are always stored
ARCHIVE_BYTES = 16 << 20  # of an archive before compression, about
MERGE_ROWS = 100_000  # captures that one merge task holds, about
_FIRST_SECOND, _SECONDS = 1704067200, 315360000  # pages carry no time: 2024-01-01 and page_id seconds, within ten years
_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_URL = re.compile(r"[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]*)(?::\d+)?([^#]*)")


def records(pages: DataFrame) -> DataFrame:
    """(record) one WARC record per page, without the blank lines that end it.

    A null html is an empty payload, a null url has no target header. Of equal
    payloads (SHA-1) of at least REVISIT_BYTES the page with the largest page_id
    is the response and the others, those without an id included, are revisits
    of it. Rows that repeat that page_id are responses too.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", body.alias("body"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("digest"))
    shared = stage(pages.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("digest", "refers"))
    pages = pages.join(shared, "digest", "left")
    again = F.col("refers").isNotNull() & F.coalesce(F.col("page_id") < F.col("refers"), F.lit(True))
    seconds = F.timestamp_seconds(F.lit(_FIRST_SECOND) + F.coalesce(F.pmod("page_id", F.lit(_SECONDS)), F.lit(0)))
    date = F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(_CRLF))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", ident("page_id")),
        line("WARC-Date", date), F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", ident("refers")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    return pages.select(F.concat(head, line("Content-Length", F.octet_length(block).cast("string")), F.lit(_CRLF), block).alias("record"), "bytes")


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzip archives of about ARCHIVE_BYTES below ``path``; Spark's text writer ends each record with two line ends."""
    mean = pages.agg(F.avg(F.octet_length("html") + 600)).first()[0] or ARCHIVE_BYTES
    (records(pages).select("record").write.option("lineSep", _CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / mean))).text(path))


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query; no scheme, www, port or fragment."""
    low = (url or "").lower()
    m = _URL.match(low)
    return f"{','.join(reversed(m[1].split('.')))}){m[2] or '/'}" if m else low


def parse(data: bytes) -> Iterator[tuple]:
    """Captures of an archive: page_id, url, time, payload size and digest, kind, page referred to, offset, length."""
    at = 0
    page = lambda v: None if v is None or v == "<urn:page:none>" else int(v[10:-1])
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        head = dict(x.split(": ", 1) for x in data[at:body - 4].decode().split(_CRLF)[1:])
        end = body + int(head["Content-Length"])
        payload = data.index(b"\r\n\r\n", body) + 4
        if head["WARC-Type"] == "response":
            size, digest = end - payload, hashlib.sha1(data[payload:end], usedforsecurity=False).hexdigest()
        else:  # what was not stored again is known from the headers
            size, digest = int(data[body:payload].rsplit(b"Content-Length: ", 1)[1]), head["WARC-Payload-Digest"][5:]
        yield (page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Date"], size, digest, head["WARC-Type"], page(head.get("WARC-Refers-To")), at, end - at)
        at = end + 4


_CAPTURE = ["page_id", "url", "captured_at", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "length"]
_RUNS = ("page_id long, url string, captured_at string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
         "offset long, length long, url_key string, archive string, place long")


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The sorted run of each archive below ``path``: its captures by url_key, time and page_id; place is the rank in the run."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = pd.DataFrame(list(parse(gzip.decompress(content))), columns=_CAPTURE)
                rows["url_key"] = rows["url"].map(url_key)
                rows = rows.sort_values(["url_key", "captured_at", "page_id", "offset"], ignore_index=True)
                yield rows.assign(archive=name.rsplit("/", 1)[-1], place=range(len(rows))).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInPandas(run, _RUNS)


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of each match, the root the winner."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.loser = [0] * self.k
        winner = [0] * (2 * self.k)
        winner[self.k:] = range(self.k)
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winner[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's next item goes first; a run at its end loses, ties go to the earlier run."""
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place) of each item in merged order."""
        while self.runs and self.at[self.top] < len(self.runs[self.top]):
            w = self.top
            yield w, self.at[w]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node:
                if self._before(self.loser[node], w):
                    self.loser[node], w = w, self.loser[node]
                node //= 2
            self.top = w


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One key range: its slice of every run, merged."""
    g = [b for b in batches if len(b)]
    if not g:
        return
    g = pd.concat(g, ignore_index=True)
    id_of = g["page_id"].astype("Int64").fillna(-(1 << 63))
    keys = list(zip(g["url_key"], g["captured_at"], id_of))
    starts = (g["archive"] != g["archive"].shift()).to_numpy().nonzero()[0].tolist() + [len(g)]
    order = [starts[r] + i for r, i in LoserTree([keys[a:b] for a, b in zip(starts, starts[1:])])]
    yield g.iloc[order].assign(rank=range(len(g))).astype({"page_id": "Int64", "refers_to": "Int64"})


def merge_runs(runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The global capture history: all captures with ``position`` by url_key, time and page_id, from 0.

    Key ranges are cut by (url_key, time, page_id), so a URL with many captures
    spreads over several; each task merges its slice of all runs.
    """
    runs = stage(runs)
    ranges = partitions_for(runs.count(), merge_rows)
    cut = runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id").sortWithinPartitions("archive", "place")
    merged = stage(cut.mapInPandas(_merge, f"{_RUNS}, rank long").withColumn("part", F.spark_partition_id()))
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per merge task
    before = stage(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    return merged.join(before, "part").withColumn("position", F.col("before") + F.col("rank")).drop("part", "before", "rank", "place")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/archives/{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    history = merge_runs(capture_runs(spark, path))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")


QUERIES = {"op1_warc_index_merge": op1_warc_index_merge}

ORACLES = {"op1_warc_index_merge": r"""
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u, coalesce(html, '') AS b, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY b) ELSE page_id END AS top,
        CASE WHEN regexp_matches(u, '^[a-z][a-z0-9+.-]*://')
             THEN array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]*)', 1), '.')), ',') || ')' ||
                  coalesce(nullif(regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:www\.)?[^/:?#]*(?::\d+)?([^#]*)', 1), ''), '/')
             ELSE u END AS url_key,
        strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 315360000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM p)
SELECT page_id, payload_bytes, sha1(b) AS payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to, url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS position
FROM r"""}
