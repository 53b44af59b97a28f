"""WARC archives of pages, and their capture index by an external merge.

Pages become WARC/1.1 records in gzip files written by Spark's text writer,
whose line end is the record end; a payload seen before becomes a revisit of its
response. Reading an archive back gives its captures, sorted by URL key and
time: one run per archive. The runs are cut at common key boundaries, and each
range is merged from its runs by a loser tree, so the index is globally ordered
and a URL with very many captures is cut by time like any other stretch.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.base import written
from rolesift.operators.joins import look_up

CRLF = "\r\n"
RECORD_END = CRLF + CRLF
RECORDS_PER_FILE = 2_000
ROWS_PER_RANGE = 200_000
#: Host, path and query of a URL.
URL = re.compile(r"(?:[^:/?#]+:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", re.DOTALL)
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
# Fixed value: the profile name of the WARC standard for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = (
    "urlkey string, timestamp string, file string, offset long, seq long, url string, page_id long, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, intact boolean")


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 SHA-1: five hexadecimal digits become four."""
    digest = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("-"))))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def capture_time(page_id: Column) -> Column:
    """An ISO time per page for tables without one: seconds after the start of 2026, by page id."""
    seconds = F.coalesce(F.pmod(page_id, F.lit(31_536_000)), F.lit(0)) + 1_767_225_600
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html, time) with digest, size, record_type and refers_to.

    Of equal payloads of at least ``least_bytes`` the smallest page_id is the
    response; rows that repeat this id are responses too. A NULL page_id counts
    as larger than any; if all are NULL, all are responses.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.withColumn("html", payload).withColumn("digest", base32_sha1(payload)).withColumn(
        "bytes", F.octet_length(payload).cast("long"))
    # Combined before the shuffle; only payloads that occur again are looked up.
    first = written(
        rows.filter(F.col("bytes") >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "payloads")
    found = look_up(rows, first, ["digest"], F.col("page_id"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("first"))).drop("first")


def warc_record(decided: DataFrame) -> DataFrame:
    """One text column: the record without its end."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    revisit = F.col("record_type") == "revisit"
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "_")
    http = F.concat(F.lit(HTTP_HEAD), F.col("bytes").cast("string"), F.lit(RECORD_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", clean_url), line("WARC-Date", F.col("time")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))), F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to")))),
        line("X-Page-ID", F.col("page_id").cast("string")), line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")))
    return decided.select(F.concat(head, F.lit(RECORD_END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, time: Column | None = None, id_column: str = "page_id",
                   url_column: str = "url", html_column: str = "html") -> None:
    """A WARC record per row of ``pages``, in gzip files of at most RECORDS_PER_FILE records under ``path``."""
    rows = pages.select(
        pages[f"`{id_column}`"].cast("long").alias("page_id"), pages[f"`{url_column}`"].alias("url"),
        pages[f"`{html_column}`"].alias("html"),
        (time if time is not None else capture_time(pages[f"`{id_column}`"])).alias("time"))
    warc_record(decide(rows, least_bytes)).write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, in lower case: pages of a site are neighbours.

    Any text has a key: what has no scheme or host is all path.
    """
    host, path, query = URL.match(url).groups("")
    host = ",".join(reversed(host.rpartition("@")[2].lower().split(".")))
    return f"{host}){path.lower() or '/'}" + (f"?{query.lower()}" if query else "")


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the uncompressed stream, header, block) of each record; lengths rule, not the content."""
    at = 0
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        header, size = {}, len(first)
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name.lower()] = value.strip()
        length = int(header["content-length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut off")
        yield at, header, block
        at += size + 2 + length + 4


def _captures(file: str, content: bytes) -> list[dict]:
    """The captures of one archive as a sorted run."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    rows = []
    for offset, header, block in read_records(stream):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
        digest = header["warc-payload-digest"].removeprefix("sha1:")
        response = header["warc-type"] == "response"
        number = {k: int(header[k]) if k in header else None for k in ("x-page-id", "x-refers-to-page-id")}
        rows.append({
            "urlkey": url_key(header["warc-target-uri"]), "timestamp": re.sub(r"\D", "", header["warc-date"]), "file": file,
            "offset": offset, "url": header["warc-target-uri"], "page_id": number["x-page-id"], "record_type": header["warc-type"],
            "payload_bytes": len(payload) if response else stated, "refers_to": number["x-refers-to-page-id"],
            "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else digest,
            "intact": not response or (
                stated == len(payload) and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)})
    rows.sort(key=lambda r: (r["urlkey"], r["timestamp"], r["offset"]))
    return [r | {"seq": i} for i, r in enumerate(rows)]


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in CAPTURE.split(", "))])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per archive under ``path``; ``seq`` is the place in the run."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow()
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("path")[i].as_py().rpartition("/")[2]
                yield pa.RecordBatch.from_pylist(_captures(name, batch.column("content")[i].as_py()), schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(self.k, 1)
        for run in range(self.k):
            self._play(run)

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            if self.losers[node] < 0:
                # The first to arrive waits for its opponent.
                self.losers[node] = run
                return
            if self._beats(self.losers[node], run):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator:
        while self.k and (head := self._head(winner := self.losers[0])) is not None:
            yield head
            self.at[winner] += 1
            self._play(winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in order of URL key, time, archive and offset, over all partitions in turn.

    ``runs`` is a written table. Repeated captures stay; an empty table gives an
    empty index. A range has some ROWS_PER_RANGE captures however many there
    are; file and offset tell all apart, so no key owns a range.
    """
    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        keys = list(zip(*[table.column(c).to_pylist() for c in ("urlkey", "timestamp", "file", "offset")],
                        range(table.num_rows), strict=True))
        parts: dict[str, list] = {}
        for key in keys:
            parts.setdefault(key[2], []).append(key)
        order = [key[4] for key in LoserTree(list(parts.values()))]
        yield from table.take(order).to_batches(max_chunksize=10_000)

    ranges = max(-(-runs.count() // ROWS_PER_RANGE), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = runs.repartitionByRange(ranges, "urlkey", "timestamp", "file", "offset").sortWithinPartitions("file", "seq")
    return cut.mapInArrow(merged, CAPTURE)


def capture_index(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Pages written as archives under ``path``, read back and indexed: one row per record, in index order."""
    write_archives(pages, path, least_bytes)
    return merge_runs(written(read_runs(pages.sparkSession, path), "capture-runs"))
