"""Legacy archives: ARC files of either version converted to WARC, and both read.

ARC header lines are parsed by the fields that the version block of their file
declares (version 1: five, version 2: ten), and contents by their declared
lengths.  Each record gets an equivalent WARC record: an identifier made of its
file and its place there, its 14-digit date as a timestamp, a type, and SHA-1
digests of block and payload.  An HTTP answer is a response; what has no HTTP
head (a ``dns:`` record, say) is a resource of its own content type;
the version block becomes a warcinfo record, which the others name.  Contents
are bytes throughout.  HTTP records with equal payloads of at least ``SHARED``
bytes become revisits of the one with the largest page id.

Archives are written by Spark's text writer, one row a file, gzipped, of at most
``PER_FILE`` records and ``FILE_BYTES`` bytes (one longer record stands alone);
so any store Spark writes to will do, and a file is small enough to be read whole.

Defined results: null html counts as empty, a null url gets a urn of the page;
characters that a header line can't hold are percent-encoded, and a url with
blanks is read as one; of rows that share the largest page id of equal payloads
one is the response; a record shorter than its header declares is kept as it is
and marked ``WARC-Truncated``; bytes that are no UTF-8 pass through; a header line
without the declared fields is an error; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Records in an archive file.
PER_FILE = 500
#: Bytes from which an archive file is full.
FILE_BYTES = 16 << 20
#: Bytes from which equal payloads are stored once.
SHARED = 1000
#: Bytes of payload that a worker gathers before it hands them on.
GATHERED = 4 << 20

#: Fixed by the format: the fields of a header line by version.
FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def version_block(version: str, name: str, date: str) -> str:
    body = f"{version} 0 tickloom\n{' '.join(FIELDS[version])}\n"
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == "2" else [])
    return " ".join([*head, str(len(body))]) + "\n" + body


def arc_record(version: str, url: str, ip: str, date: str, mime: str, content: bytes, name: str) -> bytes:
    head = [url, ip, date, mime] + (["200", hashlib.md5(content).hexdigest(), "-", "0", name] if version == "2" else [])
    return " ".join([*head, str(len(content))]).encode() + b"\n" + content


def arc_records(raw: bytes) -> Iterator[dict]:
    """The records of an ARC file, each a dict of its header fields, ``content`` and ``offset``.

    The version block is one of them, with ``filedesc`` true.  Header lines that do not have
    the declared fields raise ValueError; a record shorter than declared has ``truncated`` set.
    """
    at, fields, version = 0, None, ""
    while at < len(raw):
        if raw[at] in b"\r\n":
            at += 1
            continue
        stop = raw.find(b"\n", at)
        line = raw[at : stop if stop >= 0 else len(raw)].decode("latin-1").rstrip("\r")
        words = line.split(" ")
        begin = stop + 1 if stop >= 0 else len(raw)
        length = int(words[-1]) if words[-1].isdecimal() and words[-1].isascii() else -1
        content = raw[begin : begin + length]
        shared = {"content": content, "offset": at, "truncated": begin + length > len(raw)}
        if line.startswith("filedesc://"):
            version = content.split(b" ", 1)[0].decode("latin-1")
            if version not in FIELDS:
                raise ValueError(f"ARC version {version!r}")
            fields = FIELDS[version]
            yield dict(zip(FIELDS["1"], [*words[:4], words[-1]], strict=False)) | shared | {"version": version, "filedesc": True}
        elif fields is None or len(words) < len(fields) or length < 0:
            raise ValueError(f"ARC header line {line[:100]!r}")
        else:
            spare = len(words) - len(fields)
            words = ["%20".join(words[: spare + 1]), *words[spare + 1 :]]
            yield dict(zip(fields, words, strict=True)) | shared | {"version": version, "filedesc": False}
        at = begin + length


def date_of(arc_date: str) -> str:
    """14 digits, fewer filled up, as a WARC timestamp."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Head and payload; a content without the blank line is all head."""
    head, sep, body = content.partition(b"\r\n\r\n")
    if not sep:
        head, sep, body = content.partition(b"\n\n")
    return head + sep, body


def kind_of(record: dict) -> str:
    """The WARC type that stands for an ARC record."""
    if record["filedesc"]:
        return "warcinfo"
    return "response" if record["content"].startswith(b"HTTP/") else "resource"


def header(head: str, name: str) -> str | None:
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$", head)
    return found[1] if found else None


def page_of(head: str) -> int | None:
    """The page id that an HTTP head bears, if it is one."""
    found = header(head, "X-Page-Id") or ""
    return int(found) if re.fullmatch(r"-?[0-9]{1,18}", found) else None


def sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def identity(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block


def warc_records(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Header text and block of each record, by the declared lengths."""
    at = 0
    while at < len(raw):
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = raw[at:stop].decode("utf-8", "replace")
        length = int(header(head, "Content-Length"))
        yield head, raw[stop + 4 : stop + 4 + length]
        at = stop + 8 + length


def _archives(records: Iterator[bytes], separator: bytes, opening: Callable[[int], bytes], limits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """One archive a batch: an opening record and those that follow, up to a file's records or bytes."""
    held: list[bytes] = []
    size = serial = 0
    for record in records:
        if held and (len(held) > limits[0] or size + len(record) > limits[1]):
            yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], ["value"])
            held, size, serial = [], 0, serial + 1
        if not held:
            held.append(opening(serial))
        held.append(record)
        size += len(record)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], ["value"])


def _written(archives: DataFrame, separator: str) -> DataFrame:
    """The archive files as (path, content) of binaryFile rows, after they are written."""
    spark = archives.sparkSession
    path = common.shared_dir(spark)
    # the cast keeps every byte, also those that are no UTF-8
    lines = archives.select(F.col("value").cast("string"))
    lines.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame) -> DataFrame:
    """Pages as ARC files, of version 1 or 2 by a hash of the page; the files as binaryFile rows."""
    from pyspark import TaskContext

    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    limits = PER_FILE, FILE_BYTES
    half = F.pmod(F.xxhash64("page_id", "url"), F.lit(2))

    def run(batches: Iterator[pa.RecordBatch], version: str) -> Iterator[pa.RecordBatch]:
        part = f"{version}-{TaskContext.get().partitionId()}"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    body = (html or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n"
                    where = quote(url or f"urn:page:{page}", safe="!#$%&'()*+,/:;=?@[]~")
                    yield arc_record(version, where, "0.0.0.0", "20240101000000", "text/html", head.encode() + body, f"pages-{part}")

        yield from _archives(records(), b"\n", lambda k: version_block(version, f"pages-{part}-{k}.arc", "20240101000000").encode(), limits)

    parts = [pages.filter(half == k).mapInArrow(partial(run, version=v), "value binary") for k, v in enumerate("12")]
    return _written(parts[0].union(parts[1]), "\n")


PARSED = "page_id long, record_id string, info_id string, kind string, url string, ip string, date string, mime string, truncated boolean, http binary, payload binary, payload_bytes long, digest string"


def parse_arc(files: DataFrame, contents: bool = True) -> DataFrame:
    """The records of ARC files, (path, content), with their WARC identifiers, types, timestamps and digests.

    Without ``contents``, http and payload are null: what the search for copies needs.
    """
    names = [x.split()[0] for x in PARSED.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [types[x.split()[1]] for x in PARSED.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for files in batches:
            for k in range(files.num_rows):
                path, info = files.column(0)[k].as_py(), None
                raw = files.column(1)[k].as_py()
                for r in arc_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    kind, record = kind_of(r), identity(path, r["offset"])
                    http, body = split_http(r["content"]) if kind == "response" else (b"", r["content"])
                    if kind == "warcinfo":
                        info = record
                    rows.append((page_of(http.decode("latin-1")), record, info, kind, r["URL"], r["IP-address"], date_of(r["Archive-date"]), r["Content-type"], r["truncated"], http if contents else None, body if contents else None, len(body), sha1(body)))
                    held += len(body) * contents + 200
                    if held > GATHERED:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return files.mapInArrow(run, PARSED)


def write_warc(files: DataFrame) -> DataFrame:
    """The records of ARC files as WARC files, copies as revisits; the files as binaryFile rows."""
    from pyspark import TaskContext

    top = F.max(F.struct("page_id", "record_id", "url", "date")).alias("top")
    records = parse_arc(files)
    able = (F.col("payload_bytes") >= SHARED) & (F.col("kind") == "response")
    copies = parse_arc(files, contents=False).filter(able).groupBy("digest").agg(top, F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("copied"), F.col("top.record_id").alias("refers"), F.col("top.url").alias("refers_url"), F.col("top.date").alias("refers_date"))
    marked = records.join(common.stored(copies), (F.col("digest") == F.col("copied")) & (F.col("kind") == "response"), "left").withColumn("refers", F.expr("nullif(refers, record_id)")).select(*records.columns, "refers", "refers_url", "refers_date")
    job, limits = uuid.uuid4().hex, (PER_FILE, FILE_BYTES)

    def converted(page, record, info, kind, url, ip, date, mime, truncated, http, payload, size, digest, refers, refers_url, refers_date) -> bytes:
        fields = {"WARC-Type": kind, "WARC-Record-ID": record, "WARC-Date": date}
        if kind == "warcinfo":
            lines = payload.decode("latin-1").split("\n")
            body = f"format: WARC File Format 1.1\r\nconverted-from: ARC {lines[0].strip()}\r\narc-fields: {lines[1].strip() if len(lines) > 1 else ''}\r\n".encode()
            return warc_record(fields | {"WARC-Filename": url.removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}, body)
        block = http if refers else http + payload
        if refers:
            fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT, "WARC-Refers-To": refers, "WARC-Refers-To-Target-URI": refers_url, "WARC-Refers-To-Date": refers_date}
        mime = "application/http; msgtype=response" if kind == "response" else mime if "/" in mime else "application/octet-stream"
        fields |= {"WARC-Target-URI": url, "WARC-IP-Address": None if ip in ("", "-", "0.0.0.0") else ip, "WARC-Warcinfo-ID": info, "WARC-Truncated": "unspecified" if truncated else None}
        return warc_record(fields | {"WARC-Payload-Digest": digest, "WARC-Block-Digest": sha1(block), "Content-Type": mime}, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def own() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(16)), strict=True):
                    yield converted(*row)

        yield from _archives(own(), b"\r\n\r\n", lambda k: warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": identity(job, part, k), "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), limits)

    return _written(marked.mapInArrow(run, "value binary"), "\r\n\r\n")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string"


def read_warc(files: DataFrame) -> DataFrame:
    """One row per response, revisit or resource; digests are those of the payload itself, checked against the header, but for revisits."""
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for k in range(files.num_rows):
                rows = []
                for head, block in warc_records(gzip.decompress(files.column(1)[k].as_py())):
                    kind = header(head, "WARC-Type")
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    http, body = (b"", block) if kind == "resource" else split_http(block)
                    top = http.decode("latin-1")
                    digest = header(head, "WARC-Payload-Digest")
                    if kind != "revisit" and sha1(body) != digest:
                        raise ValueError(f"{header(head, 'WARC-Record-ID')}: the payload does not have its digest")
                    size = int(header(top, "Content-Length") or 0) if kind == "revisit" else len(body)
                    rows.append((page_of(top), size, base64.b32decode(digest[5:]).hex(), kind, header(head, "WARC-Record-ID"), header(head, "WARC-Refers-To")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.mapInArrow(run, READ)


def convert(pages: DataFrame) -> DataFrame:
    """Pages through ARC files, the converter and WARC files, read back: one row per page."""
    found = common.only(lambda: read_warc(write_warc(write_arc(pages))))
    named = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("named")).agg(F.max("page_id").alias("refers_to"))
    revisits = found.filter("record_type = 'revisit'").join(named, F.col("refers") == F.col("named"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(common.table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS place FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN top END AS refers_to
FROM k
"""
