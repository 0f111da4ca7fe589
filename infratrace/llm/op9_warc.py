"""Legacy ARC archives to WARC, and WARC archives back to records.

An ARC file opens with a version block whose last line names the fields of every later header line
(five in version 1, ten in version 2); a record is such a line and as many bytes as its last field
declares. `parse_arc` reads by those names and lengths. `warc_records` gives each record its WARC
equivalents: a name-based UUID over the archive's name, the record's place in it, address, time and
digest (so equal records differ and a repeated run agrees), the 14-digit time as ISO 8601, a type
(warcinfo, response for an HTTP answer, resource for anything else) and SHA-1 digests of block and
payload in base32. Records whose payload another record of a smaller page_id has become revisits:
they keep the HTTP header lines, drop the payload and name the record they repeat.

Only digests are grouped, and only those met more than once are kept and joined back; the planner
sends that table to every task if its size allows and shuffles both sides if not. Archives are packed
up to `file_bytes`, since a file is read by one task, and written by Spark's text writer, one file a
row with the closing blank lines as line end, so they are plain WARC files.

A null html is an empty payload; a null url stands as about:blank; a null page_id stays null, and
never is the one that others refer to unless all are null (then all are responses). Rows that repeat
both page_id and html are all responses if that page_id is the smallest. Payloads below `min_bytes`
are never revisits. An empty table gives no records. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, shared_path, stash, table

#: The field names of ARC's header lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: what closes a WARC record.
GAP = b"\r\n\r\n"
#: Bytes of an ARC segment at most (but for its last record).
SEGMENT = 4_000_000
#: Bytes of a WARC file at most (but for its last record).
FILE_BYTES = 32 << 20
MIN_BYTES = 0
#: What is taken for a page_id; a foreign archive may hold anything there.
PAGE_ID = re.compile(r"-?[0-9]{1,18}")


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- ARC ----------------------------------------------------------------------------------------

def arc_header(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 infratrace\n{ARC_FIELDS[version]}\n\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(body))}
    return _arc_line(values, version) + body


def _arc_line(values: dict[str, str], version: int) -> bytes:
    return (" ".join(values.get(k, "-") for k in ARC_FIELDS[version].split(" ")) + "\n").encode()


def arc_record(url: str, ip: str, date: str, content_type: str, content: bytes, version: int) -> bytes:
    safe = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "about:blank"
    values = {"URL": safe, "IP-address": ip, "Archive-date": date, "Content-type": content_type, "Result-code": "200", "Archive-length": str(len(content))}
    return _arc_line(values, version) + content + b"\n"


def inflated(data: bytes) -> bytes:
    """The bytes of an ARC file whose records are gzip members, or data itself."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member of an ARC file does not end")
        data = member.unused_data
    return b"".join((*out, data))


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of each record, the version block first. Field names are the file's own. Files may be
    compressed record by record; spaces beyond the fields belong to the URL, which is the first of them."""
    names, at, data = ARC_FIELDS[1].split(" "), 0, inflated(data)
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError(f"the ARC header line at byte {at} does not end")
            return
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if values == [""]:  # blank lines between records
            at = end + 1
            continue
        size = int(values[-1])
        content = data[end + 1:end + 1 + size]
        if len(content) != size:
            raise ValueError(f"an ARC record at byte {at} declares {size} bytes and has {len(content)}")
        if values[0].startswith("filedesc://"):
            lines = content.decode("utf-8", "replace").split("\n")
            names = lines[1].strip().split(" ")
            yield dict(zip((ARC_FIELDS[1] if len(values) == 5 else ARC_FIELDS[2]).split(" "), values)) | {"version": lines[0].split(" ")[0]}, content
        else:
            more = max(len(values) - len(names), 0)
            values = [" ".join(values[:more + 1]), *values[more + 1:]]
            if len(values) != len(names):
                raise ValueError(f"an ARC record at byte {at} has {len(values)} fields, not {len(names)}")
            yield dict(zip(names, values)), content
        at = end + 1 + size


def pages_to_arc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20200101000000", segment: int = SEGMENT, name: str = "part") -> DataFrame:
    """arc: segments of ARC records, versions 1 and 2 in turn, each an HTTP answer that holds a page. Record ids
    derive from the archives' names: give each corpus a `name` of its own."""
    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pd.DataFrame:
            version = number % 2 + 1
            return pd.DataFrame({"arc": [b"".join([arc_header(f"{name}-{part}-{number}.arc", version, date), *(arc_record(u, "0.0.0.0", date, "text/html", c, version) for u, c in held)])]})

        for frame in rows:
            for i, u, h in zip(frame["page_id"].tolist(), frame["url"].tolist(), frame["html"].tolist()):
                body = (h or "").encode("utf-8")
                own = "" if i is None else f"X-Page-Id: {i}\r\n"
                held.append((u or "", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode() + body))
                size += len(body)
                if size >= segment:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    chosen = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return chosen.mapInPandas(pack, "arc binary")


# -- conversion ---------------------------------------------------------------------------------

def iso_time(stamp: str) -> str:
    """An ARC time (14 digits, older files 12) as a WARC-Date; what is no time becomes the epoch."""
    s = stamp.ljust(14, "0") if re.fullmatch(r"\d{12}(\d{2})?", stamp) else "19700101000000"
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def _header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


RECORD = "type string, record_id string, uri string, ip string, date string, content_type string, page_id long, head string, payload string, payload_sha1 string, payload_digest string, payload_bytes long, block_digest string, head_digest string, head_bytes long"


def warc_records(arcs: DataFrame, arc: str = "arc") -> DataFrame:
    """The records of ARC files (column `arc`, whole files or segments) as WARC record rows."""
    def convert(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for data in frame["arc"]:
                out, archive = [], ""
                for place, (f, content) in enumerate(parse_arc(data)):
                    uri, date = f["URL"], iso_time(f["Archive-date"])
                    head, payload = b"", content
                    if uri.startswith("filedesc://"):
                        kind, mime, archive = "warcinfo", "text/plain", uri
                    elif content.startswith(b"HTTP/") and (cut := content.find(b"\r\n\r\n")) >= 0:
                        kind, mime = "response", "application/http; msgtype=response"
                        head, payload = content[:cut + 4], content[cut + 4:]
                    else:
                        kind, mime = "resource", f["Content-type"]
                    page = _header(head, "X-Page-Id") or ""
                    digest = base32(payload)
                    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive} {place} {uri} {date} {digest}")
                    out.append((kind, f"<urn:uuid:{ident}>", uri, f["IP-address"], date, mime, int(page) if PAGE_ID.fullmatch(page) else None, head, payload, base64.b32decode(digest).hex(), digest, len(payload), base32(content), base32(head), len(head)))
                frame_out = pd.DataFrame(out, columns=[c.split(" ")[0] for c in RECORD.split(", ")])
                frame_out["page_id"] = frame_out["page_id"].astype("Int64")
                yield frame_out

    binary = RECORD.replace("head string", "head binary").replace("payload string", "payload binary")
    rows = arcs.select(F.col(arc).alias("arc")).mapInPandas(convert, binary)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("head", "payload")})


def repeated_payloads(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """payload_sha1, first_page of the payloads that more than one page_id has."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    digests = pages.select(F.sha1(body).alias("payload_sha1"), F.col(page_id).alias("page_id"), F.octet_length(body).alias("size")).where(F.col("size") >= min_bytes)
    return digests.groupBy("payload_sha1").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first_page").isNotNull()).drop("n")


def mark_revisits(records: DataFrame, repeated: DataFrame) -> DataFrame:
    """refers_to: the page whose payload this record repeats, null for the first and for unique ones."""
    first = F.col("first_page")
    again = (F.col("type") == "response") & first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    return records.join(repeated, "payload_sha1", "left").withColumn("refers_to", F.when(again, first)).drop("first_page")


def warc_text() -> Column:
    """A record row as WARC header lines, blank line and block."""
    c = F.col
    revisit = c("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    when = lambda cond, value: F.when(cond, value).otherwise("")
    return F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise(c("type"))),
        line("WARC-Record-ID", c("record_id")),
        line("WARC-Date", c("date")),
        line("WARC-Target-URI", c("uri")),
        line("WARC-IP-Address", c("ip")),
        when(revisit, line("WARC-Profile", F.lit(REVISIT))),
        when(revisit, line("X-Refers-To-Page", c("refers_to").cast("string"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, c("head_digest")).otherwise(c("block_digest")))),
        line("Content-Type", c("content_type")),
        line("Content-Length", F.when(revisit, c("head_bytes")).otherwise(c("head_bytes") + c("payload_bytes")).cast("string")),
        F.lit("\r\n\r\n"), c("head"), F.when(revisit, "").otherwise(c("payload")),
    )


def write_warc(records: DataFrame, out: str, file_bytes: int = FILE_BYTES) -> None:
    """Write marked record rows as .warc text files of about `file_bytes` to the folder `out`."""
    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in rows:
            for record in frame["record"]:
                held.append(record)
                size += len(record)
                if size >= file_bytes:
                    yield pd.DataFrame({"file": [GAP.join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"file": [GAP.join(held)]})

    files = records.select(warc_text().cast("binary").alias("record")).mapInPandas(pack, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", GAP.decode()).option("maxRecordsPerFile", 1).text(out)


# -- reading ------------------------------------------------------------------------------------

def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-case names, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 8 + size


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """record_type, record_id, uri, date, page_id, refers_to, payload (null in revisits), payload_bytes, payload_digest, digest_ok."""
    def unpack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for data in frame["content"]:
                out = []
                for f, block in parse_warc(data):
                    head, payload = b"", block
                    if f["content-type"].startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                    page, refers, revisit = _header(head, "X-Page-Id"), f.get("x-refers-to-page"), f["warc-type"] == "revisit"
                    stated = f["warc-payload-digest"].removeprefix("sha1:")
                    size = int(_header(head, "Content-Length") or 0) if revisit else len(payload)
                    out.append((f["warc-type"], f["warc-record-id"], f["warc-target-uri"], f["warc-date"], page and int(page), refers and int(refers), None if revisit else payload, size, stated if revisit else base32(payload), base32(block) == f["warc-block-digest"].removeprefix("sha1:")))
                got = pd.DataFrame(out, columns=["record_type", "record_id", "uri", "date", "page_id", "refers_to", "payload", "payload_bytes", "payload_digest", "digest_ok"])
                for c in ("page_id", "refers_to"):
                    got[c] = got[c].astype("Int64")
                yield got

    schema = "record_type string, record_id string, uri string, date string, page_id long, refers_to long, payload binary, payload_bytes long, payload_digest string, digest_ok boolean"
    return spark.read.format("binaryFile").load(folder).select("content").mapInPandas(unpack, schema)


def pages_to_warc(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Pages through ARC segments to WARC files in the folder `out`."""
    bound_batches(pages.sparkSession)
    repeated = stash(repeated_payloads(pages, page_id, html, min_bytes), "repeated")
    write_warc(mark_revisits(warc_records(pages_to_arc(pages, page_id, url, html)), repeated), out, file_bytes)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    pages_to_warc(table(spark, sf_dir, "pages"), folder)
    read = read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
