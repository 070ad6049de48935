"""Conversion of legacy ARC archives to WARC records.

An ARC file opens with a version block (filedesc://...) whose second line gives
the version and whose third names the fields of every header line; version 1
has five fields, version 2 ten.  Each record is a header line, as many bytes
as its last field declares, and a line break.  Archives may be gzip members, one for each record or
any other way.  A converted record gets a WARC type (warcinfo for the version block, response
for HTTP and DNS answers, else resource), an ISO date, digests of block and payload,
a record id that is a UUID made from the URL, date and block digest, so that
converting again gives the same ids, and its bytes as they stand in a WARC file;
``write_warc`` writes those.

Lengths alone say where a record ends: nothing inside a block is ever read as a header.

Results in odd cases
  * null or empty archive: no records.  An archive without version block: read as version 1.
  * a header line without a length or with too few fields: no border after it can be trusted, so
    what is left (of the gzip member, or of an archive that isn't compressed) is kept whole as one
    resource, urn:arc-unparsed:..., marked in ``note`` as header.
  * any URL with something in it is taken, whether it has a scheme or not.
  * a declared length beyond the end, or a damaged gzip member: what is there, marked truncated.
  * a date of 12 digits is taken as without seconds; one that is no date: the epoch, marked in ``note``.
  * equal records: equal ids, each reported.  Very long records: whole.
  * further columns of the archives' table are not read.
  * ``archives`` leaves out pages whose URL is null or empty (ARC has no place for them); a null html is an empty body.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SCHEMA = "warc_record_id string, warc_type string, warc_target_uri string, warc_date string, warc_ip_address string, content_type string, content_length long, warc_block_digest string, warc_payload_digest string, note string, record binary"
_END = b"\r\n\r\n"  # of every record in a file

Record = tuple[dict[str, str], bytes, str]  # header fields, block, what is wrong with it


def _header(line: bytes, version: int) -> dict[str, str] | None:
    parts = line.rstrip(b"\r").split(b" ")
    names = FIELDS[version]
    if len(parts) < len(names) or not parts[-1].isdigit() or len(parts[-1]) > 18:
        return None
    extra = len(parts) - len(names)  # blanks in an old URL
    parts = [b" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
    return {k: v.decode("utf-8", "replace") for k, v in zip(names, parts)} if parts[0].strip() else None


def _members(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """The gzip members' contents, and whether they are whole; data that isn't compressed as it is."""
    at = 0
    while data.startswith(b"\x1f\x8b", at):
        reader, out = zlib.decompressobj(31), []
        try:
            out.append(reader.decompress(data[at:]))
        except zlib.error:  # as far as it can be read, in small steps
            reader, out = zlib.decompressobj(31), []
            try:
                for i in range(at, len(data), 64):
                    out.append(reader.decompress(data[i : i + 64]))
            except zlib.error:
                pass
        yield b"".join(out), reader.eof
        at = len(data) - len(reader.unused_data) if reader.eof else data.find(b"\x1f\x8b\x08", at + 2)
        if at < 0 or at >= len(data):
            return
    if at < len(data):
        yield data[at:], True


def read(data: bytes) -> Iterator[Record]:
    """(header fields, block, note) of every record, the version block first."""
    version = 1
    for part, whole in _members(data):
        at = 0
        while at < len(part):
            if part[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = part.find(b"\n", at)
            end = len(part) if end < 0 else end
            first = part.startswith(b"filedesc://", at)
            if first:  # the block begins with the version, by which its own header line is read too
                version = 2 if part[end + 1 : end + 3] == b"2 " else 1
            head = _header(part[at:end], version) or (_header(part[at:end], 1) if first else None)
            if head is None:
                rest = part[at:]
                yield {"url": "urn:arc-unparsed:" + hashlib.sha256(rest).hexdigest(), "ip": "0.0.0.0", "date": "", "mime": "application/octet-stream"}, rest, "header"
                break
            at = end + 1
            length = int(head["length"])
            block = part[at : at + length]
            at += length
            yield head, block, "truncated" if len(block) < length or (not whole and not part[at:].strip(b"\r\n")) else ""


def iso_date(digits: str) -> tuple[str, bool]:
    for form in ("%Y%m%d%H%M%S", "%Y%m%d%H%M"):
        try:
            if len(digits) == {"%Y%m%d%H%M%S": 14, "%Y%m%d%H%M": 12}[form]:
                return dt.datetime.strptime(digits, form).strftime("%Y-%m-%dT%H:%M:%SZ"), True
        except ValueError:
            pass
    return "1970-01-01T00:00:00Z", False


def record(head: dict[str, str], block: bytes, wrong: str = "") -> tuple:
    """The WARC fields of one ARC record, in the order of SCHEMA."""
    date, good = iso_date(head["date"])
    url = head["url"]
    http = block[:5] == b"HTTP/"
    kind = "warcinfo" if url.startswith("filedesc:") else "response" if http or url.startswith("dns:") else "resource"
    mime = "application/http; msgtype=response" if http else head["mime"]
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    digest, of_payload = ("sha256:" + hashlib.sha256(x).hexdigest() for x in (block, payload))
    x = hashlib.md5(f"{url} {date} {digest}".encode()).hexdigest()
    rid = f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"
    notes = [n for n in (wrong, "" if good or wrong == "header" else "date") if n]
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"Content-Type: {mime}", f"Content-Length: {len(block)}", f"WARC-Block-Digest: {digest}"]
    lines += [f"WARC-Filename: {url.rpartition('/')[2]}"] if kind == "warcinfo" else [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {head['ip']}", f"WARC-Payload-Digest: {of_payload}"]
    lines += ["WARC-Truncated: length"] if wrong == "truncated" else []
    raw = "\r\n".join(x.replace("\r", "%0D") for x in lines).encode() + b"\r\n\r\n" + block + _END
    return (rid, kind, url, date, head["ip"], mime, len(block), digest, of_payload, ",".join(notes) or None, raw)


def convert(archives: DataFrame) -> DataFrame:
    """Every record of a table with a binary column ``archive``: its WARC fields, and the record as it stands in a WARC/1.0 file."""
    fields = [x.split() for x in SCHEMA.split(", ")]
    names, kinds = [n for n, _ in fields], [{"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string()) for _, k in fields]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for archive in b.column("archive"):
                for r in read(archive.as_py() or b""):
                    rows.append(record(*r))
                    held += rows[-1][6]
                    if held > 16_000_000 or len(rows) == 10_000:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return archives.select("archive").mapInArrow(run, SCHEMA)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """The records (column ``record``) as WARC files: every record's bytes, whatever they are, each ended by two line breaks."""
    body = F.substring("record", F.lit(1), F.length("record") - len(_END)).cast("string")  # a cast, which leaves bytes as they are
    records.select(body.alias("value")).write.option("lineSep", _END.decode()).option("compression", compression).text(path)


def write_arc(name: str, version: int, records: list[tuple[str, str, str, str, bytes]], compressed: bool = False) -> bytes:
    """An ARC file of (url, ip, 14-digit date, MIME type, block) records; compressed: each record a gzip member."""
    about = f"{version} 0 tessera\n{_NAMES[version]}\n".encode()
    mid = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 20040101000000 text/plain{mid} {len(about)}\n".encode() + about]
    offset = len(out[0]) + 1
    for url, ip, date, mime, block in records:
        mid = "" if version == 1 else f" 200 - - {offset} {name}"
        out.append(f"{url} {ip} {date} {mime}{mid} {len(block)}\n".encode() + block)
        offset += len(out[-1]) + 1
    return b"".join(gzip.compress(x + b"\n", 1, mtime=0) if compressed else x + b"\n" for x in out)


def archives(pages: DataFrame) -> DataFrame:
    """(archive): for each page an ARC file of its version block, the host's DNS answer and the page, as a crawler that closes its file after every fetch leaves them.

    By page_id, half of them are version 1 and half 2, and half of each are gzip members; date and address, which pages lack, follow from it too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pid, url, host, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "html"))):
                pid = pid or 0
                body = (html or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                date = (dt.datetime(2004, 1, 1) + dt.timedelta(seconds=pid % 31_536_000)).strftime("%Y%m%d%H%M%S")
                ip = f"192.0.2.{pid % 250 + 1}"
                answer = f"{date}\n{host}. 3600 IN A {ip}\n".encode()
                out.append(write_arc(f"page-{pid}.arc", 1 + pid % 2, [(f"dns:{host}", "192.0.2.253", date, "text/dns", answer), (url, ip, date, "text/html", block)], pid // 2 % 2 == 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["archive"])

    url = F.replace(F.replace(F.replace("url", F.lit(" "), F.lit("%20")), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))
    rows = pages.where("url <> ''").select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), "html")
    return rows.select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), "html").mapInArrow(run, "archive binary")


_CRLF = "chr(13) || chr(10)"
SQL = rf"""
WITH u AS (
  SELECT coalesce(page_id, 0) AS pid, replace(replace(replace(url, ' ', '%20'), chr(10), '%0A'), chr(13), '%0D') AS u, coalesce(html, '') AS body FROM pages WHERE url <> ''),
p AS (
  SELECT *, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS host, TIMESTAMP '2004-01-01' + to_seconds(pid % 31536000) AS t, '192.0.2.' || (pid % 250 + 1) AS ip FROM u),
r AS (
  SELECT 'warcinfo' AS kind, 'filedesc://page-' || pid || '.arc' AS uri, TIMESTAMP '2004-01-01' AS t, '0.0.0.0' AS ip, 'text/plain' AS mime, '' AS head,
    CASE WHEN pid % 2 = 0 THEN '1 0 tessera' || chr(10) || '{_NAMES[1]}' ELSE '2 0 tessera' || chr(10) || '{_NAMES[2]}' END || chr(10) AS body FROM p
  UNION ALL SELECT 'response', 'dns:' || host, t, '192.0.2.253', 'text/dns', '', strftime(t, '%Y%m%d%H%M%S') || chr(10) || host || '. 3600 IN A ' || ip || chr(10) FROM p
  UNION ALL SELECT 'response', u, t, ip, 'application/http; msgtype=response', 'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(body) || {_CRLF} || {_CRLF}, body FROM p),
x AS (SELECT *, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS d, 'sha256:' || sha256(head || body) AS digest, 'sha256:' || sha256(body) AS inner_digest FROM r),
y AS (SELECT *, md5(uri || ' ' || d || ' ' || digest) AS m FROM x),
z AS (SELECT *, '<urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) || '>' AS rid FROM y)
SELECT rid AS warc_record_id, kind AS warc_type, uri AS warc_target_uri, d AS warc_date, ip AS warc_ip_address, mime AS content_type,
  CAST(strlen(head || body) AS BIGINT) AS content_length, digest AS warc_block_digest, inner_digest AS warc_payload_digest, CAST(NULL AS VARCHAR) AS note,
  'WARC/1.0' || {_CRLF} || 'WARC-Type: ' || kind || {_CRLF} || 'WARC-Record-ID: ' || rid || {_CRLF} || 'WARC-Date: ' || d || {_CRLF} || 'Content-Type: ' || mime || {_CRLF}
  || 'Content-Length: ' || strlen(head || body) || {_CRLF} || 'WARC-Block-Digest: ' || digest || {_CRLF}
  || CASE WHEN kind = 'warcinfo' THEN 'WARC-Filename: ' || regexp_extract(uri, '[^/]*$') ELSE 'WARC-Target-URI: ' || uri || {_CRLF} || 'WARC-IP-Address: ' || ip || {_CRLF} || 'WARC-Payload-Digest: ' || inner_digest END
  || {_CRLF} || {_CRLF} || head || body || {_CRLF} || {_CRLF} AS record
FROM z
"""
