"""Web archives: pages to legacy ARC files, ARC (version 1 and 2) to WARC, and WARC back to rows.

Archives are gzip text files that Spark writes and reads below ``spark.checkpoint.dir``: an ARC
record ends with a line feed, a WARC record with two CRLFs, which is what the text writer puts
between rows.  Gzip files are not split, so a task reads an archive as one stream of lines; the
parser takes each record's declared length from that stream and so holds one record at a time.

Conversion: a record's identifier is made from its archive and offset, its date from the 14-digit
ARC date, its type from URL scheme and content, its digests (SHA-256) from block and payload.
Of records with equal payloads of ``least`` bytes or more, the one with the smallest key (the
``X-Page-Id`` of its HTTP header) stays a response; the others become revisits that carry no
payload but its digest and length.

Defined results: null html is an empty payload; a null page_id sorts after all others; of equal
records with the same page_id one (the least identifier) is the response; a null url is ``-``.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm.common import mapped, stored
from hitweave.session import scratch_path

# Fixed values of the formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_PAYLOAD = 100
BATCH_BYTES = 4 << 20
MAX_LONG = 2**63 - 1


class Stream:
    """Bytes of one archive from its lines."""

    def __init__(self, lines: Iterable[bytes]):
        self._lines, self._rest, self.offset = iter(lines), b"", 0

    def _more(self) -> bool:
        line = next(self._lines, None)
        if line is None:
            return False
        self._rest += line + b"\n"
        return True

    def readline(self) -> bytes | None:
        if not self._rest and not self._more():
            return None
        line, _, self._rest = self._rest.partition(b"\n")
        self.offset += len(line) + 1
        return line

    def read(self, n: int) -> bytes:
        parts, have = [self._rest], len(self._rest)
        while have < n:
            line = next(self._lines, None)
            if line is None:
                raise ValueError(f"archive ends {n - have} bytes before a record's declared length")
            parts.append(line + b"\n")
            have += len(line) + 1
        data = b"".join(parts)
        self._rest = data[n:]
        self.offset += n
        return data[:n]


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Stream]]:
    rows = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1)))
    for name, lines in itertools.groupby(rows, lambda r: r[0]):
        yield name, Stream(v.as_py() for _, v in lines)


def _batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


LINE = pa.schema([("value", pa.large_string())])


def _write(lines: DataFrame, path: str, end: str) -> str:
    lines.write.option("lineSep", end).option("compression", "gzip").text(path)
    return path


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("value"))


# ARC

def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20000101000000", ip: str = "0.0.0.0") -> str:
    """Write ``page_id, url, html`` as ARC archives; each record is an HTTP response."""
    fields = ARC_FIELDS[version]
    more = "" if version == 1 else " 200 - - 0 -"

    def run(batches):
        def lines():
            about = f"{version} 0 hitweave\n{fields}\n\n"
            yield (f"filedesc://pages.arc {ip} {date} text/plain{more} {len(about)}\n{about}",)
            for b in batches:
                for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3))):
                    body = html or ""
                    key = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                    n = len(body.encode())
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n{key}\r\n"
                    where = "%20".join((url or "-").split()) or "-"
                    yield (f"{where} {ip} {date} text/html{more} {len(head) + n}\n{head}{body}",)
        yield from _batched(lines(), LINE)

    return _write(pages.select("page_id", "url", "html").transform(mapped, run, "value string"), path, "\n")


def parse_arc(stream: Stream) -> Iterator[dict]:
    """Records of an ARC archive, by the fields that its version block declares."""
    first = (stream.readline() or b"").split(b" ")
    block = stream.read(int(first[-1])).split(b"\n")
    version, fields = int(block[0].split(b" ")[0]), block[1].decode().split(" ")
    if fields != ARC_FIELDS.get(version, "").split(" "):
        raise ValueError(f"ARC version {version} with fields {fields}")
    while (line := stream.readline()) is not None:
        if not line.strip():
            continue
        at = stream.offset
        values = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)  # only the URL could hold a blank
        if len(values) != len(fields):
            raise ValueError(f"ARC header with {len(values)} fields instead of {len(fields)}")
        record = dict(zip(fields, values))
        yield record | {"offset": at, "block": stream.read(int(record["Archive-length"]))}


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (names in lower case), the header itself and the payload of an HTTP
    response; other blocks are all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in fields.items()}, head + gap, payload


def _key(fields: dict[str, str]) -> int | None:
    return int(fields["x-page-id"]) if "x-page-id" in fields else None


ARC_ROW = pa.schema([("rid", pa.int64()), ("key", pa.int64()), ("url", pa.string()), ("ip", pa.string()),
                     ("date", pa.string()), ("mime", pa.string()), ("digest", pa.string()),
                     ("payload_bytes", pa.int64()), ("block", pa.large_binary())])


def read_arc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """One row per record of the ARC archives in ``path``; ``rid`` names archive and offset."""
    def run(batches):
        def rows():
            for name, stream in _archives(batches):
                for r in parse_arc(stream):
                    fields, _, payload = split_http(r["block"])
                    rid = xxhash.xxh64_intdigest(f"{name}:{r['offset']}") - 2**63
                    yield (rid, _key(fields), r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"],
                           hashlib.sha256(payload).hexdigest(), len(payload), r["block"] if with_block else None)
        yield from _batched(rows(), ARC_ROW)

    return _lines(spark, path).transform(mapped, run, "rid bigint, key bigint, url string, ip string, date string, mime string, "
                                               "digest string, payload_bytes bigint, block binary")


# WARC

def record_id(rid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(rid))}>"


def warc_date(arc: str) -> str:
    """``YYYYMMDDhhmmss``, possibly cut short, as a WARC date."""
    d = (arc + "00000101000000"[len(arc):])[:14] if arc.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(url: str, block: bytes) -> tuple[str, str | None]:
    """WARC type and content type (None: the ARC record's own) for an ARC record."""
    if block.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return ("response", "text/dns") if url.startswith("dns:") else ("resource", None)


def _warc_record(headers: list[tuple[str, str]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{head}\r\n{block.decode('utf-8', 'surrogateescape')}"


def write_warc(records: DataFrame, path: str) -> str:
    """Write converted records (``read_arc``'s columns, ``first_rid`` and ``first_key``; a record
    with a first that is not itself is a revisit) as WARC archives."""
    def run(batches):
        def lines():
            about = b"software: hitweave\r\nformat: WARC File Format 1.0\r\nconformsTo: ARC conversion\r\n"
            yield (_warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(0)), ("WARC-Date", warc_date("")),
                                 ("Content-Type", "application/warc-fields")], about),)
            names = ("rid", "url", "ip", "date", "mime", "digest", "payload_bytes", "block", "first_rid", "first_key")
            for b in batches:
                for rid, url, ip, date, mime, digest, size, block, first, first_key in zip(*(b.column(n).to_pylist() for n in names)):
                    kind, content = warc_type(url, block)
                    headers = [("WARC-Record-ID", record_id(rid)), ("WARC-Date", warc_date(date)),
                               ("WARC-Target-URI", url), ("WARC-IP-Address", ip), ("Content-Type", content or mime),
                               ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-X-Payload-Length", str(size))]
                    if first is not None and first != rid:
                        kind, block = "revisit", split_http(block)[1]
                        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first))]
                        headers += [("WARC-X-Refers-To-Key", str(first_key))] if first_key is not None else []
                    headers += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
                    yield (_warc_record([("WARC-Type", kind), *headers], block),)
        yield from _batched(lines(), LINE)

    return _write(records.transform(mapped, run, "value string"), path, "\r\n\r\n")


def parse_warc(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while (line := stream.readline()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := (stream.readline() or b"").rstrip(b"\r")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


WARC_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
                      ("url", pa.string()), ("date", pa.string())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but warcinfo.  A response's digest and length are taken of the payload
    found and must agree with its header; a revisit's are those of its header."""
    def run(batches):
        def rows():
            for name, stream in _archives(batches):
                for h, block in parse_warc(stream):
                    if h["warc-type"] == "warcinfo":
                        continue
                    fields, _, payload = split_http(block)
                    digest, size = h["warc-payload-digest"].partition(":")[2], int(h["warc-x-payload-length"])
                    if h["warc-type"] != "revisit" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"{h['warc-record-id']} in {name}: the payload is not the one declared")
                    key = h.get("warc-x-refers-to-key")
                    yield (_key(fields), size, digest, h["warc-type"], None if key is None else int(key), h["warc-record-id"],
                           h["warc-target-uri"], h["warc-date"])
        yield from _batched(rows(), WARC_ROW)

    return _lines(spark, path).transform(mapped, run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                                               "refers_to bigint, record_id string, url string, date string")


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST_PAYLOAD) -> str:
    """Convert the ARC archives in ``arc`` to WARC archives in ``warc``."""
    narrow = stored(read_arc(spark, arc, with_block=False).drop("block").filter(F.col("payload_bytes") >= least)
                    .select("digest", "rid", F.coalesce("key", F.lit(MAX_LONG)).alias("k")), "arc-digests")
    by_key = narrow.groupBy("digest", "k").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n"))
    firsts = stored(by_key.groupBy("digest").agg(F.min_by("rid", "k").alias("first_rid"), F.min("k").alias("first_key"), F.sum("n").alias("n"))
                    .filter("n > 1").select("digest", "first_rid", F.nullif("first_key", F.lit(MAX_LONG)).alias("first_key")), "arc-firsts")
    # Only payloads that occur more than once are in ``firsts``; short ones never are.
    records = read_arc(spark, arc).join(firsts, "digest", "left")
    return write_warc(records, warc)


def archive_pages(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages through ARC and WARC and back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to`` and the record's identifier, url and date."""
    spark = pages.sparkSession
    arc = write_arc(pages, scratch_path(spark, "arc"), version)
    return read_warc(spark, convert(spark, arc, scratch_path(spark, "warc")))
