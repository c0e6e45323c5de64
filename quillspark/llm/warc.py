"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

write_archives() makes archives of bounded size as binary rows; each archive fits its own dictionary on its
first records (at most DICT_RECORDS records and DICT_BYTES bytes; archives of few records go without).
read_archives() loads the dictionary, decodes a frame for each record and checks what the formats promise:
frame lengths, one record in a frame, header syntax, Content-Length, digests, closing blank lines. What the formats leave open is
read as it comes: frames that don't state their size, HTTP responses in chunks or without a length, payloads without a digest.

Defined results: null html is an empty payload; a null url leaves WARC-Target-URI out; records are named
after their page id (``null`` for a null one); rows that share the largest page id of a group of equal
payloads are all responses; page ids that are all null as well. A record that breaks a rule, or that is longer than MAX_RECORD, gives a row with an error; reading goes on
with the next frame, as long as the frames' own headers tell where it begins. A file gives a row for each archive in it. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Uncompressed bytes after which the next archive begins; what a dictionary is fitted on, and its size.
ARCHIVE_BYTES, DICT_RECORDS, DICT_BYTES, DICT_SIZE, LEVEL = 32 << 20, 400, 2 << 20, 32 << 10, 3
#: Bytes of a record at most, whatever its frame declares, and of a window that a frame may ask for.
MAX_RECORD, MAX_WINDOW = 1 << 30, 1 << 27
# fixed values of the formats
SKIPPABLE, ZSTD_MAGIC, DICT_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """The bytes break a rule of WARC or of its Zstandard form."""


# ---- records


def _safe(value: str) -> str:
    """A header's value: control characters and line ends are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its HTTP headers and payload, or a revisit with the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _safe(url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The dictionary's skippable frame, if there is one, then a frame for each record."""
    sample, size = [], 0
    for x in records[:DICT_RECORDS]:
        if size + len(x) > DICT_BYTES:
            break
        sample.append(x)
        size += len(x)
    out, fitted = [], None
    if len(sample) >= 16:
        try:
            fitted = zstandard.train_dictionary(min(DICT_SIZE, size // 4), sample)
        except zstandard.ZstdError:  # too little to learn from
            fitted = None
    if fitted is not None:
        body = fitted.as_bytes()
        out.append(struct.pack("<II", SKIPPABLE, len(body)) + body)
        fitted.precompute_compress(level=LEVEL)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=fitted, write_checksum=True, write_content_size=True)
    out += map(c.compress, records)
    return b"".join(out)


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame at a byte ends, from its headers and those of its blocks."""
    try:
        if struct.unpack_from("<I", data, at)[0] != ZSTD_MAGIC:
            raise WarcError(f"no Zstandard frame at byte {at}")
        flags = data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        while True:
            block = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data) or block >> 1 & 3 == 3:
                raise WarcError(f"a broken block at byte {at}")
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
    except (IndexError, struct.error):
        raise WarcError("a frame is cut off") from None
    at += 4 * checksum
    if at > len(data):
        raise WarcError("a frame is cut off")
    return at


def _dictionary(data) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        end = 8 + struct.unpack_from("<I", data, 4)[0]
        if end > len(data):
            raise WarcError("the dictionary's frame is cut off")
        body = bytes(data[8:end])
        if body[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary may be compressed itself
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
        if body[:4] != struct.pack("<I", DICT_MAGIC):
            raise WarcError("the leading frame holds no dictionary")
        return zstandard.ZstdCompressionDict(body), end
    return None, 0


_LINE = re.compile(r"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*")


def _headers(lines: list[str], of: str) -> dict[str, str]:
    out = {}
    for x in lines:
        m = _LINE.fullmatch(x)
        if not m:
            raise WarcError(f"{of}: a malformed header {x[:80]!r}")
        out[m[1].lower()] = m[2]
    return out


def _length(head: dict[str, str], of: str) -> int:
    if not re.fullmatch("[0-9]{1,15}", head.get("content-length", "")):
        raise WarcError(f"{of}: no Content-Length")
    return int(head["content-length"])


def parse_record(data: bytes) -> dict:
    """A checked record: its WARC headers, type, HTTP payload and the payload's length and digest."""
    top, found, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    head = _headers(lines[1:], "WARC")
    for k in ("warc-type", "warc-record-id", "warc-date"):
        if not head.get(k):
            raise WarcError(f"no {k}")
    n = _length(head, "WARC")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the block and its end have {len(rest)} bytes")
    block, out = rest[:n], {"headers": head, "type": head["warc-type"], "payload": None, "payload_bytes": None, "digest": None}
    if head["warc-type"] not in ("response", "revisit"):
        return out
    http, found, payload = block.partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")
    if not found or not re.fullmatch(r"HTTP/\d\.\d \d{3}( .*)?", lines[0]):
        raise WarcError("no HTTP status line")
    fields = _headers(lines[1:], "HTTP")
    revisit = head["warc-type"] == "revisit"
    if "chunked" in fields.get("transfer-encoding", "").lower() and not revisit:
        payload, size = _unchunked(payload), None
    else:
        size = _length(fields, "HTTP") if "content-length" in fields else None
    stated = head.get("warc-payload-digest", "")
    algorithm, _, digest = stated.partition(":")
    raw = None
    if algorithm.lower() == "sha1":
        if not re.fullmatch("[A-Z2-7]{32}", digest.upper()):
            raise WarcError("the sha1 payload digest is malformed")
        raw = base64.b32decode(digest.upper())
    if revisit:
        if payload or not head.get("warc-refers-to") or not head.get("warc-profile"):
            raise WarcError("a revisit has no payload, names its profile and what it refers to")
        return out | {"payload_bytes": size, "digest": None if raw is None else raw.hex()}
    found = hashlib.sha1(payload).digest()
    # some writers take the digest of a chunked payload as it was sent
    if size not in (None, len(payload)) or raw not in (None, found, hashlib.sha1(block.partition(b"\r\n\r\n")[2]).digest()):
        raise WarcError("the payload doesn't have its length or digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "digest": found.hex()}


def _unchunked(data: bytes) -> bytes:
    """The payload of an HTTP response in chunks."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]{1,8}", data[at:end]) if end >= 0 else None
        if not size:
            raise WarcError("a malformed chunk")
        n = int(size[0], 16)
        if not n:
            return b"".join(out)
        at = end + 2 + n
        if data[at : at + 2] != b"\r\n":
            raise WarcError("a chunk doesn't have its length")
        out.append(data[end + 2 : at])
        at += 2


def decoded(d: zstandard.ZstdDecompressor, frame, most: int = MAX_RECORD) -> bytes:
    """A frame's bytes, by stream: what it declares is not allocated beforehand."""
    out, size = [], 0
    with d.stream_reader(frame, read_size=1 << 16) as f:
        while part := f.read(1 << 20):
            out.append(part)
            size += len(part)
            if size > most:
                raise WarcError(f"a record of more than {most} bytes")
    found = b"".join(out)
    declared = zstandard.frame_content_size(frame[:18])
    if declared not in (-1, len(found)):
        raise WarcError(f"the frame declares {declared} bytes and has {len(found)}")
    return found


def read_archive(data: bytes):
    """The records of an archive, checked, one after another; in place of a record that breaks a rule its WarcError."""
    fitted, at = _dictionary(data)
    d = zstandard.ZstdDecompressor(dict_data=fitted, max_window_size=MAX_WINDOW)
    view = memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] >> 4 == SKIPPABLE >> 4:  # frames that others have put in between
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        end = frame_end(data, at)
        try:
            yield parse_record(decoded(d, view[at:end]))
        except WarcError as e:
            yield WarcError(f"the frame at byte {at}: {e}")
        except (zstandard.ZstdError, UnicodeDecodeError, MemoryError) as e:
            yield WarcError(f"the frame at byte {at}: {e}")
        at = end


# ---- DataFrames


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit). Only digests and ids are grouped; pages meet the
    digests of repeated payloads, in a join that Spark may split where one payload is very common."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), (F.octet_length(html) >= least).alias("large"))
    groups = rows.where("large").groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first_id")
    met = rows.join(groups, rows.large & (rows.digest == groups.of), "left")
    revisit = F.coalesce((F.col("first_id") != F.col("page_id")) | (F.col("first_id").isNotNull() & F.col("page_id").isNull()), F.lit(False))
    return met.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(records long, archive binary): archives of some archive_bytes of records each, of the rows as they are dealt."""

    def run(batches):
        out, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([len(out)], pa.int64()), pa.array([archive(out)], pa.binary())], ["records", "archive"])
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True):
                page_id, url, html, digest, refers_to, revisit = row
                out.append(record(page_id, url, html, bytes.fromhex(digest), refers_to, revisit))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pack()
                    out, size = [], 0
        if out:
            yield pack()

    return common.map_batches(rows, run, "records long, archive binary")


def read_archives(archives: DataFrame, column: str = "archive", payloads: bool = True, strict: bool = False) -> DataFrame:
    """A row for each record of each archive: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, error. strict: an error
    ends the job, whatever columns are read."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "error"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def number(name):
        m = re.fullmatch("<urn:page:(-?[0-9]+)>", name or "")
        return int(m[1]) if m else None

    def run(batches):
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                try:
                    for r in read_archive(data.as_py() or b""):
                        if isinstance(r, WarcError):
                            if strict:
                                raise RuntimeError(str(r))
                            out.append((*[None] * 7, str(r)))
                            continue
                        h = r["headers"]
                        out.append((number(h["warc-record-id"]), h.get("warc-target-uri"), r["type"], r["payload_bytes"], r["digest"], number(h.get("warc-refers-to")), r["payload"] if payloads else None, None))
                        size += len(out[-1][6] or b"") + 200
                        if size > 4 << 20:
                            yield batch_of(out)
                            out, size = [], 0
                except WarcError as e:
                    if strict:
                        raise RuntimeError(str(e)) from None
                    out.append((*[None] * 7, str(e)))
                yield batch_of(out)

    return common.map_batches(archives.select(column), run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string")


def read_archive_files(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of files *.warc.zst, each file one archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return read_archives(files, "content", payloads)
