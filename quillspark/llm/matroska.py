"""Matroska as media columns: EBML elements, clusters, lacing and cues, written and parsed without a library.

A media column holds whole files as binary. read_file() parses variable-length EBML elements (known and
unknown sizes, Void skipped, CRC-32 checked) into tracks, cues and packets; a packet is a frame with its time,
track and byte range, after Xiph, EBML or fixed-size lacing is undone. A simple block says itself whether it is a keyframe; one of a group is if the
group refers to no other block. Malformed data raise MatroskaError,
which the packet table turns into a row with an error and no packet.

Defined results: a null payload is an empty one; an empty payload is padded to one whole frame by the query;
null media gives one row with error ``null media``. Rows repeat as given. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

# fixed values: ids of the format's elements
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK, BLOCK_DURATION, CRC_32 = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B, 0xBF
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

#: Bytes of a frame (24 ms of 8-bit mono at 8000 Hz), frames of a lace, blocks of a cluster.
FRAME, RATE, LACE, BLOCKS = 192, 8000, 8, 32
CODEC = "A_PCM/INT/LIT"


class MatroskaError(ValueError):
    """The bytes aren't a Matroska file that this module reads."""


# ---- writing


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int) -> bytes:
    """A size in the fewest bytes; all ones are reserved for sizes that aren't known."""
    n = next(n for n in range(1, 9) if x < (1 << 7 * n) - 1)
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return _id(ident) + vint(len(body)) + body


def _uint(ident: int, x: int) -> bytes:
    return element(ident, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> tuple[int, bytes]:
    """The flags' lacing bits and the block's payload for several frames: xiph, ebml or fixed."""
    if kind == "none" or len(frames) == 1:
        if len(frames) != 1:
            raise ValueError("several frames need lacing")
        return 0x00, frames[0]
    if not 1 < len(frames) <= 256:
        raise ValueError("a lace has 1 to 256 frames")
    count, sizes = bytes([len(frames) - 1]), [len(x) for x in frames]
    if kind == "fixed":
        if len(set(sizes)) > 1:
            raise ValueError("frames of fixed lacing have one size")
        return 0x04, count + b"".join(frames)
    if kind == "xiph":
        return 0x02, count + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    out = [count, vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
        out.append(((b - a + (1 << 7 * n - 1) - 1) | 1 << 7 * n).to_bytes(n, "big"))
    return 0x06, b"".join(out) + b"".join(frames)


_HEAD = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC_ID, CODEC.encode()) + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def write_file(payload: bytes, lacing: str = "fixed") -> bytes:
    """A file with one track of 8-bit samples at 8000 Hz: the payload, a positive multiple of FRAME bytes, in laced SimpleBlocks."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    ms = FRAME * 1000 // RATE
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"quillspark") + element(WRITING_APP, b"quillspark"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    per = FRAME * LACE * BLOCKS
    for start in range(0, len(payload), per):
        time, end = start // FRAME * ms, min(start + per, len(payload))
        body = [_uint(TIMESTAMP, time)]
        for b in range(start, end, FRAME * LACE):
            frames = [payload[x : x + FRAME] for x in range(b, min(b + FRAME * LACE, end), FRAME)]
            flags, data = lace(frames, lacing)
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (b - start) // FRAME * ms, 0x80 | flags) + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# ---- reading


def _vint(data, at: int, end: int, marker: bool) -> tuple[int | None, int]:
    """An id (marker kept) or a size (marker cleared; None: not known) and where it ends."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > end or marker and n > 4:
        raise MatroskaError(f"an integer of {n} bytes at byte {at} is cut off or too long")
    x = int.from_bytes(data[at : at + n], "big")
    if marker:
        return x, at + n
    x ^= 1 << 7 * n
    return (None if x == (1 << 7 * n) - 1 else x), at + n


def elements(data, at: int, end: int, stop=frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements' bodies."""
    for k, (ident, begins, body, stop_at) in enumerate(placed_elements(data, at, end, stop)):
        if ident == CRC_32 and k == 0 and not stop:  # the first element of its parent holds for all that follow in that
            if stop_at - body != 4 or zlib.crc32(data[stop_at:end]) != int.from_bytes(data[body:stop_at], "little"):
                raise MatroskaError(f"the CRC-32 at byte {begins} doesn't hold")
        yield ident, body, stop_at


def placed_elements(data, at: int, end: int, stop=frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, where it begins, its body's start and end). An unknown size ends before the next top-level element."""
    while at < end:
        begins = at
        ident, body = _vint(data, at, end, True)
        if ident in stop:
            return
        size, body = _vint(data, body, end, False)
        if size is None:
            if ident not in (SEGMENT, CLUSTER):
                raise MatroskaError(f"element {ident:X} at byte {at} has no known size")
            stop_at = end if ident == SEGMENT else body + length_until(data, body, end)
        else:
            stop_at = body + size
            if stop_at > end:
                raise MatroskaError(f"element {ident:X} at byte {at} ends beyond its parent")
        yield ident, begins, body, stop_at
        at = stop_at


def length_until(data, at: int, end: int) -> int:
    """Bytes of the elements from at on, up to the next top-level element."""
    last = at
    for _, _, last in elements(data, at, end, TOP_LEVEL):  # noqa: B007
        pass
    return last - at


def _number(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data, a: int, b: int) -> float:
    if b - a not in (4, 8):
        raise MatroskaError("a float has 4 or 8 bytes")
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


def block_frames(data, a: int, b: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the byte ranges of the frames of a block."""
    track, at = _vint(data, a, b, False)
    if at + 3 > b:
        raise MatroskaError(f"the block at byte {a} is cut off")
    time, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    kind = flags & 0x06
    if not kind:
        return track, time, flags, [(at, b)]
    if at >= b:
        raise MatroskaError(f"the lace at byte {a} has no count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 0x04:
        if (b - at) % n:
            raise MatroskaError(f"the lace at byte {a} doesn't divide into {n} frames")
        sizes = [(b - at) // n] * n
    else:
        for k in range(n - 1):
            if kind == 0x02:
                size = 0
                while at < b and data[at] == 255:
                    size, at = size + 255, at + 1
                if at >= b:
                    raise MatroskaError(f"the lace at byte {a} is cut off")
                size, at = size + data[at], at + 1
            else:
                was = at
                size, at = _vint(data, at, b, False)
                if size is None:
                    raise MatroskaError(f"the lace at byte {a} has a size that isn't known")
                if k:
                    size += sizes[-1] - (1 << 7 * (at - was) - 1) + 1
            sizes.append(size)
        sizes.append(b - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != b:
        raise MatroskaError(f"the lace at byte {a} is longer than its block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return track, time, flags, out


def read_file(data: bytes) -> dict:
    """tracks, cues, duration_ms and packets: (track, time_ms, start, end, cluster, keyframe)."""
    tops = elements(data, 0, len(data))
    head = next(tops, None)
    if not head or head[0] != EBML:
        raise MatroskaError("no EBML header")
    kinds = [bytes(data[a:b]) for i, a, b in elements(data, head[1], head[2]) if i == DOC_TYPE]
    if kinds and kinds[0] not in (b"matroska", b"webm"):
        raise MatroskaError(f"a document of type {kinds[0]!r}")
    scale, duration, tracks, packets, cues, clusters, found = 1_000_000, None, {}, [], [], {}, False
    for ident, a, b in tops:
        if ident != SEGMENT:
            continue
        found, segment = True, a
        for i, begins, c, d in placed_elements(data, a, b):
            if i == INFO:
                for j, e, f in elements(data, c, d):
                    if j == TIMESTAMP_SCALE:
                        scale = _number(data, e, f)
                    elif j == DURATION:
                        duration = _float(data, e, f)
            elif i == TRACKS:
                for j, e, f in elements(data, c, d):
                    if j == TRACK_ENTRY:
                        track = {"rate": 8000.0, "channels": 1, "bits": None, "codec": "", "default_ns": 0}
                        for k, g, h in elements(data, e, f):
                            if k == TRACK_NUMBER:
                                tracks[_number(data, g, h)] = track
                            elif k == CODEC_ID:
                                track["codec"] = bytes(data[g:h]).decode("ascii", "replace").rstrip("\0")
                            elif k == DEFAULT_DURATION:
                                track["default_ns"] = _number(data, g, h)
                            elif k == AUDIO:
                                for m, o, p in elements(data, g, h):
                                    if m == SAMPLING_FREQUENCY:
                                        track["rate"] = _float(data, o, p)
                                    elif m == CHANNELS:
                                        track["channels"] = _number(data, o, p)
                                    elif m == BIT_DEPTH:
                                        track["bits"] = _number(data, o, p)
            elif i == CLUSTER:
                n, base = len(clusters), 0
                clusters[begins - segment] = n
                for j, e, f in elements(data, c, d):
                    blocks, refers = [(e, f)] if j == SIMPLE_BLOCK else [], None
                    if j == TIMESTAMP:
                        base = _number(data, e, f)
                    elif j == BLOCK_GROUP:
                        parts = list(elements(data, e, f))
                        blocks, refers = [(g, h) for k, g, h in parts if k == BLOCK], any(k == REFERENCE_BLOCK for k, _, _ in parts)
                    for g, h in blocks:
                        number, time, flags, frames = block_frames(data, g, h)
                        if number not in tracks:
                            raise MatroskaError(f"a block of track {number}, which isn't declared")
                        step = tracks[number]["default_ns"]
                        for k, (x, y) in enumerate(frames):
                            packets.append((number, ((base + time) * scale + k * step) // 1_000_000, x, y, n, bool(flags & 0x80) if refers is None else not refers))
            elif i == CUES:
                for j, e, f in elements(data, c, d):
                    if j == CUE_POINT:
                        point = {"time": 0, "at": []}
                        for k, g, h in elements(data, e, f):
                            if k == CUE_TIME:
                                point["time"] = _number(data, g, h) * scale // 1_000_000
                            elif k == CUE_TRACK_POSITIONS:
                                of = {m: _number(data, o, p) for m, o, p in elements(data, g, h)}
                                point["at"].append((of.get(CUE_TRACK), of.get(CUE_CLUSTER_POSITION)))
                        cues.append(point)
    if not found:
        raise MatroskaError("no segment")
    for point in cues:
        for _, where in point["at"]:
            if where not in clusters:
                raise MatroskaError(f"a cue points at byte {where}, where no cluster begins")
    return {"tracks": tracks, "cues": cues, "clusters": len(clusters), "packets": packets, "duration_ms": None if duration is None else duration * scale / 1e6}


def features(data: bytes, media: dict, payload: bytes) -> str:
    """What the packet table and the samples say, in integers and fixed decimals."""
    track = next(iter(media["tracks"].values()))
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int64) - 128
    changes = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    level = np.bincount(x >> 5, minlength=8)
    return (
        f"codec={track['codec']};rate={track['rate']:.0f};channels={track['channels']};bits={track['bits']};packets={len(media['packets'])};clusters={media['clusters']};cues={len(media['cues'])};"
        f"duration_ms={media['duration_ms']:.0f};last_ms={media['packets'][-1][1]};sum={int(centred.sum())};energy={int((centred * centred).sum())};crossings={changes};levels={'/'.join(map(str, level))}"
    )


# ---- DataFrames


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def encode_texts(docs: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """(keep, n_bytes, media): each whole text in UTF-8, padded by spaces, as a Matroska file."""

    def run(batches):
        for batch in batches:
            texts = common.utf8(batch, "body")
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, texts), pa.int64()), pa.array([write_file(padded(t)) for t in texts], pa.binary())], ["key", "n_bytes", "media"])

    rows = docs.select(F.col(keep).alias("key"), F.col(text).alias("body"))
    out = common.map_batches(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, media binary")
    return out.withColumnRenamed("key", keep)


PACKETS = "packet long, track int, time_ms long, byte_start long, byte_end long, cluster int, keyframe boolean, error string"


def packet_table(rows: DataFrame, keep: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each packet of each file; a file that can't be read gives one row with its error."""
    names = [x.split()[0] for x in PACKETS.split(", ")]

    def run(batches):
        for batch in batches:
            keys, out = batch.column("key").to_pylist(), []
            for key, data in zip(keys, batch.column("media").to_pylist(), strict=True):
                try:
                    if data is None:
                        raise MatroskaError("null media")
                    found = read_file(data)["packets"]
                    out += [(key, n, t, ms, a, b, c, k, None) for n, (t, ms, a, b, c, k) in enumerate(found)]
                except MatroskaError as e:
                    out.append((key, None, None, None, None, None, None, None, str(e)))
                if len(out) > 50_000:
                    yield _batch(out, batch.schema.field("key").type)
                    out = []
            yield _batch(out, batch.schema.field("key").type)

    def _batch(out, kind):
        cols = list(zip(*out, strict=True)) if out else [[]] * 9
        types = [kind, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["key", *names])

    rows = rows.select(F.col(keep).alias("key"), F.col(media).alias("media"))
    return common.map_batches(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, {PACKETS}").withColumnRenamed("key", keep)


def read_back(rows: DataFrame) -> DataFrame:
    """Digests and features of (doc_id, n_bytes, media), from the packets of the stored files."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column("media").to_pylist():
                media = read_file(data)
                payload = b"".join([data[a:b] for _, _, a, b, _, _ in media["packets"]])
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(data, media, payload)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.map_batches(rows.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
