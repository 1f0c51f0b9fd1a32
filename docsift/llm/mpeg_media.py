"""Media columns: MPEG audio (MPEG-1 Layer III).

The writer makes valid variable-bitrate streams: an ID3v2.3 tag, a Xing frame (frames, bytes, seek table), and
frames under CRC-16 whose granules are silent and whose ancillary data carry the payload. The parser reads tags
(ID3v2, ID3v1), resynchronises on frame headers (a header counts if another of its kind, or the stream's end,
follows it), reads the Xing or VBRI table with its seek points and holds them against the frames, verifies checksums
of Layers I and III, and returns the exact duration and the offset of each frame. Decoding sound, free-format frames
and the checksum of Layer II, which needs its allocation tables, are out of scope.

Defined results: a null text counts as empty; equal texts give equal bytes, repeated rows and ties too; bytes without
frames parse to none; an empty table gives an empty one; very long texts become streams of as many frames as they need.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import ddl, passing, ship, slices

#: Fixed values of the format: kbit/s by index, samples a second by index, both for MPEG-1, 2 and 2.5.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 192
_RATE_INDEX, _RATE = 2, 32000
_SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
_HEAD = 4 + 2 + _SIDE


@dataclass(frozen=True)
class Frame:
    """What a header says. length counts the header."""

    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int
    samples: int


_HEADERS: dict[bytes, Frame | None] = {}


def parse_header(b: bytes) -> Frame | None:
    """The frame of four header bytes, or None."""
    if b not in _HEADERS:
        if len(_HEADERS) > 10_000:
            _HEADERS.clear()
        _HEADERS[b] = _parse_header(b)
    return _HEADERS[b]


def _parse_header(b: bytes) -> Frame | None:
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3)
    rate_at, bits_at, padding = b[2] >> 2 & 3, b[2] >> 4, b[2] >> 1 & 1
    if version == 1 or layer == 4 or rate_at == 3 or bits_at in (0, 15):
        return None
    bitrate, rate = BITRATES[1 if version == 3 else 2, layer][bits_at] * 1000, RATES[version][rate_at]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    return Frame(version, layer, not b[1] & 1, bitrate, rate, b[3] >> 6 == 3, length, samples)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


_SUMS: dict[bytes, int] = {}


def _crc_of(data: bytes) -> int:
    if data not in _SUMS:
        if len(_SUMS) > 10_000:
            _SUMS.clear()
        _SUMS[data] = crc16(data)
    return _SUMS[data]


def side_bytes(f: Frame) -> int:
    """Bytes of side information of a Layer III frame."""
    return (17 if f.mono else 32) if f.version == 3 else (9 if f.mono else 17)


def allocation_bytes(f: Frame, mode: int) -> int:
    """Bytes of the bit allocation of a Layer I frame: 4 bits a subband and channel, from the joint ones on one for both."""
    both = (4 * (mode >> 4 & 3) + 4 if mode >> 6 == 1 else 32) if not f.mono else 0
    return (both + 32) // 2


# Writing


def _header(bits_at: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, bits_at << 4 | _RATE_INDEX << 2, 0xC0))


def _sizes() -> list[tuple[int, int, bytes]]:
    """(payload bytes, frame length, everything before the payload) of the smallest frame for each number of units."""
    out, units = [], 1
    for bits_at in range(1, 15):
        h = _header(bits_at, True)
        length = parse_header(h).length
        side = bytes(_SIDE)
        while _HEAD + units * UNIT <= length:
            out.append((units * UNIT, length, h + struct.pack(">H", crc16(h[2:4] + side)) + side))
            units += 1
    return out


_FRAMES = _sizes()
_MOST = _FRAMES[-1][0]
_INFO_BITS = 5  # 64 kbit/s: 288 bytes, enough for the Xing fields


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\x00" + text.encode("latin-1")
    return name + struct.pack(">IH", len(body), 0) + body


def write_stream(payload: bytes) -> bytes:
    """A stream that carries the payload, a positive multiple of UNIT bytes."""
    view, parts, lengths = memoryview(payload), [], []
    for at in range(0, len(payload), _MOST):
        chunk = view[at : at + _MOST]
        _, length, head = _FRAMES[len(chunk) // UNIT - 1]
        parts += (head, chunk, bytes(length - len(head) - len(chunk)))
        lengths.append(length)
    n = len(lengths)
    tag = _text_frame(b"TLEN", str((n + 1) * 1152 * 1000 // _RATE)) + _text_frame(b"TXXX", f"payload\x00{len(payload)}")
    size = len(tag)
    id3 = b"ID3\x03\x00\x00" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tag
    info_head = _header(_INFO_BITS, False)
    info_length = parse_header(info_head).length
    total, starts, at = info_length + sum(lengths), [], info_length
    for x in lengths:
        starts.append(at)
        at += x
    toc = bytes(min(255, starts[k * n // 100] * 256 // total) for k in range(100))
    info = info_head + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, n, total) + toc
    return b"".join([id3, info, bytes(info_length - len(info)), *parts])


# Reading


@dataclass
class Stream:
    """What the parser found. offsets: of sound frames, in order; duration: samples / rate seconds, exactly."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: str = ""
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    seek_points: list[int] = field(default_factory=list)  # bytes from the first frame, as the table tells
    seek_ok: bool | None = None  # whether each lies within a frame of the place that it stands for
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    checked: int = 0
    bad: int = 0
    skipped: int = 0


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """The tag's end."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    a, b, c, d = data[6:10]
    end = 10 + (a << 21 | b << 14 | c << 7 | d)
    at, syncsafe = 10, data[3] >= 4
    while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        name = data[at : at + 4].decode("latin-1")
        raw = data[at + 4 : at + 8]
        size = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if syncsafe else int.from_bytes(raw, "big")
        body = data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += 10 + size
    return end


def _vbr(frame: bytes, f: Frame, out: Stream) -> bool:
    """Whether the frame is a Xing, Info or VBRI frame."""
    at = 4 + side_bytes(f) + 2 * f.protected
    name = frame[at : at + 4]
    if name in (b"Xing", b"Info"):
        out.vbr = name.decode()
        flags = int.from_bytes(frame[at + 4 : at + 8], "big")
        at += 8
        if flags & 1:
            out.vbr_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 2:
            out.vbr_bytes, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4 and out.vbr_bytes and len(frame) >= at + 100:
            out.seek_points = [b * out.vbr_bytes // 256 for b in frame[at : at + 100]]
        return True
    if frame[36:40] == b"VBRI":
        out.vbr, out.vbr_bytes, out.vbr_frames = "VBRI", int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        entries, scale, width, _ = struct.unpack(">4H", frame[54:62]) if len(frame) >= 62 else (0, 0, 0, 0)
        place = f.length
        for k in range(entries if 0 < width <= 4 else 0):
            own = frame[62 + k * width : 62 + (k + 1) * width]
            if len(own) < width:
                break
            place += int.from_bytes(own, "big") * scale
            out.seek_points.append(place)
        return True
    return False


def _check_seek(out: Stream, head: int, head_length: int) -> None:
    """Xing: 100 places in time, in 256ths of the bytes. VBRI: the bytes of equal numbers of frames, added up."""
    n, points = len(out.offsets), out.seek_points
    if not points or not n:
        return
    wide = max(max(out.lengths), head_length)
    if out.vbr == "VBRI":
        ends = [*(at - head for at in out.offsets[1:]), out.offsets[-1] + out.lengths[-1] - head]
        each = -(-n // len(points))
        out.seek_ok = all(abs(p - ends[min((k + 1) * each, n) - 1]) <= wide for k, p in enumerate(points))
    else:
        step = (out.vbr_bytes or 0) // 256 + 1
        out.seek_ok = all(abs(p - (out.offsets[min(k * n // 100, n - 1)] - head)) <= wide + step or p + step >= 255 * step for k, p in enumerate(points))


def _alike(a: Frame, b: Frame | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def parse_stream(data: bytes) -> Stream:
    out = Stream()
    at, end = _id3v2(data, out.tags), len(data)
    # An ID3v1 tag, unless these bytes turn out to lie in a frame that ends with the stream.
    tag = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else None
    first, head, head_length = None, 0, 0
    while at + 4 <= end:
        if at == tag:
            out.tags.setdefault("TIT2", data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1"))
            break
        f = parse_header(data[at : at + 4])
        after = at + f.length if f else 0
        fits = f is not None and f.length >= 4 and after <= end and (first is None or _alike(first, f))
        fits = fits and (tag is None or not at < tag < after or after == end)
        if not fits or not (after in (end, tag) or _alike(f, parse_header(data[after : after + 4]))):
            if not fits or first is None:
                there = data.find(b"\xff", at + 1, end)
                there = end if there < 0 else there
                there = tag if tag is not None and at < tag < there else there
                out.skipped += there - at
                at = there
                continue
        if first is None:
            first, out.rate, head, head_length = f, f.rate, at, f.length
            if f.layer == 3 and _vbr(data[at:after], f, out):
                at = after
                continue
        if f.protected and f.layer != 2:
            side = data[at + 6 : at + 6 + (side_bytes(f) if f.layer == 3 else allocation_bytes(f, data[at + 3]))]
            out.checked += 1
            out.bad += _crc_of(data[at + 2 : at + 4] + side) != int.from_bytes(data[at + 4 : at + 6], "big")
        out.offsets.append(at)
        out.lengths.append(f.length)
        out.samples += f.samples
        at = after
    _check_seek(out, head, head_length)
    return out


def read_payload(data: bytes, s: Stream) -> bytes:
    """The payload of a stream of write_stream."""
    left, parts, view = int(s.tags.get("payload", 0)), [], memoryview(data)
    for at, length in zip(s.offsets, s.lengths):
        take = min(left, (length - _HEAD) // UNIT * UNIT)
        parts.append(view[at + _HEAD : at + _HEAD + take])
        left -= take
    if left:
        raise ValueError("the stream holds less than its tag says")
    return b"".join(parts)


def feature_of(s: Stream) -> str:
    """Duration, sizes and a digest of the seek offsets, as text."""
    seek = hashlib.sha256(struct.pack(f"<{len(s.offsets)}Q", *s.offsets)).hexdigest()[:16]
    table = "none" if s.seek_ok is None else "ok" if s.seek_ok else "bad"
    return f"rate={s.rate};samples={s.samples};frames={len(s.offsets)};vbr={s.vbr};table_frames={s.vbr_frames};table_seek={table};crc={s.checked - s.bad}/{s.checked};skipped={s.skipped};seek={seek}"


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, counted, and filled with blanks to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def store_audio(docs: DataFrame, text: str = "text", keep_text: bool = False, out: str = "media") -> DataFrame:
    """Add the text's payload as a stream, in a binary column."""
    ship(docs.sparkSession)
    fields = passing(docs, text, keep_text, out)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            media = [write_stream(padded(t)[1]) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {out: pa.array(media, pa.binary())})

    schema = ddl(fields, f"`{out}` binary")
    return docs.withColumn("_text", F.col(text).cast("string")).mapInArrow(run, schema)


def read_audio(df: DataFrame, media: str = "media") -> DataFrame:
    """Replace a column of MPEG streams by what the parser finds: tags, exact duration (samples over rate), VBR table,
    its seek points and whether they fit, checksum counts, and the offset of each frame. A null stream has none."""
    ship(df.sparkSession)
    fields = passing(df, media, False, "tags", "rate", "samples", "duration", "vbr", "vbr_frames", "vbr_bytes", "seek_points", "seek_ok", "crc_checked", "crc_bad", "skipped_bytes", "frame_offsets")
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = [parse_stream(x or b"") for x in batch.column(media).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {n: batch.column(n) for n in names}
                | {
                    "tags": pa.array([list(x.tags.items()) for x in s], pa.map_(pa.string(), pa.string())),
                    "rate": pa.array([x.rate for x in s], pa.int32()),
                    "samples": pa.array([x.samples for x in s], pa.int64()),
                    "duration": pa.array([x.samples / x.rate if x.rate else 0.0 for x in s], pa.float64()),
                    "vbr": pa.array([x.vbr for x in s], pa.string()),
                    "vbr_frames": pa.array([x.vbr_frames for x in s], pa.int64()),
                    "vbr_bytes": pa.array([x.vbr_bytes for x in s], pa.int64()),
                    "seek_points": pa.array([x.seek_points for x in s], pa.list_(pa.int64())),
                    "seek_ok": pa.array([x.seek_ok for x in s], pa.bool_()),
                    "crc_checked": pa.array([x.checked for x in s], pa.int64()),
                    "crc_bad": pa.array([x.bad for x in s], pa.int64()),
                    "skipped_bytes": pa.array([x.skipped for x in s], pa.int64()),
                    "frame_offsets": pa.array([x.offsets for x in s], pa.list_(pa.int64())),
                }
            )

    own = "tags map<string,string>, rate int, samples long, duration double, vbr string, vbr_frames long, vbr_bytes long, seek_points array<long>, seek_ok boolean, crc_checked long, crc_bad long, skipped_bytes long, frame_offsets array<long>"
    return df.mapInArrow(run, ddl(fields, own))


def op10_mpeg_media(documents: DataFrame) -> DataFrame:
    """One row per document: payload and stream digests and features, from the stored bytes read back, with the exact
    duration (samples at a rate) and the offset of each frame."""
    ship(documents.sparkSession)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data, n in zip(batch.column("media").to_pylist(), batch.column("n_bytes").to_pylist()):
                s = parse_stream(data)
                payload = read_payload(data, s)
                rows.append((n, len(payload), sha(payload), zlib.crc32(payload[-16:]), len(data), sha(data), feature_of(s), s.samples, s.rate, s.offsets))
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_samples", "sample_rate", "frame_offsets")
            kinds = {2: pa.string(), 5: pa.string(), 6: pa.string(), 9: pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array([r[i] for r in rows], kinds.get(i, pa.int64())) for i, k in enumerate(names)})

    sized = documents.select("doc_id", "text", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return store_audio(sized).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate long, frame_offsets array<long>")
