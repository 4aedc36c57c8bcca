"""Media columns: an Ogg container over binary columns.

Writing cuts a payload into packets, deals them over two logical streams and interleaves
their pages. Reading verifies every page's checksum, joins packets from lacing values
(over pages too), takes the logical streams apart, and derives times from granule
positions. A stream's first packet names its rate, channel and number of channels.

Defined results: null text is empty, and an empty payload is padded to 64 zero bytes; equal
texts give equal files, as serial numbers come from the payload's checksum; rows with a
null or repeated ``doc_id`` are treated each for itself; an empty table gives an empty
result; a damaged page raises ``OggError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc32, table

#: Fixed values of the format (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_SEGMENTS = 255
NO_GRANULE = -1

_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))
#: First bytes of a stream's header packet: mark, channel, channels, rate.
HEAD = struct.Struct("<8sBBI")
MARK = b"\x01pcm8bit"
SAMPLE_UNIT = 64
PACKET_BYTES = 4032
RATE = 8000


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 04c11db7, not reflected, from 0: zlib's on bytes with their bits reversed."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes

    def pack(self) -> bytes:
        head = CAPTURE + struct.pack("<BBqII", 0, self.flags, self.granule, self.serial, self.sequence)
        tail = bytes([len(self.lacing)]) + self.lacing + self.body
        return head + struct.pack("<I", page_checksum(head + bytes(4) + tail)) + tail


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position and byte offset in the file of each page on which a packet ends.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _part: bytes | None = None
    _next: int = 0

    @property
    def head(self) -> tuple[int, int, int]:
        """Channel, number of channels, rate."""
        if not self.packets or self.packets[0][:8] != MARK:
            raise OggError("unknown stream")
        return HEAD.unpack(self.packets[0][: HEAD.size])[1:]

    @property
    def seconds(self) -> float:
        return (self.granules[-1] if self.granules else 0) / self.head[2]


def pages(data: bytes) -> Iterator[Page]:
    """Pages in file order, each with a verified checksum."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or len(data) < at + 27:
            raise OggError(f"no page at byte {at}")
        version, flags, granule, serial, sequence, checksum, n = struct.unpack_from("<BBqIIIB", data, at + 4)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise OggError(f"cut page at byte {at}")
        if page_checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != checksum:
            raise OggError(f"bad checksum at byte {at}")
        yield Page(flags, granule, serial, sequence, lacing, data[at + 27 + n : end])
        at = end


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first pages."""
    streams: dict[int, Stream] = {}
    for page in pages(data):
        s = streams.get(page.serial)
        if s is None:
            if not page.flags & FIRST:
                raise OggError(f"stream {page.serial} has no first page")
            s = streams[page.serial] = Stream(page.serial)
        if page.sequence != s._next or s.ended:
            raise OggError(f"stream {page.serial} lacks page {s._next}")
        if bool(page.flags & CONTINUED) != (s._part is not None):
            raise OggError(f"packet of stream {page.serial} is not continued")
        s._next, s.pages, at = s._next + 1, s.pages + 1, 0
        part = s._part or b""
        inside = s._part is not None
        ended = False
        for lace in page.lacing:
            part += page.body[at : at + lace]
            at, inside = at + lace, True
            if lace < 255:
                s.packets.append(part)
                part, inside, ended = b"", False, True
        s._part = part if inside else None
        if ended:
            s.granules.append(page.granule)
        s.ended = bool(page.flags & LAST)
    for s in streams.values():
        if not s.ended or s._part is not None:
            raise OggError(f"stream {s.serial} does not end")
    return streams


def _stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> Iterator[Page]:
    """Packs packets into pages of at most 255 segments; the header packet has a page alone."""
    lacing, body, flags, sequence, granule, continued = bytearray(), bytearray(), FIRST, 0, NO_GRANULE, False
    for k, (packet, position) in enumerate(zip(packets, granules, strict=True)):
        at, left = 0, len(packet) // 255 + 1
        while left:
            if len(lacing) == MAX_SEGMENTS:
                yield Page(flags | CONTINUED * continued, granule, serial, sequence, bytes(lacing), bytes(body))
                sequence, flags, granule, continued = sequence + 1, 0, NO_GRANULE, at > 0
                lacing.clear()
                body.clear()
            part = packet[at : at + 255]
            lacing.append(len(part))
            body += part
            at, left = at + len(part), left - 1
        granule = position
        if k == 0 and len(packets) > 1:
            yield Page(flags, granule, serial, sequence, bytes(lacing), bytes(body))
            sequence, flags, granule = sequence + 1, 0, NO_GRANULE
            lacing.clear()
            body.clear()
    yield Page(flags | LAST | CONTINUED * continued, granule, serial, sequence, bytes(lacing), bytes(body))


def multiplex(payload: bytes, rate: int = RATE, packet_bytes: int = PACKET_BYTES, channels: int = 2) -> bytes:
    """A file with the payload's 8-bit samples, its packets dealt over the streams in turn.

    First pages come first, then the streams' pages in turn. A granule position counts the
    samples of its stream up to the end of the last packet that ends on the page.
    """
    cut = [payload[k : k + packet_bytes] for k in range(0, len(payload), packet_bytes)]
    base = crc32(payload)
    queues = []
    for c in range(channels):
        own = cut[c::channels]
        serial = (base + c) & 0xFFFFFFFF
        packets = [HEAD.pack(MARK, c, channels, rate), *own]
        granules = [0, *np.cumsum([len(p) for p in own]).tolist()] if own else [0]
        queues.append(list(_stream_pages(serial, packets, granules)))
    out = [q[0].pack() for q in queues]
    for k in range(1, max(map(len, queues))):
        out += [q[k].pack() for q in queues if k < len(q)]
    return b"".join(out)


def samples(streams: dict[int, Stream]) -> bytes:
    """The payload: the streams' packets taken in turn, by the channel that each names."""
    by_channel = [s.packets[1:] for s in sorted(streams.values(), key=lambda s: s.head[0])]
    out = []
    for k in range(max(map(len, by_channel))):
        out += [p[k] for p in by_channel if k < len(p)]
    return b"".join(out)


def features(data: bytes) -> tuple[bytes, str]:
    """The samples that a file holds, and a line on its streams and their samples."""
    streams = demultiplex(data)
    raw = samples(streams)
    x = np.frombuffer(raw, "u1").astype("f8") - 128
    parts = [f"{s.pages}p/{len(s.packets)}k/{s.seconds:.6f}s" for s in sorted(streams.values(), key=lambda s: s.head[0])]
    rms = float(np.sqrt((x * x).mean())) if len(x) else 0.0
    crossings = int((np.diff(np.signbit(x)) != 0).sum())
    return raw, f"streams={len(streams)};{';'.join(parts)};mean={x.mean() if len(x) else 0:.4f};rms={rms:.4f};crossings={crossings}"


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _run(keep_media: bool):
    schema = _SCHEMA.append(pa.field("media", pa.binary())) if keep_media else _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, 8_000_000):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                raw = text.encode()
                media = multiplex(raw + bytes(-len(raw) % SAMPLE_UNIT or SAMPLE_UNIT * (not raw)))
                back, feature = features(media)
                row = (i, len(raw), len(back), hashlib.sha256(back).hexdigest(), crc32(back[-SAMPLE_UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                rows.append((*row, media) if keep_media else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as an Ogg file and reads it back; one row out for each row in.

    With ``keep_media`` the files are in the column ``media``.
    """
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_run(keep_media), ddl + ", media binary" * keep_media)


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
