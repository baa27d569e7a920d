"""Ogg container: bytes kept as 8-bit samples in Ogg, and the reader that takes any Ogg stream apart.

Stored form of a payload: two logical streams, multiplexed by page. The first
is PCM ("PCM     " header as in the public OggPCM draft, unsigned 8 bit, mono,
packets of FRAME samples, granule position = samples so far); the second holds
the CRC-32 of the samples of each page of the first, at the same granule. All
serial numbers come from the payload, so equal payloads have equal bytes.

The reader finds pages by their capture pattern, verifies each checksum (a page
whose checksum fails is skipped and counted, and reading goes on at the next
capture pattern), splits pages by serial number, puts packets together from
lacing values across pages, drops a packet of which a page is missing, and
derives each packet's time from the granule position of the page on which it
ends.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes

FRAME = 576
RATE = 8000
SLICE_BYTES = 8 << 20
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(data: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, not reflected, from 0, no final xor): zlib's on bytes with their bits reversed, from and to an inverted state."""
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    blank = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + checksum(blank).to_bytes(4, "little") + blank[26:]


def lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def store(payload: bytes) -> bytes:
    """The Ogg file of a payload of whole frames."""
    serial = zlib.crc32(payload)
    other = serial ^ 1
    head = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, FRAME, 0)
    mark = b"SUMS    " + struct.pack(">I", FRAME)
    out = [page(serial, 0, 0, FIRST, lace(len(head)), head), page(other, 0, 0, FIRST, lace(len(mark)), mark)]
    per_page = 255 // len(lace(FRAME)) * FRAME
    starts = range(0, len(payload), per_page)
    for number, at in enumerate(starts, 1):
        body = payload[at : at + per_page]
        last = LAST if number == len(starts) else 0
        out.append(page(serial, number, at + len(body), last, lace(FRAME) * (len(body) // FRAME), body))
        out.append(page(other, number, at + len(body), last, b"\x04", zlib.crc32(body).to_bytes(4, "little")))
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: whole packets, and for each the granule position of the page it ends on, if it is the last there."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    lost: int = 0
    ended: bool = False
    _next: int | None = None
    _open: list[bytes] | None = None

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if self._next is not None and number != self._next:
            self.lost += 1
            self._open = None
        self._next = (number + 1) & 0xFFFFFFFF
        skip = bool(flags & CONTINUED) and self._open is None  # its beginning is missing
        begin = self._open if flags & CONTINUED and self._open is not None else []
        self._open = None
        at, size, done = 0, 0, 0
        for value in lacing:
            size += value
            if value < 255:
                if skip:
                    skip = False
                else:
                    self.packets.append(b"".join([*begin, body[at : at + size]]))
                    self.granules.append(None)
                    done += 1
                begin, at, size = [], at + size, 0
        if lacing and lacing[-1] == 255 and not skip:
            self._open = [*begin, body[at:]]
        if done and granule != -1:
            self.granules[-1] = granule
        self.ended |= bool(flags & LAST)

    def ends(self, duration: Callable[[bytes], int]) -> list[int | None]:
        """Granule position at the end of each packet: a page's position holds for the last packet that ends on it, those before it lie back by the later ones' durations."""
        out: list[int | None] = [None] * len(self.packets)
        now = None
        for k in reversed(range(len(self.packets))):
            if self.granules[k] is not None:
                now = self.granules[k]
            out[k] = now
            now = None if now is None else now - duration(self.packets[k])
        return out


@dataclass
class Ogg:
    streams: dict[int, Stream]
    damaged: int


def read(data: bytes) -> Ogg:
    """All logical streams of an Ogg file, in order of their first pages."""
    streams: dict[int, Stream] = {}
    at = damaged = 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 <= len(data):
            _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + count]
            begin = at + 27 + count
            end = begin + sum(lacing)
            if version == 0 and len(lacing) == count and end <= len(data) and checksum(b"".join([data[at : at + 22], bytes(4), data[at + 26 : end]])) == crc:
                streams.setdefault(serial, Stream(serial)).add(flags, granule, number, lacing, data[begin:end])
                at = end
                continue
        damaged += 1
        at += 4
    return Ogg(streams, damaged)


def samples(ogg: Ogg) -> tuple[bytes, float]:
    """(samples, seconds) of the PCM stream; raises ValueError where the second stream's sums or the granule positions don't agree with it."""
    pcm = next((s for s in ogg.streams.values() if s.packets and s.packets[0][:8] == b"PCM     "), None)
    sums = next((s for s in ogg.streams.values() if s.packets and s.packets[0][:8] == b"SUMS    "), None)
    if pcm is None or sums is None:
        raise ValueError("no PCM stream with sums")
    rate = struct.unpack_from(">I", pcm.packets[0], 16)[0]
    data = b"".join(pcm.packets[1:])
    ends = pcm.ends(lambda p: 0 if p[:8] == b"PCM     " else len(p))
    marks = sums.ends(lambda _: 0)
    begin = 0
    for packet, end in zip(sums.packets[1:], marks[1:], strict=True):
        if end is None or zlib.crc32(data[begin:end]).to_bytes(4, "little") != packet:
            raise ValueError(f"samples {begin} to {end} don't have their sum")
        begin = end
    if begin != len(data) or ends[-1] != len(data) or ogg.damaged or pcm.lost:
        raise ValueError("pages are missing or damaged")
    return data, ends[-1] / rate


def feature(data: bytes, seconds: float) -> str:
    """Figures of the samples, all whole numbers but the time."""
    x = np.frombuffer(data, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    high = x > 127
    return f"seconds={seconds:.6f} sum={int(counts @ values)} squares={int(counts @ (values * values))} crossings={int(np.count_nonzero(high[1:] != high[:-1]))} levels={int(np.count_nonzero(counts))}"


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, media): the Ogg file of each text's UTF-8 bytes, padded by 255 to whole frames. Null text: empty. Other columns are left out."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                media = [store(padded(x or b"")) for x in part.column("text").cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(media, pa.binary())], ["id", "media"])

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(write, "id long, media binary").withColumnRenamed("id", id_col)


FEATURES = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Reads Ogg columns written by store_texts: one row each, with the sizes, digests and features of what was read back."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        types = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]
        for batch in batches:
            rows = []
            for doc, media in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                data, seconds = samples(read(media))
                rows.append((doc, len(data.rstrip(b"\xff")), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(data, seconds)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(look, FEATURES).withColumnRenamed("id", id_col)
