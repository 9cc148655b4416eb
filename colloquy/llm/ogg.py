"""Texts as samples in Ogg streams, and a reader of such streams.

A stream of 8-bit samples and a stream of notes are multiplexed into one physical Ogg stream per row. The
reader checks page checksums, reassembles packets from lacing values, separates the logical streams and takes
times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from colloquy.llm.arrow import map_columns

#: Samples in a packet, and samples in a second.
PACKET, RATE = 576, 48_000
#: Fixed values of the format: page header, flags, most lacing values in a page.
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST, LACES = 1, 2, 4, 255
#: First packets of the two streams.
SAMPLES_HEAD, NOTES_HEAD = b"\x7fsamples8", b"\x7fnotes"
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04C11DB7, high bit first, from 0), by way of zlib's, whose bits run the other way."""
    low = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(REVERSED), "big")


def page(serial: int, number: int, flags: int, granule: int, laces: bytes, body: bytes) -> bytes:
    def head(crc: int) -> bytes:
        return HEADER.pack(b"OggS", 0, flags, granule, serial, number, crc, len(laces)) + laces

    return head(checksum(head(0) + body)) + body


def laces_of(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


class Writer:
    """One logical stream; `packet` returns the pages that are full."""

    def __init__(self, serial: int):
        self.serial, self.number, self.laces, self.body = serial, 0, bytearray(), bytearray()
        self.open, self.begun = -1, False  # granule position of the open page, does it begin inside a packet

    def flush(self, flags: int = 0) -> bytes:
        flags |= (FIRST if self.number == 0 else 0) | (CONTINUED if self.begun else 0)
        out = page(self.serial, self.number, flags, self.open, bytes(self.laces), bytes(self.body))
        self.number += 1
        self.laces, self.body, self.open, self.begun = bytearray(), bytearray(), -1, False
        return out

    def packet(self, data: bytes, granule: int) -> list[bytes]:
        """Add a packet that ends at this granule position; pages break inside packets where they must."""
        out, laces, at, fresh = [], laces_of(len(data)), 0, True
        while laces:
            if len(self.laces) == LACES:
                out.append(self.flush())
                self.begun = not fresh
            part, laces = laces[: LACES - len(self.laces)], laces[LACES - len(self.laces) :]
            size = sum(part)
            self.laces += part
            self.body += data[at : at + size]
            at, fresh = at + size, False
        self.open = granule
        return out



def write_stream(payload: bytes, note: bytes) -> bytes:
    """A physical stream: both first pages, then the samples' pages with the notes' page halfway. Equal input, equal bytes."""
    serial = zlib.crc32(payload)
    samples, notes = Writer(serial), Writer(serial ^ 0xFFFFFFFF)
    out = []
    for stream, head in ((samples, SAMPLES_HEAD + struct.pack("<II", RATE, PACKET)), (notes, NOTES_HEAD)):
        stream.packet(head, 0)
        out.append(stream.flush())
    pages = []
    for at in range(0, len(payload), PACKET):
        pages += samples.packet(payload[at : at + PACKET], min(at + PACKET, len(payload)))
    pages.append(samples.flush(LAST))
    half = len(pages) // 2
    return b"".join([*out, *pages[:half], *notes.packet(note, 0), notes.flush(LAST), *pages[half:]])


@dataclass
class Logical:
    """A logical stream as read: packets, and for each page its end in samples and seconds."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pending: bytearray = field(default_factory=bytearray)
    number: int = 0
    ended: bool = False

    def times(self, rate: int = RATE) -> list[float]:
        return [g / rate for g in self.granules if g >= 0]


class OggError(ValueError):
    """The bytes are no sound Ogg stream."""


def read_streams(data: bytes) -> dict[int, Logical]:
    """Logical streams by serial number; raises OggError for what a sound stream can't hold."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError("cut off in a page header")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        laces = data[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(laces)
        if end > len(data):
            raise OggError("cut off in a page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum in the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Logical(serial)
        if serial not in streams or streams[serial].ended or streams[serial].number != number:
            raise OggError(f"page {number} of stream {serial} is out of order")
        s = streams[serial]
        if bool(s.pending) != bool(flags & CONTINUED):
            raise OggError("a continued packet has no start or no rest")
        body = at + HEADER.size + n
        for lace in laces:
            s.pending += data[body : body + lace]
            body += lace
            if lace < 255:
                s.packets.append(bytes(s.pending))
                s.pending.clear()
        s.number, s.ended, at = number + 1, bool(flags & LAST), end
        s.granules.append(granule)
    for s in streams.values():
        if s.pending or not s.ended:
            raise OggError(f"stream {s.serial} doesn't end")
    return streams


def stored(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the physical stream that holds it, padded with 255 to whole packets."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw.ljust(max(1, -(-len(raw) // PACKET)) * PACKET, b"\xff")
    return len(raw), write_stream(payload, struct.pack("<Q", len(raw)))


def loaded(media: bytes) -> tuple[bytes, int, list[float]]:
    """Payload, bytes without padding, and times of the page ends."""
    kinds = {}
    for s in read_streams(media).values():
        head = next((h for h in (SAMPLES_HEAD, NOTES_HEAD) if s.packets[0].startswith(h)), None)
        if head is None:
            raise OggError(f"stream {s.serial} is of an unknown kind")
        kinds[head] = s
    samples = kinds[SAMPLES_HEAD]
    rate = struct.unpack("<II", samples.packets[0][len(SAMPLES_HEAD) :])[0]
    payload = b"".join(samples.packets[1:])
    if samples.granules[-1] != len(payload):
        raise OggError("the last granule position isn't the number of samples")
    return payload, struct.unpack("<Q", kinds[NOTES_HEAD].packets[1])[0], samples.times(rate)


def features(payload: bytes, times: list[float]) -> str:
    """Duration, pages, mean, root mean square about the mean, and crossings of the middle, of the samples."""
    x = np.frombuffer(payload, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.uint32) ** 2).sum(dtype=np.int64))
    mean = total / len(x)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"seconds={times[-1]:.3f};pages={len(times)};mean={mean:.4f};rms={max(0.0, squares / len(x) - mean * mean) ** 0.5:.4f};crossings={crossings}"


def write_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text as an Ogg stream. A null text is stored as an empty one: one packet of padding. Each row gives a row; an empty table none."""

    def run(ids, texts):
        made = [stored(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [n for n, _ in made], "media": [m for _, m in made]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, {"doc_id": id_col, "text": text_col}, run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", keep_payload: bool = False) -> DataFrame:
    """What the stored bytes hold, read back and checked.

    Returns doc_id, n_bytes (unpadded), payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload bytes),
    media_bytes, media_sha256, feature, end_s (seconds, from the last granule position) and, if asked for, payload.
    Null media give nulls; broken media fail the task with the reason. Rows are independent; an empty table gives none.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "end_s", "payload"]

    def row(m):
        if m is None:
            return dict.fromkeys(names)
        payload, n, times = loaded(m)
        return {
            "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
            "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": features(payload, times), "end_s": times[-1], "payload": payload,
        }

    def run(ids, media):
        rows = [row(m) for m in media]
        return {"doc_id": ids} | {k: [r[k] for r in rows] for k in names}

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, end_s double"
    return map_columns(media, {"doc_id": id_col, "media": media_col}, run, schema + ", payload binary" * keep_payload)
