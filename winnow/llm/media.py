"""Texts as Ogg media: writing, and reading back by the container's own rules.

The reader verifies each page's checksum, demultiplexes pages by serial number, reassembles
packets from lacing values (also over page boundaries) and derives timestamps from granule
positions. A file written here has two logical streams: unsigned 8-bit PCM at 8000 Hz, whose first
packet is a header with rate, channels and bits and whose other packets are samples, and a note
whose single packet holds the unpadded length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import map_slices, with_bytes

RATE = 8000
#: Fixed values of the container: capture pattern, header layout after it, flags.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
PCM_MAGIC, NOTE_MAGIC = b"PCM8    ", b"NOTE    "
PACKET, BLOCK = 4096, 64
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def checksum(page: bytes) -> int:
    """The container's CRC: polynomial 0x04C11DB7, high bit first, no inversion.

    It equals zlib's (low bit first, inverted at both ends) on mirrored bytes, mirrored.
    """
    reflected = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(MIRROR), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    raw = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def lace(n: int) -> bytes:
    """A packet's lacing values: as many 255s as fit, then the rest, 0 at a multiple of 255."""
    return b"\xff" * (n // 255) + bytes([n % 255])


def stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; each packet comes with the granule position at its end.

    The first packet has a page of its own. A page holds up to 255 segments; a packet that does
    not fit goes on in the next page. A page in which no packet ends has granule position -1.
    """
    pages: list[bytes] = []
    laces, body, granule, carried = bytearray(), bytearray(), -1, False

    def flush(last: bool) -> None:
        nonlocal carried, granule
        flags = (CONTINUED if carried else 0) | (FIRST if not pages else 0) | (LAST if last else 0)
        pages.append(page(serial, len(pages), flags, granule, bytes(laces), bytes(body)))
        carried = bool(laces) and laces[-1] == 255
        laces.clear()
        body.clear()
        granule = -1

    for i, (data, end) in enumerate(packets):
        todo, at = lace(len(data)), 0
        while todo:
            room = 255 - len(laces)
            part, todo = todo[:room], todo[room:]
            n = sum(part)
            laces += part
            body += data[at : at + n]
            at += n
            if not todo:
                granule = end
            if len(laces) == 255 and (todo or i + 1 < len(packets)):
                flush(False)
        if i == 0 and len(packets) > 1:
            flush(False)
    flush(True)
    return pages


def write(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg file with the payload as samples; the pages of its two streams alternate."""
    serial = zlib.crc32(payload)
    header = PCM_MAGIC + struct.pack("<IBB", RATE, 1, 8)
    packets, end = [(header, 0)], 0
    for a in range(0, len(payload), PACKET):
        part = payload[a : a + PACKET]
        end += len(part)
        packets.append((part, end))
    sound = stream(serial, packets)
    note = stream(serial ^ 0x5A5A5A5A, [(NOTE_MAGIC + struct.pack("<Q", n_bytes), 0)])
    return b"".join([sound[0], *note, *sound[1:]])  # the first pages of all streams come first


@dataclass
class Stream:
    """One logical stream as read: whole packets, and the time at which each page ends."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: list[bytes] = field(default_factory=list)


def read(data: bytes) -> dict[int, Stream]:
    """The logical streams of a file by serial number, in order of appearance.

    Raises ValueError for a bad capture pattern, checksum, page number, truncation, or a packet
    that is continued where none is open or left open at the end.
    """
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError("truncated page header")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != CAPTURE or version:
            raise ValueError("no page starts here")
        body = at + HEADER.size + n
        laces = data[at + HEADER.size : body]
        end = body + sum(laces)
        if len(laces) < n or end > len(data):
            raise ValueError("truncated page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError("page checksum does not match")
        if bool(flags & FIRST) == (serial in streams):
            raise ValueError("a stream starts twice or not at all")
        s = streams.setdefault(serial, Stream(serial))
        if number != s.pages or s.ended:
            raise ValueError("a page is missing or out of order")
        if bool(flags & CONTINUED) != bool(s.partial):
            raise ValueError("a packet is continued where none is open, or not continued")
        s.pages += 1
        if granule >= 0:
            s.granules.append(granule)
        for k in laces:
            s.partial.append(data[body : body + k])
            body += k
            if k < 255:
                s.packets.append(b"".join(s.partial))
                s.partial = []
        s.ended = bool(flags & LAST)
        at = end
    if any(s.partial or not s.ended for s in streams.values()):
        raise ValueError("a stream is cut off")
    return streams


def decode(data: bytes) -> tuple[bytes, int, dict]:
    """The payload read back, its unpadded length, and what the container tells of it."""
    streams = read(data)
    sound = next(s for s in streams.values() if s.packets[0].startswith(PCM_MAGIC))
    note = next(s for s in streams.values() if s.packets[0].startswith(NOTE_MAGIC))
    rate, channels, bits = struct.unpack("<IBB", sound.packets[0][len(PCM_MAGIC) :])
    payload = b"".join(sound.packets[1:])
    if sound.granules[-1] * channels * bits // 8 != len(payload):
        raise ValueError("the last granule position is not the number of samples")
    about = {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "seconds": sound.granules[-1] / rate, "page_ends": [g / rate for g in sound.granules]}
    return payload, struct.unpack("<Q", note.packets[0][len(NOTE_MAGIC) :])[0], about


def features(payload: bytes, about: dict) -> str:
    """Sample statistics and container facts as one string; equal payloads give equal strings."""
    import numpy as np

    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    rms = float(np.sqrt(np.mean(x * x)))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"streams={about['streams']};pages={about['pages']};packets={about['packets']};seconds={about['seconds']:.4f};rms={rms:.4f};peak={int(np.abs(x).max())};crossings={crossings};page_ends={','.join(f'{t:.4f}' for t in about['page_ends'])}"


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, unpadded length and the Ogg bytes of each document (null text: empty)."""

    def one(batch: pa.RecordBatch) -> dict:
        raw = batch.column("utf8").to_pylist()
        return {"doc_id": batch.column("doc_id"), "media": [write(pad(x), len(x)) for x in raw]}

    return map_slices(with_bytes(docs, "doc_id"), lambda: one, "doc_id long, media binary")


def digest(docs: DataFrame) -> DataFrame:
    """Store each document as Ogg, read the stored bytes back, and describe what was read.

    One row per row of ``docs`` (columns: ``MEDIA``). Null and empty texts become one block of
    zeros. Texts of any length are stored whole, one at a time, over as many pages as they need.
    Repeated rows and null ids give rows of their own; equal texts give equal values, so ties are
    alike. An empty table gives an empty result. Columns other than doc_id and text are ignored.
    The feature tells the streams, pages, packets and length in seconds, statistics of the samples,
    and when each page of sound ends by its granule position.
    """

    def one(batch: pa.RecordBatch) -> dict:
        out: list[tuple] = []
        for x in batch.column("utf8"):
            raw = x.as_py()
            media = write(pad(raw), len(raw))
            payload, n, about = decode(media)
            out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, about)))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*out, strict=True), strict=True))

    return map_slices(with_bytes(docs, "doc_id"), lambda: one, MEDIA)
