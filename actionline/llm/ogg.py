"""Operator 10: texts as Ogg media columns, and the features of what is read back from them.

Each text becomes one Ogg file with two logical streams: a head stream of one packet (magic, rate,
bytes before padding) and a stream of 8-bit samples in packets of 4096. The reader trusts nothing but
the bytes: it verifies page checksums, takes packets together from the lacing values, parts the streams
by serial number, checks page order, and derives timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from actionline.llm.common import id_text, table, written

RATE, PACKET, UNIT = 8000, 4096, 64
HEAD = b"u8 pcm\0\1"
#: Each byte with its bits in reverse: Ogg's CRC-32 is zlib's polynomial fed from the other end.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_PAGE = struct.Struct("<4sBBqIIIB")


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, from the highest bit, initial value and final XOR 0."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = _PAGE.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def _stream(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """The pages of one logical stream. A page has at most 255 lacing values; packets may cross pages."""
    segments = []  # lacing value, bytes, granule position where a packet ends
    for packet, granule in zip(packets, granules, strict=True):
        for at in range(0, len(packet) + 1, 255):
            part = packet[at : at + 255]
            segments.append((len(part), part, granule if len(part) < 255 else None))
    pages = []
    for n, at in enumerate(range(0, len(segments), 255)):
        here = segments[at : at + 255]
        kind = (1 if at and segments[at - 1][2] is None else 0) | (2 if not at else 0) | (4 if at + 255 >= len(segments) else 0)
        done = [g for _, _, g in here if g is not None]
        pages.append(_page(kind, done[-1] if done else -1, serial, n, bytes(s[0] for s in here), b"".join(s[1] for s in here)))
    return pages


def encode(text: str | None) -> bytes:
    """The Ogg file of a text; serial numbers come from its content, so equal texts give equal bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    payload = data + bytes(-len(data) % UNIT or (0 if data else UNIT))
    serial = zlib.crc32(payload)
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(len(payload), i + PACKET) for i in range(0, len(payload), PACKET)]
    head = _stream([HEAD + struct.pack("<IQ", RATE, len(data))], [0], serial ^ 1)
    body = _stream(packets, ends, serial)
    return b"".join([head[0], body[0], *head[1:], *body[1:]])  # all first pages come first


def decode(media: bytes) -> dict[int, dict]:
    """For each serial number: packets, granule positions of their pages, pages. Raises ValueError on damage."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) < at + 27:
            raise ValueError("a page is cut off")
        magic, version, kind, granule, serial, number, crc, n = _PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(media) < end:
            raise ValueError("a page is cut off")
        page = media[at:end]
        if page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise ValueError(f"the page at byte {at} has another checksum")
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": None, "ended": False})
        if number != s["pages"] or s["ended"] or bool(kind & 2) != (number == 0) or bool(kind & 1) != (s["open"] is not None):
            raise ValueError(f"the page at byte {at} is out of order")
        s["pages"] += 1
        s["ended"] = bool(kind & 4)
        s["granules"].append(granule)
        body = at + 27 + n
        parts, s["open"] = s["open"] or [], None
        for value in lacing:
            parts.append(media[body : body + value])
            body += value
            if value < 255:
                s["packets"].append(b"".join(parts))
                parts = []
        if parts:
            s["open"] = parts
        elif lacing and lacing[-1] == 255:
            s["open"] = []
        at = end
    if any(not s["ended"] or s["open"] is not None for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def samples(media: bytes) -> tuple[bytes, int, dict]:
    """The payload, the bytes before padding, and the sample stream with its timestamps in seconds."""
    streams = decode(media)
    head = next((p for s in streams.values() for p in s["packets"][:1] if p[:8] == HEAD and len(p) == 20), None)
    body = [s for s in streams.values() if not s["packets"] or s["packets"][0][:8] != HEAD or len(s["packets"][0]) != 20]
    if head is None or len(body) != 1:
        raise ValueError("a head stream and a sample stream are expected")
    rate, n_bytes = struct.unpack("<IQ", head[8:])
    payload = b"".join(body[0]["packets"])
    times = [g / rate for g in body[0]["granules"] if g >= 0]
    if body[0]["granules"][-1] != len(payload):
        raise ValueError("the last granule position is not the count of samples")
    return payload, n_bytes, {"streams": len(streams), "pages": sum(s["pages"] for s in streams.values()), "packets": len(body[0]["packets"]), "times": times}


def feature(payload: bytes, found: dict) -> str:
    """Duration, counts, mean, root mean square around 128, zero crossings and peak of the samples."""
    x = np.frombuffer(payload, np.uint8)
    total = squares = crossings = peak = 0
    last = None
    for at in range(0, len(x), 1 << 20):
        part = x[at : at + (1 << 20)].astype(np.int64) - 128
        total += int(part.sum())
        squares += int((part * part).sum())
        up = part >= 0
        crossings += int((up[1:] != up[:-1]).sum()) + (last is not None and last != up[0])
        last, peak = up[-1], max(peak, int(np.abs(part).max()))
    return f"sec={found['times'][-1]:.6f};streams={found['streams']};pages={found['pages']};packets={found['packets']};mean={total / len(x):.6f};rms={(squares / len(x)) ** 0.5:.6f};crossings={int(crossings)};peak={peak}"


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id and media: the Ogg bytes of each text, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(x.as_py()) for x in part.column(1)], pa.binary())], ["doc_id", "media"])

    return written(id_text(docs).mapInArrow(run, "doc_id long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of each row hold; a damaged file raises."""
    names = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                raw = x.as_py()
                payload, n_bytes, found = samples(raw)
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(payload, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, names.values(), strict=True))], ["doc_id", *names])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts: 64 zero bytes. Null doc_id and repeated rows: each its own file. Empty table: empty
    result. Long texts are kept whole; one task holds one batch of texts and their files. Ties: equal texts, equal
    values. Other columns, clashing names among them, are ignored."""
    return media_features(write_media(table(spark, sf_dir, "documents")))
