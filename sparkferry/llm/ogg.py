"""Media columns: Ogg containers of 8-bit samples, written and read by the published framing (RFC 3533).

A text's UTF-8 bytes, filled with spaces up to a positive multiple of 192, are the samples of an uncompressed mono
stream; a second logical stream, interleaved with it, holds the unpadded length. Reading verifies each page's checksum and
sequence number, reassembles packets from the lacing values, demultiplexes the streams by serial number, and derives
the time of each packet of each stream from the granule positions. A row is read and written by itself: nothing is shuffled.

A page's granule position is the time at the end of the last packet that ends on it, and may never fall within a stream. Samples
tell how long each audio packet lasts, so packets before a page's last get their times by counting, which must meet the
page's position. A cue has no duration: it is at the position of its page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkferry.llm._frames import carried, ship, slices

BLOCK, RATE, PACKET = 192, 8000, 1920
CONTINUED, FIRST, LAST = 1, 2, 4
#: A page without the end of a packet has this granule position.
NONE = 0xFFFFFFFFFFFFFFFF
PAGE = struct.Struct("<4sBBQIIIB")
REFLECTED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: OggPCM header: magic, version 0.0, format unsigned 8 bit, rate, significant bits, channels, most frames in a packet, further headers.
PCM = struct.Struct(">8sHHIIBBHI")
PCM_MAGIC, PCM_U8 = b"PCM     ", 1
CUE_MAGIC = b"\x80cue\x00\x00\x00\x00"


def page_crc(data: bytes) -> int:
    """Ogg's CRC (polynomial 0x04c11db7, unreflected, initial value and final xor 0), by zlib's reflected one over reflected bytes."""
    crc = zlib.crc32(data.translate(REFLECTED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REFLECTED), "big")


def make_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_crc(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]], number: int = 0, last: bool = True) -> list[bytes]:
    """Pages of a logical stream from (packet, granule position at its end); the first packet has a page alone when number is 0."""
    pages: list[bytes] = []

    def put(lacing, body, granule, continued, end):
        flags = CONTINUED * continued | FIRST * (number + len(pages) == 0) | LAST * (end and last)
        pages.append(make_page(serial, number + len(pages), flags, granule, bytes(lacing), b"".join(body)))

    lacing: list[int] = []
    body: list[bytes] = []
    granule, continued = NONE, False
    for k, (packet, at) in enumerate(packets):
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        taken = 0
        while sizes:
            n = min(len(sizes), 255 - len(lacing))
            size = sum(sizes[:n])
            lacing += sizes[:n]
            body.append(packet[taken : taken + size])
            taken, sizes = taken + size, sizes[n:]
            if not sizes:
                granule = at
            end = k == len(packets) - 1 and not sizes
            if len(lacing) == 255 or end or (number + len(pages) == 0 and not sizes):
                put(lacing, body, granule, continued, end)
                lacing, body, granule, continued = [], [], NONE, bool(sizes)
    return pages


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % BLOCK or BLOCK * (not data))


def write_ogg(data: bytes) -> bytes:
    """The container of a text's bytes; equal bytes make equal containers."""
    payload = pad(data)
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    audio = [(PCM.pack(PCM_MAGIC, 0, 0, PCM_U8, RATE, 8, 1, PACKET, 0), 0)]
    audio += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    cue = [(CUE_MAGIC, 0), (struct.pack("<Q", len(data)), len(payload))]
    a, c = stream_pages(serial, audio), stream_pages(serial | 1, cue)
    return b"".join([a[0], c[0], a[1], *c[1:], *a[2:]])  # first pages before all others


class Damaged(ValueError):
    """A container that breaks a rule of the framing."""


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(serial, flags, granule, lacing, body) of each page; its checksum and its stream's page numbers must be right."""
    at, numbers = 0, {}
    while at < len(data):
        if len(data) < at + PAGE.size:
            raise Damaged("a page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise Damaged(f"no page at byte {at}")
        lacing = data[at + PAGE.size : at + PAGE.size + n]
        end = at + PAGE.size + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise Damaged("a page is cut off")
        page = data[at:end]
        if page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise Damaged(f"wrong checksum at byte {at}")
        if number != numbers.get(serial, -1) + 1 or bool(flags & FIRST) != (number == 0):
            raise Damaged(f"page {number} of stream {serial} is out of order")
        numbers[serial] = number
        yield serial, flags, granule, lacing, page[PAGE.size + n :]
        at = end


def read_streams(data: bytes) -> tuple[dict[int, list[tuple[bytes, int | None]]], int]:
    """Packets by serial number, and the number of pages. The last packet that ends on a page has the page's granule position, the others None."""
    packets: dict[int, list[tuple[bytes, int | None]]] = {}
    rest: dict[int, list[bytes]] = {}
    latest: dict[int, int] = {}
    ended: set[int] = set()
    count = 0
    for serial, flags, granule, lacing, body in read_pages(data):
        count += 1
        if serial in ended:
            raise Damaged("a page follows its stream's last")
        out, open_ = packets.setdefault(serial, []), rest.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(open_):
            raise Damaged("a continued packet lacks a part")
        at, size, done = 0, 0, len(out)
        for n in lacing:
            size += n
            if n < 255:
                open_.append(body[at : at + size])
                out.append((b"".join(open_), None))
                open_.clear()
                at, size = at + size, 0
        if size:
            open_.append(body[at : at + size])
        if (granule == NONE) == (len(out) > done):
            raise Damaged("a granule position without the end of a packet, or an end without it")
        if granule != NONE:
            if granule < latest.get(serial, 0):
                raise Damaged("granule positions fall")
            latest[serial] = granule
            out[-1] = (out[-1][0], granule)
        if flags & LAST:
            ended.add(serial)
    if ended != set(packets) or any(rest.values()):
        raise Damaged("a stream doesn't end")
    return packets, count


def audio_times(packets: list[tuple[bytes, int | None]], rate: int) -> list[int]:
    """The microsecond at which each packet of samples ends: counted, and held against each granule position."""
    out, position = [], 0
    for samples, granule in packets:
        position += len(samples)
        if granule is not None and granule != position:
            raise Damaged("granule positions and samples differ")
        out.append(position * 1_000_000 // rate)
    return out


def cue_times(packets: list[tuple[bytes, int | None]], rate: int) -> list[int]:
    """The microsecond of each cue: its page's granule position, which is the next that is given."""
    out, position = [], 0
    for _, granule in reversed(packets):
        position = granule if granule is not None else position
        out.append(position * 1_000_000 // rate)
    return out[::-1]


def read_ogg(data: bytes) -> dict:
    """Payload, unpadded length, times and features of a container. Raises Damaged."""
    streams, pages = read_streams(data)
    audio = next((p for p in streams.values() if p and p[0][0][:8] == PCM_MAGIC), None)
    cue = next((p for p in streams.values() if len(p) == 2 and p[0][0] == CUE_MAGIC and len(p[1][0]) == 8), None)
    if audio is None or cue is None or len(audio[0][0]) != PCM.size:
        raise Damaged("a stream is missing")
    _, _, _, kind, rate, _, channels, _, _ = PCM.unpack(audio[0][0])
    if kind != PCM_U8 or channels != 1 or not rate:
        raise Damaged("samples of another format")
    payload = b"".join(p for p, _ in audio[1:])
    n = struct.unpack("<Q", cue[1][0])[0]
    audio_us, cue_us = audio_times(audio[1:], rate), cue_times(cue[1:], rate)
    if audio[0][1] or cue[0][1] or audio[-1][1] != len(payload) or n > len(payload):
        raise Damaged("granule positions and samples differ")
    samples, end_us = np.frombuffer(payload, np.uint8), audio_us[-1] if audio_us else 0
    # 16 bits for each sum: integers only, so that equal samples make equal strings everywhere.
    mean, crossings = int(samples.sum(dtype=np.int64)) * 1000 // max(1, len(samples)), int(np.count_nonzero((samples[1:] >= 96) != (samples[:-1] >= 96)))
    feature = f"pages={pages} streams={len(streams)} packets={len(audio) - 1} end_us={end_us} cue_us={cue_us[0]} mean_milli={mean} peak={int(samples.max(initial=0))} crossings={crossings}"
    return {"payload": payload, "n_bytes": n, "pages": pages, "packets": len(audio) - 1, "end_us": end_us, "audio_us": audio_us, "cue_us": cue_us, "feature": feature}


def to_media(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's kept columns with media, its text's container. A null text is empty (192 spaces); repeated rows stay; an
    empty table gives an empty one; other columns may have any name."""
    ship(df.sparkSession)
    rows, kept, back = carried(df, text, keep, ("media",))
    schema = T.StructType([*kept, T.StructField("media", T.BinaryType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "in__"):
                made = pa.array([write_ogg((s or "").encode()) for s in batch.column("in__").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [made], schema.names)

    return rows.mapInArrow(run, schema).select(*back, "media")


FIELDS = "payload binary, n_bytes long, pages int, packets int, end_us long, audio_us array<long>, cue_us array<long>, feature string, error string"


def read_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's kept columns with payload (padded samples), n_bytes (unpadded), pages, packets, end_us (the last sample's
    end), audio_us and cue_us (the time of each packet, in microseconds), feature and error. A null or damaged container has an error and nulls elsewhere."""
    ship(df.sparkSession)
    made = T._parse_datatype_string(FIELDS)
    rows, kept, back = carried(df, media, keep, made.names)
    schema = T.StructType(kept + made.fields)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                got = []
                for x in batch.column("in__").to_pylist():
                    try:
                        got.append(read_ogg(x) | {"error": None} if x is not None else {"error": "no media"})
                    except Damaged as e:
                        got.append({"error": str(e)})
                kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string()]
                new = [pa.array([g.get(f.name) for g in got], k) for f, k in zip(made.fields, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + new, schema.names)

    return rows.mapInArrow(run, schema).select(*back, *made.names)
