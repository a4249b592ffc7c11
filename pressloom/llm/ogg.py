"""Ogg media columns: page checksums, lacing, logical streams and granule timestamps.

``mux`` writes logical streams of packets as one physical Ogg stream; ``demux`` reads
one back: it verifies every page's checksum, reassembles packets from lacing values
(also across pages), separates streams by serial number and derives every packet's
time from the granule positions. ``store_samples`` and ``read_samples`` keep raw 8-bit
samples in such a stream; ``store`` and ``read`` are the columns over them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a packet of samples; payloads are padded to a multiple.
PACKET = 576
RATE = 8000
PAD = 255
_HEAD = struct.Struct("<4sBBqIIIB")
_MARK = struct.Struct("<4sBII")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The Ogg CRC-32 (polynomial 04C11DB7, most significant bit first, no inversion).

    It is zlib's CRC over bit-reversed bytes, with the inversions undone and the bits
    of the result reversed, so both run at native speed.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "big").translate(_REVERSED), "little")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def paginate(packets: list[bytes], granules: list[int], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) for one logical stream; the first packet has a page of its own.

    A page holds at most 255 lacing values. Its granule is that of the last packet
    that ends on it, -1 if none does.
    """
    pages: list[tuple[int, int, bytes, bytes]] = []
    lacing, body, granule, continued = bytearray(), [], -1, 0

    def flush(starts_inside: int) -> None:
        nonlocal granule, continued
        pages.append((continued, granule, bytes(lacing), b"".join(body)))
        lacing.clear()
        body.clear()
        granule, continued = -1, starts_inside

    for k, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while done < len(values):
            take = values[done : done + 255 - len(lacing)]
            body.append(packet[done * 255 : (done + len(take)) * 255])
            lacing += take
            done += len(take)
            if done == len(values):
                granule = at
            if len(lacing) == 255 or k == 0 and done == len(values):
                flush(_CONTINUED if done < len(values) else 0)
    if lacing or not pages:
        flush(0)
    last = len(pages) - 1
    return [
        (g, _page(c | (_FIRST if n == 0 else 0) | (_LAST if n == last else 0), g, serial, n, lac, bod))
        for n, (c, g, lac, bod) in enumerate(pages)
    ]


def mux(streams: dict[int, tuple[list[bytes], list[int]]]) -> bytes:
    """One physical stream of {serial: (packets, granules)}: first pages first, then by granule."""
    paged = {serial: paginate(packets, granules, serial) for serial, (packets, granules) in streams.items()}
    firsts = [pages[0][1] for pages in paged.values()]
    rest = []
    for order, pages in enumerate(paged.values()):
        at = 0
        for n, (granule, page) in enumerate(pages[1:]):
            at = max(at, granule)
            rest.append((at, order, n, page))
    return b"".join([*firsts, *(page for *_, page in sorted(rest, key=lambda x: x[:3]))])


@dataclass
class Logical:
    """One logical stream. ``ends`` has each packet's granule; -1 where a page states none for it."""

    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    closed: bool = False


def demux(data: bytes, duration=len) -> tuple[dict[int, Logical], int]:
    """({serial: Logical}, number of damaged spans) of a physical stream.

    A page with a false checksum or length is skipped up to the next capture pattern
    and counted. A packet that lost a page is dropped and counted in ``lost``.
    ``duration`` gives a packet's length in granules; a page's granule is its last
    ended packet's, and the packets before it on the page count back from there.
    """
    streams: dict[int, Logical] = {}
    open_packets: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    at = bad = 0
    while at < len(data):
        page_ok = False
        if data[at : at + 4] == b"OggS" and at + 27 <= len(data):
            _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            start = at + 27 + n
            end = start + sum(lacing)
            page_ok = (
                version == 0
                and len(lacing) == n
                and end <= len(data)
                and checksum(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]))) == crc
            )
        if not page_ok:
            bad += 1
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        stream = streams.setdefault(serial, Logical())
        parts = open_packets.pop(serial, None)
        if number != expected.get(serial, 0):
            stream.lost += number - expected.get(serial, 0)
            parts = None
        drop = flags & _CONTINUED and parts is None
        if not flags & _CONTINUED:
            parts = None
        ended, pos, length = [], start, 0
        for value in lacing:
            length += value
            if value < 255:
                piece = data[pos : pos + length]
                pos, length = pos + length, 0
                if drop:
                    drop = False
                    stream.lost += 1
                else:
                    ended.append(b"".join([*parts, piece]) if parts else piece)
                parts = None
        if length and not drop:
            open_packets[serial] = [*(parts or []), data[pos:end]]
        clock, ends = granule, []
        for packet in reversed(ended):
            ends.append(clock)
            clock = clock - duration(packet) if clock >= 0 else -1
        stream.packets += ended
        stream.ends += reversed(ends)
        stream.pages += 1
        stream.closed = bool(flags & _LAST)
        expected[serial] = number + 1
        at = end
    return streams, bad


def store_samples(payload: bytes, tracks: int = 2, rate: int = RATE) -> bytes:
    """An Ogg stream of 8-bit samples: consecutive runs of packets, one logical stream each.

    Serial numbers are 1, 2 and so on; a header packet carries the format mark, the
    track's number and count, and the rate. Equal payloads give equal bytes.
    """
    cut = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    tracks = max(1, min(tracks, len(cut)))
    streams, per = {}, -(-len(cut) // tracks)
    for k in range(tracks):
        own = cut[k * per : (k + 1) * per]
        ends = np.cumsum([0, *map(len, own)]).tolist()
        streams[k + 1] = ([_MARK.pack(b"PCM8", k, tracks, rate), *own], ends)
    return mux(streams)


def read_samples(media: bytes) -> tuple[bytes, str]:
    """(samples, feature) of what ``store_samples`` wrote; any damage is an error.

    The feature states streams, pages, packets, the duration in milliseconds from
    the last granules, the mean and peak sample, and the crossings of the middle.
    """
    size = lambda packet: 0 if packet[:4] == b"PCM8" and len(packet) == _MARK.size else len(packet)
    streams, bad = demux(media, size)
    order, rate = {}, RATE
    for stream in streams.values():
        mark, number, tracks, rate = _MARK.unpack(stream.packets[0])
        if mark != b"PCM8" or tracks != len(streams) or stream.lost or not stream.closed:
            raise ValueError("an incomplete stream")
        starts = [end - len(p) for end, p in zip(stream.ends[1:], stream.packets[1:], strict=True)]
        if starts != [0, *stream.ends[1:-1]][: len(starts)]:
            raise ValueError("granule positions do not follow the samples")
        order[number] = stream
    if bad or not streams or sorted(order) != list(range(len(streams))):
        raise ValueError("a damaged stream")
    payload = b"".join(p for k in range(len(order)) for p in order[k].packets[1:])
    samples = np.frombuffer(payload, np.uint8)
    high = samples >= 128
    ticks = sum(s.ends[-1] for s in streams.values())
    facts = {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()),
        "packets": sum(len(s.packets) for s in streams.values()),
        "ms": ticks * 1000 // rate,
        "mean": int(samples.sum(dtype=np.int64)) // max(1, len(samples)),
        "peak": int(samples.max(initial=0)),
        "crossings": int(np.count_nonzero(high[1:] != high[:-1])),
    }
    return payload, ";".join(f"{k}={v}" for k, v in facts.items())


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of PACKET."""
    return data + bytes([PAD]) * (PACKET - len(data) % PACKET if len(data) % PACKET or not data else 0)


def store(text: Column | str) -> Column:
    """Whole texts (or binaries) as Ogg media; null counts as empty.

    Equal texts have equal media, row by row; a very long text is one longer stream, held
    in one task a few times over. An empty table gives no rows, other columns are not read.
    """

    def run(values: pa.Array) -> pa.Array:
        return pa.array([store_samples(padded(v.as_py() or b"")) for v in values], pa.binary())

    return F.arrow_udf(run, "binary")((F.col(text) if isinstance(text, str) else text).cast("binary"))


_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read(media: Column | str) -> Column:
    """A struct of what the stored media hold: sizes, digests and the feature; null media give null fields."""

    def one(value: bytes | None) -> tuple:
        if value is None:
            return (None,) * 6
        payload, feature = read_samples(value)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(value), hashlib.sha256(value).hexdigest(), feature)

    def run(values: pa.Array) -> pa.Array:
        rows = [one(v.as_py()) for v in values]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [part.split()[0] for part in _READ.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return F.arrow_udf(run, _READ)(media)
