"""Ogg against an independent bit-by-bit checksum and exact round trips."""

import hashlib
import random
import struct
import zlib

import pytest
from llm_support import ODD, docs_of

from pressloom.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_matches_the_bitwise_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)


def test_packets_of_any_size_come_back_from_two_streams():
    rng = random.Random(2)
    sizes = [[0, 1, 254, 255, 256, 510, 70_000, 3], [10, 255 * 255, 255 * 254 + 1, 0, 0, 5]]
    streams = {}
    for serial, own in enumerate(sizes, 7):
        packets, clock, ends = [rng.randbytes(n) for n in own], 0, []
        for p in packets:
            clock += len(p)
            ends.append(clock)
        streams[serial] = (packets, ends)
    data = ogg.mux(streams)
    found, bad = ogg.demux(data)
    assert bad == 0
    for serial, (packets, ends) in streams.items():
        assert found[serial].packets == packets and found[serial].closed and not found[serial].lost
        assert [e for e in found[serial].ends] == ends


def test_every_page_is_a_valid_page():
    data, at, seen = ogg.store_samples(bytes(range(256)) * 1000), 0, 0
    data = ogg.store_samples(ogg.padded(bytes(range(256)) * 1000))
    while at < len(data):
        head = data[at : at + 27]
        assert head[:4] == b"OggS"
        lacing = data[at + 27 : at + 27 + head[26]]
        end = at + 27 + head[26] + sum(lacing)
        page = bytearray(data[at:end])
        page[22:26] = bytes(4)
        assert slow_crc(page) == struct.unpack("<I", head[22:26])[0]
        at, seen = end, seen + 1
    assert seen > 4


def test_damage_is_found_and_the_rest_survives():
    data = ogg.store_samples(ogg.padded(b"payload" * 60_000))
    hurt = bytearray(data)
    hurt[60_000] ^= 1
    streams, bad = ogg.demux(bytes(hurt))
    assert bad and sum(s.lost for s in streams.values()) >= 1
    assert sum(len(s.packets) for s in streams.values()) > 100
    with pytest.raises(ValueError):
        ogg.read_samples(bytes(hurt))
    assert ogg.demux(b"") == ({}, 0)
    assert ogg.demux(b"junk") == ({}, 1)
    assert ogg.demux(b"junk" + data)[1] == 1


def slow_store(payload):
    """The stored form written from the format alone: packets of 576 bytes are lacing values 255, 255, 66, so a page holds 85."""
    packets = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    tracks = min(2, len(packets))
    per = -(-len(packets) // tracks)
    firsts, rest = [], []
    for k in range(tracks):
        own, at = packets[k * per : (k + 1) * per], 0
        pages = [(2, 0, bytes([13]), b"PCM8" + bytes([k]) + tracks.to_bytes(4, "little") + (8000).to_bytes(4, "little"))]
        for i in range(0, len(own), 85):
            some = own[i : i + 85]
            at += 576 * len(some)
            pages.append((4 if i + 85 >= len(own) else 0, at, bytes([255, 255, 66]) * len(some), b"".join(some)))
        for n, (flags, granule, lacing, body) in enumerate(pages):
            page = b"OggS" + bytes([0, flags]) + granule.to_bytes(8, "little") + (k + 1).to_bytes(4, "little") + n.to_bytes(4, "little") + bytes(4) + bytes([len(lacing)]) + lacing + body
            page = page[:22] + slow_crc(page).to_bytes(4, "little") + page[26:]
            (rest if n else firsts).append((granule, k, n, page))
    return b"".join(page for *_, page in firsts + sorted(rest))


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        pad = raw + b"\xff" * ((576 - len(raw) % 576) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(pad))
        assert r.payload_sha256 == hashlib.sha256(pad).hexdigest()
        assert r.tail_crc32 == zlib.crc32(pad[-32:])
        media = slow_store(pad)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"ms={len(pad) // 8};" in r.feature


def test_query_over_odd_and_real_texts(spark, tmp_path, real):
    from pressloom.llm import catalog

    docs_of(spark, ODD).withColumnRenamed("n_chars", "media").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["op2_ogg"](spark, str(tmp_path)).collect()
    check(rows, dict(enumerate(ODD)))
    same = {r.doc_id: r[2:] for r in rows}
    assert same[4] == same[7]
    texts = {r.doc_id: r.text for r in real.collect()}
    check(catalog.QUERIES["op2_ogg"](spark, "/root/testdata/sf0.001").collect(), texts)
    docs_of(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert catalog.QUERIES["op2_ogg"](spark, f"{tmp_path}/empty").count() == 0
