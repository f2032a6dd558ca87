import hashlib
import random
import time
import zlib

import pytest

from velum.llm import media


def frame(b1, b2, b3, size, body=b"", crc=True):
    raw = bytes((0xFF, b1, b2, b3))
    h = media.Header(raw)
    assert h.size == size
    data = body.ljust(size - 6 if crc else size - 4, b"\0")
    if not crc:
        return raw + data
    bits = h.checked_bits(data)
    return raw + media.crc16(raw[2:] + data, 16 + bits).to_bytes(2, "big") + data


def test_round_trip_of_any_text(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "a"), (4, "é" * 96), (5, "x" * 193), (6, "ID3 TAG Xing \x00"), (7, "y" * 200_000), (7, "y" * 200_000)]
    rows += [(100 + i, "".join(chr(rng.randrange(1, 0x2FF)) for _ in range(rng.randrange(4000)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 as media", "4 as feature")
    got = sorted((tuple(r) for r in media.media_features(df).collect()), key=lambda r: r[0])
    for (i, t), r in zip(rows, got, strict=True):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        stream = media.write_stream(padded, len(raw))
        assert r[:7] == (i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), len(stream), hashlib.sha256(stream).hexdigest())
        found = media.read_stream(stream)
        assert found["junk"] == 0 and found["crc_failed"] == 0 and found["crc_checked"] == len(found["frames"]) == found["table"]["frames"]
        assert found["table"]["bytes"] == len(stream) - found["info_at"]


@pytest.mark.parametrize("b1,b2,b3,size,samples", [(0xFA, 0xA0, 0x40, 522, 1152), (0xFE, 0x90, 0x00, 312, 384), (0xFC, 0xA4, 0xC0, 576, 1152), (0xF2, 0x80, 0x00, 208, 576), (0xE2, 0x80, 0xC0, 417, 576), (0xF4, 0x80, 0x40, 417, 1152)])
def test_resynchronises_over_junk_and_finds_bad_checksums(b1, b2, b3, size, samples):
    one = frame(b1, b2, b3, size, bytes(range(1, 200)))
    bad = one[:8] + bytes([one[8] ^ 8]) + one[9:]
    junk = b"noise \xff\xfb nothing \xff\xff\xe0"
    stream = one * 3 + junk + one * 2 + bad + one
    r = media.read_stream(stream)
    assert len(r["frames"]) == 7 and r["junk"] == len(junk)
    assert (r["crc_checked"], r["crc_failed"]) == (7, 1)
    assert media.duration(r["frames"]) == [(r["frames"][0][1].rate, 7 * samples)]
    assert [p for p, _ in r["frames"]][3] == 3 * size + len(junk)


def test_tags_tables_and_truncation():
    one = frame(0xFA, 0x98, 0xC0, 576)
    info = one[:2] + one[2:23] + b"Info" + (9).to_bytes(4, "big") + (5).to_bytes(4, "big") + (77).to_bytes(4, "big")
    info = info.ljust(576, b"\0")
    vbri = (one[:36] + b"VBRI" + bytes(4) + (60).to_bytes(2, "big") + (4000).to_bytes(4, "big") + (6).to_bytes(4, "big") + bytes(8)).ljust(576, b"\0")
    v1 = b"TAG" + b"Song".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + bytes(30) + b"1999" + bytes(31)
    id3 = b"ID3\x04\0\0\0\0\0\x10" + b"TIT2\0\0\0\x06\0\0\x03title"
    for first, kind, frames in ((info, "Info", 5), (vbri, "VBRI", 6)):
        r = media.read_stream(id3 + first + one * 5 + id3 + one + one[:100] + v1)
        assert r["table"]["kind"] == kind and r["table"]["frames"] == frames
        assert len(r["frames"]) == 6 and r["junk"] == 100 and r["tags"]["TIT2"] == "title" and r["tags"]["ID3v1.title"] == "Song"
    free = b"\xff\xfb\x04\xc0" + b"z" * 300
    assert [p for p, _ in media.read_stream(free * 3)["frames"]] == [0, 304] or len(media.read_stream(free * 3)["frames"]) == 3
    assert media.read_stream(b"")["frames"] == [] and media.read_stream(b"\xff" * 50)["junk"] == 50


def test_info_column_of_any_bytes(spark):
    rng = random.Random(2)
    rows = [(None,), (b"",), (bytes(rng.randrange(256) for _ in range(3000)),), (media.write_stream(b"q" * 1920, 1900),)]
    got = [r.info for r in media.with_info(spark.createDataFrame(rows, "media binary").coalesce(1)).collect()]
    assert [r.frames for r in got[:2]] == [0, 0] and got[3].frames == 2 and got[3].samples == 2304 and got[3].seconds == 0.072
    assert media.media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_data_that_looks_like_a_trailing_tag(spark):
    texts = []
    for blocks in (*range(1, 9), 15):
        for text in (b"x" * (192 * blocks),):
            n = len(text)
            stream = media.write_stream(text, n)
            start = media.read_stream(stream)["frames"][-1][0] + 23
            first = (blocks - 1) // 7 * 7 * 192  # of the last frame's data
            for back, mark in ((128, b"TAG"), (32, b"APETAGEX\xd0\x07\0\0" + (40).to_bytes(4, "little")), (32, b"APETAGEX\0\0\0\0" + (len(stream) - 20).to_bytes(4, "little")), (32, b"APETAGEX\0\0\0\0" + (len(stream) - 200).to_bytes(4, "little")), (15, b"000100LYRICS200"), (15, b"000216LYRICS200")):
                at = first + len(stream) - back - start
                if first <= at and at + len(mark) <= n:
                    texts.append(text[:at] + mark + text[at + len(mark) :])
    assert len(texts) > 10
    for t in texts:
        stream = media.write_stream(t, len(t))
        found = media.read_stream(stream)
        assert media.read_payload(stream, found) == (t, len(t))
        assert found["junk"] == found["trailing"] == 0 and len(found["frames"]) == found["table"]["frames"]
    row = ("a" * 65 + "TAG").ljust(190, "b")
    (got,) = media.media_features(spark.createDataFrame([(1, row)], "doc_id long, text string")).collect()
    assert got.payload_sha256 == hashlib.sha256((row + "  ").encode()).hexdigest()
    v1 = b"TAG" + b"Song".ljust(125, b"\0")
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16)
    for tail in (v1, ape, ape + v1):
        r = media.read_stream(media.write_stream(b"q" * 1920, 1900) + tail)
        assert r["trailing"] == len(tail) and r["junk"] == 0 and len(r["frames"]) == 2


def test_junk_takes_no_square_of_its_length():
    began = time.process_time()
    for junk in (b"\xff" * 1_000_000, b"\xff\xfb\x00\xc0" * 250_000, b"\xff\xfb\x00\xc0" + b"\x00\xff" * 500_000, b"ID3" * 300_000):
        assert media.read_stream(junk)["frames"] is not None
    tagged = media.write_stream(*media.payload_of("x" * 4_000_000)) + b"TAG".ljust(128, b"\0")
    r = media.read_stream(tagged)
    assert r["trailing"] == 128 and len(media.read_payload(tagged, r)[0]) >= 4_000_000
    assert time.process_time() - began < 60


def test_seek_offsets_lead_to_frames(spark):
    rows = [(1, "word " * 3000), (2, None)]
    for r in media.media_features(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        made = media.write_stream(*media.payload_of(dict(rows)[r.doc_id]))
        assert all(made[p : p + 2] == b"\xff\xfa" for p in r.seek_offsets) and r.samples == 1152 * len(r.seek_offsets) and r.sample_rate == 32000
