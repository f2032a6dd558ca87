"""MPEG audio as a media column: write lossless payloads as frames, and read any MPEG audio stream.

Reading resynchronises on frame headers over junk, steps over ID3v2, ID3v1, APEv2 and Lyrics3 tags, reads Xing, Info
and VBRI tables, verifies the CRC-16 of protected frames (layers I, II and III), and gives the exact duration as
samples over sample rate and the byte offset of every frame.

Writing: MPEG-1 Layer III, mono, 32 kHz, protected. The side information is all zero (silence), so that the main data
of a frame is free; each frame carries 192-byte blocks of the payload there: seven at 320 kbit/s, and the last frame
has the bit rate that fits what is left. An ID3v2 tag holds the payload's own length; a Xing table holds the number of
frames, of bytes and a table of contents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import narrow, prepare

BLOCK = 192

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1 or 2, layer), sample rates by version bits.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Bits of a layer II allocation by subband, as (bits, subbands): tables B.2a to B.2d and the one for low rates.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        r = n << 8
        for _ in range(8):
            r = (r << 1 ^ 0x8005) & 0xFFFF if r & 0x8000 else r << 1
        out.append(r)
    return out


_CRC = _crc_table()


def crc16(data: bytes, bits: int) -> int:
    """The CRC of a frame over the first ``bits`` bits, whole bytes first."""
    r = 0xFFFF
    for x in data[: bits >> 3]:
        r = (r << 8 & 0xFFFF) ^ _CRC[r >> 8 ^ x]
    for k in range(bits & 7):
        bit = data[bits >> 3] >> 7 - k & 1
        r = (r << 1 & 0xFFFF) ^ (0x8005 if (r >> 15) ^ bit else 0)
    return r


class Header:
    """A frame header; ``size`` is 0 for the free format."""

    __slots__ = ("channels", "kbps", "key", "layer", "lsf", "mode", "mode_ext", "padding", "protected", "rate", "samples", "side", "size", "version")

    def __init__(self, raw: bytes):
        if raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
            raise ValueError("no sync")
        version, layer, index, rate = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
        if version == 1 or layer == 4 or index == 15 or rate == 3 or raw[3] & 3 == 2:
            raise ValueError("reserved value")
        self.version, self.layer, self.lsf = version, layer, version != 3
        self.protected = not raw[1] & 1
        self.rate, self.kbps = RATES[version][rate], KBPS[2 if self.lsf else 1, layer][index]
        self.padding, self.mode, self.mode_ext = raw[2] >> 1 & 1, raw[3] >> 6, raw[3] >> 4 & 3
        self.channels = 1 if self.mode == 3 else 2
        self.samples = 384 if layer == 1 else 576 if layer == 3 and self.lsf else 1152
        self.side = (9 if self.lsf else 17) if self.channels == 1 else (17 if self.lsf else 32)
        self.key = (version, layer, rate)
        self.size = self._size(self.kbps * 1000) if index else 0

    def _size(self, bps: int) -> int:
        if self.layer == 1:
            return (12 * bps // self.rate + self.padding) * 4
        return self.samples // 8 * bps // self.rate + self.padding

    def checked_bits(self, body: bytes) -> int | None:
        """Bits after the CRC that it covers; None if the frame is too short for them."""
        bound = 4 * (self.mode_ext + 1) if self.mode == 1 else 32
        if self.layer == 3:
            bits = 8 * self.side
        elif self.layer == 1:
            bits = 4 * (self.channels * min(bound, 32) + (32 - min(bound, 32)))
        else:
            per = self.kbps // self.channels
            table = "low" if self.lsf else ("d" if self.rate == 32000 else "c") if self.kbps and per <= 48 else "a" if self.rate == 48000 or self.kbps and per <= 80 else "b"
            widths = [w for w, n in ALLOCATION[table] for _ in range(n)]
            at, used = 0, 0
            for band, w in enumerate(widths):
                copies = self.channels if band < bound else 1
                for _ in range(copies):
                    if at + w > 8 * len(body):
                        return None
                    value = int.from_bytes(body[at >> 3 : (at + w + 7) >> 3], "big") >> -(at + w) % 8 & (1 << w) - 1
                    used += 2 * bool(value) * (1 if copies == self.channels else self.channels)
                    at += w
            bits = at + used
        return bits if bits <= 8 * len(body) else None


def header(raw: bytes, known: dict[bytes, Header | None]) -> Header | None:
    """The header in four bytes, or None. The bits that say only private, copyright and original don't matter."""
    if raw not in known:
        try:
            known[raw] = Header(raw) if len(raw) == 4 else None
        except ValueError:
            known[raw] = None
    return known[raw]


def _tag_end(buf: bytes, pos: int) -> int:
    """Where an ID3v2 or APEv2 tag that begins at ``pos`` ends; ``pos`` if there is none."""
    if buf[pos : pos + 3] == b"ID3" and len(buf) >= pos + 10 and max(buf[pos + 6 : pos + 10]) < 128:
        size = 0
        for x in buf[pos + 6 : pos + 10]:
            size = size << 7 | x
        return min(len(buf), pos + 10 + size + 10 * bool(buf[pos + 5] & 16))
    if buf[pos : pos + 8] == b"APETAGEX" and len(buf) >= pos + 32:
        return min(len(buf), pos + 32 + int.from_bytes(buf[pos + 12 : pos + 16], "little"))
    return pos


def _id3v2_texts(tag: bytes) -> dict[str, str]:
    """The text frames of an ID3v2.3 or 2.4 tag; TXXX by its description."""
    out, pos, wide = {}, 10, tag[3] >= 4
    while pos + 10 <= len(tag) and tag[pos : pos + 1].isalnum():
        name, raw = tag[pos : pos + 4].decode("latin-1"), tag[pos + 4 : pos + 8]
        size = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if wide else int.from_bytes(raw, "big")
        body = tag[pos + 10 : pos + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            parts = text.rstrip("\0").split("\0")
            out[parts[0] if name == "TXXX" and len(parts) > 1 else name] = parts[-1]
        pos += 10 + size
    return out


def _tables(frame: bytes, h: Header) -> dict | None:
    """The Xing, Info or VBRI table of a first frame."""
    for at in (4 + h.side, 6 + h.side):
        kind = frame[at : at + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode(), "frames": None, "bytes": None, "toc": b"", "quality": None}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                out["toc"], at = frame[at : at + 100], at + 100
            if flags & 8:
                out["quality"] = int.from_bytes(frame[at : at + 4], "big")
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n = lambda a, b: int.from_bytes(frame[a:b], "big")
        entries, width = n(54, 56), n(58, 60)
        return {"kind": "VBRI", "frames": n(50, 54), "bytes": n(46, 50), "toc": frame[62 : 62 + entries * width], "quality": n(44, 46)}
    return None


def read_stream(buf: bytes) -> dict:
    """Everything about a stream: tags, table (or None), frames [(offset, header)] without the table's, info_at (offset
    of the table's frame or -1), junk (bytes that belong to nothing), crc_checked, crc_failed.

    A header counts if another of its kind, a tag or the end follows its frame, or if it follows such a frame.
    A trailing tag counts if no frame of the stream spans its begin or goes on from it: else it is a frame's data.
    Truncated last frames and any bytes at all are junk, never an error.
    """
    end, tags = len(buf), {}
    ends, last = [end], [{}]  # where the stream ends without each of the trailing tags, and what these say
    if end >= 128 and buf[end - 128 : end - 125] == b"TAG":
        v1 = buf[end - 128 :]
        end -= 128
        ends.append(end)
        last.append({f"ID3v1.{k}": v1[a:b].split(b"\0")[0].decode("latin-1").rstrip() for k, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97))})
    if end >= 32 and buf[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(buf[end - 20 : end - 16], "little") + (32 if buf[end - 9] & 128 else 0)
        if 0 < size <= end:
            end -= size
            ends.append(end)
            last.append({"APEv2": str(size)})
    if end >= 15 and buf[end - 9 : end] == b"LYRICS200" and buf[end - 15 : end - 9].isdigit():
        size = int(buf[end - 15 : end - 9]) + 15
        if size <= end:
            end -= size
            ends.append(end)
            last.append({"Lyrics3": str(size)})

    def reach(at: int) -> int:
        """The end, after trailing tags that begin before ``at`` turned out to be data."""
        while ends[-1] < at:
            ends.pop()
            last.pop()
        return ends[-1]

    pos, junk, known, frames, table, info_at, locked, free = 0, 0, {}, [], None, -1, None, {}
    ahead = {b"ID3": -1, b"APETAGEX": -1}  # the next place of each, looked for once
    barren: set[tuple[tuple, int]] = set()  # kinds of free format that have no further header before an end
    checked = failed = 0
    sums: dict[tuple[bytes, int], int] = {}
    while pos < end or end < len(buf):
        after = _tag_end(buf, pos)
        if after > end:
            if header(buf[after : after + 4], known):
                end = reach(after)
            else:
                after = max(pos, end)
        if after > pos:
            if buf[pos : pos + 3] == b"ID3":
                tags |= _id3v2_texts(buf[pos:after])
            pos = after
            continue
        h = header(buf[pos : pos + 4], known)
        size = 0
        if h is not None:
            size = h.size or free.get(h.key, 0) and free[h.key] + h.padding
            if not size and (h.key, end) not in barren:  # free format: up to the next header of its kind
                nxt = pos + 24
                while (nxt := buf.find(b"\xff", nxt, end)) >= 0 and not ((g := header(buf[nxt : nxt + 4], known)) and g.key == h.key and not g.size):
                    nxt += 1
                if nxt > 0:
                    size = nxt - pos
                    free[h.key] = size - h.padding
                else:
                    barren.add((h.key, end))
            follows = pos + size
            g = header(buf[follows : follows + 4], known)
            goes_on = g is not None and g.key == h.key
            if not size or follows > len(buf):
                h = None
            elif follows > end:  # a frame over the place where a trailing tag would begin
                if goes_on or locked == h.key and (follows in ends or _tag_end(buf, follows) > follows):
                    end = reach(follows)
                else:
                    h = None
            elif locked != h.key and follows != end and _tag_end(buf, follows) == follows and not goes_on:
                h = None
        if h is None:
            if pos >= end:
                break
            nxt = buf.find(b"\xff", pos + 1, end)
            for mark, place in ahead.items():
                if place <= pos:
                    ahead[mark] = at if (at := buf.find(mark, pos + 1)) >= 0 else len(buf)
            nxt = min(nxt if nxt >= 0 else end, *ahead.values(), end)
            junk, pos, locked = junk + nxt - pos, nxt, None
            continue
        locked = h.key
        frame = buf[pos : pos + size]
        if h.protected:
            bits = h.checked_bits(frame[6:])
            if bits is not None:
                span = (frame[2:4] + frame[6 : 6 + (bits + 7) // 8], bits + 16)
                if span not in sums:
                    sums[span] = crc16(*span)
                checked += 1
                failed += sums[span] != int.from_bytes(frame[4:6], "big")
        if not frames and table is None and (found := _tables(frame, h) if h.layer == 3 else None):
            table, info_at = found, pos
        else:
            frames.append((pos, h))
        pos += size
    for said in last:
        tags = said | tags
    return {"tags": tags, "table": table, "frames": frames, "info_at": info_at, "junk": junk, "trailing": len(buf) - end, "crc_checked": checked, "crc_failed": failed}


def duration(frames: list[tuple[int, Header]]) -> list[tuple[int, int]]:
    """Exact: (sample rate, samples) for each rate that occurs, in ascending order."""
    out: dict[int, int] = {}
    for _, h in frames:
        out[h.rate] = out.get(h.rate, 0) + h.samples
    return sorted(out.items())


_SIDE = bytes(17)
_MONO_32K = 2 << 2


def _frame_kinds() -> dict[int, tuple[bytes, int]]:
    """For one to seven blocks: header with CRC and side information, and the size of the smallest frame."""
    out = {}
    for blocks in range(1, 8):
        for index in range(1, 15):
            size = 144 * KBPS[1, 3][index] * 1000 // 32000
            if size >= 23 + BLOCK * blocks:
                raw = bytes((0xFF, 0xFA, index << 4 | _MONO_32K, 0xC0))
                out[blocks] = raw + crc16(raw[2:] + _SIDE, 152).to_bytes(2, "big") + _SIDE, size
                break
    return out


_KINDS = _frame_kinds()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of 192 bytes, and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK), len(raw)


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    """A stream that carries ``payload``, whose length is a positive multiple of 192."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload's length has to be a positive multiple of 192")
    parts, offsets, at = [], [], 0
    for k in range(0, len(payload), 7 * BLOCK):
        data = payload[k : k + 7 * BLOCK]
        head, size = _KINDS[len(data) // BLOCK]
        parts.append((head + data).ljust(size, b"\0"))
        offsets.append(at)
        at += size
    total = at + 144
    toc = bytes(min(255, (144 + offsets[len(offsets) * p // 100]) * 256 // total) for p in range(100))
    xing = bytes((0xFF, 0xFB, 1 << 4 | _MONO_32K, 0xC0)) + _SIDE + b"Xing" + (7).to_bytes(4, "big") + len(parts).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    body = b"\0n_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + len(body).to_bytes(4, "big") + b"\0\0" + body
    size = bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\x03\0\0" + size + tag + xing.ljust(144, b"\0") + b"".join(parts)


def read_payload(buf: bytes, found: dict) -> tuple[bytes, int]:
    """The payload that write_stream() put into a stream, and its length without padding."""
    out = []
    for pos, h in found["frames"]:
        out.append(buf[pos + 23 : pos + 23 + (h.size - 23) // BLOCK * BLOCK])
    n = int(found["tags"]["n_bytes"])  # the last frame can have room for more blocks than it got
    return b"".join(out)[: max(1, -(-n // BLOCK)) * BLOCK], n


def to_media(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The media column of a text column; null as empty."""
    for batch in batches:
        yield pa.array([write_stream(*payload_of(t)) for t in batch.to_pylist()], pa.binary())


INFO = "struct<frames:long,samples:long,sample_rate:int,seconds:double,table_kind:string,table_frames:long,table_bytes:long,crc_checked:long,crc_failed:long,junk_bytes:long,tag_bytes:long,seek:array<long>,durations:array<struct<sample_rate:int,samples:long>>>"


def media_info(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What a media column holds: exact durations by sample rate (samples and sample_rate for the only rate, else
    null), the table's figures, CRC results, and the offset of every frame. Null and empty media: zeros."""
    kind = pa.struct([*((n, pa.int64()) for n in ("frames", "samples")), ("sample_rate", pa.int32()), ("seconds", pa.float64()), ("table_kind", pa.string()), *((n, pa.int64()) for n in ("table_frames", "table_bytes", "crc_checked", "crc_failed", "junk_bytes", "tag_bytes")), ("seek", pa.list_(pa.int64())), ("durations", pa.list_(pa.struct([("sample_rate", pa.int32()), ("samples", pa.int64())])))])
    for batch in batches:
        rows = []
        for buf in batch.to_pylist():
            r = read_stream(buf or b"")
            times, table = duration(r["frames"]), r["table"] or {}
            only = times[0] if len(times) == 1 else (None, None if times else 0)
            audio = sum(h.size for _, h in r["frames"])
            rows.append({"frames": len(r["frames"]), "samples": only[1], "sample_rate": only[0], "seconds": sum(s / rate for rate, s in times), "table_kind": table.get("kind"), "table_frames": table.get("frames"), "table_bytes": table.get("bytes"), "crc_checked": r["crc_checked"], "crc_failed": r["crc_failed"], "junk_bytes": r["junk"], "tag_bytes": len(buf or b"") - r["junk"] - audio, "seek": [p for p, _ in r["frames"]], "durations": [{"sample_rate": a, "samples": b} for a, b in times]})
        yield pa.array(rows, kind)


_STORED = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("samples", pa.int64()), ("sample_rate", pa.int32()), ("seek_offsets", pa.list_(pa.int64()))]


STORED = "struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string,samples:long,sample_rate:int,seek_offsets:array<long>>"


def stored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Figures of media that to_media() wrote, from the stored bytes alone."""
    for batch in batches:
        rows = []
        for buf in batch.to_pylist():
            r = read_stream(buf)
            payload, n = read_payload(buf, r)
            ((rate, samples),) = duration(r["frames"])
            offsets = [p for p, _ in r["frames"]]
            seek = zlib.crc32(b"".join(p.to_bytes(8, "little") for p in offsets))
            feature = f"mpeg1-layer3 mono frames={len(offsets)} duration={samples}/{rate} {r['table']['kind']}={r['table']['frames']}/{r['table']['bytes']} crc={r['crc_checked'] - r['crc_failed']}/{r['crc_checked']} junk={r['junk']} seek_first={offsets[0]} seek_last={offsets[-1]} seek_crc32={seek:08x}"
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(buf), hashlib.sha256(buf).hexdigest(), feature, samples, rate, offsets))
        yield pa.StructArray.from_arrays([pa.array([x[k] for x in rows], t) for k, (_, t) in enumerate(_STORED)], names=[n for n, _ in _STORED])


def with_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` with its texts stored in a media column too. Repeated rows get equal media; null is stored as empty; an
    empty table gives none. A column of that name is replaced: name another one to keep it."""
    prepare(docs.sparkSession)
    return docs.withColumn(media_col, F.arrow_udf(to_media, "binary")(F.col(text_col)))


def with_info(media: DataFrame, media_col: str = "media", info_col: str = "info") -> DataFrame:
    """``media`` with what its media column holds. Repeated rows get equal values, null counts as empty, an empty table
    gives none. A column of that name is replaced: name another one to keep it."""
    prepare(media.sparkSession)
    return media.withColumn(info_col, F.arrow_udf(media_info, INFO)(F.col(media_col)))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (frames, exact duration, table, CRC results and seek offsets as one string), samples and
    sample_rate (the exact duration), seek_offsets (of every frame). Null texts are stored as empty ones; equal texts give equal values; an empty table gives none."""
    with_bytes = with_media(narrow(docs, doc_id=id_col, text=text_col), media_col="media").select("doc_id", "media")
    return with_bytes.select("doc_id", F.arrow_udf(stored, STORED)("media").alias("s")).select("doc_id", *[f"s.{n}" for n, _ in _STORED])
