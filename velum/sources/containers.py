"""Text in PDF and ZIP containers, read in one pass and in bounded memory, so that no file can fail or stall a job.

Every entry that is asked for is looked at first: one that is encrypted, compressed by an unknown method, there twice,
damaged, or larger than the limit when inflated gives a reason instead of texts. Inflating goes by steps and stops at the
limit, whatever sizes the container claims. A container is packed again by copying the entries that stay as they are,
compressed as they are, so that these may be of any kind.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable

#: Bytes of all texts of a file when inflated.
MOST_INFLATED = 64 << 20
_STEP = 1 << 20
_LOCAL, _CENTRAL, _END = "<4sHHHHHIIIHH", "<4sHHHHHHIIIHHHHHII", "<4sHHHHIIH"
_STORED, _DEFLATED, _ENCRYPTED, _SIZES_LATER, _UTF8 = 0, 8, 0x1, 0x8, 0x800


class Skipped(Exception):
    """Why a file's texts can't be had."""


def _inflate(data: bytes, limit: int, window: int) -> bytes:
    """At most ``limit`` bytes; more are a reason to skip. What is cut off or damaged at the end raises zlib.error."""
    d, out, size = zlib.decompressobj(window), [], 0
    while True:
        part = d.decompress(data, min(_STEP, limit - size + 1))
        out.append(part)
        size += len(part)
        if size > limit:
            raise Skipped("too large when inflated")
        data = d.unconsumed_tail
        if d.eof or not (data or part):
            return b"".join(out)


def _entry(content: bytes, info: zipfile.ZipInfo, limit: int) -> bytes:
    if info.flag_bits & _ENCRYPTED:
        raise Skipped("encrypted entry")
    if info.compress_type not in (_STORED, _DEFLATED):
        raise Skipped("unknown compression")
    raw = _raw(content, info)
    if info.compress_type == _STORED:
        if len(raw) > limit:
            raise Skipped("too large when inflated")
        data = raw
    else:
        data = _inflate(raw, limit, -15)
    if zlib.crc32(data) != info.CRC and info.CRC:  # some writers leave it zero
        raise Skipped("damaged entry")
    return data


def _raw(content: bytes, info: zipfile.ZipInfo) -> bytes:
    """An entry's bytes as they are in the file."""
    at = info.header_offset
    if content[at : at + 4] != b"PK\3\4":
        raise Skipped("damaged entry")
    n_name, n_extra = struct.unpack_from("<HH", content, at + 26)
    start = at + 30 + n_name + n_extra
    raw = content[start : start + info.compress_size]
    if len(raw) < info.compress_size:
        raise Skipped("damaged entry")
    return raw


def _listed(content: bytes) -> list[zipfile.ZipInfo]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.infolist()


def _safely(read: Callable[[], object]) -> object:
    """Whatever a hostile container makes the library raise is a reason too."""
    try:
        return read()
    except zipfile.BadZipFile:
        raise Skipped("not a container") from None
    except (zlib.error, EOFError, OSError, ValueError, OverflowError, RuntimeError, struct.error, IndexError, KeyError):
        raise Skipped("damaged entry") from None


def entries(content: bytes, wanted: Callable[[str], object], limit: int = MOST_INFLATED) -> list[tuple[str, str]]:
    """(name, text) of the entries whose name is wanted, in the container's order; Skipped with the reason if any of them
    can't be had."""

    def read() -> list[tuple[str, str]]:
        out, left = [], limit
        own = [i for i in _listed(content) if wanted(i.filename)]
        if len({i.filename for i in own}) < len(own):
            raise Skipped("doubled name")
        for info in own:
            data = _entry(content, info, left)
            left -= len(data)
            out.append((info.filename, data.decode("utf-8", "replace")))
        return out

    return _safely(read)


def repacked(content: bytes, parts: dict[str, str]) -> bytes:
    """The container with new texts of some entries, which are deflated; all others are copied as they are."""

    def pack() -> bytes:
        out, central = io.BytesIO(), []
        infos = _listed(content)
        for info in infos:
            name = info.orig_filename.encode("utf-8" if info.flag_bits & _UTF8 else "cp437")
            new = parts.get(info.filename)
            if new is None:
                data, method, crc, size = _raw(content, info), info.compress_type, info.CRC, info.file_size
            else:
                plain = new.encode()
                c = zlib.compressobj(6, zlib.DEFLATED, -15)
                data, method, crc, size = c.compress(plain) + c.flush(), _DEFLATED, zlib.crc32(plain), len(plain)
            flags, at, when = info.flag_bits & ~_SIZES_LATER, out.tell(), _when(info)
            extra = b"" if new is not None else _without_sizes(info.extra)
            out.write(struct.pack(_LOCAL, b"PK\3\4", info.extract_version, flags, method, *when, crc, len(data), size, len(name), len(extra)) + name + extra + data)
            central.append(struct.pack(_CENTRAL, b"PK\1\2", info.create_version | info.create_system << 8, info.extract_version, flags, method, *when, crc, len(data), size, len(name), len(extra), len(info.comment), 0, info.internal_attr, info.external_attr, at) + name + extra + info.comment)
        start = out.tell()
        out.write(b"".join(central))
        out.write(struct.pack(_END, b"PK\5\6", 0, 0, len(infos), len(infos), out.tell() - start, start, 0))
        return out.getvalue()

    return _safely(pack)


def _when(info: zipfile.ZipInfo) -> tuple[int, int]:
    y, month, d, h, minute, s = info.date_time
    return h << 11 | minute << 5 | s // 2, max(0, y - 1980) << 9 | month << 5 | d


def _without_sizes(extra: bytes) -> bytes:
    """Extra fields without those of 64-bit sizes: what is copied fits 32 bits, as a column value does."""
    out, at = [], 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind != 1:
            out.append(extra[at : at + 4 + n])
        at += 4 + n
    return b"".join(out)


# --- PDF ------------------------------------------------------------------------------------------------------------

_FILTER = re.compile(rb"/Filter\s*(?:/FlateDecode|\[[^\]]*/FlateDecode[^\]]*\])")
#: Bytes before a stream in which its filter is named.
_BEFORE = 500
_MARK = re.compile(r"[\[\]()]")
_STRING = re.compile(r"([^\\)]*+(?:\\.[^\\)]*+)*+)\)", re.S)
_SHOWN, _LISTED = re.compile(r"\s*(Tj|')"), re.compile(r"\s*TJ")
_ESCAPE = re.compile(r"\\([0-7]{1,3}|.)", re.S)
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", "(": "(", ")": ")"}


def _unescaped(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else _PLAIN.get(m[1], m[0]), s) if "\\" in s else s


def _streams(content: bytes, limit: int) -> list[str]:
    """The streams of a PDF, inflated where the bytes before name that filter."""
    out, left, at = [], limit, 0
    while (here := content.find(b"stream", at)) >= 0:
        start = here + 6
        if content[start : start + 2] == b"\r\n":
            start += 2
        elif content[start : start + 1] == b"\n":
            start += 1
        else:
            at = start
            continue
        end = content.find(b"endstream", start)
        if end < 0:  # nor is there one behind any later beginning
            break
        body = content[start:end]
        if _FILTER.search(content, max(0, here - _BEFORE), here):
            try:
                body = _inflate(body, left, 15)
            except zlib.error:
                pass
        left -= len(body)
        if left < 0:
            raise Skipped("too large when inflated")
        out.append(body.decode("latin-1"))
        at = end + 9
    return out


def _strings(body: str) -> str:
    """The strings that a stream shows: those of Tj, then those of TJ, then those of '. One pass: a string that isn't
    closed leaves none behind it closed, and an array ends at the next bracket."""
    shown: list[str] = []
    listed: list[str] = []
    lines: list[str] = []
    array: list[str] | None = None
    at = 0
    while m := _MARK.search(body, at):
        at, mark = m.end(), m[0]
        if mark == "(":
            string = _STRING.match(body, at)
            if not string:
                break
            at = string.end()
            if array is not None:
                array.append(string[1])
            if how := _SHOWN.match(body, at):
                at = how.end()
                (shown if how[1] == "Tj" else lines).append(string[1])
        elif mark == "[":
            array = []
        elif mark == "]":
            if array is not None and _LISTED.match(body, at):
                listed += array
            array = None
    return "".join([*map(_unescaped, shown), *map(_unescaped, listed), *["\n" + _unescaped(x) for x in lines]])


def pdf_text(content: bytes, limit: int = MOST_INFLATED) -> str:
    """The strings that the text operators of a PDF's streams show, a line a stream. Linear in the file and in what it
    holds; Skipped if that is more than ``limit`` bytes."""
    return _safely(lambda: "\n".join(text for body in _streams(content, limit) if (text := _strings(body))).strip())


__all__ = ["MOST_INFLATED", "Skipped", "entries", "pdf_text", "repacked"]
