import io
import random
import re
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from velum.sources import documents
from velum.sources.containers import Skipped, entries, pdf_text, repacked

WORD = "word/document.xml"


def office(parts, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n, x in parts:
            z.writestr(n, x)
    return out.getvalue()


def patched(content, name, field, value, everywhere=True):
    """The container with a field (offset in the central entry, and in the local one) of an entry set."""
    out = bytearray(content)
    for mark, at, where in ((b"PK\1\2", 46, field), (b"PK\3\4", 30, field - 2)):
        k = -1
        while (k := content.find(mark, k + 1)) >= 0:
            if content[k + at : k + at + len(name)] == name.encode() and (everywhere or mark == b"PK\1\2"):
                struct.pack_into("<H" if field in (8, 10) else "<I", out, k + where, value)
    return bytes(out)


GOOD = office([(WORD, "<w:t>acme</w:t>"), ("word/media.bin", bytes(range(256)) * 20)])


def reason(content, limit=1 << 20):
    with pytest.raises(Skipped) as e:
        entries(content, lambda n: n == WORD, limit)
    return str(e.value)


def test_reasons():
    assert entries(GOOD, lambda n: n == WORD) == [(WORD, "<w:t>acme</w:t>")]
    assert reason(patched(GOOD, WORD, 8, 1)) == "encrypted entry"
    assert reason(patched(GOOD, WORD, 10, 97)) == "unknown compression"
    with pytest.warns(UserWarning):
        assert reason(office([(WORD, "a"), (WORD, "b")])) == "doubled name"
    assert reason(office([(WORD, "x" * (1 << 20) + "y")])) == "too large when inflated"
    assert reason(patched(office([(WORD, "x" * (3 << 20))]), WORD, 24, 5)) == "too large when inflated"  # whatever size it claims
    assert reason(office([(WORD, "x" * (1 << 20) + "y")], zipfile.ZIP_STORED)) == "too large when inflated"
    assert reason(patched(GOOD, WORD, 16, 12345)) == "damaged entry"
    assert reason(patched(GOOD, WORD, 42, 1 << 30, False)) in ("damaged entry", "not a container")
    for junk in (b"", b"PK", b"PK\5\6" + b"\xff" * 18, GOOD[:-1], GOOD[60:]):
        assert reason(junk) in ("not a container", "damaged entry")


def test_damaged_files_always_have_a_reason():
    rng = random.Random(3)
    for _ in range(600):
        bad = bytearray(GOOD)
        for _ in range(rng.randrange(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            got = entries(bytes(bad), lambda n: n == WORD)
            assert got in ([], [(WORD, "<w:t>acme</w:t>")]) or len(got) == 1
            repacked(bytes(bad), {WORD: "new"})
        except Skipped as e:
            assert str(e)


def test_what_stays_is_copied_as_it_is():
    odd = patched(office([("word/odd.bin", b"secret" * 9), (WORD, "<w:t>acme</w:t>"), ("word/é.bin", b"e")]), "word/odd.bin", 10, 97)
    new = repacked(odd, {WORD: "<w:t>zeta</w:t>"})
    z = zipfile.ZipFile(io.BytesIO(new))
    assert [i.filename for i in z.infolist()] == ["word/odd.bin", WORD, "word/é.bin"] and z.read(WORD) == b"<w:t>zeta</w:t>" and z.read("word/é.bin") == b"e"
    before, after = (zipfile.ZipFile(io.BytesIO(c)).infolist()[0] for c in (odd, new))
    assert (after.compress_type, after.compress_size, after.CRC, after.date_time) == (97, before.compress_size, before.CRC, before.date_time)
    later = io.BytesIO()
    with zipfile.ZipFile(_Pipe(later), "w", zipfile.ZIP_DEFLATED) as out:  # sizes stand behind the entries
        out.writestr("a.bin", b"a" * 1000)
        out.writestr(WORD, "old")
    again = zipfile.ZipFile(io.BytesIO(repacked(later.getvalue(), {WORD: "new"})))
    assert again.testzip() is None and again.read("a.bin") == b"a" * 1000 and again.read(WORD) == b"new"


class _Pipe(io.RawIOBase):
    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def write(self, b):
        return self.out.write(b)


def by_patterns(body):
    """What good streams show, by patterns that look back."""
    un = lambda s: re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", "(": "(", ")": ")"}.get(m[1], m[0]), s, flags=re.S)
    parts = [un(x) for x in re.findall(r"\(((?:\\.|[^\\)])*)\)\s*Tj", body, re.S)]
    for inner in re.findall(r"\[((?:\((?:\\.|[^\\)])*\)|[^\[\]()])*)\]\s*TJ", body, re.S):
        parts += [un(x) for x in re.findall(r"\(((?:\\.|[^\\)])*)\)", inner, re.S)]
    return "".join(parts + ["\n" + un(x) for x in re.findall(r"\(((?:\\.|[^\\)])*)\)\s*'", body, re.S)])


def test_pdf_text_of_good_streams():
    rng = random.Random(5)
    string = lambda: "(" + "".join(rng.choice(["a", " ", "[", "]", "\\(", "\\)", "\\\\", "\\n", "\\101", "é", "'", "Tj"]) for _ in range(rng.randrange(6))) + ")"
    for _ in range(300):
        parts = [rng.choice([lambda: string() + " Tj", lambda: string() + rng.choice(["", "\n"]) + "'", lambda: "[" + " -5 ".join(string() for _ in range(rng.randrange(4))) + "] TJ", lambda: "1 0 0 1 72 720 Tm", lambda: string() + " x"])() for _ in range(rng.randrange(12))]
        body = "BT " + "\n".join(parts) + " ET"
        for raw in (body.encode("latin-1"), zlib.compress(body.encode("latin-1"))):
            head = b"<< /Filter [ /FlateDecode ] >>\n" if raw[:2] == b"x\x9c" else b""
            assert pdf_text(b"%PDF\n" + head + b"stream\r\n" + raw + b"\nendstream\n") == by_patterns(body).strip()


def test_hostile_pdfs_take_linear_time():
    n = 10_000_000
    for body in (b"(" * n, b"\\(" * (n // 2), b"[" * n, b"[(" * (n // 2), b"() " * (n // 3), b"(a)" + b" " * n):
        began = time.time()
        pdf_text(b"stream\n" + body + b"\nendstream", 1 << 30)
        assert time.time() - began < 12, body[:4]
    for content in (b"stream\n" * (n // 7), b"stream " * (n // 7), b"stream\n(x) Tj endstream " * 200_000, b"/Filter " * (n // 8) + b"stream\nx"):
        began = time.time()
        pdf_text(content, 1 << 30)
        assert time.time() - began < 12, content[:24]
    bomb = zlib.compress(b"(a) Tj " * 4_000_000)
    with pytest.raises(Skipped, match="too large"):
        pdf_text(b"/Filter /FlateDecode stream\n" + bomb + b"\nendstream", 1 << 20)


def test_a_folder_of_all_of_these(spark):
    doubled = GOOD.replace(b"word/media.bin", b"word/footer.xml").replace(b"word/footer.xml", b"word/media.bin")
    files = {
        "good.docx": GOOD, "locked.docx": patched(GOOD, WORD, 8, 1), "odd.docx": patched(GOOD, WORD, 10, 14), "bomb.docx": office([(WORD, "a" * (2 << 20))]), "bad.docx": b"junk",
        "empty.docx": office([("other.xml", "x")]), "scan.pdf": b"%PDF no stream", "a.pdf": b"stream\n(acme) Tj\nendstream", "a.txt": b"acme", "same.txt": b"x", "a.pptx": doubled, "null.txt": None, "null.pdf": None,
    }
    df = spark.createDataFrame([(f"/d/{n}", c) for n, c in files.items()] + [("/d/a.txt", b"acme")], "path string, content binary").withColumn("kind", documents.kind(F.col("path")))
    new = lambda d: d.withColumn("new_text", F.replace("text", F.lit("acme"), F.lit("zeta")))
    got = sorted((r.filename, r.status, r.reason) for r in documents.rewrite(df, new, new, limit=1 << 20).collect())
    assert got == sorted([
        ("good.docx", "rewritten", None), ("locked.docx", "skipped", "encrypted entry"), ("odd.docx", "skipped", "unknown compression"), ("bomb.docx", "skipped", "too large when inflated"),
        ("bad.docx", "skipped", "not a container"), ("empty.docx", "skipped", "no text"), ("scan.pdf", "skipped", "no text"), ("a.txt", "rewritten", None), ("a.txt", "rewritten", None), ("a.txt", "rewritten", None),
        ("same.txt", "unchanged", None), ("a.pptx", "skipped", "unknown type"), ("null.txt", "skipped", "no content"), ("null.pdf", "skipped", "no content"),
    ], key=lambda r: r)
    assert documents.extract(df, 1 << 20).count() == 5 and documents.skipped(df, 1 << 20).count() == 9
