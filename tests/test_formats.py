"""Legacy Word and PDF files, made here byte by byte."""

from __future__ import annotations

import struct
import zlib

import pytest

from millrace.sources import files, formats


def compound(streams: dict[str, bytes], cutoff: int = 4096) -> bytes:
    """A compound file with its streams in sectors of 512 bytes, or, under the cutoff, in the mini stream."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        first, n = len(sectors), max(1, -(-len(data) // 512))
        for k in range(n):
            sectors.append(data[512 * k : 512 * (k + 1)].ljust(512, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return first

    mini, mini_fat, placed = b"", [], []
    for name, data in streams.items():
        if len(data) < cutoff:
            first, n = len(mini_fat), max(1, -(-len(data) // 64))
            mini_fat += [first + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
            mini += data.ljust(64 * n, b"\0")
            placed.append((name, first, len(data)))
        else:
            placed.append((name, put(data), len(data)))
    root = put(mini) if mini else 0xFFFFFFFE
    entry = lambda name, kind, first, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind)).ljust(0x74, b"\0") + struct.pack("<III", first, size, 0)
    folder = put(b"".join([entry("Root Entry", 5, root, len(mini)), *(entry(n, 2, f, s) for n, f, s in placed)]))
    minis = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff")) if mini_fat else 0xFFFFFFFE
    at = len(sectors)
    table = struct.pack("<128I", *(fat + [0xFFFFFFFD]).__add__([0xFFFFFFFF] * (127 - len(fat))))
    head = formats._CFB.ljust(0x1E, b"\0") + struct.pack("<HH", 9, 6)
    head = head.ljust(0x2C, b"\0") + struct.pack("<II", 1, folder)
    head = head.ljust(0x38, b"\0") + struct.pack("<IIIII", cutoff, minis, 1, 0xFFFFFFFE, 0) + struct.pack("<I", at)
    return head.ljust(512, b"\xff") + b"".join(sectors) + table


def word(cutoff: int) -> bytes:
    latin, wide = "Plain caf\xe9\r\x13 HYPERLINK x \x14link\x15\r", "中文 text\x07end\r"
    body = bytearray(0x800)
    struct.pack_into("<H", body, 0x0A, 0x0200)
    struct.pack_into("<i", body, 0x4C, len(latin) + len(wide))
    a, b = len(body), len(body) + len(latin)
    data = bytes(body) + latin.encode("cp1252") + wide.encode("utf-16-le")
    pieces = struct.pack("<III", 0, len(latin), len(latin) + len(wide)) + struct.pack("<HIH", 0, 0x40000000 | 2 * a, 0) + struct.pack("<HIH", 0, b, 0)
    clx = b"\x01" + struct.pack("<H", 3) + b"xyz" + b"\x02" + struct.pack("<I", len(pieces)) + pieces
    data = bytearray(data.ljust(5000, b"\0"))
    struct.pack_into("<II", data, 0x01A2, 7, len(clx))
    return compound({"WordDocument": bytes(data), "1Table": b"\0" * 7 + clx}, cutoff)


@pytest.mark.parametrize("cutoff", [4096, 10, 100_000])
def test_word(cutoff):
    assert formats.doc_text(word(cutoff)) == "Plain café\nlink\n中文 text\tend\n"


def pdf(flate: bool) -> bytes:
    def stream(data: bytes) -> bytes:
        packed = zlib.compress(data) if flate else data
        return b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(packed), b"/Filter /FlateDecode " if flate else b"", packed)

    cmap = b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <6587> <0010> <0011> [<0061> <00620063>] endbfrange"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>",
        b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>",
        b"<< /Type /Font /Subtype /Type1 >>",
        b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>",
        stream(b"BT /F2 9 Tf 1 0 0 1 5 5 Tm <0001000200030010> Tj <0011> Tj ET"),
        stream(rb"BT /F1 12 Tf 10 10 Td (Hello \(caf\351\)) Tj 0 -14 Td [(two) -500 (wor) 20 (ds)] TJ (next) ' ET"),
        stream(cmap),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"


@pytest.mark.parametrize("flate", [False, True])
def test_pdf(flate):
    assert formats.pdf_text(pdf(flate)) == "Hello (café)\ntwo words\nnext\n中文斈abc"


def test_files(spark, tmp_path):
    for name, content in (("a.pdf", pdf(True)), ("b.doc", word(4096)), ("c.pdf", b"%PDF-1.4 cut"), ("d.doc", b"\xd0\xcf\x11\xe0 cut")):
        (tmp_path / name).write_bytes(content)
    got = {r.source: r.text for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].startswith("Hello") and got["b.doc"].startswith("Plain café") and got["c.pdf"] == got["d.doc"] == ""
