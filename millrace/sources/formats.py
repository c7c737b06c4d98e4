"""Texts of legacy Word files and of PDF files, by the published formats and the standard library alone.

Both readers take what common writers produce: Word 97 and later with its piece table; PDF with plain or Flate streams,
object streams, and fonts that say what their codes mean (ToUnicode) or use the Latin code page. Scanned pages have no text.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

# --- compound files and Word ------------------------------------------------------------------------

_CFB = bytes.fromhex("d0cf11e0a1b11ae1")
_LAST = 0xFFFFFFFA  # sector numbers from here on end a chain


class Compound:
    """The streams of a compound file, by name."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != _CFB:
            raise ValueError("not a compound file")
        self.raw = raw
        self.size, mini = 1 << struct.unpack_from("<H", raw, 0x1E)[0], 1 << struct.unpack_from("<H", raw, 0x20)[0]
        first_dir, self.cutoff, first_mini = struct.unpack_from("<I", raw, 0x30)[0], *struct.unpack_from("<II", raw, 0x38)
        sectors = [s for s in struct.unpack_from("<109I", raw, 0x4C) if s < _LAST]
        more = struct.unpack_from("<I", raw, 0x44)[0]
        seen: set[int] = set()
        while more < _LAST and more not in seen:
            seen.add(more)
            *own, more = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            sectors += [s for s in own if s < _LAST]
        self.fat = [x for s in sectors for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        entries = b"".join(self._chain(first_dir))
        self.entries: dict[str, tuple[int, int]] = {}
        root = (0, 0)
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 0x40)
            start, size = struct.unpack_from("<II", entries, at + 0x74)
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self.entries[entries[at : at + max(length - 2, 0)].decode("utf-16-le", "replace")] = (start, size)
        minis = b"".join(self._chain(first_mini)) if first_mini < _LAST else b""
        self.mini_fat = struct.unpack(f"<{len(minis) // 4}I", minis)
        self.mini_size, self.mini = mini, b"".join(self._chain(root[0]))[: root[1]] if root[1] else b""

    def _sector(self, k: int) -> bytes:
        return self.raw[(k + 1) * self.size : (k + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, k: int) -> Iterator[bytes]:
        for _ in range(len(self.fat)):
            if k >= len(self.fat):
                return
            yield self._sector(k)
            k = self.fat[k]

    def stream(self, name: str) -> bytes:
        start, size = self.entries[name]
        if size >= self.cutoff:
            return b"".join(self._chain(start))[:size]
        out = []
        for _ in range(len(self.mini_fat)):
            if start >= len(self.mini_fat):
                break
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini_fat[start]
        return b"".join(out)[:size]


def doc_text(raw: bytes) -> str:
    """The main text of a Word file: its pieces in order, field codes and control characters left out."""
    file = Compound(raw)
    word = file.stream("WordDocument")
    table = file.stream("1Table" if struct.unpack_from("<H", word, 0x0A)[0] & 0x0200 else "0Table")
    length = struct.unpack_from("<i", word, 0x4C)[0]
    at, size = struct.unpack_from("<II", word, 0x01A2)
    clx, k = table[at : at + size], 0
    while k < len(clx) and clx[k] == 1:  # formatting that pieces share
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    n = (struct.unpack_from("<I", clx, k + 1)[0] - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", clx, k + 5)
    out = []
    for i in range(n):
        where, count = struct.unpack_from("<I", clx, k + 5 + 4 * (n + 1) + 8 * i + 2)[0], places[i + 1] - places[i]
        if where & 0x40000000:
            start = (where & 0x3FFFFFFF) // 2
            out.append(word[start : start + count].decode("cp1252", "replace"))
        else:
            out.append(word[where : where + 2 * count].decode("utf-16-le", "replace"))
    text = re.sub("\x13[^\x13\x14\x15]*\x14?|\x15", "", "".join(out)[:length])
    return re.sub(r"[\x00-\x08\x0e-\x1f]", "", text.replace("\r", "\n").replace("\x0b", "\n").replace("\x07", "\t"))


# --- PDF ------------------------------------------------------------------------------------------

_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s<>\[\]()/%]*|[-+.\d]+|[A-Za-z'\"*]+", re.S)


class Pdf:
    """Objects of a PDF file by number: their text and their stream."""

    def __init__(self, raw: bytes) -> None:
        if not raw.startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        self.objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw, re.S)}
        for body in [b for b in self.objects.values() if b"/ObjStm" in b]:
            data, n, first = self.stream(body), self._number(body, b"N"), self._number(body, b"First")
            heads = list(map(int, data[:first].split()))[: 2 * n]
            ends = [*heads[3::2], len(data) - first]
            for number, start, end in zip(heads[::2], heads[1::2], ends, strict=False):
                self.objects.setdefault(number, data[first + start : first + end])

    @staticmethod
    def _number(body: bytes, key: bytes) -> int:
        found = re.search(rb"/" + key + rb"\s+(\d+)", body)
        return int(found[1]) if found else 0

    def stream(self, body: bytes) -> bytes:
        """Decoded bytes of an object's stream; none if it has no stream, or one that isn't read here."""
        found = _STREAM.search(body)
        if not found:
            return b""
        if b"/FlateDecode" not in body[: found.start()]:
            return b"" if b"/Filter" in body[: found.start()] else found[1]
        return zlib.decompressobj().decompress(found[1])

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """Objects that a key names, one or a list."""
        found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", found[1])] if found else []

    def pages(self) -> Iterator[bytes]:
        """Page objects in order of the tree."""
        roots = [n for n, b in self.objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not self.refs(b, b"Parent")]
        seen: set[int] = set()

        def under(n: int) -> Iterator[bytes]:
            body = self.objects.get(n, b"")
            if n in seen:
                return
            seen.add(n)
            if re.search(rb"/Type\s*/Page\b", body):
                yield body
            for kid in self.refs(body, b"Kids"):
                yield from under(kid)

        for n in roots:
            yield from under(n)

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str] | None]:
        """Name of each font of a page -> text of its codes, or None for Latin ones."""
        body = page
        for _ in range(32):  # resources may stand on a page above
            if b"/Resources" in body or not (up := self.refs(body, b"Parent")):
                break
            body = self.objects.get(up[0], b"")
        for key in (b"Resources", b"Font"):
            body = b"".join([body, *(self.objects.get(n, b"") for n in self.refs(body, key))])
        out: dict[bytes, dict[bytes, str] | None] = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", body):
            font = self.objects.get(int(n), b"")
            if b"/Font" in font:
                maps = self.refs(font, b"ToUnicode")
                out[name] = code_map(self.stream(self.objects.get(maps[0], b""))) if maps else None
        return out


def code_map(data: bytes) -> dict[bytes, str]:
    """Text of the codes in a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for code, value in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(code.decode())] = text(value)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for low, high, one, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            a, b, size = int(low, 16), int(high, 16), len(low) // 2
            values = re.findall(rb"<([0-9A-Fa-f]+)>", several)
            for k in range(min(b - a + 1, 65_536)):
                value = values[k] if k < len(values) else one
                if value:
                    base = text(value)
                    out[(a + k).to_bytes(size, "big")] = base if values else base[:-1] + chr(ord(base[-1]) + k)
    return out


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)


def page_text(content: bytes, fonts: dict[bytes, dict[bytes, str] | None]) -> str:
    """Strings that a page shows, a new line where the text moves to another one."""
    out: list[str] = []
    stack: list[bytes] = []
    font: dict[bytes, str] | None = None

    def shown(raw: bytes) -> str:
        if not font:
            return raw.decode("cp1252", "replace")
        size = max(map(len, font))
        return "".join(font.get(raw[i : i + size], "") for i in range(0, len(raw), size))

    for token in _TOKEN.findall(content):
        if not re.fullmatch(rb"[A-Za-z'\"*]+", token):
            stack.append(token)
            continue
        strings = [t for t in stack if t[:1] in b"(<"]
        if token == b"Tf":
            font = next((fonts.get(t[1:]) for t in stack if t[:1] == b"/"), None)
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out.append("\n" if token in (b"'", b'"') else "")
            for t in stack:
                if t[:1] in b"(<":
                    out.append(shown(_literal(t)))
                elif strings and token == b"TJ" and re.fullmatch(rb"-\d{3,}(\.\d*)?", t):
                    out.append(" ")  # a wide gap between strings of one line
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
        stack = []
    return re.sub(r" *\n[ \n]*", "\n", "".join(out)).strip()


def pdf_text(raw: bytes) -> str:
    """Texts of the pages in order, joined by newlines."""
    file = Pdf(raw)
    return "\n".join(page_text(b"\n".join(file.stream(file.objects.get(n, b"")) for n in file.refs(page, b"Contents")), file.fonts(page)) for page in file.pages())
