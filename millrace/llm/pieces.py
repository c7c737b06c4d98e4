"""SentencePiece encoding that keeps source offsets, and decoding.

The model file holds a compiled character map: a trie as a double array, and the strings that its keys are replaced by.
`Normaliser` finds the longest key at every character of an Arrow batch's texts (all places walk the array together, a byte a
step) and notes for each byte of the normalised text where in the source its character begins. The library finds the pieces;
their lengths lie end to end in the normalised text, so each piece is projected to the bytes of the source that it came from.

Words come again and again, so a text is cut before spaces and line breaks where the model proves that no piece spans the cut,
and each distinct unit is encoded and decoded by the library once while a task keeps it; else texts go to the library whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import chunks, doc_columns, map_batches, text_bytes

#: Bytes of text that are worked on at once, and distinct units that a task keeps.
CHUNK, CACHE = 1 << 20, 200_000
META = "▁"
META_BYTES = META.encode()
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


def span_places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of these spans, one span after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Normaliser:
    """Longest-prefix normalisation by a model's character map, with the source place of each byte."""

    def __init__(self, spec: dict[int, int | bytes], symbols: list[bytes] = ()) -> None:
        blob = spec.get(2, b"")
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.strings = np.frombuffer(blob[4 + size :], np.uint8)
        self.string_ends = np.flatnonzero(self.strings == 0)
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if self.squeeze and b"  " in blob[4 + size :]:
            raise ValueError("a character map that makes two spaces of one character is not supported")
        self.symbols = sorted(symbols, key=len)

    def longest(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the longest key that begins at each of these places (0: none), and the place of its replacement."""
        sizes, strings = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return sizes, strings
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        live = np.arange(len(starts))
        node = np.full(len(starts), offset(self.units[0]))
        for k in range(int((limits - starts).max(initial=0))):
            more = starts[live] + k < limits[live]
            live, node = live[more], node[more]
            letter = data[starts[live] + k].astype(np.int64)
            node ^= letter
            unit = self.units[node]
            found = unit & ((1 << 31) | 255) == letter
            live, node, unit = live[found], node[found] ^ offset(unit[found]), unit[found]
            if not len(live):
                break
            ends = (unit >> 8) & 1 == 1  # a key ends here
            sizes[live[ends]] = k + 1
            strings[live[ends]] = self.units[node[ends]] & ((1 << 31) - 1)
        return sizes, strings

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the normalised texts, the source place of each, the texts' offsets in them, and the source place of each
        text's end (before the spaces that are taken off there)."""
        starts = np.flatnonzero(data & 0xC0 != 0x80)
        own = np.diff(np.append(starts, len(data)))
        text = np.searchsorted(offsets, starts, side="right") - 1
        sizes, strings = self.longest(data, starts, offsets[text + 1])
        for symbol in self.symbols:  # the longest last; they come before the map and stay as they are
            raw = data.tobytes()
            at = np.searchsorted(starts, np.array([m.start() for m in re.finditer(b"(?=" + re.escape(symbol) + b")", raw)], np.int64))
            at = at[starts[at] + len(symbol) <= offsets[text[at] + 1]]
            sizes[at], strings[at] = len(symbol), -1
        mapped = (sizes > 0) & (strings >= 0)
        sizes = np.where(sizes > 0, sizes, own)
        keep = np.ones(len(starts), bool)
        for i in np.flatnonzero(sizes > own).tolist():  # a key of several characters takes those behind it
            if keep[i]:
                keep[i + 1 : np.searchsorted(starts, starts[i] + sizes[i])] = False
        starts, sizes, text, mapped, strings = (x[keep] for x in (starts, sizes, text, mapped, strings))
        source = data
        if mapped.any():
            sizes[mapped] = self.string_ends[np.searchsorted(self.string_ends, strings[mapped])] - strings[mapped]
            source = np.concatenate([data, self.strings])
        out = source[span_places(np.where(mapped, len(data) + strings, starts), sizes)]
        place, of, ends = np.repeat(starts, sizes), np.repeat(text, sizes), offsets[1:].copy()
        texts = np.flatnonzero(np.diff(offsets) > 0)
        heads = offsets[texts]
        if self.squeeze and len(out):
            blank, new = out == 32, np.append(True, of[1:] != of[:-1])
            left = ~blank | ~new & ~np.append(True, blank[:-1])  # of a run of spaces the first, none in front
            out, place, of = out[left], place[left], of[left]
            texts = np.unique(of)
            solid = np.flatnonzero(~((sizes == 1) & (source[np.where(mapped, len(data) + strings, starts)] == 32)))
            heads = starts[solid[np.searchsorted(text[solid], texts)]]
        if self.prefix:
            at = np.searchsorted(of, texts)
            out, place, of = np.insert(out, at, 32), np.insert(place, at, heads), np.insert(of, at, texts)
        if self.escape:
            blank = out == 32
            wide = np.where(blank, len(META_BYTES), 1)
            spots = (np.cumsum(wide) - wide)[blank]
            out, place, of = (np.repeat(x, wide) for x in (out, place, of))
            for k, byte in enumerate(META_BYTES):
                out[spots + k] = byte
        at = np.searchsorted(of, np.arange(len(offsets)))
        return self._trimmed(out, place, at, ends) if self.squeeze else (out, place, at, ends)

    def _trimmed(self, out: np.ndarray, place: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Without the spaces, as they are written, at the texts' ends."""
        first = np.append(np.flatnonzero(out & 0xC0 != 0x80), len(out))
        padded = np.append(out, np.zeros(len(META_BYTES), np.uint8))
        mark = META_BYTES if self.escape else b" "
        solid = np.flatnonzero(~np.all([padded[first[:-1] + k] == byte for k, byte in enumerate(mark)], axis=0))
        behind = np.append(0, first[solid + 1])[np.searchsorted(first[solid], at[1:])]  # the end of the last other character
        behind = np.maximum(behind, at[:-1])
        cut = behind < at[1:]
        ends[cut] = place[behind[cut]]
        sizes = behind - at[:-1]
        keep = span_places(at[:-1], sizes)
        return out[keep], place[keep], np.append(0, np.cumsum(sizes)), ends


class Pieces:
    """A model with its normaliser, and the units of which a task knows the ids."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = list(message(f.read()))
        pieces = [dict(message(raw)) for k, raw in fields if k == 1]
        kinds = np.array([p.get(3, NORMAL) for p in pieces])
        texts = [p[1] for p in pieces]
        if dict(message(dict(fields).get(2, b""))).get(24):
            raise ValueError("models that write a space behind a word are not supported")
        self.normaliser = Normaliser(dict(message(dict(fields).get(3, b""))), [t for t, k in zip(texts, kinds, strict=True) if k == USER_DEFINED])
        #: Bytes of the normalised text that each piece covers; -1: the unknown piece may cover any.
        self.sizes = np.where(kinds == BYTE, 1, np.where(kinds == UNKNOWN, -1, [len(t) for t in texts]))
        plain = [t.decode() for t, k in zip(texts, kinds, strict=True) if k == NORMAL]
        n = self.normaliser
        #: No piece spans a place before a run of spaces or before a line break, all texts keep their characters, and bytes
        #: stand for what the vocabulary lacks: then units can be encoded alone.
        self.cuts = n.prefix and n.escape and not n.squeeze and not len(n.units) and not n.symbols and (kinds == BYTE).sum() == 256 and not any(re.search(f"[^{META}]{META}", p) or "\n" in p and len(p) > 1 for p in plain)
        self.unit = re.compile(r" +[^ \n]*|\n[^ \n]*")
        self.known: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.head = len(self.sp.encode("\n", num_threads=1))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """Of each text: ids as little-endian u32, ids in decimal with a comma behind each, the decoded text."""
        if not self.cuts:
            ids = self.sp.encode(texts, num_threads=1)
            return [self._packed(i, d) for i, d in zip(ids, self.sp.decode(ids, num_threads=1), strict=True)] if texts else []
        units = [self.unit.findall(" " + t.replace(META, " ")) if t else [] for t in texts]
        met = set().union(*units)
        new = met - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = met
        self._learn(sorted(new))
        out = []
        for own in units:
            a, b, c = zip(*map(self.known.__getitem__, own), strict=True) if own else ((), (), ())
            out.append((b"".join(a), b"".join(b), b"".join(c)[1:]))  # the space put before a text isn't decoded
        for u in [u for u in new if len(u) > 64]:
            del self.known[u]
        return out

    def _learn(self, units: list[str]) -> None:
        """Encodes and decodes units, each behind a line break, from which no piece goes on into it."""
        if units:
            ids = self.sp.encode(["\n" + u for u in units], num_threads=1)
            for u, i, d in zip(units, ids, self.sp.decode(ids, num_threads=1), strict=True):
                self.known[u] = self._packed(i[self.head :], d[1:])

    @staticmethod
    def _packed(ids: list[int], decoded: str) -> tuple[bytes, bytes, bytes]:
        return np.array(ids, "<u4").tobytes(), b"".join(b"%d," % i for i in ids), decoded.encode()

    def spans(self, data: np.ndarray, offsets: np.ndarray, texts: list[str], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all pieces of the texts, in bytes of their own text."""
        out, place, at, ends = self.normaliser(data, offsets)
        every = np.concatenate([np.zeros(0, "<u4"), *ids])
        n = np.array([len(i) for i in ids], np.int64)
        sizes = self.sizes[every]
        if (sizes < 0).any():
            sizes = sizes.copy()
            of = np.repeat(np.arange(len(n)), n)
            for t in np.unique(of[sizes < 0]).tolist():
                own = of == t
                sizes[own] = np.where(sizes[own] < 0, [len(p.encode()) for p in self.sp.encode(texts[t], out_type=str, num_threads=1)], sizes[own])
        last = np.cumsum(sizes)
        of = np.repeat(np.arange(len(n)), n)
        if not np.array_equal(np.append(0, last)[np.append(0, np.cumsum(n))], at):
            raise ValueError("pieces don't cover the normalised text")
        places = np.append(place, 0)
        starts = places[last - sizes]
        done = last == at[1:][of]  # nothing of the text is behind the piece
        return starts - offsets[of], np.where(done, ends[of], places[last]) - offsets[of]


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    return Pieces(path)


def _batches(rows: pa.RecordBatch, path: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, bytes, bytes]], np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows with what `Pieces.encode` gives, the texts' offsets in their pieces, and the pieces' spans."""
    data, offsets = text_bytes(rows.column("text"))
    for i, j in chunks(offsets, CHUNK):
        some = rows.slice(i, j - i)
        texts = [t or "" for t in some.column("text").to_pylist()]
        found = model(path).encode(texts)
        ids = [np.frombuffer(f[0], "<u4") for f in found]
        starts, ends = model(path).spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], texts, ids)
        yield some, found, np.concatenate([[0], np.cumsum([len(x) for x in ids])]), starts, ends


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, starts, ends of every text: of each piece the span of the source's UTF-8 bytes that it was made from. Pieces
    that one character was replaced by share its start; a null or empty text has empty arrays."""

    def batch(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some, found, at, starts, ends in _batches(rows, path):
            lists = [pa.LargeListArray.from_arrays(at, pa.array(x)) for x in (np.frombuffer(b"".join(f[0] for f in found), "<i4"), starts, ends)]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(x.cast(pa.list_(t)) for x, t in zip(lists, (pa.int32(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "ids", "starts", "ends"])

    return map_batches(doc_columns(docs, "doc_id", "text"), batch, "doc_id long, ids array<int>, starts array<long>, ends array<long>", after=lambda: model(path).known.clear())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row's ids, as the library decodes them; null ids as none."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = model(path).sp.decode([ids or [] for ids in rows.column("ids").to_pylist()], num_threads=1)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(doc_columns(encoded, "doc_id", "ids"), batch, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the decoded text),
    spans_sha256 (start and end of each piece in the source, as little-endian 64-bit integers).

    Null texts are encoded as empty ones: 0 tokens, all digests are those of no bytes. Repeated rows and null ids stay as they
    are; doc_id is an integer, other columns are not looked at; an empty table gives an empty result.
    """

    def batch(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some, found, at, starts, ends in _batches(rows, path):
            raw = memoryview(np.stack([starts, ends], axis=1).astype("<i8").tobytes())
            cuts = (16 * at).tolist()
            hexes = [[hashlib.sha256(x).hexdigest() for x in part] for part in ([f[1][:-1] for f in found], [f[2] for f in found], [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)])]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.diff(at)), *(pa.array(h, pa.string()) for h in hexes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return map_batches(doc_columns(docs, "doc_id", "text"), batch, columns, after=lambda: model(path).known.clear())
