"""Byte-level BPE encoding and decoding over Arrow batches, with the tokenizers library.

A rank file (token bytes -> rank) is turned into the library's vocabulary by the byte-to-character table:
each byte is written as one printable character, so a token may end inside a character of the text. Decoding
goes the other way: characters of the tokens -> bytes, joined first, and only then read as UTF-8, so that
characters which are split over tokens come out whole.

Words come again and again, so of an Arrow batch only the units between spaces that a task hasn't met yet go to the
library, many in one string; the tokens' offsets tell which unit each belongs to. Where the pattern or a text doesn't
allow such cuts, the library is given whole texts.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import chunks, doc_columns, map_batches, text_bytes

#: Texts given to the library at once, units in one such text, and bytes of text whose units are looked up at once.
AT_ONCE, UNITS, CHUNK = 64, 256, 1 << 20
#: Distinct units (see `ByteBpe.packed`) whose ids a task keeps, but for those of one chunk.
CACHE = 200_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints in Latin-1, else one from U+0100 on."""
    prints = lambda b: 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b
    others = iter(range(256, 512))
    return [chr(b) if prints(b) else chr(next(others)) for b in range(256)]


class ByteBpe:
    """The library's tokenizer made from a rank file, and the table that decodes."""

    def __init__(self, rank_path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        of_byte = byte_characters()
        written = {token: "".join(of_byte[b] for b in token) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := last_merge(token, rank, ranks)):
                merges.append((written[pair[0]], written[pair[1]]))
        model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=100_000)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        to_byte = {c: b for b, c in enumerate(of_byte)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for characters, i in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = bytes(to_byte[c] for c in characters)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.cuts = cuts_at_spaces(pattern)
        self.units: dict[str, bytes] = {}

    def encode(self, texts: list[str], offsets: bool = False) -> Iterator[tuple[list[int], list[tuple[int, int]] | None]]:
        """Ids of each text and, if asked for, the span of characters that each id lies in."""
        call = self.library.encode_batch if offsets else self.library.encode_batch_fast
        for i in range(0, len(texts), AT_ONCE):
            for x in call(texts[i : i + AT_ONCE], add_special_tokens=False):
                yield x.ids, x.offsets if offsets else None

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u32; each distinct unit is encoded once while it stays in the cache.

        Units are what spaces part, each with the space before it; see `cuts_at_spaces`. A text with a unit that is
        empty, or begins or ends with white space, goes to the library whole, as does the part before the first space.
        """
        parts = [t.split(" ") if self.cuts else [t] for t in texts]
        met = set().union(*(p[1:] for p in parts))
        odd = {u for u in met if not _sound(u)}
        whole = [len(p) > 1 and not (_sound(p[0]) and odd.isdisjoint(p[1:])) for p in parts]
        new = met - odd - self.units.keys()
        if len(self.units) + len(new) > CACHE:
            self.units.clear()
            new = met - odd
        self._learn(sorted(new))
        heads = self.encode([t if w else p[0] for t, p, w in zip(texts, parts, whole, strict=True)])
        out = [np.array(ids, "<u4").tobytes() + (b"" if w else b"".join(map(self.units.__getitem__, p[1:]))) for (ids, _), p, w in zip(heads, parts, whole, strict=True)]
        for u in [u for u in new if len(u) > 64]:
            del self.units[u]
        return out

    def _learn(self, units: list[str]) -> None:
        """Encodes units, many in one text, and deals the ids by the unit that they lie in."""
        groups = [units[i : i + UNITS] for i in range(0, len(units), UNITS)]
        for group, (ids, spans) in zip(groups, self.encode(["".join(" " + u for u in g) for g in groups], offsets=True), strict=True):
            ends = np.cumsum([len(u) + 1 for u in group])
            firsts = np.fromiter((a for a, _ in spans), np.int64, len(spans))
            cut = [0, *np.searchsorted(firsts, ends).tolist()]
            raw = np.array(ids, "<u4").tobytes()
            self.units.update((u, raw[4 * i : 4 * j]) for u, i, j in zip(group, cut, cut[1:], strict=False))

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """The tokens' bytes, read back from the byte table; a character may be split over tokens."""
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        if not sizes.sum():
            return b""
        at = np.repeat(self.places[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.all_bytes[at].tobytes()


def _sound(unit: str) -> bool:
    return bool(unit) and not unit[0].isspace() and not unit[-1].isspace()


#: What the alternatives of a pattern may be, so that it never matches over a lone space (fixed values).
_WORDS = {r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+"}
_BLANKS = {r"\s+(?!\S)", r"\s+"}


def cuts_at_spaces(pattern: str) -> bool:
    """Whether it follows from the pattern that a match begins at each space that stands alone between characters which
    aren't white: then what stands before it, and it with all that follows, match as they do in the whole text.

    It does if every alternative is an apostrophe with letters, an optional space with a run of one class, or white space,
    the three classes hold all that isn't white, and they come before white space. Nothing of it matches a space after
    another character but white space, which the character before isn't; and at the space, the class of the character
    behind it matches before `\\s+` is tried, with the space as its first character.
    """
    parts = pattern.split("|")
    blank = [i for i, p in enumerate(parts) if p in _BLANKS]
    word = [i for i, p in enumerate(parts) if p in _WORDS]
    short = [p for p in parts if re.fullmatch(r"'[a-z]+", p)]
    return len(parts) == len(blank) + len(word) + len(short) and {parts[i] for i in word} == _WORDS and max(word) < min(blank, default=len(parts))


def last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge gives this one, when only lower ranks merge; None if they don't lead to it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
        if not options:
            return None
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1])


@lru_cache(maxsize=2)
def tokenizer(rank_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_path, pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, starts, ends (spans of characters) of every text; a null or empty text has empty arrays."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = list(tokenizer(rank_path, pattern).encode([t or "" for t in rows.column("text").to_pylist()], offsets=True))
        ints = pa.list_(pa.int32())
        spans = [np.array(o, np.int32).reshape(-1, 2) for _, o in found]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([i for i, _ in found], ints), pa.array([s[:, 0] for s in spans], ints), pa.array([s[:, 1] for s in spans], ints)], ["doc_id", "ids", "starts", "ends"])

    return map_batches(doc_columns(docs, "doc_id", "text"), batch, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes, text of every row's ids. Bytes that are no UTF-8 (ids cut inside a character) read as U+FFFD."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        table = tokenizer(rank_path, pattern)
        out = [table.decode(ids or []) for ids in rows.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in out], pa.string())], ["doc_id", "bytes", "text"])

    return map_batches(doc_columns(encoded, "doc_id", "ids"), batch, "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (ids as little-endian u32), decoded_sha256 (decoded bytes).

    Null texts are encoded as empty ones: 0 tokens, and both digests are those of no bytes. Repeated rows and
    null ids stay as they are; doc_id is an integer, other columns are not looked at; an empty table gives an empty result.
    """

    def batch(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = tokenizer(rank_path, pattern)
        _, offsets = text_bytes(rows.column("text"))
        for i, j in chunks(offsets, CHUNK):
            some = rows.slice(i, j - i)
            packed = table.packed([t or "" for t in some.column("text").to_pylist()])
            n = [len(ids) // 4 for ids in packed]
            of_ids = [hashlib.sha256(ids).hexdigest() for ids in packed]
            of_bytes = [hashlib.sha256(table.decode(np.frombuffer(ids, "<u4"))).hexdigest() for ids in packed]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(doc_columns(docs, "doc_id", "text"), batch, columns, after=lambda: tokenizer(rank_path, pattern).units.clear())
