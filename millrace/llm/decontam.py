"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the windows of benchmark items. For windows of m words, a table of two-word blocks tells how
far a search may skip when a block ends at the current place; only where a block ends a test string does the
search look into the bucket of that suffix and compare the words themselves.

Test strings of up to BLOCK_BYTES of item text are broadcast and searched for in the rows as they come, without a shuffle. Of a
larger benchmark only two tables of bounded size are broadcast: the shifts, by a hash of the block (of blocks that share a
place the smaller shift counts, so nothing is passed over), and a filter of the strings' hashes. Cursors go over all texts of
a batch at once, each by its own shifts; what ends a string and passes the filter is written with its words, and the join with the
strings' words decides. So a benchmark of any size takes two scans of the rows, one to search and one to give rows their hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import IS_NOT_ALNUM, LOWER, NOT_ALNUM, U64, chunks, discard, doc_columns, map_batches, merged, mixed, signed, span_hashes, text_bytes, window_starts, word_hashes, written
from ._common import words as word_spans

WINDOW = 10
#: Bytes of item text whose windows are broadcast themselves; windows that begin in a piece of an item.
BLOCK_BYTES, PIECE = 2 << 20, 10_000
#: Places of the table of shifts, and bits of the filter of strings, of one length: eight and sixteen a string, within bounds.
LEAST_TABLE, MOST_SHIFTS, MOST_BITS = 1 << 16, 1 << 27, 1 << 30
#: Words that a cursor goes over.
STRETCH = 512
#: What parts words, in Java's regular expressions.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOLD = bytes(32 if b in NOT_ALNUM and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all that isn't ASCII; null has none."""
    return text.encode().translate(_FOLD).split() if text else []


class WuManber:
    """Search for many strings of words; strings of one length share their tables."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items if item is not None})
        number = {item: k for k, item in enumerate(self.items)}
        strings: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, words in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            m = min(window, len(own))
            for i in range(len(own) - m + 1 if m else 0):
                of = strings.setdefault(m, {}).setdefault(tuple(own[i : i + m]), set())
                if item is not None:  # its windows are searched for, but there is no name to report
                    of.add(number[item])
        self.base = len(self.ids) + 1  # 0 is a word that no string has
        self.tables = [(m, *self._table(m, found)) for m, found in strings.items()]

    def _table(self, m: int, strings: dict[tuple[int, ...], set[int]]) -> tuple[int, dict[int, int], dict[int, list[tuple[tuple[int, ...], set[int]]]]]:
        """Size of a block, shift of each block that occurs, strings by the block that they end with."""
        size = min(2, m)
        shifts: dict[int, int] = {}
        ends: dict[int, list[tuple[tuple[int, ...], set[int]]]] = {}
        for words, items in strings.items():
            for j in range(size - 1, m):
                block = words[j] + (self.base * words[j - 1] if size == 2 else 0)
                shifts[block] = min(shifts.get(block, m), m - 1 - j)
            ends.setdefault(block, []).append((words, items))
        return size, shifts, ends

    def search(self, words: list[bytes]) -> tuple[list[int], list[int], set[int]]:
        """Starts and ends of all occurrences, and the numbers of the items that they belong to."""
        get, base = self.ids.get, self.base
        ids = [get(w, 0) for w in words]
        starts, stops, items = [], [], set()
        for m, size, shifts, ends in self.tables:
            i, n, skip = m - 1, len(ids), m - size + 1
            while i < n:
                block = ids[i] + (base * ids[i - 1] if size == 2 else 0)
                shift = shifts.get(block, skip)
                if shift:
                    i += shift
                    continue
                first = i - m + 1
                for string, of in ends[block]:
                    if ids[first] == string[0] and tuple(ids[first : i + 1]) == string:
                        starts.append(first)
                        stops.append(i + 1)
                        items |= of
                i += 1
        return starts, stops, items


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (string or null) and text of all items with a text, in pieces of PIECE windows at most."""
    items = doc_columns(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct()
    split = items.select("item_id", words(F.col("text")).alias("w"))
    last = F.greatest(F.size("w") - window, F.lit(0))
    part = lambda k: F.array_join(F.slice("w", k * PIECE + 1, PIECE + window - 1), " ")
    return split.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(last / PIECE).cast("int")), part)).alias("text"))


_FOUND = "starts array<int>, ends array<int>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of docs as the struct `row`, with n_words, starts and ends (merged spans of hit words) and items
    (ids, as sorted strings) of what it holds of the benchmark.

    Null and empty texts have no words; null, empty and repeated items are taken once or not at all. An item of
    fewer words than a window is one window. Windows of an item whose id is null hit like others, only items doesn't
    name it. With an empty benchmark nothing is hit; an empty table of documents gives an empty result. Columns of
    docs may have any names.
    """
    spark = docs.sparkSession
    items = pieces(benchmark, window)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("`text`").alias("text")

    if size <= block_bytes:
        table = spark.sparkContext.broadcast(WuManber([(r.item_id, words_of(r.text)) for r in items.toLocalIterator()], window))
        schema = docs.select(row).withColumns({"n_words": F.lit(0).cast("long"), **{c: F.array().cast(t) for c, t in (("starts", "array<int>"), ("ends", "array<int>"), ("items", "array<string>"))}}).schema
        return map_batches(docs.select(row, text), lambda batch: _searched(batch, table), schema)
    digest = F.unhex(F.sha2(F.coalesce(F.col("`text`"), F.lit("")), 256)).alias("digest")
    hits = _looked_up(docs.select(digest, text), items, window)
    out = docs.select(row, digest, F.size(words(F.col("`text`"))).cast("long").alias("n_words")).join(hits, "digest", "left")
    none = {"starts": "array<int>", "ends": "array<int>", "items": "array<string>"}
    return out.select("row", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()])


def _found_in(batch: pa.RecordBatch, table) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[int]], list[list[int]], list[list[str]]]]:
    """Parts of a batch, with the number of words of each text, starts and ends of hit words, and items."""
    found = table.value
    for k in range(0, batch.num_rows, 1000):
        some = batch.slice(k, 1000)
        n, starts, ends, items = [], [], [], []
        for text in some.column("text").to_pylist():
            own = words_of(text)
            a, b, numbers = found.search(own)
            if a:
                x, y = merged(np.array(a, np.int32), np.array(b, np.int32))
                a, b = x.tolist(), y.tolist()
            n.append(len(own)), starts.append(a), ends.append(b), items.append([found.items[i] for i in sorted(numbers)])
        yield some, n, starts, ends, items


def _lists(starts: list, ends: list, items: list) -> list[pa.Array]:
    return [pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]


def _searched(batch: pa.RecordBatch, table) -> Iterator[pa.RecordBatch]:
    for some, n, *found in _found_in(batch, table):
        yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(n, pa.int64()), *_lists(*found)], ["row", "n_words", "starts", "ends", "items"])


# --- a large benchmark ---------------------------------------------------------------------------

def _power(n: int, most: int) -> int:
    return min(most, max(LEAST_TABLE, 1 << max(n - 1, 0).bit_length()))


def _split(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch with the hashes of their words, the texts' offsets in them, a hash of each word and the one before, and
    the words again, one space behind each, with their places there."""
    data, offsets = text_bytes(batch.column("text"))
    for i, j in chunks(offsets):
        low = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, of_text = word_spans(low, offsets[i : j + 1] - offsets[i], IS_NOT_ALNUM)
        h = word_hashes(low, starts, ends)
        places = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        letters = np.ones(places[-1], bool)
        letters[places[1:] - 1] = False
        spaced = np.full(places[-1], 32, np.uint8)
        spaced[letters] = low[~IS_NOT_ALNUM[low]]
        yield batch.slice(i, j - i), h, of_text, mixed(np.append(U64(0), h[:-1])[: len(h)] * U64(0x9FB21C651E98DF25) + h), spaced, places


def _strings(spaced: np.ndarray, places: np.ndarray, starts: np.ndarray, m: int) -> pa.Array:
    """The words of the windows of m words from each of these on."""
    first, sizes = places[starts], places[starts + m] - 1 - places[starts]
    ends = np.cumsum(sizes)
    spots = np.repeat(first - (ends - sizes), sizes) + np.arange(sizes.sum())
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(spaced[spots])).cast(pa.string())


def _windows(of_text: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, starts of the items' windows of m words, their texts)."""
    counts = np.diff(of_text)
    for m in np.unique(np.minimum(counts, window))[:].tolist():
        texts = np.flatnonzero(np.minimum(counts, window) == m)
        if m == window:
            starts = window_starts(of_text, window)
            yield m, starts, np.searchsorted(of_text, starts, side="right") - 1
        elif m:
            yield m, of_text[:-1][texts], texts


def _item_rows(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """(m, h, item, string) of all windows of items; then (m, h, shift) of the blocks in them."""
    names = ["m", "h", "item", "string", "shift"]
    for some, h, of_text, blocks, spaced, places in _split(batch):
        for m, starts, text in _windows(of_text, window):
            columns = (pa.array(np.full(len(starts), m, np.int32)), pa.array(signed(span_hashes(h, starts, starts + m))), some.column("item_id").take(pa.array(text)), _strings(spaced, places, starts, m), pa.nulls(len(starts), pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns), names)
        # a block that ends at the word p of an item is m - 1 - p before the end of the first window that has it, or ends one
        m = np.repeat(np.minimum(np.diff(of_text), window), np.diff(of_text))
        p = np.arange(len(h)) - np.repeat(of_text[:-1], np.diff(of_text))
        real = (p > 0) | (m == 1)
        hashes = np.where(m == 1, mixed(h), blocks)[real]
        n = int(real.sum())
        yield pa.RecordBatch.from_arrays([pa.array(m[real].astype(np.int32)), pa.array(signed(hashes)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(np.maximum(0, m - 1 - p)[real].astype(np.int32))], names)


def _tables(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length of windows: the shifts by place, and the bits of the filter; both of bounded size."""
    out = {}
    counts = {r.m: r["count"] for r in rows.filter("shift is null").groupBy("m").count().collect()}  # `window` rows at most
    for m, n in counts.items():
        shifts, bits = np.full(_power(8 * n, MOST_SHIFTS), m - min(2, m) + 1, np.uint8), np.zeros(_power(16 * n, MOST_BITS) // 8, np.uint8)
        out[m] = (shifts, bits)
        place = F.col("h").bitwiseAND(F.lit(len(shifts) - 1))
        least = rows.filter(f"shift is not null and m = {m}").groupBy(place.alias("at")).agg(F.min("shift").cast("byte").alias("shift"))
        for r in least.groupBy(F.shiftright("at", 16).alias("page")).agg(F.collect_list("at").alias("at"), F.collect_list("shift").alias("shift")).toLocalIterator():  # 65,536 places a page
            shifts[r.at] = r.shift
        spot = F.col("h").bitwiseAND(F.lit(8 * len(bits) - 1)).alias("at")
        pages = rows.filter(f"shift is null and m = {m}").select(spot).groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
        for r in pages.toLocalIterator():
            bits[4096 * r.page : 4096 * (r.page + 1)] = np.frombuffer(r.bits, np.uint8)
    return out


def string_ends(slots: np.ndarray, of_text: np.ndarray, m: int, shifts: np.ndarray) -> np.ndarray:
    """Words at which a block ends that ends a string of m words, in texts of m words or more. slots: of each word's block the
    place in the table of shifts."""
    first, last = of_text[:-1] + m - 1, of_text[1:]
    n = np.maximum(-(-(last - first) // STRETCH), 0)
    at = np.repeat(first, n) + STRETCH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    stop = np.minimum(at + STRETCH, np.repeat(last, n))
    found = []
    while len(at):
        shift = shifts[slots[at]].astype(np.int64)
        found.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _candidates(batch: pa.RecordBatch, tables) -> Iterator[pa.RecordBatch]:
    """(digest, m, start, string) of the windows that end a string's last block and pass the filter."""
    for some, h, of_text, blocks, spaced, places in _split(batch):
        for m, (shifts, bits) in tables.value.items():
            ends = string_ends(((mixed(h) if m == 1 else blocks) & U64(len(shifts) - 1)).astype(np.int64), of_text, m, shifts)
            starts = ends - m + 1
            spot = (span_hashes(h, starts, starts + m) & U64(8 * len(bits) - 1)).astype(np.int64)
            starts = starts[(bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
            if len(starts):
                text = np.searchsorted(of_text, starts, side="right") - 1
                columns = (some.column("digest").take(pa.array(text)), pa.array(np.full(len(starts), m, np.int32)), pa.array((starts - of_text[text]).astype(np.int32)), _strings(spaced, places, starts, m))
                yield pa.RecordBatch.from_arrays(list(columns), ["digest", "m", "start", "string"])


def _looked_up(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """digest, starts, ends (merged spans of hit words) and items of the texts of rows(digest, text) that hold something."""
    strings = written(map_batches(items, lambda b: _item_rows(b, window), "m int, h long, item string, string string, shift int"), "decontamination-strings", free=False)
    tables = rows.sparkSession.sparkContext.broadcast(_tables(strings))
    found = map_batches(rows, lambda b: _candidates(b, tables), "digest binary, m int, start int, string string").distinct()  # of copies one
    found = written(found, "decontamination-found")
    own = strings.filter("shift is null").select("m", "string", "item").distinct()
    real = found.join(own.select("m", "string").distinct(), ["m", "string"], "left_semi")
    spans = map_batches(real.groupBy("digest").agg(F.collect_list(F.struct("start", "m")).alias("found")), _merged, "digest binary, starts array<int>, ends array<int>")
    named = found.select("digest", "m", "string").distinct().join(own.filter("item is not null"), ["m", "string"]).groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = written(spans.join(named, "digest", "left"), "decontamination-hits")
    discard(found)
    discard(strings)
    return hits


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    starts, ends = [], []
    for found in batch.column("found").to_pylist():
        a = np.array([f["start"] for f in found], np.int32)
        a, b = merged(a, a + np.array([f["m"] for f in found], np.int32))
        starts.append(a), ends.append(b)
    return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["digest", "starts", "ends"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; see `scan`."""
    found = scan(doc_columns(docs, "doc_id", "text"), benchmark, window, block_bytes)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with their own columns, that hold no window of the benchmark."""
    found = scan(docs, benchmark, window, block_bytes).filter(F.size("starts") == 0)
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
