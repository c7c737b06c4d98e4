"""Phrase collocations: counts of word n-grams from suffix arrays per shard, merged by key, and their scores.

A shard is a few megabytes of text inside one task. Its words become ids, and its suffixes are sorted by numpy prefix
doubling; neighbours in that order with n words in common form the LCP intervals, whose sizes count the n-grams of the shard.

1. Pairs of words: each shard's counts of pairs, as hashes, are summed by key. Only what a pair falls short of `least`
   for matters here, so hashes do: two pairs of one hash are both let through at worst.
2. A phrase can be frequent only if all its pairs are. Between pairs that aren't, pieces are cut; a suffix array over what is
   left counts the phrases of up to `longest` words, and the shards' counts are summed by the phrase itself, exactly.
3. Candidates are cut after each word, and their parts' counts joined to them; scores are exact decimals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, U64, chunks, discard, doc_columns, mapped, mixed, separators, signed, text_bytes, word_hashes, words, written

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text in a shard; longer texts are cut at ends of pieces.
SHARD = 4 << 20
#: Bits of the filter of frequent pairs (its only purpose is to save work), least and most: 16 a pair.
FILTER_BITS, MOST_FILTER_BITS = 1 << 23, 1 << 30
ENDS_PIECE = separators(b".,;:!?" + bytes(range(0x0A, 0x0E)))
ENDS_WORD = ENDS_PIECE | separators(b" \t")


# --- shards --------------------------------------------------------------------------------------

class Shard:
    """Words of some texts of one language, in order: ids, and where pieces begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seed: np.uint64) -> None:
        data = LOWER[data]
        starts, ends, of_text = words(data, offsets, ENDS_WORD)
        sizes = ends - starts
        letters = data[~ENDS_WORD[data]]
        in_order = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(letters)])
        coded = in_order.dictionary_encode()
        self.ids, self.known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        known, at = text_bytes(self.known)
        self.hashes = word_hashes(known, at[:-1], at[1:]) + seed
        piece = np.cumsum(ENDS_PIECE[data], dtype=np.int32)[starts]
        self.new = np.ones(len(starts), bool)
        self.new[1:] = piece[1:] != piece[:-1]
        self.new[of_text[:-1][np.diff(of_text) > 0]] = True
        # the words again, one space behind each: a phrase is a slice of it
        self.places = np.concatenate([[0], np.cumsum(sizes + 1)])
        gaps = np.ones(self.places[-1], bool)
        gaps[self.places[1:] - 1] = False
        self.spaced = np.full(len(gaps), 32, np.uint8)
        self.spaced[gaps] = letters

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """A hash of each of these words and the next."""
        return mixed(self.hashes[self.ids[at]] * U64(0x9FB21C651E98DF25) + self.hashes[self.ids[at + 1]])

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The texts of the phrases of n words from each of these words on."""
        starts, sizes = self.places[at], self.places[at + n] - 1 - self.places[at]
        ends = np.cumsum(sizes)
        spots = np.repeat(starts - (ends - sizes), sizes) + np.arange(sizes.sum())
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(self.spaced[spots])).cast(pa.string())


def left_of(new: np.ndarray) -> np.ndarray:
    """How many words there are from each word to the end of its run. new: where runs begin."""
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(new))
    return np.repeat(ends, ends - starts) - np.arange(len(new))


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first words (depth at least; a suffix ends with its run), by prefix doubling, and
    the common words of each with the one before it, `depth` at most."""
    n, rank, known = len(ids), ids, 1
    order = np.argsort(rank) if depth < 2 or not n else rank
    while known < depth and n:
        behind = np.zeros(n, np.int64)  # 0: the run has ended
        more = np.flatnonzero(left > known)
        behind[more] = rank[more + known] + 1
        key = rank * np.int64(n + 1) + behind
        order = np.argsort(key)
        known *= 2
        if known < depth:
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
    lcp = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for k in range(depth):
        a, b = order[live - 1], order[live]
        live, a, b = (x[(left[a] > k) & (left[b] > k)] for x in (live, a, b))
        live = live[ids[a + k] == ids[b + k]]
        lcp[live] = k + 1
    return order, lcp


def intervals(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams: one place of each, and their counts, which are the sizes of the LCP intervals of n words."""
    long = np.flatnonzero(left[order] >= n)
    heads = np.flatnonzero(lcp[long] < n)
    return order[long[heads]], np.diff(np.append(heads, len(long)))


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Shard, str]]:
    """The shards of a task that have words, each of one language, with it."""
    for batch in batches:
        for lang in batch.column("lang").unique():
            data, offsets = text_bytes(batch.column("text").filter(pc.equal(batch.column("lang"), lang)))
            name = lang.as_py()
            seed = U64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest()))
            for i, j in chunks(offsets, most):
                for some, at in _parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], most):
                    if not ENDS_WORD[some].all():
                        yield Shard(some, at, seed), name


def _parts(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Several texts as they are; one long text cut at ends of pieces, so that parts stay under `most` bytes if pieces do."""
    if len(data) <= most:
        yield data, offsets
        return
    ends, lo = np.append(np.flatnonzero(ENDS_PIECE[data]) + 1, len(data)), 0
    while lo < len(data):
        hi = int(ends[max(np.searchsorted(ends, lo + most, side="right") - 1, np.searchsorted(ends, lo, side="right"))])
        yield data[lo:hi], np.array([0, hi - lo])
        lo = hi


def _pair_rows(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """(pair, c): hashes of the shards' pairs of words, and how often they stand there."""
    for shard, _ in _shards(batches, shard_bytes):
        left = left_of(shard.new)
        at, c = intervals(*suffix_array(shard.ids, left, 2), left, 2)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(signed(shard.pairs(at))), pa.array(c)], ["pair", "c"])


def _phrase_rows(batches: Iterator[pa.RecordBatch], longest: int, shard_bytes: int, table: Broadcast) -> Iterator[pa.RecordBatch]:
    """(lang, n, phrase, c): the shards' phrases, from pairs that pass the filter, and how often they stand there; all
    single words; n = 0: all words of a language."""
    bits = table.value
    mask = U64(8 * len(bits) - 1)
    for shard, lang in _shards(batches, shard_bytes):

        def rows(n: int, c: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(np.full(len(c), n, np.int32)), texts, pa.array(c)], ["lang", "n", "phrase", "c"])  # noqa: B023

        yield rows(0, np.array([len(shard.ids)]), pa.array([""]))
        yield rows(1, np.bincount(shard.ids), shard.known.cast(pa.string()))
        spot = (shard.pairs(np.arange(len(shard.ids) - 1)) & mask).astype(np.int64)
        new = shard.new.copy()
        new[1:] |= (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 0
        left = left_of(new)
        several = np.flatnonzero((left > 1) | ~new)  # words of runs of one word can't be in a phrase
        left = left[several]
        order, lcp = suffix_array(shard.ids[several], left, longest)
        for n in range(2, longest + 1):
            at, c = intervals(order, lcp, left, n)
            if len(at):
                yield rows(n, c, shard.phrases(several[at], n))


# --- counts --------------------------------------------------------------------------------------

def _filter(pairs: DataFrame) -> np.ndarray:
    """Bits of a filter of bounded size that all these pairs pass."""
    size = min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (16 * pairs.count()).bit_length()))
    spot = F.col("pair").bitwiseAND(F.lit(size - 1))
    pages = pairs.select(spot.alias("at")).groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    found = np.zeros((size // 32768, 4096), np.uint8)
    for r in pages.toLocalIterator():  # size / 32768 pages of 4 KB at most
        found[r.page] = np.frombuffer(r.bits, np.uint8)
    return found.reshape(-1)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD) -> DataFrame:
    """lang, n, phrase, f: all phrases of 1 to `longest` words that stand at least `least` times in a language, as written
    table (see `_common.written`); n = 0 is the row of all words of a language, whatever their number."""
    rows = doc_columns(docs, "text", "lang").select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    pairs = mapped(rows, lambda b: _pair_rows(b, shard_bytes), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    pairs = written(pairs.select("pair"), "collocations-pairs")
    table = rows.sparkSession.sparkContext.broadcast(_filter(pairs))
    discard(pairs)
    counted = mapped(rows, lambda b: _phrase_rows(b, longest, shard_bytes, table), "lang string, n int, phrase string, c long").groupBy("lang", "n", "phrase").agg(F.sum("c").alias("f"))
    return written(counted.filter((F.col("f") >= least) | (F.col("n") == 0)), "collocations-phrases")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of several words: its lowest-scoring cut, of equal ones the first."""
    several = counts.filter("n > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = several.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    of = lambda name, f: counts.filter("n > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    total = counts.filter("n = 0").select("lang", F.col("f").alias("n"))
    score = F.expr("(cast(a as decimal(17)) * cast(n as decimal(17)) * 1000) div (cast(l as decimal(19)) * cast(r as decimal(19)))")
    whole = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"]).join(total, "lang").withColumn("score", score)
    best = whole.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    return best.select("lang", "phrase", *[F.col(f"cut.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def covered(counts: DataFrame) -> DataFrame:
    """lang, phrase, most: the phrases that lie inside longer ones, and the highest count of those."""
    longer = counts.filter("n > 2").select("lang", "f", "n", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size"))
    inside = longer.select("lang", "f", "size", "w", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("start"))
    return inside.select("lang", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard_bytes: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z), parted into pieces at .,;:!? and line breaks, and pieces into words at spaces and tabs. a: how
    often a phrase stands within pieces, overlaps included, `least` at least; n: all words of the language; l and r: the counts
    of its parts at the cut with the lowest score floor(1000 a n / (l r)), of equal ones the first. Left out is what lies in a
    longer phrase that stands as often. Ranked by score, a (both descending) and the phrase's bytes.

    Null and empty texts have no words; a null language is `und`; repeated rows count as often as they stand; doc_id and other
    columns are not looked at; an empty table gives an empty result. A piece of more than `shard_bytes`
    bytes is worked on as one.
    """
    counts = frequent(docs, least, longest, shard_bytes)
    left = scored(counts).join(covered(counts), ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each of many shares first, so that no task sorts a whole language
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = left.withColumn("rank", F.row_number().over(shares)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
