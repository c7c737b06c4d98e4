"""N-gram Jaccard join by prefix filters under several global token orders.

A document's tokens are its distinct shingles of five words. Under any one order of all tokens, two documents with a
Jaccard similarity of `percent` or more share a token among the first n - ceil(percent n / 100) + 1 of each (n: a
document's tokens). Candidates must do so under every one of three orders:

1. ascending corpus frequency (estimated by a sketch of fixed size, which only orders): the candidates are joined
   on these prefix tokens, where frequent tokens come last;
2. a hash order: candidates' prefixes under it are joined to them and must overlap, before any text is moved;
3. another hash order, compared when the texts are there, before the exact intersection.

Texts of equal words (by a 128-bit digest of the words themselves) fold into one node first. Tokens are 64-bit hashes that mix
every byte under a key drawn for each run; a link between nodes counts only after the shingles' words themselves have been
compared. The candidates of a token are compared with one pivot (its smallest node) only, linked ones become one component, and what is left to compare are pairs of different
components in a common token, as far as that token can be the first that a similar pair has in common. So a large group of
near copies isn't expanded into pairs, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import IS_WHITE, LOWER, U64, chunks, discard, map_batches, mapped, mixed, signed, text_bytes, word_hashes, words, written
from ._repeats import without_copies

SHINGLE, PERCENT = 5, 80
#: Counters of the frequency sketch (its only purpose is the first order of tokens), least and most: one for four texts.
COUNTERS, MOST_COUNTERS = 1 << 18, 1 << 22
#: A null id is taken for this one, so that it compares as the smallest.
NO_ID = -(1 << 63) + 1
_FOLD = LOWER.tobytes()
_ORDERS = (U64(0x8CB92BA72F3D8DD7), U64(0xC6A4A7935BD1E995))


# --- shingles ------------------------------------------------------------------------------------

def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles (sorted within the text), and the texts' offsets in them."""
    data = LOWER[data]
    return _shingles(data, *words(data, offsets, IS_WHITE), n, key)


def _shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_text: np.ndarray, n: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    h = word_hashes(data, starts, ends, key)
    counts = np.diff(of_text)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), sizes)
    first = np.repeat(of_text[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    grams = mixed(h[first] + U64(0x51ED270B7A1F1E25))
    left = of_text[1:][text] - first  # words from the first on
    for k in range(1, n):
        more = left > k
        grams = np.where(more, mixed(grams ^ h[np.minimum(first + k, len(h) - 1)]), grams) if len(h) else grams
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(counts) + 1))


def shingle_set(text: str, n: int = SHINGLE) -> set[bytes]:
    """The distinct shingles themselves."""
    own = text.encode().translate(_FOLD).split()
    return {b" ".join(own[i : i + n]) for i in range(max(len(own) - n + 1, min(len(own), 1)))}


def prefix_size(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Tokens of which two similar sets share one, whatever the order; 0 of an empty set."""
    return (n - (percent * n + 99) // 100 + 1) * (n > 0)


def least_overlap(n: int, m: int, percent: int) -> int:
    """Common tokens that make sets of n and m tokens similar."""
    return -(-percent * (n + m) // (100 + percent))


def _texts(batch: pa.RecordBatch, n: int, key: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with the shingles of their texts, these texts' offsets in them, and the marks of the texts' words."""
    data, offsets = text_bytes(batch.column("text"))
    for i, j in chunks(offsets):
        low = LOWER[data[offsets[i] : offsets[j]]]
        found = words(low, offsets[i : j + 1] - offsets[i], IS_WHITE)
        yield slice(i, j), *_shingles(low, *found, n, key), _marks(low, *found)


def _marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """128 bits, as two numbers, that identify each text's words: a digest of the words themselves."""
    sizes = ends - starts + 1
    places = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.full(places[-1], 32, np.uint8)
    letters = np.ones(len(joined), bool)
    letters[places[1:] - 1] = False
    joined[letters] = data[~IS_WHITE[data]]
    raw, cuts = memoryview(joined), places[of_text].tolist()
    digests = b"".join(hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(cuts, cuts[1:], strict=False))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def sized(n: int, least: int, most: int) -> int:
    """The power of two from n on, between two others."""
    return min(most, max(least, 1 << max(n - 1, 0).bit_length()))


def _sketch(every: DataFrame, size: int) -> np.ndarray:
    """How many shingles (one a text) fall on each counter, summed up from the rows that `_set_rows` adds for it."""
    parts = every.filter("counters is not null").select(F.explode(F.arrays_zip("counters", "counts")).alias("c"))
    out = np.zeros(size, np.int64)
    for r in parts.groupBy(F.col("c.counters").alias("counter")).agg(F.sum("c.counts").alias("n")).toPandas().itertuples():  # MOST_COUNTERS rows at most
        out[r.counter] = r.n
    return out


#: Bits of the filter that keeps texts which no candidate needs from being moved (its only purpose), least and most: eight an id.
FILTER_BITS, MOST_FILTER_BITS = 1 << 23, 1 << 28


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows(did, sig, text), most of those left out whose did isn't among ids(id): a filter of bounded size, without shuffle."""
    size = sized(8 * ids.count(), FILTER_BITS, MOST_FILTER_BITS)
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bits = ids.select(spot("id").alias("at")).groupBy((F.col("at") / 32768).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    found = np.zeros((size // 32768, 4096), np.uint8)
    for r in bits.toLocalIterator():  # size / 32768 pages of 4 KB at most
        found[r.page] = np.frombuffer(r.bits, np.uint8)
    table = rows.sparkSession.sparkContext.broadcast(found.reshape(-1))

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        at = part.column("at").to_numpy()
        keep = pa.array((table.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)
        return pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("did", "sig", "text")], ["did", "sig", "text"])

    return map_batches(rows.select("did", "sig", "text", spot("did").alias("at")), batch, "did long, sig long, text string")


# --- components ----------------------------------------------------------------------------------

def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) reaches, by large-star and small-star steps."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), name, free=False)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.written_to = edges.written_to
            return out
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(low, "u")
        small = joined.filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).distinct()
        after = written(small, name, free=False)
        discard(edges)
        edges = after


# --- the join ------------------------------------------------------------------------------------

def _prefix_rows(batch: pa.RecordBatch, n: int, percent: int, key: int, counts) -> Iterator[pa.RecordBatch]:
    """(t, same, n, pos) of the tokens in each text's prefix under the first order; same: the first mark of its words."""
    for _, grams, at, marks in _texts(without_copies(batch), n, key):
        sizes = np.diff(at)
        text = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((mixed(grams), counts.value[(grams & U64(len(counts.value) - 1)).astype(np.int64)], text))
        pos = np.arange(len(grams)) - np.repeat(at[:-1], sizes)
        keep = pos < np.repeat(prefix_size(sizes, percent), sizes)
        t, text, pos = grams[order][keep], text[keep], pos[keep]
        columns = (signed(t), marks[text, 0], sizes[text].astype(np.int32), pos.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["t", "same", "n", "pos"])


_SET = "did long, sig long, n long, a long, b long, second array<long>, counters array<int>, counts array<long>"


def _set_rows(batch: pa.RecordBatch, n: int, percent: int, key: int, counters: int) -> Iterator[pa.RecordBatch]:
    """(did, sig, n, a, b, second): the size of each text's set, the marks of its words, its prefix under the second order. One more
    row has only counters and counts, the batch's part of the frequency sketch."""
    did, sig = (batch.column(c).to_numpy() for c in ("did", "sig"))
    names = [x.split()[0] for x in _SET.split(", ")]
    total = np.zeros(counters, np.int64)
    for part, grams, at, marks in _texts(batch, n, key):
        sizes = np.diff(at)
        a, b = marks[:, 0].copy(), marks[:, 1].copy()
        total += np.bincount((grams & U64(counters - 1)).astype(np.int64), minlength=counters)
        empty = [pa.nulls(len(sizes), pa.list_(t)) for t in (pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(did[part]), pa.array(sig[part]), pa.array(sizes.astype(np.int64)), pa.array(a), pa.array(b), _prefixes(grams, at, percent, 0), *empty], names)
    used = np.flatnonzero(total)
    lists = [pa.array([x], pa.list_(t)) for x, t in ((used.astype(np.int32), pa.int32()), (total[used], pa.int64()))]
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 5 + [pa.nulls(1, pa.list_(pa.int64())), *lists], names)


def _prefixes(grams: np.ndarray, at: np.ndarray, percent: int, order: int) -> pa.ListArray:
    sizes = np.diff(at)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ranked = np.lexsort((mixed(grams * _ORDERS[order]), text))
    keep = np.arange(len(grams)) - np.repeat(at[:-1], sizes) < np.repeat(prefix_size(sizes, percent), sizes)
    ends = np.concatenate([[0], np.cumsum(prefix_size(sizes, percent))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(grams[ranked][keep])))


class _Sets:
    """Distinct shingles of texts, the last few hundred kept: pivots come again and again."""

    def __init__(self, n: int, key: int) -> None:
        self.n, self.key, self.kept = n, key, {}

    def __call__(self, key: int, text: str) -> np.ndarray:
        if key not in self.kept:
            if len(self.kept) >= 256:
                self.kept.pop(next(iter(self.kept)))
            raw = np.frombuffer(text.encode(), np.uint8)
            self.kept[key] = shingles(raw, np.array([0, len(raw)]), self.n, self.key)[0]
        return self.kept[key]


def _verified(batches: Iterator[pa.RecordBatch], n: int, percent: int, key: int) -> Iterator[pa.RecordBatch]:
    sets = _Sets(n, key)
    for batch in batches:
        u, v, keep = batch.column("u"), batch.column("v"), []
        for k, (a, b) in enumerate(zip(u.to_pylist(), v.to_pylist(), strict=True)):
            s, t = (batch.column(c)[k].as_py() for c in ("text_u", "text_v"))
            near = similar(sets(a, s), sets(b, t), percent)
            keep.append(near and really_similar(s, t, n, percent))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], ["u", "v"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 |x & y| >= percent |x | y|, after the prefixes under the third order have been compared."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    firsts = []
    for s in (x, y):
        ranked = mixed(s * _ORDERS[1])
        p = int(prefix_size(len(s), percent))
        firsts.append(np.partition(ranked, p - 1)[:p])
    if not len(np.intersect1d(*firsts, assume_unique=True)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def really_similar(s: str, t: str, n: int, percent: int) -> bool:
    """`similar` by the shingles' words: what hashes say is true only if no two of them stand for different words."""
    x, y = shingle_set(s, n), shingle_set(t, n)
    both = len(x & y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def linked(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, apart: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(sets, nodes, links, done): sets(did, sig, n, node) of every distinct (id, text); nodes(node, did, sig): of each node,
    all texts of the same words, the smallest row; links(u, v) between nodes, enough of them to connect all that is similar;
    tables to discard when the links have been used. A text without words has no node."""
    rows = docs.select(*_keyed(docs, apart), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    spark, key = docs.sparkSession, secrets.randbits(63) + 1
    counters = sized(docs.count() // 4, COUNTERS, MOST_COUNTERS)
    rows_of_sets = written(map_batches(rows, lambda b: _set_rows(b, n, percent, key, counters), _SET), "jaccard-sets", free=False)
    every = rows_of_sets.filter("counters is null")
    classes = every.filter("n > 0").groupBy("a", "b").agg(F.min(F.struct("did", "sig")).alias("least"))
    # numbered in order of ids: a pivot, its smallest node, is what stood there first, of which copies are likelier made than of them
    in_order = classes.select("a", "b", "least.*").orderBy("did", "sig")
    nodes = written(in_order.select(F.monotonically_increasing_id().alias("node"), "a", "b", "did", "sig"), "jaccard-nodes", free=False)
    sets = written(every.select("did", "sig", "n", "a", "b").distinct().join(nodes.select("a", "b", "node"), ["a", "b"], "left").drop("a", "b"), "jaccard-classes", free=False)
    counts = spark.sparkContext.broadcast(_sketch(rows_of_sets, counters))
    prefixes = written(map_batches(rows, lambda b: _prefix_rows(b, n, percent, key, counts), "t long, same long, n int, pos int"), "jaccard-prefixes", free=False)
    # written first, so that the join has two plain exchanges and Spark can split a token of many rows
    shared = written(prefixes.groupBy("t").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).filter("lo != hi").select("t"), "jaccard-tokens")
    found = written(prefixes.join(shared, "t").join(nodes.select("node", F.col("a").alias("same")), "same").select("t", "node", "n", "pos").distinct(), "jaccard-shared")
    discard(prefixes)
    discard(shared)

    def fits(i: str, j: str) -> F.Column:
        """Whether sizes and the places of a common token leave room for similarity, if it is the first that both have.
        A similar pair passes at its first common token, so what fails at one token is made at another or not at all."""
        nx, ny, px, py = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (i, j))
        room = F.least(nx - px, ny - py)
        return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (room * (100 + percent) >= percent * (nx + ny))

    second = every.select("did", "sig", "second").join(nodes.select("did", "sig", "node"), ["did", "sig"]).select("node", "second")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (u, v) that also share a prefix token under the second order, then those that are similar."""
        near = pairs.join(second.select(F.col("node").alias("u"), F.col("second").alias("su")), "u").join(second.select(F.col("node").alias("v"), F.col("second").alias("sv")), "v")
        near = written(near.filter(F.arrays_overlap("su", "sv")).select("u", "v").distinct(), f"{name}-near")
        needed = nodes.join(near.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node").select("node", "did", "sig")
        # a row of each: an id may have the same text many times
        text = among(rows, needed.select(F.col("did").alias("id"))).join(needed, ["did", "sig"]).groupBy("node").agg(F.first("text").alias("text"))
        sides = near.join(text.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v").join(text.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
        found = written(mapped(sides, lambda b: _verified(b, n, percent, key), "u long, v long").distinct(), name)
        discard(near)
        return found

    pivots = found.groupBy("t").agg(F.min(F.struct("node", "n", "pos")).alias("pivot"))
    stars = found.alias("x").join(pivots.select("t", "pivot.*").alias("y"), "t").filter((F.col("x.node") != F.col("y.node")) & fits("x", "y"))
    first = checked(stars.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct(), "jaccard-stars")
    roots = components(first, "jaccard-roots")
    placed = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # of a token's components the largest isn't compared within, so a pair has one side at least outside it
    sizes = placed.groupBy("t", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = written(sizes.groupBy("t").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("t", "largest"), "jaccard-open", free=False)
    tokens = written(placed.join(largest, "t").withColumn("outside", F.col("root") != F.col("largest")).drop("largest"), "jaccard-placed")
    x, y = tokens.alias("x"), tokens.filter("outside").alias("y")
    once = ~F.col("x.outside") | (F.col("x.node") > F.col("y.node"))
    cross = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.root") != F.col("y.root")) & once & fits("x", "y"))
    rest = checked(cross.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct(), "jaccard-rest")
    for done in (largest, tokens, found, rows_of_sets, roots):
        discard(done)
    return sets, nodes, first.unionByName(rest), [first, rest]


def _keyed(docs: DataFrame, apart: bool = False) -> list[F.Column]:
    """did and sig of rows; apart: each text of a null id has a did of its own, a hash of 63 bits under 0."""
    sig = F.xxhash64(F.coalesce(F.col("`text`"), F.lit("")))
    none = sig.bitwiseOR(F.lit(-(1 << 63))) if apart else F.lit(NO_ID)
    return [F.coalesce(F.col("`doc_id`").cast("long"), none).alias("did"), sig.alias("sig")]


def grouped(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """did (doc_id, NO_ID for null), sig (xxhash64 of the text, null as empty), n_shingles and root (the smallest did of the
    component) of each distinct id and text; the texts of an id are one document."""
    sets, nodes, links, done = linked(docs, n, percent)
    own = sets.filter("node is not null").select("did", "node").distinct()
    several = own.groupBy("did").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi").select("did", "lo")
    joined = own.join(several, "did").filter("node != lo").select(F.col("node").alias("u"), F.col("lo").alias("v"))
    roots = components(links.unionByName(joined), "jaccard-components")
    for df in done:
        discard(df)
    placed = nodes.join(roots, "node", "left").select("node", "did", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("did").alias("least"))
    of_id = own.join(placed.select("node", "root"), "node").join(least, "root").groupBy("did").agg(F.min("least").alias("least"))
    out = written(sets.join(of_id, "did", "left").select("did", "sig", F.col("n").alias("n_shingles"), F.coalesce("least", "did").alias("root")), "jaccard-grouped", free=False)
    for df in (sets, nodes, roots):
        discard(df)
    return out


def report(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Texts without words, and null texts, have no shingles and are linked with nothing; a text of fewer words than a
    shingle is one shingle as a whole. Rows of one id are one document: their links are joined. A null id counts
    as the smallest and stays null. doc_id is an integer. Other columns are not looked at. An empty table gives an empty result.
    """
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    found = docs.select(*_keyed(docs)).join(grouped(docs, n, percent), ["did", "sig"])
    return found.select(known("did").alias("doc_id"), "n_shingles", known("root").alias("component_id"))


def kept(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their own columns, of which one is left of each group of similar texts: that of the smallest id.

    Here each text is a document, whatever its id: texts that share an id, or have none, are linked by similarity only. Null ids
    stand before all ids from 0 on; if an id has several texts of a group, the one with the least hash stays. Of equal rows one
    stays, of texts without words one of each id (null and empty ones count as the same text).
    """
    sets, nodes, links, done = linked(docs, n, percent, apart=True)
    roots = components(links, "jaccard-components")
    for df in done:
        discard(df)
    groups = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("did", "sig")).alias("least")).select("least.*")
    first = written(groups.unionByName(sets.filter("node is null").select("did", "sig")), "jaccard-kept", free=False)
    for df in (sets, nodes, roots):
        discard(df)
    rows = docs.select(*_keyed(docs, apart=True), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.join(first, ["did", "sig"]).dropDuplicates(["did", "sig"])
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
