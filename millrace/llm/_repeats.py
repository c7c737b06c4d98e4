"""Repeated windows (of bytes or words) over a corpus, exactly, without moving each window.

Equal windows have the same minimiser (least hash of the grams inside), so consecutive windows that share a
minimiser travel together, as one packed string (super-k-mer), to the minimiser's bucket. Steps:

1. `anchors`: one narrow row (minimiser, document, first window, windows) per super-k-mer of every text.
2. Minimisers that stand at one place only can't hold a repeated window: a hash aggregate drops them. Exact
   copies of a text don't count as other places: the document with the smallest id stands for its copies.
3. Only what is left is cut out of the texts as packed strings and dealt by minimiser; within a bucket
   identical strings fold first, and the caller's `bucket` compares the windows of those that differ.
4. A minimiser of more than HOT strings, or HOT_BYTES, doesn't go to one task. Its strings are grouped by their bytes
   first, pre-aggregated before the shuffle: all windows of a string that stands twice are repeated, and one of
   each is enough to compare with others. If a minimiser has too many different strings even so, these are cut once more,
   by the least hash of longer grams (`finer`), and the pieces go through steps 2 to 4 again: most differ around what the
   strings share, and are dropped as they stand at one place. Only windows of pieces that are too many by the longest grams
   are dealt one by one, by a digest of their content, pre-aggregated too.

A super-k-mer has LONGEST windows at most, so a periodic text doesn't travel as one string.

The result has, for each document with such windows, the ranges of its window starts that are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, discard, map_batches, mapped, signed, text_bytes, written

#: Super-k-mers of one minimiser, and bytes of them, that one task may hold; more are grouped by content first.
HOT, HOT_BYTES = 1_000, 1 << 18
#: Different repeated windows among the strings of hot minimisers that are looked up in a broadcast table at most; more are joined.
MOST_SEEN = 1 << 16
#: Windows of a super-k-mer at most.
LONGEST = 4_096
#: Places whose minimisers are looked for at once: so many fit the lower bits of a key.
PLACES = 1 << 24
#: Bytes of packed strings that a bucket task works on at once.
BUCKET_BYTES = 1 << 20
#: Ids are compared; a null id counts as the smallest.
NO_ID = -(1 << 63) + 1


@dataclass
class Windows:
    """What differs between byte and word windows.

    anchors: texts' bytes and offsets -> (text index, first window, windows, minimiser, again, bytes) of all super-k-mers.
    cut: a text's bytes, first windows, numbers of windows -> packed strings.
    digests: a packed string, its number of windows -> 16 bytes that identify each window's content.
    finer: as anchors, by longer and longer grams, for packed strings of which there are too many.
    bucket: strings (distinct), their place (document, first window) -> flags of their windows, one array each.
    first_stays: the earliest place of a window isn't repeated, only the others are.
    """

    anchors: Callable
    cut: Callable
    digests: Callable
    bucket: Callable
    first_stays: bool
    finer: tuple[Callable, ...] = ()


def identity() -> list[F.Column]:
    """did (never null) and sig (60 bits of the text's SHA-256): what the steps join by. Rows of one id and text share them."""
    sha = F.sha2(F.coalesce(F.col("`text`"), F.lit("")), 256)
    return [F.coalesce(F.col("`doc_id`").cast("long"), F.lit(NO_ID)).alias("did"), F.conv(F.substring(sha, 1, 15), 16, 10).cast("long").alias("sig")]


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(*identity(), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))


def doc_id() -> F.Column:
    return F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id")


def copies(rows: DataFrame, name: str) -> DataFrame:
    """did, sig, rep, copies of every document whose whole text another row has too, written; rep is the smallest id. Texts are
    told apart by their SHA-256."""
    narrow = rows.select("did", "sig", F.unhex(F.sha2("text", 256)).alias("sha"))
    classes = narrow.groupBy("sha").agg(F.min("did").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    classes = written(classes, f"{name}-classes", free=False)  # so that Spark can split a text of many copies in the join
    twins = written(narrow.distinct().join(classes, "sha").select("did", "sig", "rep", "copies"), f"{name}-copies", free=False)
    discard(classes)
    return twins


def longer(gram: int, window: int) -> list[int]:
    """Lengths of grams between `gram` and `window`, four at most, each halfway from the one before."""
    out, last = [], gram
    for _ in range(4):
        last += (window - last + 1) // 2
        if gram < last < window and last not in out:
            out.append(last)
    return out


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams, the index of its least hash (by 40 bits), the first of equals. len(hashes) - width + 1."""
    n = len(hashes)
    if n > PLACES:
        step = PLACES - width + 1
        return np.concatenate([minimisers(hashes[i : i + PLACES], width) + i for i in range(0, n - width + 1, step)])
    keys = (hashes & U64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=U64)
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[: len(keys) - span], keys[span:])
        span *= 2
    if span < width:
        keys = np.minimum(keys[: len(keys) - (width - span)], keys[width - span :])
    return (keys & U64(0xFFFFFF)).astype(np.int64)


def super_runs(of_text: np.ndarray, firsts: np.ndarray, grams: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, first, windows, minimiser, again) of runs of windows whose minimisers have one hash.

    of_text: the text of each window; firsts: its place; grams: hashes of the grams at all places. Windows cover
    the grams at firsts .. firsts + width - 1. again: the minimiser stands at several places of the run, as in
    periodic text, so windows within the run may be equal; else they can't be.
    """
    if not len(firsts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(bool)
    at = minimisers(grams, width)[firsts]
    low = grams[at]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (of_text[1:] != of_text[:-1]) | (firsts[1:] != firsts[:-1] + 1)])
    runs = np.flatnonzero(new)
    sizes = np.diff(np.append(runs, len(firsts)))
    if sizes.max() > LONGEST:
        new |= (np.arange(len(firsts)) - np.repeat(runs, sizes)) % LONGEST == 0
        runs = np.flatnonzero(new)
    moved = np.concatenate([[False], (at[1:] != at[:-1]) & ~new[1:]])
    again = np.add.reduceat(moved.astype(np.int64), runs) > 0
    return of_text[runs], firsts[runs], np.diff(np.append(runs, len(firsts))), signed(low[runs]), again


_RUNS = "h long, did long, sig long, start int, n int, again boolean"


def find(docs: DataFrame, kind: Windows, name: str, hot: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of `identified`, ranges(did, sig, spans) of repeated window starts, copies(did, sig, rep, copies)).

    Copies other than the representative have no ranges: their caller removes what a whole copy loses.
    """
    hot = HOT if hot is None else hot
    rows = identified(docs)
    twins = copies(rows, name)
    runs = written(map_batches(rows, lambda b: _anchor_rows(b, kind), f"{_RUNS}, bytes int"), f"{name}-runs", free=False)
    place = F.xxhash64("sig", "start")  # a copy's place is that of the text it copies
    places = runs.select("h", "again", "bytes", place.alias("place")).groupBy("h")
    places = places.agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.max("again").alias("again"), F.count(F.lit(1)).alias("strings"), F.sum("bytes").alias("bytes"))
    too_hot = ((F.col("strings") > hot) | (F.col("bytes") > HOT_BYTES)).alias("hot")
    # written first, so that the join has two plain exchanges and Spark can split a minimiser of many rows
    shared = written(places.filter("lo != hi or again").select("h", too_hot), f"{name}-shared")
    others = twins.filter("did != rep").select("did", "sig")
    flagged = written(runs.drop("bytes").join(shared, "h").join(others, ["did", "sig"], "left_anti"), f"{name}-flagged")
    discard(runs)
    discard(shared)

    lists = flagged.groupBy("did", "sig").agg(F.collect_list(F.struct("h", "start", "n", "again", "hot")).alias("runs"))
    packed = map_batches(rows.join(lists, ["did", "sig"]), lambda b: _packed_rows(b, kind), f"{_RUNS}, hot boolean, s binary")
    dealt, known, done = packed.drop("hot"), [], [flagged]
    if not flagged.filter("hot").isEmpty():
        packed = written(packed, f"{name}-strings")  # texts are moved once for both kinds
        known, few, more = _grouped(packed.filter("hot").drop("hot"), kind, name, hot, kind.finer)
        dealt = packed.filter("not hot").drop("hot").unionByName(few)
        done += [packed, *more]
    found = mapped(dealt.repartition("h").sortWithinPartitions("h"), lambda batches: _buckets(batches, kind), "did long, sig long, a int, b int")
    for part in known:
        found = found.unionByName(part)
    # written, so that texts are dealt once for each of two plans, whatever Spark reuses, and never both at a time
    spans = written(found.groupBy("did", "sig").agg(F.collect_list(F.struct("a", "b")).alias("spans")), f"{name}-spans")
    for df in done:
        discard(df)
    return rows, spans, twins


def _grouped(strings: DataFrame, kind: Windows, name: str, hot: int, finer: tuple[Callable, ...]) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Of the strings of hot minimisers: ranges known by their bytes, strings still to compare, tables written."""
    member = F.struct("did", "start", "sig")
    classes = strings.groupBy("h", "s").agg(F.min(F.struct("did", "start", "sig", "n", "again")).alias("first"), F.max(member).alias("last"))
    classes = written(classes.select("h", "s", "first", (F.struct("first.did", "first.start", "first.sig") != F.col("last")).alias("many")), f"{name}-classes")
    whole = strings.join(classes.filter("many").select("h", "s", "first"), ["h", "s"])
    if kind.first_stays:
        whole = whole.filter(member != F.struct("first.did", "first.start", "first.sig"))
    known = [whole.select("did", "sig", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))]
    sizes = classes.groupBy("h").agg(F.count(F.lit(1)).alias("strings"), F.sum(F.octet_length("s")).alias("bytes"))
    too_hot = written(sizes.filter((F.col("strings") > hot) | ((F.col("bytes") > HOT_BYTES) & (F.col("strings") > 1))).select("h"), f"{name}-hot")
    one_each = classes.select("h", "first.did", "first.sig", "first.start", "first.n", "first.again", "s")
    few, done = one_each.join(too_hot, "h", "left_anti"), [classes, too_hot]
    if too_hot.isEmpty():
        return known, few, done
    many = one_each.join(too_hot, "h")
    if finer:
        pieces = written(map_batches(many, lambda b: _finer_rows(b, kind, finer[0]), f"{_RUNS}, s binary"), f"{name}-pieces", free=False)
        place = F.xxhash64("sig", "start")
        shared = pieces.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("again").alias("again")).filter("lo != hi or again")
        more, others, made = _grouped(pieces.join(shared.select("h"), "h"), kind, name, hot, finer[1:])
        known, few, done = [*known, *more], few.unionByName(others), [*done, pieces, *made]
    else:
        single = map_batches(many, lambda b: _digest_rows(b, kind), "w binary, did long, sig long, a int")
        seen = single.groupBy("w").agg(F.min(F.struct("did", "a", "sig")).alias("lo"), F.max(F.struct("did", "a", "sig")).alias("hi")).filter("lo != hi")
        seen = written(seen.select("w", "lo"), f"{name}-seen")
        done.append(seen)
        if seen.count() <= MOST_SEEN:  # few windows, at however many places: looked up where the strings are
            table = many.sparkSession.sparkContext.broadcast({bytes(r.w): (r.lo.did, r.lo.a, r.lo.sig) for r in seen.collect()})
            known.append(map_batches(many, lambda b: _seen_ranges(b, kind, table), "did long, sig long, a int, b int"))
        else:
            alone = single.join(seen, "w")
            if kind.first_stays:
                alone = alone.filter(F.struct("did", "a", "sig") != F.col("lo"))
            known.append(alone.select("did", "sig", "a", (F.col("a") + 1).alias("b")))
    return known, few, done


def without_copies(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of rows with one text in a batch only the one of the smallest id, as a pre-aggregation: a group of copies leaves a
    row a batch. The smallest id of all is among them. sig finds them, their bytes decide."""
    did, sig = (batch.column(c).to_numpy() for c in ("did", "sig"))
    order = np.lexsort((did, sig))
    same = np.flatnonzero(sig[order][1:] == sig[order][:-1])
    if not len(same):
        return batch
    data, offsets = text_bytes(batch.column("text"))
    stays = np.ones(len(did), bool)
    for i, j in zip(order[same].tolist(), order[same + 1].tolist(), strict=True):
        stays[j] = not np.array_equal(data[offsets[i] : offsets[i + 1]], data[offsets[j] : offsets[j + 1]])
    return batch.filter(pa.array(stays))


def _anchor_rows(batch: pa.RecordBatch, kind: Windows) -> Iterator[pa.RecordBatch]:
    batch = without_copies(batch)
    data, offsets = text_bytes(batch.column("text"))
    did, sig = (batch.column(c).to_numpy() for c in ("did", "sig"))
    for text, start, n, h, again, size in kind.anchors(data, offsets):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, did[text], sig[text], start.astype(np.int32), n.astype(np.int32), again, size.astype(np.int32))], ["h", "did", "sig", "start", "n", "again", "bytes"])


def _per_text(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, tuple[np.ndarray, ...]]]:
    """did, sig, text, and h, start, n, again, hot of its runs."""
    lists = batch.column("runs")
    flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(5)]
    for i, (did, sig, text) in enumerate(zip(batch.column("did").to_pylist(), batch.column("sig").to_pylist(), batch.column("text").cast(pa.binary()), strict=True)):
        own = slice(at[i], at[i + 1])
        yield did, sig, text.as_py(), tuple(f[own] for f in fields)


def _packed_rows(batch: pa.RecordBatch, kind: Windows) -> Iterator[pa.RecordBatch]:
    for part in range(0, batch.num_rows, 512):
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        strings: list[bytes] = []
        for did, sig, raw, (h, start, n, again, hot) in _per_text(batch.slice(part, 512)):
            strings += kind.cut(raw, start.tolist(), n.tolist())
            for own, values in zip(columns, (h, np.full(len(h), did), np.full(len(h), sig), start, n, again, hot), strict=True):
                own.append(values)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in columns), pa.array(strings, pa.binary())], ["h", "did", "sig", "start", "n", "again", "hot", "s"])


def _finer_rows(batch: pa.RecordBatch, kind: Windows, anchors: Callable) -> Iterator[pa.RecordBatch]:
    """Packed strings cut into those of the runs that `anchors` finds."""
    data, offsets = text_bytes(batch.column("s"))
    strings = batch.column("s").to_pylist()
    did, sig, start = (batch.column(c).to_numpy() for c in ("did", "sig", "start"))
    for of, first, n, h, again, _ in anchors(data, offsets):
        cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)).tolist()
        pieces = [s for i, j in zip(cuts, cuts[1:], strict=False) for s in kind.cut(strings[of[i]], first[i:j].tolist(), n[i:j].tolist())]
        columns = [pa.array(x) for x in (h, did[of], sig[of], (start[of] + first).astype(np.int32), n.astype(np.int32), again)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], ["h", "did", "sig", "start", "n", "again", "s"])


def _digest_rows(batch: pa.RecordBatch, kind: Windows) -> Iterator[pa.RecordBatch]:
    for did, sig, start, n, string in zip(*(batch.column(c).to_pylist() for c in ("did", "sig", "start", "n", "s")), strict=True):
        places = np.arange(start, start + n, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind.digests(string, n), pa.binary()), pa.array(np.full(n, did)), pa.array(np.full(n, sig)), pa.array(places)], ["w", "did", "sig", "a"])


def _seen_ranges(batch: pa.RecordBatch, kind: Windows, table) -> pa.RecordBatch:
    """Ranges of the windows whose digests are in the table (digest -> first place)."""
    found: list[tuple[int, int, int, int]] = []
    for did, sig, start, n, string in zip(*(batch.column(c).to_pylist() for c in ("did", "sig", "start", "n", "s")), strict=True):
        places = [table.value.get(w) for w in kind.digests(string, n)]
        hit = [first is not None and not (kind.first_stays and first == (did, start + k, sig)) for k, first in enumerate(places)]
        edges = np.flatnonzero(np.diff(np.array([False, *hit, False], np.int8)))
        found += [(did, sig, start + a, start + b) for a, b in edges.reshape(-1, 2).tolist()]
    columns = zip(*found, strict=True) if found else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["did", "sig", "a", "b"])


def spans_of(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The starts and ends of each row's spans; none for a null row."""
    flat, sizes = lists.flatten(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
    at = np.concatenate([[0], np.cumsum(sizes)])
    return [(a[i:j], b[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def digest(window: bytes) -> bytes:
    return hashlib.blake2b(window, digest_size=16).digest()


def _buckets(batches: Iterator[pa.RecordBatch], kind: Windows) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by minimiser; whole buckets are worked on together, about BUCKET_BYTES at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= BUCKET_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1], side="left"))
            if whole:
                yield from _bucket_rows(table.slice(0, whole), kind)
                rest = table.slice(whole)
                held = rest.to_batches()
                size = sum(len(x) for x in rest.column("s").to_pylist()) + 32 * rest.num_rows
    if held:
        yield from _bucket_rows(pa.Table.from_batches(held).combine_chunks(), kind)


def _bucket_rows(table: pa.Table, kind: Windows) -> Iterator[pa.RecordBatch]:
    edges = [0]
    lengths = np.cumsum([len(x) for x in table.column("s").to_pylist()])
    h = table.column("h").to_numpy()
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    base = 0
    for e in ends.tolist():
        if lengths[e - 1] - base >= BUCKET_BYTES or e == len(h):
            base = lengths[e - 1]
            edges.append(e)
    for i, j in zip(edges, edges[1:], strict=False):
        yield _compared(table.slice(i, j - i), kind)


def _compared(table: pa.Table, kind: Windows) -> pa.RecordBatch:
    h, did, sig, start, n = (table.column(c).to_numpy() for c in ("h", "did", "sig", "start", "n"))
    strings = table.column("s").to_pylist()
    order = np.lexsort((sig, start, did))
    group: dict[bytes, int] = {}
    member = np.empty(len(strings), np.int64)
    firsts: list[int] = []
    many: list[bool] = []
    for i in order.tolist():  # the earliest place of a string comes first
        g = group.setdefault(strings[i], len(firsts))
        if g == len(firsts):
            firsts.append(i)
            many.append(False)
        elif (sig[i], start[i]) != (sig[firsts[g]], start[firsts[g]]) or did[i] != did[firsts[g]]:
            many[g] = True
        member[i] = g
    first = np.array(firsts)
    repeated = np.array(many)
    if kind.first_stays:
        whole = np.flatnonzero((did != did[first[member]]) | (start != start[first[member]]))
    else:
        whole = np.flatnonzero(repeated[member])
    spans = [(whole, start[whole], start[whole] + n[whole])]
    _, inverse, counts = np.unique(h[first], return_inverse=True, return_counts=True)
    again = table.column("again").to_numpy(zero_copy_only=False)[first]
    mixed_ones = np.flatnonzero((counts[inverse] > 1) | again)  # where windows of different strings, or of one, may be equal
    if len(mixed_ones):
        at = first[mixed_ones]
        flags = kind.bucket([strings[i] for i in at.tolist()], did[at], start[at], n[at])
        of = np.repeat(np.arange(len(at)), n[at])
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
        hit = np.flatnonzero(flags)
        if len(hit):
            new = np.concatenate([[True], (of[hit][1:] != of[hit][:-1]) | (inside[hit][1:] != inside[hit][:-1] + 1)])
            runs = np.flatnonzero(new)
            owner, a, size = of[hit][runs], inside[hit][runs], np.diff(np.append(runs, len(hit)))
            if kind.first_stays:
                rows = at[owner]
                spans.append((rows, start[rows] + a, start[rows] + a + size))
            else:
                by_group: dict[int, list[int]] = {}
                for k, g in enumerate(mixed_ones[owner].tolist()):
                    by_group.setdefault(g, []).append(k)
                for i in np.flatnonzero(np.isin(member, list(by_group)) & ~repeated[member]).tolist():
                    ks = np.array(by_group[member[i]])
                    spans.append((np.full(len(ks), i), start[i] + a[ks], start[i] + a[ks] + size[ks]))
    rows, a, b = (np.concatenate([x[k] for x in spans]) for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(did[rows]), pa.array(sig[rows]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["did", "sig", "a", "b"])
