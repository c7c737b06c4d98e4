"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier in the corpus.

Windows of 100 bytes are dealt as super-k-mers (see `_repeats`); each bucket's strings are put in suffix order by
two-stage sorting: only suffixes smaller than their successors are sorted directly, the rest is induced by
scanning the buckets of first bytes; then neighbours' common prefixes show which windows are equal, and the
earliest place of each stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import U64, chunks, map_batches, merged, mixed
from ._repeats import Windows, digest, doc_id, find, longer, spans_of, super_runs

LENGTH, GRAM = 100, 32
#: Ends a string in a bucket's text; UTF-8 has no such byte.
END = 0xFF


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes at each place, by doubling; where that goes beyond, of two parts that overlap."""
    h = mixed(np.arange(1, 257, dtype=U64) * U64(0x9FB21C651E98DF25))[data]
    span, factor = 1, 0xD6E8FEB86659FD93
    while span * 2 <= gram:
        h = h[: len(h) - span] * U64(factor) + h[span:]
        factor = factor * factor % (1 << 64)
        span *= 2
    if span < gram:
        h = h[: len(h) - (gram - span)] * U64(factor) + h[gram - span :]
    return mixed(h)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number that compares as they do; behind the end are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
    out = np.zeros(len(data), U64)
    for k in range(8):
        out |= padded[k : k + len(data)] << U64(8 * (7 - k))
    return out


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes; suffixes with `depth` equal bytes stand together, in any order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    run_ends = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    rises = np.append(data[run_ends[:-1]] < data[run_ends[:-1] + 1], False)
    smaller = np.repeat(rises, np.diff(np.append(-1, run_ends)))  # than the successor
    own = _directly_sorted(np.flatnonzero(smaller), words_at(data), depth)
    cuts = np.searchsorted(data[own], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        scanned = [front]
        while len(front):  # runs of one byte are induced within their own bucket
            front = front[front > 0] - 1
            front = front[(data[front] == c) & ~smaller[front]]
            scanned.append(front)
        here = np.concatenate([*scanned, own[cuts[c] : cuts[c + 1]]])
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        before = before[data[before] > c]
        if len(before):
            firsts = data[before]
            order = np.argsort(firsts, kind="stable")
            before, firsts = before[order], firsts[order]
            edges = np.flatnonzero(firsts[1:] != firsts[:-1]) + 1
            for part in np.split(before, edges):
                waiting[data[part[0]]].append(part)
    return np.concatenate(out)


def _directly_sorted(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """places sorted by the `depth` bytes there: by 8 bytes, then ties by the next 8, and so on."""
    if not len(places):
        return places
    ahead = lambda p: np.where(p < len(words), words[np.minimum(p, len(words) - 1)], U64(0))
    key = words[places]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    tied = np.arange(len(places))
    done = 8
    while True:
        g = group[tied]
        same = g[1:] == g[:-1]
        tied = tied[np.append(same, False) | np.insert(same, 0, False)]
        if done >= depth or not len(tied):
            return places
        g, p = group[tied], places[tied]
        key = ahead(p + done)
        order = np.lexsort((key, g))
        places[tied], key, g = p[order], key[order], g[order]
        # ties get numbers of their own: the place of their group's first row
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        group[tied] = len(places) + done * len(places) + np.cumsum(new)
        done += 8


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each place's suffix has in common with the one before it in `order`, up to `limit`; 0 for the first."""
    words = words_at(data)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(0, limit, 8):
        left, right = order[live - 1] + k, order[live] + k
        inside = (left < len(data)) & (right < len(data))
        live, left, right = live[inside], left[inside], right[inside]
        differ = words[left] ^ words[right]
        equal = differ == 0
        out[live[equal]] = k + 8
        for s in range(1, 8):  # whole bytes that still agree
            ok = ~equal & (differ >> U64(64 - 8 * s) == 0)
            out[live[ok]] = k + s
        live = live[equal]
    return np.minimum(out, limit)


def byte_windows(length: int = LENGTH, gram: int = GRAM) -> Windows:
    def anchors(data: np.ndarray, offsets: np.ndarray, gram: int = gram) -> Iterator[tuple[np.ndarray, ...]]:
        for i, j in chunks(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            counts = np.maximum(np.diff(own) - length + 1, 0)
            if not counts.any():
                continue
            text = np.repeat(np.arange(j - i), counts)
            firsts = np.repeat(own[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            got, first, n, low, again = super_runs(text, firsts, gram_hashes(part, gram), length - gram + 1)
            yield got + i, first - own[got], n, low, again, n + length - 1

    def cut(raw: bytes, starts: list[int], ns: list[int]) -> list[bytes]:
        return [raw[s : s + n + length - 1] for s, n in zip(starts, ns, strict=True)]

    def digests(string: bytes, n: int) -> list[bytes]:
        return [digest(string[k : k + length]) for k in range(n)]

    def bucket(strings: list[bytes], did: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        data = np.frombuffer(b"".join(s + bytes([END]) for s in strings), np.uint8)
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        bases = np.cumsum(sizes) - sizes
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(bases, n) + inside
        window = np.full(len(data), -1, np.int64)
        window[at] = np.arange(len(at))
        order = suffix_array(data, length)
        order = order[window[order] >= 0]  # a window with an END in it equals none
        group = np.cumsum(common_prefixes(data, order, length) < length)
        who = window[order]
        ranks = np.lexsort((np.repeat(start, n)[who] + inside[who], np.repeat(did, n)[who], group))
        later = np.concatenate([[False], group[ranks][1:] == group[ranks][:-1]])
        out = np.zeros(len(at), bool)
        out[who[ranks]] = later
        return out

    return Windows(anchors, cut, digests, bucket, first_stays=True, finer=tuple(partial(anchors, gram=g) for g in longer(gram, length)))


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256 of every row.

    Null texts are empty; a text under `length` bytes loses nothing. Of rows with one text those with the smallest
    id keep it; rows that repeat an id and a text are one document. Null ids count as smallest; doc_id is an integer. Other columns
    are not looked at. An empty table gives an empty result.
    """
    rows, spans, twins = find(docs, byte_windows(length, gram), "suffixdedup", hot)
    later = twins.filter("did != rep").select("did", "sig", "copies").distinct()
    lined = rows.join(spans, ["did", "sig"], "left").join(later, ["did", "sig"], "left").select("did", "text", "spans", "copies")

    def batch(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, part.num_rows, 512):
            some = part.slice(k, 512)
            size, removed, count, kept = [], [], [], []
            for raw, (a, b), copies in zip(some.column("text").cast(pa.binary()).to_pylist(), spans_of(some.column("spans")), some.column("copies").to_pylist(), strict=True):
                if copies and len(raw) >= length:
                    a, b = np.array([0]), np.array([len(raw)])
                elif len(a):
                    a, b = merged(a, b + length - 1)
                left = b"".join(raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                size.append(len(raw)), removed.append(len(raw) - len(left)), count.append(len(a)), kept.append(left)
            longs = [pa.array(x, pa.int64()) for x in (size, removed, count)]
            shas = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([some.column("did"), *longs, pa.array(kept, pa.binary()), shas], ["did", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = map_batches(lined, batch, "did long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
