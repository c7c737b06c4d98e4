"""Substring dedup by super-k-mer partitioning: words covered by a window of words that stands elsewhere too.

Windows of 35 words; the minimiser of a window is the least hash of its runs of 12 words. See `_repeats` for how
super-k-mers are dealt; in a bucket the windows are sorted by hash and neighbours compared word by word, which
counts them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import IS_WHITE, U64, chunks, map_batches, merged, span_hashes, window_starts, word_hashes, words
from ._repeats import Windows, digest, doc_id, find, identity, longer, spans_of, super_runs

WINDOW, GRAM = 35, 12


def word_windows(window: int = WINDOW, gram: int = GRAM) -> Windows:
    def anchors(data: np.ndarray, offsets: np.ndarray, gram: int = gram) -> Iterator[tuple[np.ndarray, ...]]:
        for i, j in chunks(offsets):
            part = data[offsets[i] : offsets[j]]
            starts, ends, of_text = words(part, offsets[i : j + 1] - offsets[i], IS_WHITE)
            firsts = window_starts(of_text, window)
            if not len(firsts):
                continue
            h = word_hashes(part, starts, ends)
            at = np.arange(len(h) - gram + 1)
            text = np.searchsorted(of_text, firsts, side="right") - 1
            got, first, n, low, again = super_runs(text, firsts, span_hashes(h, at, at + gram), window - gram + 1)
            yield got + i, first - of_text[got], n, low, again, ends[first + n + window - 2] - starts[first]

    def cut(raw: bytes, starts: list[int], ns: list[int]) -> list[bytes]:
        own = raw.split()
        return [b" ".join(own[s : s + n + window - 1]) for s, n in zip(starts, ns, strict=True)]

    def digests(string: bytes, n: int) -> list[bytes]:
        own = string.split(b" ")
        return [digest(b" ".join(own[k : k + window])) for k in range(n)]

    def bucket(strings: list[bytes], did: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        ids: dict[bytes, int] = {}
        numbers = np.array([ids.setdefault(w, len(ids)) for s in strings for w in s.split(b" ")], np.int64)
        sizes = n.astype(np.int64) + window - 1
        at = np.repeat(np.cumsum(sizes) - sizes, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return repeated(numbers, at, window)

    return Windows(anchors, cut, digests, bucket, first_stays=False, finer=tuple(partial(anchors, gram=g) for g in longer(gram, window)))


def repeated(numbers: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows of words at `at` have an equal one, by sorting; hashes order, words decide."""
    h = span_hashes(numbers.astype(U64), at, at + window)
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = h[order[1:]] == h[order[:-1]]
    pairs = np.flatnonzero(same)
    left, right = at[order[pairs - 1]], at[order[pairs]]
    equal = np.ones(len(pairs), bool)
    for k in range(window):
        equal &= numbers[left + k] == numbers[right + k]
    if not equal.all():  # two windows of one hash differ: order them by their words
        order = np.lexsort([numbers[at + k] for k in range(window)])
        same[1:] = np.all([numbers[at[order[1:]] + k] == numbers[at[order[:-1]] + k] for k in range(window)], axis=0)
    out = np.zeros(len(at), bool)
    out[order] = same | np.append(same[1:], False)
    return out


def _lined(rows: DataFrame, spans: DataFrame, twins: DataFrame, *more: str) -> DataFrame:
    once = twins.select("did", "sig", "copies").distinct()
    return rows.join(spans, ["did", "sig"], "left").join(once, ["did", "sig"], "left").select("did", "text", "spans", "copies", *more)


def _kept(batch: pa.RecordBatch, window: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list[bytes]]]:
    """Parts of a batch, with the number of words of each text, that of words removed, and what is left."""
    for k in range(0, batch.num_rows, 512):
        some = batch.slice(k, 512)
        n, removed, kept = [], [], []
        for raw, (a, b), copies in zip(some.column("text").cast(pa.binary()).to_pylist(), spans_of(some.column("spans")), some.column("copies").to_pylist(), strict=True):
            own = raw.split()
            n.append(len(own))
            if copies and len(own) >= window:
                own = []
            elif len(a):
                a, b = merged(a, b + window - 1)
                ends = [0, *b.tolist()]
                own = [w for i, j in zip(ends, [*a.tolist(), len(own)], strict=True) for w in own[i:j]]
            removed.append(n[-1] - len(own))
            kept.append(b" ".join(own))
        yield some, n, removed, kept


def digested(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) of every row.

    Words are runs of other than ASCII white space. Null and empty texts have no words and keep nothing; a text
    under `window` words loses nothing. Rows that repeat a text, under whatever id, repeat its windows. Null ids
    are kept; doc_id is an integer. Other columns are not looked at. An empty table gives an empty result.
    """
    rows, spans, twins = find(docs, word_windows(window, gram), "superkmer", hot)

    def batch(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some, n, removed, kept in _kept(part, window):
            yield pa.RecordBatch.from_arrays([some.column("did"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["did", "n_words", "n_removed", "kept"])

    out = map_batches(_lined(rows, spans, twins), batch, "did long, n_words long, n_removed long, kept binary")
    return out.select(doc_id(), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def applied(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """Every row of docs with its own columns; a text that loses words becomes its kept words, joined by one space,
    and n_chars, if there is one, their number of characters. Other texts stay as they are. See `digested`."""
    _, spans, twins = find(docs, word_windows(window, gram), "superkmer", hot)
    whole = docs.select(*identity(), F.coalesce(F.col("`text`"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lined = _lined(whole, spans, twins, "row")
    schema = lined.select("row").withColumn("left", F.lit(None).cast("string")).schema

    def batch(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some, _, removed, kept in _kept(part, window):
            left = pa.array([k.decode() if r else None for k, r in zip(kept, removed, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([some.column("row"), left], ["row", "left"])

    out = map_batches(lined, batch, schema)
    new = {"text": F.coalesce("left", "row.text"), "n_chars": F.when(F.col("left").isNotNull(), F.length("left")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
