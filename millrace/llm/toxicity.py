"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed list of insults and of lexicons learned from the labels, how near
second-person words they stand, rates of capitals, of punctuation and of obfuscated words. The lexicons are words and
stems that labelled texts show to go with label 1, some nearly always, others with a weight (their log odds); they are
learned on one half of the training rows for the other half's features, so that the trees see them as reliable as they
will be. Calibration is fitted on scores of rows that the trees didn't see. Training takes at most TRAIN_ROWS labelled
rows, one text of each id; scoring reads every whole text.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, doc_columns, map_batches, written

#: Labelled rows that the lexicons, the trees and the calibration are fitted on at most: those of least id hash.
TRAIN_ROWS = 20_000
#: Learned words (and as many stems) at most; weighted words and stems.
LEXICON, WEIGHTED = 400, 2000
#: Bytes of a stem, and of weighted ones; words a second-person word may be away.
STEM, STEMS, NEAR = 5, (3, 4, 5, 6, 7, 8, 9), 6
#: Texts of label 1 that a learned word or stem stands in at least, and the least log odds of a weighted one.
LEAST, LEAST_WEIGHT = 5, 1.5
THRESHOLD = 0.7
#: Insults of general use (fixed values).
INSULTS = "idiot idiots stupid moron morons loser losers trash scum pathetic disgusting worthless clown clowns dumb fool fools garbage jerk ugly hate shut vermin imbecile idiota estupido imbécile débile trottel dumm".split()
#: Second-person words of several languages (fixed values).
YOU = "you your yours yourself u ur tu te toi ton ta vous votre du dich dir dein deine ihr euch usted ustedes tus".split()
FEATURES = ("insults", "insult_rate", "words", "word_rate", "stems", "stem_rate", "near_you", "you_rate", "capitals", "exclaims", "punctuation", "symbols", "digits", "obfuscated", "length", "weight", "weight_rate", "first_weight", "second_weight", "third_weight", "mean_weight")

_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
_MASKED = re.compile(rb"[A-Za-z][A-Za-z]*[0-9@$!*]+[A-Za-z]+")
_INSULTS, _YOU = frozenset(w.encode() for w in INSULTS), frozenset(w.encode() for w in YOU)


def tokens_of(word: bytes) -> list[bytes]:
    """The stems of a word and the word itself, which ends in a blank."""
    return [word[:k] for k in STEMS if len(word) > k] + [word + b" "]


class Weights(dict):
    """Word -> the largest weight of its stems and of itself, 0 if none has one."""

    def __init__(self, of_token: dict[bytes, float]) -> None:
        super().__init__()
        self.of_token = of_token

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 100_000:
            self.clear()
        found = max((self.of_token[t] for t in tokens_of(word) if t in self.of_token), default=0.0)
        if len(word) <= 64:
            self[word] = found
        return found

    def __reduce__(self):
        return Weights, (self.of_token,)


def features(raw: bytes, lexicon: frozenset[bytes], stems: frozenset[bytes], weights: Weights | None = None) -> list[float]:
    """The numbers in FEATURES of a text; all 0 for an empty one."""
    words = raw.translate(_FOLD).split()
    n = len(words) or 1
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=128) if raw else np.zeros(128, int)
    size = len(raw) or 1
    masked = _MASKED.findall(raw) if counts[48:58].any() or counts[[33, 36, 42, 64]].any() else []
    insults = sum(w in _INSULTS for w in words) + sum(w.translate(_LEET).lower() in _INSULTS for w in masked)
    learned = [i for i, w in enumerate(words) if w in lexicon]
    bad = [i for i, w in enumerate(words) if w in lexicon or w in _INSULTS]
    stemmed = sum(w[:STEM] in stems for w in words) if stems else 0
    you = [i for i, w in enumerate(words) if w in _YOU]
    near = sum(any(abs(i - j) <= NEAR for j in you) for i in bad) if len(bad) * len(you) < 10_000 else int((np.searchsorted(you, np.array(bad) - NEAR) < np.searchsorted(you, np.array(bad) + NEAR, side="right")).sum())
    weighed = [weights[w] for w in words] if weights is not None else []
    each = dict(zip(words, weighed, strict=False))
    top = [*heapq.nlargest(3, each.values()), 0.0, 0.0, 0.0]
    weight = sum(each.values())
    letters = counts[65:91].sum() + counts[97:123].sum()
    marks = sum(counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]])
    odd = sum(counts[[35, 36, 37, 38, 42, 60, 62, 64, 124]])
    return [insults, insults / n, len(learned), len(learned) / n, stemmed, stemmed / n, near, len(you) / n, counts[65:91].sum() / (letters or 1), counts[33] / size, marks / size, odd / size, counts[48:58].sum() / size, len(masked) / n, np.log1p(len(words)), weight, sum(weighed) / n, *top[:3], weight / (len(each) or 1)]


# --- trees ---------------------------------------------------------------------------------------

@dataclass
class Trees:
    """Boosted trees of one depth, as arrays: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0) -> Trees:
    """Trees fitted to the logistic loss by second-order gain over binned features."""
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)  # x <= cut k: bin <= k
    score, inner, n_features = np.full(len(x), base), 2**depth - 1, x.shape[1]
    all_f, all_t, all_v = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(x), np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(depth):
            first, wide = 2**k - 1, 2**k
            at = node - first
            for m in range(wide):
                own = at == m
                if own.sum() < 10:
                    continue
                best = 1e-6
                gs, hs = g[own].sum(), h[own].sum()
                for j in range(n_features):
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], len(cuts[j]) + 1))[:-1]
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                    if gain.max() > best:
                        best, f[first + m], t[first + m] = gain.max(), j, cuts[j][gain.argmax()]
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + smooth)
        score += v[leaf]
        all_f.append(f), all_t.append(t), all_v.append(v)
    return Trees(base, np.array(all_f), np.array(all_t), np.array(all_v))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (scores, probabilities) of the non-decreasing fit, by pooling adjacent violators."""
    xs, inverse = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # sum, count, last score
    for x, s, c in zip(xs, np.bincount(inverse, y), np.bincount(inverse), strict=True):
        blocks.append([s, c, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c, x = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, x]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: frozenset[bytes]
    stems: frozenset[bytes]
    weights: Weights
    trees: Trees | None
    steps: np.ndarray
    chance: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.chance[0])
        at = np.searchsorted(self.steps, self.trees.raw(x) - 1e-9)
        return self.chance[np.minimum(at, len(self.steps) - 1)]


# --- fitting and scoring on Spark ----------------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, text, toxic (0 or 1), fold of the rows that are learned from; of several texts of one id that of least hash."""
    rows = doc_columns(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")
    text = F.coalesce("text", F.lit(""))
    found = doc_columns(docs, "doc_id", "text").filter(~held_out).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("own"))
    found = found.groupBy("doc_id").agg(F.min("own").alias("own"), F.min("toxic").alias("toxic"))
    return found.select("doc_id", F.col("own.text").alias("text"), F.col("toxic").cast("int").alias("toxic"), fold.alias("fold"))


def _tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """token, texts: of the distinct texts of each fold and label that a word or stem stands in, how many."""
    found: list[Counter] = [Counter() for _ in range(4)]
    toxic, fold = batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()
    for i, text in enumerate(batch.column("text").to_pylist()):
        found[2 * fold[i] + toxic[i]].update({t for w in set(text.encode().translate(_FOLD).split()) for t in tokens_of(w)})
    for k, counts in enumerate(found):
        tokens, n = list(counts), list(counts.values())
        for i in range(0, len(tokens), 50_000):
            some = n[i : i + 50_000]
            columns = [pa.array(tokens[i : i + 50_000], pa.binary()), *[pa.array(some if j == k else [0] * len(some), pa.int64()) for j in range(4)]]
            yield pa.RecordBatch.from_arrays(columns, ["token", "good0", "bad0", "good1", "bad1"])


@dataclass
class Lexicons:
    """Of each fold, and of both as fold 2, what goes with label 1: words, stems, weights of words and stems."""

    words: list[frozenset[bytes]]
    stems: list[frozenset[bytes]]
    weights: list[Weights]


def learned(rows: DataFrame) -> Lexicons:
    names = ["good0", "bad0", "good1", "bad1"]
    counts = map_batches(rows, _tokens, "token binary, " + ", ".join(f"{c} long" for c in names)).groupBy("token").agg(*[F.sum(c).alias(c) for c in names])
    counts = written(counts.filter(F.col("bad0") + F.col("bad1") >= LEAST), "toxicity-tokens", free=False)
    n = {(r.fold, r.toxic): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    out = Lexicons([], [], [])
    for fold, folds in enumerate([(0,), (1,), (0, 1)]):
        bad, good = (sum((F.col(f"{kind}{k}") for k in folds), F.lit(0)) for kind in ("bad", "good"))
        all_bad, all_good = (sum(n.get((k, t), 0) for k in folds) for t in (1, 0))
        of = counts.select("token", bad.alias("bad"), good.alias("good")).filter(f"bad >= {LEAST}")
        weight = F.log((F.col("bad") + 0.5) / (all_bad + 1)) - F.log((F.col("good") + 0.5) / (all_good + 1))
        word = F.endswith("token", F.lit(b" "))
        for into, kind in ((out.words, word), (out.stems, ~word & (F.octet_length("token") == STEM))):
            top = of.filter(kind & (F.col("bad") >= 8 * F.col("good"))).orderBy((F.col("bad") / (F.col("good") + 1)).desc(), "token").limit(LEXICON).select("token")
            into.append(frozenset(bytes(r.token).rstrip(b" ") for r in top.collect()))
        top = of.withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT).orderBy((F.col("weight") * F.sqrt("bad")).desc(), "token").limit(WEIGHTED).select("token", "weight")
        out.weights.append(Weights({bytes(r.token): r.weight for r in top.collect()}))
    discard(counts)
    return out


def fit(docs: DataFrame, labels: DataFrame, held_out: F.Column) -> Model:
    """The model of the labelled rows; with labels of one kind, or none, every score is their mean (or 0)."""
    rows = written(training_rows(docs, labels, held_out), "toxicity-training", free=False)
    lexicons = learned(rows)
    sent = docs.sparkSession.sparkContext.broadcast(lexicons)

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        own = sent.value
        lists = [features(t.encode(), own.words[1 - k], own.stems[1 - k], own.weights[1 - k]) for t, k in zip(part.column("text").to_pylist(), part.column("fold").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), part.column("fold"), pa.array(lists, pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    found = map_batches(rows, batch, "doc_id long, toxic int, fold int, x array<double>").collect()  # TRAIN_ROWS at most
    discard(rows)
    found.sort(key=lambda r: r.doc_id)
    y = np.array([r.toxic for r in found], float)
    every = (lexicons.words[2], lexicons.stems[2], lexicons.weights[2])
    if not len(y) or y.min() == y.max():
        return Model(*every, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    x, fold = np.array([r.x for r in found], float), np.array([r.fold for r in found])
    unseen = np.zeros(len(y))
    for k in (0, 1):
        own = fold != k
        unseen[~own] = boosted(x[own], y[own]).raw(x[~own]) if own.any() and (~own).any() else 0
    steps, chance = isotonic(np.round(unseen, 3), y)
    return Model(*every, boosted(x, y), steps, np.clip(chance, 0, 1))


def scored(docs: DataFrame, labels: DataFrame, held_out: F.Column, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs as the struct `row`, with score and predicted (1 if score >= threshold)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out))
    lined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("`text`").alias("text"))
    schema = lined.drop("text").withColumn("score", F.lit(0.0)).schema

    def batch(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = model.value
        for k in range(0, part.num_rows, 1000):
            some = part.slice(k, 1000)
            x = np.array([features((t or "").encode(), own.lexicon, own.stems, own.weights) for t in some.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(own.score(x), pa.float64())], ["row", "score"])

    return map_batches(lined, batch, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def report(docs: DataFrame, labels: DataFrame, held_out: F.Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts are scored as empty ones. Rows without a label are scored, not learned from; of several labels of one
    id the highest counts, of several texts that of least hash; null labels and ids are not learned from. Repeated rows
    are scored each. doc_id is an integer. Other columns
    are not looked at. An empty table gives an empty result; without labels every score is 0.
    """
    found = scored(doc_columns(docs, "doc_id", "text"), labels, held_out, threshold)
    return found.select(F.col("row.doc_id").alias("doc_id"), "score", "predicted").withColumn("held_out", F.coalesce(held_out, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, held_out: F.Column, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their own columns, that aren't predicted toxic."""
    found = scored(docs, labels, held_out, threshold).filter("predicted = 0")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
