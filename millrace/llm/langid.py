"""Language identification with blended-spectrum string kernels.

Two texts' kernel is the number of character n-grams (n = 1, 2, 3 together) present in both, over the root of the
product of their numbers of n-grams. A Nyström map over landmark texts makes kernel rows into features, and a
one-versus-rest kernel ridge regression has one column per language. Texts are scored by two products of matrices:
presence by the landmarks' presence, and kernel rows by the fitted coefficients.

Grams are those that landmarks have. They are kept as postings, gram by gram the landmarks that have it; where all cells of
grams by landmarks are few the product is one of dense matrices, else a text's kernel row is summed up from the postings of
its grams. Only the fit is bounded, in labelled rows: SAMPLE and LANDMARKS texts a language, whole and whatever their length,
SAMPLES and ALL_LANDMARKS together, and the landmarks' GRAMS (of many languages each gets an equal share, one text at least;
of landmarks with too many grams the longest go). The letters and the languages are all that those texts have.
Executors turn training texts into grams and kernel rows; the driver holds these, and no text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, discard, doc_columns, map_batches, mapped, text_bytes, written

#: Training texts of a language, and of all languages, at most (but one of each).
SAMPLE, SAMPLES = 150, 20_000
#: Landmarks of a language, and of all languages, at most (but one of each).
LANDMARKS, ALL_LANDMARKS = 16, 2_048
#: Grams of all landmarks together, at most (but those of one landmark of each language): ten bytes each.
GRAMS = 1 << 24
#: Numbers of grams are looked up in a table up to this size, beyond it by bisection; both find the same.
TABLE = 1 << 24
#: Cells of a presence matrix that is worked on at once, and of the landmarks' matrix if it is made.
CELLS, DENSE = 4 << 20, 8 << 20
RIDGE = 1e-3


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([unicodedata.category(chr(p))[0] == "L" for p in range(0x110000)])


def letters_of(text: str) -> np.ndarray:
    """Code points of a text in lower case between two blanks, 0 for what isn't a letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_is_letter()[points], points, 0)


def grams_of(symbols: np.ndarray, base: int) -> np.ndarray:
    """Numbers of the 1-, 2- and 3-grams of symbols below base - 1; those of different n differ."""
    one = symbols.astype(np.int64) + 1
    two = one[:-1] * base + one[1:]
    return np.concatenate([one, two, two[:-1] * base + one[2:]])


#: More than any code point and a bit, so that grams of code points fit 64 bits.
POINTS = 1 << 21


@dataclass
class Model:
    langs: list[str]
    letters: np.ndarray  # code points that landmarks have, sorted
    grams: np.ndarray  # numbers of the grams that landmarks have, sorted
    at: np.ndarray  # where each gram's landmarks begin and end in `marks`
    marks: np.ndarray  # numbers of landmarks
    sizes: np.ndarray  # grams of each landmark
    own: np.ndarray | None = field(default=None, repr=False)  # the landmarks' kernels, for the fit
    weights: np.ndarray | None = None  # landmarks by languages
    bias: np.ndarray | None = None
    tables: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None, "own": None}  # made where they are needed

    @property
    def base(self) -> int:
        return len(self.letters) + 3  # besides letters: what isn't one, a letter that no landmark has, and no symbol

    def columns(self, text: str) -> np.ndarray:
        """Columns of the grams of a text that landmarks have, some several times; len(self.grams) for others."""
        if self.tables is None:
            of_point = np.where(_is_letter(), 1, 0).astype(np.int32)
            of_point[self.letters] = np.arange(2, len(self.letters) + 2)
            table = None
            if self.base**3 <= TABLE:
                table = np.full(self.base**3, len(self.grams), np.int32)
                table[self.grams] = np.arange(len(self.grams))
            dense = None
            if len(self.grams) * len(self.sizes) <= DENSE:
                dense = np.zeros((len(self.grams), len(self.sizes)), np.float32)
                dense[np.repeat(np.arange(len(self.grams)), np.diff(self.at)), self.marks] = 1
                dense /= np.sqrt(self.sizes)
            self.tables = (of_point, table, dense)
        of_point, table, _ = self.tables
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        found = grams_of(of_point[points], self.base)
        if table is not None:
            return table[found]
        found = np.unique(found)
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        return np.where(self.grams[at] == found, at, len(self.grams))


def presence(model: Model, texts: list[str]) -> np.ndarray:
    """texts by grams: 1 where the text has the gram. Scaled so that a row's own kernel is 1."""
    out = np.zeros((len(texts), len(model.grams) + 1), np.float32)
    for i, text in enumerate(texts):
        out[i, model.columns(text)] = 1
    out = out[:, :-1]
    return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))


def kernel(model: Model, texts: list[str]) -> np.ndarray:
    """texts by landmarks, a bounded number of presence cells at a time."""
    if not texts:
        return np.zeros((0, len(model.sizes)), np.float32)
    model.columns("")  # makes the tables
    dense = model.tables[2]
    if dense is None:
        return np.stack([posted(model, np.unique(model.columns(t))) for t in texts])
    step = max(1, CELLS // (len(model.grams) + 1))
    return np.concatenate([presence(model, texts[i : i + step]) @ dense for i in range(0, len(texts), step)])


def posted(model: Model, columns: np.ndarray) -> np.ndarray:
    """The kernel row of a text with these distinct grams, summed up from their postings."""
    columns = columns[columns < len(model.grams)]
    first, n = model.at[columns], np.diff(model.at)[columns]
    spots = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    common = np.bincount(model.marks[spots], minlength=len(model.sizes))
    return (common / np.sqrt(model.sizes) / np.sqrt(max(len(columns), 1))).astype(np.float32)


def from_landmarks(langs: list[str], marks: list[np.ndarray]) -> Model:
    """A model yet without weights. marks: the distinct grams of each landmark, as `grams_of` its code points."""
    last = np.unique(np.concatenate([np.unique(m % POINTS) for m in marks])).astype(np.int64) - 1
    letters = last[last > 0]
    own = lambda g: np.where(g, np.where(g > 1, np.searchsorted(letters, g - 1) + 2, 0) + 1, 0)  # noqa: E731  symbol + 1, or 0 for none
    base = len(letters) + 3
    # a gram has its first symbols in its upper bits
    numbered = [np.unique((own(m // POINTS**2) * base + own(m // POINTS % POINTS)) * base + own(m % POINTS)) for m in marks]
    sizes = np.array([len(m) for m in numbered])
    every = np.concatenate(numbered)
    order = np.argsort(every, kind="stable")
    of = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.int32), sizes)[order]
    every = every[order]
    at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    model = Model(langs, letters, every[at], np.append(at, len(every)), of, sizes)
    model.own = np.stack([posted(model, np.searchsorted(model.grams, m)) for m in numbered])
    return model


def fitted(model: Model, labels: list[str], rows: np.ndarray) -> Model:
    """The model with the weights of a ridge regression on kernel rows of labelled texts."""
    values, vectors = np.linalg.eigh(model.own.astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = rows.astype(np.float64) @ root
    target = np.where(np.array(labels, object)[:, None] == np.array(model.langs, object), 1.0, -1.0)
    mean_x, mean_y = features.mean(0), target.mean(0)
    x, y = features - mean_x, target - mean_y
    solved = np.linalg.solve(x.T @ x + RIDGE * len(rows) * np.eye(x.shape[1]), x.T @ y)
    model.weights, model.bias = (root @ solved).astype(np.float32), mean_y - mean_x @ solved
    return model


def score(model: Model, texts: list[str]) -> np.ndarray:
    """texts by languages: about 1 for the text's language and -1 for others."""
    return kernel(model, texts) @ model.weights + model.bias


# --- fitting on Spark ----------------------------------------------------------------------------

def training_rows(rows: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int, int, int]]:
    """(lang, sig, doc_id, bytes) of at most `sample` different texts of each language, those of least hash.

    rows: lang, sig, doc_id, bytes. Each task passes on its own least ones only, so no group of copies, nor a language of most
    rows, comes together in one task.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[int, tuple[int, int]]] = {}
        for batch in batches:
            for lang, sig, doc, size in zip(*(batch.column(c).to_pylist() for c in ("lang", "sig", "doc_id", "bytes")), strict=True):
                own = best.setdefault(lang, {})
                if sig not in own or (doc, size) < own[sig]:
                    own[sig] = (doc, size)
                    if len(own) >= 4 * sample:
                        best[lang] = {k: own[k] for k in sorted(own)[:sample]}
        found = [(lang, k, *own[k]) for lang, own in best.items() for k in sorted(own)[:sample]]
        for i in range(0, len(found), 10_000):
            columns = zip(*found[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["lang", "sig", "doc_id", "bytes"])

    some = mapped(rows.select("lang", "sig", "doc_id", "bytes"), least, "lang string, sig long, doc_id long, bytes long")
    some = some.groupBy("lang", "sig").agg(F.min(F.struct("doc_id", "bytes")).alias("least"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("sig"))
    found = some.withColumn("rank", rank).filter(F.col("rank") <= sample).collect()  # `sample` narrow rows a language
    return sorted((r.lang, r.sig, r.least.doc_id, r.least.bytes) for r in found)


def within(sizes: dict[tuple[str, int], int], most: int) -> list[tuple[str, int]]:
    """Landmarks (lang, sig) of `most` grams together at most: each language has an equal share, its longest ones go first, and
    one of it stays."""
    langs = sorted({lang for lang, _ in sizes})
    out = []
    for lang in langs:
        own = sorted((k for k in sizes if k[0] == lang), key=lambda k: (sizes[k], k))
        total = np.cumsum([sizes[k] for k in own])
        out += own[: max(1, int(np.searchsorted(total, most // len(langs), side="right")))]
    return sorted(out)


def fit(docs: DataFrame, keep: F.Column) -> Model | None:
    """The model of the rows with a lang and a letter that `keep` leaves; None without any."""
    sig = F.xxhash64("text").alias("sig")
    rows = docs.filter(keep & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.col("doc_id").cast("long").alias("doc_id"), sig, F.octet_length("text").cast("long").alias("bytes"), "text")
    found = training_rows(rows)
    if not found:
        return None
    spark, langs = docs.sparkSession, sorted({r[0] for r in found})
    each, marked = max(1, min(SAMPLE, SAMPLES // len(langs))), max(1, min(LANDMARKS, ALL_LANDMARKS // len(langs)))
    chosen, marks = [], set()
    for lang in langs:
        own = [r for r in found if r[0] == lang][:each]
        chosen += own
        by_size = sorted(own, key=lambda r: (r[3], r[1]))  # landmarks evenly over the lengths: long texts have most grams
        marks |= {by_size[i][:2] for i in np.linspace(0, len(own) - 1, min(marked, len(own))).astype(int).tolist()}
    wanted = F.broadcast(spark.createDataFrame([(*r[:3], r[:2] in marks) for r in chosen], "lang string, sig long, doc_id long, mark boolean"))  # SAMPLES narrow rows
    texts = rows.select("lang", "sig", "doc_id", "text").join(wanted, ["lang", "sig", "doc_id"]).select("lang", "sig", "mark", "text")
    sample = written(map_batches(texts, _once(), "lang string, sig long, mark boolean, text string"), "langid-sample", free=False)

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [np.unique(grams_of(letters_of(t), POINTS)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("sig"), pa.array(lists, pa.list_(pa.int64()))], ["lang", "sig", "grams"])

    found = written(map_batches(sample.filter("mark"), grams, "lang string, sig long, grams array<long>"), "langid-grams", free=False)
    sizes = {(r.lang, r.sig): r.n for r in found.select("lang", "sig", F.size("grams").alias("n")).collect()}  # ALL_LANDMARKS narrow rows
    few = within(sizes, GRAMS)
    got = {(r.lang, r.sig): np.array(r.grams, np.int64) for r in found.join(F.broadcast(spark.createDataFrame(few, "lang string, sig long")), ["lang", "sig"]).toLocalIterator()}
    discard(found)
    model = from_landmarks(langs, [got[k] for k in sorted(got)])
    del got
    sent = spark.sparkContext.broadcast(model)

    def kernels(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("sig"), pa.array(list(kernel(sent.value, batch.column("text").to_pylist())), pa.list_(pa.float32()))], ["lang", "sig", "k"])

    rows_of = {(r.lang, r.sig): r.k for r in map_batches(sample, kernels, "lang string, sig long, k array<float>").toLocalIterator()}
    discard(sample)
    keys = sorted(rows_of)
    return fitted(model, [lang for lang, _ in keys], np.array([rows_of[k] for k in keys], np.float32))


def _once():
    """A function of batches that passes on one row of each (lang, sig): rows may be repeated without end."""
    seen: set[tuple[str, int]] = set()  # each task unpickles its own, and no more than SAMPLES come

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = []
        for key in zip(batch.column("lang").to_pylist(), batch.column("sig").to_pylist(), strict=True):
            new.append(key not in seen)
            seen.add(key)
        return batch.filter(pa.array(new, pa.bool_()))

    return first


def identify(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; fitted on rows that held_out (of doc_id) leaves out.

    A null text, or one without a letter, is `und` with score 0, as is every text if there is no row to learn
    from. Rows with null lang are scored, not learned from; null ids too. Repeated rows are scored each, and learned
    from once. Texts of any length are learned from. doc_id is an integer. Other columns are not looked at. An empty
    table gives an empty result.
    """
    rows = doc_columns(docs, "doc_id", "text", "lang")
    held = F.coalesce(held_out, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, ~held))

    def batch(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = model.value
        _, offsets = text_bytes(part.column("text"))
        for i, j in chunks(offsets, 1 << 19):
            some = part.slice(i, j - i)
            read = np.array(some.column("read").to_pylist(), bool) & (own is not None)
            lang, best = np.full(len(read), "und", object), np.zeros(len(read))
            if read.any():
                found = score(own, [t for t, r in zip(some.column("text").to_pylist(), read, strict=True) if r])
                lang[read] = np.array(own.langs, object)[found.argmax(1)]
                best[read] = np.clip((found.max(1) + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), pa.array(lang, pa.string()), pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    lined = rows.select("doc_id", held.alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("read"))
    return map_batches(lined, batch, "doc_id long, held_out boolean, lang_pred string, score double")
