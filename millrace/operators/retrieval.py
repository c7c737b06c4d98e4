"""Vector retrieval: exact scoring of every row, top-k with unique tie-breakers, neighbours, tag expansion.

Rows have an id that is their position in the index; vectors are ARRAY<DOUBLE>. Query vectors come as a frame of few
rows, of checked size, that is broadcast. A null or empty query vector finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.vectors import cosine, norm, present, weighted
from .ordering import placed

#: Query rows that are broadcast at most; a larger set is to be asked in blocks.
MOST_QUERIES = 10_000
#: Digits of a similarity that a product of matrices gives: equal vectors score alike, whatever block they are in.
DIGITS = 12
#: Similarities that a task holds at once (8 bytes each): questions are multiplied with a batch in tiles of so many.
TILE = 1 << 19
#: Weights of the five vectors of a structured record (fixed values).
WEIGHTS = {"symptoms_vector": 0.3, "organs_vector": 0.2, "formulas_vector": 0.2, "patterns_vector": 0.2, "full_content_vector": 0.1}


def few(queries: DataFrame) -> DataFrame:
    """queries, marked for broadcast once their number has been checked."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise InvalidInput(f"more than {MOST_QUERIES} queries: ask them in blocks")
    return F.broadcast(queries)


def settled(rows: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """Few rows, computed once: whatever is made of them doesn't scan the index again."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise InvalidInput(f"more than {most} rows")
    return rows.sparkSession.createDataFrame(found, rows.schema)


def scored(index: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every row of the index with its similarity to the one row of query(q)."""
    asked = few(query.select(F.col("q"), norm(F.col("q")).alias("q_norm")).filter(present(F.col("q"))))
    return index.crossJoin(asked).withColumn("score", cosine(F.col(vector), F.col("q"), norm_b=F.col("q_norm"))).drop("q", "q_norm")


def top(rows: DataFrame, k: int, id_column: str, score: str = "score") -> DataFrame:
    """The k rows of highest score; of equal scores those of lowest id. One TakeOrderedAndProject."""
    return rows.orderBy(F.col(score).desc(), F.col(id_column)).limit(k)


def with_neighbours(index: DataFrame, hits: DataFrame, id_column: str, reach: int = 1) -> DataFrame:
    """Hits and the rows up to `reach` positions beside them, once each, with is_hit, in index order."""
    near = hits.select(F.col(id_column).alias("hit"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d"))
    wanted = near.groupBy((F.col("hit") + F.col("d")).alias(id_column)).agg(F.max(F.col("d") == 0).alias("is_hit"))
    return index.join(F.broadcast(wanted), id_column).orderBy(id_column)  # hits x (2 reach + 1) rows


def retrieve(index: DataFrame, query: DataFrame, id_column: str, top_n: int = 3, adjacent: bool = True, mode: str = "true", mocked: DataFrame | None = None) -> DataFrame:
    """Flat retrieval. mode: "false" finds nothing, "mock" answers from a table (query, rank, text, similarity)."""
    mode = str(mode).lower()
    if mode == "false":
        return scored(index, query).limit(0)
    if mode == "mock":
        return mock(mocked, top_n)
    hits = top(scored(index, query), top_n, id_column)
    if not adjacent:
        return hits
    near = with_neighbours(index, settled(hits.select(id_column)), id_column)  # the index is scored once, then some rows of it
    return scored(near, query).orderBy(id_column)


def mock(table: DataFrame, top_n: int = 3) -> DataFrame:
    """The first rows of each query of a retrieval table, similarity 0.9 where none is given."""
    return table.filter(F.col("rank") <= top_n).withColumn("similarity", F.coalesce("similarity", F.lit(0.9)))


def multi_scored(records: DataFrame, query: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Records with a score over their weighted vectors; those without any usable vector are left out.

    query: one row, with a vector of the name of each vector column. Columns of no positive weight aren't read.
    """
    used = {k: w for k, w in (WEIGHTS if weights is None else weights).items() if w > 0 and k in records.columns}
    names = {k: f"_q_{k}" for k in used}
    asked = few(query.select(*[F.col(k).alias(v) for k, v in names.items()]))
    pairs = {k: (cosine(F.col(k), F.col(v)), present(F.col(k))) for k, v in names.items()}
    total = weighted(pairs, WEIGHTS if weights is None else weights)
    return records.crossJoin(asked).withColumn("score", total).drop(*names.values()).filter("score is not null")


def search(records: DataFrame, query: DataFrame, search_type: str = "multi", top_k: int = 5, weights: Mapping[str, float] | None = None, id_column: str = "vec_id") -> DataFrame:
    """Top-k of all vectors ("multi"), or of one, named with or without its ending "_vector"."""
    if search_type not in ("multi", "multi_vector"):
        weights = {f"{search_type.removesuffix('_vector')}_vector": 1.0}
    return top(multi_scored(records, query, weights), top_k, id_column)


def search_with_tags(records: DataFrame, query: DataFrame, weights: Mapping[str, float] | None = None, top_k: int = 5, use_tags: bool = True) -> DataFrame:
    """`search` over all vectors: tags don't change what is found first, they only add to it (see `expanded`)."""
    return search(records, query, "multi", top_k, weights)


def search_types(records: DataFrame) -> list[str]:
    return [c.removesuffix("_vector") for c in records.columns if c.endswith("_vector")]


def adjacent(records: DataFrame, hits: DataFrame, id_column: str, reach: int = 2, chapter: bool = False) -> DataFrame:
    """(hit, id, dist): records beside each hit in its book, by (chapter, section, id); or all of its chapter.

    Of records with one chapter and section the first stays. hits: ids, few. Records are only ids here, without vectors
    or texts.
    """
    keys = records.select("book_id", "chapter_index", "section_index", id_column)
    places = placed(keys, "book_id", ["chapter_index", "section_index"], id_column)
    asked = F.broadcast(settled(places.join(few(hits.select(id_column)), id_column).select("book_id", F.col(id_column).alias("hit"), F.col("chapter_index").alias("hit_chapter"), F.col("pos").alias("hit_pos"))))
    near = (F.col("chapter_index") == F.col("hit_chapter")) if chapter else F.col("pos").between(F.col("hit_pos") - reach, F.col("hit_pos") + reach)
    pairs = places.join(asked, "book_id").filter(near)
    first = Window.partitionBy("hit", "chapter_index", "section_index").orderBy("pos")
    once = pairs.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return once.select("hit", F.col(id_column).alias("adjacent"), (F.col("pos") - F.col("hit_pos")).alias("dist"))


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of an array of vectors: their lengths, and for each length the rows that have it and these as unit vectors (zero
    vectors stay)."""
    sizes = np.nan_to_num(np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
    out = {}
    for size in set(sizes.tolist()) - {0}:
        rows = np.flatnonzero(sizes == size)
        m = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        out[size] = (rows, np.divide(m, norms, out=np.zeros_like(m), where=norms > 0))
    return sizes, out


def asked_blocks(asked: DataFrame, id_column: str | None = None, vector: str = "q") -> Iterator[tuple[list, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """The asked vectors in blocks of MOST_QUERIES at most: their ids, and per length what `unit_rows` gives."""
    own = asked.filter(present(F.col(vector))).select(*([id_column] if id_column else []), F.col(vector).cast("array<double>").alias(vector))
    blocks = max(1, -(-own.count() // (MOST_QUERIES * 9 // 10)))  # dealt by hash, so a block may be a little larger than the mean
    for k in range(blocks):
        part = own if blocks == 1 else own.filter(F.pmod(F.xxhash64(*own.columns), F.lit(blocks)) == k)
        rows = part.toArrow()
        yield rows.column(id_column).to_pylist() if id_column else [], unit_rows(rows.column(vector).combine_chunks())[1]


def tiles(n: int, rows: int) -> Iterator[tuple[int, int]]:
    """(a, b) of parts of n questions that have TILE similarities to `rows` rows at most, one question at least."""
    step = max(1, TILE // max(1, rows))
    return ((a, min(a + step, n)) for a in range(0, n, step))


def part_of(block: tuple[np.ndarray, np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (questions in order, vectors) those of questions a to b, counted from a."""
    which, m = block
    i, j = np.searchsorted(which, [a, b])
    return which[i:j] - a, m[i:j]


class Best:
    """The k rows of highest score of each of n questions, among what a task has seen; of equal scores those of lowest id. Scores
    of -inf don't count, NaN counts as the highest, as in ORDER BY. once: an id has its best score only."""

    def __init__(self, n: int, k: int, once: bool = False):
        self.k, self.once = k, once
        self.scores, self.ids, self.seen = np.full((n, k), -np.inf), None, np.zeros(n, np.int64)

    def add(self, a: int, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: of the questions from a on to rows with these ids; changed."""
        if not scores.size or not self.k:
            return
        n, own = len(scores), slice(a, a + len(scores))
        scores[np.isnan(scores)] = np.inf
        least = self.scores[own, -1]  # -inf until there are k
        if scores.shape[1] > 4 * self.k and (scores >= least[:, None]).sum() > 4 * self.k * n and (not self.once or len(ids.unique()) == len(ids)):
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(q):
            return
        new = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array(ids.to_pylist(), object)
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, new.dtype)
        elif new.dtype != self.ids.dtype:
            self.ids = self.ids.astype(object)
        held_q, held_at = np.nonzero(np.arange(self.k) < self.seen[own, None])
        q = np.concatenate([held_q, q])
        score = np.concatenate([self.scores[own][held_q, held_at], scores[q[len(held_q) :], at]])
        rows = np.concatenate([self.ids[own][held_q, held_at], new[at]])
        place = rows
        if rows.dtype == object:
            order = {x: i for i, x in enumerate(sorted(set(rows.tolist()), key=lambda x: (x is not None, x)))}
            place = np.array([order[x] for x in rows.tolist()])
        if self.once:
            by = np.lexsort((-score, place, q))
            by = by[np.concatenate([[True], (q[by][1:] != q[by][:-1]) | (place[by][1:] != place[by][:-1])])]
            q, score, rows, place = q[by], score[by], rows[by], place[by]
        by = np.lexsort((place, -score, q))
        q, score, rows = q[by], score[by], rows[by]
        counts = np.bincount(q, minlength=n)
        rank = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        stays = rank < self.k
        self.scores[q[stays] + a, rank[stays]], self.ids[q[stays] + a, rank[stays]] = score[stays], rows[stays]
        self.seen[own] = np.minimum(counts, self.k)

    def rows(self, kind: pa.DataType | None = None) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Question, id and score of each row that stays."""
        q, rank = np.nonzero(np.arange(self.k) < self.seen[:, None])
        score = self.scores[q, rank]
        score[score == np.inf] = np.nan
        return q, pa.array(self.ids[q, rank] if len(q) else [], kind, from_pandas=False), pa.array(score, pa.float64(), from_pandas=False)


def similar_tags(tag_vectors: DataFrame, asked: DataFrame, top_k: int = 10, threshold: float = 0.7) -> DataFrame:
    """(tag, similarity): each tag's best similarity to any asked vector (q), at least 0, over the threshold.

    Asked vectors are taken in blocks; a block is broadcast, and each Arrow batch of tags is multiplied with it, so what
    comes out is a row a tag and block, not one a pair.
    """
    spark, schema = asked.sparkSession, tag_vectors.select("tag", F.lit(0.0).alias("sim")).schema
    parts = []
    for _, block in asked_blocks(asked):
        sent = spark.sparkContext.broadcast({size: m for size, (_, m) in block.items()})

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sim = np.zeros(batch.num_rows)
                for size, (rows, m) in unit_rows(batch.column("embedding"))[1].items():
                    own = sent.value.get(size, m[:0])
                    for a, b in tiles(len(own), len(rows)):
                        sim[rows] = np.maximum(sim[rows], (m @ own[a:b].T).max(1).round(DIGITS))
                yield pa.RecordBatch.from_arrays([batch.column("tag"), pa.array(sim)], ["tag", "sim"])

        parts.append(tag_vectors.select("tag", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(best, schema))
    every = reduce(DataFrame.unionByName, parts).groupBy("tag").agg(F.max("sim").alias("similarity"))
    return every.filter(F.col("similarity") >= threshold).orderBy(F.col("similarity").desc(), "tag").limit(top_k)


def top_many(index: DataFrame, asked: DataFrame, k: int, id_column: str, asked_id: str = "qid", vector: str = "embedding") -> DataFrame:
    """(asked_id, id, score, rank): the k rows of the index that are nearest to each asked vector (q); ties by id.

    Each Arrow batch of the index is multiplied with a block of asked vectors, in tiles, and each task passes on its own k best of
    each, so k rows a task and vector are shuffled. Rows and asked vectors of unequal length, or zero, have score 0.
    """
    spark, ids = asked.sparkSession, index.schema[id_column].dataType
    schema = f"{asked_id} {asked.schema[asked_id].dataType.simpleString()}, {id_column} {ids.simpleString()}, score double"
    parts = []
    for names, block in asked_blocks(asked, asked_id):
        sent = spark.sparkContext.broadcast((names, block))

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, block = sent.value
            best, kind = Best(len(names), k), None
            for batch in batches:
                kind, (_, vectors) = batch.column("id").type, unit_rows(batch.column("v"))
                for a, b in tiles(len(names), batch.num_rows):
                    scores = np.zeros((b - a, batch.num_rows))
                    for size, (rows, n) in vectors.items():
                        if size in block:
                            which, m = part_of(block[size], a, b)
                            scores[np.ix_(which, rows)] = (m @ n.T).round(DIGITS)
                    best.add(a, scores, batch.column("id"))
            which, found, score = best.rows(kind)
            if len(which):
                yield pa.RecordBatch.from_arrays([pa.array([names[w] for w in which.tolist()]), found, score], [asked_id, id_column, "score"])

        rows = index.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        parts.append(rows.mapInArrow(nearest, schema))
    order = Window.partitionBy(asked_id).orderBy(F.col("score").desc(), id_column)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def expanded(records: DataFrame, tags: DataFrame, original: DataFrame, id_column: str, vector: str = "patterns_vector", each: int = 2, most: int = 3) -> DataFrame:
    """Up to `most` records found by the best tags (tag, similarity, q): two a tag, without those already there."""
    ranked = few(tags.withColumn("tag_rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "tag"))))
    pairs = records.filter(present(F.col(vector))).crossJoin(ranked).withColumn("score", cosine(F.col(vector), F.col("q")))
    best = Window.partitionBy("tag_rank").orderBy(F.col("score").desc(), F.col(id_column))
    two = pairs.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= each)
    new = two.join(few(original.select(id_column)), id_column, "left_anti")
    once = new.withColumn("again", F.row_number().over(Window.partitionBy(id_column).orderBy("tag_rank", "rn"))).filter("again = 1")
    return once.orderBy("tag_rank", "rn").limit(most).select(id_column, "tag", "similarity", "tag_rank", "rn")


def with_expansion(original: DataFrame, more: DataFrame, id_column: str, top_k: int, extra: int = 3) -> DataFrame:
    """(rank, id, source): the hits in order of score, then the expansion, top_k + extra rows at most."""
    a = original.select(F.lit(0).alias("part"), F.col(id_column), (-F.col("score")).alias("k1"), F.col(id_column).cast("double").alias("k2"), F.lit("search").alias("source"))
    b = more.select(F.lit(1).alias("part"), F.col(id_column), F.col("tag_rank").cast("double").alias("k1"), F.col("rn").cast("double").alias("k2"), F.lit("tag").alias("source"))
    first = a.unionByName(b).orderBy("part", "k1", "k2").limit(top_k + extra)
    return first.select(F.row_number().over(Window.orderBy("part", "k1", "k2")).alias("rank"), id_column, "source")  # top_k + extra rows


def boosted(rows: DataFrame, words: list[str], text: str = "text", score: str = "score") -> DataFrame:
    """score x (1 + 0.1 for each of the words that the text holds), and how many those are."""
    held = F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(text), w)))
    return rows.withColumn("matches", held).withColumn("boosted", F.col(score) * (1 + 0.1 * F.col("matches")))


def reranked(rows: DataFrame, words: list[str], id_column: str, text: str = "text", score: str = "score") -> DataFrame:
    """`boosted` rows in order of the boosted score; ties by id."""
    return boosted(rows, words, text, score).orderBy(F.desc("boosted"), id_column)


def context(rows: DataFrame, group: Column, order: str, source: str, text: str) -> DataFrame:
    """Rows of each group as "From {source}: {text}" lines, in order."""
    line = F.concat(F.lit("From "), F.coalesce(F.col(source), F.lit("Unknown")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line"))))
    return rows.groupBy(group.alias("grp")).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("context"))
