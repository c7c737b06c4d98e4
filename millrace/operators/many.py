"""Many structured questions at once: weighted search over five vectors, neighbours and tag expansion, keyed by question.

One scan of the records multiplies each Arrow batch with all questions of a block, vector by vector, and in the same scan with
the vectors that tags are searched by, in tiles; of each question and tag only its best rows of the task go on. Everything after that is
joins and windows by question, so no question waits for another and nothing of them is held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import present
from .ordering import placed
from .retrieval import DIGITS, MOST_QUERIES, WEIGHTS, Best, asked_blocks, part_of, tiles, unit_rows


def _blocks(asked: DataFrame, key: str, vectors: list[str]) -> Iterator[tuple[list, dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]]]:
    """The questions in blocks of about MOST_QUERIES: their keys, and of each vector what `unit_rows` gives."""
    own = asked.select(key, *[F.col(v).cast("array<double>").alias(v) for v in vectors])
    blocks = max(1, -(-own.count() // (MOST_QUERIES * 9 // 10)))
    for k in range(blocks):
        part = own if blocks == 1 else own.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
        rows = part.toArrow()
        yield rows.column(key).to_pylist(), {v: unit_rows(rows.column(v).combine_chunks())[1] for v in vectors}


def searched(records: DataFrame, asked: DataFrame, id_column: str, top_k: int = 5, weights: Mapping[str, float] | None = None, tag_queries: DataFrame | None = None, tag_vector: str = "patterns_vector", each: int = 2, key: str = "qid") -> tuple[DataFrame, DataFrame | None]:
    """(hits, by_tag) from one scan of the records.

    hits(key, id, score, rank): the top_k records of each question of asked(key, a vector of the name of each vector column),
    by weighted similarity: a vector that a record lacks counts nothing, one that the question lacks neither; a record
    without any is left out. by_tag(tag, id, rn): the `each` records nearest to each of tag_queries(tag, q) in `tag_vector`.
    Ties by id. A row of either goes on from each task for each rank, so about top_k rows a task and question are shuffled.
    """
    spark = records.sparkSession
    used = {k: float(w) for k, w in (WEIGHTS if weights is None else weights).items() if w > 0 and k in records.columns}
    total = float(sum(w for w in (WEIGHTS if weights is None else weights).values() if w > 0))
    needed = list(dict.fromkeys([*used, *([tag_vector] if tag_queries is not None else [])]))
    rows = records.select(F.col(id_column).alias("id"), *[F.col(c).cast("array<double>").alias(c) for c in needed])
    ids, q_kind = records.schema[id_column].dataType.simpleString(), asked.schema[key].dataType.simpleString()
    t_kind = tag_queries.schema["tag"].dataType.simpleString() if tag_queries is not None else "string"
    schema = f"`{key}` {q_kind}, tag {t_kind}, `{id_column}` {ids}, score double"
    questions = list(_blocks(asked, key, list(used)))
    tags = list(asked_blocks(tag_queries, "tag")) if tag_queries is not None else []
    parts = []
    for k in range(max(len(questions), len(tags))):
        sent = spark.sparkContext.broadcast((questions[k] if k < len(questions) else None, tags[k] if k < len(tags) else None))

        def found(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            question, tag = sent.value
            types = pa.schema([(key, pa_of(q_kind)), ("tag", pa_of(t_kind)), (id_column, pa_of(ids)), ("score", pa.float64())])
            asks, tagged = Best(len(question[0]) if question else 0, top_k), Best(len(tag[0]) if tag else 0, each)
            for batch in batches:
                own, units = batch.column("id"), {c: unit_rows(batch.column(c)) for c in needed}
                for a, b in tiles(len(asks.seen), batch.num_rows):
                    asks.add(a, _weighted(question[1], units, used, total, a, b), own)
                for a, b in tiles(len(tagged.seen), batch.num_rows):
                    sizes, vectors = units[tag_vector]
                    scores = np.full((b - a, batch.num_rows), -np.inf)
                    scores[:, sizes > 0] = 0.0
                    for size, (at, n) in vectors.items():
                        if size in tag[1]:
                            which, m = part_of(tag[1][size], a, b)
                            scores[np.ix_(which, at)] = (m @ n.T).round(DIGITS)
                    tagged.add(a, scores, own)
            for best, names, at in ((asks, question and question[0], 0), (tagged, tag and tag[0], 1)):
                which, rows, scores = best.rows(types.field(2).type)
                if len(which):
                    columns = [pa.array([names[i] for i in which.tolist()], types.field(at).type), pa.nulls(len(which), types.field(1 - at).type)]
                    yield pa.RecordBatch.from_arrays([*(columns if at == 0 else columns[::-1]), rows, scores], schema=types)

        parts.append(rows.mapInArrow(found, schema))
    every = reduce(DataFrame.unionByName, parts).withColumn("asks", F.col(key).isNotNull())
    # one exchange for both: a question's rows, or a tag's, are ranked where they meet
    rank = F.row_number().over(Window.partitionBy("asks", key, "tag").orderBy(F.col("score").desc(), id_column))
    ranked = every.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("asks"), top_k).otherwise(each))
    hits = ranked.filter("asks").select(key, id_column, "score", "rank")
    return hits, None if tag_queries is None else ranked.filter("not asks").select("tag", id_column, F.col("rank").alias("rn"))


def pa_of(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _weighted(question: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], units: dict[str, tuple], used: dict[str, float], total: float, a: int, b: int) -> np.ndarray:
    """Questions a to b by records; -inf where a record has none of the vectors."""
    there = np.zeros(len(next(iter(units.values()))[0]), bool)
    out = np.zeros((b - a, len(there)))
    for name, weight in used.items():
        sizes, blocks = units[name]
        there |= sizes > 0
        for size, block in question[name].items():
            if size in blocks:
                (which, m), (at, own) = part_of(block, a, b), blocks[size]
                out[np.ix_(which, at)] += weight * (m @ own.T)
    out = (out / total).round(DIGITS)
    out[:, ~there] = -np.inf
    return out


def similar_tags(tag_vectors: DataFrame, asked: DataFrame, top_k: int = 15, threshold: float = 0.7, key: str = "qid") -> DataFrame:
    """(key, tag, similarity, tag_rank): of each question its top_k tags, by the best similarity of the tag's vector to any of
    the question's vectors asked(key, q), at least 0, over the threshold; ties by tag."""
    spark = asked.sparkSession
    t_kind, q_kind = tag_vectors.schema["tag"].dataType.simpleString(), asked.schema[key].dataType.simpleString()
    parts = []
    for names, block in asked_blocks(asked, key):
        known = {name: i for i, name in enumerate(dict.fromkeys(names))}
        of = np.array([known[x] for x in names], np.int64)
        owned = {}
        for size, (which, m) in block.items():  # a question's vectors stand together
            order = np.argsort(of[which], kind="stable")
            owned[size] = (of[which][order], m[order])
        sent = spark.sparkContext.broadcast((list(known), owned))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, owned = sent.value
            found = Best(len(keys), top_k, once=True)  # who is among the best of all is so in each block and task that gives its best score
            for batch in batches:
                _, vectors = unit_rows(batch.column("embedding"))
                for a, b in tiles(len(keys), batch.num_rows):
                    sim = np.zeros((b - a, batch.num_rows))
                    for size, (rows, m) in vectors.items():
                        which, own = part_of(owned[size], a, b) if size in owned else (np.zeros(0, np.int64), m[:0])
                        for i, j in tiles(len(own), len(rows)):
                            firsts = np.flatnonzero(np.append(True, which[i + 1 : j] != which[i : j - 1]))
                            at = np.ix_(which[i:j][firsts], rows)
                            sim[at] = np.maximum(sim[at], np.maximum.reduceat((own[i:j] @ m.T).round(DIGITS), firsts, axis=0))
                    sim[~(sim >= threshold)] = -np.inf
                    found.add(a, sim, batch.column("tag"))
            at, tag, similarity = found.rows(pa_of(t_kind))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at.tolist()], pa_of(q_kind)), tag, similarity], [key, "tag", "similarity"])

        rows = tag_vectors.select("tag", F.col("embedding").cast("array<double>").alias("embedding"))
        parts.append(rows.mapInArrow(best, f"`{key}` {q_kind}, tag {t_kind}, similarity double"))
    every = reduce(DataFrame.unionByName, parts).groupBy(key, "tag").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc(), "tag"))
    return every.withColumn("tag_rank", rank).filter(F.col("tag_rank") <= top_k)


def neighbours(records: DataFrame, hits: DataFrame, id_column: str, reach: int = 2) -> DataFrame:
    """(hit, adjacent, dist): records up to `reach` places beside each hit in its book, by (chapter, section, id); of records of
    one chapter and section the first stays. hits: ids, any number of them; equi-joins on (book, place)."""
    places = placed(records.select("book_id", "chapter_index", "section_index", id_column), "book_id", ["chapter_index", "section_index"], id_column)
    own = hits.select(id_column).distinct().join(places, id_column).select("book_id", F.col(id_column).alias("hit"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("dist"), "pos")
    near = places.join(own.withColumn("pos", F.col("pos") + F.col("dist")), ["book_id", "pos"])
    first = Window.partitionBy("hit", "chapter_index", "section_index").orderBy("pos")
    once = near.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return once.select("hit", F.col(id_column).alias("adjacent"), "dist")


def answered(records: DataFrame, asked: DataFrame, id_column: str = "vec_id", top_k: int = 5, weights: Mapping[str, float] | None = None, tag_vectors: DataFrame | None = None, tags_asked: DataFrame | None = None, threshold: float = 0.7, reach: int = 2, most: int = 3, key: str = "qid") -> DataFrame:
    """(key, rank, id, source, score, near) of each question: its hits in order of score, then up to `most` records that its tags
    find, top_k + most together; near: ids beside a hit, in order. tag_vectors(tag, embedding, q), tags_asked(key, q): vectors
    that stand for a question's tags. Questions are dealt by key; the records are scanned once."""
    similar = tag_queries = None
    if tag_vectors is not None:
        similar = similar_tags(tag_vectors, tags_asked, 15, threshold, key)
        tag_queries = similar.select("tag").distinct().join(tag_vectors.select("tag", "q"), "tag").filter(present(F.col("q")))
    hits, by_tag = searched(records, asked, id_column, top_k, weights, tag_queries, key=key)
    rows = hits.select(key, F.lit(0).alias("part"), F.col("rank").alias("k1"), F.lit(0).alias("k2"), id_column, F.lit("search").alias("source"), "score")
    if tag_vectors is not None:
        new = similar.join(by_tag, "tag").join(hits.select(key, id_column), [key, id_column], "left_anti")
        once = new.withColumn("again", F.row_number().over(Window.partitionBy(key, id_column).orderBy("tag_rank", "rn"))).filter("again = 1")
        some = once.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("tag_rank", "rn"))).filter(F.col("n") <= most)
        rows = rows.unionByName(some.select(key, F.lit(1).alias("part"), F.col("tag_rank").alias("k1"), F.col("rn").alias("k2"), id_column, F.lit("tag").alias("source"), F.lit(None).cast("double").alias("score")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("part", "k1", "k2"))).filter(F.col("rank") <= top_k + most)
    beside = neighbours(records, hits, id_column, reach).filter("dist <> 0").groupBy(F.col("hit").alias(id_column)).agg(F.array_sort(F.collect_list(F.struct("dist", "adjacent"))).alias("near"))
    out = ranked.join(beside, id_column, "left")
    near = F.when(F.col("source") == "search", F.transform("near", lambda n: n["adjacent"]))
    return out.select(key, "rank", id_column, "source", "score", near.alias("near"))
