"""A layout for neighbours: records in the order of their book, dealt in shelves, so that a look beside a hit reads its shelf.

A shelf is a stretch of SPAN places of a book. The table is bucketed by shelf and sorted within the buckets, so what stands beside
some hits is found in the buckets of their shelves: Spark reads no others, joins without an exchange of the table, and what
it reads doesn't depend on how many other books there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import placed
from .retrieval import few, settled

#: Places of a shelf.
SPAN = 64


def shelf(book: Column, place: Column) -> Column:
    return F.xxhash64(book, F.floor(place / SPAN).cast("long"))


@dataclass
class Shelves:
    """The name of the table, and of the records' id in it."""

    name: str
    id_column: str

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


def shelved(records: DataFrame, name: str, path: str, id_column: str, buckets: int = 64) -> Shelves:
    """Writes book_id, chapter_index, section_index, id, pos and shelf of all records as a bucketed table at path."""
    keys = records.select("book_id", "chapter_index", "section_index", id_column)
    rows = placed(keys, "book_id", ["chapter_index", "section_index"], id_column).withColumn("shelf", shelf(F.col("book_id"), F.col("pos")))
    rows.repartition(buckets, "shelf").write.mode("overwrite").option("path", path).bucketBy(buckets, "shelf").sortBy("shelf", "pos").saveAsTable(name)
    return Shelves(name, id_column)


def places_of(spark: SparkSession, shelves: Shelves, hits: DataFrame) -> DataFrame:
    """(book_id, pos, id) of hits(id): a scan of ids, for callers whose hits don't bring their places along."""
    return shelves.table(spark).join(few(hits.select(shelves.id_column)), shelves.id_column).select("book_id", "pos", shelves.id_column)


def adjacent(spark: SparkSession, shelves: Shelves, hits: DataFrame, reach: int = 2) -> DataFrame:
    """(hit, adjacent, dist): up to `reach` places beside each of hits(book_id, pos, id), few of them; of records of one chapter and
    section the first. Only the buckets of the hits' shelves are read."""
    ask = hits.select(F.col(shelves.id_column).alias("hit"), "book_id", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("dist"), "pos")
    near = settled(ask.withColumn("pos", F.col("pos") + F.col("dist")).withColumn("shelf", shelf(F.col("book_id"), F.col("pos"))))
    wanted = sorted({r.shelf for r in near.select("shelf").distinct().collect()})  # of few hits
    rows = shelves.table(spark).filter(F.col("shelf").isin(wanted))
    found = rows.join(F.broadcast(near), ["shelf", "book_id", "pos"])
    first = Window.partitionBy("hit", "chapter_index", "section_index").orderBy("pos")
    return found.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("hit", F.col(shelves.id_column).alias("adjacent"), "dist")
