"""An index kept up to date by content: only sections that have changed are extracted and embedded again.

A version of an index is a table of commits (`sources.commits`). Each record has the digest of its section; a refresh parses the
books, compares digests with the last version's and builds the records that are new. Records that are gone leave the table and
are named in a table of tombstones; those that stay keep their vec_id and vectors, wherever they have moved to in the book.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.commits import CommitTable
from .ordering import consecutive, discard, written

#: What tells where a section stands; it may change while the content stays.
PLACE = ["chapter_index", "section_index"]


def digested(sections: DataFrame) -> DataFrame:
    """sections(book_id, chapter_index, section_index, content) with digest, and occurrence: the how-manieth of its book with
    that digest. (book_id, digest, occurrence) is a record's identity."""
    rows = sections.withColumn("digest", F.coalesce(F.sha2(F.col("content"), 256), F.lit("none")))
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("book_id", "digest").orderBy(*PLACE)))


IDENTITY = ["book_id", "digest", "occurrence"]


def refreshed(spark: SparkSession, path: str, sections: DataFrame, build: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Brings the index at path up to sections; gives how many records were built, moved, kept and removed.

    build(sections) adds the columns that cost something (contents, vectors) and is called on new sections only. vec_id: of
    what stays, its own; of what is new, the next numbers in order of book and place. Removed ids aren't given again. Readers of
    the version before aren't disturbed; tombstones (vec_id, identity, version) are written before the rows go.
    """
    index, gone = CommitTable(spark, f"{path}/records"), CommitTable(spark, f"{path}/tombstones")
    now = written(digested(sections), "refresh-sections")
    first = index.version() is None
    old = None if first else index.read()
    fresh = now if first else now.join(old.select(*IDENTITY), IDENTITY, "left_anti")
    last = -1
    if not first:
        highest = [index.read().agg(F.max("vec_id")).first()[0], gone.read().agg(F.max("vec_id")).first()[0] if gone.version() is not None else None]
        last = max((h for h in highest if h is not None), default=-1)
    numbered = consecutive(fresh, ["book_id", *PLACE, "digest"]).withColumn("vec_id", F.col("vec_id") + F.lit(last + 1))
    made = written(build(numbered), "refresh-made")  # numbered before, as dealing rows in ranges computes them twice
    built = made.count()
    if first:
        index.append(made)
        counts = {"built": built, "moved": 0, "kept": 0, "removed": 0}
    else:
        places = now.select(*IDENTITY, *[F.col(c).alias(f"_{c}") for c in PLACE])
        stays = old.join(places, IDENTITY)
        changed = F.lit(False)
        for c in PLACE:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        moved = written(stays.filter(changed).select(*[F.col(f"_{c}").alias(c) if c in PLACE else F.col(c) for c in old.columns]), "refresh-moved")
        dead = written(old.join(now.select(*IDENTITY), IDENTITY, "left_anti").select("vec_id", *IDENTITY), "refresh-gone")
        counts = {"built": built, "moved": moved.count(), "removed": dead.count()}
        counts["kept"] = stays.count() - counts["moved"]
        if counts["removed"]:
            gone.append(dead.withColumn("version", F.lit(index.version() + 1).cast("long")))
            index.delete(dead.select("vec_id"), ["vec_id"])
        if built or counts["moved"]:
            index.upsert(made.select(*old.columns).unionByName(moved), ["vec_id"])
        discard(moved, dead)
    discard(now, made)
    return counts
