"""Tags of sections: normalising, deduplication, lookup, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories of a tagged section (fixed values); each is also accepted with "_tags" behind its plural.
CATEGORIES = ("symptom", "herb", "formula", "pulse", "tongue", "syndrome", "pathogen", "treatment", "meridian", "organ", "acupoint", "element")


def category_of(key: Column) -> Column:
    """"symptom_tags" and "symptoms_tags" alike are "symptom"; null for other keys."""
    name = F.regexp_replace(key, "_tags$", "")
    return F.coalesce(*[F.when(name.isin(c, f"{c}s"), F.lit(c)) for c in CATEGORIES])


def tag_rows(sections: DataFrame) -> DataFrame:
    """Rows (chapter_id, section_id, pos, tag_zh, tag_en) of sections with an array of such tags; both names needed."""
    rows = sections.select("chapter_id", "section_id", F.posexplode("tags").alias("pos", "t")).select("chapter_id", "section_id", "pos", F.col("t.tag_zh").alias("tag_zh"), F.col("t.tag_en").alias("tag_en"))
    return rows.filter("tag_zh <> '' and tag_en <> ''")


def flattened(tags: DataFrame) -> DataFrame:
    """(category, name_zh, name_en, first_pos): of each name in a category the last tag, at the first one's place."""
    return tags.groupBy("category", "name_zh").agg(F.max_by("name_en", "pos").alias("name_en"), F.min("pos").alias("first_pos"))


def first_of_name(tags: DataFrame, name: str = "tag_zh", pos: str = "pos") -> DataFrame:
    """The first tag of each name."""
    rows = tags.select(F.struct(*[F.col(f"`{c}`") for c in tags.columns]).alias("row"), name, pos)
    return rows.groupBy(name).agg(F.min_by("row", pos).alias("row")).select("row.*")


def of_sections(sections: DataFrame, tagged: DataFrame) -> DataFrame:
    """sections with the tags of the first tagged entry that has their (chapter_id, section_id); none: empty array."""
    first = tagged.groupBy("chapter_id", "section_id").agg(F.min_by("tags", "pos").alias("tags"))
    kind = tagged.schema["tags"].dataType
    return sections.join(first, ["chapter_id", "section_id"], "left").withColumn("tags", F.coalesce("tags", F.array().cast(kind)))


def enhanced(text: Column, tags: Column) -> Column:
    """The text with a block of related tags behind it; without tags as it is."""
    lines = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("- "), t["tag_zh"], F.lit(" ("), t["tag_en"], F.lit(")"))), "\n")
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.concat(text, F.lit("\n\n[Related Tags]\n"), lines)).otherwise(text)


def selected(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Tags, repeated ones too, whose name is among names(tag_zh)."""
    return tags.join(names, "tag_zh", "left_semi")


def report(records: DataFrame) -> DataFrame:
    """One row on records with an array `tags` of names: how many, coverage, averages."""
    size = F.size("tags")
    counts = records.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(size > 0).alias("records_with_tags"), F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).cast("long").alias("total_tags"))
    unique = records.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("unique_tags"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 2)
    return counts.crossJoin(unique).withColumn("coverage", share(100.0 * F.col("records_with_tags"), F.col("total_records"))).withColumn("avg_tags", share(F.col("total_tags"), F.col("total_records")))


def most_common(records: DataFrame, k: int = 5) -> DataFrame:
    return records.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def latest(sections: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Upsert: of rows with equal keys the one of the highest seq."""
    order = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return sections.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
