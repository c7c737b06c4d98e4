"""Parsers of marked-up books, each as expressions that turn a text into rows.

Three parsers exist because three consumers read the same markup by different rules; the differences are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, cut, strip

NO_TEXT = "<No text in section>"
DESCRIPTION = "<Chapter description>"


def _split(text: Column, mark: str) -> Column:
    return F.split(text, rf"(?md)^{mark}\s*")


def _parts(text: Column) -> Column:
    """Array of (n, place, part, body) of the n parts that #SECTION makes: their place, and the part as it is and
    stripped; blank ones are left out unless there is no other. All that a row needs lies in its own struct, so that an
    explode carries neither the text nor the array along."""
    part = lambda p, i, n: F.struct(n.alias("n"), i.alias("place"), p.alias("part"), strip(p).alias("body"))
    listed = lambda ps: F.filter(F.transform(ps, lambda p, i: part(p, i, F.size(ps))), lambda x: (x["n"] == 1) | (x["body"] != ""))
    return bound(_split(text, "#SECTION"), listed)


def _lines(text: Column) -> Column:
    """Lines at any line break; an ending one makes no empty line after it."""
    return F.split(F.regexp_replace(text, r"(\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}])\z", ""), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]")


def _rest(lines: Column) -> Column:
    return F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")


def _first(lines: Column) -> Column:
    return strip(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))


def tagging_sections(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, chapter_idx (place among the blocks that #CHAPTER parts, empty ones counted), chapter_title, section_idx,
    section_title, section_text. Text ahead of the first section is a section called <Chapter description>."""
    blocks = docs.select(*keys, F.posexplode(_split(F.col("text"), "#CHAPTER")).alias("chapter_idx", "block")).filter("block <> ''")
    lines = blocks.select(*keys, "chapter_idx", _lines(F.col("block")).alias("lines"))
    chapters = lines.select(*keys, "chapter_idx", _first(F.col("lines")).alias("chapter_title"), _parts(_rest(F.col("lines"))).alias("parts"))
    parts = chapters.select(*keys, "chapter_idx", "chapter_title", F.inline("parts")).withColumn("lines", _lines(F.col("part")))
    described = F.col("place") == 0
    text = F.when(described, F.col("body")).otherwise(strip(_rest(F.col("lines"))))
    order = Window.partitionBy(*keys, "chapter_idx").orderBy("place")
    return parts.select(
        *keys, "chapter_idx", "chapter_title",
        (F.row_number().over(order) - 1).alias("section_idx"),
        F.when(described, F.lit(DESCRIPTION)).otherwise(_first(F.col("lines"))).alias("section_title"),
        F.when(text == "", F.lit(NO_TEXT)).otherwise(text).alias("section_text"),
    )


def graph_sections(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, pos (order within the document), chapter, section, text. A chapter without sections is one called
    (whole chapter); text ahead of the first section is one whose title is its first line."""
    blocks = docs.select(*keys, F.posexplode(_split(F.col("text"), "#CHAPTER")).alias("block_no", "block")).withColumn("block", strip(F.col("block"))).filter("block <> ''")
    lines = blocks.select(*keys, "block_no", _lines(F.col("block")).alias("lines"))
    chapters = lines.select(*keys, "block_no", _first(F.col("lines")).alias("chapter"), _parts(_rest(F.col("lines"))).alias("parts"))
    parts = chapters.select(*keys, "block_no", "chapter", F.inline("parts")).withColumn("part", F.col("body")).withColumn("lines", _lines(F.col("part")))
    whole = F.col("n") == 1
    order = Window.partitionBy(*keys).orderBy("block_no", "place")
    return parts.select(
        *keys, (F.row_number().over(order) - 1).alias("pos"), "chapter",
        F.when(whole, F.lit("(whole chapter)")).otherwise(_first(F.col("lines"))).alias("section"),
        F.when(whole, F.col("part")).otherwise(strip(_rest(F.col("lines")))).alias("text"),
    )


def grouped_chapters(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, title, first_pos, sections: chapters of one title merged, their sections in order. The result of
    `graph_sections` is what it takes; a group is a chapter of one document."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "section", "text")))
    return sections.groupBy(*keys, F.col("chapter").alias("title")).agg(F.min("pos").alias("first_pos"), listed.alias("sections"))


def prompt_text(sections: Column) -> Column:
    """Sections (chapter, section, text) as numbered blocks for a prompt."""
    block = lambda s, i: F.concat(F.lit("[Section "), (i + 1).cast("string"), F.lit("] CHAPTER: "), s["chapter"], F.lit(" | SECTION: "), s["section"], F.lit("\n\n"), strip(s["text"]))
    return F.array_join(F.transform(sections, block), "\n\n")


def structured_sections(docs: DataFrame, keys: Sequence[str], chapter_pattern: str, section_pattern: str, least: int = 50, most: int = 4000) -> DataFrame:
    """Keys, chapter_index, chapter_title, section_index, section_title, subsection_index, content, in reading order
    `pos`. The patterns find headers anywhere in the text; content counts from `least` + 1 characters, and is cut in
    parts of `most`. Sections are numbered anew in each stretch between two chapter headers; an empty pattern finds
    nothing."""
    def tokens(text: Column, pattern: str) -> Column:
        """Headers (H) and what lies between (T), in order, each behind its letter."""
        clean = F.replace(text, F.lit("\x01"), F.lit(""))
        return F.split(F.concat(F.lit("T"), F.regexp_replace(clean, f"(?:{pattern})", "\x01H$0\x01T") if pattern else clean), "\x01")

    def read(name: str, piece: str) -> list[Column]:
        return [F.startswith(piece, F.lit("H")).alias(f"is_{name}"), strip(F.substring(piece, 2, 1 << 30)).alias("content")]

    chapters = docs.select(*keys, F.posexplode(tokens(F.col("text"), chapter_pattern)).alias("outer", "piece"))
    chapters = chapters.select(*keys, "outer", "piece", *read("chapter", "piece")).filter("content <> ''")
    reading = Window.partitionBy(*keys).orderBy("outer").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("is_chapter"), F.col("content")), ignorenulls=True).over(reading)
    titled = chapters.withColumns({"chapter_index": F.sum(F.col("is_chapter").cast("int")).over(reading), "chapter_title": F.coalesce(title, F.lit("Unknown Chapter"))})
    inner = titled.filter(~F.col("is_chapter")).select(*keys, "outer", "chapter_index", "chapter_title", F.posexplode(tokens(F.substring("piece", 2, 1 << 30), section_pattern)).alias("place", "piece"))
    bodies = inner.select(*keys, "outer", "chapter_index", "chapter_title", "place", *read("section", "piece")).filter("content <> ''")
    within = Window.partitionBy(*keys, "outer").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("is_section"), F.col("content")), ignorenulls=True).over(within)
    bodies = bodies.withColumns({"section_index": F.sum(F.col("is_section").cast("int")).over(within), "section_title": F.coalesce(title, F.lit(""))})
    kept = bodies.filter(~F.col("is_section") & (F.length("content") > least))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / most).cast("int")), lambda k: strip(cut(F.col("content"), k * most, (k + 1) * most)))
    pieces = F.filter(pieces, lambda p: p != "")
    long = F.length("content") > most
    listed = F.transform(pieces, lambda p, k: F.struct(k.alias("k"), p.alias("part"), long.alias("long")))
    parts = kept.select(*keys, "outer", "place", "chapter_index", "chapter_title", "section_index", "section_title", F.inline(listed))
    title = F.when(F.col("long"), F.concat("section_title", F.lit(" (Part "), (F.col("k") + 1).cast("string"), F.lit(")"))).otherwise(F.col("section_title"))
    return parts.select(*keys, F.col("outer").alias("pos"), F.col("place").alias("inner_pos"), "chapter_index", "chapter_title", "section_index", title.alias("section_title"), F.when(F.col("long"), F.col("k") + 1).otherwise(F.lit(0)).alias("subsection_index"), F.col("part").alias("content"))
