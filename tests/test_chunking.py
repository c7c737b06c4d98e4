from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import chunking as C
from millrace.operators import parsing as P


def spans(spark, text, size=500, overlap=50):
    df = spark.createDataFrame([(text,)], "text string").select(C.regular_spans(F.col("text"), size, overlap).alias("s"))
    return [(x.start, x.end) for x in df.first().s]


def loop(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            dot, gap = text.rfind(".", start, end), text.rfind("\n\n", start, end)
            if dot >= 0 and dot > start + size - 100:
                end = dot + 1
            elif gap >= 0 and gap > start + size - 200:
                end = gap + 2
        out.append((start, end))
        start = max(end - overlap, start + 1)
    return out


def test_tail_chunks(spark):
    assert [s for s, _ in spans(spark, "x" * 960)] == [0, 450, 900]
    assert [s for s, _ in spans(spark, "x" * 500)] == [0, 450]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["word ", "é", ".", "\n\n", "x" * 60, "世界"]), max_size=120))
def test_spans_equal_a_loop(spark, parts):
    text = "".join(parts)
    for size, overlap in ((500, 50), (300, 100), (120, 20)):
        assert spans(spark, text, size, overlap) == loop(text, size, overlap)


def test_small_chunks_end(spark):
    assert len(spans(spark, "abc" * 100, 60, 50)) == len(loop("abc" * 100, 60, 50))


def test_marker_on_last_line(spark):
    df = spark.createDataFrame([(1, "#CHAPTER\nOne\n #SECTION ")], "id long, text string")
    assert [tuple(r) for r in C.marker_rows(df, ["id"]).collect()] == [(1, "chapter", 0, 1, "One"), (1, "section", 13, 3, "Unknown Section")]


def test_oversize_chapter_is_cut_at_its_sections(spark):
    text = "preface\n#CHAPTER\nA\nshort\n#CHAPTER\nB\n" + "".join(f"#SECTION\nS{k}\n{'y' * 300}\n" for k in range(2))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = [(r.type, r.title, r.preserved_complete) for r in C.chunked(df, ["id"], "semantic_chapter", max_tokens=100).collect()]
    assert got == [("semantic_chapter", "A", True), ("chapter_section", "B - S0", True), ("chapter_section", "B - S1", True)]


def test_blank_text_has_no_chunks_and_unknown_method_is_an_error(spark):
    df = spark.createDataFrame([(1, " \n"), (2, None)], "id long, text string")
    for method in C.METHODS:
        assert C.chunked(df, ["id"], method).count() == 0
    with pytest.raises(ValueError):
        C.chunked(df, ["id"], "none")


def test_parsers_disagree_on_a_prologue(spark):
    df = spark.createDataFrame([(1, "#CHAPTER\nOne\nprologue\nmore\n#SECTION\nS\ntext\n#SECTION\n \n#CHAPTER\nTwo\n")], "id long, text string")
    tagging = [(r.chapter_idx, r.section_idx, r.section_title, r.section_text) for r in P.tagging_sections(df, ["id"]).orderBy("chapter_idx", "section_idx").collect()]
    assert tagging == [(1, 0, "<Chapter description>", "prologue\nmore"), (1, 1, "S", "text"), (2, 0, "<Chapter description>", "<No text in section>")]
    flat = [(r.chapter, r.section, r.text) for r in P.graph_sections(df, ["id"]).orderBy("pos").collect()]
    assert flat == [("One", "prologue", "more"), ("One", "S", "text"), ("Two", "(whole chapter)", "")]


def test_structured_sections(spark):
    text = "lead " * 20 + "Chapter 1 " + "Sec A " + "a" * 60 + " Sec B " + "b" * 4100 + "Chapter 2 " + "c" * 51 + "Sec A short"
    df = spark.createDataFrame([("k", text)], "book string, text string")
    rows = P.structured_sections(df, ["book"], "Chapter [0-9]+", "Sec [AB]").orderBy("pos", "inner_pos", "subsection_index").collect()
    got = [(r.chapter_index, r.chapter_title, r.section_index, r.section_title, len(r.content)) for r in rows]
    assert got == [(0, "Unknown Chapter", 0, "", 99), (1, "Chapter 1", 1, "Sec A", 60), (1, "Chapter 1", 2, "Sec B (Part 1)", 4000), (1, "Chapter 1", 2, "Sec B (Part 2)", 100), (2, "Chapter 2", 0, "", 51)]
