"""Parsers of long texts: four times the sections take about four times as long."""

from __future__ import annotations

import time

import pytest

from millrace.operators import chunking, parsing


def book(sections: int) -> str:
    return "#CHAPTER\nOne\nahead\n" + "".join(f"#SECTION\nTitle {i}\nsome text of the section {i}\n" for i in range(sections))


def seconds(make, *sizes: int) -> list[float]:
    make(sizes[0])
    out = []
    for n in sizes:
        began = time.perf_counter()
        make(n)
        out.append(time.perf_counter() - began)
    return out


@pytest.mark.parametrize("parse", [parsing.graph_sections, parsing.tagging_sections])
def test_sections(spark, parse):
    def run(n):
        assert parse(spark.createDataFrame([(1, book(n))], "doc_id long, text string"), ["doc_id"]).count() == n + 1

    small, large = seconds(run, 4_000, 16_000)
    assert large < 8 * small + 1


def test_markers(spark):
    def run(n):
        assert chunking.marker_rows(spark.createDataFrame([(1, book(n))], "doc_id long, text string"), ["doc_id"]).count() == n + 1

    small, large = seconds(run, 2_000, 8_000)
    assert large < 12 * small + 1


@pytest.mark.parametrize("text", ["", "#SECTION", " #CHAPTER \n#SECTION\n", "#FORMULA\n\n#CHAPTER\n a \r\n#SECTIONS\n\t#SECTION\x0b\nb", "x#CHAPTER\n#CHAPTER y\n", "#CHAPTER\r\nt\n　#SECTION　\nlast"])
def test_markers_equal_a_scan_of_lines(spark, text):
    kinds = {"#CHAPTER": "chapter", "#SECTION": "section", "#FORMULA": "formula"}
    lines, at, want = text.split("\n"), 0, []
    for i, line in enumerate(lines):
        if line.strip() in kinds:
            kind = kinds[line.strip()]
            want.append((kind, at, i + 1, lines[i + 1].strip() if i + 1 < len(lines) else f"Unknown {kind.title()}"))
        at += len(line) + 1
    got = chunking.marker_rows(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)


def test_windows_of_blocks(spark):
    """Spans of a text equal those by slices of it."""
    text = "".join("é" if i % 7 else ". " for i in range(5_000)) + "\n\n" + "x" * 3_000 + "\U0001f600" * 700

    def spans(size, overlap):
        out, start = [], 0
        while start < len(text):
            end = start + size
            if end < len(text):
                window = text[start:end]
                stop, blank = window.rfind("."), window.rfind("\n\n")
                end = start + stop + 1 if stop > size - 100 else start + blank + 2 if blank > size - 200 else end
            out.append(text[start:end].strip())
            start = max(end - overlap, start + 1)
        return [p for p in out if p]

    for size, overlap in ((500, 50), (1000, 100), (210, 3)):
        got = chunking.chunked(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], size=size, overlap=overlap).orderBy("chunk_index").collect()
        assert [r.text for r in got] == spans(size, overlap)


@pytest.mark.parametrize("method", ["semantic_section", "semantic_chapter"])
def test_semantic_chunks(spark, method):
    def run(n):
        rows = chunking.chunked(spark.createDataFrame([(1, book(n))], "doc_id long, text string"), ["doc_id"], method, max_tokens=100)
        assert rows.count() >= n

    small, large = seconds(run, 2_000, 4_000)
    assert large < 3 * small + 1


def test_regular_chunks(spark):
    def run(n):
        assert chunking.chunked(spark.createDataFrame([(1, "word. " * n)], "doc_id long, text string"), ["doc_id"], size=60, overlap=5).count() > n / 20

    small, large = seconds(run, 20_000, 80_000)
    assert large < 8 * small + 1
