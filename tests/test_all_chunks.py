"""All chunks of the semantic chunkers, whatever their type, against a plain parser of lines."""

from __future__ import annotations

import hashlib
import math

import pytest
from conftest import SMALL

from millrace.operators import chunking
from millrace.plans import text_queries

KINDS = {"#CHAPTER": "chapter", "#SECTION": "section", "#FORMULA": "formula"}


def tokens(text):
    return math.ceil(len(text) / 4)


def pieces(text, size, overlap):
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


def blocks(text, kind):
    """(title, place, text) of the blocks that a kind of marker begins, and (title, place) of the markers."""
    lines, at, heads = text.split("\n"), 0, []
    for i, line in enumerate(lines):
        if KINDS.get(line.strip()) == kind:
            heads.append((lines[i + 1].strip() if i + 1 < len(lines) else f"Unknown {kind.title()}", at))
        at += len(line) + 1
    ends = [p for _, p in heads[1:]] + [len(text)]
    return [(t, p, text[p:e].strip()) for (t, p), e in zip(heads, ends)], heads


def parts(text, size, overlap, kind, head, chapter, section):
    return [(kind, f"{head} (Part {k})" if head is not None else f"Chunk {k}", chapter, section, p, None) for k, p in enumerate(pieces(text, size, overlap), 1)]


def by_chapter(text, size, most):
    own, heads = blocks(text, "chapter")
    if not heads:
        return parts(text, size, 200, "regular", None, None, None)
    out = []
    for title, _, chapter in own:
        if tokens(chapter) <= most:
            out.append(("semantic_chapter", title, title, None, chapter, tokens(chapter)))
        elif sections := blocks(chapter, "section")[0]:
            for name, _, s in sections:
                if tokens(s) <= most:
                    out.append(("chapter_section", f"{title} - {name}", title, name, s, tokens(s)))
                else:
                    out += parts(s, size, 200, "chapter_section_part", f"{title} - {name}", title, name)
        else:
            out += parts(chapter, size, 200, "chapter_part", title, title, None)
    return out


def by_section(text, size, most):
    own, heads = blocks(text, "section")
    chapters = blocks(text, "chapter")[1]
    if not heads:
        return by_chapter(text, size, most)
    out = []
    for name, at, s in own:
        chapter = next((t for t, p in reversed(chapters) if p <= at), "Unknown Chapter")
        if tokens(s) <= most:
            out.append(("semantic_section", f"{chapter} - {name}", chapter, name, s, tokens(s)))
        else:
            out += parts(s, size, 100, "section_part", f"{chapter} - {name}", chapter, name)
    return out


def rows_of(doc, chunks):
    return [(doc, k, *c[:4], len(c[4]), c[5], hashlib.md5(c[4].encode()).hexdigest()) for k, c in enumerate(chunks)]


@pytest.mark.parametrize("query, parse, size", [(text_queries.chapter_chunks, by_chapter, 2000), (text_queries.section_chunks, by_section, 1500)])
def test_queries(spark, query, parse, size):
    books = [(r.doc_id, r.text) for r in text_queries.books(spark, SMALL).collect()]
    want = [x for d, t in books for x in rows_of(d, parse(t, size, 7500) if t and t.strip() else [])]
    assert sorted(map(tuple, query(spark, SMALL).collect()), key=repr) == sorted(want, key=repr)


LONG = "ahead\n#CHAPTER\nA\nintro. " + "text one. " * 60 + "\n#SECTION\nS1\nshort\n#SECTION\nS2\n" + "long words here " * 90 + "\n#CHAPTER\nB\n" + "no section\n\n" * 120 + "#CHAPTER\nC\ntiny"


@pytest.mark.parametrize("most", [1, 40, 200, 10_000])
@pytest.mark.parametrize("method, parse, size", [("semantic_chapter", by_chapter, 400), ("semantic_section", by_section, 300)])
def test_oversize(spark, most, method, parse, size):
    docs = [(1, LONG), (2, "plain text. " * 100), (3, LONG.replace("#SECTION", "#OTHER")), (4, "#SECTION\nonly\n" + "x" * 900)]
    got = chunking.chunked(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], method, size, max_tokens=most)
    got = got.selectExpr("doc_id", "chunk_index", "type", "title", "chapter_title", "section_title", "char_count", "token_count", "md5(text)")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((x for d, t in docs for x in rows_of(d, parse(t, size, most))), key=repr)
