"""Table functions for SQL: chunks of a text by LATERAL, sections of lines by PARTITION BY.

    select d.doc_id, c.* from documents d, lateral chunks(d.text, 'regular') c
    select * from sections(table(lines) partition by doc_id order by line_number)

`register` makes them known to a session. Their columns are settled when a statement is analysed: an unknown method, or a table
without the columns that are needed, is an error before anything runs. They are the SQL face of `operators.chunking` for
users without the DataFrame API, who lose code generation by them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .text import STRIPPED

#: Methods of `chunks`: the size, and the overlap, of a window.
SIZES = {"regular": (500, 50), "wide": (2000, 200)}
MARKERS = {"#CHAPTER": "chapter", "#SECTION": "section", "#FORMULA": "formula"}


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of `size` characters that end after a full stop or a blank line near their end; see `regular_spans`."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            stop, blank = text.rfind(".", start, end) - start, text.rfind("\n\n", start, end) - start
            if stop > size - 100:
                end = start + stop + 1
            elif blank > size - 200:
                end = start + blank + 2
        yield start, end
        start = max(end - overlap, start + 1)


class Chunks:
    @staticmethod
    def analyze(text: AnalyzeArgument, method: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError("chunks: the first argument is a text")
        if not method.isConstantExpression or method.value not in SIZES:
            raise ValueError(f"chunks: the second argument is one of {', '.join(SIZES)}")
        if any(x is not None and not x.isConstantExpression for x in (size, overlap)):
            raise ValueError("chunks: size and overlap are constants")
        given = SIZES[method.value]
        if (size.value if size is not None else given[0]) <= (overlap.value if overlap is not None else given[1]):
            raise ValueError("chunks: size must exceed overlap")
        return AnalyzeResult(StructType().add("chunk_index", IntegerType()).add("n_chars", IntegerType()).add("text", StringType()).add("title", StringType()))

    def eval(self, text: str | None, method: str, size: int | None = None, overlap: int | None = None) -> Iterator[tuple]:
        given = SIZES[method]
        pieces = (text[a:b].strip(STRIPPED) for a, b in spans(text or "", size or given[0], given[1] if overlap is None else overlap))
        for i, piece in enumerate(p for p in pieces if p):
            yield i, len(piece), piece, f"Chunk {i + 1}"


class Sections:
    """Of the lines of a partition, in order, the #SECTION markers with their titles and the chapter that they stand in."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"line_number", "line"} <= set(rows.dataType.names):
            raise ValueError("sections: a table with line_number and line")
        own = [f for f in rows.dataType if f.name not in ("line_number", "line")]
        schema = StructType(own).add("line_number", IntegerType()).add("section_title", StringType()).add("chapter_title", StringType())
        return AnalyzeResult(schema)

    def __init__(self) -> None:
        self.open: tuple | None = None  # the marker whose title is the next line
        self.chapter: str | None = None

    def eval(self, row) -> Iterator[tuple]:
        values = row.asDict()
        number, line = values.pop("line_number"), values.pop("line")
        yield from self._titled(line.strip(STRIPPED))
        if kind := MARKERS.get(line.strip(STRIPPED)):
            self.open = (kind, number, tuple(values.values()))

    def terminate(self) -> Iterator[tuple]:
        yield from self._titled(None)

    def _titled(self, title: str | None) -> Iterator[tuple]:
        if self.open is None:
            return
        kind, number, own = self.open
        self.open, title = None, f"Unknown {kind.title()}" if title is None else title
        if kind == "chapter":
            self.chapter = title
        elif kind == "section":
            yield *own, number, title, self.chapter


def register(spark: SparkSession) -> None:
    """Makes `chunks` and `sections` known to the session's SQL."""
    spark.udtf.register("chunks", udtf(Chunks, useArrow=False))
    spark.udtf.register("sections", udtf(Sections, useArrow=False))
