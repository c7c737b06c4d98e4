"""Chunkers: each takes a frame of documents and gives one row per chunk.

Input columns: the key columns named by the caller, and `text`. Places are code points from 0. A chunk row has the
keys, chunk_index (from 0), text, type, title, and where they apply chapter_title, section_title, char_count,
token_count, preserved_complete.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.text import SPACE, bound, cut, is_blank, rfind, strip, token_estimate
from ..functions.tokens import Counter, counted, looked_up

Tokens = Callable[[Column], Column]
MAX_TOKENS = 7500
CHUNK = "struct<text:string,type:string,title:string,chapter_title:string,section_title:string,token_count:int,preserved_complete:boolean>"


# --- fixed size ----------------------------------------------------------------------------------

def regular_spans(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Array of (start, end): windows of `size` that end after the last full stop among their last 100 characters, or
    else after the last blank line among their last 200; each begins `overlap` before the end of the one before."""
    if size <= overlap:
        raise InvalidInput("size must exceed overlap")
    least = max(1, size - 197 - overlap)
    state = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def end_of(blocks: Column, n: Column, start: Column) -> Column:
        hard = start + size
        window = within(blocks, start, hard, size)

        def soft(w: Column) -> Column:
            stop, blank = rfind(w, "."), rfind(w, "\n\n")
            return F.when(stop > size - 100, start + stop + 1).when(blank > size - 200, start + blank + 2).otherwise(hard)

        return F.when(hard < n, bound(window, soft)).otherwise(hard)

    def step(blocks: Column, n: Column, s: Column) -> Column:
        grown = bound(end_of(blocks, n, s["start"]), lambda end: F.struct(F.greatest(end - overlap, s["start"] + 1).alias("start"), F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), end.alias("end")))).alias("spans")))
        return F.when(s["start"] < n, grown).otherwise(s)

    # steps in segments of about the root of their number, each with spans of its own: no array of all spans is copied again and again
    several = F.struct(F.lit(0).alias("start"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("parts"))

    def fold(known: Column) -> Column:
        blocks, n, segment = known["blocks"], known["n"], known["segment"]

        def further(s: Column) -> Column:
            own = F.aggregate(segment, F.struct(s["start"].alias("start"), state["spans"].alias("spans")), lambda t, _: step(blocks, n, t))
            grown = bound(own, lambda t: F.struct(t["start"].alias("start"), F.concat(s["parts"], F.array(t["spans"])).alias("parts")))
            return F.when(s["start"] < n, grown).otherwise(s)

        return F.flatten(F.aggregate(segment, several, lambda s, _: further(s))["parts"])

    # what the steps ask again and again is computed once, the length of the text too
    segment = F.sequence(F.lit(1), F.ceil(F.sqrt(F.floor(F.length(text) / least) + 1)).cast("int"))
    return bound(F.struct(blocked(text, size).alias("blocks"), F.length(text).alias("n"), segment.alias("segment")), fold)


def blocked(text: Column, size: int) -> Column:
    """The text in blocks of `size` characters, so that a window of it is found without reading what stands before."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))


def within(blocks: Column, start: Column, end: Column, size: int) -> Column:
    """text[start:end] of a text in blocks, at most `size` characters of it: of two blocks."""
    k = F.floor(start / size).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit("")))
    return cut(two, start - k * size, end - k * size)


def regular_pieces(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """The stripped texts of `regular_spans`, blank ones left out; none of a blank text."""
    pieces = bound(blocked(text, size), lambda blocks: F.transform(regular_spans(text, size, overlap), lambda s: strip(within(blocks, s["start"], s["end"], size))))
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.filter(pieces, lambda p: p != ""))


def _parts(text: Column, size: int, overlap: int, kind: str | Column, head: Column | None, chapter: Column, section: Column) -> Column:
    """Chunks of the regular pieces of a text; titles are "Chunk k", or "{head} (Part k)"."""
    label = (lambda k: F.concat(F.lit("Chunk "), k.cast("string"))) if head is None else (lambda k: F.concat(head, F.lit(" (Part "), k.cast("string"), F.lit(")")))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    whole = F.lit(None).cast("boolean") if head is None else F.lit(False)
    return F.transform(regular_pieces(text, size, overlap), lambda p, i: _chunk(p, kind, label(i + 1), chapter, section, F.lit(None).cast("int"), whole))


def _chunk(text: Column, kind: Column, title: Column, chapter: Column, section: Column, tokens: Column, whole: Column) -> Column:
    return F.struct(text.alias("text"), kind.alias("type"), title.alias("title"), chapter.alias("chapter_title"), section.alias("section_title"), tokens.alias("token_count"), whole.alias("preserved_complete"))



def _null() -> Column:
    return F.lit(None).cast("string")


# --- markers -------------------------------------------------------------------------------------

#: Lines that are a marker when stripped (fixed values), and the places where they begin.
MARKERS = {"#CHAPTER": "chapter", "#SECTION": "section", "#FORMULA": "formula"}
_INLINE = SPACE.replace(r"[\t-\r", r"[\t\x0b-\r")  # white space within a line
_AT_MARKER = rf"(?md)^(?={_INLINE}*(?:{'|'.join(MARKERS)}){_INLINE}*$)"


_MARKER = "kind:string,position:int,line_number:int,title:string"


def parted(text: Column) -> Column:
    """(pieces, found): the text parted at its marker lines, and its markers in order with `i`, the piece that each begins, and
    `chapter`, the title of the last chapter up to it. The fold goes over pieces, and takes the chapter along."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("chapter"), F.array().cast(f"array<struct<{_MARKER},i:int,chapter:string>>").alias("found"))

    def read(pieces: Column) -> Column:
        def step(s: Column, piece: Column) -> Column:
            head = F.substring_index(piece, "\n", 1)
            behind = F.substring(piece, F.length(head) + 2, F.length(piece))
            after = F.get(pieces, s["i"] + 1)  # begins with a marker's line
            line = F.when(F.length(piece) > F.length(head), F.substring_index(F.when((behind == "") & after.isNotNull(), after).otherwise(behind), "\n", 1))
            kind = F.coalesce(*[F.when(strip(head) == mark, F.lit(kind)) for mark, kind in MARKERS.items()])

            def grown(named: Column) -> Column:
                chapter = F.when(named["kind"] == "chapter", named["title"]).otherwise(s["chapter"])
                found = F.struct(named["kind"].alias("kind"), s["at"].alias("position"), (s["line"] + 1).alias("line_number"), named["title"].alias("title"), s["i"].alias("i"), chapter.alias("chapter"))
                lines = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
                return F.struct((s["i"] + 1).alias("i"), (s["at"] + F.length(piece)).alias("at"), (s["line"] + lines).alias("line"), chapter.alias("chapter"), F.when(named["kind"].isNotNull(), F.concat(s["found"], F.array(found))).otherwise(s["found"]).alias("found"))

            return bound(F.struct(kind.alias("kind"), F.coalesce(strip(line), F.concat(F.lit("Unknown "), F.initcap(kind))).alias("title")), grown)

        return F.struct(pieces.alias("pieces"), F.aggregate(pieces, state, step)["found"].alias("found"))

    return bound(F.split(text, _AT_MARKER), read)


def markers(text: Column) -> Column:
    """Array of (kind, position, line_number, title) of the lines that are #CHAPTER, #SECTION or #FORMULA when
    stripped; the title is the next line, stripped."""
    return F.transform(parted(text)["found"], lambda m: F.struct(*[m[c].alias(c) for c in ("kind", "position", "line_number", "title")]))


def marker_rows(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per marker: the keys, kind, position, line_number, title."""
    return docs.select(*keys, F.explode(markers(F.col("text"))).alias("m")).select(*keys, "m.*")


def _of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda m: m["kind"] == kind)


def _blocks(read: Column, kind: str) -> Column:
    """Each marker of a kind with the stripped text from it to the next of its kind: its pieces put together, so that all
    texts are read once. read: what `parted` gives."""
    pieces = read["pieces"]
    end = lambda heads, i: F.coalesce(F.get(heads, i + 1)["i"], F.size(pieces))
    return bound(_of_kind(read["found"], kind), lambda heads: F.transform(heads, lambda m, i: F.struct(m["title"].alias("title"), m["chapter"].alias("chapter"), strip(F.array_join(F.slice(pieces, m["i"] + 1, end(heads, i) - m["i"]), "")).alias("text"))))


# --- by chapter and section (types of chunks and the forms of titles are fixed values) ------------

def chapter_chunks(text: Column, fallback: int = 2000, max_tokens: int = MAX_TOKENS, tokens: Tokens = token_estimate, overlap: int = 200) -> Column:
    """Chunks of whole chapters. A chapter of too many tokens is cut at its sections, and what is still too long, or
    has no sections, in pieces of fixed size; a text without chapters is all pieces. Text before the first marker is
    left out."""

    def of_chapter(c: Column) -> Column:
        def by_section(read: Column) -> Column:
            def of_section(s: Column) -> Column:
                title = F.concat(c["title"], F.lit(" - "), s["title"])
                whole = F.array(_chunk(s["text"], F.lit("chapter_section"), title, c["title"], s["title"], tokens(s["text"]), F.lit(True)))
                return F.when(tokens(s["text"]) <= max_tokens, whole).otherwise(_parts(s["text"], fallback, overlap, "chapter_section_part", title, c["title"], s["title"]))

            pieces = _parts(c["text"], fallback, overlap, "chapter_part", c["title"], c["title"], _null())
            return bound(_blocks(read, "section"), lambda sections: F.when(F.size(sections) > 0, F.flatten(F.transform(sections, of_section))).otherwise(pieces))

        whole = F.array(_chunk(c["text"], F.lit("semantic_chapter"), c["title"], c["title"], _null(), tokens(c["text"]), F.lit(True)))
        return F.when(tokens(c["text"]) <= max_tokens, whole).otherwise(bound(parted(c["text"]), by_section))

    def cut_up(read: Column) -> Column:
        pieces = _parts(text, fallback, overlap, "regular", None, _null(), _null())
        return bound(_blocks(read, "chapter"), lambda chapters: F.when(F.size(chapters) > 0, F.flatten(F.transform(F.filter(chapters, lambda c: c["text"] != ""), of_chapter))).otherwise(pieces))

    return F.when(is_blank(text), F.array().cast(f"array<{CHUNK}>")).otherwise(bound(parted(text), cut_up))


def section_chunks(text: Column, fallback: int = 1500, max_tokens: int = MAX_TOKENS, tokens: Tokens = token_estimate) -> Column:
    """Chunks of whole sections, titled with the last chapter before them; too long ones in pieces of fixed size; a
    text without sections by chapters. Text before the first section is left out."""

    def cut_up(read: Column) -> Column:
        def of_section(s: Column) -> Column:
            chapter = F.coalesce(s["chapter"], F.lit("Unknown Chapter"))
            title = F.concat(chapter, F.lit(" - "), s["title"])
            whole = F.array(_chunk(s["text"], F.lit("semantic_section"), title, chapter, s["title"], tokens(s["text"]), F.lit(True)))
            return F.when(tokens(s["text"]) <= max_tokens, whole).otherwise(_parts(s["text"], fallback, 100, "section_part", title, chapter, s["title"]))

        by_chapter = chapter_chunks(text, fallback, max_tokens, tokens)
        return bound(_blocks(read, "section"), lambda sections: F.when(F.size(sections) > 0, F.flatten(F.transform(F.filter(sections, lambda s: s["text"] != ""), of_section))).otherwise(by_chapter))

    return F.when(is_blank(text), F.array().cast(f"array<{CHUNK}>")).otherwise(bound(parted(text), cut_up))


def hybrid_chunks(text: Column, by: str = "section", size: int = 1000, max_tokens: int = MAX_TOKENS, tokens: Tokens = token_estimate) -> Column:
    """By sections (or chapters) where a text has any marker of either kind, else pieces of fixed size."""
    marked = F.exists(markers(text), lambda m: m["kind"].isin("chapter", "section"))
    semantic = chapter_chunks(text, size, max_tokens, tokens) if by == "chapter" else section_chunks(text, size, max_tokens, tokens)
    return F.when(marked, semantic).otherwise(_parts(text, size, 100, "regular", None, _null(), _null()))


def _capped(by: Callable[..., Column]) -> Callable[..., Column]:
    """Chapters or sections kept whole up to a number of characters. Only the name and the cap of these two methods are
    known, so their splitting is designed here: that of the token-capped ones."""
    return lambda text, size, **_: by(text, size, max_tokens=size, tokens=lambda t: F.length(t).cast("int"))


METHODS: dict[str, tuple[Callable[..., Column], int]] = {
    "regular": (lambda text, size, overlap=50, **_: _parts(text, size, overlap, "regular", None, _null(), _null()), 500),
    "chapter": (_capped(chapter_chunks), 2000),
    "section": (_capped(section_chunks), 1500),
    "semantic_chapter": (lambda text, size, **kw: chapter_chunks(text, size, **kw), 2000),
    "semantic_section": (lambda text, size, **kw: section_chunks(text, size, **kw), 1500),
    "hybrid": (lambda text, size, **kw: hybrid_chunks(text, size=size, **kw), 1000),
}


def register(method: str, cutter: Callable[..., Column], size: int) -> None:
    """Adds a method: cutter(text, size, **options) gives an array of chunks (see `CHUNK`)."""
    METHODS[method] = (cutter, size)


def measured(text: Column) -> Column:
    """The distinct texts of a text whose tokens a chunker may ask for: its chapters, its sections, and theirs."""

    def of(read: Column) -> Column:
        chapters, sections = _blocks(read, "chapter"), _blocks(read, "section")
        inner = F.flatten(F.transform(chapters, lambda c: F.transform(bound(parted(c["text"]), lambda own: _blocks(own, "section")), lambda s: s["text"])))
        return F.array_distinct(F.concat(F.transform(chapters, lambda c: c["text"]), F.transform(sections, lambda s: s["text"]), inner))

    return F.coalesce(bound(parted(text), of), F.array().cast("array<string>"))


def chunked(docs: DataFrame, keys: Sequence[str], method: str = "regular", size: int | None = None, tokenizer: Counter | None = None, **options) -> DataFrame:
    """One row per chunk: the keys, chunk_index and the chunk's fields, char_count among them. tokenizer: counts the tokens
    of a list of texts; without one they are estimated."""
    if method not in METHODS:
        raise InvalidInput(f"unknown chunking method {method!r}; there are {', '.join(METHODS)}")
    cutter, default = METHODS[method]
    if tokenizer is not None:
        docs = docs.withColumn("_texts", measured(F.col("text"))).withColumn("_tokens", counted(F.col("_texts"), tokenizer))
        options["tokens"] = looked_up(F.col("_tokens"))
    rows = docs.select(*keys, F.posexplode(cutter(F.col("text"), size or default, **options)).alias("chunk_index", "c"))
    return rows.select(*keys, "chunk_index", "c.*").withColumn("char_count", F.length("text"))


def process_documents(files: DataFrame, method: str = "regular", size: int | None = None, **options) -> DataFrame:
    """Chunks of files (path, text) with what an index stores about each: chunk_id, source, chunk_index, total_chunks."""
    from ..functions.text import file_name, stem

    rows = chunked(files, ["path"], method, size, **options)
    return rows.select(
        F.concat_ws("_", stem(F.col("path")), F.col("chunk_index").cast("string")).alias("chunk_id"),
        file_name(F.col("path")).alias("source"),
        F.col("path").alias("file_path"),
        "chunk_index",
        F.count(F.lit(1)).over(Window.partitionBy("path")).alias("total_chunks"),
        F.lit(method).alias("chunking_method"),
        F.col("type").alias("chunk_type"),
        F.col("title").alias("chunk_title"),
        "text", "chapter_title", "section_title", "char_count", "token_count", "preserved_complete",
    )


# --- texts alone -----------------------------------------------------------------------------------

def texts_of(docs: DataFrame, method: str = "regular", size: int | None = None, **options) -> DataFrame:
    """Only the texts of the chunks of docs (text), in no order over documents: for callers that need no fields."""
    return chunked(docs, [], method, size, **options).select("text")


def by_chapters(docs: DataFrame, size: int = 2000) -> DataFrame:
    return texts_of(docs, "chapter", size)


def by_sections(docs: DataFrame, size: int = 1500) -> DataFrame:
    return texts_of(docs, "section", size)
