"""Queries of parsing, chunking and text functions.

A document's book is its text under a chapter with the source's name, each further line a section; documents whose id
divides by three get a second chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import listings as L
from ..operators import parsing as P
from .registry import ORACLES, query, table

_SP = X.SPACE
_STRIP = lambda x: f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"
_BOOK = "'#CHAPTER' || chr(10) || source || chr(10) || replace(text, chr(10), chr(10) || '#SECTION' || chr(10)) || case when doc_id % 3 = 0 then chr(10) || '#CHAPTER' || chr(10) || 'Appendix ' || lang || chr(10) || '#FORMULA' || chr(10) || ' end ' else '' end"
_BOOKS = f"b as (select doc_id, {_BOOK} as text from documents)"
#: Lines of a book with their number and place, and the markers among them.
_LINES = f"""l as (select doc_id, n, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as position,
  lead(line) over (partition by doc_id order by n) as next from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from b)),
m as (select doc_id, case {_STRIP('line')} when '#CHAPTER' then 'chapter' when '#SECTION' then 'section' else 'formula' end as kind, position, n as line_number, {_STRIP('next')} as title, next from l where {_STRIP('line')} in ('#CHAPTER', '#SECTION', '#FORMULA')),
k as (select doc_id, kind, cast(position as integer) as position, cast(line_number as integer) as line_number, coalesce(title, 'Unknown ' || upper(kind[1]) || kind[2:]) as title from m)"""


def book() -> Column:
    nl = F.lit("\n")
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n#CHAPTER\nAppendix "), "lang", F.lit("\n#FORMULA\n end "))).otherwise("")
    return F.concat(F.lit("#CHAPTER"), nl, "source", nl, F.replace("text", nl, F.lit("\n#SECTION\n")), more)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", book().alias("text"))


def _windows(source: str, size: int, overlap: int) -> str:
    """Recursive SQL of the spans of regular chunks of source(doc_id, text)."""
    return f"""w as (select doc_id, text, length(text) as len, 0 as start, {_end('0', size)} as stop from {source} where length(text) > 0
union all select doc_id, text, len, stop - {overlap}, {_end(f'(stop - {overlap})', size)} from w where stop - {overlap} < len)"""


def _end(start: str, size: int) -> str:
    window = f"substr(text, {start} + 1, {size})"
    dot = f"{size} - instr(reverse({window}), '.')"
    blank = f"{size} - instr(reverse({window}), chr(10) || chr(10)) - 1"
    return f"case when {start} + {size} >= length(text) then {start} + {size} when instr(reverse({window}), '.') > 0 and {dot} > {size - 100} then {start} + {dot} + 1 when instr(reverse({window}), chr(10) || chr(10)) > 0 and {blank} > {size - 200} then {start} + {blank} + 2 else {start} + {size} end"


@query(f"""with recursive d as (select doc_id, text from documents), {_windows('d', 500, 50)},
p as (select doc_id, start, {_STRIP('substr(text, start + 1, stop - start)')} as piece from w)
select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) as chunk_index, cast(length(piece) as integer) as n_chars, piece as text, 'Chunk ' || row_number() over (partition by doc_id order by start) as title from p where piece <> ''""")
def regular_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunked(table(spark, sf_dir, "documents"), ["doc_id"], "regular").select("doc_id", "chunk_index", F.col("char_count").alias("n_chars"), "text", "title")


@query(f"with {_BOOKS}, {_LINES} select doc_id, kind, position, line_number, title from k")
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.marker_rows(books(spark, sf_dir), ["doc_id"])


_SECTIONS = f"""s as (select k.doc_id, k.title as section_title, k.position, lead(k.position) over (partition by k.doc_id order by k.position) as stop,
  (select max_by(c.title, c.position) from k c where c.doc_id = k.doc_id and c.kind = 'chapter' and c.position <= k.position) as chapter_title from k where kind = 'section'),
t as (select s.*, {_STRIP('substr(b.text, s.position + 1, coalesce(s.stop, length(b.text)) - s.position)')} as piece from s join b using (doc_id))"""
_CHAPTERS = f"""c as (select k.doc_id, k.title, k.position, lead(k.position) over (partition by k.doc_id order by k.position) as stop from k where kind = 'chapter'),
t as (select c.*, {_STRIP('substr(b.text, c.position + 1, coalesce(c.stop, length(b.text)) - c.position)')} as piece from c join b using (doc_id))"""


@query(f"""with {_BOOKS}, {_LINES}, {_SECTIONS}
select doc_id, chapter_title, section_title, coalesce(chapter_title, 'Unknown Chapter') || ' - ' || section_title as title, cast(length(piece) as integer) as n_chars, cast(ceil(length(piece) / 4.0) as integer) as token_count, 'semantic_section' as type from t where ceil(length(piece) / 4.0) <= 7500
""")
def semantic_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sections; those of one-line books come as chapters, and oversize ones in parts (see `section_parts`)."""
    rows = C.chunked(books(spark, sf_dir), ["doc_id"], "semantic_section").filter("type = 'semantic_section'")
    return rows.select("doc_id", "chapter_title", "section_title", "title", F.col("char_count").alias("n_chars"), "token_count", "type")


@query(f"""with recursive {_BOOKS}, {_LINES}, {_SECTIONS.replace('t as', 'sec as')}, o as (select row_number() over () as doc_id, sec.doc_id as doc, position, chapter_title || ' - ' || section_title as title, piece as text from sec where ceil(length(piece) / 4.0) > 100),
{_windows('o', 1500, 100)}, p as (select doc_id, start, {_STRIP('substr(text, start + 1, stop - start)')} as piece from w)
select o.doc as doc_id, o.title || ' (Part ' || row_number() over (partition by p.doc_id order by p.start) || ')' as title, cast(length(p.piece) as integer) as n_chars, 'section_part' as type from p join o using (doc_id) where p.piece <> ''""")
def section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of more than 100 tokens, in parts."""
    rows = C.chunked(books(spark, sf_dir), ["doc_id"], "semantic_section", max_tokens=100).filter("type = 'section_part'")
    return rows.select("doc_id", "title", F.col("char_count").alias("n_chars"), "type")


@query(f"with {_BOOKS}, {_LINES}, {_CHAPTERS} select doc_id, title as chapter, cast(length(piece) as integer) as n_chars, 'semantic_chapter' as type from t where ceil(length(piece) / 4.0) <= 7500")
def semantic_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.chunked(books(spark, sf_dir), ["doc_id"], "semantic_chapter").filter("type = 'semantic_chapter'")
    return rows.select("doc_id", F.col("chapter_title").alias("chapter"), F.col("char_count").alias("n_chars"), "type")


@query(f"""with recursive {_BOOKS}, {_LINES}, {_SECTIONS.replace('t as', 'sec as')}, {_CHAPTERS.replace('t as', 'cha as')}, d as (select doc_id, text from documents where doc_id % 2 = 0), {_windows('d', 1000, 100)},
p as (select doc_id, {_STRIP('substr(text, start + 1, stop - start)')} as piece from w),
x as (select doc_id, 'regular' as type from p where piece <> '' union all select doc_id, 'semantic_section' from sec where doc_id % 2 <> 0 union all select doc_id, 'semantic_chapter' from cha where doc_id % 2 <> 0 and doc_id not in (select doc_id from sec))
select doc_id, type, count(*) as n from x group by all""")
def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of even ids as they are, books of the others."""
    mixed = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(book()).alias("text"))
    return C.chunked(mixed, ["doc_id"], "hybrid", max_tokens=1_000_000).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def _all_chunks(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    rows = C.chunked(books(spark, sf_dir), ["doc_id"], method)
    return rows.select("doc_id", "chunk_index", "type", "title", "chapter_title", "section_title", F.col("char_count").alias("n_chars"), "token_count", F.md5("text").alias("text_md5"))


def _named_windows(name: str, source: str, size: int, overlap: int) -> str:
    return _windows(source, size, overlap).replace("w as (", f"{name} as (").replace("from w where", f"from {name} where")


#: What is too long, as rows (doc_id, doc, position, type, title, chapter_title, section_title, text), in pieces.
_PIECES = lambda w, o: f"select o.doc, o.position, row_number() over (partition by x.doc_id order by x.start) as part, o.type, o.title || ' (Part ' || row_number() over (partition by x.doc_id order by x.start) || ')' as title, o.chapter_title, o.section_title, x.piece, cast(null as integer) as token_count from (select doc_id, start, {_STRIP('substr(text, start + 1, stop - start)')} as piece from {w}) x join {o} o using (doc_id) where x.piece <> ''"
_TOKENS = "cast(ceil(length(piece) / 4.0) as integer)"
_CHUNK_ROWS = "select doc as doc_id, cast(row_number() over (partition by doc order by position, part) - 1 as integer) as chunk_index, type, title, chapter_title, section_title, cast(length(piece) as integer) as n_chars, token_count, md5(piece) as text_md5 from u"


@query(f"""with recursive {_BOOKS}, {_LINES}, {_CHAPTERS.replace('t as', 'cha as')},
i as (select cha.doc_id, cha.title as chapter_title, k.title, k.position, cha.position as chapter_at, lead(k.position) over (partition by cha.doc_id, cha.position order by k.position) as next_at, cha.stop
  from cha join k on k.doc_id = cha.doc_id and k.kind = 'section' and k.position >= cha.position and k.position < coalesce(cha.stop, 1000000000) where {_TOKENS.replace('piece', 'cha.piece')} > 7500),
j as (select i.doc_id, chapter_title, position, chapter_at, next_at, i.title, {_STRIP('substr(b.text, i.position + 1, coalesce(i.next_at, i.stop, length(b.text)) - i.position)')} as piece from i join b using (doc_id)),
sec as (select *, case when next_at is null and piece = '#SECTION' then 'Unknown Section' else title end as section_title from j),
o1 as (select row_number() over () as doc_id, doc_id as doc, position, 'chapter_section_part' as type, chapter_title || ' - ' || section_title as title, chapter_title, section_title, piece as text from sec where {_TOKENS} > 7500
union all select -row_number() over (), doc_id, position, 'chapter_part', title, title, null, piece from cha where {_TOKENS} > 7500 and (doc_id, position) not in (select (doc_id, chapter_at) from sec)),
{_named_windows('w1', 'o1', 2000, 200)},
u as (select doc_id as doc, position, 0 as part, 'semantic_chapter' as type, title, title as chapter_title, cast(null as varchar) as section_title, piece, {_TOKENS} as token_count from cha where piece <> '' and {_TOKENS} <= 7500
union all select doc_id, position, 0, 'chapter_section', chapter_title || ' - ' || section_title, chapter_title, section_title, piece, {_TOKENS} from sec where {_TOKENS} <= 7500
union all {_PIECES('w1', 'o1')}) {_CHUNK_ROWS}""")
def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks by chapters at the production limit, those of oversize chapters too."""
    return _all_chunks(spark, sf_dir, "semantic_chapter")


@query(f"""with recursive {_BOOKS}, {_LINES}, {_SECTIONS.replace('t as', 'sec as')}, {_CHAPTERS.replace('t as', 'cha as').replace('c as (', 'cc as (').replace('from c join', 'from cc c join')},
o1 as (select row_number() over () as doc_id, doc_id as doc, position, 'section_part' as type, coalesce(chapter_title, 'Unknown Chapter') || ' - ' || section_title as title, coalesce(chapter_title, 'Unknown Chapter') as chapter_title, section_title, piece as text from sec where {_TOKENS} > 7500),
o2 as (select row_number() over () as doc_id, doc_id as doc, position, 'chapter_part' as type, title, title as chapter_title, cast(null as varchar) as section_title, piece as text from cha where {_TOKENS} > 7500 and doc_id not in (select doc_id from sec)),
{_named_windows('w1', 'o1', 1500, 100)}, {_named_windows('w2', 'o2', 1500, 200)},
u as (select doc_id as doc, position, 0 as part, 'semantic_section' as type, coalesce(chapter_title, 'Unknown Chapter') || ' - ' || section_title as title, coalesce(chapter_title, 'Unknown Chapter') as chapter_title, section_title, piece, {_TOKENS} as token_count from sec where piece <> '' and {_TOKENS} <= 7500
union all select doc_id, position, 0, 'semantic_chapter', title, title, null, piece, {_TOKENS} from cha where piece <> '' and {_TOKENS} <= 7500 and doc_id not in (select doc_id from sec)
union all {_PIECES('w1', 'o1')} union all {_PIECES('w2', 'o2')}) {_CHUNK_ROWS}""")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks by sections at the production limit, of texts without sections and of oversize ones too."""
    return _all_chunks(spark, sf_dir, "semantic_section")


_PATTERNS = ("Chapter [0-9]+[.]", "Section [0-9]+:")
_MARKED = "'Chapter ' || (doc_id % 5) || '.' || chr(10) || replace(text, chr(10), chr(10) || 'Section 7:' || chr(10)) || ' Chapter 9. ' || lang || ' Section 1:' || text"
_TOK = lambda text, pattern: f"string_split('T' || regexp_replace({text}, '({pattern})', chr(1) || 'H' || '\\1' || chr(1) || 'T', 'g'), chr(1))"


@query(f"""with d as (select doc_id, {_MARKED} as text from documents),
a as (select doc_id, unnest(t) as p, generate_subscripts(t, 1) as o from (select doc_id, {_TOK('text', _PATTERNS[0])} as t from d)),
a2 as (select doc_id, o, p, p[1] = 'H' as h, {_STRIP('p[2:]')} as c from a), a3 as (select *, sum(cast(h as integer)) over (partition by doc_id order by o) as chapter_index, coalesce(last_value(case when h then c end ignore nulls) over (partition by doc_id order by o), 'Unknown Chapter') as chapter_title from a2 where c <> ''),
e as (select doc_id, o, chapter_index, chapter_title, unnest(t) as p, generate_subscripts(t, 1) as i from (select *, {_TOK('p[2:]', _PATTERNS[1])} as t from a3 where not h)),
e2 as (select *, p[1] = 'H' as h, {_STRIP('p[2:]')} as c from e), e3 as (select *, sum(cast(h as integer)) over (partition by doc_id, o order by i) as section_index, coalesce(last_value(case when h then c end ignore nulls) over (partition by doc_id, o order by i), '') as section_title from e2 where c <> ''),
f as (select *, unnest(range(0, cast(floor((length(c) - 1) / 4000.0) as bigint) + 1)) as k from e3 where not h and length(c) > 50), g as (select *, {_STRIP('substr(c, k * 4000 + 1, 4000)')} as content from f),
x as (select *, row_number() over (partition by doc_id, o, i order by k) as part from g where content <> '')
select doc_id, cast(chapter_index as bigint) as chapter_index, chapter_title, cast(section_index as bigint) as section_index, case when length(c) > 4000 then section_title || ' (Part ' || part || ')' else section_title end as section_title, cast(case when length(c) > 4000 then part else 0 end as integer) as subsection_index, cast(length(content) as integer) as n_chars from x""")
def structure_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Chapter "), (F.col("doc_id") % 5).cast("string"), F.lit(".\n"), F.replace("text", F.lit("\n"), F.lit("\nSection 7:\n")), F.lit(" Chapter 9. "), "lang", F.lit(" Section 1:"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    rows = P.structured_sections(docs, ["doc_id"], *_PATTERNS)
    return rows.select("doc_id", F.col("chapter_index").cast("long").alias("chapter_index"), "chapter_title", F.col("section_index").cast("long").alias("section_index"), "section_title", F.col("subsection_index").cast("int").alias("subsection_index"), F.length("content").alias("n_chars"))


_SPLIT = lambda x, mark: f"string_split(regexp_replace({x}, '(?m)^{mark}\\s*', chr(1), 'g'), chr(1))"
_REST = lambda x: f"(case when contains({x}, chr(10)) then substr({x}, instr({x}, chr(10)) + 1) else '' end)"
_HEAD = lambda x: _STRIP(f"split_part({x}, chr(10), 1)")


@query(f"""with {_BOOKS}, c as (select doc_id, unnest({_SPLIT('text', '#CHAPTER')}) as block, generate_subscripts({_SPLIT('text', '#CHAPTER')}, 1) - 1 as chapter_idx from b),
c2 as (select doc_id, chapter_idx, {_HEAD('block')} as chapter_title, regexp_replace({_REST('block')}, '\\n$', '') as rest from c where block <> ''),
s as (select doc_id, chapter_idx, chapter_title, len(parts) as n, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as place from (select *, {_SPLIT('rest', '#SECTION')} as parts from c2)),
s2 as (select *, {_STRIP('part')} as body from s), s3 as (select * from s2 where n = 1 or body <> ''),
s4 as (select *, case when place = 0 then body else {_STRIP(_REST('part'))} end as txt, case when place = 0 then '<Chapter description>' else {_HEAD('part')} end as section_title from s3)
select doc_id, cast(chapter_idx as integer) as chapter_idx, chapter_title, cast(row_number() over (partition by doc_id, chapter_idx order by place) - 1 as integer) as section_idx, section_title, case when txt = '' then '<No text in section>' else txt end as section_text from s4""")
def tagging_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tagging_sections(books(spark, sf_dir), ["doc_id"])


_GRAPH = f"""c as (select doc_id, {_STRIP('block')} as block, o from (select doc_id, unnest({_SPLIT('text', '#CHAPTER')}) as block, generate_subscripts({_SPLIT('text', '#CHAPTER')}, 1) as o from b)),
c2 as (select doc_id, o, {_HEAD('block')} as chapter, {_REST('block')} as rest from c where block <> ''),
s as (select doc_id, o, chapter, len(parts) as n, {_STRIP('unnest(parts)')} as part, generate_subscripts(parts, 1) as place from (select *, {_SPLIT('rest', '#SECTION')} as parts from c2)),
g as (select doc_id, cast(row_number() over (partition by doc_id order by o, place) - 1 as integer) as pos, chapter, case when n = 1 then '(whole chapter)' else {_HEAD('part')} end as section, case when n = 1 then part else {_STRIP(_REST('part'))} end as text from s where n = 1 or part <> '')"""


@query(f"with {_BOOKS}, {_GRAPH} select * from g")
def graph_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.graph_sections(books(spark, sf_dir), ["doc_id"])


@query(f"with {_BOOKS}, {_GRAPH} select doc_id, chapter as title, min(pos) as first_pos, string_agg('[Section ' || (rn) || '] CHAPTER: ' || chapter || ' | SECTION: ' || section || chr(10) || chr(10) || {_STRIP('text')}, chr(10) || chr(10) order by pos) as prompt from (select *, row_number() over (partition by doc_id, chapter order by pos) as rn from g) group by doc_id, chapter")
def grouped_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.grouped_chapters(P.graph_sections(books(spark, sf_dir), ["doc_id"]), ["doc_id"])
    whole = F.transform("sections", lambda s: F.struct(F.col("title").alias("chapter"), s["section"].alias("section"), s["text"].alias("text")))
    return rows.select("doc_id", "title", "first_pos", P.prompt_text(whole).alias("prompt"))


@query(f"""with recursive d as (select 'in/doc.' || doc_id || '.txt' as doc_id, text from documents), {_windows('d', 500, 50)},
p as (select doc_id, start, {_STRIP('substr(text, start + 1, stop - start)')} as piece from w), n as (select *, row_number() over (partition by doc_id order by start) - 1 as i, count(*) over (partition by doc_id) as t from p where piece <> '')
select replace(replace(doc_id, 'in/', ''), '.txt', '') || '_' || i as chunk_id, replace(doc_id, 'in/', '') as source, cast(i as integer) as chunk_index, t as total_chunks, 'regular' as chunking_method from n""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("in/doc."), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return C.process_documents(files).select("chunk_id", "source", "chunk_index", "total_chunks", "chunking_method")


@query(f"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '{_SP}+'), lambda w: w <> '')) as integer) as word_count, cast(length(text) as integer) as char_count, case when length(text) > 6000 then left(text, 6000) || '...' else text end as embedded from documents")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"), X.shortened(F.col("text"), 6000).alias("embedded"))


@query("select doc_id, case when length(text) > 100 then left(text, 100) || '...' else text end as preview from documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.shortened(F.col("text"), 100).alias("preview"))


@query("select source, count(*) as files, cast(sum(strlen(text)) as bigint) as total_bytes from documents group by source")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.file_statistics(table(spark, sf_dir, "documents"), "source", F.octet_length("text"))


@query("select page_id, case when ext in ('.txt', '.docx', '.doc', '.pdf') then ext[2:] else '' end as extractor from (select page_id, lower(regexp_extract(url, '[^/.](\\.[A-Za-z0-9]+)$', 1)) as ext from pages)")
def extractor_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import extractor_of

    return table(spark, sf_dir, "pages").select("page_id", extractor_of(F.col("url")).alias("extractor"))


@query(f"with x as (select doc_id, {_STRIP('unnest(string_split(text, chr(10)))')} as line from documents) select doc_id, line, count(*) as n from x where line <> '' group by all")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.prompt_lines(F.col("text"))).alias("line"))
    return rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_BOOKS}, {_LINES} select k.doc_id, k.position, k.title as section_title,
(select max_by(c.title, c.position) from k c where c.doc_id = k.doc_id and c.kind = 'chapter' and c.position <= k.position) as chapter_title from k where kind = 'section'""")
def sections_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the chapter that they stand in, as rows: an as-of join of two kinds of markers."""
    from ..operators.asof import as_of

    found = C.marker_rows(books(spark, sf_dir), ["doc_id"])
    chapters = found.filter("kind = 'chapter'").select("doc_id", "position", F.col("title").alias("chapter_title"))
    sections = found.filter("kind = 'section'").select("doc_id", "position", F.col("title").alias("section_title"))
    return as_of(sections, chapters, "doc_id", "position", ["chapter_title"])


def _registered(spark: SparkSession) -> None:
    from ..functions.tables import register

    register(spark)


@query(ORACLES["regular_chunks"])
def chunks_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of regular_chunks by a table function in SQL."""
    _registered(spark)
    return spark.sql("select d.doc_id, c.chunk_index, c.n_chars, c.text, c.title from {documents} d, lateral chunks(d.text, 'regular') c", documents=table(spark, sf_dir, "documents"))


@query(f"""with {_BOOKS}, {_LINES} select k.doc_id, k.line_number, k.title as section_title,
(select max_by(c.title, c.position) from k c where c.doc_id = k.doc_id and c.kind = 'chapter' and c.position <= k.position) as chapter_title from k where kind = 'section'""")
def sections_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by a table function over the lines of each book, in order."""
    _registered(spark)
    lines = books(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).selectExpr("doc_id", "at + 1 as line_number", "line")
    return spark.sql("select doc_id, line_number, section_title, chapter_title from sections(table(select * from {lines}) partition by doc_id order by line_number)", lines=lines)
