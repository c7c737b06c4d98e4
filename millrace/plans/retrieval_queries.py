"""Queries of vector retrieval. The query vector is that of vec_id 0; records are five slices of each embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import listings as L
from ..operators import ordering as O
from ..operators import retrieval as R
from .registry import ORACLES, query, table

#: Slices of an embedding that stand for a record's vectors: first dimension and length.
SLICES = {"symptoms_vector": (1, 12), "organs_vector": (13, 12), "formulas_vector": (25, 12), "patterns_vector": (37, 12), "full_content_vector": (49, 16)}
TAG_LABELS, ASKED_LABEL, TAG_THRESHOLD = (1, 2, 3), 0, 0.2


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


_INDEX = "v as (select vec_id, label, cast(embedding as double[]) as e from embeddings)"
_RECORDS = _INDEX + ", r as (select vec_id, label as chapter_index, vec_id % 10 as section_index, " + ", ".join(f"e[{a}:{a + n - 1}] as {k}" for k, (a, n) in SLICES.items()) + " from v)"
#: Where a record has the vector; the slices themselves are whole in the SQL.
_HAS = {k: "r.vec_id % 7 <> 0" if k == "symptoms_vector" else "true" for k in SLICES}
_QUERY = "q as (select " + ", ".join(f"e[{a}:{a + n - 1}] as {k}" for k, (a, n) in SLICES.items()) + " from v where vec_id = 0)"
_PARTS = " + ".join(f"case when {_HAS[k]} then {_cos('r.' + k, 'q.' + k)} * {R.WEIGHTS[k]} else 0 end" for k in SLICES)
_MULTI = f"s as (select r.*, ({_PARTS}) / {sum(R.WEIGHTS.values())!r} as score from r, q)"


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one book: chapter by label, section by id; every seventh lacks its symptoms vector."""
    e = index(spark, sf_dir)
    slices = {k: F.slice("embedding", a, n) for k, (a, n) in SLICES.items()}
    slices["symptoms_vector"] = F.when(F.col("vec_id") % 7 != 0, slices["symptoms_vector"])
    return e.select("vec_id", F.lit("book").alias("book_id"), F.col("label").alias("chapter_index"), (F.col("vec_id") % 10).alias("section_index"), *[v.alias(k) for k, v in slices.items()])


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = index(spark, sf_dir).filter("vec_id = 0")
    return e.select(*[F.slice("embedding", a, n).alias(k) for k, (a, n) in SLICES.items()])


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = index(spark, sf_dir)
    return R.scored(e, e.filter("vec_id = 0").select(F.col("embedding").alias("q")))


@query(f"with {_INDEX} select v.vec_id, round({_cos('v.e', 'q.e')}, 6) as score from v, (select e from v where vec_id = 0) q order by {_cos('v.e', 'q.e')} desc, v.vec_id limit 3")
def flat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(_flat(spark, sf_dir), 3, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""with {_INDEX}, s as (select v.vec_id, {_cos('v.e', 'q.e')} as score from v, (select e from v where vec_id = 0) q), h as (select vec_id from s order by score desc, vec_id limit 3),
n as (select vec_id + d as vec_id, max(d = 0) as is_hit from h, (select unnest([-1, 0, 1]) as d) group by 1)
select s.vec_id, round(s.score, 6) as score, n.is_hit from s join n using (vec_id)""")
def flat_topk_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = index(spark, sf_dir)
    found = R.retrieve(e, e.filter("vec_id = 0").select(F.col("embedding").alias("q")), "vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"), "is_hit")


@query("""with t as (select conv_id, role, text, row_number() over (partition by conv_id, role order by turn) as rank, cast(case when turn % 2 = 0 then null else 0.5 end as double) as similarity from conversations)
select cast(conv_id as varchar) || ':' || role as query, cast(rank as integer) as rank, text, coalesce(similarity, cast(0.9 as double)) as similarity from t where rank <= 3""")
def mock_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id", "role").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), "role").alias("query"), F.row_number().over(order).alias("rank"), "text", F.when(F.col("turn") % 2 != 0, 0.5).alias("similarity"))
    return R.mock(t)


@query(f"with {_RECORDS}, {_QUERY}, {_MULTI} select vec_id, round(score, 6) as score from s order by s.score desc, vec_id limit 5")
def multi_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.search(records(spark, sf_dir), asked(spark, sf_dir))
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("with " + _RECORDS + ", " + _QUERY + ", x as (" + " union all ".join(f"(select '{k.removesuffix('_vector')}' as search_type, r.vec_id, {_cos('r.' + k, 'q.' + k)} as score from r, q where {_HAS[k]} order by 3 desc, 2 limit 5)" for k in SLICES) + ") select search_type, vec_id, round(score, 6) as score from x")
def single_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    r, q = records(spark, sf_dir), asked(spark, sf_dir)
    parts = [R.search(r, q, kind).select(F.lit(kind).alias("search_type"), "vec_id", F.round("score", 6).alias("score")) for kind in R.search_types(r)]
    return reduce(DataFrame.unionByName, parts)


_PLACED = "p as (select vec_id, chapter_index, section_index, row_number() over (order by chapter_index, section_index, vec_id) as pos from r)"


@query(f"""with {_RECORDS}, {_QUERY}, {_MULTI}, h as (select vec_id from s order by score desc, vec_id limit 5), {_PLACED},
x as (select a.vec_id as hit, b.vec_id as adjacent, b.pos - a.pos as dist, row_number() over (partition by a.vec_id, b.chapter_index, b.section_index order by b.pos) as rn from h join p a using (vec_id), p b where abs(b.pos - a.pos) <= 2)
select hit, adjacent, cast(dist as integer) as dist from x where rn = 1""")
def adjacent_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return R.adjacent(r, R.search(r, asked(spark, sf_dir)), "vec_id")


@query(f"""with {_RECORDS}, {_QUERY}, {_MULTI}, h as (select vec_id from s order by score desc, vec_id limit 5), {_PLACED},
x as (select a.vec_id as hit, b.vec_id as adjacent, b.pos - a.pos as dist, row_number() over (partition by a.vec_id, b.chapter_index, b.section_index order by b.pos) as rn from h join p a using (vec_id), p b where b.chapter_index = a.chapter_index)
select hit, adjacent, cast(dist as integer) as dist from x where rn = 1""")
def adjacent_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return R.adjacent(r, R.search(r, asked(spark, sf_dir)), "vec_id", chapter=True)


@query(f"""with {_RECORDS}, {_QUERY}, {_MULTI}, h as (select vec_id, score, row_number() over (order by score desc, vec_id) as rank from s order by score desc, vec_id limit 5), {_PLACED},
x as (select a.vec_id as hit, b.vec_id as adjacent, row_number() over (partition by a.vec_id, b.chapter_index, b.section_index order by b.pos) as rn from h join p a using (vec_id), p b where abs(b.pos - a.pos) <= 2)
select cast(h.rank as integer) as rank, h.vec_id, round(h.score, 6) as score, x.adjacent from h join x on x.hit = h.vec_id where x.rn = 1 and x.adjacent not in (select vec_id from h)""")
def structured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: weighted top-5, computed once, with what stands beside each hit and is no hit itself."""
    from pyspark.sql import Window

    r = records(spark, sf_dir)
    hits = R.settled(R.search(r, asked(spark, sf_dir)).select("vec_id", "score"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))  # five rows
    near = R.adjacent(r, hits, "vec_id").join(F.broadcast(hits.select(F.col("vec_id").alias("adjacent"))), "adjacent", "left_anti")
    return ranked.join(near, ranked.vec_id == near.hit).select("rank", "vec_id", F.round("score", 6).alias("score"), "adjacent")


_TAGS = f"t as (select vec_id as tag, max(greatest({_cos('a.e', 'b.e')}, 0)) as similarity from (select * from v where label in {TAG_LABELS}) a, (select e from v where label = {ASKED_LABEL}) b group by 1 having max(greatest({_cos('a.e', 'b.e')}, 0)) >= {TAG_THRESHOLD})"


def _similar(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = index(spark, sf_dir)
    tags = e.filter(F.col("label").isin(*TAG_LABELS)).select(F.col("vec_id").alias("tag"), "embedding")
    return R.similar_tags(tags, e.filter(F.col("label") == ASKED_LABEL).select(F.col("embedding").alias("q")), k, TAG_THRESHOLD)


@query(f"with {_INDEX}, {_TAGS.replace('vec_id as tag', 'a.vec_id as tag')} select tag, round(similarity, 6) as similarity from t order by t.similarity desc, tag limit 10")
def similar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, 10).select("tag", F.round("similarity", 6).alias("similarity"))


@query(f"""with {_RECORDS}, {_QUERY}, {_MULTI}, h as (select vec_id, score from s order by score desc, vec_id limit 5), {_TAGS.replace('vec_id as tag', 'a.vec_id as tag')},
k as (select tag, similarity, row_number() over (order by similarity desc, tag) as tr from t order by similarity desc, tag limit 15),
c as (select tr, r.vec_id, row_number() over (partition by tr order by {_cos('r.patterns_vector', 'w.e[37:48]')} desc, r.vec_id) as rn from r, k join v w on w.vec_id = k.tag),
d as (select *, row_number() over (partition by vec_id order by tr, rn) as again from c where rn <= 2 and vec_id not in (select vec_id from h)),
m as (select tr, rn, vec_id from d where again = 1 order by tr, rn limit 3),
u as (select 0 as part, -score as k1, cast(vec_id as double) as k2, vec_id, 'search' as source from h union all select 1, tr, rn, vec_id, 'tag' from m)
select cast(row_number() over (order by part, k1, k2) as integer) as rank, vec_id, source from u order by part, k1, k2 limit 8""")
def tag_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = records(spark, sf_dir), index(spark, sf_dir)
    hits = R.settled(R.search(r, asked(spark, sf_dir)).select("vec_id", "score"))
    tags = _similar(spark, sf_dir, 15).join(e.select(F.col("vec_id").alias("tag"), F.slice("embedding", 37, 12).alias("q")), "tag")
    return R.with_expansion(hits, R.expanded(r, tags, hits, "vec_id"), "vec_id", 5)


@query(f"""with {_RECORDS}, {_QUERY}, {_MULTI}, h as (select vec_id, score from s order by score desc, vec_id limit 5), {_TAGS.replace('vec_id as tag', 'a.vec_id as tag')}, {_PLACED},
k as (select tag, similarity, row_number() over (order by similarity desc, tag) as tr from t order by similarity desc, tag limit 15),
c as (select tr, r.vec_id, row_number() over (partition by tr order by {_cos('r.patterns_vector', 'w.e[37:48]')} desc, r.vec_id) as rn from r, k join v w on w.vec_id = k.tag),
d as (select *, row_number() over (partition by vec_id order by tr, rn) as again from c where rn <= 2 and vec_id not in (select vec_id from h)),
m as (select tr, rn, vec_id from d where again = 1 order by tr, rn limit 3),
u as (select 0 as part, -score as k1, cast(vec_id as double) as k2, vec_id, 'search' as source, round(score, 6) as score from h union all select 1, tr, rn, vec_id, 'tag', null from m),
x as (select a.vec_id as hit, b.vec_id as adjacent, b.pos - a.pos as dist, row_number() over (partition by a.vec_id, b.chapter_index, b.section_index order by b.pos) as rn from h join p a using (vec_id), p b where abs(b.pos - a.pos) <= 2),
n as (select hit, string_agg(cast(adjacent as varchar), ',' order by dist) as near from x where rn = 1 and dist <> 0 group by hit)
select cast(row_number() over (order by part, k1, k2) as integer) as rank, vec_id, source, score, near from u left join n on hit = vec_id order by part, k1, k2 limit 8""")
def structured_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole structured search: five hits, three more by tags, and what stands beside the hits; the records are scanned once."""
    from ..operators import many as M

    r, e = records(spark, sf_dir), index(spark, sf_dir)
    question = e.filter("vec_id = 0").select(F.col("vec_id").alias("qid"), *[F.slice("embedding", a, n).alias(k) for k, (a, n) in SLICES.items()])
    own = e.filter(F.col("label") == ASKED_LABEL).select(F.lit(0).cast("long").alias("qid"), F.col("embedding").alias("q"))
    found = M.answered(r, question, tag_vectors=_tag_vectors(e), tags_asked=own, threshold=TAG_THRESHOLD)
    return found.select("rank", "vec_id", "source", F.round("score", 6).alias("score"), F.array_join(F.transform("near", lambda n: n.cast("string")), ",").alias("near"))


def _tag_vectors(e: DataFrame) -> DataFrame:
    return e.filter(F.col("label").isin(*TAG_LABELS)).select(F.col("vec_id").alias("tag"), "embedding", F.slice("embedding", 37, 12).alias("q"))


@query(f"""with {_INDEX}, s as (select q.vec_id as qid, v.vec_id, {_cos('v.e', 'q.e')} as score from v, v q where q.label = {ASKED_LABEL}),
x as (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from s) select qid, vec_id, round(score, 6) as score, cast(rank as integer) as rank from x where rank <= 3""")
def many_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest rows to each embedding of one label, in one pass over the index."""
    e = index(spark, sf_dir)
    found = R.top_many(e, e.filter(F.col("label") == ASKED_LABEL).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 3, "vec_id")
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


WORDS = ["the", "tion", "ou", "ch", "de"]


@query("select doc_id, cast(m as integer) as matches, round((1.0 / (1 + n_chars)) * (1 + 0.1 * m), 9) as boosted from (select doc_id, n_chars, " + " + ".join(f"cast(contains(text, '{w}') as integer)" for w in WORDS) + " as m from documents)")
def symptom_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("score", 1.0 / (1 + F.col("n_chars")))
    return R.boosted(rows, WORDS).select("doc_id", "matches", F.round("boosted", 9).alias("boosted"))


@query(f"with {_RECORDS} select count(*) as total_records, count(distinct 'book') as books, count(distinct chapter_index) as total_chapters, round(avg(length(cast(vec_id as varchar))), 6) as avg_content_length from r")
def db_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return L.structured_summary(r, F.col("vec_id").cast("string")).withColumn("avg_content_length", F.round("avg_content_length", 6))


@query("select count(*) as total_chunks, count(distinct source) as sources from documents")
def flat_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flat_summary(table(spark, sf_dir, "documents"))


@query("select conv_id as grp, string_agg('From ' || coalesce(role, 'Unknown') || ': ' || coalesce(text, ''), chr(10) order by turn) as context from conversations group by conv_id")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.context(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", "role", "text")


@query("select count(*) as chunks, count(*) filter (n_chars > 1500) as large, round(100.0 * count(*) filter (n_chars > 1500) / count(*), 2) as large_share, round(avg(n_chars), 6) as avg_chars, max(n_chars) as max_chars from documents")
def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.chunk_sizes(table(spark, sf_dir, "documents"), "n_chars").withColumns({"large_share": F.round("large_share", 2), "avg_chars": F.round("avg_chars", 6)})


# --- the index of cells: asked is every embedding whose id is divisible by 100 --------------------

def _cells(spark: SparkSession, sf_dir: str) -> tuple[C.CellIndex, DataFrame, DataFrame]:
    e = index(spark, sf_dir)
    return C.built(e, O.folder(spark, "cells"), "vec_id"), e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


_HUNDREDTH = f"""with {_INDEX}, s as (select q.vec_id as qid, v.vec_id, {_cos('v.e', 'q.e')} as score from v, v q where q.vec_id % 100 = 0),
x as (select *, row_number() over (partition by qid order by round(score, 12) desc, vec_id) as rank from s) """


@query(_HUNDREDTH + "select qid, vec_id, round(score, 6) as score, cast(rank as integer) as rank from x where rank <= 10")
def cells_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows by the index of cells, all cells searched: exact."""
    cells, _, asked = _cells(spark, sf_dir)
    found = C.nearest(spark, cells, asked, 10, probes=len(cells.centroids), exact=True)
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the cells and candidates that the index has chosen: approximate, so there is no SQL for it."""
    cells, _, asked = _cells(spark, sf_dir)
    return C.nearest(spark, cells, asked, 10).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(_HUNDREDTH + "select count(*) as wanted, true as enough from x where rank <= 10")
def cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the exact ten nearest rows, and whether the approximate search finds nine in ten of them."""
    cells, e, asked = _cells(spark, sf_dir)
    return C.recall(C.nearest(spark, cells, asked, 10), R.top_many(e, asked, 10, "vec_id"), ["qid", "vec_id"]).select("wanted", (F.col("recall") >= 0.9).alias("enough"))


_QUESTIONS = "q as (select vec_id as qid, e, " + ", ".join(f"e[{a}:{a + n - 1}] as {k}" for k, (a, n) in SLICES.items()) + " from v where vec_id % 100 = 0)"


@query(f"""with {_RECORDS}, {_QUESTIONS}, s as (select q.qid, r.vec_id, round(({_PARTS}) / {sum(R.WEIGHTS.values())!r}, 12) as score from r, q),
h as (select *, row_number() over (partition by qid order by score desc, vec_id) as hr from s qualify hr <= 5), {_PLACED},
t as (select q.qid, a.vec_id as tag, round(greatest({_cos('a.e', 'q.e')}, 0), 12) as similarity from v a, q where a.label in {TAG_LABELS}),
k as (select *, row_number() over (partition by qid order by similarity desc, tag) as tr from t where similarity >= {TAG_THRESHOLD} qualify tr <= 15),
w as (select tag, r.vec_id, row_number() over (partition by tag order by round({_cos('r.patterns_vector', 'v.e[37:48]')}, 12) desc, r.vec_id) as rn from (select distinct tag from k) g join v on v.vec_id = g.tag, r qualify rn <= 2),
c as (select k.qid, tr, rn, vec_id from k join w using (tag) where (k.qid, vec_id) not in (select (qid, vec_id) from h)),
d as (select *, row_number() over (partition by qid, vec_id order by tr, rn) as again from c qualify again = 1),
m as (select *, row_number() over (partition by qid order by tr, rn) as n from d qualify n <= 3),
u as (select qid, 0 as part, hr as k1, 0 as k2, vec_id, 'search' as source, round(score, 6) as score from h union all select qid, 1, tr, rn, vec_id, 'tag', null from m),
x as (select a.vec_id as hit, b.vec_id as adjacent, b.pos - a.pos as dist, row_number() over (partition by a.vec_id, b.chapter_index, b.section_index order by b.pos) as rn from (select distinct vec_id from h) o join p a using (vec_id), p b where abs(b.pos - a.pos) <= 2),
n as (select hit, string_agg(cast(adjacent as varchar), ',' order by dist) as near from x where rn = 1 and dist <> 0 group by hit)
select qid, cast(row_number() over (partition by qid order by part, k1, k2) as integer) as rank, vec_id, source, score, case when source = 'search' then near end as near from u left join n on hit = vec_id""")
def structured_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole structured searches for every embedding whose id is divisible by 100: five hits, three more by tags, neighbours."""
    from ..operators import many as M

    r, e = records(spark, sf_dir), index(spark, sf_dir)
    own = e.filter("vec_id % 100 = 0")
    questions = own.select(F.col("vec_id").alias("qid"), *[F.slice("embedding", a, n).alias(k) for k, (a, n) in SLICES.items()])
    found = M.answered(r, questions, tag_vectors=_tag_vectors(e), tags_asked=own.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), threshold=TAG_THRESHOLD)
    return found.select("qid", "rank", "vec_id", "source", F.round("score", 6).alias("score"), F.array_join(F.transform("near", lambda n: n.cast("string")), ",").alias("near"))


@query(ORACLES["adjacent_sections"])
def adjacent_shelved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of adjacent_sections from a table bucketed by shelf."""
    import uuid

    from ..operators import shelves as B

    r = records(spark, sf_dir)
    shelves = B.shelved(r, f"shelves_{uuid.uuid4().hex}", O.folder(spark, "shelves"), "vec_id")
    hits = R.settled(R.search(r, asked(spark, sf_dir)).select("vec_id"))
    return B.adjacent(spark, shelves, B.places_of(spark, shelves, hits))
