"""Composites: building indexes, answering questions, diagnosis by workflow, evaluation runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import comma_list, is_blank, word_count
from ..sources.providers import Chat, Providers, answered, both_languages, embedded, extracted, one_by_one
from . import chunking, parsing, retrieval, tags
from .oplog import apply_log  # noqa: F401  part of what a service offers
from .ordering import consecutive, discard, written

NOTHING_FOUND = "未找到相关内容。\n\n---\n\nNo relevant content was found."
WORKFLOWS = ("no_rag", "chunk_rag", "tag_rag")


def flat_index(files: DataFrame, providers: Providers, method: str = "regular", size: int | None = None, **options) -> DataFrame:
    """Chunks of files (path, text) with vec_id, their position, and embedding; blank ones and those that can't be
    embedded are left out. vec_id numbers the chunks in order of file and place."""
    rows = chunking.process_documents(files, method, size, **options).filter(~is_blank(F.col("text")))
    vectors = written(rows.withColumn("embedding", embedded(F.col("text"), providers.embed)).filter("embedding is not null"), "embedded")
    out = consecutive(vectors, ["file_path", "chunk_index"])  # deals rows in ranges, for which it reads them twice: written before
    discard(vectors)
    return out


def structured_index(books: DataFrame, providers: Providers, chapter_pattern: str, section_pattern: str, tagged: DataFrame | None = None, kinds: Sequence[str] = ("symptoms", "organs", "formulas", "patterns")) -> DataFrame:
    """Sections of books (book_id, text) as records: counts of the text, related tags, one vector for each kind of
    extracted content and one for the whole (tags included)."""
    rows = parsing.structured_sections(books, ["book_id"], chapter_pattern, section_pattern)
    rows = rows.withColumns({"word_count": word_count(F.col("content")), "char_count": F.length("content"), "chapter_id": F.col("chapter_index").cast("string"), "section_id": F.col("section_index").cast("string")})
    rows = rows.withColumn("tags", F.array().cast("array<struct<tag_zh:string,tag_en:string>>")) if tagged is None else tags.of_sections(rows, tagged)
    rows = rows.withColumn("full_content", tags.enhanced(F.col("content"), F.col("tags")))
    for kind in kinds:
        rows = rows.withColumn(kind, extracted(F.col("content"), kind, providers.words)).withColumn(f"{kind}_vector", embedded(F.col(kind), providers.embed))
    vectors = written(rows.withColumn("full_content_vector", embedded(F.col("full_content"), providers.embed)), "embedded")
    out = consecutive(vectors, ["book_id", "pos", "inner_pos", "subsection_index"])
    discard(vectors)
    return out


def prompt_of(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question)


def replies(rows: DataFrame, providers: Providers, system_prompt: str | None = None, nothing: str = NOTHING_FOUND) -> DataFrame:
    """rows(question, context, chunks_used) with response, its two languages and error. Where nothing was found the answer
    is fixed and no model is asked."""
    head = F.lit(f"{system_prompt}\n\n" if system_prompt else "")
    some = F.col("chunks_used") > 0
    asked = rows.withColumn("prompt", F.concat(head, prompt_of(F.col("context"), F.col("question"))))
    found = answered(asked.filter(some), "prompt", providers.chat).withColumn("r", both_languages(F.col("answer")))
    full = found.select(*rows.columns, F.when(F.col("r.combined") != "", F.col("r.combined")).otherwise(F.col("answer")).alias("response"), F.coalesce("r.chinese", "answer").alias("chinese_response"), F.coalesce("r.english", F.lit("")).alias("english_response"), "error")
    none = asked.filter(~some).select(*rows.columns, F.lit(nothing).alias("response"), F.lit(nothing.split("\n")[0]).alias("chinese_response"), F.lit(nothing.split("\n")[-1]).alias("english_response"), F.lit(None).cast("string").alias("error"))
    return full.unionByName(none)


def ask_flat(index: DataFrame, question: str, providers: Providers, top_n: int = 3, adjacent: bool = True, system_prompt: str | None = None, translate: Chat | None = None) -> DataFrame:
    """One row: question, context of the retrieved chunks, response in both languages, chunks_used, and the chunks (text,
    english_text, similarity, source) in index order; english_text is empty without a translator, or if it fails."""
    spark = index.sparkSession
    query = spark.createDataFrame([(v or None,) for v in providers.embed([question])], "q array<double>")
    found = retrieval.settled(retrieval.retrieve(index, query, "vec_id", top_n, adjacent).select("vec_id", "source", "text", "score"))
    context = retrieval.context(found, F.lit(1), "vec_id", "source", "text")
    chunks = found.withColumn("english_text", F.lit(""))
    if translate is not None:
        chunks = answered(found, "text", translate, "english").withColumn("english_text", F.coalesce("english", F.lit(""))).drop("english", "error")
    chunks = chunks.agg(F.array_sort(F.collect_list(F.struct("vec_id", "text", "english_text", F.col("score").alias("similarity"), "source"))).alias("chunks"))
    return _answer(spark, question, context, found, providers, system_prompt).crossJoin(F.broadcast(chunks))  # one row each


def searched(records: DataFrame, vector: Sequence[float] | None, search_type: str = "multi_vector", top_k: int = 5, weights: Mapping[str, float] | None = None, tag_vectors: DataFrame | None = None, threshold: float = 0.7, reach: int = 2) -> tuple[DataFrame, DataFrame]:
    """(results, near): (vec_id, rank, source, score) of the hits in order and, with tag_vectors, of up to three records more
    that the tags nearest to those of the hits find, top_k + 3 together; and (hit, adjacent, dist) of the hits' neighbours.

    A single search type is that vector alone, whatever the weights. tag_vectors(tag, embedding, q): embedding is that of
    the tag's name, q that of the text which is asked for with it. Vectors of the hits' tags are found there by name. Ids
    go around, not records.
    """
    spark = records.sparkSession
    names = [c for c in records.columns if c.endswith("_vector")]
    query = spark.createDataFrame([[list(vector) if vector else None] * len(names)], ", ".join(f"{c} array<double>" for c in names))
    return searched_by(records, query, search_type, top_k, weights, tag_vectors, threshold, reach)


def searched_by(records: DataFrame, query: DataFrame, search_type: str = "multi_vector", top_k: int = 5, weights: Mapping[str, float] | None = None, tag_vectors: DataFrame | None = None, threshold: float = 0.7, reach: int = 2, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`searched` with one row of vectors by name; asked(q): vectors that stand for the hits' tags, where they are known."""
    hits = retrieval.settled(retrieval.search(records, query, search_type, top_k, weights).select("vec_id", "score"))
    none = hits.limit(0).select("vec_id", F.lit("").alias("tag"), F.lit(0.0).alias("similarity"), F.lit(0).alias("tag_rank"), F.lit(0).alias("rn"))
    more = none
    if tag_vectors is not None:
        if asked is None:
            own = records.join(F.broadcast(hits.select("vec_id")), "vec_id").select(F.explode("tags").alias("t")).select(F.col("t.tag_zh").alias("name")).distinct()
            asked = tag_vectors.join(F.broadcast(retrieval.settled(own)), F.col("tag") == F.col("name"), "left_semi").select(F.col("embedding").alias("q"))
        similar = retrieval.settled(retrieval.similar_tags(tag_vectors, asked, 15, threshold))
        more = retrieval.settled(retrieval.expanded(records, tag_vectors.select("tag", "q").join(F.broadcast(similar), "tag"), hits, "vec_id"))
    order = retrieval.with_expansion(hits, more, "vec_id", top_k).join(F.broadcast(hits), "vec_id", "left")
    return order.select("vec_id", "rank", "source", "score"), retrieval.adjacent(records, hits, "vec_id", reach)


def ask_structured(records: DataFrame, question: str, providers: Providers, search_type: str = "multi", top_k: int = 5, weights: Mapping[str, float] | None = None, tag_vectors: DataFrame | None = None, threshold: float = 0.7, system_prompt: str | None = None) -> DataFrame:
    """One row on a question: context of the three best results, response in both languages, chunks_used, search_type, and
    the results (rank, vec_id, source, score, section_title, adjacent ids) in order; see `searched`. Without results the
    response is a fixed text."""
    spark = records.sparkSession
    order, near = searched(records, providers.embed([question])[0] or None, search_type, top_k, weights, tag_vectors, threshold)
    order = retrieval.settled(order)
    rows = records.join(F.broadcast(order), "vec_id")
    context = retrieval.context(rows.filter("rank <= 3"), F.lit(1), "rank", "section_title", "full_content")
    beside = near.filter("dist <> 0").groupBy(F.col("hit").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("dist", "adjacent"))).alias("adjacent"))
    listed = rows.select("vec_id", "rank", "source", "score", "section_title").join(F.broadcast(beside), "vec_id", "left")  # top_k rows
    results = listed.agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "source", "score", "section_title", "adjacent"))).alias("results"))
    return _answer(spark, question, context, order, providers, system_prompt).withColumn("search_type", F.lit(search_type)).crossJoin(F.broadcast(results))  # one row each


def _answer(spark: SparkSession, question: str, context: DataFrame, found: DataFrame, providers: Providers, system_prompt: str | None = None) -> DataFrame:
    asked = spark.createDataFrame([(question,)], "question string")
    counted = asked.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("chunks_used")))).join(F.broadcast(context.select("context")), F.lit(True), "left")  # one row each
    return replies(counted.select("question", "context", "chunks_used"), providers, system_prompt)


# --- many questions ------------------------------------------------------------------------------

def ask_many(index: DataFrame, questions: Sequence[str], providers: Providers, top_n: int = 3, adjacent: bool = True, system_prompt: str | None = None) -> DataFrame:
    """qid (place in the list) with what `ask_flat` gives but the chunks; a question that can't be embedded has an error.
    All questions are searched in one pass over the index, and answered in batches on the executors."""
    spark = index.sparkSession
    vectors = one_by_one(providers.embed, questions, 1)  # a question that fails fails alone
    asked = spark.createDataFrame([(k, q, v or None, e) for k, (q, (v, e)) in enumerate(zip(questions, vectors, strict=True))], "qid long, question string, q array<double>, failed string")
    hits = written(retrieval.top_many(index, asked.select("qid", "q"), top_n, "vec_id").select("qid", "vec_id"), "hits")  # searched once
    if adjacent:
        hits = hits.select("qid", F.explode(F.array(*[F.col("vec_id") + d for d in (-1, 0, 1)])).alias("vec_id")).distinct()
    rows = index.select("vec_id", "source", "text").join(hits, "vec_id")
    contexts = retrieval.context(rows, F.col("qid"), "vec_id", "source", "text").withColumnRenamed("grp", "qid")
    used = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("chunks_used"))
    joined = asked.drop("q").join(contexts, "qid", "left").join(used, "qid", "left").na.fill(0, ["chunks_used"])
    done = replies(joined.select("qid", "question", "context", "chunks_used", "failed"), providers, system_prompt)
    return done.withColumn("response", F.when(F.col("failed").isNull(), F.col("response"))).withColumn("error", F.coalesce("failed", "error")).drop("failed")


def diagnosed(cases: DataFrame, workflow: str, providers: Providers, index: DataFrame | None = None, **options) -> list[dict]:
    """A result for each of the cases (prompt_id, content), by the workflow; an unknown one is an error in each. Cases are
    what persons wrote, so their list is short; they are answered together, but for tag_rag, whose search has steps."""
    rows = [case.asDict() for case in cases.collect()]
    out = [{"prompt_id": row.get("prompt_id") or f"prompt_{k}", "workflow": workflow} for k, row in enumerate(rows, 1)]
    if workflow not in WORKFLOWS:
        return [entry | {"error": f"unknown workflow {workflow!r}"} for entry in out]
    texts = [row["content"] for row in rows]
    if workflow == "no_rag":
        return [entry | ({"diagnosis": text, "chunks_used": 0} if e is None else {"error": e}) for entry, (text, e) in zip(out, one_by_one(providers.chat, texts), strict=True)]
    if workflow == "chunk_rag":
        found = sorted(ask_many(index, texts, providers, **options).collect(), key=lambda r: r.qid)
    else:
        found = [ask_structured(index, text, providers, **options).first() for text in texts]
    return [entry | {"diagnosis": r.response, "chunks_used": r.chunks_used} | ({"error": r.error} if r.error else {}) for entry, r in zip(out, found, strict=True)]


def selected_tags(sections: DataFrame, every: Sequence[Mapping[str, str]], chat: Chat, content: str = "content", most: int = 10) -> DataFrame:
    """sections with related_tags: of the first hundred tags (tag_zh, tag_en) those that a model names for the section's first
    2000 characters, by a comma-separated list of at most `most`; none where it fails."""
    shown = [t for t in every if t.get("tag_zh") and t.get("tag_en")]
    listed = "\n".join(f"- {t['tag_zh']} ({t['tag_en']})" for t in shown[:100])
    prompt = F.concat(F.lit(f"Which of these tags fit the text best? Answer with at most {most} of the Chinese names, separated by commas, and nothing else.\n\nTags:\n{listed}\n\nText:\n"), F.left(content, F.lit(2000)))
    kind = "array<struct<tag_zh:string,tag_en:string>>"
    if not shown:
        return sections.withColumn("related_tags", F.array().cast(kind))
    table = F.array(*[F.struct(F.lit(t["tag_zh"]).alias("tag_zh"), F.lit(t["tag_en"]).alias("tag_en")) for t in shown])
    rows = answered(sections.withColumn("_prompt", prompt), "_prompt", chat, "_names").withColumn("_names", comma_list(F.coalesce("_names", F.lit(""))))
    return rows.withColumn("related_tags", F.filter(table, lambda t: F.array_contains(F.col("_names"), t["tag_zh"]))).drop("_prompt", "_names", "error")


# --- tagging books and running evaluations -------------------------------------------------------

def tagged_books(books: DataFrame, tag: DataFrame) -> DataFrame:
    """Tags of books (book_id, text) in one table per category: sections are parsed, given to a tagger's result
    tag(book_id, chapter_idx, section_idx, seq, tags: category -> array of (name_zh, name_en)), of which the last for a
    section counts, and flattened: of each name the last tag, at the first one's place."""
    sections = parsing.tagging_sections(books, ["book_id"])
    keys = ["book_id", "chapter_idx", "section_idx"]
    rows = sections.join(tags.latest(tag, keys, "seq"), keys).select(*keys, F.explode("tags").alias("key", "list"))
    rows = rows.select(*keys, tags.category_of(F.col("key")).alias("category"), F.posexplode("list").alias("k", "t")).filter("category is not null")
    place = F.struct(*keys, "k")
    return rows.select("category", F.col("t.name_zh").alias("name_zh"), F.col("t.name_en").alias("name_en"), place.alias("pos")).transform(tags.flattened)


def evaluated(cases: DataFrame, index: DataFrame, providers: Providers, top_n: int = 3, size: int = 5) -> list[dict]:
    """Answers to cases (prompt_index, prompt), `size` of them together, one batch after the other; one that fails has an
    error. processing_time is a case's share of the seconds that its batch took."""
    import time

    rows = cases.orderBy("prompt_index").collect()  # prompts that a person wrote
    out = []
    for i in range(0, len(rows), size):
        some, began = rows[i : i + size], time.perf_counter()
        try:
            found = {r.qid: r for r in ask_many(index, [c.prompt for c in some], providers, top_n).collect()}
            batch = [{"response": found[k].response, "num_chunks_used": found[k].chunks_used, "error": found[k].error} for k in range(len(some))]
        except Exception as e:  # noqa: BLE001  one batch mustn't end the run
            batch = [{"response": None, "num_chunks_used": 0, "error": f"{type(e).__name__}: {e}"}] * len(some)
        seconds = (time.perf_counter() - began) / len(some)
        out += [{"case_number": c.prompt_index + 1, "prompt": c.prompt, **b, "processing_time": seconds} for c, b in zip(some, batch, strict=True)]
    return out


def evaluated_structured(cases: DataFrame, records: DataFrame, providers: Providers, **options) -> list[dict]:
    """The same over records, a case after the other: success, response, chunks_used, error."""
    out = []
    for case in cases.orderBy("prompt_index").collect():  # prompts that a person wrote
        try:
            r = ask_structured(records, case.prompt, providers, **options).first()
            out.append({"case_number": case.prompt_index + 1, "prompt": case.prompt, "success": r.error is None, "response": r.response, "chunks_used": r.chunks_used, "error": r.error})
        except Exception as e:  # noqa: BLE001  one case mustn't end the run
            out.append({"case_number": case.prompt_index + 1, "prompt": case.prompt, "success": False, "response": None, "chunks_used": 0, "error": f"{type(e).__name__}: {e}"})
    return out
