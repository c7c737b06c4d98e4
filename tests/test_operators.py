from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import graph as G
from millrace.operators import retrieval as R
from millrace.operators import serving as S
from millrace.operators import tags as T
from millrace.plans import retrieval_queries as Q
from millrace.sources.providers import Providers


def index(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


def query(spark, v):
    return spark.createDataFrame([(v,)], "q array<double>")


def test_neighbours_are_clipped_and_in_index_order(spark):
    found = R.retrieve(index(spark, [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]), query(spark, [1.0, 0.0]), "vec_id", top_n=1)
    assert [(r.vec_id, r.is_hit) for r in found.collect()] == [(0, True), (1, False)]


def test_more_asked_than_there_is_ties_and_missing_query(spark):
    rows = index(spark, [[1.0], [1.0]])
    assert [r.vec_id for r in R.top(R.scored(rows, query(spark, [2.0])), 3, "vec_id").collect()] == [0, 1]
    assert R.scored(rows, query(spark, None)).count() == 0 == R.scored(rows, query(spark, [])).count()
    assert R.retrieve(rows, query(spark, [1.0]), "vec_id", mode="False").count() == 0


def test_search_accepts_both_spellings(spark, sf):
    r, q = Q.records(spark, sf), Q.asked(spark, sf)
    one, two = (R.search(r, q, kind).select("vec_id", "score").collect() for kind in ("patterns", "patterns_vector"))
    assert one == two and len(one) == 5


def test_top_k_is_a_prefix_of_a_larger_k(spark, sf):
    r, q = Q.records(spark, sf), Q.asked(spark, sf)
    small, large = ([x.vec_id for x in R.search(r, q, top_k=k).collect()] for k in (3, 9))
    assert large[:3] == small


def test_plans(spark, sf, capsys):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(R.search(Q.records(spark, sf), Q.asked(spark, sf)))
    assert "TakeOrderedAndProject" in text and "Python" not in text and "BroadcastNestedLoopJoin" in text
    one = R.search(Q.records(spark, sf), Q.asked(spark, sf), "patterns")
    assert "embedding" in plan(one)


def test_adjacent_folds_equal_sections(spark):
    rows = [(i, "b", c, s) for i, (c, s) in enumerate([(0, 0), (0, 0), (0, 1), (1, 0)])] + [(9, "other", 0, 0)]
    r = spark.createDataFrame(rows, "vec_id long, book_id string, chapter_index int, section_index int")
    hit = spark.createDataFrame([(1,)], "vec_id long")
    assert sorted(x.adjacent for x in R.adjacent(r, hit, "vec_id").collect()) == [0, 2, 3]


def test_flatten_keeps_the_last_tag_at_the_first_place_and_is_idempotent(spark):
    rows = spark.createDataFrame([("c", "x", "old", 1), ("c", "y", "y", 2), ("c", "x", "new", 3)], "category string, name_zh string, name_en string, pos long")
    once = T.flattened(rows)
    assert sorted(tuple(r) for r in once.collect()) == [("c", "x", "new", 1), ("c", "y", "y", 2)]
    twice = T.flattened(once.withColumnRenamed("first_pos", "pos"))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_categories_in_both_spellings(spark):
    df = spark.createDataFrame([("symptom_tags",), ("symptoms_tags",), ("acupoints",), ("other",)], "k string")
    assert [r[0] for r in df.select(T.category_of(F.col("k"))).collect()] == ["symptom", "symptom", "acupoint", None]


def test_duplicate_symptoms_count_twice(spark):
    edges = spark.createDataFrame([("s", "a", 0), ("s", "b", 1)], "syndrome string, symptom string, pos int")
    asked = spark.createDataFrame([("a", 0), ("a", 1)], "symptom string, place long")
    assert G.ranked(edges, asked).first().score == pytest.approx(1.005)


def test_links_and_splits_are_idempotent(spark):
    edges = spark.createDataFrame([("s", "a", 0)], "syndrome string, symptom string, pos int")
    kids = spark.createDataFrame([("a", "a1"), ("a", "a2")], "parent string, child string")
    once = G.split(edges, kids)
    assert sorted(r.symptom for r in once.collect()) == ["a", "a1", "a2"]
    assert sorted(map(tuple, G.split(once, kids).collect())) == sorted(map(tuple, once.collect()))


def test_added_skips_known_names(spark):
    kind = "id string, zh string, en string, seq long, description string"
    nodes = spark.createDataFrame([("symp-0001", "咳", "Cough", 1, "")], kind)
    new = spark.createDataFrame([(None, "x", "cough", 2, ""), (None, "热", "fever", 3, ""), (None, "热", "heat", 4, "")], kind)
    assert [(r.id, r.en) for r in G.added(nodes, new, "symp", 1).collect()] == [("symp-0002", "fever")]


def test_operation_log(spark):
    nodes = spark.createDataFrame([("symp-0001", "symptom", "咳", "cough", 1, "d")], "id string, kind string, zh string, en string, seq long, description string")
    edges = spark.createDataFrame([], "syndrome string, symptom string, pos long")
    log = [
        {"op": "add_syndrome", "args": '{"name_zh": "风寒", "name_en": "wind"}'},
        {"op": "link", "args": {"syndrome": "wind", "symptom": "COUGH"}},
        {"op": "link", "args": {"syndrome": "none", "symptom": "cough"}},
        {"op": "split_symptom", "args": {"original": "cough", "children": [{"name_zh": "干咳", "name_en": "dry"}]}},
        {"op": "edit_symptom", "args": {"target": "dry", "name_en": "dry cough", "name_zh": ""}},
        {"op": "fly", "args": "broken"},
    ]
    nodes, edges, said = S.apply_log(nodes, edges, log)
    assert sorted((r.syndrome, r.symptom) for r in edges.collect()) == [("syn-0001", "symp-0001"), ("syn-0001", "symp-0002")]
    assert {r.id: r.en for r in nodes.collect()}["symp-0002"] == "dry cough"
    assert [m.split(":")[0] for m in said] == ["OK", "OK", "WARNING", "OK", "OK", "WARNING"]


def test_rating_rules(spark):
    rows = [(4, 3, 5, 1, 1, 1), (0, None, 5, 1, 1, 1), (None, 0, 5, 1, 1, 1)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in ("overall_rating", *E.CRITERIA)))
    r = E.rating_statistics(df).first()
    assert (r.total_ratings, r.average_overall_rating, r.avg_accuracy_rating) == (3, 4.0, 1.5)
    assert tuple(E.best_criterion(df).first()) == ("completeness_rating", 5.0)


def test_two_ratings_of_one_prompt(spark):
    runs = spark.createDataFrame([("r", 3), ("s", 2)], "run_id string, total_prompts long")
    ratings = spark.createDataFrame([("r", 1), ("r", 1)], "run_id string, prompt_number int")
    got = {r.run_id: (r.rated_count, r.unrated_count) for r in E.run_summary(runs, ratings).collect()}
    assert got == {"r": (2, 2), "s": (0, 2)}


def test_missing_batch_result(spark):
    lines = spark.createDataFrame([('{"custom_id":"request-0"}',), ('{"custom_id":"request-2"}',)], "value string")
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(3)], "prompt_index long, prompt string")
    assert sorted(r.prompt for r in E.batch_results(lines, prompts).collect()) == ["p0", "p2"]
    assert sorted(r.prompt for r in E.batch_results(lines, prompts, by_rank=True).collect()) == ["p0", "p1"]


def test_job_rules(spark):
    df = spark.createDataFrame([("a", "downloaded", "2020-01-01"), ("b", None, "nonsense"), ("c", "failed", None)], "job string, status string, at string")
    assert sorted(r.job for r in E.active(df).collect()) == ["a", "b"]
    assert [r.job for r in E.older_than(df, "at", F.lit("2020-01-03").cast("timestamp"), 1).collect()] == ["a"]
    assert E.older_than(df, "at", F.lit("2020-01-02").cast("timestamp"), 1).count() == 0


def test_index_ask_and_diagnose(spark):
    files = spark.createDataFrame([("in/a.txt", "cough and fever. " * 60), ("in/b.txt", "cold hands"), ("in/c.txt", "  ")], "path string, text string")
    providers = Providers(chat=lambda prompts: [f"seen {'cold hands' in p}" for p in prompts])
    idx = S.flat_index(files, providers).cache()
    assert [r.vec_id for r in idx.orderBy("vec_id").collect()] == list(range(idx.count()))
    row = S.ask_flat(idx, "cold hands", providers, top_n=1, adjacent=False).first()
    assert (row.response, row.chunks_used) == ("seen True", 1) and row.context.startswith("From b.txt: ")
    cases = spark.createDataFrame([(None, "cold hands")], "prompt_id string, content string")
    assert S.diagnosed(cases, "chunk_rag", providers, idx, top_n=1)[0]["prompt_id"] == "prompt_1"
    assert "error" in S.diagnosed(cases, "none", providers)[0]
    empty = S.ask_flat(idx.limit(0), "x", providers).first()
    assert empty.response == S.NOTHING_FOUND and empty.chunks_used == 0


def test_structured_index(spark):
    text = "Chapter 1 Sec A " + "cough with wind and cold " * 4 + "Sec B " + "fever with heat and thirst " * 4
    books = spark.createDataFrame([("b", text)], "book_id string, text string")
    tagged = spark.createDataFrame([(0, "1", "1", [("风", "wind")])], "pos long, chapter_id string, section_id string, tags array<struct<tag_zh:string,tag_en:string>>")
    providers = Providers(words={"symptoms": ["cough", "fever"]})
    idx = S.structured_index(books, providers, "Chapter [0-9]", "Sec [AB]", tagged)
    rows = idx.orderBy("vec_id").collect()
    assert [(r.symptoms, r.word_count, len(r.tags)) for r in rows] == [("cough", 20, 1), ("fever", 20, 0)]
    assert rows[0].full_content.endswith("[Related Tags]\n- 风 (wind)") and rows[0].organs_vector is None
    assert S.ask_structured(idx, "fever", providers, "symptoms", top_k=1).first().chunks_used == 1


def test_tagged_books(spark):
    books = spark.createDataFrame([("b", "#CHAPTER\nOne\n#SECTION\nS\ntext\n#SECTION\nT\nmore")], "book_id string, text string")
    kind = "book_id string, chapter_idx int, section_idx int, seq int, tags map<string,array<struct<name_zh:string,name_en:string>>>"
    tag = spark.createDataFrame([("b", 1, 0, 1, {"herb_tags": [("x", "early")]}), ("b", 1, 0, 2, {"herbs_tags": [("x", "first")], "odd": [("z", "z")]}), ("b", 1, 1, 1, {"herb_tags": [("x", "last"), ("y", "y")]})], kind)
    got = {r.name_zh: (r.category, r.name_en, r.first_pos.section_idx) for r in S.tagged_books(books, tag).collect()}
    assert got == {"x": ("herb", "last", 0), "y": ("herb", "y", 1)}


def test_evaluation_run(spark, tmp_path):
    from millrace.operators import results

    files = spark.createDataFrame([("in/a.txt", "cough and fever")], "path string, text string")
    idx = S.flat_index(files, Providers())
    cases = spark.createDataFrame([(0, "cough"), (1, "bad")], "prompt_index int, prompt string")

    def embed(texts):
        if texts == ["bad"]:
            raise OSError("down")
        return Providers().embed(texts)

    rows = S.evaluated(cases, idx, Providers(embed=embed))
    assert [bool(r["error"]) for r in rows] == [False, True] and rows[0]["num_chunks_used"] == 1
    table = spark.createDataFrame(rows)
    assert tuple(results.summary(table).first())[:3] == (2, 1, 1)
    results.write_run(results.consolidated(table), results.summary(table), str(tmp_path), "r1", batch=True)
    assert spark.read.json(str(tmp_path / "responses_batch_r1")).count() == 2
    with pytest.raises(ValueError):
        results.require(table, ["prompt", "missing"])


def knowledge(spark):
    from millrace.operators.dialog import Knowledge

    symptoms = spark.createDataFrame([("a", "咳", "cough", 1, "d"), ("b", "热", "fever", 2, "")], "id string, zh string, en string, seq long, description string")
    syndromes = spark.createDataFrame([("s", "风寒", "wind", 1, "cold", "herb"), ("t", "", "heat", 2, "", "")], "id string, zh string, en string, seq long, description string, herbal_treatments string")
    edges = spark.createDataFrame([("s", "a", 0), ("t", "b", 0), ("t", "gone", 1)], "syndrome string, symptom string, pos int")
    return Knowledge(symptoms, syndromes, edges)


def test_dialog_tools(spark):
    import json

    kb = knowledge(spark)
    assert json.loads(kb.expand_symptom("a"))["syndromes"] == ["s"] and kb.expand_symptom("x").startswith("WARNING")
    found = json.loads(kb.search_syndromes(["b", "a", "x"]))
    assert [r["syndrome_id"] for r in found["results"]] == ["t", "s"] and len(found["warnings"]) == 1
    assert found["results"][0]["symptoms"][1] == {"id": "gone", "name": "<missing>"} and found["results"][0]["score"] == 1.005
    assert kb.search_syndromes(["x"]) == kb.search_syndromes([]) == "WARNING: No valid symptom ids provided."
    assert kb.call("fly", {}).startswith("WARNING") and kb.call("give_diagnosis", {"x": 1}).startswith("ERROR")


def test_conversation_ends(spark):
    kb = knowledge(spark)
    turns = iter([{"tool": "search_syndromes", "arguments": {"symptom_ids": ["a"]}}, {"tool": "give_diagnosis", "arguments": {"syndrome_id": "s"}}])
    log = kb.converse([{"role": "user", "content": "cough"}], lambda _: next(turns))
    assert [m["role"] for m in log] == ["user", "assistant", "tool", "assistant", "tool"] and "herb" in log[-1]["content"]
    assert kb.converse([], lambda _: {"tool": "fly"}, budget=2)[-1]["role"] == "system"
    assert kb.converse([], lambda _: {"content": "hello"})[-1]["content"] == "hello"


def test_local_batches(spark):
    from millrace.sources.providers import LocalBatches

    def chat(prompts):
        if prompts == ["p1"]:
            raise OSError("quota")
        return ["fine"]

    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(3)], "prompt_index long, prompt string")
    service = LocalBatches(chat)
    job = service.submit([r.line for r in E.batch_requests(prompts, "m", "s").orderBy("prompt_index").collect()])
    assert service.status(job)["request_counts"] == {"total": 3, "completed": 2, "failed": 1}
    lines = spark.createDataFrame([(x,) for x in service.results(job)], "value string")
    assert {r.prompt: r.response for r in E.batch_results(lines, prompts).collect()} == {"p0": "fine", "p1": "Error: quota", "p2": "fine"}
    assert service.jobs[job]["status"] == "downloaded"
