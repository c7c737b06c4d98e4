"""Whole questions over an index: expansion by tags, translations, batches, failing cases."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import retrieval as R
from millrace.operators import serving as S
from millrace.sources import providers as P

RECORD = "vec_id long, book_id string, chapter_index long, section_index long, section_title string, full_content string, tags array<struct<tag_zh:string,tag_en:string>>, patterns_vector array<double>, full_content_vector array<double>"


def records(spark):
    v = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.9, 0.1], [0.0, 0.0, 1.0]]
    tags = [[("风", "wind")], [("热", "heat")], [], []]
    return spark.createDataFrame([(k, "b", 0, k, f"S{k}", f"text {k}", tags[k], v[k], v[k]) for k in range(4)], RECORD)


def tag_vectors(spark):
    rows = [("风", [1.0, 0.0], [1.0, 0.0, 0.0]), ("寒", [0.9, 0.1], [0.0, 1.0, 0.0]), ("热", [0.0, 1.0], [0.0, 0.0, 1.0])]
    return spark.createDataFrame(rows, "tag string, embedding array<double>, q array<double>")


def test_structured_question(spark):
    providers = P.Providers(embed=lambda texts: [[1.0, 0.1, 0.0] for _ in texts])
    r = S.ask_structured(records(spark), "what", providers, "multi_vector", 1, tag_vectors=tag_vectors(spark)).first()
    assert [(x.rank, x.vec_id, x.source) for x in r.results] == [(1, 0, "search"), (2, 1, "tag"), (3, 2, "tag")]
    assert [(a.dist, a.adjacent) for a in r.results[0].adjacent] == [(1, 1), (2, 2)] and r.results[1].adjacent is None
    assert r.chunks_used == 3 and r.context.startswith("From S0: text 0\nFrom S1: ") and r.chinese_response.startswith("回答")
    plain = S.ask_structured(records(spark), "what", providers, "patterns", 2, weights={"full_content_vector": 1.0}).first()
    assert [x.vec_id for x in plain.results] == [0, 1] and plain.search_type == "patterns"
    none = S.ask_structured(records(spark).limit(0), "what", providers, tag_vectors=tag_vectors(spark)).first()
    assert (none.response, none.chunks_used, none.results, none.error) == (S.NOTHING_FOUND, 0, [], None)


def flat(spark):
    rows = [(k, f"f{k}.txt", t, v) for k, (t, v) in enumerate([("cough", [1.0, 0.0]), ("cold", [0.0, 1.0]), ("wind", [0.6, 0.8])])]
    return spark.createDataFrame(rows, "vec_id long, source string, text string, embedding array<double>")


def test_chunks_are_translated(spark):
    asked = []

    def chat(prompts):
        return [f"{len(p)}" for p in prompts]

    providers = P.Providers(embed=lambda texts: [[1.0, 0.0] for _ in texts], chat=chat)
    r = S.ask_flat(flat(spark), "q", providers, 1, system_prompt="Be brief.", translate=lambda texts: [f"en {t}" for t in texts]).first()
    assert [(c.vec_id, c.english_text) for c in r.chunks] == [(0, "en cough"), (1, "en cold")] and r.chunks[0].similarity == 1.0
    bare = S.ask_flat(flat(spark), "q", providers, 1).first()
    assert int(r.response) - int(bare.response) == len("Be brief.\n\n") and bare.chunks[0].english_text == ""

    def broken(texts):
        raise OSError("down")

    assert S.ask_flat(flat(spark), "q", providers, 1, translate=broken).first().chunks[0].english_text == ""
    assert asked == []


def test_many_equal_one_at_a_time(spark):
    def embed(texts):
        if "bad" in texts:
            raise OSError("down")
        return [[1.0, 0.0] if t == "a" else [0.0, 1.0] if t == "b" else [] for t in texts]

    providers = P.Providers(embed=embed)
    many = sorted(S.ask_many(flat(spark), ["a", "bad", "b", "none"], providers, 2).collect(), key=lambda r: r.qid)
    for k, q in ((0, "a"), (2, "b"), (3, "none")):
        one = S.ask_flat(flat(spark), q, providers, 2).first()
        assert (many[k].context, many[k].response, many[k].chunks_used) == (one.context, one.response, one.chunks_used)
    assert many[1].error == "OSError: down" and many[1].response is None and many[1].chunks_used == 0


@pytest.mark.parametrize("most", [R.MOST_QUERIES, 3])
def test_top_many_and_similar_tags_equal_a_full_product(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_QUERIES", most)
    rng = np.random.default_rng(0)
    rows = [(k, (rng.integers(-2, 3, 4 if k % 5 else 3)).astype(float).tolist()) for k in range(40)] + [(40, None), (41, [])]
    asked = [(k, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(9)] + [(9, [0.0] * 4), (10, [1.0, 2.0, 0.5]), (11, None)]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if a and b and len(a) == len(b) and np.any(a) and np.any(b) else 0.0
    index, queries = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), spark.createDataFrame(asked, "qid long, q array<double>")
    got = {(r.qid, r["rank"]): (round(r.score, 9), r.vec_id) for r in R.top_many(index, queries, 4, "vec_id").collect()}
    for q, v in asked:
        best = sorted(((-round(cos(e, v), 9), i) for i, e in rows))[:4]
        assert [got.get((q, k + 1)) for k in range(4)] == ([(-s, i) for s, i in best] if v else [None] * 4)
    tags = R.similar_tags(index.withColumnRenamed("vec_id", "tag"), queries.select("q"), 50, 0.5).collect()
    want = {i: max([0.0, *(cos(e, v) for _, v in asked)]) for i, e in rows}
    assert {r.tag: round(r.similarity, 9) for r in tags} == {i: round(s, 9) for i, s in want.items() if s >= 0.5}


def test_providers_in_batches():
    sizes = []

    def call(texts):
        sizes.append(len(texts))
        if "x" in texts:
            raise ValueError("x")
        return [t.upper() for t in texts]

    assert P.one_by_one(call, ["a", "x", "b", "c", "d", "e"], 5) == [("A", None), (None, "ValueError: x"), ("B", None), ("C", None), ("D", None), ("E", None)]
    assert sizes == [5, 1, 1, 1, 1, 1, 1]
    turns = iter([[], [1, 2], [{"name": "tag_section"}]])
    log = [{"role": "user", "content": "text"}]
    assert P.called_once(lambda m: next(turns), log, "once, please") == {"name": "tag_section"} and log[0]["content"] == "text"
    assert P.called_once(lambda m: [], log, "again") is None


def test_selected_tags(spark):
    sections = spark.createDataFrame([(1, "咳 " * 3000), (2, "x")], "id long, content string")
    every = [{"tag_zh": "咳", "tag_en": "cough"}, {"tag_zh": "", "tag_en": "none"}, {"tag_zh": "热", "tag_en": "heat"}]
    got = {r.id: [t.tag_en for t in r.related_tags] for r in S.selected_tags(sections, every, lambda ps: ["咳, 热 ,无" if "咳 咳" in p and len(p) < 2300 else " , " for p in ps]).collect()}
    assert got == {1: ["cough", "heat"], 2: []}
    assert S.selected_tags(sections, [], lambda ps: ps).first().related_tags == []


def test_structured_batch(spark):
    cases = spark.createDataFrame([(0, "a"), (1, "bad")], "prompt_index int, prompt string")

    def embed(texts):
        if texts == ["bad"]:
            raise OSError("down")
        return [[1.0, 0.0, 0.0] for _ in texts]

    rows = S.evaluated_structured(cases, records(spark), P.Providers(embed=embed))
    assert [r["success"] for r in rows] == [True, False] and rows[0]["chunks_used"] == 4 and rows[1]["error"] == "OSError: down"
    found = S.diagnosed(spark.createDataFrame([("p", "a")], "prompt_id string, content string"), "tag_rag", P.Providers(embed=embed), records(spark))
    assert found[0]["chunks_used"] == 4 and "error" not in found[0]
