from __future__ import annotations

import json

import pytest

from millrace import errors, settings
from millrace.operators import graph, retrieval
from millrace.operators.schemas import graph_tools
from millrace.plans import retrieval_queries as Q
from millrace.sources import files, providers


def test_settings(spark, tmp_path):
    path = tmp_path / "s.json"
    assert settings.load(spark, str(path)) == settings.Settings()
    path.write_text('{"top_k": 9, "model": "m"}')
    assert (settings.load(spark, str(path)).top_k, settings.load(spark, str(path)).model) == (9, "m")
    for bad in ('{"odd": 1}', '{"temperature": 3}', '{"batch_size": 0}'):
        path.write_text(bad)
        with pytest.raises(errors.InvalidInput):
            settings.load(spark, str(path))
    assert set(settings.missing()) <= set(settings.OPTIONAL)


def test_errors():
    @errors.safely(default=list)
    def broken():
        raise errors.ProviderFailed("down")

    assert broken() == []
    assert errors.required({"a": 0}, ["a"]) == {"a": 0}
    with pytest.raises(errors.EngineError, match="prompts lacks b, c"):
        errors.required({"a": 1, "b": ""}, ["a", "b", "c"], "prompts")


def test_tool_calls(spark):
    def chat(prompts, tools):
        if "bad" in prompts:
            raise OSError("down")
        return [{"content": "", "tool_calls": [{"id": "1", "name": tools[0]["function"]["name"], "arguments": '{"x": 1}'}]} if p == "call" else {"content": p} for p in prompts]

    rows = spark.createDataFrame([(0, "call"), (1, "say"), (2, "bad")], "k int, p string")
    got = {r.k: r.turn for r in providers.with_tools(rows, "p", chat, graph_tools()).collect()}
    assert (got[0].tool_calls[0].name, got[1].content, list(got[1].tool_calls), got[2].error) == ("add_symptom_node", "say", [], "OSError: down")


def test_tags_pass_through(spark, sf):
    r, q = Q.records(spark, sf), Q.asked(spark, sf)
    assert [x.vec_id for x in retrieval.search_with_tags(r, q).collect()] == [x.vec_id for x in retrieval.search(r, q).collect()]


def test_graph_as_json(spark, tmp_path):
    node = "id string, zh string, en string, seq long, description string"
    symptoms = spark.createDataFrame([("a", "咳", "cough", 1, "d"), ("b", "", "fever", 2, "")], node)
    syndromes = spark.createDataFrame([("s", "风", "wind", 1, "x", "h")], node + ", herbal_treatments string")
    edges = spark.createDataFrame([("s", "b", 0), ("s", "a", 1)], "syndrome string, symptom string, pos int")
    graph.write_graph(symptoms, syndromes, edges, str(tmp_path))
    lines = [json.loads(x) for p in (tmp_path / "symptoms").glob("part-*") for x in p.read_text().splitlines()]
    assert {x["name"]: x["syndromes"] for x in lines} == {"咳 / cough": ["s"], "fever": ["s"]}
    own = json.loads(graph.as_json(syndromes, edges, "syndrome").first().json)
    assert own == {"id": "s", "name_zh": "风", "name_en": "wind", "description": "x", "herbal_treatments": "h", "symptoms": ["a", "b"], "type": "syndrome", "name": "风 / wind"}


def test_named_files(spark):
    rows = spark.createDataFrame([("x/responses_1.json",), ("x/responses_1.txt",), ("responses_x/a.json",)], "path string")
    assert [r.path for r in files.named(rows, "responses_", ".json").collect()] == ["x/responses_1.json"]


def test_requests_follow_the_settings(spark, tmp_path):
    import json

    from millrace import settings
    from millrace.operators import evaluation

    (tmp_path / "s.json").write_text('{"model": "m", "temperature": 0.1, "max_tokens": 7}')
    prompts = spark.createDataFrame([(0, "p")], "prompt_index long, prompt string")
    body = json.loads(evaluation.requests_of(prompts, settings.load(spark, str(tmp_path / "s.json")), "be brief").first().line)["body"]
    assert (body["model"], body["temperature"], body["max_tokens"]) == ("m", 0.1, 7)
