"""The graph by a log: the same as one call after the other on a plain dictionary of nodes."""

from __future__ import annotations

import json
import random

import pytest

from millrace.operators import graph, oplog, schemas

NODE = "id string, kind string, zh string, en string, seq long, description string, herbal_treatments string"
EDGE = "syndrome string, symptom string, pos long"


def base(spark):
    nodes = [("symp-0001", "symptom", "咳", "cough", 1, "长 / long", ""), ("symp-0004", "symptom", "", "fever", 2, "", ""), ("syn-0002", "syndrome", "风寒", "wind / cold", 3, "d", "桂枝 / cinnamon")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame([("syn-0002", "symp-0001", 0)], EDGE)


def run(spark, log, **kw):
    nodes, edges, said = oplog.apply_log(*base(spark), log, **kw)
    return {r.id: r for r in nodes.collect()}, sorted((r.syndrome, r.symptom) for r in edges.collect()), said


def test_calls_see_those_before_them(spark):
    log = [
        {"op": "add_symptom_node", "args": {"name_zh": "a", "name_en": "", "description_zh": "x", "description_en": "y"}},
        {"op": "add_symptom_node", "args": {"name_zh": "a / b", "name_en": ""}},
        {"op": "add_symptom_node", "args": {"name_zh": "b", "name_en": ""}},
        {"op": "add_syndrome_node", "args": json.dumps({"name_zh": "热", "name_en": "heat", "herbal_zh": "石膏", "herbal_en": "gypsum"})},
        {"op": "link_syndrome_symptom", "args": {"syndrome_name": "HEAT", "symptom_name": "b"}},
        {"op": "split_symptom_node", "args": {"original_name": "b", "children": [{"name_zh": "b1", "name_en": ""}, {"name_zh": "cough", "name_en": ""}]}},
        {"op": "link_syndrome_symptom", "args": {"syndrome_name": "cold", "symptom_name": "b"}},
        {"op": "edit_syndrome_node", "args": {"target_name": "wind", "herbal_en": "twig", "new_name_en": "chill"}},
        {"op": "link_syndrome_symptom", "args": {"syndrome_name": "chill", "symptom_name": "fever"}},
        {"op": "link_syndrome_symptom", "args": {"syndrome_name": "wind", "symptom_name": "nothing"}},
        {"op": "split_symptom_node", "args": {"original_name": "cough", "children": [{"name_zh": "dry", "name_en": "dry"}]}},
    ]
    nodes, edges, said = run(spark, log)
    assert [json.loads(m)["symptom_id"] for m in said[:3]] == ["symp-0005", "symp-0005", "symp-0006"]
    assert nodes["syn-0003"].herbal_treatments == "石膏 / gypsum" and nodes["symp-0005"].description == "x / y"
    assert nodes["syn-0002"].herbal_treatments == "桂枝 / twig" and nodes["syn-0002"].en == "chill" and nodes["syn-0002"].description == "d"
    assert said[9] == "WARNING: Neither found: syndrome=wind, symptom=nothing" and said[5] == "OK: Split b into: b1, 咳 / cough"
    assert edges == sorted([("syn-0002", s) for s in ("symp-0001", "symp-0004", "symp-0006", "symp-0008")] + [("syn-0003", s) for s in ("symp-0001", "symp-0006", "symp-0007", "symp-0008")])


def test_failing_calls_change_nothing(spark):
    nodes, edges, said = run(spark, [{"op": "fly", "args": {}}, {"op": "split_symptom_node", "args": {"original_name": "cough", "children": [3]}}, {"op": "expand_symptom", "args": {"target_name": "cough"}}, {"op": "edit_symptom_node", "args": "broken"}])
    assert [m.split(":")[0] for m in said] == ["WARNING", "ERROR", "ERROR", "WARNING"] and len(nodes) == 3 and edges == [("syn-0002", "symp-0001")]
    assert run(spark, [])[2] == []


def test_expansion_keeps_old_halves(spark):
    log = [{"op": "expand_symptom", "args": {"target_name": "cough"}}, {"op": "expand_syndrome", "args": {"target_name": "wind", "notes": "n"}}]
    asked = []

    def chat(prompts):
        asked.append(prompts[0])
        return ['so: {"description_zh": "更长"} '] if len(asked) == 1 else ["no json"]

    nodes, _, said = run(spark, log, chat=chat, context="the page")
    assert nodes["symp-0001"].description == "更长 / long" and nodes["syn-0002"].herbal_treatments == "桂枝 / cinnamon" and nodes["syn-0002"].description == "d"
    assert all(m.startswith("OK: Expanded") for m in said) and all("the page" in a for a in asked) and "桂枝" in asked[1]


def sequential(known, new):
    """Names of new nodes that are added, one after the other."""
    taken, out = {k for n in known for k in oplog.keys_of(oplog.both(*n), *n)}, []
    for seq, zh, en in new:
        keys = set(oplog.keys_of(oplog.both(zh, en), zh, en))
        if not keys & taken:
            out.append(seq)
            taken |= keys
    return out


@pytest.mark.parametrize("seed", range(3))
def test_added_equals_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["", "a", "B", "a / b", "c(d)", "e,f", "g", "h / a", *(f"n{i}" for i in range(12))])
    new = [(k, name(), name()) for k in range(40)] if seed else [(1, "a", ""), (2, "a / b", ""), (3, "b", "")]
    new = [x for x in new if x[1] or x[2]]
    nodes = spark.createDataFrame([("symp-0001", "N3", "x", 0)], "id string, zh string, en string, seq long")
    got = graph.added(nodes, spark.createDataFrame([(*x, "") for x in new], "seq long, zh string, en string, description string"), "symp", 1).collect()
    assert sorted((r.id, r.seq) for r in got) == [(f"symp-{k:04d}", s) for k, s in enumerate(sequential([("N3", "x")], new), 2)]


def test_rounds_end_without_calls(spark):
    turns = iter([{"tool_calls": [{"id": "1", "name": "add_symptom_node", "arguments": '{"name_zh": "头痛", "name_en": "headache"}'}]}, {"content": "done"}, {"tool_calls": [{"id": "2", "name": "fly"}]}, {"tool_calls": [{"id": "3", "name": "fly"}]}])
    seen = []

    def model(messages, tools):
        seen.append((messages[1]["content"], len(tools)))
        return next(turns)

    nodes, _, logs = oplog.built(*base(spark), ["first", "second"], model, "be brief", rounds=2)
    assert [len(log) for log in logs] == [5, 6] and nodes.count() == 4
    assert "headache" not in seen[0][0] and "headache" in seen[2][0] and seen[0][1] == 8
    assert logs[1][3]["content"] == "WARNING: Tool not implemented: fly"


def test_schemas(spark):
    offered = [*schemas.graph_tools(), *schemas.dialog_tools(), *schemas.tagging_tools()]
    assert len(offered) == 13 and json.dumps(offered)
    kind = schemas.arguments_type("split_symptom_node", schemas.graph_tools())
    assert kind.simpleString() == "struct<original_name:string,children:array<struct<name_zh:string,name_en:string,description_zh:string,description_en:string>>>"
    assert len(schemas.arguments_type("tag_section", offered).names) == 12


def test_a_log_of_too_many_names(spark, monkeypatch):
    monkeypatch.setattr(oplog, "MOST_NAMED", 3)
    calls = [{"op": "add_symptom_node", "args": {"name_zh": f"甲{k}", "name_en": f"a{k}"}} for k in range(4)]
    with pytest.raises(ValueError, match="in parts"):
        oplog.apply_log(*base(spark), calls)
