"""Tools over the graph for a conversation, and the conversation itself: one tool call a turn, a budget, an end.

A tool answers a person's question about few nodes, so its result is a JSON text; what it reads is joined and ranked on
the executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

BUDGET = 30
Model = Callable[[list[dict]], dict]


class Knowledge:
    """symptoms(id, zh, en, seq, description), syndromes (the same and herbal_treatments), edges(syndrome, symptom, pos)."""

    def __init__(self, symptoms: DataFrame, syndromes: DataFrame, edges: DataFrame) -> None:
        self.symptoms, self.syndromes, self.edges = symptoms, syndromes, edges
        self.tools: dict[str, Callable[..., str]] = {"expand_symptom": self.expand_symptom, "search_syndromes": self.search_syndromes, "give_diagnosis": self.give_diagnosis}

    def expand_symptom(self, symptom_id: str) -> str:
        node = graph.exported(self.symptoms.filter(F.col("id") == symptom_id), self.edges, "symptom").first()
        if node is None:
            return f"WARNING: Symptom id not found: {symptom_id}"
        return _json({"symptom_id": node.id, "name": _name(node), "description": node.description or "", "syndromes": node.syndromes})

    def search_syndromes(self, symptom_ids: Sequence[str], k: int = 10) -> str:
        """The k best syndromes of the valid ids in their order, each with all its symptoms; warnings for the others."""
        spark = self.edges.sparkSession
        if not symptom_ids:
            return "WARNING: No valid symptom ids provided."
        asked = spark.createDataFrame([(s, i) for i, s in enumerate(symptom_ids)], "id string, at long")
        valid = {r.id for r in graph.validated(asked.select("id").distinct(), self.symptoms).filter("valid").collect()}
        own = [s for s in symptom_ids if s in valid]
        if not own:
            return "WARNING: No valid symptom ids provided."
        best = graph.ranked(self.edges, spark.createDataFrame([(s, i) for i, s in enumerate(own)], "symptom string, place long"), k)
        ranked = best.join(self.syndromes, F.col("syndrome") == F.col("id")).orderBy(F.desc("score"), "syndrome").collect()
        if not ranked:
            return "WARNING: No matching syndromes for the given symptoms."
        chosen = self.edges.join(F.broadcast(best.select("syndrome")), "syndrome")
        names: dict[str, list] = {}
        for r in graph.hydrated(chosen, self.symptoms).orderBy("syndrome", "pos").collect():  # the symptoms of k syndromes
            names.setdefault(r.syndrome, []).append({"id": r.symptom, "name": r.name})
        results = [{"syndrome_id": r.syndrome, "name": _name(r), "description": r.description or "", "symptoms": names[r.syndrome], "score": round(r.score, 4), "matched_symptom_ids": [s for s in own if any(x["id"] == s for x in names[r.syndrome])]} for r in ranked]
        out: dict = {"query_symptom_ids": own, "results": results}
        if len(own) < len(symptom_ids):
            out["warnings"] = [f"WARNING: Symptom id not found: {s}" for s in symptom_ids if s not in valid]
        return _json(out)

    def give_diagnosis(self, syndrome_id: str) -> str:
        node = self.syndromes.filter(F.col("id") == syndrome_id).first()
        if node is None:
            return f"WARNING: Syndrome id not found: {syndrome_id}"
        ids = [r.symptom for r in self.edges.filter(F.col("syndrome") == syndrome_id).orderBy("pos").collect()]
        return _json({"syndrome_id": node.id, "name": _name(node), "description": node.description or "", "herbal_treatments": node.asDict().get("herbal_treatments") or "", "symptom_ids": ids})

    def call(self, name: str, arguments: dict) -> str:
        if name not in self.tools:
            return f"WARNING: Unknown tool: {name}"
        try:
            return self.tools[name](**arguments)
        except TypeError as e:
            return f"ERROR: {name}: {e}"

    def converse(self, messages: list[dict], model: Model, budget: int = BUDGET) -> list[dict]:
        """messages with the model's turns ({content} or {tool, arguments}) and the tools' answers, until the model says
        something, a diagnosis is given, or the budget of calls is spent."""
        log = list(messages)
        for _ in range(budget):
            turn = model(log)
            log.append({"role": "assistant", **turn})
            if not turn.get("tool"):
                return log
            answer = self.call(turn["tool"], turn.get("arguments") or {})
            log.append({"role": "tool", "name": turn["tool"], "content": answer})
            if turn["tool"] == "give_diagnosis" and not answer.startswith(("WARNING", "ERROR")):
                return log
        log.append({"role": "system", "content": "The budget of tool calls is spent."})
        return log


def _name(row) -> str:
    return " / ".join(x.strip() for x in (row.zh or "", row.en or "") if x.strip())


def _json(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False)
