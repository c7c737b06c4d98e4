"""Changing the graph by a log of tool calls: the log is folded in order over the few nodes that it names, and what comes
out is applied to the tables in one plan, however long the log is.

nodes(id, kind, zh, en, seq, description, herbal_treatments), edges(syndrome, symptom, pos). A log is what a model asks for
in one round, so it is held by the driver; the tables are only joined with what the log names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.text import bilingual, id_number, name_keys
from ..sources.providers import Chat, parse_arguments
from . import graph

KINDS = {"symptom": "symp", "syndrome": "syn"}
HERBAL = "herbal_treatments"
#: Names of the tools that a model calls (fixed values), and the operations that they stand for.
TOOLS = {
    "add_symptom_node": "add_symptom", "add_syndrome_node": "add_syndrome", "edit_symptom_node": "edit_symptom", "edit_syndrome_node": "edit_syndrome",
    "link_syndrome_symptom": "link", "split_symptom_node": "split_symptom", "expand_symptom": "expand_symptom", "expand_syndrome": "expand_syndrome",
}
#: Other names of an argument (fixed values).
_ALIASES = {"target_name": "target", "original_name": "original", "syndrome_name": "syndrome", "symptom_name": "symptom"}


def both(zh: str | None, en: str | None) -> str:
    return " / ".join(x.strip() for x in (zh or "", en or "") if x.strip())


def parts_of(text: str | None) -> tuple[str, str]:
    """First and last part of a bilingual text; a text of one part has an empty last."""
    parts = (text or "").split(" / ")
    return parts[0], parts[-1] if len(parts) > 1 else ""


def keys_of(*names: str | None) -> list[str]:
    """Distinct normalised names: each whole one, then the parts of the first."""
    whole = [n.strip().lower() for n in names if n]
    parts = [p.strip().lower() for p in re.split(r"[/|,;（）()]+", (names[0] if names else "") or "")]
    return [k for k in dict.fromkeys(whole[:1] + parts + whole[1:]) if k]


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    zh: str
    en: str
    seq: int
    description: str
    herbal: str = ""

    @property
    def name(self) -> str:
        return both(self.zh, self.en)


class Fold:
    """The nodes that a log names, by id and by name, and the changes so far."""

    def __init__(self, index: dict[str, dict[str, str]], nodes: dict[str, Node], numbers: dict[str, int], seq: int, degrees: dict[str, int], chat: Chat | None = None, context: str = "") -> None:
        self.index, self.nodes, self.numbers, self.seq, self.degrees = index, nodes, numbers, seq, degrees
        self.chat, self.context = chat, context
        self.changed: dict[str, Node] = {}
        self.links: dict[tuple[str, str], int] = {}
        #: Nodes whose edges in the table a node shares: itself, and the nodes that it was split from.
        self.shares: dict[str, set[str]] = {i: {i} for i in nodes}

    def find(self, kind: str, name: str | None) -> Node | None:
        own = self.index[kind]
        return next((self.nodes[own[k]] for k in keys_of(name) if k in own), None)

    def put(self, node: Node) -> None:
        self.nodes[node.id] = self.changed[node.id] = node

    def named(self, node: Node) -> None:
        own = self.index[node.kind]
        for k in [k for k, i in own.items() if i == node.id]:
            del own[k]
        own.update(dict.fromkeys(keys_of(node.name, node.zh, node.en), node.id))

    def add(self, kind: str, args: dict) -> Node:
        zh, en = args.get("name_zh") or "", args.get("name_en") or ""
        for known in (both(zh, en), zh, en):
            if found := self.find(kind, known):
                return found
        self.numbers[kind] += 1
        self.seq += 1
        node = Node(f"{KINDS[kind]}-{self.numbers[kind]:04d}", kind, zh, en, self.seq, both(args.get("description_zh"), args.get("description_en")), both(args.get("herbal_zh"), args.get("herbal_en")))
        self.shares[node.id] = set()
        self.put(node)
        self.named(node)
        return node

    def edit(self, node: Node, args: dict) -> Node:
        """The node with the arguments that are there in place of its own; empty ones keep what was."""
        zh, en = (args.get(f"new_name_{x}", args.get(f"name_{x}")) for x in ("zh", "en"))
        if zh is not None or en is not None:
            node = replace(node, zh=zh or node.zh, en=en or node.en)
            self.named(node)
        for field, stem in (("description", "description"), ("herbal", "herbal")):
            new = args.get(f"{stem}_zh"), args.get(f"{stem}_en")
            if new != (None, None) and (field == "description" or node.kind == "syndrome"):
                old = parts_of(getattr(node, field))
                node = replace(node, **{field: both(new[0] or old[0], new[1] or old[1])})
        self.put(node)
        return node

    def link(self, syndrome: str, symptom: str) -> None:
        if (syndrome, symptom) not in self.links:
            self.links[syndrome, symptom] = self.degrees.get(syndrome, 0)
            self.degrees[syndrome] = self.degrees.get(syndrome, 0) + 1

    # --- calls: each gives a message

    def apply(self, op: str, args: dict) -> str:
        # messages that begin with OK: or WARNING:, and the fields of the JSON reply, are fixed values
        name = TOOLS.get(op, op)
        args = {_ALIASES.get(k, k): v for k, v in args.items()}
        if name in ("add_symptom", "add_syndrome"):
            kind = name.removeprefix("add_")
            node = self.add(kind, args)
            return json.dumps({"status": "ok", f"{kind}_id": node.id, "name": node.name}, ensure_ascii=False) if op in TOOLS else f"OK: {node.id} {node.name}"
        if name.startswith(("edit_", "expand_")) and name in TOOLS.values():
            return self.changed_node(*name.split("_"), args)
        if name == "link":
            syn, sym = self.find("syndrome", args.get("syndrome")), self.find("symptom", args.get("symptom"))
            if syn and sym:
                self.link(syn.id, sym.id)
                return f"OK: Linked {syn.name} <-> {sym.name}"
            if syn is None and sym is None:
                return f"WARNING: Neither found: syndrome={args.get('syndrome')}, symptom={args.get('symptom')}"
            return f"WARNING: {'Symptom' if syn else 'Syndrome'} not found: {args.get('symptom' if syn else 'syndrome')}"
        if name == "split_symptom":
            return self.split(args.get("original"), args.get("children") or [])
        return f"WARNING: Tool not implemented: {op}"

    def changed_node(self, what: str, kind: str, args: dict) -> str:
        node = self.find(kind, args.get("target"))
        if node is None:
            return f"WARNING: {kind.title()} not found: {args.get('target')}"
        if what == "expand":
            return f"OK: Expanded {kind} {self.edit(node, self.asked(node, args.get('notes') or '')).name}"
        return f"OK: {kind.title()} updated: {self.edit(node, args).name}"

    def asked(self, node: Node, notes: str) -> dict:
        """A model's longer description; without an answer in JSON the old halves stay."""
        if self.chat is None:
            raise InvalidInput("expanding a node needs a chat provider")
        fields = ["description_zh", "description_en"] + (["herbal_zh", "herbal_en"] if node.kind == "syndrome" else [])
        lines = [f"Write a fuller description of this {node.kind} of traditional Chinese medicine: Chinese, then the same in English.", f"Answer with one JSON object that has the keys {', '.join(fields)} and nothing else.", f"Name: {node.name}", f"Description: {node.description}"]
        lines += [f"Herbal treatments: {node.herbal}"] if node.kind == "syndrome" else []
        answer = self.chat(["\n".join([*lines, f"Notes: {notes}", "From the book:", self.context])])[0]
        got = parse_arguments(answer) or parse_arguments((re.findall(r"(?s)\{.*\}", answer or "") or [""])[0])
        return {k: got.get(k) or "" for k in fields}

    def split(self, original: str | None, children: Sequence[dict]) -> str:
        parent = self.find("symptom", original)
        if parent is None:
            return f"WARNING: Symptom not found: {original}"
        made = []
        for c in children:
            child = self.add("symptom", {k: (v or "").strip() for k, v in c.items()})
            self.shares[child.id] |= self.shares[parent.id]
            for syndrome in [a for a, b in self.links if b == parent.id]:
                self.link(syndrome, child.id)
            made.append(child.name)
        return f"OK: Split {parent.name} into: {', '.join(made)}"


def names_in(args: dict) -> list[str]:
    """All names that a call may look up."""
    own = [args.get(k) for k in ("target", "target_name", "original", "original_name", "syndrome", "syndrome_name", "symptom", "symptom_name")]
    calls = [args, *(c for c in args.get("children") or [] if isinstance(c, dict))]
    names = [(c.get(f"{new}name_zh"), c.get(f"{new}name_en")) for c in calls for new in ("", "new_")]
    return [n for n in [*own, *(both(*map(_text, p)) for p in names), *(x for p in names for x in p)] if isinstance(n, str) and n]


def _text(x) -> str:
    return x if isinstance(x, str) else ""


#: Names in one log at most: they, and the nodes that have them, are on the driver while it is folded.
MOST_NAMED = 100_000


def apply_log(nodes: DataFrame, edges: DataFrame, log: Sequence[dict], chat: Chat | None = None, context: str = "") -> tuple[DataFrame, DataFrame, list[str]]:
    """Applies tool calls ({op, args}) in order to the nodes and edges of a graph, with a message for each; an unknown or
    failing call changes nothing. Calls see what those before them did. A split copies the edges that its parent has at
    that time. nodes without herbal_treatments get an empty column of it."""
    spark = nodes.sparkSession
    if HERBAL not in nodes.columns:
        nodes = nodes.withColumn(HERBAL, F.lit(""))
    calls = []
    for call in log:
        args = parse_arguments(call["args"]) if isinstance(call.get("args"), str) else call.get("args") or {}
        calls.append((call.get("op", ""), args))
    fold = _fold_over(nodes, edges, sorted({k for _, args in calls for n in names_in(args) for k in keys_of(n)}), chat, context)
    messages = []
    for op, args in calls:
        try:
            messages.append(fold.apply(op, args))
        except Exception as e:  # noqa: BLE001  a call that fails is its own message
            messages.append(f"ERROR: Tool {op} failed: {e}")
    if fold.changed:
        rows = [(n.id, n.kind, n.zh, n.en, n.seq, n.description, n.herbal) for n in fold.changed.values()]
        new = spark.createDataFrame(rows, "id string, kind string, zh string, en string, seq long, description string, herbal_treatments string")
        kept = nodes.join(F.broadcast(new.select("id")), "id", "left_anti")  # rows of one log
        nodes = kept.select(nodes.columns).unionByName(new.select([F.col(c).cast(nodes.schema[c].dataType) for c in nodes.columns]))
    shared = [(p, c) for c, parents in fold.shares.items() for p in parents if p != c]
    if shared:
        edges = graph.split(edges, F.broadcast(spark.createDataFrame(shared, "parent string, child string")))
    if fold.links:
        new = spark.createDataFrame([(a, b, p) for (a, b), p in fold.links.items()], "syndrome string, symptom string, pos long")
        edges = graph.linked(edges, new.select([F.col(c).cast(edges.schema[c].dataType) for c in edges.columns]))
    return nodes, edges, messages


def _fold_over(nodes: DataFrame, edges: DataFrame, keys: list[str], chat: Chat | None, context: str) -> Fold:
    """The nodes that have one of the keys as a name, the last number of each kind, and the degrees of the syndromes."""
    spark = nodes.sparkSession
    row = F.struct("id", "kind", "zh", "en", "seq", "description", HERBAL).alias("node")
    named = nodes.select("kind", "seq", row, F.explode(name_keys(bilingual(F.col("zh"), F.col("en")), F.col("zh"), F.col("en"))).alias("key"))
    if len(keys) > MOST_NAMED:
        raise InvalidInput(f"a log of more than {MOST_NAMED} names: apply it in parts, one after the other")
    asked = F.broadcast(spark.createDataFrame([(k,) for k in keys], "key string"))  # MOST_NAMED names at most, and a node of each kind for each
    found = named.join(asked, "key").groupBy("kind", "key").agg(F.max_by("node", "seq").alias("node")).collect()
    index: dict[str, dict[str, str]] = {k: {} for k in KINDS}
    own: dict[str, Node] = {}
    for r in found:
        index.setdefault(r.kind, {})[r.key] = r.node.id
        own[r.node.id] = Node(r.node.id, r.kind, r.node.zh or "", r.node.en or "", r.node.seq, r.node.description or "", r.node[HERBAL] or "")
    counts = {r.kind: r for r in nodes.groupBy("kind").agg(F.max(id_number(F.col("id"))).alias("last"), F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")).collect()}
    numbers = {k: max(counts[k].last or 0, counts[k].n) if k in counts else 0 for k in KINDS}
    syndromes = [i for i, n in own.items() if n.kind == "syndrome"]
    degrees = {}
    if syndromes:
        of = F.broadcast(spark.createDataFrame([(i,) for i in syndromes], "syndrome string"))
        degrees = {r.syndrome: r.n for r in edges.join(of, "syndrome").groupBy("syndrome").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Fold(index, own, numbers, max((r.seq or 0 for r in counts.values()), default=0), degrees, chat, context)


# --- building a graph by rounds of a model --------------------------------------------------------

Model = Callable[[list[dict], list[dict]], dict]


def built(nodes: DataFrame, edges: DataFrame, texts: Sequence[str], model: Model, instructions: str = "", rounds: int = 8, chat: Chat | None = None, cut: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> tuple[DataFrame, DataFrame, list[list[dict]]]:
    """The graph after a model has read the texts, one conversation each: it is given the names that are there and the
    text, and calls tools until it calls none, or for `rounds` turns. All calls of a turn are applied in one plan.

    model(messages, tool schemas) -> {content, tool_calls: [{id, name, arguments}]}. cut writes a table and reads it again,
    so that plans don't grow with the rounds. The conversations come back too.
    """
    from .results import names_memory
    from .schemas import graph_tools

    logs = []
    for text in texts:
        lists = {r.kind: r.names for r in nodes.groupBy("kind").agg(F.collect_set(bilingual(F.col("zh"), F.col("en"))).alias("names")).collect()}  # shown to a model, so of bounded number
        memory = [nodes.sparkSession.range(1).select(names_memory(F.array(*[F.lit(x) for x in lists.get(k, [])]), f"{k.title()}s")).first()[0] for k in KINDS]
        log: list[dict] = [{"role": "system", "content": instructions}, {"role": "user", "content": "\n\n".join([*memory, text])}]
        for turn in range(rounds):
            said = model(log, graph_tools())
            calls = said.get("tool_calls") or []
            log.append({"role": "assistant", "content": said.get("content") or "", "tool_calls": calls})
            if not calls:
                break
            nodes, edges, messages = apply_log(nodes, edges, [{"op": c["name"], "args": c.get("arguments") or "{}"} for c in calls], chat, text)
            nodes, edges = cut(nodes, f"nodes-{len(logs)}-{turn}"), cut(edges, f"edges-{len(logs)}-{turn}")
            log += [{"role": "tool", "tool_call_id": c.get("id"), "name": c["name"], "content": m} for c, m in zip(calls, messages, strict=True)]
        logs.append(log)
    return nodes, edges, logs
