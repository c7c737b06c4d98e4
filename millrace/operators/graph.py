"""A bipartite graph of findings (symptoms) and conditions (syndromes) as node and edge tables.

nodes(id, zh, en, seq, description): seq is the order of insertion. edges(syndrome, symptom, pos). Changes are frames
in, frames out; name indexes are derived, never stored.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bilingual, halves, name_keys, norm, numbered_id, strip
from .ordering import consecutive, discard, written


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, id): every normalised name of every node; of several nodes the one inserted last."""
    keys = nodes.select("id", "seq", F.explode(name_keys(bilingual(F.col("zh"), F.col("en")), F.col("zh"), F.col("en"))).alias("key"))
    return keys.groupBy("key").agg(F.max_by("id", "seq").alias("id"))


def lookup(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked(name) with the node id that its whole name has in the index, or else its first part that is there."""
    none = F.lit("")
    keys = asked.select("name", F.posexplode(name_keys(F.col("name"), none, none)).alias("rank", "key"))
    hits = keys.join(index, "key").groupBy("name").agg(F.min_by("id", "rank").alias("id"))
    return asked.join(hits, "name", "left")


def added(nodes: DataFrame, new: DataFrame, prefix: str, start: int) -> DataFrame:
    """New nodes (zh, en, seq, description) that no node has a name of, with ids from start + 1 on in order of seq.

    As if they were added one after the other: a new node is left out if a node that was added before it has one of its
    names. In a few rounds those whose names no undecided node before them has are added, and whatever shares a name with them
    is left out: that settles names which very many share. What is left are chains of shared names; each connected group of
    them is decided in order, by one fold a group, so the number of rounds doesn't grow with the chains.
    """
    keys = new.select("seq", F.explode(name_keys(bilingual(F.col("zh"), F.col("en")), F.col("zh"), F.col("en"))).alias("key"))
    known = keys.join(name_index(nodes), "key", "left_semi").select("seq").distinct()
    undecided = written(keys.join(known, "seq", "left_anti"), "undecided")
    chosen = []
    for _ in range(ROUNDS):
        if undecided.isEmpty():
            break
        owner = undecided.groupBy("key").agg(F.min("seq").alias("owner"))
        first = undecided.join(owner, "key").groupBy("seq").agg(F.min("owner").alias("least")).filter("least = seq").select("seq")
        first = written(first, "added")
        taken = undecided.join(first, "seq", "left_semi").select("key").distinct()
        out = undecided.join(taken, "key", "left_semi").select("seq").distinct()
        left = written(undecided.join(out, "seq", "left_anti"), "undecided")
        discard(undecided)
        undecided = left
        chosen.append(first)
    if not undecided.isEmpty():
        owner = undecided.groupBy("key").agg(F.min("seq").alias("v"))
        roots = components(undecided.join(owner, "key").select(F.col("seq").alias("u"), "v"))
        grouped = undecided.join(roots.withColumnRenamed("node", "seq"), "seq", "left").withColumn("root", F.coalesce("root", "seq"))
        chosen.append(written(grouped.groupBy("root").applyInPandas(_decided, "seq long"), "added"))
        discard(roots)
    every = reduce(DataFrame.unionByName, chosen) if chosen else new.select("seq").limit(0)
    rows = consecutive(new.join(every, "seq"), ["seq"], "n")
    discard(undecided, *chosen)  # `consecutive` has written what it needs
    return rows.select(numbered_id(prefix, (F.col("n") + start + 1).cast("int")).alias("id"), "zh", "en", "seq", "description")


#: Rounds that names which many share are settled by, before connected groups are folded.
ROUNDS = 3


def _decided(group: pd.DataFrame) -> pd.DataFrame:
    """Which nodes of a connected group are added, one after the other."""
    taken: set[str] = set()
    chosen = []
    for seq, names in group.sort_values("seq").groupby("seq", sort=False)["key"]:
        if taken.isdisjoint(names):
            taken.update(names)
            chosen.append(seq)
    return pd.DataFrame({"seq": chosen}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) reaches, as a written table. Each step ties nodes to the
    smallest neighbour of theirs, and that one's to it, so chains halve."""
    down = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    now, before = written(down(edges), "components"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.written_to = now.written_to
            return out
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        # neighbours above a node go to the smallest one around it, then those below it too
        large = down(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")))
        own = large.groupBy("u").agg(F.min("v").alias("low"))
        small = down(large.join(own, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(own.select("u", F.col("low").alias("v"))))
        after = written(small, "components")
        discard(now)
        now = after


def edited(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with the non-empty fields of changes(id, new_zh, new_en, new_desc_zh, new_desc_en, and for nodes that have
    herbal_treatments new_herbal_zh, new_herbal_en) in place of theirs; a half that is empty keeps what was."""
    rows = nodes.join(changes, "id", "left")
    full = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    old_zh, old_en = halves(F.coalesce(F.col("description"), F.lit("")))
    touched = F.col("new_desc_zh").isNotNull() | F.col("new_desc_en").isNotNull()
    description = F.when(touched, bilingual(F.coalesce(full("new_desc_zh"), old_zh), F.coalesce(full("new_desc_en"), old_en))).otherwise(F.col("description"))
    zh, en = F.coalesce(full("new_zh"), F.col("zh")), F.coalesce(full("new_en"), F.col("en"))
    herbal = []
    if "herbal_treatments" in nodes.columns and {"new_herbal_zh", "new_herbal_en"} <= set(changes.columns):
        old_zh, old_en = halves(F.coalesce(F.col("herbal_treatments"), F.lit("")))
        touched = F.col("new_herbal_zh").isNotNull() | F.col("new_herbal_en").isNotNull()
        herbal = [F.when(touched, bilingual(F.coalesce(full("new_herbal_zh"), old_zh), F.coalesce(full("new_herbal_en"), old_en))).otherwise(F.col("herbal_treatments")).alias("herbal_treatments")]
    elif "herbal_treatments" in nodes.columns:
        herbal = [F.col("herbal_treatments")]
    return rows.select("id", zh.alias("zh"), en.alias("en"), "seq", description.alias("description"), bilingual(zh, en).alias("name"), *herbal)


def linked(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and the new ones (syndrome, symptom, pos), each pair once, at its first place."""
    return edges.unionByName(new).groupBy("syndrome", "symptom").agg(F.min("pos").alias("pos"))


# messages of links and of ids that aren't there, here and below, are fixed values
def link_status(asked: DataFrame) -> DataFrame:
    """asked(syndrome_name, syndrome, symptom_name, symptom): ids are null where nothing was found; a message each."""
    no_syn, no_sym = F.col("syndrome").isNull(), F.col("symptom").isNull()
    message = F.when(no_syn & no_sym, F.concat(F.lit("WARNING: Neither found: syndrome="), "syndrome_name", F.lit(", symptom="), "symptom_name"))
    message = message.when(no_syn, F.concat(F.lit("WARNING: Syndrome not found: "), "syndrome_name")).when(no_sym, F.concat(F.lit("WARNING: Symptom not found: "), "symptom_name"))
    return asked.withColumn("status", message.otherwise(F.concat(F.lit("OK: Linked "), "syndrome_name", F.lit(" <-> "), "symptom_name")))


def split(edges: DataFrame, children: DataFrame) -> DataFrame:
    """children(parent, child) get all edges of their parents, which keep theirs."""
    inherited = edges.join(children, edges.symptom == children.parent).select("syndrome", F.col("child").alias("symptom"), "pos")
    return linked(edges, inherited)


def ranked(edges: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(syndrome, score, n_match): of asked(symptom, place from 0) every matching row counts 1 / (last place of its
    symptom + 1); 0.01 / degree is added. The k best, ties by id."""
    last = asked.groupBy("symptom").agg(F.max("place").alias("last"), F.count(F.lit(1)).alias("times"))
    degree = edges.groupBy("syndrome").agg(F.count(F.lit(1)).alias("degree"))
    hits = edges.select("syndrome", "symptom").distinct().join(F.broadcast(last), "symptom")  # the symptoms of one query
    sums = hits.groupBy("syndrome").agg(F.sum(F.col("times") / (F.col("last") + 1)).alias("sum"), F.sum("times").alias("n_match"))
    score = F.col("sum") + 0.01 / F.greatest(F.col("degree"), F.lit(1))
    return sums.join(degree, "syndrome").select("syndrome", score.alias("score"), "n_match").orderBy(F.desc("score"), "syndrome").limit(k)


def validated(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked(id) with whether there is such a node, and a warning if not."""
    known = nodes.select("id").distinct().withColumn("valid", F.lit(True))
    rows = asked.join(known, "id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    return rows.withColumn("warning", F.when(~F.col("valid"), F.concat(F.lit("WARNING: Symptom id not found: "), F.col("id").cast("string"))))


def hydrated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of their symptoms, <missing> where there is no node."""
    names = nodes.select(F.col("id").alias("symptom"), bilingual(F.col("zh"), F.col("en")).alias("name"))
    return edges.join(names, "symptom", "left").withColumn("name", F.coalesce("name", F.lit("<missing>")))


def catalog_lines(nodes: DataFrame) -> DataFrame:
    """(id, line) with "{id} - {name}", to be shown in order of id."""
    return nodes.select("id", F.concat_ws(" - ", F.col("id").cast("string"), bilingual(F.col("zh"), F.col("en"))).alias("line"))


def statistics(edges: DataFrame, symptoms: DataFrame, syndromes: DataFrame) -> DataFrame:
    counts = [f.agg(F.count(F.lit(1)).alias(n)) for f, n in ((symptoms, "symptoms"), (syndromes, "syndromes"), (edges, "edges"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


def exported(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """Nodes with the sorted ids of their neighbours; side: "symptom" or "syndrome"."""
    other = "syndrome" if side == "symptom" else "symptom"
    links = edges.groupBy(F.col(side).alias("id")).agg(F.array_sort(F.collect_set(other)).alias(f"{other}s"))
    kind = links.schema[f"{other}s"].dataType
    return nodes.join(links, "id", "left").withColumn(f"{other}s", F.coalesce(f"{other}s", F.array().cast(kind)))


def as_json(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """(id, json): each node with its name and its neighbours as the JSON object that graph files hold."""
    rows = exported(nodes, edges, side).withColumns({"type": F.lit(side), "name": bilingual(F.col("zh"), F.col("en"))}).withColumnsRenamed({"zh": "name_zh", "en": "name_en"})
    return rows.select("id", F.to_json(F.struct(*[c for c in rows.columns if c != "seq"])).alias("json"))


def write_graph(symptoms: DataFrame, syndromes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Both sides as JSON lines, in a folder each."""
    for side, nodes in (("symptom", symptoms), ("syndrome", syndromes)):
        as_json(nodes, edges, side).select("json").write.mode("overwrite").text(f"{folder}/{side}s")


def matches_name(name: Column, key: str) -> Column:
    return norm(strip(name)) == key
