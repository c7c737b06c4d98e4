"""Queries of tags and of the graph. Parts stand for symptoms, orders for syndromes, line items for the edges; section
tags are part types by return flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import listings as L
from ..operators import tags as T
from .registry import query, table

#: Parts that a symptom query asks for, in its order, one of them twice and one unknown.
ASKED = (5, 9, 1, 5, 77, 1_000_000_000)
_NORM = lambda x: f"lower(regexp_replace({x}, '^{X.SPACE}+|{X.SPACE}+$', '', 'g'))"
_EDGES = "edges as (select l_orderkey as syndrome, l_partkey as symptom, min(l_linenumber) as pos from lineitem group by all)"
_RECORDS = "records as (select o_orderkey, coalesce(list(p_type order by l_linenumber) filter (p_type is not null), []) as tags from orders left join lineitem on l_orderkey = o_orderkey left join part on p_partkey = l_partkey group by 1)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("zh"), F.col("p_name").alias("en"), F.col("p_partkey").alias("seq"), F.concat_ws(" / ", "p_type", "p_brand").alias("description"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("syndrome"), F.col("l_partkey").alias("symptom")).agg(F.min("l_linenumber").alias("pos"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, name_zh, name_en, pos) in reading order."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name")
    rows = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    return rows.select(F.col("l_returnflag").alias("category"), F.col("p_type").alias("name_zh"), F.col("p_name").alias("name_en"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("pos"), "l_orderkey")


def tag_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tagged(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name_zh"))), lambda t: t["name_zh"]).alias("tags"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return orders.join(lists, "l_orderkey", "left").select("l_orderkey", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


@query(f"""with {_RECORDS}, c as (select count(*) as total_records, count(*) filter (len(tags) > 0) as records_with_tags, cast(sum(len(tags)) as bigint) as total_tags from records), u as (select count(distinct t) as unique_tags from (select unnest(tags) as t from records))
select total_records, records_with_tags, total_tags, unique_tags, round(100.0 * records_with_tags / total_records, 2) as coverage, round(cast(total_tags as double) / total_records, 2) as avg_tags from c, u""")
def tag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.report(tag_records(spark, sf_dir))


@query(f"with {_RECORDS} select tag, count(*) as n from (select unnest(tags) as tag from records) group by 1 order by n desc, tag limit 5")
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.most_common(tag_records(spark, sf_dir))


@query("select l_returnflag as category, p_type as name_zh, arg_max(p_name, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) as name_en, min((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) as first_pos from lineitem join part on p_partkey = l_partkey group by 1, 2")
def flatten_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.flattened(tagged(spark, sf_dir))


@query("select p_type as name_zh, arg_min(p_name, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) as name_en, arg_min(l_returnflag, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) as category from lineitem join part on p_partkey = l_partkey group by 1")
def first_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_of_name(tagged(spark, sf_dir), "name_zh").select("name_zh", "name_en", "category")


@query(f"""with t as (select l_orderkey % 500 as chapter_id, l_orderkey % 7 as section_id, l_orderkey as pos, list({{'tag_zh': p_type, 'tag_en': p_name}} order by l_linenumber, p_name, p_type) as tags from lineitem join part on p_partkey = l_partkey group by all),
f as (select chapter_id, section_id, arg_min(tags, pos) as tags from t group by all)
select o_orderkey, coalesce(len(tags), 0) as n_tags, 'text of ' || o_orderkey || case when len(tags) > 0 then chr(10) || chr(10) || '[Related Tags]' || chr(10) || array_to_string(list_transform(tags, lambda x: '- ' || x.tag_zh || ' (' || x.tag_en || ')'), chr(10)) else '' end as content
from orders left join f on f.chapter_id = o_orderkey % 600 and f.section_id = o_orderkey % 7""")
def section_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the tags of the first entry that has their chapter and section, and the text enhanced by them."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("tag_zh"), F.col("p_name").alias("tag_en"))
    rows = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "tag_en", "tag_zh"))).alias("all"))
    entries = lists.select((F.col("l_orderkey") % 500).alias("chapter_id"), (F.col("l_orderkey") % 7).alias("section_id"), F.col("l_orderkey").alias("pos"), F.transform("all", lambda t: F.struct(t["tag_zh"].alias("tag_zh"), t["tag_en"].alias("tag_en"))).alias("tags"))
    sections = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 600).alias("chapter_id"), (F.col("o_orderkey") % 7).alias("section_id"))
    found = T.of_sections(sections, entries)
    return found.select("o_orderkey", F.size("tags").cast("long").alias("n_tags"), T.enhanced(F.concat(F.lit("text of "), F.col("o_orderkey").cast("string")), F.col("tags")).alias("content"))


@query("select p_partkey, p_type as tag_zh from part where p_type in (select p_type from part where p_size <= 5 and p_name <> '' and p_type <> '')")
def tag_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("tag_zh"))
    names = table(spark, sf_dir, "part").filter("p_size <= 5 and p_name <> '' and p_type <> ''").select(F.col("p_type").alias("tag_zh"))
    return T.selected(tags, names).select("p_partkey", "tag_zh")


_KEYS = f"""n as (select p_partkey as id, p_brand || ' / ' || p_name as name, p_brand as zh, p_name as en from part),
keys as (select distinct id, key from (select id, unnest(list_concat([{_NORM('name')}], list_transform(regexp_split_to_array(name, '[/|,;（）()]+'), lambda x: {_NORM('x')}), [{_NORM('zh')}, {_NORM('en')}])) as key from n) where key <> ''),
idx as (select key, max(id) as id from keys group by key)"""


@query(f"with {_KEYS} select key, id from idx")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.name_index(nodes(spark, sf_dir))


@query(f"""with {_KEYS}, a as (select distinct case when p_partkey % 3 = 0 then upper(p_name) when p_partkey % 3 = 1 then p_brand || ' (x)' else 'none ' || p_partkey end as name from part),
k as (select name, unnest(t) as key, generate_subscripts(t, 1) as rank from (select name, list_concat([{_NORM('name')}], list_transform(regexp_split_to_array(name, '[/|,;（）()]+'), lambda x: {_NORM('x')})) as t from a))
select a.name, h.id from a left join (select name, arg_min(id, rank) as id from k join idx using (key) group by name) h using (name)""")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.upper("p_name")).when(key % 3 == 1, F.concat("p_brand", F.lit(" (x)"))).otherwise(F.concat(F.lit("none "), key.cast("string")))
    asked = table(spark, sf_dir, "part").select(name.alias("name")).distinct()
    return G.lookup(asked, G.name_index(nodes(spark, sf_dir)))


@query(f"with {_EDGES} select (select count(*) from part) as symptoms, (select count(*) from orders) as syndromes, (select count(*) from edges) as edges")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.statistics(edges(spark, sf_dir), table(spark, sf_dir, "part"), table(spark, sf_dir, "orders"))


_ASKED = "a as (select symptom, place from (values " + ", ".join(f"({s}, {i})" for i, s in enumerate(s for s in ASKED if s < 10**9)) + ") v(symptom, place))"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(s for s in ASKED if s < 10**9)], "symptom long, place long")


@query(f"""with {_EDGES}, {_ASKED}, l as (select symptom, max(place) as last, count(*) as times from a group by 1), d as (select syndrome, count(*) as degree from edges group by 1),
s as (select syndrome, sum(cast(times as double) / (last + 1)) as s, cast(sum(times) as bigint) as n_match from edges join l using (symptom) group by 1)
select syndrome, round(s + 0.01 / greatest(degree, 1), 6) as score, n_match from s join d using (syndrome) order by s + 0.01 / greatest(degree, 1) desc, syndrome limit 10""")
def syndrome_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ranked(edges(spark, sf_dir), _asked(spark, sf_dir)).select("syndrome", F.round("score", 6).alias("score"), "n_match")


@query("select a.id, p_partkey is not null as valid, case when p_partkey is null then 'WARNING: Symptom id not found: ' || a.id end as warning from (select distinct l_partkey * 3 as id from lineitem) a left join part on p_partkey = a.id")
def validate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 3).alias("id")).distinct()
    return G.validated(asked, nodes(spark, sf_dir))


@query(f"with {_EDGES} select syndrome, symptom, min(pos) as pos from (select * from edges union all select syndrome, symptom + 1000000 * k as symptom, pos from edges, (select unnest([1, 2]) as k) where symptom % 50 = 0) group by all")
def split_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("parent"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return G.split(edges(spark, sf_dir), kids.select("parent", (F.col("parent") + 1_000_000 * F.col("k")).alias("child")))


@query(f"with {_EDGES} select syndrome, symptom, min(pos) as pos from (select * from edges union all select o_orderkey as syndrome, o_custkey as symptom, 99 as pos from orders) group by all")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("syndrome"), F.col("o_custkey").alias("symptom"), F.lit(99).alias("pos"))
    return G.linked(edges(spark, sf_dir), new)


_LINKS = "x as (select o_orderkey, 'syn ' || o_orderkey as sn, case when o_orderkey % 3 <> 0 then o_orderkey end as syn, 'sym ' || o_custkey as mn, case when o_orderkey % 2 <> 0 then o_custkey end as sym from orders)"


@query(f"with {_LINKS} select o_orderkey, case when syn is null and sym is null then 'WARNING: Neither found: syndrome=' || sn || ', symptom=' || mn when syn is null then 'WARNING: Syndrome not found: ' || sn when sym is null then 'WARNING: Symptom not found: ' || mn else 'OK: Linked ' || sn || ' <-> ' || mn end as status from x")
def link_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = o.select("o_orderkey", F.concat(F.lit("syn "), k.cast("string")).alias("syndrome_name"), F.when(k % 3 != 0, k).alias("syndrome"), F.concat(F.lit("sym "), c.cast("string")).alias("symptom_name"), F.when(k % 2 != 0, c).alias("symptom"))
    return G.link_status(asked).select("o_orderkey", "status")


@query("""with c as (select p_partkey as id, case when p_partkey % 2 = 0 then 'N' || p_partkey else '' end as zh, case when p_partkey % 4 = 0 then 'E' || p_partkey end as en, case when p_partkey % 3 = 0 then 'D' || p_partkey end as dz from part)
select p_partkey as id, case when c.zh <> '' then c.zh else p_brand end || ' / ' || coalesce(c.en, p_name) as name, case when c.dz is not null then c.dz else p_type end || ' / ' || p_brand as description from part left join c on c.id = p_partkey""")
def edit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    named = lambda letter: F.concat(F.lit(letter), key.cast("string"))
    changes = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 2 == 0, named("N")).otherwise("").alias("new_zh"), F.when(key % 4 == 0, named("E")).alias("new_en"), F.when(key % 3 == 0, named("D")).alias("new_desc_zh"), F.lit(None).cast("string").alias("new_desc_en"))
    return G.edited(nodes(spark, sf_dir), changes).select("id", "name", "description")


@query("select p_partkey, printf('symp-%04d', p_partkey + 7) as id, cast(p_partkey + 7 as integer) as number from part")
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", X.numbered_id("symp", F.col("p_partkey") + 7).alias("id"))
    return rows.withColumn("number", X.id_number(F.col("id")))


@query("select p_partkey as id, p_partkey || ' - ' || p_brand || ' / ' || p_name as line from part")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.catalog_lines(nodes(spark, sf_dir))


@query(f"with {_EDGES} select syndrome, symptom, coalesce(p_brand || ' / ' || p_name, '<missing>') as name from edges left join part on p_partkey = symptom and p_brand <> 'Brand#13'")
def hydrated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hydrated(edges(spark, sf_dir), nodes(spark, sf_dir).filter("zh <> 'Brand#13'")).select("syndrome", "symptom", "name")


@query(f"with {_EDGES} select p_partkey as id, coalesce(array_to_string(list_sort(list(syndrome) filter (syndrome is not null)), ','), '') as syndromes from part left join edges on symptom = p_partkey group by p_partkey")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.exported(nodes(spark, sf_dir), edges(spark, sf_dir), "symptom")
    return rows.select("id", F.array_join(F.transform("syndromes", lambda s: s.cast("string")), ",").alias("syndromes"))


@query("select l_partkey, l_orderkey, l_quantity from (select *, row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_quantity desc) as rn from lineitem) where rn = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    return T.latest(rows, ["l_partkey"], "seq").select("l_partkey", "l_orderkey", "l_quantity")


@query("select p_partkey, cast(row_number() over (partition by p_brand order by p_partkey) as integer) as rank from part qualify rank <= 2")
def top_two_per_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_of_each(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_brand"], ["p_partkey"], 2).drop("p_brand")


#: Names of new nodes: chains of customers share one or the other name, some have that of a part.
_ZH = "case when c_custkey % 11 = 0 then 'BRAND#' || (c_custkey % 5 + 1) || (c_custkey % 4 + 1) else 'z' || (c_custkey % 37) end"
_EN = "case when c_custkey % 7 = 0 then '' else 'E' || (c_custkey % 23) || ' / e' || (c_custkey % 101) end"


@query(f"""with recursive c as (select row_number() over (order by c_custkey) as i, c_custkey, {_ZH} as zh, {_EN} as en from customer),
k as (select *, list_distinct(list_filter([lower(zh || case when en = '' then '' else ' / ' || en end), lower(zh), lower(en)] || list_transform(string_split(en, '/'), lambda x: lower(trim(x))), lambda x: x <> '')) as keys from c),
known as (select distinct lower(p_brand) as key from part union select lower(p_name) from part union select lower(p_brand || ' / ' || p_name) from part),
fresh as (select *, row_number() over (order by i) as j from k where not list_has_any(keys, (select list(key) from known))),
r as (select 0 as j, cast([] as varchar[]) as taken, false as ok union all select r.j + 1, case when list_has_any(r.taken, f.keys) then r.taken else list_concat(r.taken, f.keys) end, not list_has_any(r.taken, f.keys) from r join fresh f on f.j = r.j + 1)
select printf('symp-%04d', 7 + row_number() over (order by c_custkey)) as id, c_custkey as seq, zh, en from r join fresh using (j) where ok""")
def add_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as new symptoms, in order of their ids, unless a node before has one of their names."""
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.expr(_ZH).alias("zh"), F.expr(_EN).alias("en"), F.lit("").alias("description"))
    return G.added(nodes(spark, sf_dir), new, "symp", 7).select("id", "seq", "zh", "en")


@query("""with e as (select distinct c_nationkey as symptom, o_orderpriority as syndrome from orders join customer on c_custkey = o_custkey),
n as (select n_nationkey, case when n_regionkey = 0 then upper(n_name) || ' (edited)' else n_name end as name from nation),
kids as (select r_regionkey, k, 'part ' || k || ' of ' || (select min(n_name) from nation where n_regionkey = r_regionkey) as name from region, (select unnest([1, 2]) as k))
select syndrome, name from e join n on n_nationkey = symptom
union select syndrome, kids.name from e join nation on n_nationkey = symptom and n_name = (select min(n_name) from nation m where m.n_regionkey = nation.n_regionkey) join kids on r_regionkey = n_regionkey
union select 'region ' || r_name, kids.name from region join kids using (r_regionkey)
union select 'region ' || r_name, n.name from region join nation on n_regionkey = r_regionkey join n using (n_nationkey) where n_name = (select min(n_name) from nation m where m.n_regionkey = r_regionkey)""")
def apply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as symptoms, priorities of their orders as syndromes. A log adds a syndrome for each region, links the region's first
    nation to it, splits that nation in two, and then renames the nations of region 0."""
    from ..operators.oplog import apply_log as run

    nation = table(spark, sf_dir, "nation")
    symptoms = nation.select(F.format_string("symp-%04d", F.col("n_nationkey").cast("int")).alias("id"), F.lit("symptom").alias("kind"), F.lit("").alias("zh"), F.col("n_name").alias("en"), F.col("n_nationkey").cast("long").alias("seq"), F.lit("").alias("description"))
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderpriority", "c_nationkey").distinct()
    number = F.substring("o_orderpriority", 1, 1).cast("int")
    syndromes = pairs.select("o_orderpriority").distinct().select(F.format_string("syn-%04d", number).alias("id"), F.lit("syndrome").alias("kind"), F.lit("").alias("zh"), F.col("o_orderpriority").alias("en"), (100 + number).cast("long").alias("seq"), F.lit("").alias("description"))
    links = pairs.select(F.format_string("syn-%04d", number).alias("syndrome"), F.format_string("symp-%04d", F.col("c_nationkey").cast("int")).alias("symptom"), F.col("c_nationkey").cast("long").alias("pos"))
    regions = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.min("n_name").alias("first")).collect()  # five
    log: list[dict] = []
    for r in sorted(regions):
        log.append({"op": "add_syndrome_node", "args": {"name_zh": "", "name_en": f"region {r.r_name}"}})
        log.append({"op": "link_syndrome_symptom", "args": {"syndrome_name": f"REGION {r.r_name}", "symptom_name": r["first"].lower()}})
        log.append({"op": "split_symptom_node", "args": {"original_name": r["first"], "children": [{"name_zh": "", "name_en": f"part {k} of {r['first']}"} for k in (1, 2)]}})
    names = [r.n_name for r in nation.filter("n_regionkey = 0").collect()]
    log += [{"op": "edit_symptom_node", "args": {"target_name": n, "new_name_en": f"{n.upper()} (edited)"}} for n in names]
    after, edges_after, _ = run(symptoms.unionByName(syndromes), links, log)
    named = after.select("id", X.bilingual(F.col("zh"), F.col("en")).alias("name"))
    named_edges = edges_after.join(named.withColumnRenamed("name", "syndrome_name"), F.col("syndrome") == F.col("id")).drop("id").join(named, F.col("symptom") == F.col("id"))
    return named_edges.select(F.col("syndrome_name").alias("syndrome"), "name")
