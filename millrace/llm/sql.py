"""DuckDB SQL for the corpus queries that SQL can express, by plain comparison of everything with everything that
could match. Language ID, toxicity (models), tokenisers and byte strings are tested against brute force instead."""

from __future__ import annotations

from . import collocations, kdmeans, license, quality

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FILLED = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_scan() -> str:
    phrases = " union all ".join(f"select '{label}' as label, ['{"', '".join(p.split())}'] as p" for p, label in license.PHRASES.items())
    templates = " union all ".join(f"select {k} as tid, '{label}' as label, {-(-100 * len(t.split()) // license.PERCENT)} as run, list_distinct(['{"', '".join(t.split())}']) as t" for k, (label, t) in enumerate(license.TEMPLATES))
    # one count for each word of a template, of the distinct ones in the run that begins with it; runs differ in length
    runs = " union all ".join(f"select r, tid, count(distinct word) over (partition by r, tid order by s range between current row and {run - 1} following) as shared from places where run = {run}" for run in sorted({-(-100 * len(t.split()) // license.PERCENT) for _, t in license.TEMPLATES}))
    return f"""
    with d as (select row_number() over () as r, doc_id, {LOWER} as low from documents),
    w as (select r, doc_id, low, regexp_extract_all(low, '{ALNUM}') as w from d),
    phrases as ({phrases}), templates as ({templates}),
    base as (select r, label, s from (select r, w, label, p, unnest(range(1, len(w) - len(p) + 2)) as s from w, phrases) where w[s : s + len(p) - 1] = p),
    based as (select r, count(*) as n, min(s) - 1 as lo, max(s) - 1 as hi, array_to_string(list_sort(list(distinct label)), ',') as labels from base group by r),
    vocabulary as (select tid, run, len(t) as size, unnest(t) as word from templates),
    enough as (select r, tid from (select r, unnest(list_distinct(w)) as word from w) join vocabulary using (word) group by r, tid, size having 100 * count(*) >= {license.PERCENT} * size),
    places as (select r, tid, run, s, word from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as s from w where r in (select r from enough)) join vocabulary using (word) join enough using (r, tid)),
    runs as ({runs}),
    parts as (select r, label, shared / len(t) as part from (select r, tid, max(shared) as shared from runs group by r, tid) join templates using (tid) where 100 * shared >= {license.PERCENT} * len(t)),
    best as (select r, max(part) as part from parts group by r),
    named as (select r, array_to_string(list_sort(list(distinct label)), ',') as labels from (select r, label from base union select r, label from parts) group by r)
    select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(based.n, 0) as bigint) as n_base, cast(based.lo as bigint) as first_word, cast(based.hi as bigint) as last_word,
      coalesce(based.labels, '') as base_labels, coalesce(named.labels, '') as labels, cast(case when based.n > 0 then 1.0 else coalesce(best.part, 0.0) end as double) as score
    from w left join based using (r) left join best using (r) left join named using (r)"""


def quality_rules() -> str:
    white = "[\\x20\\x09-\\x0D]"
    text = lambda x: f"length(regexp_replace({x}, '{white}', '', 'g'))"
    navigation = quality.NAVIGATION.replace("'", "''")
    return f"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    w as (select r, doc_id, text, regexp_extract_all(text, '{FILLED}') as w from d),
    windows as (select r, s, count(*) over (partition by r, k) as c from (select r, s, array_to_string(w[s : s + 4], ' ') as k from (select r, w, unnest(range(1, len(w) - 3)) as s from w))),
    again as (select r, count(distinct p) as n from (select r, unnest(range(s, s + 5)) as p from windows where c > 1) group by r),
    lines as (select r, line from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{FILLED}')),
    judged as (select r, line, {text("line")} as chars, {text("line")} - {text("regexp_replace(line, '[!?#*$%&|<>~^_=+{}\\[\\]\\\\]', '', 'g')")} as marks,
      length(line) - length(replace(line, ' | ', '  ')) as bars, lower(line) as low from lines),
    failing as (select r, sum(chars) as lost from judged where chars = 0 or 100 * marks > {quality.MOST_MARKS} * chars or bars >= 3
      or (length(line) <= {quality.SHORT} and length(line) - length(regexp_replace(line, '{quality.SOLID}', '', 'g')) <= {quality.MOST_SOLID}
        and (regexp_matches(low, '{navigation}') or regexp_matches(low, '{quality.BOILERPLATE}'))) group by r),
    dup as (select r, count(*) - count(distinct line) as n from lines group by r),
    counted as (select w.doc_id, len(w.w) as n_words, length(array_to_string(w.w, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
      coalesce(dup.n, 0) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words, coalesce(failing.lost, 0) as lost
      from w left join dup using (r) left join again using (r) left join failing using (r)),
    based as (select *, n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words as base_failed from counted)
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
      cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and 100 * lost <= {quality.MOST_LOST} * word_chars as kept from based"""


def ngram_jaccard() -> str:
    return f"""
    with recursive d as (select doc_id, regexp_extract_all({LOWER}, '{FILLED}') as w from documents),
    s as (select distinct doc_id, k from (select doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[p : p + 4], ' ') end as k
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as p from d where len(w) > 0))),
    n as (select doc_id, count(*) as n from s group by doc_id),
    common as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
    links as (select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
    sides as (select x, y from links union all select y, x from links),
    reached as (select doc_id as x, doc_id as root from documents union select sides.y, reached.root from reached join sides on sides.x = reached.x where reached.root < sides.y)
    select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.root as component_id
    from d left join n using (doc_id) join (select x, min(root) as root from reached group by x) r on r.x = d.doc_id"""


def decontamination() -> str:
    return f"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '{ALNUM}') as w from documents),
    b as (select cast(item_id as varchar) as item, regexp_extract_all({LOWER}, '{ALNUM}') as w from benchmark),
    items as (select distinct item, m, array_to_string(w[s : s + m - 1], ' ') as k from (select item, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from b where len(w) > 0)),
    places as (select r, m, s, array_to_string(w[s : s + m - 1], ' ') as k from (select r, w, m, unnest(range(1, len(w) - m + 2)) as s from d, (select distinct m from items))),
    hits as (select r, s, p.m, item from places p join items i on p.m = i.m and p.k = i.k),
    words as (select r, count(distinct p) as n from (select r, unnest(range(s, s + m)) as p from hits) group by r),
    named as (select r, count(distinct item) as n, array_to_string(list_sort(list(distinct item)), ',') as items from hits group by r)
    select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(words.n, 0) as bigint) as n_hit, cast(coalesce(named.n, 0) as bigint) as n_items,
      sha256(coalesce(named.items, '')) as items_sha256, words.n is not null as contaminated
    from d left join words using (r) left join named using (r)"""


def substring_dedup(source: str = "documents") -> str:
    return f"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{FILLED}') as w from {source}),
    places as (select r, s, array_to_string(w[s : s + 34], ' ') as k from (select r, w, unnest(range(1, len(w) - 33)) as s from d)),
    again as (select r, s from (select r, s, count(*) over (partition by k) as c from places) where c > 1),
    covered as (select distinct r, unnest(range(s, s + 35)) as p from again),
    kept as (select r, count(*) as n, string_agg(word, ' ' order by p) as text from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) left join covered c using (r, p) where c.r is null group by r)
    select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from d left join kept using (r)"""


def phrase_collocation(least: int, longest: int, top: int) -> str:
    join = lambda lo, hi: f"array_to_string(w[{lo} : {hi}], ' ')"
    return f"""
    with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
    total as (select lang, cast(sum(len(w)) as hugeint) as n from p group by lang),
    starts as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as s from p, range(1, {longest + 1}) t(m)),
    f as (select lang, m, {join("s", "s + m - 1")} as phrase, cast(count(*) as hugeint) as f from starts group by all),
    c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= {least}),
    cuts as (select c.lang, c.phrase, c.a, k, h.f as l, t.f as r, n, (1000 * c.a * n) // (h.f * t.f) as score
      from (select *, unnest(range(1, m)) as k from c) c join f h on h.lang = c.lang and h.phrase = {join("1", "k")} join f t on t.lang = c.lang and t.phrase = {join("k + 1", "c.m")} join total on total.lang = c.lang),
    best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    inner_ as (select lang, a, {join("s", "s + size - 1")} as phrase from (select *, unnest(range(1, m - size + 2)) as s from (select *, unnest(range(2, m)) as size from c))),
    dropped as (select distinct lang, phrase from best join inner_ i using (lang, phrase) where 100 * i.a >= 100 * best.a),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from best anti join dropped using (lang, phrase))
    select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= {top}"""


def centroid_clustering(k: int, rounds: int, dims: int, scale: int, seed: str) -> str:
    steps = "".join(
        f"""
    a{n} as materialized (select r, c, d from (select r, c, sum((x - y) * (x - y)) as d from e join c{n} using (i) group by r, c) qualify row_number() over (partition by r order by d, c) = 1),
    c{n + 1} as materialized (select c, i, cast(case when n is null then y else (s - ((s % n) + n) % n) // n end as bigint) as y
      from c{n} left join (select c, i, sum(x) as s, count(*) as n from e join a{n} using (r) group by c, i) using (c, i)),"""
        for n in range(rounds)
    )
    return f"""
    with kept as materialized (select row_number() over () as r, vec_id, [cast(floor(cast(x as double) * {scale}) as bigint) for x in embedding] as v from embeddings
      where len(embedding) = {dims} and len([x for x in embedding if x is not null and isfinite(x)]) = {dims}),
    e as materialized (select r, unnest(range(1, {dims + 1})) as i, unnest(v) as x from kept),
    c0 as materialized (select c, unnest(range(1, {dims + 1})) as i, unnest(v) as y from (select v, row_number() over (order by sha256('{seed}' || vec_id) nulls last, v) - 1 as c from kept) where c < {k}),{steps}
    last as materialized (select r, c, d from (select r, c, sum((x - y) * (x - y)) as d from e join c{rounds} using (i) group by r, c) qualify row_number() over (partition by r order by d, c) = 1),
    digests as (select c, sha256(string_agg(cast(y as varchar), ',' order by i)) as h from c{rounds} group by c)
    select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, h as centroid_sha256
    from kept join last using (r) join digests using (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan(), "op4_ngram_jaccard": ngram_jaccard(), "op6_quality_rules": quality_rules(), "op7_decontamination": decontamination(), "op10_substring_dedup": substring_dedup(), "op11_phrase_collocation": phrase_collocation(collocations.LEAST, collocations.LONGEST, collocations.TOP), "op13_centroid_clustering": centroid_clustering(kdmeans.K, kdmeans.ROUNDS, kdmeans.DIMS, kdmeans.SCALE, kdmeans.SEED)}
