"""License scan by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a run of words, wherever lines end in it, of 100 / `PERCENT` times the template's length: so a notice is found however
it is wrapped, and words that are scattered over a long line are not. A block matches a template if it contains `PERCENT` of the
template's distinct words. Words are put in one global order, the rarest in the corpus first (document frequency over the whole
table). Then, for a template of t words of which `need` must be there,

* prefix filter: the text has one of the template's first t - need + 1 words;
* length filter: the text has `need` words of the template at least;
* positional filter: from the word of the template that a block begins with, the next `need` - 1 places of such words lie in it.

What passes all three is counted exactly. Templates are a parameter of bounded size, so they go with the plan as literals: rows are
neither shuffled nor keyed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from ._common import doc_columns

#: Share of a template's words that a block must contain.
PERCENT = 80
#: Phrases that are looked for as they stand (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Statements and whole texts of common licenses (fixed values); a thousand words together.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to
        the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
        holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or
        in connection with the software or the use or other dealings in the software"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be
        liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this
        software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following
        disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
        in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and
        contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and
        fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of
        use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
        including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
        damage"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be
        misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the
        product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be
        misrepresented as being the original software this notice may not be removed or altered from any source distribution"""),
    ("public-domain", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
        sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
        means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law"""),
)
#: What parts words, in Java's regular expressions, after lower-casing.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BREAKS), lambda w: w != "")


#: The one character beyond ASCII that `lower` turns into a letter of ASCII (into k); I with a dot becomes an i with a mark of its own.
KELVIN = "\u212a"


def lowered(text: Column) -> Column:
    """A-Z in lower case. Other letters change too, but no word becomes one of a phrase or of a template by that."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("\ufffd")))


def ordered_templates(docs: DataFrame, percent: int = PERCENT) -> list[tuple[str, list[str], int, int]]:
    """(label, words in the global order, words that a block needs, words of a run); the corpus' counts of template
    words give the order."""
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()})
    found = docs.select(F.explode(F.array_intersect(words(lowered(F.col("text"))), _strings(vocabulary))).alias("w")).groupBy("w").count()
    counts = {r.w: r["count"] for r in found.collect()}  # a row for each word of the templates at most
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    sets = [(label, sorted(set(t.split()), key=rank.__getitem__), len(t.split())) for label, t in TEMPLATES]
    return [(label, own, -(-percent * len(own) // 100), -(-100 * n // percent)) for label, own, n in sets]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def matches(w: Column, known: Column, templates: list[tuple[str, list[str], int, int]]) -> Column:
    """Array of (label, containment) of the templates that a run of the words w matches; known: the distinct words of
    templates among w."""
    order = list(dict.fromkeys(x for _, own, _, _ in templates for x in own))
    each = F.array(*[F.struct(F.lit(label).alias("label"), _strings(own).alias("own"), _strings(own[: len(own) - need + 1]).alias("prefix"), F.lit(need).alias("need"), F.lit(run).alias("run")) for label, own, need, run in templates])
    passes = lambda t: F.arrays_overlap(known, t["prefix"]) & (F.size(F.array_intersect(known, t["own"])) >= t["need"])
    places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(order), F.struct(x.alias("w"), i.alias("i")))), lambda p: p.isNotNull())

    def most(at: Column, t: Column) -> Column:
        """Words of the template t in the run that has most; at: their places."""
        within = lambda p, k: F.filter(F.slice(at, k + 1, t["run"]), lambda q: q["i"] < p["i"] + t["run"])
        return F.array_max(F.transform(at, lambda p, k: F.when(F.get(at, k + t["need"] - 1)["i"] < p["i"] + t["run"], F.size(F.array_distinct(F.transform(within(p, k), lambda q: q["w"]))))))

    def found(all_places: Column) -> Column:
        own = F.transform(F.filter(each, passes), lambda t: F.struct(t.alias("t"), F.filter(all_places, lambda p: F.array_contains(t["own"], p["w"])).alias("at")))
        counted = F.transform(own, lambda o: F.struct(o["t"].alias("t"), most(o["at"], o["t"]).alias("n")))
        return F.transform(F.filter(counted, lambda c: c["n"] >= c["t"]["need"]), lambda c: F.struct(c["t"]["label"].alias("label"), (c["n"] / F.size(c["t"]["own"])).alias("part")))

    none = F.array().cast("array<struct<label:string,part:double>>")
    return F.when(F.exists(each, passes), bound(places, found)).otherwise(none)


def scan(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score: the largest containment of a matching template, 1.0 where a base phrase stands, else 0.0. Null texts are
    empty: no words, empty labels. Repeated rows are scanned each, null ids stay. Other columns are not looked at.
    An empty table gives an empty result.
    """
    rows = doc_columns(docs, "doc_id", "text")
    templates = ordered_templates(rows, percent)
    prefixes = sorted({w for _, own, need, _ in templates for w in own[: len(own) - need + 1]})
    low = rows.select("doc_id", lowered(F.col("text")).alias("low"))
    split = low.select("doc_id", "low", words(F.col("low")).alias("w"))
    gap = BREAKS
    standing = "|".join(f"(?:{gap.join(p.split())})" for p in PHRASES)
    starts = {label: _starts(F.col("w"), phrase.split()) for phrase, label in PHRASES.items()}
    none = F.array().cast("array<int>")
    based = split.withColumn("maybe", F.col("low").rlike(standing))
    placed = based.select("doc_id", "low", "w", *[F.when(F.col("maybe"), at).otherwise(none).alias(f"at_{k}") for k, at in enumerate(starts.values())])
    some = F.arrays_overlap("w", _strings(prefixes))
    vocabulary = sorted({w for _, own, _, _ in templates for w in own})
    listed = placed.withColumn("known", F.when(some, F.array_intersect("w", _strings(vocabulary))).otherwise(F.array().cast("array<string>")))
    matched = listed.withColumn("hits", matches(F.col("w"), F.col("known"), templates))
    every = F.concat(*[f"at_{k}" for k in range(len(starts))])
    labels = F.filter(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, label in enumerate(starts)]), lambda x: x.isNotNull())
    n_base = reduce(lambda a, b: a + b, [F.size(f"at_{k}") for k in range(len(starts))])
    best = F.coalesce(F.array_max(F.col("hits.part")), F.lit(0.0))
    return matched.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, F.col("hits.label")))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def _starts(w: Column, phrase: list[str]) -> Column:
    """Places of a word array at which the phrase stands."""
    hit = lambda x, i: reduce(lambda a, b: a & b, [x == phrase[0], *[F.get(w, i + k) == p for k, p in enumerate(phrase[1:], 1)]])
    return F.filter(F.transform(w, lambda x, i: F.when(hit(x, i), i)), lambda i: i.isNotNull())
