"""What the line rules take out and what they leave; letters that lower-casing must not turn into A-Z."""

from __future__ import annotations

import pytest
from conftest import oracle_rows, rows_of

from millrace.llm import license, quality, sql

PROSE = [
    "We baked oatmeal cookies for the school fair and sold every one of them before the rain came down.",
    "The author explains at length why javascript became the language of the web, and what came after it.",
    "Their lawyers rewrote the privacy policy of the whole company after the court had ruled against it in the spring of that year.",
    "She reminded the committee that a subscribe to button had cost them more readers than any other change that they made.",
]
#: Sentences of other scripts that mention such phrases, and short lines of them that are little else.
SCRIPTS = [
    "В прошлом году наша компания решила переписать документ privacy policy, потому что юристы нашли в нём много ошибок, и новая версия появилась на сайте только весной этого года",
    "Η εταιρεία αποφάσισε να ξαναγράψει ολόκληρο το κείμενο privacy policy, επειδή οι δικηγόροι βρήκαν πολλά λάθη μέσα σε αυτό και η νέα έκδοση εμφανίστηκε την άνοιξη",
    "去年我们公司决定重新编写这份名为 privacy policy 的文件，因为律师在其中发现了许多错误，而新的版本直到今年春天才出现在网站上。",
    "昨年、私たちの会社は privacy policy という文書を書き直すことにしました。弁護士が多くの誤りを見つけたからです。",
    "ปีที่แล้วบริษัทของเราตัดสินใจเขียนเอกสาร privacy policy ใหม่ เพราะทนายความพบข้อผิดพลาดมากมาย",
    "home — так называли мы этот старый дом на берегу реки, где прошло всё наше детство и куда мы вернулись",
]
SHORT = ["Прочтите: privacy policy", "Η privacy policy μας", "版权所有 All rights reserved", "home Главная", "menu 主页"]
LINES = ["All rights reserved.", "© Copyright 2020 Example Ltd. All rights reserved.", "This website uses cookies.", "Cookie policy", "Please enable JavaScript to view this page.", "Read our privacy policy", "Alle Rechte vorbehalten", "Tous droits réservés.", "Política de privacidad", "Zurück", "Home"]


def tables(spark):
    rows = [(k, t) for k, t in enumerate(PROSE)] + [(10 + k, f"A short line.\n{line}") for k, line in enumerate(LINES)] + [(40, PROSE[0] + "\n" + "\n".join(LINES)), (41, "\n".join(LINES * 2)), (42, "été " * 9_000 + "cookie policy")]
    rows += [(50 + k, t) for k, t in enumerate(SCRIPTS)] + [(60 + k, f"A short line.\n{t}") for k, t in enumerate(SHORT)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lines(spark):
    cleaned = {r.doc_id: r.text for r in quality.clean(tables(spark)).collect()}
    assert all(cleaned[k] == t for k, t in enumerate(PROSE))
    assert all(cleaned[10 + k] == "A short line." for k in range(len(LINES)))
    assert all(cleaned[50 + k] == t for k, t in enumerate(SCRIPTS)) and all(cleaned[60 + k] == "A short line." for k in range(len(SHORT)))
    assert cleaned[41] == "" and cleaned[42].endswith("cookie policy")
    kept = {r.doc_id: r.kept for r in quality.rules(tables(spark)).collect()}
    assert all(kept[k] for k in range(len(PROSE))) and not kept[41]
    assert kept[50] and kept[51] and kept[55]


@pytest.mark.parametrize("name, report", [("op6_quality_rules", quality.rules), ("op2_license_scan", license.scan)])
def test_equals_the_sql(spark, name, report):
    import duckdb

    docs = tables(spark) if name == "op6_quality_rules" else spark.createDataFrame(kelvin(), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    _, want = oracle_rows(con, sql.oracle_sql()[name])
    assert rows_of(report(docs)) == want


def kelvin():
    own = "this work is licensed under a creative commons attribution 4 0 international license"
    return [(1, own), (2, own.replace("work", "wor\u212a").replace("a creative ", "")), (3, own.replace("a creative ", "")), (4, "\u0130n MIT L\u0130CENSE, released under the MIT L\u0130CENSE"), (5, "ALL R\u0130GHTS RESERVED All Rights Reserved"), (None, None)]


def test_kelvin_is_no_k(spark):
    got = {r.doc_id: r.labels for r in license.scan(spark.createDataFrame(kelvin(), "doc_id long, text string")).collect()}
    assert got[1] == "cc-by" == got[3] and got[2] == ""
