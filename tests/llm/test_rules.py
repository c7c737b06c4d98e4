from __future__ import annotations

import collections
import re

import pytest

from millrace.llm import license, quality

ROWS = [
    (1, "Good first line, with enough words to be kept.\nA second line of running text that ends well.\nHome | About | News | Contact"),
    (2, None), (2, None), (None, ""), (3, " \n\t"), (4, "Home | About | News | Contact | Login | Search | Site map | More | Shop | Blog"),
    (5, "the same five words here " * 20), (6, "Same line here.\nSame line here.\nAnother line of text which stands only once in it."),
    (7, "### $$$ %%% &&& ***\n" * 12), (8, "Clean words " + " ".join(f"word{i}" for i in range(20_000)) + "."), (9, "é" * 30 + " ü　ö"),
    (10, "Licensed under CC BY-NC 4.0. All rights reserved.\nall RIGHTS reserved"), (11, "released   under the MIT-license"), (12, "cc\nby general public  license cc by"),
    (13, "this work is licensed under the general public licence version three"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as w", "2 as low", "'k' as keys", "3 as n_words", "4 as lines")


def test_base_counts(docs):
    want = []
    for d, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {p for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    got = quality.rules(docs)
    assert collections.Counter(tuple(r)[:7] for r in got.collect()) == collections.Counter(want)
    verdict = {r.doc_id: r.kept for r in got.collect()}
    assert verdict[1] and verdict[8] and not any(verdict[k] for k in (2, 3, 4, 5, 7, None))


def test_failing_lines_go(docs):
    kept = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert kept[1].count("\n") == 1 and kept[4] == "" and kept[2] is None


def test_license_scan(docs):
    got = {r.doc_id: r for r in license.scan(docs).collect()}
    assert (got[10].n_base, got[10].base_labels, got[10].first_word, got[10].last_word, got[10].score) == (3, "cc-by,reserved", 2, 10, 1.0)
    assert (got[11].n_base, got[11].labels, got[11].first_word, got[11].score) == (0, "mit", None, 1.0)
    assert (got[12].n_base, got[12].base_labels, got[12].last_word) == (3, "cc-by,gpl", 5)
    assert (got[13].labels, got[2].labels, got[2].n_words, got[2].score) == ("", "", 0, 0.0)
    assert license.scan(docs).count() == len(ROWS)


def test_filters_lose_no_match(docs):
    """Every block that contains enough of a template, and no other, is found."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    got = {r.doc_id: r for r in license.scan(docs).collect()}
    for d, t in ROWS:
        want = set()
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        for label, s in license.TEMPLATES:
            run, own = -(-100 * len(s.split()) // 80), set(s.split())
            if any(100 * len(own & set(words[i : i + run])) >= 80 * len(own) for i in range(len(words)) if words[i] in own):
                want.add(label)
        assert set(got[d].labels.split(",")) - {""} == want | (set(got[d].base_labels.split(",")) - {""})


WRAPPED = [
    ("mit", "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software)"),
    ("bsd", "x y z\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\r\nare met:"),
    ("mpl", "dnl This Source Code Form is subject to the terms of the Mozilla Public\ndnl License, v. 2.0."),
    ("gpl", "This\nprogram is free software;\n\nyou can redistribute\nit and/or modify it\nunder the terms of the\nGNU General Public\nLicense"),
    ("apache", "Licensed under\nthe Apache\nLicense, Version\n2.0"),
    ("", "Released for all\n" + "other words stand here\n" * 9 + "under the roof\n" + "and more of them\n" * 9 + "the MIT"),
]


def test_wrapped_notices_are_found(spark):
    """Every run of words that contains enough of a template is found, wherever lines end in it."""
    alone = [(10 * k, label, t) for k, (label, t) in enumerate(WRAPPED)]
    long = [(10 * k + 1, label, "some prose of the document and its license\n" * 300 + t + "\nmore of it to be read" * 300) for k, (label, t) in enumerate(WRAPPED)]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame([(d, t) for d, _, t in alone + long], "doc_id long, text string")).collect()}
    for d, label, t in alone + long:
        want, best = set(), 0.0
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        for name, s in license.TEMPLATES:
            own, run = set(s.split()), -(-100 * len(s.split()) // 80)
            share = max(len(own & set(words[i : i + run])) / len(own) for i in range(len(words)))
            if share >= 0.8:
                want, best = want | {name}, max(best, share)
        assert label in want or not label and not want
        assert set(got[d].labels.split(",")) - {""} == want | (set(got[d].base_labels.split(",")) - {""})
        assert got[d].score == (1.0 if got[d].n_base else best)


def test_native_and_empty(docs):
    for f in (license.scan, quality.rules, quality.clean):
        df = f(docs)
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
        assert f(docs.limit(0)).count() == 0
