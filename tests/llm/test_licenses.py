"""Whole license notices, as they stand in files, wrapped or not."""

from __future__ import annotations

import textwrap

import pytest

from millrace.llm import license

MIT = (
    "MIT License. Copyright (c) 2020 A. Author. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
    "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of "
    "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
APACHE = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
NOTICES = {
    "mit": MIT, "bsd": BSD, "apache": APACHE,
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}


@pytest.mark.parametrize("width", [10_000, 80, 40])
@pytest.mark.parametrize("lead", ["", "# ", " * "])
def test_notices(spark, width, lead):
    rows = [(k, "\n".join(lead + line for line in textwrap.wrap(text, width))) for k, text in enumerate(NOTICES.values())]
    got = {r.doc_id: r.labels.split(",") for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[k] for k, label in enumerate(NOTICES))


def test_prose_has_no_label(spark):
    text = "The library was free to use for any person. In this work the authors describe the terms of the purchase, with or without a fee, and the public was granted a copy of the source.\n" * 3
    row = license.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.score) == ("", 0.0)


def test_kin_are_told_apart(spark):
    """No template but a license's own is found in notices that share most of their words with it."""
    kin = {
        "this work is licensed under a creative commons attribution 4 0 international license": {"cc-by"},
        "This library is free software; under the terms of the GNU Lesser General Public License": set(),
        "Distributed under the Boost Software License, Version 1.0": set(),
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": {"gpl"},
    }
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in license.scan(spark.createDataFrame(list(enumerate(kin)), "doc_id long, text string")).collect()}
    assert [got[k] - ({"gpl"} if "General Public License" in t else set()) for k, t in enumerate(kin)] == [v - ({"gpl"} if "General Public License" in t else set()) for t, v in kin.items()]


def test_scattered_words_are_no_notice(spark):
    """All words of a statement, 300 others between each two of them, on one line or on many: no label."""
    words = dict(license.TEMPLATES)["cc0"].split()
    rows = [(k, sep.join(w + sep + sep.join(f"x{i}" for i in range(300)) for w in words)) for k, sep in enumerate((" ", "\n"))]
    assert {(r.labels, r.score) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {("", 0.0)}


@pytest.mark.parametrize("width", [1_000_000, 78])
def test_whole_texts_of_licenses(spark, width):
    """Whole license texts in the middle of a long one, and with a tenth of their words lost, one line or wrapped."""
    prose = " ".join(f"prose{i % 97}" for i in range(3000))
    whole = [(label, t) for label, t in license.TEMPLATES if len(t.split()) > 80]
    less = lambda t: " ".join(w for i, w in enumerate(t.split()) if i % 10)
    rows = [(k, "\n".join(textwrap.wrap(f"{prose} {f(t)} {prose}", width))) for k, (f, t) in enumerate([(f, t) for f in (str, less) for _, t in whole])]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _) in enumerate(whole * 2):
        assert label in got[k].labels.split(",") and got[k].score >= 0.8
