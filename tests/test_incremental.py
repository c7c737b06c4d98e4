"""Steps that resume, batches in order, files of books."""

from __future__ import annotations

import pandas as pd

from millrace.sources import files
from millrace.streaming import incremental as I


def test_each_step_writes_its_own_rows(spark, tmp_path):
    folder, keys = str(tmp_path / "parts"), ["chapter", "section"]
    inputs = spark.createDataFrame([(c, s) for c in range(3) for s in range(2)], "chapter int, section int")
    done = I.resumed(spark, inputs, "chapter", lambda df: df, folder, keys)
    assert sorted(map(tuple, done.collect())) == [(c, s) for c in range(3) for s in range(2)]
    assert [spark.read.parquet(f"{folder}/version={v}").count() for v in range(3)] == [2, 2, 2]
    more = inputs.unionByName(spark.createDataFrame([(3, 0)], inputs.schema))
    assert I.resumed(spark, more, "chapter", lambda df: df, folder, keys).count() == 7
    assert I.resumed(spark, inputs.limit(0), "chapter", lambda df: df, str(tmp_path / "none"), keys).count() == 0


def test_batches_follow_an_order(spark):
    rows = spark.range(1000).selectExpr("999 - id as k").repartition(7)
    got = I.in_batches(rows, lambda p: pd.DataFrame({"first": [p.k.iloc[0]], "n": [len(p)], "sorted": [bool((p.k.diff().dropna() == 1).all())]}), "first long, n long, sorted boolean", order=["k"]).collect()
    assert sum(r.n for r in got) == 1000 and all(r.sorted for r in got) and max(r.n for r in got) == 5


def test_book_files(spark, tmp_path):
    for book in ("one", "two"):
        (tmp_path / book).mkdir()
    for name, content in (("b.txt", b"b"), ("a.txt", "é".encode()), ("bad.txt", "é".encode("latin-1")), ("c.TXT", b"c"), ("d.doc", b"no"), ("e.docx", b"no"), ("f.pdf", b"f")):
        (tmp_path / "one" / name).write_bytes(content)
    (tmp_path / "two" / "x.txt").write_text("x")
    got = files.book_files(spark, {b: str(tmp_path / b) for b in ("one", "two")}, {".doc": lambda raw: raw.decode()}).orderBy("book_id", "pos").collect()
    assert [(r.book_id, r.pos, r.path.rsplit("/", 1)[1], r.text) for r in got] == [("one", 0, "a.txt", "é"), ("one", 1, "b.txt", "b"), ("one", 2, "bad.txt", ""), ("one", 3, "e.docx", ""), ("one", 4, "d.doc", "no"), ("two", 0, "x.txt", "x")]


def test_only_files_with_an_ending_are_read(spark, tmp_path):
    for name in ("a.TXT", "b.md", "c.tXt"):
        (tmp_path / name).write_text(name)
    read = files.documents(spark, str(tmp_path), (".txt",))
    assert sorted(r.source for r in read.collect()) == ["a.TXT", "c.tXt"]
    assert files.any_case([".txt", ".mp3"]) == "*{.[tT][xX][tT],.[mM][pP]3}"
