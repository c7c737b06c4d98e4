"""Tables of commits: versions, two writers, crashes at each step, files that an upsert leaves alone."""

from __future__ import annotations

import datetime as dt

import pytest

from millrace.sources import runs
from millrace.sources.commits import CommitTable, Conflict

SCHEMA = "k long, v string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA).coalesce(1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    t = CommitTable(spark, f"{tmp_path}/t")
    t.append(frame(spark, (1, "a"), (2, "b")))
    t.append(frame(spark, (3, "c"), (None, "n")))
    return t


def test_versions(spark, table):
    assert table.upsert(frame(spark, (2, "B"), (9, "i"), (None, "N")), ["k"]) == 2
    assert rows(table.read()) == rows(frame(spark, (1, "a"), (2, "B"), (3, "c"), (9, "i"), (None, "N")))
    assert rows(table.read(0)) == [(1, "a"), (2, "b")] and rows(table.read(1)) == rows(frame(spark, (1, "a"), (2, "b"), (3, "c"), (None, "n")))
    table.overwrite(frame(spark, (7, "z")))
    assert rows(table.read()) == [(7, "z")] and table.version() == 3
    assert [h["operation"] for h in table.history()] == ["append", "append", "upsert", "overwrite"]


def test_an_upsert_rewrites_only_what_it_touches(spark, table):
    before = table.state()[0]
    table.upsert(frame(spark, (3, "C")), ["k"])
    after = table.state()[0]
    assert before[0] in after and before[1] not in after
    assert table.history()[-1]["removed"] == 1
    table.upsert(frame(spark, (50, "new")), ["k"])
    assert table.history()[-1]["removed"] == 0
    with pytest.raises(ValueError, match="more than once"):
        table.upsert(frame(spark, (1, "x"), (1, "y")), ["k"])
    with pytest.raises(ValueError, match="columns"):
        table.append(spark.createDataFrame([(1,)], "other int"))


def test_many_commits_and_whole_manifests(spark, tmp_path):
    t = CommitTable(spark, f"{tmp_path}/m")
    for i in range(13):
        t.upsert(frame(spark, (i % 4, str(i))), ["k"])
    assert rows(t.read()) == [(0, "12"), (1, "9"), (2, "10"), (3, "11")] and rows(t.read(4)) == [(0, "4"), (1, "1"), (2, "2"), (3, "3")]


@pytest.mark.parametrize("slow", ["append", "upsert"])
def test_of_two_writers_one_tries_again(spark, table, monkeypatch, slow):
    """The other commits after the slow one has read the version and before it writes its manifest; nothing is lost."""
    other, real, raced = CommitTable(spark, table.path), CommitTable._commit, []

    def commit(self, base, *args):
        if self is table and not raced:
            raced.append(other.upsert(frame(spark, (1, "other"), (4, "d")), ["k"]))
        return real(self, base, *args)

    monkeypatch.setattr(CommitTable, "_commit", commit)
    version = table.append(frame(spark, (5, "e"))) if slow == "append" else table.upsert(frame(spark, (5, "e"), (4, "mine")), ["k"])
    assert raced == [2] and version == 3
    want = {1: "other", 2: "b", 3: "c", None: "n", 4: "d" if slow == "append" else "mine", 5: "e"}
    assert dict(rows(table.read())) == want


def test_a_writer_gives_up(spark, table, monkeypatch):
    monkeypatch.setattr(CommitTable, "_commit", lambda *_: False)
    with pytest.raises(Conflict):
        table.append(frame(spark, (5, "e")))


@pytest.mark.parametrize("step", ["_written", "_beside", "_renamed"])
def test_a_crash_leaves_the_last_version(spark, table, monkeypatch, step):
    before, owner = rows(table.read()), CommitTable if step == "_written" else runs.Store
    real = getattr(owner, step)

    def crash(*args):
        if step == "_written":
            real(*args)  # the files are there, nobody names them
        raise OSError("down")

    monkeypatch.setattr(owner, step, crash)
    with pytest.raises(OSError):
        table.upsert(frame(spark, (1, "x")), ["k"])
    monkeypatch.undo()
    assert rows(table.read()) == before and table.version() == 1
    table.upsert(frame(spark, (1, "x")), ["k"])
    assert dict(rows(table.read()))[1] == "x"


def test_vacuum(spark, table):
    table.upsert(frame(spark, (1, "x")), ["k"])
    assert table.vacuum() == 0 and rows(table.read(0)) == [(1, "a"), (2, "b")]  # young files stay
    assert table.vacuum(keep=3, older_s=-60) == 0
    now = rows(table.read())
    assert table.vacuum(keep=1, older_s=-60) == 1 and rows(table.read()) == now
    with pytest.raises(Exception):
        table.read(0).collect()


def test_a_file_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    store, path = runs.Store(spark), f"{tmp_path}/a/x.json"
    store.write(path, "one")
    store.write(path, "two")
    assert store.read(path) == "two" and not store.write_new(path, "three") and store.read(path) == "two"
    for step in ("_beside", "_renamed"):
        def crash(*args):
            raise OSError("down")

        monkeypatch.setattr(runs.Store, step, crash)
        with pytest.raises(OSError):
            store.write(path, "four")
        monkeypatch.undo()
        assert store.read(path) == "two"


def test_checkpoints_fall_back(spark, tmp_path):
    folder = f"{tmp_path}/c"
    for chapter in (1, 2):
        runs.checkpoint({"nodes": frame(spark, (chapter, "x"))}, folder, chapter, dt.datetime(2024, 1, chapter))
    store = runs.Store(spark)
    assert runs.resumed(spark, folder)[1] == 2
    store.write(f"{folder}/checkpoint_latest.json", "{half")
    tables, chapter = runs.resumed(spark, folder)
    assert chapter == 2 and rows(tables["nodes"]) == [(2, "x")]
    store.delete(f"{folder}/checkpoint_latest.json")
    store.delete(f"{folder}/nodes/version=1")
    tables, chapter = runs.resumed(spark, folder)
    assert chapter == 1 and rows(tables["nodes"]) == [(1, "x")]
    assert runs.resumed(spark, f"{tmp_path}/none") == ({}, 0)
