"""New nodes one after the other: long chains of shared names, names that many share, nothing left behind."""

from __future__ import annotations

import random

import pytest

from millrace.operators import graph, ordering

NODES = "id string, zh string, en string, seq long, description string"
NEW = "seq long, zh string, en string, description string"


def one_by_one(new):
    taken, chosen = set(), []
    for seq, zh, en, _ in sorted(new):
        names = {zh, en, f"{zh} / {en}"}
        if taken.isdisjoint(names):
            taken |= names
            chosen.append(seq)
    return chosen


def chain(n):
    return [(i, f"n{i}", f"n{i + 1}", "") for i in range(n)]


@pytest.mark.parametrize("case", ["chain", "shuffled", "shared", "mixed"])
def test_equal_to_one_after_the_other(spark, case):
    rng = random.Random(9)
    if case == "chain":
        new = chain(500)
    elif case == "shuffled":
        order = rng.sample(range(200), 200)
        new = [(order[i], f"n{i}", f"n{i + 1}", "") for i in range(200)]
    elif case == "shared":
        new = [(i, "fever" if i % 3 else f"f{i}", f"e{i // 2}", "") for i in range(300)]
    else:
        new = [(i, f"a{rng.randint(0, 60)}", f"a{rng.randint(0, 60)}", "") for i in range(150)]
    before = set(ordering._folders)
    got = graph.added(spark.createDataFrame([], NODES), spark.createDataFrame(new, NEW), "symp", 0)
    left = len(set(ordering._folders) - before)
    assert sorted(r.seq for r in got.collect()) == one_by_one(new)
    assert left == 1  # what the result reads


def test_rounds_do_not_grow_with_chains(spark, monkeypatch):
    writes = []
    real = ordering.written
    monkeypatch.setattr(graph, "written", lambda rows, name: writes.append(name) or real(rows, name))
    counts = []
    for n in (40, 640):
        writes.clear()
        graph.added(spark.createDataFrame([], NODES), spark.createDataFrame(chain(n), NEW), "symp", 0).count()
        counts.append(len(writes))
    assert counts[1] <= counts[0] + 6
