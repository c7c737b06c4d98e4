from __future__ import annotations

import collections

import corpus_pipeline
import pytest
from conftest import SMALL

from millrace.llm import queries


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input, output) of every stage over the small tables, written and read again."""
    top = tmp_path_factory.mktemp("stages")
    docs, out = queries.table(spark, SMALL, "documents"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SMALL).write.parquet(str(top / str(k)))
        after = spark.read.parquet(str(top / str(k)))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_are_the_named_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "byte_bpe"]


def test_columns_and_rows(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes), name
        ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
        assert not ids(after) - ids(before), name
    assert stages[-1][1].count() == stages[-1][2].count()


def test_each_stage_does_its_work_on_its_own_input(spark, stages):
    from test_pairs import components, windows
    from test_repeats import brute_words

    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    _, before, after = stages[1]
    assert sorted(d for d, _ in rows(after)) == sorted({c for _, _, c in components(rows(before))})
    _, before, after = stages[2]
    removed = {d: n for d, _, n, _ in brute_words(rows(before))}
    old = dict(rows(before))
    assert all((t == old[d]) == (removed[d] == 0) and len(t.split()) == len(old[d].split()) - removed[d] for d, t in rows(after))
    _, before, after = stages[3]
    items = [(r.item_id, r.text) for r in queries.table(spark, SMALL, "benchmark").collect()]
    assert sorted(d for d, _ in rows(after)) == sorted(w[0] for w in windows(rows(before), items) if not w[5])


def test_run_equals_the_stages(spark, stages):
    want = sorted(map(tuple, stages[-1][2].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == want


def test_empty_and_odd_documents(spark, tmp_path):
    docs = queries.table(spark, SMALL, "documents")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (5, "", None, None, 0), (5, "", None, None, 0)], docs.schema))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SMALL).count() == 0, name
        assert f(spark, odd, SMALL).count() == (3 if name != "ngram_jaccard" else 2), name
