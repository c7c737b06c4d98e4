"""The first and the last stage of the pipeline, each on its own input."""

from __future__ import annotations

import base64
import collections
import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from conftest import SMALL

from millrace.llm import queries, toxicity


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_toxicity_keeps_what_the_operator_accepts(spark):
    docs = queries.table(spark, SMALL, "documents")
    labels = queries.table(spark, SMALL, "labels")
    verdict = collections.Counter((r.doc_id, r.predicted) for r in toxicity.report(docs, labels, queries.id_fold(3, 1)).collect())
    kept = collections.Counter(r.doc_id for r in stage("toxicity")(spark, docs, SMALL).collect())
    assert kept == collections.Counter({d: n for (d, toxic), n in verdict.items() if not toxic})
    model = toxicity.fit(docs, labels, queries.id_fold(3, 1))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    x = np.array([toxicity.features(t.encode(), model.lexicon, model.stems, model.weights) for t in texts.values()])
    assert {d for (d, toxic) in verdict if toxic} == {d for d, s in zip(texts, model.score(x)) if s >= toxicity.THRESHOLD}


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    docs = queries.table(spark, SMALL, "documents").filter("text is not null")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = stage("byte_bpe")(spark, docs, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = e.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_leaves_one_table(spark):
    from millrace.llm import _common

    before = len(_common._written)
    corpus_pipeline.run(spark, SMALL).count()
    assert len(_common._written) == before + 1  # what the last stage reads
