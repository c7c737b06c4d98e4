"""Pieces against the library, and its offsets for models with a character map."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from millrace.llm import pieces

MODEL = P.path("piece_bpe_32k.model")
ODD = list("ab c\n  ▁\tÉ<s>0x世é\r　😀.'tＡ①") + ["\x00", " ", "\x85", "<0x0A>", "</s>", "word ", "é", "ﬁ", "​", "\x01", "ガ"]


def texts(n=1500):
    rng = random.Random(12)
    return [None, "", " ", "  ", "\n", "\n\n a", "▁", "\x01", "x" * 5000, " ".join(["long"] * 30000)] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)]


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k else None, t) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7]], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens", "3 as starts")


def digest(x):
    return hashlib.sha256(x).hexdigest()


def test_round_trip_equals_the_library(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.round_trip(docs, MODEL).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        ids = sp.encode(TEXTS[r.doc_id or 0] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids)).encode()), digest(sp.decode(ids).encode()))
    assert pieces.round_trip(docs.limit(0), MODEL).count() == 0


def test_encode_and_decode(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in pieces.encode(docs, MODEL).collect()}
    for k, t in enumerate(TEXTS):
        raw, r = (t or "").encode(), rows[k or None]
        assert r.ids == sp.encode(t or "")
        spans = list(zip(r.starts, r.ends, strict=True))
        assert all(0 <= a <= b <= len(raw) for a, b in spans) and r.starts == sorted(r.starts) and (not raw or r.ends[-1] == len(raw))
        for i, (a, b) in zip(r.ids, spans, strict=True):
            if not sp.is_byte(i):  # but for the space before a text, a piece is what stands in the source
                assert raw[a:b].decode().replace(" ", "▁") in (sp.id_to_piece(i), sp.id_to_piece(i)[1:])
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()}
    assert all(back[k or None] == sp.decode(sp.encode(t or "")) for k, t in enumerate(TEXTS))


def test_cuts_don_t_change_ids(monkeypatch):
    one, whole = pieces.Pieces(MODEL), pieces.Pieces(MODEL)
    assert one.cuts
    whole.cuts = False
    monkeypatch.setattr(pieces, "CACHE", 5)
    some = [t or "" for t in TEXTS]
    assert one.encode(some) == whole.encode(some)
    assert all(len(u) <= 64 for u in one.known)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps(rule, squeeze):
    """The normalised bytes and their alignment equal the library's, for maps compiled by it."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    spec = dict(pieces.message(library.serialized_normalizer_spec()))
    own = pieces.Normaliser(spec)
    raw = [(t or "").encode() for t in TEXTS if len(t or "") < 100]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    out, place, at, ends = own(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, r in enumerate(raw):
        text, want = library.normalize(r.decode(), with_offsets=True)
        got = out[at[k] : at[k + 1]].tobytes().decode()
        assert got == text
        lead = np.flatnonzero(out[at[k] : at[k + 1]] & 0xC0 != 0x80) + at[k]
        in_characters = [len(r[: p - offsets[k]].decode()) for p in [*place[lead], ends[k]]]
        assert in_characters[:-1] == want[:-1]
        assert not got or in_characters[-1] == want[-1]


def test_symbols_come_before_the_map():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    own = pieces.Normaliser(dict(pieces.message(library.serialized_normalizer_spec())), ["Ａ".encode(), "ＡＡ①".encode()])
    raw = "ＡＢＡＡ①①Ａ".encode()
    out, place, at, _ = own(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert out.tobytes().decode() == "ＡBＡＡ①1Ａ" and place[-1] == len(raw) - 3


def test_unknown_pieces_cover_what_they_stand_for():
    m = pieces.Pieces(MODEL)
    m.sizes = m.sizes.copy()
    i = m.sp.encode("b世b")[2]
    m.sizes[i] = -1
    raw = "b世b".encode()
    ids = [np.array(m.sp.encode("b世b"), "<u4")]
    starts, ends = m.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ["b世b"], ids)
    assert (starts[0], ends[-1]) == (0, len(raw))
