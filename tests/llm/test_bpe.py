import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from opsmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    own = bpe.vocabulary(PATH, public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text("aabst \n'é1", max_size=300)), max_size=8))
def test_ids(peer, texts):
    own = bpe.vocabulary(PATH, public_tokenizers.PATTERN)
    own.known = {}
    for text, packed in zip(texts, own.encode_all(texts), strict=True):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == peer.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_memory_is_bounded(peer, monkeypatch):
    own = bpe.Vocabulary(open(PATH, "rb"), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for text in ("thonnthe inger", "erstly ouheed", "thonnthe erstly"):
        assert np.frombuffer(own.encode_all([text])[0], "<u4").tolist() == peer.encode_ordinary(text)
        assert len(own.known) <= 5


def test_long_pretokens_and_cases(make_docs, peer):
    texts = [None, "", " ", "ab" * 5000, "a" * 3001, "é" * 999, "<|endoftext|>", "x\ty  z \n\n", "x\ty  z \n\n"]
    rows = list(enumerate(texts))
    docs = make_docs([*rows, (None, "null id"), (3, "again")])
    got = {(r.doc_id, r.decoded_sha256): r for r in bpe.multilingual(docs).collect()}
    assert len(got) == len(texts) + 2
    for doc_id, text in rows:
        ids = peer.encode_ordinary(text or "")
        r = got[doc_id, hashlib.sha256((text or "").encode()).hexdigest()]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.multilingual(make_docs([])).collect() == []


def test_encode_then_decode(make_docs):
    docs = make_docs([(1, "Über den Wolken 12,5"), (2, None)])
    ids = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    data = {r.doc_id: bytes(r.data) for r in bpe.decode(ids, PATH, public_tokenizers.PATTERN).collect()}
    assert data == {1: "Über den Wolken 12,5".encode(), 2: b""}
