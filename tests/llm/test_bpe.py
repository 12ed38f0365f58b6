import hashlib

import numpy as np
import pytest

from faultline.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.read_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def oracle(ranks):
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", "a" * 5000, "   \n\t x", "▁ ▁a", "日本語 🎉🎉‍", "\x00\x01 <unk> <s>", "ab " * 500, "don't I'll 123 -- ñandú"])
def test_odd_texts(ranks, oracle, text):
    codec = bpe.Codec(ranks, P.PATTERN)
    ids = codec.encode(text)
    assert ids == oracle.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_documents(docs, texts, ranks, oracle):
    for r in bpe.encode_documents(docs, ranks, P.PATTERN).collect():
        raw = texts[r["doc_id"]].encode()
        ids = oracle.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_edges(edge_docs, no_docs, ranks, edge_rows):
    rows = bpe.encode_documents(edge_docs, ranks, P.PATTERN, keep_ids=True).collect()
    assert len(rows) == len(edge_rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert bpe.encode_documents(no_docs, ranks, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})
