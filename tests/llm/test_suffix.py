import hashlib
import random

import numpy as np
import pytest

from faultline.llm import suffix

N = suffix.LENGTH


def brute(docs):
    """(n_bytes, n_removed, n_spans, digest) by key; docs: (key, bytes), keys in order."""
    seen, out = set(), {}
    for k, t in sorted(docs):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - N + 1):
            w = t[i : i + N]
            if w in seen:
                gone[i : i + N] = True
            seen.add(w)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[k] = (len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def figures(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc ", bytes(range(32, 127))])
def test_two_stage_sort(letters):
    rnd = random.Random(1)
    data = np.array([*(rnd.choice(letters) for _ in range(700)), 0], np.uint8)
    order = suffix.two_stage_sort(data, np.ones(701, bool), N)
    raw = data.tobytes()
    heads = [raw[i : i + N] for i in order]
    assert sorted(order.tolist()) == list(range(701)) and heads == sorted(heads)
    prefix = suffix.common_prefixes(data, order, N)
    for a, b, p in zip(heads, heads[1:], prefix[1:]):
        pad = max(len(a), len(b))
        same = next((i for i in range(pad) if a[i : i + 1] != b[i : i + 1]), N)
        assert min(p, same) == same or p == same


def test_documents(spark, texts, monkeypatch):
    rnd = random.Random(2)
    rows = sorted(texts.items())[:120]
    base = rows[3][1]
    rows += [(10_000, None), (10_001, ""), (10_002, "ab" * 300), (10_003, "y" * 99), (10_004, "z" * 100), (10_005, "z" * 101), (10_006, base * 2), (-5, base[50:]), (10_007, base[:400] + "é" + base[400:])]
    rows += [(20_000 + i, "".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(40))) + base[:160] + str(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    want = brute([(k, (t or "").encode()) for k, t in rows])
    assert figures(suffix.measure_repeats(df)) == want
    monkeypatch.setattr(suffix, "SPLIT_BLOCKS", 2)
    assert figures(suffix.measure_repeats(df)) == want


def test_edges(edge_docs, no_docs, edge_rows):
    rows = suffix.measure_repeats(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    assert suffix.measure_repeats(no_docs).count() == 0
    kept = suffix.remove_repeats(edge_docs)
    assert kept.schema.names == edge_docs.columns and kept.count() == len(edge_rows)
    by = {r["k"]: r for r in kept.collect()}
    assert by["k0"]["text"] is None and by["k3"]["text"] == "x" and by["k7"]["n_chars"] == len(by["k7"]["text"]) < 200
    assert suffix.remove_repeats(no_docs).count() == 0
