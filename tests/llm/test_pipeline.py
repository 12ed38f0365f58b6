"""The pipeline's stages and its run against plain versions that share no code with them, over a small table."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from faultline.llm import langid
from faultline.llm.common import release

from .test_minhash import brute
from .test_packing import plain as plain_bins
from .test_pii import NAMES
from .test_pii import plain as plain_spans


@pytest.fixture(scope="module")
def small(spark, docs, tmp_path_factory):
    rows = [r for r in docs.where("doc_id < 110").collect()]
    again = rows[3]["text"]
    rows += [(1000, again, "en", "s", len(again)), (1001, again + " tail", "en", "s", len(again) + 5), (1002, "12 34 !!", None, "s", 8), (1003, None, None, None, None), (1004, "слово за слово", None, "s", 14)]
    rows += [(1005, "Call +49 30 1234567 or write to some.one@example.org, the card is 4111 1111 1111 1111 at 10.0.0.1 and that is all of it", "en", "t", 9)]
    folder = tmp_path_factory.mktemp("small")
    df = spark.createDataFrame(rows, docs.schema)
    df.repartition(2).write.parquet(str(folder / "documents.parquet"))
    return spark.read.parquet(str(folder / "documents.parquet")), str(folder)


def best_share(model, text):
    """The share of a text's letters that Viterbi gives to its best language, a word at a time; unknown words count as letters of none."""
    words = langid.words_of(text or "")
    if not words:
        return 0.0
    scores = [model.score(w) for w in words]
    k = len(model.languages)
    best, back = list(scores[0]), []
    for s in scores[1:]:
        top = max(range(k), key=lambda i: (best[i], -i))
        come = [i if best[i] >= best[top] - langid.SWITCH else top for i in range(k)]
        best = [(best[i] if come[i] == i else best[top] - langid.SWITCH) + s[i] for i in range(k)]
        back.append(come)
    at = max(range(k), key=lambda i: (best[i], -i))
    labels = [at]
    for come in reversed(back):
        labels.append(come[labels[-1]])
    share = Counter()
    for label, w, s in zip(reversed(labels), words, scores):
        share[label] += len(w) if any(s) else 0
    return max(share.values()) / sum(map(len, words))


def without_repeats(texts):
    """Texts by doc_id without the bytes of any 100-byte window that starts earlier too."""
    seen, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        out[k] = None if texts[k] is None else bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def redacted(text):
    out, at = [], 0
    for a, kind, b in plain_spans(text or ""):
        if a >= at:
            out.append(text[at:a] + f"[{NAMES[kind].upper()}]")
        at = max(at, b)
    return text and "".join(out) + text[at:]


def test_stages_against_plain_versions(spark, small):
    docs, _ = small
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "repeat_dedup", "redact_pii", "pack"]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    had = texts(docs)
    kept = stages["language_id"](spark, docs, "").cache()
    assert kept.columns == docs.columns and texts(kept) == {k: t for k, t in had.items() if best_share(model, t) >= 1 / 3}
    assert not {1002, 1003, 1004} & set(texts(kept)) and len(texts(kept)) > 100
    had = texts(kept)
    one = stages["near_dedup"](spark, kept, "").cache()
    assert one.columns == docs.columns and texts(one) == {k: had[k] for k, _, root in brute(sorted(had.items())) if k == root}
    assert 1000 not in texts(one)
    had = texts(one)
    new = stages["repeat_dedup"](spark, one, "").cache()
    assert new.columns == docs.columns and texts(new) == without_repeats(had)
    had = texts(new)
    clean = stages["redact_pii"](spark, new, "").cache()
    assert clean.columns == docs.columns and texts(clean) == {k: redacted(t) for k, t in had.items()}
    assert "[PHONE]" in texts(clean)[1005] and all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    had = texts(clean)
    pieces = stages["pack"](spark, clean, "").collect()
    whole = defaultdict(str)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        whole[r["doc_id"]] += r["text"] or ""
        assert r["n_words"] == len((r["text"] or "").split()) <= 1024
    assert whole == {k: t or "" for k, t in had.items()}
    bins = defaultdict(list)
    for r in pieces:
        bins[r["bin"]].append(r)
    assert all(sum(r["n_words"] for r in b) <= 1024 and len({r["source"] for r in b if r["source"]}) == len([r for r in b if r["source"]]) for b in bins.values())
    sizes, sources = [r["n_words"] for r in pieces], [r["source"] for r in pieces]
    assert abs(len(bins) - (1 + max(b for b, _ in plain_bins(sizes, sources, [had[r["doc_id"]] or None for r in pieces], 1024)))) <= 1


def test_run_is_all_stages(spark, small):
    docs, folder = small
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, now.collect()))
    release(spark)


def test_run_over_documents(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and max(Counter((r["bin"], r["source"]) for r in rows).values()) == 1 and not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r["text"] or "") for r in rows)
