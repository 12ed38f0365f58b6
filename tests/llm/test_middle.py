"""Fill-in-the-middle: a plain version, exact round trips, edge cases."""

import hashlib
import re

import pytest

from faultline.llm import middle
from faultline.llm.middle import Plan


def plainly(doc_id, text, plan=Plan()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)) or h3 % 100 >= plan.rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    before, mid, after = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < plan.spm:
        return doc_id, n, "spm", len(before), len(mid), plan.suffix + after + plan.prefix + before + plan.middle + mid
    return doc_id, n, "psm", len(before), len(mid), plan.prefix + before + plan.suffix + after + plan.middle + mid


def key(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("plan", [Plan(), Plan(seed=3, rate=40, spm=100), Plan(prefix="<'pre'>", suffix="<suf]", middle="[mid>")])
def test_against_plain_version(spark, docs, plan):
    odd = ["", None, "\n", "\n\n\n", "a\n", "a\r\nb\r\n", "no <P> here", "<S>", "x<M", "<P<P", "nul\0\nend", "é\n日本\n𝟘\n", "x" * 300_000 + "\ny", "a\n" * 40_000]
    rows = [(i, t, "other") for i, t in enumerate(odd * 3)] + [(None, "a\nb\nc\n", "z"), (7, "twice\nsaid\n", None), (7, "twice\nsaid\n", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, output string")  # a column with the name of a result
    assert key(middle.transform(frame, plan).collect()) == key(plainly(i, t, plan) for i, t, _ in rows)
    assert key(middle.transform(docs, plan).collect()) == key(plainly(r["doc_id"], r["text"], plan) for r in docs.collect())


def test_round_trip_and_digests(spark, edge_docs, edge_rows):
    restored = middle.restore(middle.transform(edge_docs))
    assert key(restored.select("doc_id", "restored").collect()) == key((r[0], r[1] or "") for r in edge_rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(*(made := plainly(r[0], r[1]))[:5], sha(made[5]), sha(r[1] or "")) for r in edge_rows]
    assert key(middle.measure(edge_docs).collect()) == key(want)


def test_empty_table(no_docs):
    assert middle.transform(no_docs).collect() == [] and middle.measure(no_docs).collect() == []


def test_marks_that_could_be_mistaken():
    for bad in ({"prefix": "aa"}, {"prefix": "<S>"}, {"middle": ""}, {"suffix": "<\n>"}, {"prefix": "aba"}):
        with pytest.raises(ValueError):
            Plan(**bad)
