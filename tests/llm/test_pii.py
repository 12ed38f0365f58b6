import hashlib
import re

import pytest

from faultline.llm import pii

NAMES = ["email", "ip", "card", "phone"]


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def plain(s):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


ODD = ["a@b.co_x@d.ef", "1.2.3.4.5.6.7.8 256.1.1.1 000.01.255.0255", "é 4111 1111 1111 1111 ñ +1 (234) 567-8901 a@b", "a" * 20000 + "@", "1" * 20000, "x@y.z " * 500, "+1+12345678901 12.12.12.12.", "\U0001F600 a.b@c.d \U0001F600 +49 30 1234567", "1 2 3 " * 3000, "4111-1111-1111-1111-", ".@a.b", "a@b..c a@-.-"]


def test_base_spans(spark, docs, texts):
    rows = [*texts.items(), *[(10**6 + i, t) for i, t in enumerate(ODD)]]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        want = plain(t)
        listed = ",".join(f"{NAMES[i]}:{a}:{b}" for a, i, b in want)
        assert got[k]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), k
        assert [got[k][f"n_{n}"] for n in NAMES] == [sum(i == j for _, j, _ in want) for i in range(4)]
        assert set(listed.split(",")) - {""} <= set(got[k]["spans"].split(","))


@pytest.mark.parametrize("text, spans", [("my iban DE89370400440532013000", "iban:8:30"), ("DE89370400440532013001", ""), ("ssn 123-45-6789", "ssn:4:15"), ("part 123-45-6789", "")])
def test_added_kinds(spark, text, spans):
    assert pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"] == spans


def test_context_raises_the_score(spark):
    a, b = (r["scores"] for r in pii.detect(spark.createDataFrame([(1, "credit card 4111111111111111"), (2, "number 4111111111111111")], "doc_id long, text string")).orderBy("doc_id").collect())
    assert float(a) > float(b)


def test_native_and_edges(edge_docs, no_docs, edge_rows):
    df = pii.detect(edge_docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and df.count() == len(edge_rows) and pii.detect(no_docs).count() == 0
    clean = pii.redact(edge_docs)
    assert clean.columns == edge_docs.columns
    by = {r["k"]: r for r in clean.collect()}
    assert by["k11"]["text"] == "mail [EMAIL] or [PHONE], [IP]" and by["k0"]["text"] is None and by["k11"]["n_chars"] == len(by["k11"]["text"])


def test_names_that_clash(spark):
    """Columns named like those of any step stay as they are."""
    df = spark.createDataFrame([(1, "to a@b.co", "z", "y", "x", "w", 9)], "doc_id long, text string, m0 string, _p0 string, row string, spans string, n_chars int")
    r = pii.redact(df).first()
    assert tuple(r) == (1, "to [EMAIL]", "z", "y", "x", "w", len("to [EMAIL]"))
    assert pii.redact(df.select("text")).first()["text"] == "to [EMAIL]"


def test_context_is_seen_across_matches(spark):
    """The last 40 code points count, whatever other matches lie in them."""
    for gap, raised in ((5, True), (60, False)):
        text = "card +1 234 567 8901 " + "." * gap + " 4111111111111111"
        df = pii.find_spans(spark.createDataFrame([(text,)], "text string").selectExpr("struct(1 as k) row", "text"))
        card = next(s for s in df.first()["spans"] if s["kind"] == 2 and s["value"].startswith("4111"))
        assert (card["score"] > 0.75) == raised
