import hashlib
import re
from collections import Counter

import numpy as np

from faultline.llm import fingerprints as fp


def test_documents(docs, texts, monkeypatch):
    monkeypatch.setattr(fp, "RUN_ROWS", 30)
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(docs).collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for i, k in enumerate(ids):
        t, after = texts[k], texts[ids[(i + 1) % len(ids)]]
        new = fp.edited(t, after)
        a, b, c = (fp.signatures(x) for x in (t, new, after))
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fp.to_text(a) and r["edited_fingerprint"] == fp.to_text(b)
        assert np.isclose(r["near_edited"], fp.likeness(a, b)) and np.isclose(r["near_next"], fp.likeness(a, c))


def test_signatures_and_likeness():
    s = fp.signatures("at a rally to kick off a weeklong campaign the state of south carolina")
    assert len(s) and (fp.from_text(fp.to_text(s)) == s).all()
    assert (fp.signatures("The House, is old. " * 40) == fp.signatures("the house is OLD " * 40)).all()
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, n).astype(np.uint32)) for n in rng.integers(1, 300, 2))
        exact = len(set(a) & set(b)) / len(set(a) | set(b))
        assert np.isclose(fp.likeness(a, b), exact)  # no floor
        pruned = fp.likeness(a, b, 0.4)
        assert np.isclose(pruned, exact) or exact < 0.4 and pruned == 0.0


def test_edges(spark, edge_docs, no_docs, edge_rows):
    rows = fp.fingerprint_documents(edge_docs).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fp.fingerprint_documents(no_docs).count() == 0
    one = fp.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_no_bound_parts_near_copies():
    rng = np.random.default_rng(8)
    for size in (200, 405, 600, 3000):
        text = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(size))[:size]
        assert fp.likeness(fp.signatures(text), fp.signatures(text[: size - 10])) > 0.7
    token = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5000))
    assert 0.35 < fp.likeness(fp.signatures(token), fp.signatures(fp.edited(token, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5000))))) < 0.65


def plain_spots(text):
    """The spot signatures of a text as plain tuples: an anchor, the next content words, how often that came before."""
    words = re.findall(r"\w+", text.lower())
    seen, out = Counter(), set()
    for i, w in enumerate(words):
        if w in fp.ANCHORS:
            chain = (w, *[x for x in words[i + 1 :] if x not in fp.ANCHORS][: fp.CHAIN])
            out.add((chain, seen[chain]))
            seen[chain] += 1
    return out


def test_query_against_plain_spots(docs, texts, monkeypatch):
    """With nothing but chains after common words, the query's likeness is the Jaccard of plain tuples."""
    monkeypatch.setattr(fp, "ALSO", 1 << 44)
    monkeypatch.setattr(fp, "FEW", 0)
    monkeypatch.setattr(fp, "LONG", 1 << 30)
    ids = sorted(texts, reverse=True)
    plain = {k: plain_spots(texts[k]) for k in ids}
    some = 0
    for i, k in enumerate(ids):
        other = fp.edited(texts[k], texts[ids[(i + 1) % len(ids)]])
        new, a, b = plain_spots(other), fp.signatures(texts[k]), fp.signatures(other)
        if re.search(r"\w", texts[k]) and re.search(r"\w", other):
            assert abs(len(a) - len(plain[k])) <= 1
            union = len(plain[k] | new)
            some += union > 40
            assert not union or abs(fp.likeness(a, b) - len(plain[k] & new) / union) <= 2 / union
    assert some > 20


def test_shipped_setting_against_plain_spots(docs, texts):
    """As it is shipped, chains after common words are the large majority, and the query's likeness is near that of plain tuples."""
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(docs).collect()}
    ids = sorted(texts, reverse=True)
    anchored = total = 0
    apart = []
    for i, k in enumerate(ids):
        after = texts[ids[(i + 1) % len(ids)]]
        own, new, nxt = plain_spots(texts[k]), plain_spots(fp.edited(texts[k], after)), plain_spots(after)
        anchored += len(own)
        total += len(fp.from_text(got[k]["fingerprint"]))
        if len(own | new) > 60:
            apart.append(abs(got[k]["near_edited"] - len(own & new) / len(own | new)))
            assert apart[-1] < 0.3 and abs(got[k]["near_next"] - len(own & nxt) / len(own | nxt)) < 0.2
    assert anchored > 0.7 * total and len(apart) > 20 and sum(apart) / len(apart) < 0.05


def test_near_documents_against_all_pairs(spark, docs, texts):
    """Every pair of differing fingerprints that are near is found, from tables with copies, ties and texts without signatures."""
    rng = np.random.default_rng(5)
    rows = [(k, t) for k, t in texts.items()] + [(10_000 + k, t) for k, t in list(texts.items())[:30]] + [(None, "no id, and words of the kind"), (20_000, ""), (20_001, None), (20_002, "")]
    for j, (k, t) in enumerate(list(texts.items())[:60]):  # near copies at all distances
        words = t.split(" ")
        for i in rng.integers(0, max(1, len(words)), max(1, len(words) * (j % 7) // 100)):
            words[i] = "changed" + str(i)
        rows.append((30_000 + k, " ".join(words)))
    got = {(r["class"], r["other"]): r["likeness"] for r in fp.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    classes = {}
    for k, t in rows:
        if len(s := fp.signatures(t or "")):
            key = s.tobytes()
            old = classes.get(key, (None, s))[0]
            classes[key] = (k if old is None else old if k is None else min(old, k), s)
    every = sorted(classes.values(), key=lambda x: (x[0] is None, x[0] or 0))
    want = {}
    for i, (k, a) in enumerate(every):
        for j, b in every[:i]:
            union = len(np.union1d(a, b))
            if len(a) + len(b) - union >= fp.NEAR * union - 1e-12:
                want[frozenset((k, j))] = (len(a) + len(b) - union) / union
    assert {frozenset(p): round(v, 12) for p, v in got.items()} == {p: round(v, 12) for p, v in want.items()} and len(got) == len(want) > 20


def test_doc_id_of_many_rows(spark, monkeypatch):
    """A doc_id that holds most rows spans several runs; the next document is still that of a plain sort."""
    import zlib

    monkeypatch.setattr(fp, "RUN_ROWS", 20)
    rows = [(7, f"the text number {i} of a document that has many rows and of others") for i in range(400)] + [(i, f"the other text {i}") for i in range(40)] + [(None, "no id")] * 3
    got = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), zlib.crc32(r[1].encode()), r[1]))
    want = sorted((k or -1, hashlib.sha256(fp.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(order))
    assert sorted((r["doc_id"] or -1, r["edited_sha256"]) for r in got) == want
    runs = fp.Runs([3, 7, 7, 7, 9])
    at = runs.of(np.array([7] * 8), np.arange(8, dtype=np.int64) << 29)
    assert sorted(set(at.tolist())) == [1, 2, 3, 4] and (np.diff(at) >= 0).all()
