import numpy as np
import pytest

from faultline.llm import minhash


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= 0.75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), k), k)
    return {(k, len(sets[i]), least[top(i)]) for i, (k, _) in enumerate(rows)}


def test_groups(spark, texts):
    rows = sorted(texts.items())
    base = rows[7][1].split()
    for i in range(40):  # a group of near copies, each with its own words here and there
        w = list(base)
        for j in range(0, len(w), max(1, len(w) // 3)):
            w[(j + 7 * i) % len(w)] = f"new{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, "one two three") for i in range(3)] + [(2003, "one two four"), (2004, ""), (2005, None), (2006, "A B c D e f"), (2007, "a b\tC d\x0bE f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.group_documents(df).collect()}
    assert got == brute(rows)


def test_linked_is_exact_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    assert minhash.linked(a[:75], a) and not minhash.linked(a[:74], a)
    b = np.concatenate([a[:87], np.arange(200, 213, dtype=np.uint64)])
    assert minhash.linked(a, b) == (100 * 87 >= 75 * 113)


def test_edges(edge_docs, no_docs, edge_rows):
    rows = minhash.group_documents(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    none = [r for r in rows if r["doc_id"] in (0, 1, 2)]
    assert all(r["n_shingles"] == 0 and r["kept"] and r["component_id"] == r["doc_id"] for r in none)
    assert {r["doc_id"] for r in rows if r["component_id"] == 6} == {6, 7}
    assert minhash.group_documents(no_docs).count() == 0
    kept = minhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and 7 not in {r["doc_id"] for r in kept.collect()}
    assert minhash.drop_near_duplicates(no_docs).count() == 0


def crowd(seed, copies, words=400, edits=11):
    """A text and copies of it that share at least 0.75 with it, but about 0.6 with one another."""
    rnd = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = [" ".join(base)]
    for i in range(copies):
        w = list(base)
        for n, at in enumerate(np.sort(rnd.choice(words // 5 - 2, edits, replace=False)) * 5 + 4 + rnd.integers(0, 2)):
            w[at] = f"e{i}n{n}"
        out.append(" ".join(w))
    return out


def test_crowd_around_one_text(spark):
    texts = crowd(1, 2000)
    own = [minhash.shingles(t) for t in texts]
    assert all(minhash.linked(own[0], x) for x in own[1:])
    assert sum(minhash.linked(own[i], own[i + 1]) for i in range(1, 2000)) < 20
    df = spark.createDataFrame([(len(texts) - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r["component_id"] for r in minhash.group_documents(df).collect()} == {1}


@pytest.mark.parametrize("size, seed", [(400, 1), (1000, 3)])
def test_crowds_at_the_threshold(spark, size, seed):
    """Texts of 120 words with three words of their own each: about 0.75 alike, any two of them."""
    rnd = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(size):
        w = list(base)
        for at in rnd.choice(120, 3, replace=False):
            w[at] = f"own{i}x{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.group_documents(df).collect()} == brute(rows)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "z", "y"), (2, "a b c d e f", "v", "u")], "doc_id long, text string, k string, _k string")
    assert [tuple(r) for r in minhash.drop_near_duplicates(df).collect()] == [(1, "a b c d e f", "z", "y")]


def test_crowds_against_brute_force(spark):
    rows = list(enumerate(crowd(2, 150)[1:] + crowd(3, 150)))  # the first crowd without the text in its middle
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.group_documents(df).collect()} == brute(rows)


def test_in_common():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 6000, 8000)]
    assert (minhash.in_common(sets, sets[1:]) == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]).all()


def test_crowds_cost_in_proportion(spark, monkeypatch):
    """Texts that share a passage and little else: twice as many are held against each other in about twice as many rows."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    passage = " ".join(f"p{i}" for i in range(60))

    def cells(size):
        rows = [(i, passage + " " + " ".join(f"own{i}x{j}" for j in range(80))) for i in range(size)]
        own = [minhash.shingles(t) for _, t in rows]
        found = [(i, minhash.set_hash(x), minhash.signature(x).astype(">u4").tobytes()) for i, x in enumerate(own)]
        classes = spark.createDataFrame(found, "k long, s long, sig binary")
        groups = spark.createDataFrame([], "v long, c long")
        crowded = minhash._crowded(classes, groups)
        assert crowded.groupBy("t", "p").count().agg({"count": "max"}).first()[0] > size // 16
        return minhash._blocks(minhash._postings(crowded, classes)).count()

    assert cells(600) <= 3 * cells(300) + 600
