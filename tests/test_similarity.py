"""The search for similar strings against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import linking, similarity
from faultline.operators.similarity import JACCARD, PARTIAL, WEIGHTED, Strings

RATIO = {"weighted": similarity.weighted, "jaccard": lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))}


def words(seed=5, n=200):
    rnd = random.Random(seed)
    some = {"".join(rnd.choice("abcde1") for _ in range(rnd.randrange(1, 9))) for _ in range(n)}
    some |= {"".join(rnd.choice("abcdefghijklmnop12") for _ in range(rnd.randrange(3, 30))) for _ in range(n)}
    some |= {f"supplier{i:09d}" for i in rnd.sample(range(2000), n)} | {"ünïcode" + c for c in "éèüß日本"} | {"x" * 70 + "y" * k for k in (1, 30)} | {"xy" * 50}
    return sorted(some)


def score(measure, x, y):
    return PARTIAL if x in y or y in x else RATIO[measure.name](x, y)


def test_the_weighted_ratio():
    """Values worked out by hand: twice the common subsequence over both lengths; of parts, where one is much longer."""
    want = {("p12", "p21"): 4 / 6, ("naton12", "nation12"): 14 / 15, ("abc", "abc"): 1.0, ("ab", "xxxxabxxxx"): 0.9, ("ab", "x" * 20 + "ab"): 0.6, ("abcd", "xxabxcdxx"): 0.9 * 6 / 8, ("", "a"): 0.0}
    assert {p: similarity.weighted(*p) for p in want} == pytest.approx(want)


@pytest.mark.parametrize("measure", [JACCARD, WEIGHTED])
def test_scores_of_a_batch(measure):
    t = words(1, 60)
    s = Strings(t)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(t)), np.arange(len(t))))
    a, b = a[a != b], b[a != b]
    got, held = measure.scores(s, a, b, np.zeros(len(a)))
    want = np.array([score(measure, t[i], t[j]) for i, j in zip(a, b)])
    assert np.allclose(got, want, atol=1e-12)
    some, _ = measure.scores(s, a, b, np.full(len(a), 0.7))
    assert np.allclose(some[want >= 0.7], want[want >= 0.7]) and (some[want < 0.7] < 0.7).all()


@pytest.mark.parametrize("measure", [JACCARD, WEIGHTED])
def test_near_scores_against_all_pairs(spark, measure):
    """No pair is lost by passing over blocks."""
    all_ = words()
    left, right = all_[::3], all_[1::2] + all_[:10]
    got = linking.near_scores(spark.createDataFrame([(x,) for x in left], "mention_key string"), spark.createDataFrame([(x,) for x in right], "key string"), measure).collect()
    want = {(x, y): s for x in left for y in set(right) if x != y and (s := score(measure, x, y)) >= linking.MIN_SCORE}
    assert {(r["mention_key"], r["key"]): r["score"] for r in got} == pytest.approx(want) and len(got) == len(want)


@pytest.mark.parametrize("measure", [JACCARD, WEIGHTED])
def test_the_best_k(spark, measure):
    """The first k of each mention are those of all pairs, ties by id; blocks that cannot hold one are not looked into."""
    terms = [(f"id{i}", "L", ("mvtec", "tep", "shared")[i % 3], i % 2, w) for i, w in enumerate(words(9, 400))]
    mentions = [(w, d) for w in words(11, 12)[::2] for d in ("mvtec", "tep")] + [("", "tep")]
    t = spark.createDataFrame(terms, "id string, label string, scenario string, ord int, key string")
    m = spark.createDataFrame(mentions, "mention_key string, dataset string")
    got = linking.rank(linking.near_candidates(m, t, measure, 4), ["mention_key", "dataset"], 4).collect()
    have = {(r["mention_key"], r["dataset"], r["rank"]): (r["id"], round(r["score"], 9)) for r in got}
    want = {}
    for w, d in mentions:
        found = sorted((-round(s, 9), i) for i, _, scope, _, k in terms if w and k != w and scope in (d, "shared") and (s := score(measure, w, k)) >= linking.MIN_SCORE)
        want |= {(w, d, n + 1): (i, -s) for n, (s, i) in enumerate(found[:4])}
    assert have == want


@pytest.mark.parametrize("kind, share", [("numbers", 0.4), ("words", 0.5)])
def test_few_blocks_are_looked_into(spark, kind, share):
    """Names that differ in a number, and words of any letters: blocks that cannot hold a near one are passed over, and none is lost."""
    rnd = random.Random(3)
    names = sorted({f"supplier{rnd.randrange(10**9):09d}" if kind == "numbers" else "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(20_000)})
    index = similarity.build(spark.createDataFrame([("", n) for n in names], "scope string, key string"))
    asked = [n[:9] + "7" + n[10:] for n in names[::1000]]
    wanted = spark.createDataFrame([(a, "", 0.9) for a in asked], "mention_key string, scope string, least double")
    assert len(index.levels) > 1
    assert similarity.descend(wanted, index, WEIGHTED).count() < share * len(asked) * index.leaves.count()
    found = {(r["mention_key"], r["key"]) for r in similarity.search(wanted, index, WEIGHTED).collect()}
    assert found == {(a, n) for a in asked for n in names if a != n and len(set(a) & set(n)) > 4 and score(WEIGHTED, a, n) >= 0.9}


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "mention_key string")
    keys = spark.createDataFrame([("abc",)], "key string")
    assert linking.near_scores(none, keys).collect() == []
    assert linking.near_scores(spark.createDataFrame([("abd",)], "mention_key string"), keys.where("false")).collect() == []


def test_first_look_spares_blocks(spark, monkeypatch):
    """The best candidates are those of a whole search, though few blocks are looked into for them."""
    names = [f"unit {i:05d}" for i in range(2000)]
    terms = spark.createDataFrame([(f"n{i}", "Object", "tep", 1, n) for i, n in enumerate(names)], "id string, label string, scenario string, ord int, key string")
    mentions = spark.createDataFrame([(f"unit x{i:05d}", "tep") for i in range(0, 2000, 50)], "mention_key string, dataset string")
    seen = []
    descend = similarity.descend

    def counted(*args):
        out = descend(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(similarity, "descend", counted)
    best = lambda k: {(r["mention_key"], r["id"], r["rank"], round(r["score"], 9)) for r in linking.rank(linking.near_candidates(mentions, terms, similarity.WEIGHTED, k), ["mention_key"], 15).collect()}
    some, whole = best(15), best(None)
    assert some == whole and len(seen) == 3
    assert seen[0] <= 40 * 2 and sum(seen[:2]) < seen[2]


def test_close_strings_by_equality(spark):
    """Strings up to three characters apart, counted over both, are found with their scores, and no others that score more than `beyond`."""
    rnd = random.Random(5)
    keys = sorted({"".join(rnd.choice("ab1") for _ in range(rnd.randrange(9, 15))) for _ in range(400)})
    asked = sorted({"".join(rnd.choice("ab1") for _ in range(rnd.randrange(11, 14))) for _ in range(25)} | set(keys[:20:2]))
    asked = [a for a in asked if len(a) >= similarity.CLOSE_FROM]
    wanted = spark.createDataFrame([(a, "s", 0.0) for a in asked], "mention_key string, scope string, least double")
    rows = similarity.close(wanted, spark.createDataFrame([("s", k) for k in keys], "scope string, key string"), WEIGHTED).collect()
    got = {(r["mention_key"], r["key"]): r["score"] for r in rows}
    near = {(a, k): score(WEIGHTED, a, k) for a in asked for k in keys if a != k and len(a) + len(k) - 2 * similarity.common_length(a, k) <= similarity.CLOSE}
    assert got == pytest.approx(near) and len(rows) == len(near) > 5
    most = lambda a: max(similarity.PART, 2 * len(a) / (2 * len(a) + similarity.CLOSE + 1))
    assert all(score(WEIGHTED, a, k) <= most(a) + 1e-9 for a in asked for k in keys if a != k and (a, k) not in near)


def test_mentions_with_close_names_need_no_tree(spark, monkeypatch):
    """Where k nodes are nearer than anything far off can be, no blocks are searched, and the best are those of a whole search."""
    names = [f"supplier{i:09d}" for i in range(1500)]
    terms = spark.createDataFrame([(f"S{i % 900}", "Object", "tep", i // 900, n) for i, n in enumerate(names)], "id string, label string, scenario string, ord int, key string")
    mentions = spark.createDataFrame([(f"supplier{i:09d}", "tep") for i in range(1100, 1500, 10)] + [(names[25][1:], "tep")], "mention_key string, dataset string")
    best = lambda k: {(r["mention_key"], r["id"], r["rank"], round(r["score"], 9)) for r in linking.rank(linking.near_candidates(mentions, terms, WEIGHTED, k), ["mention_key"], 15).collect()}
    whole = best(None)
    monkeypatch.setattr(similarity, "build", lambda strings: pytest.fail("a tree was built"))
    assert best(15) == whole and len(whole) == 41 * 15


def test_short_mentions_with_close_names_need_no_tree(spark, monkeypatch):
    """Numbers that another scope has: where k are one character away, or two, no blocks are searched, and the best are those of a whole search."""
    digits = lambda n: ["p" + "".join(x) for x in itertools.product("0123", repeat=n)]
    terms = spark.createDataFrame([(w, "AnomalyType", "tep", 0, w) for w in digits(5)[::2] + digits(6)[::3]], "id string, label string, scenario string, ord int, key string")
    mentions = spark.createDataFrame([(w, "tep") for w in digits(5)[1::40] + digits(6)[1::180]], "mention_key string, dataset string")
    best = lambda k: {(r["mention_key"], r["id"], r["rank"], round(r["score"], 9)) for r in linking.rank(linking.near_candidates(mentions, terms, WEIGHTED, k), ["mention_key"], 6).collect()}
    whole = best(None)
    monkeypatch.setattr(similarity, "build", lambda strings: pytest.fail("a tree was built"))
    assert best(6) == whole and len(whole) == mentions.count() * 6


@pytest.mark.parametrize("apart", [1, 2, 3])
def test_what_is_not_close_scores_no_more_than_beyond(spark, apart):
    """Strings so many characters apart are found, with their scores; no other one scores more than `beyond`, however short or long."""
    rnd = random.Random(apart)
    keys = sorted({"".join(rnd.choice("ab1") for _ in range(rnd.randrange(1, 16))) for _ in range(500)})
    asked = [k for k in keys if len(k) >= similarity.CLOSE_FROM][::9]
    wanted = spark.createDataFrame([(a, "s", 0.0) for a in asked], "mention_key string, scope string, least double")
    got = {(r["mention_key"], r["key"]): r["score"] for r in similarity.close(wanted, spark.createDataFrame([("s", k) for k in keys], "scope string, key string"), WEIGHTED, apart).collect()}
    assert got == pytest.approx({(a, k): score(WEIGHTED, a, k) for a in asked for k in keys if a != k and len(a) + len(k) - 2 * similarity.common_length(a, k) <= apart})
    most = {r["a"]: r["b"] for r in spark.createDataFrame([(a,) for a in asked], "a string").withColumn("b", similarity.beyond(F.length("a"), apart)).collect()}
    assert all(score(WEIGHTED, a, k) <= most[a] for a in asked for k in keys if a != k and (a, k) not in got)
