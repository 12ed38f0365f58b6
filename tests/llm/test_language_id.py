import numpy as np
from pyspark.sql import functions as F

from faultline.llm import langid


def brute_viterbi(scores, switch):
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        top = best.argmax()
        come = [k if best[k] >= best[top] - switch else top for k in range(len(best))]
        back.append(come)
        best = s + np.array([max(best[k], best[top] - switch) for k in range(len(best))])
    out = [int(best.argmax())]
    for come in reversed(back):
        out.append(come[out[-1]])
    return out[::-1]


def test_viterbi_equals_a_plain_one():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 7, 30, 2, 30, 11])
    scores = -rng.integers(0, 9, (lengths.sum(), 4)).astype(float)
    got = langid.viterbi(scores, lengths, 5.0)
    at = 0
    for n in lengths:
        own, want = got[at : at + n], brute_viterbi(scores[at : at + n], 5.0)
        total = lambda path: sum(scores[at + i][k] for i, k in enumerate(path)) - 5.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        assert np.isclose(total(own), total(want))
        at += n


def test_scripts_narrow_and_spans_split():
    model = langid.from_counts({"en": {"the": 50, "house": 20}, "ru": {"дом": 50, "это": 20}, "de": {"das": 50, "haus": 20}})
    assert model.score("дом")[model.languages.index("en")] == -2 * langid.FLOOR
    lang, score, spans = langid.Labeller(model).label(["the house the house дом это дом это дом дом"])[0]
    assert spans.startswith("en:0:4,ru:4:10") and 0.4 < score < 0.7
    assert langid.Labeller(model).label(["123", None, ""]) == [("und", 0.0, "")] * 3


def test_held_out_accuracy(docs):
    found = langid.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_edges(edge_docs, no_docs, edge_rows):
    rows = langid.identify_documents(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] in (0, 1, 2, 8)}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in by.values())
    assert langid.identify_documents(no_docs).count() == 0
    assert langid.keep_identified(edge_docs).columns == edge_docs.columns
    assert langid.keep_identified(no_docs).count() == 0


def test_letters_beside_numerals():
    assert langid.words_of("m² x½ ²the 3a b_c Ⅷx") == ["m", "x", "the", "a", "b", "c", "x"]
    assert langid.words_of("no numerals here") == ["no", "numerals", "here"]


def test_letters_beside_numerals_have_a_language(spark, docs):
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rows = [(1, "m²"), (2, "x½"), (3, "²the"), (4, "12 ² ½"), (5, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[4] == got[5] == "und" and all(got[i] in model.languages for i in (1, 2, 3))


def test_texts_of_unknown_scripts_are_not_kept(spark, docs):
    rows = [(i, r["text"], r["lang"], "s", 1) for i, r in enumerate(docs.where("lang is not null and length(text) > 50").limit(60).collect())]
    rows += [(1000, "слово за слово идёт и идёт", None, "s", 1), (1001, "αβγ δεζ ηθι", None, "s", 1), (1002, "日本語 のテキスト", None, "s", 1)]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(60))


def test_more_languages_than_a_byte_holds():
    k = 300
    scores = np.zeros((4, k), np.float32)
    scores[:, 299] = 1.0
    assert langid.viterbi(scores, np.array([4]), 1.0).tolist() == [299] * 4
