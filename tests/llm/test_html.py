import html
import re

import pytest

from faultline.llm.html import ASIDE, Weights, best_run, extract, extract_pages, fit, scored


def plain(page):
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    t = re.sub(r"<(p|/p|h1|/h1|br)>", " ", m[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*$", "", t)).split())


def test_marked_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_unmarked_pages_with_learned_weights(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = fit(pages)
    assert weights.tags["li"] < weights.tags["p"] < 0 and weights.keys["p"] > 0 > weights.keys[ASIDE]
    for r in pages.collect():
        for opened, closed in (("", ""), ("<div class='wrap'><div>", "</div></div>"), ("<section id=x7>", "</section>")):
            bare = r["html"].replace("<article>", opened).replace("</article>", closed)
            assert extract(bare, weights) == plain(r["html"])


def test_scan_and_weights_decide(spark, monkeypatch):
    """Teasers and comments in elements that nothing is known of: only where the run ends, and what tags were learned to cost, keeps them out."""
    from faultline.llm import html as module

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    learned, right, total, by_scan, by_weights = fit(pages), 0, 0, 0, 0
    for r in pages.collect():
        page, want = r["html"], plain(r["html"])
        if "</article>" not in page or len(want.split()) < 20:
            continue
        page = page.replace("<article>", "<div class=k7q><p>Read this next week</p></div><article>").replace("</article>", "</article><div class=zqx2><p>Great post, thanks for sharing</p></div>")
        got = extract(page, learned)
        total, right = total + 1, right + (got == want)
        by_weights += extract(page, Weights()) != got
        monkeypatch.setattr(module, "best_run", lambda scores: (0, len(scores)))
        by_scan += extract(page, learned) != got
        monkeypatch.undo()
    assert total > 40 and right >= 0.98 * total and by_scan == by_weights == total


def test_class_words_are_learned(spark):
    """A class of the list that labelled articles use is text; one that is not of the list and stands beside them is not."""
    page = "<body><div class=zzz><p>" + "beside it " * 20 + "</p></div><article><div class=sponsor><p>" + "of the text " * 20 + "</p></div></article></body>"
    weights = fit(spark.createDataFrame([(i, "u", page) for i in range(30)], "page_id long, url string, html string"))
    assert weights.keys[".sponsor"] > 0 > weights.keys[".zzz"] and Weights().keys[".sponsor"] < 0
    assert extract(page.replace("article>", "section>"), weights) == ("of the text " * 20).strip()


def every_run(page, weights):
    """The best run by trying every start and end, from scores worked out anew for each piece."""
    pieces, scores = scored(page, weights)
    for p, s in zip(pieces, scores):
        if p[0] == "text":
            keys, at = [], p[1]
            while at is not None:
                keys += at.keys
                at = at.above
            odds = weights.word + sum(weights.keys.get(k, 0.0) for k in keys)
            assert s == pytest.approx(min(1.0, max(-0.2, odds)) * len(p[2].split()))
        else:
            assert s == weights.tags.get(p[2], weights.tag) < 0
    sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
    return max(sums.values(), default=0.0), scores


def test_run_has_the_largest_sum(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    learned = fit(pages)
    tried = [r["html"][:6000] for r in pages.limit(15).collect()] + ["<p>a b</p><nav>x</nav><p>c d e</p>", "<nav>x</nav>", "<p>a</p><div class=ad>" + "b " * 9 + "</div><p>c d</p>"]
    for page in tried:
        for weights in (learned, Weights(), Weights(word=0.1, tag=-2.0)):
            best, scores = every_run(page, weights)
            a, b = best_run(scores)
            assert sum(scores[a:b]) == pytest.approx(max(0.0, best))


def test_weights_decide_on_labelled_pages():
    page = "<body><p>one two three</p><article><p class=zz>four five six seven</p></article></body>"
    assert extract(page, Weights()) == "one two three four five six seven"
    assert extract(page, Weights(keys={".zz": -9.0, ASIDE: -4.0})) == "one two three"


def test_nesting_costs_no_more_than_its_depth():
    page = "<div><b>" * 30_000 + "deep words"
    assert extract(page, Weights(tag=-1e-6)) == "deep words"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<html><body><nav>a b c</nav></body></html>", ""),
        ("<p>Foo<b>bar</b>  baz &lt;x&gt; &amp; q<br>line</p>", "Foobar baz <x> & q line"),
        ("<div id=cookie-notice>we use cookies</div><main><h1>T</h1><p>one two</p><div class='advert big'>buy</div><aside>s</aside><p>three four five six</p><section class=\"comments\"><p>nice</p></section></main><footer>f</footer>", "T one two three four five six"),
        ("<article><header class='post-header'><h1>Head</h1></header><p>text <a href='x'>link</a> more<form>f <input></form></article>", "Head text link more"),
        ("<article><p>unclosed <b>bold<p>next<script>var t='</p>';</script> end<p cla", "unclosed bold next end"),
        ("<article><p>a<!-- hidden <p> -->b</p><style>p{}</style></article>", "ab"),
    ],
)
def test_cases(page, text):
    assert extract(page, Weights()) == text


def test_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article>x</article>"), (2, "v", "<article>" + "<p>word " * 20000)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 99999)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
