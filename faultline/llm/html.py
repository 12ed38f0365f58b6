"""Main text of web pages: the maximum-scoring contiguous run of words and tags, weights learned from labelled pages."""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template textarea title head svg math iframe object select option datalist canvas".split())
#: Elements that hold something other than the article, and words of class, id or role that mostly do: these have a weight (PRIOR) only until a learned one takes its place.
ASIDE_TAGS = frozenset("nav footer aside form button menu dialog fieldset label input".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sidebar rail widget footer masthead topbar header "
    "comment comments commentlist discussion disqus reply replies respond share sharing social follow related recommended recommendations "
    "newsletter subscribe subscription signup login search copyright complementary contentinfo".split()
)
#: Elements that do not end a block of text, and those that never hold anything.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the same kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Elements by which a page labels its article. They make the labels that weights are learned from, and
#: are no keys of a word.
ARTICLE_TAGS = frozenset(["article", "main"])
#: Pages that weights are learned from, about, and keys that the weights hold.
LEARNED_PAGES, LEARNED_KEYS = 1000, 4000
#: A key counts if it was seen with this many words; the largest weights of a word, either way; the key of all asides, the weight of class words that nothing was learned of, that of asides.
LEAST_WORDS, WORD_MOST, WORD_LEAST, ASIDE, PRIOR, NEVER = 30, 1.0, -0.2, "~aside", -4.0, -50.0
#: What a tag scores that is only seen in articles, and what it loses at most if it is not: a run that goes beyond such a tag has to win more words than that.
TAG_MOST, TAG_RANGE = -0.05, 10.0

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def priors() -> dict[str, float]:
    return {ASIDE: PRIOR} | {f".{w}": PRIOR for w in ASIDE_WORDS}


@dataclass
class Weights:
    """Log odds of a word: `word` of any, `keys` what each key of its path adds; score of a tag: `tags` by name, else `tag`."""

    word: float = 1.0
    keys: dict = field(default_factory=priors)
    tag: float = -0.1
    tags: dict = field(default_factory=dict)


@dataclass(slots=True)
class Element:
    """An open element; it knows its own keys only, so nesting costs no more than its depth. block: the nearest element above (or itself) that is not inline."""

    tag: str = ""
    keys: tuple = ()
    aside: bool = False
    labelled: bool = False
    above: Element | None = None
    block: Element | None = None
    odds: float | None = None


def _class_words(attributes: str) -> list[str]:
    return [p for _, v in _NAMED.findall(attributes) for p in _PARTS.findall(v.lower())] if attributes else []


def _is_aside(tag: str, attributes: str, labelled: bool) -> bool:
    """Elements that are never text of an article: by what HTML says that they are, or because they are hidden."""
    return tag in SILENT or tag in ASIDE_TAGS or tag == "header" and not labelled or bool(attributes and _HIDDEN.search(attributes))


def _element(tag: str, attributes: str, above: Element) -> Element:
    """Keys: the words of class, id and role, else the name of a block element, or only that it is an aside."""
    words = _class_words(attributes)
    labelled = above.labelled or tag in ARTICLE_TAGS or "articlebody" in words
    aside = above.aside or _is_aside(tag, attributes, above.labelled)
    if aside:
        keys = () if above.aside else (ASIDE,)
    else:
        own = [w for w in words if w != "articlebody" and not (w == "header" and labelled)]  # as in "post-header": of the article itself
        keys = tuple(dict.fromkeys(f".{w}" for w in own)) or (() if tag in INLINE or tag in ARTICLE_TAGS else (tag,))
    made = Element(tag, keys, aside, labelled, above)
    made.block = above.block if tag in INLINE else made
    return made


def walk(page: str):
    """The page in order: ("text", its element, text, whether a block begins), ("tag", the element it opens or ends, name), and ("in", element), ("out", element).

    What is never closed stays open to the end; an end tag that nothing answers is passed over.
    """
    root = Element()
    root.block = root
    now, is_open, at, fresh = root, Counter(), 0, True
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", now, page[at : m.start()], fresh
            fresh = False
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        block, met, upto = tag not in INLINE, now, now
        if m[2]:
            if is_open[tag]:
                end = now
                while end.tag != tag and (block or end.tag in INLINE):
                    end = end.above
                if end.tag == tag:
                    met, upto = end, end.above
        elif tag in SELF_CLOSING and now.block.tag == tag:
            upto = now.block.above
        while now is not upto:
            is_open[now.tag] -= 1
            yield "out", now
            now = now.above
        if not m[2] and tag not in VOID and not m[4].rstrip().endswith("/"):
            now = met = _element(tag, m[4], now)
            is_open[tag] += 1
            yield "in", now
        if tag == "br":
            yield "text", now, " ", False
        fresh = fresh or block and tag != "br"
        yield "tag", met, tag
    if at < len(page):
        yield "text", now, page[at:], fresh


def word_score(element: Element, weights: Weights) -> float:
    """What a word of the element scores: the log odds of its path, within WORD_LEAST and WORD_MOST."""
    path = []
    at = element
    while at is not None and at.odds is None:
        path.append(at)
        at = at.above
    odds = weights.word if at is None else at.odds
    for e in reversed(path):
        e.odds = odds = odds + sum(weights.keys.get(k, 0.0) for k in e.keys)
    return max(WORD_LEAST, min(WORD_MOST, odds))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the largest sum, the first of equal ones; (0, 0) if no sum is positive. One scan."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def scored(page: str, weights: Weights) -> tuple[list[tuple], list[float]]:
    """The page's texts and tags with their scores: a text has its words' score times their number, a tag its own."""
    pieces = [p for p in walk(page) if p[0] in ("text", "tag")]
    return pieces, [weights.tags.get(p[2], weights.tag) if p[0] == "tag" else word_score(p[1], weights) * len(p[2].split()) for p in pieces]


def extract(page: str, weights: Weights) -> str:
    """The text of the best run, character references decoded, blocks a space apart; what lies within it but scores as something else (an advert between paragraphs) is left out."""
    pieces, scores = scored(page, weights)
    blocks: list[list[str]] = []
    broken = True
    for kind, element, value, *begins in pieces[slice(*best_run(scores))]:
        if kind == "text":
            broken = broken or begins[0]
            if not element.aside and word_score(element, weights) > 0:
                if broken:
                    blocks.append([])
                blocks[-1].append(value)
                broken = False
    return " ".join(t for b in blocks if (t := " ".join(html_lib.unescape("".join(b)).split())))


def tally(page: str) -> Counter | None:
    """Words of each key and tags, by whether they are of the labelled article; None if the page labels none.

    A word counts once for a key, however often its path has it: a key counts from where it is first open to where it
    is open no more, so nesting costs nothing.
    """
    out, met, active, since = Counter(), [0, 0], Counter(), {}
    labelled = False

    def close(key):
        for own in (False, True):
            out[key, own] += met[own] - since[key][own]

    for kind, e, *value in walk(page):
        if kind == "in":
            for k in e.keys:
                if not active[k]:
                    since[k] = tuple(met)
                active[k] += 1
        elif kind == "out":
            for k in e.keys:
                active[k] -= 1
                if not active[k]:
                    close(k)
        elif kind == "tag":
            out[f"<{value[0]}", e.labelled and not e.aside] += 1
        else:
            own = e.labelled and not e.aside
            n = len(value[0].split())
            met[own] += n
            labelled = labelled or own and n > 0
    for k, n in active.items():
        if n:
            close(k)
    out["", False], out["", True] = met
    return out if labelled else None


def from_counts(found: dict[str, tuple[int, int]]) -> Weights:
    """Weights from (words or tags of articles, others) by key: log odds for words, and for tags the share that was beside articles."""
    odds = lambda a, b: math.log((a + 1) / (b + 1))
    prior = odds(*found.get("", (1, 0)))
    keys = priors() | {k: odds(a, b) - prior for k, (a, b) in found.items() if k and k[0] != "<" and a + b >= LEAST_WORDS}
    keys[ASIDE] = NEVER  # whatever it lies in, as a footer in a paragraph that was not closed
    tags = {k[1:]: TAG_MOST - TAG_RANGE * (b + 0.1) / (a + b + 1) for k, (a, b) in found.items() if k[:1] == "<"}
    return Weights(word=prior, keys=keys, tags=tags)


def fit(pages: DataFrame, pages_read: int = LEARNED_PAGES) -> Weights:
    """Weights from pages that label their article themselves, with an article or main element.

    About `pages_read` pages are read, those with the smallest hashes of page_id; Spark counts words by key and the
    LEARNED_KEYS most frequent come to the driver.
    """
    rows = pages.select("page_id", "html").where("html is not null and page_id is not null")
    n = rows.select(F.lit(1)).count()
    draw = F.pmod(F.xxhash64(F.lit("learn"), "page_id"), F.lit(1 << 30)) / float(1 << 30)

    def count(batch):
        total = Counter()
        for page in batch.column("html").to_pylist():
            total.update(tally(page) or {})
        flat = [(k, inside, m) for (k, inside), m in total.items() if m]
        return dict(zip(("key", "inside", "n"), (list(x) for x in zip(*flat)))) if flat else None

    counted = map_arrow(rows.where(draw < min(1.0, pages_read / max(1, n))).select("html"), count, "key string, inside boolean, n long")
    sums = counted.groupBy("key").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("all"))
    return from_counts({r["key"]: (r["own"], r["all"] - r["own"]) for r in sums.orderBy(F.desc("all"), "key").limit(LEARNED_KEYS).collect()})


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page, and one without text of its own, has an empty text. Broken markup (elements never closed, a
    page cut off) is read as far as it goes. Repeated pages get equal results; extra columns are ignored; nothing is
    shuffled, and the weights, whose size their parameters bound, go to the executors. Where no page is labelled, words
    count 1 and asides are known by their elements and the priors of class words only.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or fit(pages))

    def run(batch):
        found = [extract(p or "", shared.value) for p in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array(map(len, found), pa.int64())}

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_arrow(slim, run, "page_id long, url string, text string, n_chars long")
