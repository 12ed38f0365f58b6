"""Language identification of mixed texts: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, map_arrow

#: First and last code point of the scripts told apart; a letter outside them belongs to "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
#: Labelled documents of each language that are learned from, about (a sample by a hash of doc_id).
LEARNED_DOCUMENTS = 2000
#: Most frequent words of each language that the model holds.
LEARNED_WORDS = 30_000
#: A word's score for a language is never further below its best language's than this.
FLOOR = 6.0
#: What it costs to change language between two words.
SWITCH = 9.0
#: A script belongs to a language if at least this share of its letters is of the script.
SCRIPT_SHARE = 0.01
#: Words whose scores a worker remembers, and scores (words times languages) that one Viterbi pass covers, about: a pass
#: takes as many steps as its longest text has words, so few large passes are best.
REMEMBERED, PASS_SCORES = 300_000, 6_000_000

_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. The pattern takes in numerals that are no digits, such as those of powers: they divide."""
    found = _WORDS(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in ("".join(c if c.isalpha() else " " for c in f).split() if not f.isalpha() else (f,))]


def script_of(word: str) -> str:
    c = ord(word[0])
    for name, ranges in SCRIPTS.items():
        for first, last in ranges:
            if first <= c <= last:
                return name
    return "other"


@dataclass
class LanguageModel:
    """Word counts and letter-triple counts of each language, as scores; scripts each language is written in."""

    languages: list[str]
    words: dict[str, list[float]]
    triples: dict[str, list[float]]
    unseen: list[float]
    scripts: dict[str, list[bool]]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, word: str) -> list[float]:
        """Log likelihoods below the best language's, from -2*FLOOR (script not in use) to 0; all 0 if nothing is known."""
        fits = self.scripts.get(script_of(word))
        if fits is None or not any(fits):
            return [0.0] * len(self.languages)
        found = self.words.get(word)
        if found is None:
            padded = f"^{word}$"
            found = [0.0] * len(self.languages)
            for i in range(len(padded) - 2):
                found = [a + b for a, b in zip(found, self.triples.get(padded[i : i + 3], self.unseen))]
        best = max(x for x, ok in zip(found, fits) if ok)
        return [max(-FLOOR, min(0.0, x - best)) if ok else -2 * FLOOR for x, ok in zip(found, fits)]


def fit(labelled: DataFrame, documents: int = LEARNED_DOCUMENTS, words: int = LEARNED_WORDS) -> LanguageModel:
    """Learn from columns doc_id, text, lang (rows with nulls are left out).

    Of each language about `documents` rows are read, those with the smallest hashes of doc_id, so the cost does not
    grow with the corpus; their words are counted by Spark and the `words` most frequent of each come to the driver.
    """
    rows = labelled.where("text is not null and lang is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {}, {}, [], {})
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, documents / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.lit("learn"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def count(batch):
        found = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found[lang].update(words_of(text))
        flat = [(k, w, n) for k, c in found.items() for w, n in c.items()]
        return dict(zip(("lang", "word", "n"), (list(x) for x in zip(*flat)))) if flat else None

    counted = map_arrow(rows.where(draw < share[F.col("lang")]).select("lang", "text"), count, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    table: dict[str, dict[str, int]] = {k: {} for k in languages}
    for r in counted.withColumn("place", place).where(F.col("place") <= words).collect():
        table[r["lang"]][r["word"]] = r["n"]
    return from_counts(table)


def from_counts(table: dict[str, dict[str, int]]) -> LanguageModel:
    languages = sorted(table)
    total = [max(1, sum(table[k].values())) for k in languages]
    vocabulary = set().union(*table.values()) if table else set()
    seen = {w: c for w in vocabulary if sum(c := [table[k].get(w, 0) for k in languages]) >= 3}
    words = {w: [math.log((n + 0.05) / (t + 1)) for n, t in zip(c, total)] for w, c in seen.items()}
    triples: dict[str, list[float]] = {}
    scripts: dict[str, list[float]] = {}
    for i, k in enumerate(languages):
        for w, n in table[k].items():
            padded, n = f"^{w}$", min(n, 20)
            for j in range(len(padded) - 2):
                triples.setdefault(padded[j : j + 3], [0.0] * len(languages))[i] += n
            scripts.setdefault(script_of(w), [0.0] * len(languages))[i] += table[k][w] * len(w)
    sums = [max(1.0, sum(t[i] for t in triples.values())) for i in range(len(languages))]
    size = len(triples) + 1
    letters = [max(1.0, sum(s[i] for s in scripts.values())) for i in range(len(languages))]
    return LanguageModel(
        languages,
        words,
        {t: [math.log((n + 0.2) / (s + 0.2 * size)) for n, s in zip(c, sums)] for t, c in triples.items()},
        [math.log(0.2 / (s + 0.2 * size)) for s in sums],
        {s: [x / n >= SCRIPT_SHARE for x, n in zip(c, letters)] for s, c in scripts.items()},
    )


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word; scores of the texts one after another, all texts a word at a time, longest first."""
    total, k = scores.shape
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    back = np.zeros((total, k), np.int16)
    best = scores[starts[: alive[0]]].copy() if len(alive) else np.zeros((0, k))
    stay = np.arange(k, dtype=np.int16)
    ends = np.zeros(len(lengths), np.int64)
    for t in range(1, len(alive)):
        n = alive[t]
        if n < len(best):
            ends[n : len(best)] = best[n:].argmax(1)
            best = best[:n]
        at, top = starts[:n] + t, best.argmax(1)
        jump = best[np.arange(n), top] - switch
        better = jump[:, None] > best
        back[at] = np.where(better, top[:, None], stay)
        best = scores[at] + np.where(better, jump[:, None], best)
    ends[: len(best)] = best.argmax(1) if len(best) else 0
    labels = np.zeros(total, np.int16)
    state = np.zeros(len(lengths), np.int64)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        fresh = alive[t + 1] if t + 1 < len(alive) else 0
        state[fresh:n] = ends[fresh:n]
        at = starts[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


class Labeller:
    """A worker's scores of words, kept from task to task."""

    def __init__(self, model: LanguageModel):
        self.model, self.ids = model, {}
        self.rows = np.zeros((1 << 14, max(1, len(model.languages))), np.float32)

    def word_id(self, word: str) -> int:
        self.ids[word] = i = len(self.ids)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = self.model.score(word)
        return i

    def label(self, texts: list[str | None], known: bool = False):
        """For each text: language (und without letters), share of its letters in that language, spans lang:first word:last word + 1.

        known: letters of words about which no language is known (of a script that none uses) are in no language.
        """
        out, at, most = [], 0, PASS_SCORES // max(1, len(self.model.languages))
        while at < len(texts):
            if len(self.ids) > REMEMBERED:
                self.ids.clear()
                self.rows = self.rows[: 1 << 14].copy()
            get, slow, ids, sizes, lengths = self.ids.get, self.word_id, [], [], []
            while at < len(texts) and len(ids) < most:
                words = words_of(texts[at] or "")
                ids += [i if (i := get(w)) is not None else slow(w) for w in words]
                sizes += map(len, words)
                lengths.append(len(words))
                at += 1
            out += self._pass(np.array(ids, np.int64), np.array(sizes, np.int64), np.array(lengths, np.int64), known)
        return out

    def _pass(self, ids, sizes, lengths, known):
        names = self.model.languages
        if not names or not len(ids):
            return [("und", 0.0, "")] * len(lengths)
        rows = self.rows[ids]
        labels = viterbi(rows, lengths, SWITCH)
        counted = np.where(rows.any(axis=1) | (len(names) == 1), sizes, 0) if known else sizes
        out, start = [], 0
        for n in lengths.tolist():
            if not n:
                out.append(("und", 0.0, ""))
                continue
            own, weight = labels[start : start + n], counted[start : start + n]
            shares, letters = np.bincount(own, weights=weight, minlength=len(names)), sizes[start : start + n].sum()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), n]
            best = int(shares.argmax())
            out.append((names[best], float(shares[best] / letters), ",".join(f"{names[own[a]]}:{a}:{b}" for a, b in zip(cuts, cuts[1:]))))
            start += n
        return out


_LABELLERS: dict[str, Labeller] = {}


def labeller_for(name: str, shared) -> Labeller:
    if name not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[name] = Labeller(shared.value)
    return _LABELLERS[name]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, text, lang_pred, score (share of letters in spans of that language), spans; only the text decides.

    Null, empty and letterless texts are `und` with score 0 and no spans. Repeated rows get equal results; ties go to
    the language first in alphabetical order; a language must have been learned to be predicted. Nothing is shuffled.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), model.name

    def run(batch):
        found = labeller_for(name, shared).label(batch.column("text").to_pylist())
        lang, score, spans = (list(x) for x in zip(*found))
        return {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": pa.array(score, pa.float64()), "spans": spans}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, spans string")


def held_out():
    """True where crc32 of doc_id as text leaves 1 modulo 3: such documents are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


def keep_identified(docs: DataFrame, least: float = 1 / 3) -> DataFrame:
    """The rows, with their columns, whose language is known for at least that share of their letters.

    Words of a script that no learned language uses are in no known language, so a text of such words goes, as do
    texts without letters.
    """
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    shared, name, at = docs.sparkSession.sparkContext.broadcast(model), model.name, docs.columns.index("text")

    def run(batches):
        for b in batches:
            found = labeller_for(name, shared).label(b.column(at).to_pylist(), known=True)
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score, _ in found], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
