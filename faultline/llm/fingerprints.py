"""Document fingerprints by spot signatures: chains of content words that follow common words."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, key_of, materialize, unkey

#: Common words of English, French, German and Spanish that anchor signatures.
ANCHORS = frozenset(
    "the of and to in a is was that it for le la les de des et un une en que der die das und von ein eine zu dem ist el los las y del por con se".split()
)
#: Content words in a chain.
CHAIN = 2
#: Of the chains after other words one in ALSO, by its hash, and the FEW with the smallest hashes count too, so that texts without common words have signatures.
ALSO, FEW = 32, 24
#: Words of more than LONG characters (texts without blanks) have signatures of their own, one in RUNS of their runs of GRAM characters, by its hash; so has a text without words.
LONG, GRAM, RUNS = 24, 4, 4
#: Likeness from which `near_documents` takes two documents as near.
NEAR = 0.75
#: Rows of one ordered run of documents, about; runs at most (the driver knows their bounds); the accuracy of the bounds.
RUN_ROWS, MAX_RUNS, ACCURACY = 2000, 100_000, 0.001

_WORDS = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word to (hash, whether it is an anchor); bounded, as it is emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = h = h & ~1 | (word in ANCHORS)
        return h


_HASHES = WordHashes()


def character_runs(text: str) -> np.ndarray:
    """32-bit hashes of one in RUNS of the text's runs of GRAM characters, and of the one with the smallest hash."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint32)
    codes = np.concatenate([codes, np.zeros(max(0, GRAM - len(codes)), np.uint64)])
    n = len(codes) - GRAM + 1
    run = np.full(n, GRAM, np.uint64)
    for i in range(GRAM):
        run = (run ^ (run >> np.uint64(29))) * _MIX + codes[i : i + n]
    run = (run ^ (run >> np.uint64(32))) * _MIX
    run = run ^ (run >> np.uint64(31))
    kept = run[(run >> np.uint64(20)) % np.uint64(RUNS) == 0]
    return (np.append(kept, run.min()) >> np.uint64(32)).astype(np.uint32)


def signatures(text: str) -> np.ndarray:
    """The text's set of 32-bit spot signatures, sorted.

    A signature is an anchor with the next CHAIN words that are no anchors (fewer at the end of a text) and how often the text has had
    it before, so sets compare as multisets. Of the chains after other words one in ALSO and the FEW smallest by hash are
    signatures too: one rule for texts of any length, so near copies never differ by it, and a text without common words is not
    without signatures. Of a word of more than LONG characters, and of a text without words, runs of characters are signatures.
    """
    words = _WORDS(text.lower())
    if not words:
        return np.unique(character_runs(text))
    long = [character_runs(w) for w in words if len(w) > LONG]
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    common = (h & np.uint64(1)).astype(bool)
    content = np.concatenate([h[~common], np.zeros(CHAIN, np.uint64)])
    sig, after = h, np.cumsum(~common)
    for i in range(CHAIN):
        sig = (sig ^ (sig >> np.uint64(29))) * _MIX + content[after + i]
    order = np.argsort(sig, kind="stable")
    sig, common = sig[order], common[order]
    first = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1])
    before = np.arange(len(sig)) - np.repeat(first, np.diff(np.concatenate([first, [len(sig)]])))
    sig = (sig ^ (sig >> np.uint64(32))) * _MIX + before.astype(np.uint64)
    sig = (sig ^ (sig >> np.uint64(31))) * _MIX
    anchored, other = sig[common], sig[~common]
    if len(other) > FEW:
        few = np.zeros(len(other), bool)
        few[np.argsort(other, kind="stable")[:FEW]] = True
        other = other[few | ((other >> np.uint64(20)) % np.uint64(ALSO) == 0)]
    return np.unique(np.concatenate([(anchored >> np.uint64(32)).astype(np.uint32), (other >> np.uint64(32)).astype(np.uint32), *long]))


def to_text(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets. Two empty sets: 1. least: where it is lower, 0 may come instead.

    The sets are met a part at a time, a quarter of the smaller one at once, and given up as soon as what is left of it cannot
    reach `least` any more.
    """
    if not len(a) and not len(b):
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) < least * len(large):
        return 0.0
    both, met, step = 0, 0, max(64, len(small) // 4)
    while met < len(small):
        part = small[met : met + step]
        at = np.searchsorted(large, part)
        both += int((large[np.minimum(at, len(large) - 1)] == part).sum())
        met += len(part)
        most = both + len(small) - met
        if most < least * (len(small) + len(large) - most):
            return 0.0
    return both / (len(small) + len(large) - both)


def partition_of(length, least: float = NEAR):
    """The partition of a set by its length (a column or a number): sets that are alike lie in one, or in neighbouring ones."""
    return F.floor(F.log(F.greatest(length, F.lit(1))) / -float(np.log(least)) + 1e-12).cast("int")


def near_documents(docs: DataFrame, least: float = NEAR) -> DataFrame:
    """(class, other, likeness) of fingerprints whose likeness is `least` or more: class and other are the smallest doc_id of the texts with each.

    Equal fingerprints are one class, so copies cost nothing. Sets are partitioned by length; in its own partition and the next one up a set
    looks up its rarest signatures, as many as one of them must be shared; each pair is compared once, from the smaller
    set, through a Jaccard that gives up early. Texts without signatures are near to none; null doc_ids stand last; repeated rows and an
    empty table need nothing else.
    """

    def sign(batches):
        for b in batches:
            sets = [signatures(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "s"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = bounded(slim).mapInArrow(sign, "doc_id long, s array<long>").where(F.size("s") > 0)
    classes = materialize(signed.groupBy("s").agg(F.min("doc_id").alias("class")).withColumn("n", F.size("s")))
    common = classes.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    members = classes.select("class", "n", F.explode("s").alias("sig")).join(common, "sig")
    order = Window.partitionBy("class").orderBy("df", "sig")
    rare = members.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    rare = materialize(rare.where("df > 1").select("sig", "class", "n", partition_of(F.col("n"), least).alias("part")))
    up = rare.select("sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("class").alias("a"), F.col("n").alias("na"))
    met = up.join(rare.select("sig", "part", F.col("class").alias("b"), F.col("n").alias("nb")), ["sig", "part"])
    met = met.where((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))).where(F.col("na") >= F.col("nb") * F.lit(least) - 1e-9).select("a", "b").distinct()
    pairs = met.join(classes.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a").join(classes.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b")

    def compare(batches):
        for b in batches:
            found = [likeness(np.array(x), np.array(y), least) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(found, pa.float64())], ["class", "other", "likeness"])

    return bounded(pairs).select("a", "b", "sa", "sb").mapInArrow(compare, "class long, other long, likeness double").where(F.col("likeness") >= least)


class Runs:
    """Bounds of the runs that documents are dealt to, in the order of (key, place): a key with many rows spans several runs by its texts' places."""

    def __init__(self, keys: list[int]):
        values, counts = np.unique(np.array(keys, np.int64), return_counts=True)
        self.keys = np.repeat(values, counts)
        # of a key that is r bounds at once, the places are cut in r + 1 parts of one size
        self.cuts = np.concatenate([np.arange(1, r + 1) * ((1 << 32) // (r + 1)) for r in counts.tolist()] or [np.zeros(0, np.int64)]).astype(np.int64)

    def of(self, k: np.ndarray, place: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.keys, k, side="left")
        heavy = np.flatnonzero(np.searchsorted(self.keys, k, side="right") - run > 1)
        for i in heavy.tolist():
            end = np.searchsorted(self.keys, k[i], side="right")
            run[i] += np.searchsorted(self.cuts[run[i] : end], place[i], side="left")
        return run.astype(np.int32)


def _place(text: str):
    """Where a text stands among those of its doc_id: the order is descending, and the smallest checksum comes first."""
    return F.lit((1 << 32) - 1) - F.crc32(F.col(text).cast("binary"))


def _runs(docs: DataFrame):
    """The runs, of about RUN_ROWS rows, and for each the first row (key, place) of the one after it, descending."""
    n = docs.count()
    m = min(n // RUN_ROWS, MAX_RUNS)
    runs = Runs([int(x) for x in docs.approxQuantile("k", [i / (m + 1) for i in range(1, m + 1)], min(ACCURACY, 0.2 / (m + 1)))] if m else [])

    @F.pandas_udf("int")
    def run_of(k: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(runs.of(k.to_numpy(), place.to_numpy()))

    tops = docs.groupBy(run_of("k", "place").alias("run")).agg(F.max(F.struct("k", "place")).alias("top")).orderBy("run").collect()
    heads: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(tops):  # the largest row of a run follows the smallest of the next run up; after the last comes the first
        heads.setdefault((r["top"]["k"], r["top"]["place"]), []).append(tops[(i + 1) % len(tops)]["run"])
    return runs, heads, len(tops)


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to the first as many (or all) of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likeness of both and of the next document's.

    The next document is that of the next smaller doc_id, after the smallest the largest; a lone document is its own.
    Equal doc_ids are ordered by checksum and text, a null doc_id is the smallest. A null text is empty, and two texts
    without signatures are alike (1.0). Extra columns are ignored. Texts cross the
    network once: the runs' bounds come from the keys alone, and the first rows of each run, which its neighbour needs,
    are sent to both. A doc_id of many rows is dealt to several runs by the checksums of its texts.
    """
    slim = docs.select(key_of("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("place", _place("text"))
    runs, heads, n_runs = _runs(slim.select("k", "place"))
    share = docs.sparkSession.sparkContext.broadcast((runs, heads))

    def deal(batches):
        runs, heads = share.value
        keys = np.array(sorted({k for k, _ in heads}), np.int64)
        for b in batches:
            k, place = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(runs.of(k, place)), pa.array(np.zeros(len(k), np.int8))], DEALT)
            also = [(i, r) for i in np.flatnonzero(np.isin(k, keys)).tolist() for r in heads.get((int(k[i]), int(place[i])), ())]
            if also:
                rows = b.take(pa.array([i for i, _ in also]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([r for _, r in also], pa.int32()), pa.array(np.ones(len(also), np.int8))], DEALT)

    def walk(batches):
        held, out = None, []
        for b in batches:
            for k, text, run, guest in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if held and held[2] == run:
                    if held[3]:
                        continue  # a second guest of the run
                    own = signatures(text)
                    out.append(_compare(held, (k, text, run, guest, own)))
                else:
                    own = signatures(text)
                held = (k, text, run, guest, own)
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    DEALT = ["k", "text", "place", "run", "guest"]
    dealt = bounded(slim).mapInArrow(deal, "k long, text string, place long, run int, guest byte").repartition(max(1, n_runs), "run")
    ordered = dealt.sortWithinPartitions("run", "guest", F.desc("k"), F.desc("place"), "text")
    found = ordered.mapInArrow(walk, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumn("doc_id", unkey("k")).select("doc_id", *found.columns[1:])


def _compare(row, following):
    k, text, _, _, own = row
    new = edited(text, following[1])
    other = own if new == text else signatures(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return k, len(text), sha, to_text(own), to_text(other), likeness(own, other), likeness(own, following[4])


def _batch(rows):
    names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)
