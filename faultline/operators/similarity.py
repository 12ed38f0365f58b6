"""Search for similar strings through a tree of bounds: blocks of strings made of the same characters, and blocks of blocks.

A node knows, for each character, the most that any string below it has of it, and the least and greatest length. From these
follows the best score that a string below could have, so whole blocks are passed over. Levels are joined from the
top down, and what is left of the blocks of strings is compared in batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Characters that bounds tell apart; all others count as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Strings of a block, and blocks of a node.
FAN = 64
#: Nodes of the top level up to which it is broadcast.
TOP_NODES = 4096
#: What a node says of the strings below it: most and fewest of each character, lengths, and the fewest kinds of characters.
SUMMARY = ("most", "fewest", "shortest", "longest", "kinds")
#: Score of two strings of which one holds the other; shares that the best part of a longer string counts, and from which lengths on.
PARTIAL = 0.82
PART, LONG_PART, PART_FROM, LONG_FROM = 0.9, 0.6, 1.5, 8.0
#: Characters that two strings have beyond each other, counted together, up to which `close` finds them; mentions from so many characters on can be settled by it.
CLOSE, CLOSE_FROM = 3, 3
_LESS = 1e-9


# --- scores of pairs ------------------------------------------------------------------------------------------------


class Strings:
    """Distinct strings of a batch as arrays: codes of characters, counts, lengths."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.length = np.array([len(s) for s in strings], np.int64)
        points = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")
        letters, codes = np.unique(points, return_inverse=True)
        self.letters = [chr(c) for c in letters.tolist()]
        self.size = len(letters)  # the code of no character at all
        row = np.repeat(np.arange(len(strings)), self.length)
        column = np.arange(len(points)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.codes = np.full((len(strings), int(self.length.max(initial=0)) + 1), self.size, np.int32)
        self.codes[row, column] = codes
        self.counts = np.zeros((len(strings), self.size), np.int32)
        np.add.at(self.counts, (row, codes), 1)
        self.masks = np.zeros((len(strings), self.size + 1), np.uint64)  # where each character is, of strings of up to 63
        short = column < 63
        np.bitwise_or.at(self.masks, (row[short], codes[short]), np.uint64(1) << column[short].astype(np.uint64))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many characters the strings of each pair have in common, whatever their order."""
        out = np.zeros(len(a), np.int64)
        for c in range(self.size):
            own = self.counts[:, c]
            out += np.minimum(own[a], own[b])
        return out

    def common(self, short: np.ndarray, long: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence of each short string (up to 63) and the part of the long one at start, all pairs a column at a time."""
        out = np.zeros(len(short), np.int64)
        for at in range(0, len(short), 1 << 17):
            s, l, b, w = (x[at : at + (1 << 17)] for x in (short, long, start, width))
            n, open_ = self.length[l], np.full(len(s), ~np.uint64(0))
            for j in range(int(w.max(initial=0))):
                place = b + j
                inside = (place >= 0) & (place < n) & (j < w)
                code = np.where(inside, self.codes[l, np.where(inside, place, 0)], self.size)
                met = open_ & self.masks[s, code]
                open_ = (open_ + met) | (open_ - met)
            whole = (np.uint64(1) << self.length[s].astype(np.uint64)) - np.uint64(1)
            out[at : at + (1 << 17)] = np.bitwise_count(~open_ & whole)
        return out


def common_length(x: str, y: str) -> int:
    """The length of the longest common subsequence, a bit for each character of x."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(x)) - 1
    open_ = whole
    for c in y:
        met = open_ & at.get(c, 0)
        open_ = ((open_ + met) | (open_ - met)) & whole
    return len(x) - open_.bit_count()


def weighted(x: str, y: str) -> float:
    """Twice the longest common subsequence over both lengths, or, where one string is much longer, that of its best part, which counts less."""
    if not x or not y:
        return 0.0
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    m, n = len(short), len(long)
    whole = 2 * common_length(short, long) / (m + n)
    if n < PART_FROM * m:
        return whole
    parts = [long[max(0, i) : i + m] for i in range(1 - m, n)]
    return max(whole, max(2 * common_length(short, p) / (m + len(p)) for p in parts) * (PART if n <= LONG_FROM * m else LONG_PART))


def _weighted_scores(t: Strings, a: np.ndarray, b: np.ndarray, met: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The weighted ratio of pairs that have `met` characters in common; below `least` a value may be too small."""
    swap = t.length[a] > t.length[b]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    m, n = t.length[short], t.length[long]
    parts = n >= PART_FROM * m
    weight = np.where(parts, np.where(n <= LONG_FROM * m, PART, LONG_PART), 0.0)
    out = np.zeros(len(a))
    worth = np.flatnonzero(np.maximum(2 * met / (m + n), weight * 2 * met / (m + np.maximum(met, 1))) >= least - _LESS)
    far = worth[m[worth] > 63]
    out[far] = [weighted(t.strings[i], t.strings[j]) for i, j in zip(a[far].tolist(), b[far].tolist())]
    worth = worth[m[worth] <= 63]
    out[worth] = 2 * t.common(short[worth], long[worth], np.zeros(len(worth), np.int64), n[worth]) / (m[worth] + n[worth])
    some = worth[parts[worth]]
    for at in range(0, len(some), 2048):
        own = some[at : at + 2048]
        k = n[own] + m[own] - 1
        ends = np.cumsum(k)
        pair = np.repeat(own, k)
        start = np.arange(int(ends[-1])) - np.repeat(ends - k, k) + 1 - m[pair]
        size = np.minimum(start + m[pair], n[pair]) - np.maximum(start, 0)
        ratio = 2 * t.common(short[pair], long[pair], start, m[pair]) / (m[pair] + size)
        out[own] = np.maximum(out[own], np.maximum.reduceat(ratio, ends - k) * weight[own])
    return out


def _kinds(s: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")))


@dataclass(frozen=True)
class Measure:
    """How near two strings are: `weighted` (see above), or `jaccard`, that of their sets of characters."""

    name: str

    def scores(self, t: Strings, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether one string holds the other) of pairs of different strings; scores below `least` may be too small."""
        if self.name == "jaccard":
            size, met = (t.counts > 0).sum(1), np.zeros(len(a), np.int64)
            for at in range(0, t.size, 64):
                bits = ((t.counts[:, at : at + 64] > 0).astype(np.uint64) << np.arange(min(64, t.size - at), dtype=np.uint64)).sum(1, dtype=np.uint64)
                met += np.bitwise_count(bits[a] & bits[b])
            out = met / np.maximum(size[a] + size[b] - met, 1)
        else:
            size, met = t.length, t.shared(a, b)
            out = np.zeros(len(a))
        held = np.zeros(len(a), bool)
        could = np.flatnonzero(met == np.minimum(size[a], size[b]))
        held[could] = [x in y or y in x for x, y in ((t.strings[i], t.strings[j]) for i, j in zip(a[could].tolist(), b[could].tolist()))]
        if self.name == "weighted":
            rest = np.flatnonzero(~held)
            out[rest] = _weighted_scores(t, a[rest], b[rest], met[rest], least[rest])
        return np.where(held, PARTIAL, out), held

    def bound(self, mention: Column, counts: Column, node: dict[str, Column]) -> Column:
        """The best score that a string below a node could have."""
        less = F.zip_with(counts, node["most"], lambda x, y: F.least(x, y))
        if self.name == "jaccard":  # the last count is that of all other characters
            less = F.transform(less, lambda x, i: F.when(i < len(ALPHABET), F.least(x, F.lit(1).cast("smallint"))).otherwise(x))
            own, least = _kinds(mention), node["kinds"]
        else:
            own, least = F.length(mention), node["shortest"]
        total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x.cast("int"))
        met = F.least(own, total(less))
        # what all strings below have beyond the mention's cannot be shared
        extra = F.zip_with(node["fewest"], counts, lambda y, x: F.when(y > x, 1 if self.name == "jaccard" else y - x).otherwise(0))
        if self.name == "jaccard":
            extra = F.transform(extra, lambda x, i: F.when((i < len(ALPHABET)) & (counts[i] == 0), x).otherwise(0))
        extra = total(extra)
        size = F.greatest(least, met + extra)
        held = F.when((met >= own) | (extra == 0) & (met >= least), PARTIAL).otherwise(0.0)
        if self.name == "jaccard":
            return F.greatest(met / (own + size - met), held)
        in_longer = F.when(node["longest"] >= PART_FROM * own, PART * 2.0 * met / (own + met)).otherwise(0.0)
        of_longer = F.when(own >= PART_FROM * least, PART * 2.0 * met / (size + met)).otherwise(0.0)
        return F.greatest(2.0 * met / (own + size), in_longer, of_longer, held)


JACCARD, WEIGHTED = Measure("jaccard"), Measure("weighted")


# --- the tree -------------------------------------------------------------------------------------------------------


def bag(s: Column) -> Column:
    """How often a string has each character of the alphabet, and how many others."""
    counts = [(F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("smallint") for c in ALPHABET]
    others = F.length(F.regexp_replace(s, f"[{ALPHABET}]+", "")).cast("smallint")
    return F.array(*counts, others)


@dataclass
class Index:
    """leaves: scope, node, keys (up to FAN). levels: scope, node, parent and SUMMARY, from the blocks of strings up. top: nodes of the last level."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: int


def _blocks(batches):
    """Blocks of a partition whose rows are in order, with their summaries."""
    from pyspark import TaskContext

    place = {c: i for i, c in enumerate(ALPHABET)}
    base, n, scope, keys = TaskContext.get().partitionId() << 32, 0, None, []

    def block():
        t = Strings(keys)
        counts = np.zeros((len(keys), len(ALPHABET) + 1), np.int64)
        for i, c in enumerate(t.letters):
            counts[:, place.get(c, len(ALPHABET))] += t.counts[:, i]
        one = [[scope], [base + n], [base + n >> 6], [list(keys)], [counts.max(0).tolist()], [counts.min(0).tolist()], [int(t.length.min())], [int(t.length.max())], [int((t.counts > 0).sum(1).min())]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int16()), pa.list_(pa.int16()), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, kinds)], ["scope", "node", "parent", "keys", *SUMMARY])

    for batch in batches:
        for own, key in zip(batch.column("scope").to_pylist(), batch.column("key").to_pylist()):
            if keys and (own != scope or len(keys) == FAN):
                yield block()
                n, keys = n + 1, []
            scope = own
            keys.append(key)
    if keys:
        yield block()


def build(strings: DataFrame) -> Index:
    """strings: scope, key, each once. Strings of a length and made of the same characters make a block, within a scope.

    Strings are range-partitioned by their length and how often they have each character (up to 9 times), those first that about half of all strings
    have; a partition's rows, in this order, are cut into blocks.
    """
    kept = cut(strings.where("key <> ''"))
    shares = kept.agg(*[F.avg(F.contains("key", F.lit(c)).cast("int")).alias(c) for c in ALPHABET]).first()
    order = sorted(ALPHABET, key=lambda c: (abs((shares[c] or 0.0) - 0.5), c))
    made_of = F.concat(*[F.least(F.length("key") - F.length(F.replace("key", F.lit(c), F.lit(""))), F.lit(9)).cast("string") for c in order])
    order = ["scope", "_length", "_made_of", "key"]
    dealt = kept.withColumns({"_length": F.length("key"), "_made_of": made_of}).repartitionByRange(*order).sortWithinPartitions(*order)
    summary = "most array<smallint>, fewest array<smallint>, shortest int, longest int, kinds int"
    leaves = cut(dealt.select("scope", "key").mapInArrow(_blocks, f"scope string, node long, parent long, keys array<string>, {summary}"))
    level = leaves.drop("keys")
    levels, now, count = [level], level.count(), None
    fold = lambda c, pick: F.aggregate(F.collect_list(c), F.first(c), lambda s, x: F.zip_with(s, x, lambda p, q: pick(p, q)))
    while now > FAN and now != count:
        up = level.groupBy("scope", F.col("parent").alias("node")).agg(
            fold("most", F.greatest).alias("most"), fold("fewest", F.least).alias("fewest"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"), F.min("kinds").alias("kinds")
        )
        level = cut(up.withColumn("parent", F.shiftright("node", 6)))
        levels.append(level)
        now, count = level.count(), now
    return Index(leaves.select("scope", "node", "keys"), levels, now)


def descend(wanted: DataFrame, index: Index, measure: Measure, beam: int | None = None) -> DataFrame:
    """The wanted rows (mention_key, scope, least and what else tells them apart), once for each block of their scope that can hold a string with the score `least`.

    Adds node, bound (the best score that it can hold) and sure (of both lengths, the share of characters that all its strings have in common with the mention).
    beam: of each level only the so many nodes of a wanted row that are surest to be like it are followed: a first look, in steps that grow with the rows alone.
    """
    own = [*wanted.columns]
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but work: not to be merged into fewer tasks
    front = wanted.repartition(n, "mention_key").withColumn("_bag", bag(F.col("mention_key")))
    for depth, level in enumerate(reversed(index.levels)):
        nodes = level.select("scope", F.col("node").alias("_node"), F.col("parent").alias("_at"), *[F.col(c).alias(f"_{c}") for c in SUMMARY])
        if depth:
            met = front.join(nodes, ["scope", "_at"]).drop("_at")
        else:
            nodes = nodes.drop("_at")
            met = front.join(F.broadcast(nodes) if index.top <= TOP_NODES else nodes, "scope")
        node = {c: F.col(f"_{c}") for c in SUMMARY}
        met = met.withColumn("bound", measure.bound(F.col("mention_key"), F.col("_bag"), node)).where(F.col("bound") >= F.col("least") - _LESS)
        in_all = F.aggregate(F.zip_with("_bag", "_fewest", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x.cast("int"))
        front = met.select(*own, "_bag", F.col("_node").alias("_at"), "bound", (in_all / (F.length("mention_key") + F.col("_longest"))).alias("sure"))
        if beam is not None:
            surest = Window.partitionBy(*own).orderBy(F.desc("sure"), F.desc("bound"), "_at")
            front = front.withColumn("_nth", F.row_number().over(surest)).where(F.col("_nth") <= beam).drop("_nth")
        if depth < len(index.levels) - 1:
            front = front.drop("bound", "sure")
    return front.select(*own, F.col("_at").alias("node"), "bound", "sure")


def compare(blocks: DataFrame, index: Index, measure: Measure) -> DataFrame:
    """mention_key, [other columns], key, score, match_type: the strings of the blocks that differ from mention_key and score `least` or more.

    blocks: rows of `descend`. A block that many rows look into is a key of a plain join, which Spark splits if it is skewed; no row
    holds more than a block.
    """
    others = [c for c in blocks.columns if c not in ("mention_key", "least", "node", "bound", "sure")]
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _scored(blocks.join(index.leaves, ["scope", "node"]).select("mention_key", "least", *others, "keys").repartition(n, "mention_key", F.hash(F.col("keys"))), measure)


def _scored(rows: DataFrame, measure: Measure) -> DataFrame:
    """rows: mention_key, least, keys and what else goes along; the keys that score `least` or more, each with its score."""
    others = [c for c in rows.columns if c not in ("mention_key", "least", "keys")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = part.column("keys")
                sizes = np.array(keys.value_lengths(), np.int64)
                row = np.repeat(np.arange(part.num_rows), sizes)
                mentions, flat = part.column("mention_key").to_pylist(), keys.flatten().to_pylist()
                place: dict[str, int] = {}
                a = np.array([place.setdefault(s, len(place)) for s in mentions], np.int64)[row]
                b = np.array([place.setdefault(s, len(place)) for s in flat], np.int64)
                pairs = np.flatnonzero(a != b)
                row, a, b = row[pairs], a[pairs], b[pairs]
                if not len(row):
                    continue
                least = part.column("least").to_numpy()[row]
                score, held = measure.scores(Strings(list(place)), a, b, least)
                good = np.flatnonzero(score >= least)
                taken = pa.array(row[good])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(taken) for c in ("mention_key", *others)), pa.array(flat, pa.string()).take(pa.array(pairs[good])), pa.array(score[good]), pa.array(np.where(held[good], "partial", "fuzzy"), pa.string())],
                    ["mention_key", *others, "key", "score", "match_type"],
                )

    kinds = dict(rows.dtypes)
    schema = "mention_key string, " + "".join(f"{c} {kinds[c]}, " for c in others) + "key string, score double, match_type string"
    return rows.mapInArrow(run, schema)


def _without(s: Column, k: Column) -> Column:
    """What is left of a string without k of its characters (0 to CLOSE), in every way, each once."""
    one = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    left, out = F.array(s), F.when(k == 0, F.array(s))
    for n in range(1, CLOSE + 1):
        left = F.array_distinct(F.flatten(F.transform(left, one)))
        out = out.when(k == n, left)
    return out


def close(wanted: DataFrame, strings: DataFrame, measure: Measure, apart: int = CLOSE) -> DataFrame:
    """As `search`, for strings that become equal by leaving out `apart` characters (CLOSE at most) of both together: an equi-join of what is left of them.

    strings: scope, key, each once. How many characters go on each side follows from the two lengths, so a string is
    spelt out only for lengths that are wanted. By the weighted ratio every other string scores `beyond(length, apart)` at most.
    """
    own = [*wanted.columns]
    m, n = F.length("mention_key"), F.length("key")
    lengths = wanted.select("scope", m.alias("m")).distinct().join(strings.select("scope", n.alias("n")).distinct(), "scope")
    more = F.col("n") - F.col("m")
    both = apart - F.pmod(apart - more, F.lit(2))
    lengths = lengths.where(F.abs(more) <= apart).select("scope", "m", "n", ((both - more) / 2).cast("int").alias("_less"), ((both + more) / 2).cast("int").alias("less"))
    lengths = F.broadcast(cut(lengths))  # pairs of lengths, a few for each length that is wanted
    left = wanted.withColumn("m", m).join(lengths, ["scope", "m"]).select(*own, "n", "less", F.explode(_without(F.col("mention_key"), F.col("_less"))).alias("rest"))
    right = strings.withColumn("n", n).join(lengths.select("scope", "n", "less").distinct(), ["scope", "n"]).select("scope", "key", "n", "less", F.explode(_without(F.col("key"), F.col("less"))).alias("rest"))
    met = left.join(right.hint("merge"), ["scope", "n", "less", "rest"]).where("mention_key <> key").select(*own, "key").distinct()
    count = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as in `descend`
    return _scored(met.repartition(count, "mention_key", "key").select(*own, F.array("key").alias("keys")), measure)


def beyond(length: Column, apart: int = CLOSE) -> Column:
    """The most that a string which `close` does not find can score by the weighted ratio with one of this length.

    One that holds the other scores PARTIAL. Of a much longer one, that does not hold it, the best part lacks a character at least: m - 1 of m
    characters, at an end where the part is as short; m is the length of the shorter string, so at most this one.
    """
    part = PART * (2.0 * length - 2) / (2.0 * length - 1)
    return F.greatest(F.lit(PARTIAL), part, 2.0 * length / (2.0 * length + apart + 1)) + _LESS


def settles(length: Column, apart: int) -> Column:
    """Whether strings `apart` characters away can score more, with one of this length, than all that `close` does not find."""
    return (length >= CLOSE_FROM) & (2.0 * length / (2.0 * length + apart) > beyond(length, apart))


def search(wanted: DataFrame, index: Index, measure: Measure) -> DataFrame:
    """All strings of its scope that differ from a wanted row's mention_key and score its `least` or more: see `compare`."""
    return compare(descend(wanted, index, measure), index, measure)
