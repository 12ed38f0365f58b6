"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, free_name, key_of, map_arrow, unkey, written
from .components import components

#: Words of a shingle; two documents are linked if DENOMINATOR * intersection >= NUMERATOR * union.
WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Sorted orders of the forest and signature values in the key of each.
TREES, DEPTH = 16, 8
#: Values two neighbours of an order must share from its start to be candidates.
LEAST_PREFIX = 2
#: Neighbours after a document, in each order, that it can be held against.
NEIGHBOURS = 6
#: Candidates whose signatures agree less than this are dropped: five standard deviations below the threshold.
LEAST_AGREEMENT = 0.55
#: Candidates between two groups that the second round of confirmation tries.
TRIED = 2
#: Rows of one ordered partition of the forest, about.
PARTITION_ROWS = 250_000
#: Rows of one side of a block in which all pairs of a crowded region are compared; columns of its tables at a time.
BLOCK_ROWS, COLUMNS = 512, 4096

VALUES = TREES * DEPTH
#: Values that two candidates share at least; of any VALUES - OVERLAP + 1 values of one, in an order for all, the other has one among its own.
OVERLAP = math.ceil(LEAST_AGREEMENT * VALUES)
PREFIX = VALUES - OVERLAP + 1
_U = np.uint64


class WordHashes(dict):
    """Word to 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_HASHES = WordHashes()
_RANDOM = np.random.default_rng(7_919).integers(1, 2**63, size=(2, VALUES), dtype=np.uint64)
_RANDOM[0] |= _U(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of 64-bit hashes of the text's 5-word shingles, sorted; with fewer words, of all its words as one.

    A-Z are lower-cased; words are divided by spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, _U)
    for i in range(width):
        out = (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9) + h[i : i + n]
    out = (out ^ (out >> _U(32))) * _U(0x94D049BB133111EB)
    return np.unique(out ^ (out >> _U(31)))


def signature(found: np.ndarray) -> np.ndarray:
    """VALUES minima of the set under as many hash functions, 32 bits of each."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, _U)
    for a in range(0, len(found), 512):
        least = np.minimum(least, (found[a : a + 512, None] * _RANDOM[0] + _RANDOM[1]).min(axis=0))
    return (least >> _U(32)).astype(np.uint32)


def set_hash(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exactly whether the two sorted sets reach the threshold; sizes alone may rule it out."""
    small, large = sorted((len(a), len(b)))
    if DENOMINATOR * small < NUMERATOR * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def _sign(batch):
    out = {"k": batch.column("k"), "n": [], "s": [], "sig": []}
    seen: dict[int, None] = {}
    for text in batch.column("text").to_pylist():
        found = shingles(text)
        s = set_hash(found) if len(found) else None
        out["n"].append(len(found))
        out["s"].append(s)
        # of equal sets in a batch, one carries the signature
        out["sig"].append(signature(found).astype(">u4").tobytes() if s is not None and s not in seen else None)
        seen[s] = None
    return out | {"n": pa.array(out["n"], pa.int64()), "s": pa.array(out["s"], pa.int64()), "sig": pa.array(out["sig"], pa.binary())}


def _plant(batch):
    """A row for each order of each class: the signature's own part of it, as bytes that sort like the values."""
    s = batch.column("s").to_numpy(zero_copy_only=False)
    width = DEPTH * 4
    keys = [sig[a : a + width] for sig in batch.column("sig").to_pylist() for a in range(0, TREES * width, width)]
    return {"t": np.tile(np.arange(TREES, dtype=np.int32), len(s)), "key": pa.array(keys, pa.binary()), "s": np.repeat(s, TREES)}


def _regions(t: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row and depth from LEAST_PREFIX the number of its region, rows with that much of a prefix in common.

    A region too large to be compared whole gives each row a number of its own: it is left to deeper prefixes, and
    what they leave to `_crowds`.
    """
    n = len(t)
    out = np.zeros((n, DEPTH - LEAST_PREFIX + 1), np.int64)
    same = np.concatenate([[False], t[1:] == t[:-1]])
    for d in range(DEPTH):
        same[1:] &= key[1:, d] == key[:-1, d]
        if d + 1 >= LEAST_PREFIX:
            run = np.cumsum(~same)
            large = np.bincount(run)[run] > NEIGHBOURS + 1
            out[:, d + 1 - LEAST_PREFIX] = np.where(large, -np.arange(1, n + 1), run)
    return out


def _neighbours(batches):
    """Pairs of neighbours in an order, rows coming sorted; the last rows of a batch go on to the next one.

    Rows next to each other are a pair if they share LEAST_PREFIX values. Farther ones are if at some depth they lie
    in one region of no more than NEIGHBOURS + 1 rows, so the depth adapts to how crowded each region is.
    """
    held = None
    for b in batches:
        t = b.column(0).to_numpy(zero_copy_only=False)
        s = b.column(2).to_numpy(zero_copy_only=False)
        key = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").reshape(-1, DEPTH)
        fresh = 0
        if held is not None:
            fresh = len(held[0])
            t, key, s = np.concatenate([held[0], t]), np.concatenate([held[1], key]), np.concatenate([held[2], s])
        found = []
        region = _regions(t, key)
        for o in range(1, NEIGHBOURS + 1):
            if len(t) <= o:
                break
            shared = (t[o:] == t[:-o]) & (key[o:, :LEAST_PREFIX] == key[:-o, :LEAST_PREFIX]).all(axis=1)
            if o > 1:
                shared &= (region[o:] == region[:-o]).any(axis=1)
            i = np.flatnonzero(shared)
            i = i[i + o >= fresh]
            found.append(np.stack([s[i], s[i + o]]))
        held = t[-NEIGHBOURS:], key[-NEIGHBOURS:], s[-NEIGHBOURS:]
        if found:
            a, c = np.concatenate(found, axis=1)
            pairs = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs a < b of set classes, with the share of signature values they have in common.

    Each order of the forest is a run of its own in one range-partitioned sort by (tree, key, class); no partition
    holds a group because of its size, and a pair lost where two partitions meet is met again in the other orders.
    """
    n = classes.count()
    planted = map_arrow(classes.select("s", "sig"), _plant, "t int, key binary, s long")
    parts = max(1, n * TREES // PARTITION_ROWS)
    ordered = planted.repartitionByRange(parts, "t", "key", "s").sortWithinPartitions("t", "key", "s")
    pairs = ordered.mapInArrow(_neighbours, "a long, b long").distinct()
    sig = classes.select("s", "sig")
    both = pairs.join(sig.select(F.col("s").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("s").alias("b"), F.col("sig").alias("y")), "b")

    def agree(batch):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, VALUES) for c in ("x", "y"))
        share = (x == y).mean(axis=1)
        keep = np.flatnonzero(share >= LEAST_AGREEMENT)
        take = pa.array(keep)
        return {"a": batch.column("a").take(take), "b": batch.column("b").take(take), "share": share[keep].astype(np.float32)}

    return map_arrow(both.select("a", "b", "x", "y"), agree, "a long, b long, share float")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with whether their full sets are linked."""

    def run(batch):
        x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
        ok = [linked(np.frombuffer(p, _U), np.frombuffer(q, _U)) for p, q in zip(x, y)]
        return {"a": batch.column("a"), "b": batch.column("b"), "ok": pa.array(ok, pa.bool_())}

    both = pairs.select("a", "b").join(sets.select(F.col("s").alias("a"), F.col("full").alias("x")), "a")
    both = both.join(sets.select(F.col("s").alias("b"), F.col("full").alias("y")), "b")
    return written(map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long, ok boolean"))


def _open(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates that join two groups, with the groups."""
    ca, cb = (groups.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    named = edges.join(ca, "a", "left").join(cb, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return named.where("ca <> cb")


def _joined(edges: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """v and c (the smallest class its links reach) of the classes with links, after three rounds of confirmation; the links.

    First each class with the partner it agrees with most; then, between any two groups not yet joined, the TRIED
    best; then every candidate that still joins two groups. Links within a group would change nothing.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
    tried = _confirm(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets)
    links = tried.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
    groups = components(links)
    edges = written(_open(edges, groups).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    nth = F.row_number().over(Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.desc("share"), "a", "b"))
    first, tried = tried, _confirm(edges.withColumn("nth", nth).where(F.col("nth") <= TRIED), sets)
    ties = groups.select(F.col("v").alias("u"), F.col("c").alias("v"))
    groups = components(ties.unionByName(tried.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))))
    left = _open(edges.select("a", "b", "share"), groups).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    third = _confirm(left, sets)
    last = third.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = first.unionByName(tried).unionByName(third).where("ok").select("a", "b")
    return components(groups.select(F.col("v").alias("u"), F.col("c").alias("v")).unionByName(last)), links


def _heads(batch):
    """A row for each order of each class: the values that a region's rows have in common."""
    s = batch.column("s").to_numpy(zero_copy_only=False)
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(s), TREES, DEPTH)
    p = np.ascontiguousarray(sig[:, :, :LEAST_PREFIX]).view(np.int64).reshape(-1)
    c = batch.column("c").to_numpy(zero_copy_only=False)
    return {"t": np.tile(np.arange(TREES, dtype=np.int32), len(s)), "p": p, "s": np.repeat(s, TREES), "c": np.repeat(c, TREES)}


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))


def _mixed(rows: DataFrame, by: list[str], above: int = 1) -> DataFrame:
    """The keys that more than `above` rows have, not all of one group c: main, most and rest (see `_crowded`)."""
    kinds = rows.groupBy(*by, "c").agg(F.count("*").alias("n")).groupBy(*by)
    found = kinds.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("c", F.struct("n", "c")).alias("main"))
    return written(found.where((F.col("n") > above) & (F.col("n") > F.col("most"))).withColumn("rest", F.col("n") - F.col("most")).drop("n"))


def _crowded(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (t, p, salt, s, c) of the regions too large for the forest whose rows are not all of one group c.

    With them the region's largest group (main), and how many rows are of it (most) and of others (rest).
    """
    named = classes.select("s", "sig").join(groups.select(F.col("v").alias("s"), "c"), "s", "left").withColumn("c", F.coalesce("c", "s"))
    rows = map_arrow(named.select("s", "sig", "c"), _heads, "t int, p long, s long, c long")
    salted = _salted(_mixed(rows, ["t", "p"], NEIGHBOURS + 1))
    return written(rows.withColumn("salt", F.pmod("s", F.lit(8)).cast("int")).join(salted, ["t", "p", "salt"]))


def _tokens(batch):
    """A row for each value of each signature: its place and itself as one number."""
    s = batch.column("s").to_numpy(zero_copy_only=False)
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u4").reshape(len(s), VALUES)
    token = (np.arange(VALUES, dtype=np.int64) << 32) | sig.astype(np.int64)
    return {"token": token.reshape(-1), "s": np.repeat(s, VALUES), "c": np.repeat(batch.column("c").to_numpy(zero_copy_only=False), VALUES)}


def _postings(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (token, salt, s, c) of the crowded classes s: under each of its PREFIX signature values that fewest other groups' rows have, where one has the same.

    Candidates share OVERLAP values, so these of one hold one of these of the other: they meet whatever passage
    their region has in common, and rows that have little more than that in common do not. With them the value's largest
    group (main), and how many rows are of it (most) and of others (rest).
    """
    one = rows.select("s", "c").distinct().join(classes.select("s", "sig"), "s")
    every = written(map_arrow(one.select("s", "sig", "c"), _tokens, "token long, s long, c long"))
    spread = every.withColumn("salt", F.pmod("s", F.lit(8)).cast("int"))
    # a value that one group alone has comes before all others and meets nothing: it only takes up its place
    shared = _salted(_mixed(every, ["token"]).drop("main"))
    by_row = Window.partitionBy("s")
    ranked = spread.join(shared, ["token", "salt"]).withColumns({"nth": F.row_number().over(by_row.orderBy("rest", "most", "token")), "of": F.count("*").over(by_row)})
    kept = written(ranked.where(F.col("nth") <= F.col("of") - (VALUES - PREFIX)).select("token", "salt", "s", "c"))
    return kept.join(_salted(_mixed(kept, ["token"])), ["token", "salt"])


def _blocks(rows: DataFrame) -> DataFrame:
    """Deals the rows under each token to blocks (u, side, s, c): any two of different groups meet in one.

    Rows outside the main group are held against each other and against the main group, BLOCK_ROWS or so a side.
    side: 0 and 1 are held against each other, 2 is on both sides.
    """
    i = F.pmod(F.xxhash64("s"), F.col("own"))
    x = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    y = F.sequence(F.lit(0).cast("long"), F.col("mains") - 1)
    cell = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    within = F.transform(x, lambda j: cell(0, F.least(F.col("i"), j), F.greatest(F.col("i"), j), F.when(F.col("i") == j, 2).when(F.col("i") < j, 0).otherwise(1)))
    beside = F.transform(y, lambda j: cell(1, F.col("i"), j, F.lit(0)))
    facing = F.transform(x, lambda j: cell(1, j, F.col("i"), F.lit(1)))
    is_main = F.col("c") == F.col("main")
    sized = rows.withColumns({"others": F.ceil(F.col("rest") / BLOCK_ROWS), "mains": F.ceil(F.col("most") / BLOCK_ROWS)})
    sized = sized.withColumn("own", F.when(is_main, F.col("mains")).otherwise(F.col("others"))).withColumn("i", i)
    cells = sized.select("token", "s", "c", F.explode(F.when(is_main, facing).otherwise(F.concat(within, beside))).alias("x"))
    return cells.select(F.xxhash64("token", "x.kind", "x.a", "x.b").alias("u"), F.col("x.side").alias("side"), "s", "c")


def _each_block(batches):
    """The rows of each block as a table, from batches in which they come one after another."""
    held, now = [], None
    for b in batches:
        u = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist(), len(u)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if held and u[start] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = u[start]
            held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _sides(block: pa.Table):
    side, c = block["side"].to_numpy(), block["c"].to_numpy()
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0), c


def _alive(batches):
    """The rows of each block that have a candidate of another group on the other side."""
    for block in _each_block(batches):
        left, right, c = _sides(block)
        sig = np.frombuffer(b"".join(block["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
        x, y = np.ascontiguousarray(sig[left].T), np.ascontiguousarray(sig[right].T)
        same = np.zeros((len(left), len(right)), np.uint8)
        for v in range(VALUES):
            same += x[v][:, None] == y[v]
        near = (same >= LEAST_AGREEMENT * VALUES) & (c[left][:, None] != c[right])
        keep = np.zeros(len(c), bool)
        keep[left[near.any(axis=1)]] = True
        keep[right[near.any(axis=0)]] = True
        if keep.any():
            yield from block.select(["u", "side", "s", "c"]).filter(pa.array(keep)).combine_chunks().to_batches()


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set of the left shares with each of the right, exactly."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = (np.concatenate(x) if x else np.zeros(0, _U) for x in (left, right))
    both = np.intersect1d(a, b)
    rows, cols = [], []
    for sets, flat in ((left, a), (right, b)):
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit]
        order = np.argsort(at[hit], kind="stable")
        rows.append(row[order])
        cols.append(at[hit][order])
    for start in range(0, len(both), COLUMNS):
        dense = []
        for row, col, n in zip(rows, cols, out.shape):
            lo, hi = np.searchsorted(col, [start, start + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(both) - start)), np.float32)
            m[row[lo:hi], col[lo:hi] - start] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _block_links(batches):
    """Groups that links between rows of a block join: each with the smallest group it reaches there."""
    for block in _each_block(batches):
        left, right, c = _sides(block)
        full = [np.frombuffer(x, _U) for x in block["full"].to_pylist()]
        n = np.array([len(x) for x in full])
        common = in_common([full[i] for i in left], [full[i] for i in right])
        link = DENOMINATOR * common >= NUMERATOR * (n[left][:, None] + n[right] - common)
        link &= c[left][:, None] != c[right]
        if not link.any():
            continue
        i, j = np.nonzero(link)
        ends, at = np.unique(np.concatenate([c[left][i], c[right][j]]), return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        least, before = np.arange(len(ends)), None
        while before is None or (least != before).any():
            before = least.copy()
            np.minimum.at(least, a, before[b])
            np.minimum.at(least, b, before[a])
            least = least[least]
        yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(ends[least])], ["u", "v"])


def _hub_links(rows: DataFrame, links: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the rows of a crowded region and the one among them that has most links already."""
    degree = links.select(F.explode(F.array("a", "b")).alias("s")).groupBy("s").agg(F.count("*").alias("links"))
    ranked = rows.join(degree, "s", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    hubs = ranked.groupBy("t", "p").agg(F.max_by(F.struct("s", "c"), F.struct("links", "s")).alias("h"))
    pairs = rows.join(_salted(hubs), ["t", "p", "salt"]).where("c <> h.c").select("s", "salt", F.col("h.s").alias("h")).distinct()
    pairs = written(pairs)
    sig = classes.select("s", F.col("sig").alias("x"))
    wide = pairs.join(sig, "s").join(_salted(pairs.select(F.col("h").alias("s")).distinct().join(sig, "s").select(F.col("s").alias("h"), F.col("x").alias("y"))), ["h", "salt"])

    def agree(batch):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, VALUES) for c in ("x", "y"))
        take = pa.array(np.flatnonzero((x == y).mean(axis=1) >= LEAST_AGREEMENT))
        return {c: batch.column(c).take(take) for c in ("s", "h", "salt")}

    near = written(map_arrow(wide.select("s", "h", "salt", "x", "y"), agree, "s long, h long, salt int"))
    sets = _full_sets(docs, classes, near.select("s").unionByName(near.select(F.col("h").alias("s"))).distinct())
    held = _salted(near.select(F.col("h").alias("s")).distinct().join(sets, "s").select(F.col("s").alias("h"), F.col("full").alias("y")))

    def run(batch):
        x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
        keep = pa.array([i for i, (p, q) in enumerate(zip(x, y)) if linked(np.frombuffer(p, _U), np.frombuffer(q, _U))], pa.int64())
        return {"u": batch.column("s").take(keep), "v": batch.column("h").take(keep)}

    both = near.join(sets.withColumnRenamed("full", "x"), "s").join(held, ["h", "salt"])
    return map_arrow(both.select("s", "h", "x", "y"), run, "u long, v long")


def _crowds(docs: DataFrame, classes: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups after every candidate pair of rows of different groups in crowded regions has been held against each other.

    First each row meets its region's hub, so that copies of one text become one group before the rest are compared.
    Then rows meet under their rarest signature values, not in their region, which the square of its size would cost.
    They are compared by signature; those with a candidate left, in whole blocks, by their full sets.
    """
    rows = _crowded(classes, groups)
    if rows.isEmpty():
        return groups
    ties = groups.select(F.col("v").alias("u"), F.col("c").alias("v"))
    groups = components(ties.unionByName(_hub_links(rows, links, docs, classes)))
    cells = _blocks(_postings(_crowded(classes, groups), classes)).join(classes.select("s", "sig"), "s").select("u", "side", "s", "c", "sig")
    alive = written(bounded(cells).repartition("u").sortWithinPartitions("u").mapInArrow(_alive, "u long, side int, s long, c long"))
    if alive.isEmpty():
        return groups
    sets = _full_sets(docs, classes, alive.select("s").distinct())
    whole = alive.join(sets, "s").select("u", "side", "s", "c", "full").repartition("u").sortWithinPartitions("u")
    found = whole.mapInArrow(_block_links, "u long, v long")
    return components(groups.select(F.col("v").alias("u"), F.col("c").alias("v")).unionByName(found))


def _full_sets(docs: DataFrame, classes: DataFrame, ends: DataFrame) -> DataFrame:
    """s and its full set, for the classes s of `ends`, from the text of one document of each."""
    wanted = ends.join(classes.select("s", "k"), "s")

    def full(batch):
        want, s, found = batch.column("want").to_pylist(), [], []
        for text, w in zip(batch.column("text").to_pylist(), want):
            own = shingles(text)
            if len(own) and (h := set_hash(own)) in w:
                s.append(h)
                found.append(own.tobytes())
        return {"s": pa.array(s, pa.int64()), "full": pa.array(found, pa.binary())}

    texts = docs.select("k", "text").join(wanted.groupBy("k").agg(F.collect_list("s").alias("want")), "k")
    return written(map_arrow(texts, full, "s long, full binary").dropDuplicates(["s"]))


def near_groups(docs: DataFrame) -> DataFrame:
    """k, n (shingles) and root (the smallest k reachable over links; of an empty set, k itself) of documents k, text.

    Documents with equal sets are one class. Candidates of the forest are confirmed on full sets, best first, until
    none is left that would join two groups; then those of regions that are too crowded for the forest.
    """
    signed = written(map_arrow(docs.select("k", "text"), _sign, "k long, n long, s long, sig binary"))
    classes = written(signed.where("s is not null").groupBy("s").agg(F.min("k").alias("k"), F.max("sig").alias("sig")))
    edges = written(candidates(classes))
    ends = edges.select(F.col("a").alias("s")).unionByName(edges.select(F.col("b").alias("s"))).distinct()
    groups, links = _joined(edges, _full_sets(docs, classes, ends))
    groups = _crowds(docs, classes, groups, links)
    of_class = classes.select("s", "k").join(groups.select(F.col("v").alias("s"), "c"), "s", "left").withColumn("c", F.coalesce("c", "s"))
    roots = of_class.groupBy("c").agg(F.min("k").alias("root"))
    found = of_class.join(roots, "c").select("s", "root")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = signed.select("k", "n", "s", F.pmod("k", F.lit(8)).cast("int").alias("salt"))
    return rows.join(salted, ["s", "salt"], "left").select("k", "n", F.coalesce("root", "k").alias("root"))


def group_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A null text has no shingles and no links; a text of fewer than five words is one shingle. Rows that share a doc_id
    are one node for its links when their sets are equal and else stand in their own groups; a null doc_id counts as
    the smallest and gives a null component_id. An empty table gives an empty result; extra columns are ignored.
    """
    found = near_groups(docs.select(key_of("doc_id").alias("k"), "text"))
    return found.select(unkey("k").alias("doc_id"), F.col("n").alias("n_shingles"), unkey("root").alias("component_id"), (F.col("k") == F.col("root")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stand for their groups, with all their columns; documents without words stay.

    Rows that share a doc_id stay or go together.
    """
    k = free_name(docs, "k")
    keyed = docs.withColumn(k, key_of("doc_id"))
    gone = near_groups(keyed.select(F.col(k).alias("k"), "text")).where("k <> root").select(F.col("k").alias(k)).distinct()
    return keyed.join(gone, k, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
