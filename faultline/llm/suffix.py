"""Repeated passages: anchored blocks of text, sorted by a two-stage suffix sort, compared by adjacent common prefixes.

A passage is a byte string of LENGTH bytes, a window. Each window of a text is filed under its anchor, the K bytes in
it whose hash is smallest (rightmost on ties), so equal windows share the anchor and their place beside it. Neighbouring
windows with the same anchor are one block of text. Blocks whose anchor occurs once in the corpus hold no repeat;
those equal to an earlier block are repeats throughout; what is left, the first of each differing block of a shared
anchor, is suffix-sorted with the others of its anchor, and windows with a common prefix of LENGTH are the same.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, key_of, map_arrow, materialize, unkey

#: Bytes of a passage that counts as repeated.
LENGTH = 100
#: Bytes of an anchor (a power of two); a longer one is shared by chance less often, but there are more blocks.
K = 32
#: Anchors within a window.
SPAN = LENGTH - K + 1
#: Bytes worked on at once: of documents, of blocks to be sorted.
TEXT_BYTES, SORT_BYTES = 1 << 18, 1 << 20
#: An anchor with more differing blocks than this is split by the hash of each window.
SPLIT_BLOCKS = 4096

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOW = _U((1 << 24) - 1)
_BYTE_HASH = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") | 1 for b in range(256)], _U)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * TEXT_BYTES)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, x % 2**64, _U)])) for x in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def blocks_of(data: np.ndarray, lengths: np.ndarray):
    """(text, start in data, windows, anchor hash, block hash) of the blocks of texts that lie one after another in data."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < LENGTH:
        return empty
    byte = _BYTE_HASH[data]
    h, width, power = byte, 1, _BASE
    while width < K:
        h = h[:-width] * _U(power) + h[width:]
        power, width = power * power % 2**64, width * 2
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    least = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=_U))
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    anchor = (_LOW - (least & _LOW)).astype(np.int64)
    ends = np.cumsum(lengths)
    inside = np.repeat(ends, lengths)[: len(anchor)] >= np.arange(LENGTH, len(anchor) + LENGTH)
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    own = anchor[at]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    start, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    n = last - start + 1
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(byte * up[: len(data)])])
    block = (sums[start + n + LENGTH - 1] - sums[start]) * down[start]
    block = (block ^ (block >> _U(31)) ^ (n.astype(_U) << _U(50))) * _U(0x94D049BB133111EB)
    block ^= block >> _U(29)
    return np.searchsorted(ends, start, side="right"), start, n, h[anchor[start]].view(np.int64), block.view(np.int64)


def tag_of(raw: bytes) -> int:
    """Tells texts with the same doc_id apart, 25 bits."""
    return zlib.crc32(raw) >> 7


def _blocks_of_batch(keys: list[int], raws: list[bytes]):
    """Columns k, tag, start in the text, windows, anchor and block hash, ordered by k, tag and start."""
    tags = [tag_of(r) for r in raws]
    order = sorted(range(len(keys)), key=lambda i: (keys[i], tags[i]))
    found: list[tuple] = []

    def run(group):
        data = np.frombuffer(b"".join(raws[i][a:b] for i, a, b in group), np.uint8)
        lengths = np.array([b - a for _, a, b in group], np.int64)
        text, start, n, anchor, block = blocks_of(data, lengths)
        if len(text):
            firsts = np.cumsum(lengths) - lengths
            begin = np.array([a for _, a, _ in group], np.int64)
            own = np.array([i for i, _, _ in group], np.int64)[text]
            found.append((own, start - firsts[text] + begin[text], n, anchor, block))

    group, size = [], 0
    for i in order:
        n = len(raws[i])
        for a in range(0, max(1, n - LENGTH + 1), TEXT_BYTES) if n >= LENGTH else ():
            b = min(n, a + TEXT_BYTES + LENGTH - 1)
            group.append((i, a, b))
            size += b - a
            if size >= TEXT_BYTES:
                run(group)
                group, size = [], 0
    if group:
        run(group)
    if not found:
        return None
    own, start, n, anchor, block = (np.concatenate(x) for x in zip(*found))
    return np.array(keys, np.int64)[own], np.array(tags, np.int64)[own], start, n, anchor, block


def _again(anchor: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Whether a block has come before, in this batch."""
    both = anchor ^ (block * np.int64(0x2545F4914F6CDD1D))
    order = np.argsort(both, kind="stable")
    again = np.zeros(len(both), bool)
    again[order[1:]] = both[order[1:]] == both[order[:-1]]
    return again


def _first_blocks(batch):
    """The first of each block in the batch; tag, start and windows in one number that keeps their order."""
    found = _blocks_of_batch(batch.column("k").to_pylist(), batch.column("raw").to_pylist())
    if found is None:
        return None
    k, tag, start, n, anchor, block = found
    new = ~_again(anchor, block)
    place = (tag << 38) | (start << 7) | n
    return {"anchor": anchor[new], "block": block[new], "k": k[new], "place": place[new]}


def _later_blocks(batch):
    """The blocks that the batch has had before, as runs of windows."""
    found = _blocks_of_batch(batch.column("k").to_pylist(), batch.column("raw").to_pylist())
    if found is None:
        return None
    k, tag, start, n, anchor, block = found
    k, tag, start, n = (x[_again(anchor, block)] for x in (k, tag, start, n))
    return _joined(k, tag, start, n) if len(k) else None


def _joined(k, tag, start, n):
    """Runs of windows that adjoin become one."""
    cut = np.flatnonzero((k[1:] != k[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + n[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(k) - 1]])
    return {"k": k[first], "tag": tag[first].astype(np.int32), "start": start[first].astype(np.int32), "n": (start[last] + n[last] - start[first]).astype(np.int32)}


def two_stage_sort(data: np.ndarray, need: np.ndarray, depth: int) -> np.ndarray:
    """The needed suffixes of data in the order of their first `depth` bytes, ties side by side.

    data ends in a 0 that is smaller than any other byte. Only needed suffixes smaller than their successors are
    compared; the others follow from a scan of the buckets in ascending order: when bucket c is complete, the larger
    suffixes just before its members take the next places of their own buckets. The successor of a needed suffix that
    is not smaller than it must be needed too.
    """
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = 1
    ahead = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    smaller = step[ahead] > 0
    direct = np.flatnonzero(need & smaller)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    width = -(-depth // 8)
    padded = np.concatenate([padded, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def word(positions, i):
        return np.ascontiguousarray(words[np.minimum(positions + 8 * i, n + depth - 8)]).view(">u8").ravel().astype(np.uint64)

    order = direct[np.argsort(word(direct, 0), kind="stable")]
    key = word(order, 0)
    same = np.concatenate([[False], key[1:] == key[:-1]]) if len(order) else np.zeros(0, bool)
    for i in range(1, width):
        if not same.any():
            break
        tied = same | np.concatenate([same[1:], [False]])
        where = np.flatnonzero(tied)
        group = np.cumsum(~same[where])
        key = word(order[where], i)
        local = np.lexsort((key, group))
        order[where] = order[where][local]
        key, group = key[local], group[local]
        same[where] = np.concatenate([[False], (key[1:] == key[:-1]) & (group[1:] == group[:-1])])
    larger = need & ~smaller
    firsts = np.searchsorted(data[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(data[need], minlength=256)).tolist():
        bucket = []
        now = np.concatenate(waiting[c]) if waiting[c] else order[:0]
        while len(now):
            bucket.append(now)
            before = now[now > 0] - 1
            now = before[larger[before] & (data[before] == c)]
        bucket.append(order[firsts[c] : firsts[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[larger[before] & (data[before] > c)]
        if len(before):
            chars = data[before]
            local = np.argsort(chars, kind="stable")
            before, chars = before[local], chars[local]
            cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
            for part in np.split(before, cuts):
                waiting[data[part[0]]].append(part)
    return np.concatenate(out) if out else order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it, at most `most` bytes; of the first: 0."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(most, np.uint8)]), most)
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 15):
        b = min(len(order), a + (1 << 15))
        both = rows[order[a - 1 : b]]
        differs = both[1:] != both[:-1]
        out[a:b] = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
    return out


def repeated_windows(k, tag, start, texts: list[bytes]):
    """Of blocks that start in documents (k, tag): the runs of windows that another of them has at an earlier place."""
    k, tag, start = (np.asarray(x, np.int64) for x in (k, tag, start))
    sizes = np.array([len(t) for t in texts], np.int64)
    # UTF-8 has no byte above 0xF7, so a step up keeps to a byte and leaves 0 to end each block
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    n = sizes - LENGTH + 1
    n_data = len(data)
    asked = np.zeros(n_data + 1, np.int64)
    np.add.at(asked, begin, 1)
    np.add.at(asked, begin + n, -1)
    window = np.cumsum(asked[:-1]) > 0
    step = np.sign(data[1:].astype(np.int16) - data[:-1])
    change = np.minimum.accumulate(np.where(np.concatenate([step, [1]]) != 0, np.arange(n_data), n_data)[::-1])[::-1]
    smaller = np.concatenate([step, [1]])[change] > 0
    stop = np.minimum.accumulate(np.where(smaller, np.arange(n_data), n_data)[::-1])[::-1]
    asked = np.zeros(n_data + 1, np.int64)
    np.add.at(asked, begin, 1)
    np.add.at(asked, stop[begin + n - 1] + 1, -1)
    order = two_stage_sort(data, np.cumsum(asked[:-1]) > 0, LENGTH)
    order = order[window[order]]
    prefix = common_prefixes(data, order, LENGTH)
    by_place = np.lexsort((tag, k))
    rank = np.zeros(len(k), np.int64)
    kt = np.stack([k[by_place], tag[by_place]])
    rank[by_place] = np.concatenate([[0], np.cumsum((kt[:, 1:] != kt[:, :-1]).any(axis=0))])
    row = np.searchsorted(begin, order, side="right") - 1
    place = (rank[row] << 32) + start[row] + order - begin[row]
    heads = np.flatnonzero(prefix < LENGTH)
    earliest = np.minimum.reduceat(place, heads)
    again = order[place > np.repeat(earliest, np.diff(np.concatenate([heads, [len(order)]])))]
    if not len(again):
        return None
    again.sort()
    row = np.searchsorted(begin, again, side="right") - 1
    return _joined(k[row], tag[row], start[row] + again - begin[row], np.ones(len(again), np.int64))


def _sort_groups(batches):
    """Blocks come ordered by group; whole groups are sorted together, about SORT_BYTES at a time."""
    held: list[tuple] = []
    size = 0

    def flush(rows):
        known = [r for r in rows if r[4] is None]
        if known:
            k, place = (np.array(x, np.int64) for x in zip(*((r[2], r[3]) for r in known)))
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in _joined(k, place >> 38, (place >> 7) & (2**31 - 1), place & 127).items()})
        rows = [r for r in rows if r[4] is not None]
        if not rows:
            return
        k, place, texts = (list(x) for x in zip(*((r[2], r[3], r[4]) for r in rows)))
        place = np.array(place, np.int64)
        found = repeated_windows(k, place >> 38, (place >> 7) & (2**31 - 1), texts)
        if found is not None:
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in found.items()})

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5))):
            if size >= SORT_BYTES and row[:2] != held[-1][:2]:
                yield from flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4] or b"") + 16
    if held:
        yield from flush(held)


_RUNS = "k long, tag int, start int, n int"


def find_repeats(wide: DataFrame) -> DataFrame:
    """k and lists tag, start, n: the runs of repeated windows of documents given as k (no nulls) and raw (bytes).

    The order of documents is that of k, then of the tag of the text; rows equal in both are one document. Within a
    batch each block goes on once, so a passage of a third of all documents is a row for each batch and not for each
    document; an anchor with very many differing blocks is split by window, equal windows staying together.
    """
    slim = wide.select("k", "raw")
    firsts = map_arrow(slim, _first_blocks, "anchor long, block long, k long, place long").repartition("anchor")
    nth = F.row_number().over(Window.partitionBy("anchor", "block").orderBy("k", "place"))
    of_anchor = Window.partitionBy("anchor")
    marked = firsts.withColumn("nth", nth).withColumn("rows", F.count("*").over(of_anchor)).where("rows > 1")
    marked = marked.withColumn("kinds", F.sum((F.col("nth") == 1).cast("int")).over(of_anchor))
    marked = materialize(marked.where("nth > 1 or kinds > 1").select("anchor", "k", "place", (F.col("nth") > 1).alias("again"), F.col("kinds").cast("int").alias("kinds")))
    wanted = marked.where("not again").groupBy("k").agg(F.collect_list(F.struct("anchor", "place", "kinds")).alias("w"))
    asked = wide.join(wanted, "k", "left").withColumns({f"_{c}": F.col("w")[c] for c in ("anchor", "place", "kinds")}).drop("w")
    names = asked.columns
    at_k, at_raw, at_anchor, at_place, at_kinds = (names.index(c) for c in ("k", "raw", "_anchor", "_place", "_kinds"))

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            split: list[tuple] = []
            b = b.filter(pa.compute.is_valid(b.column(at_place)))
            for k, raw, anchors, places, kinds in zip(*(b.column(i).to_pylist() for i in (at_k, at_raw, at_anchor, at_place, at_kinds))):
                tag = tag_of(raw)
                for anchor, place, kind in zip(anchors, places, kinds):
                    if place >> 38 != tag:
                        continue
                    start, n = (place >> 7) & (2**31 - 1), place & 127
                    if kind <= SPLIT_BLOCKS:
                        out.append((anchor, 0, k, place, raw[start : start + n + LENGTH - 1]))
                    else:
                        split += ((k, tag << 38 | s << 7 | 1, anchor, kind, raw[s : s + LENGTH]) for s in range(start, start + n))
            split.sort(key=lambda x: x[:2])
            seen = set()
            for k, place, anchor, kind, window in split:
                if (anchor, window) in seen:  # a repeat already; it only passes through, anywhere
                    out.append((anchor, -1 - k % 9973, k, place, None))
                else:
                    seen.add((anchor, window))
                    out.append((anchor, zlib.crc32(window) % (kind * SPAN // (4 * SPLIT_BLOCKS) + 1), k, place, window))
            for a in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[a : a + 50_000]), TYPES)], ["anchor", "part", "k", "place", "bytes"])

    TYPES = [pa.int64()] * 4 + [pa.binary()]
    blocks = asked.mapInArrow(cut, "anchor long, part long, k long, place long, bytes binary")
    sorted_runs = blocks.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_sort_groups, _RUNS)
    place = F.col("place")
    copies = marked.where("again").select("k", F.shiftright(place, 38).cast("int").alias("tag"), (F.shiftright(place, 7) % F.lit(1 << 31)).cast("int").alias("start"), (place % 128).cast("int").alias("n"))
    runs = map_arrow(slim, _later_blocks, _RUNS).unionByName(copies).unionByName(sorted_runs)
    return runs.groupBy("k").agg(F.collect_list(F.struct("tag", "start", "n")).alias("r")).select("k", *[F.col("r")[c].alias(c) for c in ("tag", "start", "n")])


def covered_bytes(raw: bytes, tags, starts, ns) -> np.ndarray:
    """Which bytes of the text lie in its repeated windows."""
    edge = np.zeros(len(raw) + 1, np.int32)
    if starts is not None:
        own = np.asarray(tags) == tag_of(raw)
        starts, ns = np.asarray(starts)[own], np.asarray(ns)[own]
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + ns + LENGTH - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_runs(wide: DataFrame) -> DataFrame:
    found = find_repeats(wide)
    return wide.join(found.select("k", F.col("tag").alias("_tag"), F.col("start").alias("_start"), F.col("n").alias("_n")), "k", "left")


def measure_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs, digest of the rest.

    Removed is every byte in a window of 100 bytes that also starts in a document with a smaller doc_id, or earlier in
    the same; windows are judged on the texts as given. A null text is empty; a null doc_id comes first; rows with
    equal doc_id and text are one document twice over, with equal results; of equal doc_ids with differing texts the
    one with the smaller checksum comes first. Extra columns are ignored.
    """
    wide = docs.select(key_of("doc_id").alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))

    def run(batch):
        out: dict[str, list] = {c: [] for c in ("k", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for k, raw, tags, starts, ns in zip(*(batch.column(c).to_pylist() for c in ("k", "raw", "_tag", "_start", "_n"))):
            gone = covered_bytes(raw, tags, starts, ns)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
            out["k"].append(k)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out

    found = map_arrow(_with_runs(wide), run, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.select(unkey("k").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages; a character cut in two goes whole. n_chars, if there, follows the text.

    All columns stay, null texts too; a document that is nothing but repeats keeps an empty text.
    """
    columns = docs.columns
    wide = docs.select(key_of("doc_id").alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"], F.col("text").isNull().alias("_none")).alias("rest"))
    joined = _with_runs(wide)
    names = joined.columns
    at = [names.index(c) for c in ("raw", "_tag", "_start", "_n")]
    at_rest = names.index("rest")

    def run(batches):
        for b in batches:
            texts = []
            for raw, tags, starts, ns in zip(*(b.column(i).to_pylist() for i in at)):
                gone = covered_bytes(raw, tags, starts, ns)
                texts.append((np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(at_rest)], ["text", "rest"])

    schema = joined.select(F.lit("").alias("text"), "rest").schema
    found = bounded(joined).mapInArrow(run, schema)
    text = F.when(~F.col("rest._none"), F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in columns])
