"""Conflict-constrained best-fit packing of documents into bins of words."""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Words that a bin holds.
CAPACITY = 1024
#: Pieces that are packed together; bins do not outlive their block, so neither memory nor the search grows with the input.
BLOCK_PIECES = 4096
#: Pieces of one partition, about; with their texts, two blocks.
PARTITION_PIECES = 1 << 16


class Bins:
    """Open bins in order of what they still hold; each carries bitmaps of its sources and of its duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, words before it): the tightest bin with room that shares neither bit, else a new bin."""
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            residual, b = self.open[at]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.open[at]
                break
            at += 1
        else:
            residual, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if residual > size:
            insort(self.open, (residual - size, b))
        return b, self.capacity - residual


def pack_block(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, words before it) of each piece: best fit, largest first, ties in the order given. A None conflicts with nothing."""
    bits: dict = {}

    def bit(kind: str, value) -> int:
        return 0 if value is None else 1 << bits.setdefault(kind, {}).setdefault(value, len(bits[kind]))

    bins, out = Bins(capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.place(sizes[i], bit("source", sources[i]), bit("cluster", clusters[i]))
    return out


_WORD = re.compile(r"\S+")


def cut_text(text: str | None, capacity: int) -> list[str | None]:
    """The text's pieces of `capacity` words; each begins with its first word (the first: with the text), so they add up to the text."""
    if not text or len(text) <= capacity:
        return [text]
    starts = [m.start() for i, m in enumerate(_WORD.finditer(text)) if i and i % capacity == 0]
    return [text[a:b] for a, b in zip([0, *starts], [*starts, len(text)])]


def pack(docs: DataFrame, capacity: int = CAPACITY, with_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin, bin_start, source; with_text: and the piece's text.

    Documents of more than `capacity` words are cut into pieces of it and a rest. No bin holds two pieces of one
    source or two of one duplicate cluster (equal texts); a null source or text conflicts with none. A document
    without words is a piece of no words and has a bin all the same. Repeated rows are pieces of their own; extra
    columns are ignored. Pieces, without texts unless they are asked for, are dealt by hash of document and piece and packed in blocks of all
    sizes, so no task or bin list holds a source or cluster whole.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.when(F.col("text") != "", F.xxhash64("text")).alias("cluster"),
        "text",
    )

    def measure(batch):
        words = np.array([len(t.split()) if t else 0 for t in batch.column("text").to_pylist()], np.int64)
        counts = np.maximum(1, -(-words // capacity))
        row = np.repeat(np.arange(len(words)), counts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        own = np.minimum(capacity, words[row] - piece * capacity)
        taken = {c: batch.column(c).take(pa.array(row)) for c in ("doc_id", "source", "cluster")}
        if with_text:
            taken["text"] = pa.array([t for text in batch.column("text").to_pylist() for t in cut_text(text, capacity)], pa.string())
        return taken | {"piece": piece.astype(np.int32), "n_words": own}

    def pack_partition(batches):
        base, blocks, held, n = TaskContext.get().partitionId() << 40, 0, [], 0
        def flush(table):
            nonlocal blocks, base
            for at in range(0, table.num_rows, BLOCK_PIECES):
                b = table.slice(at, BLOCK_PIECES)
                placed = pack_block(b["n_words"].to_pylist(), b["source"].to_pylist(), b["cluster"].to_pylist(), capacity)
                bins, starts = (np.array(x, np.int64) for x in zip(*placed))
                doc_id, piece, words, source, *text = (b[c].combine_chunks() for c in ("doc_id", "piece", "n_words", "source", *TEXT))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, piece, pa.array(piece.to_numpy().astype(np.int64) * capacity), words, pa.array(bins + base), pa.array(starts), source, *text], NAMES
                )
                base += int(bins.max()) + 1

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_PIECES:
                whole = pa.Table.from_batches(held)
                full = n - n % BLOCK_PIECES
                yield from flush(whole.slice(0, full))
                held = whole.slice(full).to_batches()
                n -= full
        if n:
            yield from flush(pa.Table.from_batches(held))

    TEXT = ["text"] if with_text else []
    names = "doc_id long, piece int, first_word long, n_words long, bin long, bin_start long, source string" + ", text string" * with_text
    NAMES = [x.split()[0] for x in names.split(", ")]
    pieces = map_arrow(slim, measure, "doc_id long, source string, cluster long, piece int, n_words long" + ", text string" * with_text)
    parts = max(1, docs.select(F.lit(1)).count() // (2 * BLOCK_PIECES if with_text else PARTITION_PIECES))
    dealt = pieces.repartition(parts, F.xxhash64("doc_id", "piece"))
    ordered = dealt.sortWithinPartitions(F.xxhash64(F.lit("order"), "doc_id", "piece"), "doc_id", "piece", "n_words", "cluster", "source")
    return ordered.select("doc_id", "piece", "n_words", "source", "cluster", *TEXT).mapInArrow(pack_partition, names)
