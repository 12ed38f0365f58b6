"""Packing of tokenised documents into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, byte_slices, materialize

#: Ids that a sequence holds, and the id that ends a document.
CAPACITY, END = 1024, 0
#: Empty places of a sequence up to which its rests stay whole; those of emptier ones are cut.
SLACK = 5
#: Bytes of text that are split at once, about.
SLICE_BYTES = 4 << 20
#: Pre-tokens whose ids a Python worker remembers; the table is emptied when it is full.
REMEMBERED = 600_000

_LETTER, _NUMBER, _SPACE = 1, 2, 3


# --- tokens ---------------------------------------------------------------------------------------------------------


def character_kinds(tokenizer) -> np.ndarray:
    """For each code point: letter, number, white space or none of these, in the Unicode version that the tokenizer has.

    Its pre-tokens of a text of all code points are runs of one kind; with which others the first character of a run goes together tells its kind.
    """
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    kinds = np.zeros(0x110000, np.uint8)
    points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000], np.uint32)
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    kinds[32] = _SPACE
    for _, (begin, to) in split(every):
        begin += every[begin] == " "
        if begin < to:
            c = every[begin]
            together = lambda other: len(split(c + other)) == 1  # noqa: B023, E731
            kinds[points[begin:to]] = _LETTER if together("a") else _NUMBER if together("1") else 0 if together("!") else _SPACE
    return kinds


def pre_token_starts(points: np.ndarray, fresh: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of byte-level BPE begin, for all texts at once.

    points: the code points of all texts, one after the other; fresh: marks the first of each. The pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space but its last before other things|white space.
    """
    n = len(points)
    kind = kinds[points]
    change = fresh.copy()
    change[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], n)
    starts = change
    white = kind[runs] == _SPACE
    goes_on = np.zeros(len(runs), bool)  # another run of the same text follows
    goes_on[:-1] = ~fresh[runs[1:]]
    before = np.flatnonzero(white & goes_on)
    starts[ends[before] - 1] = True  # the last white space before other things is on its own ...
    joined = before[points[ends[before] - 1] == 32] + 1
    starts[runs[joined]] = False  # ... or, if it is a blank, begins the next pre-token
    alone = (points[runs] == 39) & (ends - runs == 1) & goes_on
    alone[joined] = False
    quotes = runs[np.flatnonzero(alone)]
    if len(quotes):
        open_ = np.append(fresh, [True, True])  # no letter of the same text at all beyond the end
        after = np.append(points, [0, 0])
        one, two = after[quotes + 1], np.where(open_[quotes + 2], 0, after[quotes + 2])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.isin(one.astype(np.int64) << 32 | two, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        took = np.where(single, 1, np.where(double, 2, 0))
        quotes, took = quotes[took > 0], took[took > 0]
        starts[quotes + 1] = False
        rest = quotes + 1 + took
        inside = rest < n
        rest = rest[inside]
        starts[rest[kind[rest] == _LETTER]] = True
    return starts


class Encoder:
    """Encodes texts as the tokenizer's own call does, with the pre-tokens of many texts found and looked up at once."""

    def __init__(self, raw: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = character_kinds(self.tokenizer)
        self.known: dict[str, int] = {}  # the place of each pre-token's ids in the arrays
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.flat, self.begin, self.size = self.flat[:0], self.begin[:0], self.size[:0]
        places = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            new = [words[i] for i in unknown.tolist()]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            places[unknown] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, places[unknown].tolist()))
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())))
        return places

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and, at the end, their number)."""
        whole = texts.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        joined = "".join(whole)
        if any(s in joined for s in self.special):  # such strings in a text are tokens: rare, so the tokenizer's own way
            ids = [e.ids for e in self.tokenizer.encode_batch(whole, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, whole), np.int64, len(whole))
        begins = np.concatenate([[0], np.cumsum(lengths)])
        fresh = np.zeros(len(points), bool)
        fresh[begins[:-1][lengths > 0]] = True
        starts = np.flatnonzero(pre_token_starts(points, fresh, self.kinds))
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        offsets = np.append(at[starts], at[-1]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(joined.encode())).dictionary_encode()
        which = self._places(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        each = self.size[which]
        ends = np.cumsum(each)
        out = self.flat[np.repeat(self.begin[which] - (ends - each), each) + np.arange(int(ends[-1]))]
        before = np.concatenate([[0], ends])
        return out, before[np.searchsorted(starts, begins)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, raw) -> Encoder:
    """The worker process's own encoder, kept from task to task."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(raw.value)
    return _ENCODERS[name]


# --- the plan -------------------------------------------------------------------------------------------------------


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packing patterns: lengths are placed longest first, each into the shortest pack so far that has room for it.

    A pattern stands for all packs of its kind, so the work grows with the number of lengths and not of documents. Where no
    pack has room new ones are begun, each filled before the next.
    """
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def add(room: int, count: int, lengths: tuple[int, ...]):
        if count:
            open_.setdefault(room, []).append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in range(capacity, length - 1, -1):
            if not left:
                break
            while left and room and open_.get(room):
                count, lengths = open_[room].pop()
                took = min(count, left)
                add(room, count - took, lengths)
                add(room - length, took, (*lengths, length))
                left -= took
        most = capacity // length
        add(capacity - most * length, left // most, (length,) * most)
        add(capacity - left % most * length, min(1, left % most), (length,) * (left % most))
    return [x for room in sorted(open_) for x in open_[room]]


def digits(length: int) -> list[int]:
    """The powers of two that add up to the length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


@dataclass
class Slots:
    """Where the pieces of one length go, by their rank: runs of ranks, each over sequences that hold `multiplicity` of them from `offset` on."""

    start: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    multiplicity: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def place(self, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        start, sequence, multiplicity, offset = (np.array(x, np.int64) for x in (self.start, self.sequence, self.multiplicity, self.offset))
        run = np.searchsorted(start, rank, "right") - 1
        nth, of = np.divmod(rank - start[run], multiplicity[run])
        return sequence[run] + nth, offset[run] + of * length


def _fill(patterns: Iterable[tuple[int, tuple[int, ...]]], begin: int) -> tuple[dict[int, Slots], int]:
    """The slots of each length, and the first sequence that is not used."""
    slots: dict[int, Slots] = {}
    used: dict[int, int] = {}
    for count, lengths in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            m, s = lengths.count(length), slots.setdefault(length, Slots())
            for x, v in ((s.start, used.get(length, 0)), (s.sequence, begin), (s.multiplicity, m), (s.offset, offset)):
                x.append(v)
            used[length] = used.get(length, 0) + m * count
            offset += m * length
        begin += count
    return slots, begin


@dataclass
class Plan:
    """Where rests of documents go, by their length and their rank among those of it.

    The first `kept[length]` stay whole. The others are cut at the binary digits of their length, so that longest first all
    sequences fill; digit_base[length, digit]: pieces of a digit from shorter rests come first.
    """

    kept: dict[int, int]
    whole: dict[int, Slots]
    cut: dict[int, Slots]
    digit_base: dict[tuple[int, int], int]
    sequences: int

    def place(self, length: int, rank: np.ndarray) -> Iterable[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]]:
        """(which of the ranks, start within the rest, length, sequence, offset) for each kind of piece that rests of a length have."""
        stays = rank < self.kept.get(length, 0)
        if stays.any():
            yield np.flatnonzero(stays), 0, length, *self.whole[length].place(rank[stays], length)
        if not stays.all():
            own, at = rank[~stays] - self.kept.get(length, 0), 0
            for d in digits(length):
                yield np.flatnonzero(~stays), at, d, *self.cut[d].place(own + self.digit_base[length, d], d)
                at += d


def full_enough(lengths: tuple[int, ...], capacity: int, slack: int) -> bool:
    """A sequence of a power of two needs no padding."""
    filled = sum(lengths)
    return capacity - filled <= slack or filled & (filled - 1) == 0


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, slack: int = SLACK) -> Plan:
    """histogram: the number of rests of each length below the capacity (a power of two)."""
    if capacity & (capacity - 1) or slack < 0:
        raise ValueError("the capacity must be a power of two, the slack not below 0")
    patterns = shortest_pack_first(histogram, capacity)
    stay = [x for x in patterns if full_enough(x[1], capacity, slack)]
    whole, begin = _fill(stay, 0)
    kept: dict[int, int] = {}
    for count, lengths in stay:
        for length in lengths:
            kept[length] = kept.get(length, 0) + count
    pieces: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for length in sorted(histogram):
        if dissolved := histogram[length] - kept.get(length, 0):
            for d in digits(length):
                base[length, d] = pieces.get(d, 0)
                pieces[d] = base[length, d] + dissolved
    parts = []
    for count, lengths in shortest_pack_first(pieces, capacity):
        while lengths and not full_enough(lengths, capacity, 0):  # only the last: as powers of two, largest first, it splits into such sums
            most, filled, n = 1 << (sum(lengths).bit_length() - 1), 0, 0
            while filled < most:
                filled, n = filled + lengths[n], n + 1
            parts.append((count, lengths[:n]))
            lengths = lengths[n:]
        parts.append((count, lengths))
    cut, end = _fill(parts, begin)
    return Plan(kept, whole, cut, base, end)


# --- documents ------------------------------------------------------------------------------------------------------


_COUNTED = "doc_id long, part int, rest int, nth long, doc_tokens long, first_full long, full_crc array<long>, rest_crc long, digit_crc array<long>"


def count_tokens(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per document: its number of ids, checksums of all pieces that it can be cut into, and its rank in its task among the rests of its length."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    name = uuid.uuid4().hex
    schema = _COUNTED + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encoder, part = _encoder(name, shared), TaskContext.get().partitionId()
        seen, full = np.zeros(capacity, np.int64), 0
        for batch in batches:
            for piece in byte_slices(batch, "text", SLICE_BYTES):
                ids, at = encoder.encode(piece.column("text").fill_null(""))
                cols: list[list] = [[] for _ in names]
                for k, doc_id in enumerate(piece.column("doc_id").to_pylist()):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end)).astype("<u4")
                    raw, n = memoryview(own.tobytes()), len(own)
                    rest, whole = n % capacity, n // capacity
                    crc = lambda a, b: zlib.crc32(raw[4 * a : 4 * b])  # noqa: B023, E731
                    cuts = np.cumsum([whole * capacity, *digits(rest)]).tolist()
                    row = [doc_id, part, rest, int(seen[rest]), n, full, [crc(i * capacity, (i + 1) * capacity) for i in range(whole)], crc(whole * capacity, n), [crc(a, b) for a, b in zip(cuts, cuts[1:])]]
                    for c, v in zip(cols, [*row, own.astype(np.int32)] if with_ids else row):
                        c.append(v)
                    seen[rest] += 1
                    full += whole
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(slim).mapInArrow(run, schema)


def ranked(counted: DataFrame) -> DataFrame:
    """Adds rank: the number of the rest among all of its length. Tasks have numbered their own; what comes before a task is a sum over its predecessors."""
    sizes = counted.groupBy("rest", "part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.join(sizes.select("rest", "part", before.alias("_before")), ["rest", "part"]).withColumn("rank", F.col("nth") + F.col("_before")).drop("_before", "nth")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: and its ids.

    tokenizer: the text of a tokenizer file. A document is its ids and one that ends it, so null and empty texts have one id.
    Whole sequences are cut from its front; the rests, shorter than the capacity, go by patterns that are made from the
    histogram of their lengths alone (`make_plan`): those of sequences with more than `slack` empty places are cut further, so every sequence
    has at most `slack` empty places or a power of two of ids. Repeated rows and ties in doc_id are documents
    of their own, in any order; an empty table has no pieces; extra columns are ignored.

    Documents are tokenised once, and numbers and checksums written to the shared folder; texts are not shuffled (ids are, if asked for).
    The driver gets a row for each length, and tasks the plan, whose size depends on the capacity. A length that many documents have is numbered
    by tasks, so no task gets all of them.
    """
    spark = docs.sparkSession
    counted = materialize(count_tokens(docs, tokenizer, capacity, end, with_ids))
    histogram = {r["rest"]: r["n"] for r in counted.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, capacity, slack)
    shared = spark.sparkContext.broadcast(plan)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        plan = shared.value
        for batch in batches:
            part, rest, rank, tokens, first, rest_crc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "rest", "rank", "doc_tokens", "first_full", "rest_crc"))
            lists = {}
            for c in ("full_crc", "digit_crc"):
                n = np.array(batch.column(c).value_lengths(), np.int64)
                lists[c] = (n, np.cumsum(n) - n, batch.column(c).flatten().to_numpy(zero_copy_only=False))
            whole = tokens // capacity
            rows, starts, lengths, crcs, sequences, offsets = [], [], [], [], [], []

            def add(row, start, length, crc, sequence, offset):
                for x, v in zip((rows, starts, lengths, crcs, sequences, offsets), (row, start, np.full(len(row), length), crc, sequence, offset)):
                    x.append(np.asarray(v, np.int64))

            n, begin, flat = lists["full_crc"]
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(begin, n)
            # whole sequences are numbered by task and order, beyond those of the plan
            add(row, nth * capacity, capacity, flat, (part[row].astype(np.int64) + 1 << 40) + first[row] + nth, np.zeros(len(row)))
            n, begin, flat = lists["digit_crc"]
            for length in np.unique(rest[rest > 0]).tolist():
                own = np.flatnonzero(rest == length)
                for some, at, size, sequence, offset in plan.place(length, rank[own]):
                    row = own[some]
                    crc = rest_crc[row] if size == length else flat[begin[row] + digits(length).index(size)]
                    add(row, whole[row] * capacity + at, size, crc, sequence, offset)
            row, start, length, crc, sequence, offset = (np.concatenate(x) for x in (rows, starts, lengths, crcs, sequences, offsets))
            out = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, crc, tokens[row], sequence, offset))]
            if with_ids:
                ids = batch.column("ids")
                out.append(pa.array([ids[r].values[a : a + k] for r, a, k in zip(row.tolist(), start.tolist(), length.tolist())], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)

    return bounded(ranked(counted)).mapInArrow(run, schema)


def read_tokenizer(spark, path: str) -> str:
    """The tokenizer file at a path that the driver or Spark can open."""
    if "://" in path:
        return spark.read.format("binaryFile").load(path).first()["content"].decode()
    with open(path, encoding="utf-8") as f:
        return f.read()
