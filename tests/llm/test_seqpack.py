"""Packing by the histogram of lengths: tokens against the library's own call, plans by brute force, whole tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from faultline.llm import seqpack


@pytest.fixture(scope="module")
def raw():
    return seqpack.read_tokenizer(None, public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library(raw):
    t = Tokenizer.from_str(raw)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_against_the_library(raw, library):
    rng, encoder = random.Random(5), seqpack.Encoder(raw)
    alphabet = list("aàsteré'lvmd12½ \n\t 　.,!?-😀汉字ا𝟘\x1c\x85​̀'") + ["<|endoftext|>", "'re", " '", "\r\n"]
    texts = ["", " ", "  ", "'", "x'", "it's we'll 's 'd''s", "\n 's", "a \n b", "<|endoftext|>"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for at in range(0, len(texts), 7):  # slices with and without special strings
        some = texts[at : at + 7]
        ids, ends = encoder.encode(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library(t) for t in some]


def test_kinds_of_all_characters(raw):
    t = Tokenizer.from_str(raw)
    kinds, split = seqpack.character_kinds(t), t.pre_tokenizer.pre_tokenize_str
    for point in random.Random(1).sample([i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and i != 32], 3000):
        together = [len(split(chr(point) + c)) == 1 for c in "a1!"]
        assert kinds[point] == (1 if together[0] else 2 if together[1] else 0 if together[2] else 3)


def test_placing_as_one_by_one():
    """The patterns are what placing each length on its own gives: longest first, into the pack with most room."""
    rng = random.Random(2)
    for _ in range(40):
        capacity = 64
        lengths = sorted((rng.choice([1, 2, 7, 20, 33, 33, 40, 63, rng.randint(1, 63)]) for _ in range(rng.randint(0, 120))), reverse=True)
        packs: list[list[int]] = []
        for x in lengths:
            room = [capacity - sum(p) for p in packs]
            if room and max(room) >= x:
                packs[room.index(max(room))].append(x)
            else:
                packs.append([x])
        got = seqpack.shortest_pack_first(Counter(lengths), capacity)
        assert sorted(x for c, p in got for _ in range(c) for x in p) == sorted(lengths)
        assert sum(c for c, _ in got) == len(packs)
        assert sorted(sum(p) for c, p in got for _ in range(c)) == sorted(map(sum, packs))


@pytest.mark.parametrize("slack", [0, 5])
@pytest.mark.parametrize("shape", ["mixed", "one hot length", "long", "few"])
def test_plan_places_every_id_once(shape, slack):
    rng, capacity = np.random.default_rng(3), 1024
    lengths = {
        "mixed": rng.integers(1, 1024, 5000),
        "one hot length": np.concatenate([rng.integers(1, 1024, 500), np.full(9000, 600)]),
        "long": rng.integers(700, 1024, 3000),
        "few": np.array([3, 1000]),
    }[shape]
    histogram = Counter(lengths.tolist())
    plan = seqpack.make_plan(histogram, capacity, slack)
    inside = defaultdict(list)
    for length, n in histogram.items():
        covered = np.zeros(n, np.int64)
        for some, start, size, sequence, offset in plan.place(length, np.arange(n)):
            covered[some] += size
            for s, o in zip(sequence.tolist(), offset.tolist()):
                inside[s].append((o, size))
        assert (covered == length).all()
    assert len(inside) == plan.sequences
    for pieces in inside.values():
        filled = 0
        for offset, size in sorted(pieces):
            assert offset == filled
            filled += size
        assert filled <= capacity and (capacity - filled <= slack or filled & (filled - 1) == 0)


def check_table(rows, docs, library, slack=seqpack.SLACK):
    """Each document's pieces follow one another with the right checksums; each sequence is gapless and full enough."""
    ids_of = sorted((d, tuple([*library(t), 0])) for d, t in docs) if all(d is not None for d, _ in docs) else [(d, tuple([*library(t), 0])) for d, t in docs]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        filled = 0
        for offset, length in sorted(pieces):
            assert offset == filled and length > 0
            filled += length
        assert filled <= 1024 and (1024 - filled <= slack or filled & (filled - 1) == 0)
    # pieces as (doc_id, start, length, crc), each document's set must be found among the rows as often as it is there
    have = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    starts = defaultdict(set)
    for r in rows:
        starts[r["doc_id"]].add((r["start"], r["length"]))
    want = 0
    for d, ids in ids_of:
        want += len(ids)
        raw = np.array(ids, "<u4").tobytes()
        fits = {(s, n) for s, n in starts[d] if s + n <= len(ids) and have[d, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), len(ids)] > 0}
        at = {0}
        for s, n in sorted(fits):
            if s in at:
                at.add(s + n)
        assert len(ids) in at
    assert sum(r["length"] for r in rows) == want


def test_whole_table(spark, docs, raw, library):
    rows = seqpack.pack(docs.repartition(5), raw).collect()
    check_table(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], library)


def test_edge_rows(spark, edge_docs, edge_rows, no_docs, raw, library):
    check_table(seqpack.pack(edge_docs, raw).collect(), [(r[0], r[1]) for r in edge_rows], library)
    assert seqpack.pack(no_docs, raw).collect() == []
    nulls = spark.createDataFrame([(None, None)] * 5, "doc_id long, text string")
    rows = seqpack.pack(nulls, raw).collect()
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in rows] == [(0, 1, 1)] * 5
    assert sorted(Counter(r["sequence_id"] for r in rows).values()) == [1, 4]


def test_many_equal_documents_and_their_ids(spark, raw, library):
    text = "some words of a text that is there very often " * 66
    frame = spark.createDataFrame([(i, text if i % 3 else f"text {i}", "ids") for i in range(900)], "doc_id long, text string, ids string").repartition(6)
    rows = seqpack.pack(frame, raw, with_ids=True).collect()
    check_table(rows, [(i, text if i % 3 else f"text {i}") for i in range(900)], library)
    whole = defaultdict(dict)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        whole[r["doc_id"]][r["start"]] = r["ids"]
    for i, parts in whole.items():
        assert sum((parts[s] for s in sorted(parts)), []) == [*library(text if i % 3 else f"text {i}"), 0]
