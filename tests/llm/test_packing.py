import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from faultline.llm import packing


def plain(sizes, sources, clusters, capacity):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b in range(len(bins)) if 0 < bins[b][0] and bins[b][0] >= sizes[i] and (sources[i] is None or sources[i] not in bins[b][1]) and (clusters[i] is None or clusters[i] not in bins[b][2])]
        b = min(fits, key=lambda b: (bins[b][0], b)) if fits else len(bins)
        if b == len(bins):
            bins.append([capacity, set(), set()])
        out[i] = (b, capacity - bins[b][0])
        bins[b][0] -= sizes[i]
        bins[b][1].add(sources[i])
        bins[b][2].add(clusters[i])
    return out


def test_best_fit_equals_a_plain_one():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randrange(0, 80)
        sizes = [rnd.choice([0, 1, 5, 20, 50, 99, 100]) for _ in range(n)]
        sources = [rnd.choice([None, "a", "a", "a", "b", "c"]) for _ in range(n)]
        clusters = [rnd.choice([None, *range(20)]) for _ in range(n)]
        assert packing.pack_block(sizes, sources, clusters, 100) == plain(sizes, sources, clusters, 100)


def test_documents(docs, texts):
    rows = packing.pack(docs).collect()
    bins, by = defaultdict(list), Counter()
    for r in rows:
        bins[r["bin"]].append(r)
        by[r["doc_id"]] += r["n_words"]
    assert by == Counter({k: len(t.split()) for k, t in texts.items()})
    for b in bins.values():
        b.sort(key=lambda r: (r["bin_start"], r["n_words"]))
        assert sum(r["n_words"] for r in b) <= packing.CAPACITY
        assert all(x["bin_start"] + x["n_words"] == y["bin_start"] for x, y in zip(b, b[1:]))
        assert len({r["source"] for r in b}) == len(b) and len({texts[r["doc_id"]] for r in b}) == len(b)


def test_edges(edge_docs, no_docs, edge_rows):
    rows = packing.pack(edge_docs).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in edge_rows} and packing.pack(no_docs).count() == 0
    assert sum(r["n_words"] for r in rows) == sum(len((r[1] or "").split()) for r in edge_rows)


def test_blocks_hold_all_sizes(spark):
    words = F.when(F.col("doc_id") % 2 == 0, 700).otherwise(300)
    df = spark.range(10_000).select(F.col("id").alias("doc_id")).withColumn("text", F.concat(F.col("doc_id").cast("string"), F.repeat(F.lit(" a"), words - 1)))
    found = packing.pack(df.withColumn("source", F.lit(None).cast("string"))).agg(F.countDistinct("bin"), F.sum("n_words")).first()
    assert found[1] == 5_000_000 and found[0] <= 1.06 * found[1] / packing.CAPACITY


def test_pieces_carry_their_text(edge_docs, edge_rows):
    rows = packing.pack(edge_docs, 50, with_text=True).collect()
    parts = defaultdict(list)
    for r in rows:
        assert r["n_words"] == len((r["text"] or "").split())
        parts[r["doc_id"], r["first_word"]].append(r["text"])
    for key in (3, 5, 6, 7, 9):
        whole = [parts[k] for k in sorted(p for p in parts if p[0] == key)]
        texts = [r[1] for r in edge_rows if r[0] == key]
        if len(texts) == 1:
            assert "".join(w[0] for w in whole) == texts[0]


def test_bins_against_one_block(spark):
    """Blocks cost 1 % of the bins of one best fit over all pieces, at most."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = packing.pack(docs).select("n_words", "source", "doc_id", "bin").collect()
    assert len(rows) > 2 * packing.BLOCK_PIECES
    cluster = {r["doc_id"]: r["c"] for r in docs.select("doc_id", F.xxhash64("text").alias("c")).collect()}
    one = packing.pack_block([r["n_words"] for r in rows], [r["source"] for r in rows], [cluster[r["doc_id"]] for r in rows], packing.CAPACITY)
    assert len({r["bin"] for r in rows}) <= 1.01 * (1 + max(b for b, _ in one))
