import zlib
from collections import defaultdict

import numpy as np

from faultline.llm import sharding

MASK = (1 << 64) - 1


def plain_jump(key, n):
    key = int(sharding.spread(np.array([key], np.int64))[0])
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.JUMP_MULTIPLIER + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, -1, 5, 2**63 - 1, -(2**63), *range(100, 400)], np.int64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(k, n) for k in keys.tolist()]
    many = np.arange(200_000, dtype=np.int64)
    a, b = sharding.jump_hash(many, 24), sharding.jump_hash(many, 25)
    assert set(b[a != b]) == {24} and abs((a != b).mean() - 1 / 25) < 0.005
    assert np.bincount(a).std() / np.bincount(a).mean() < 0.05


def test_documents(edge_docs, no_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RUN", 2)
    rows = sharding.shard_documents(edge_docs, 3).collect()
    assert len(rows) == len(edge_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 3)
        assert r["shard"] == plain_jump(-(2**63) if r["doc_id"] is None else r["doc_id"], 3)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["size"] == 8 and by[0]["text_crc32"] == 0
    t = edge_rows[9][1].encode()
    assert by[9]["size"] == len(t) + 8 and by[9]["text_crc32"] == zlib.crc32(t)
    assert sharding.shard_documents(no_docs).count() == 0
