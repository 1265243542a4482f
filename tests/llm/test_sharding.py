from collections import Counter

import numpy as np

from docvet.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 2000, dtype=np.uint64)
    for n in (1, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    a, b = sharding.jump_hash(keys, 8), sharding.jump_hash(keys, 9)
    assert set(b[a != b].tolist()) == {8}


def test_every_row_once(spark, make_docs, odd_rows, tmp_path):
    docs = make_docs(odd_rows)
    got = sharding.shard_documents(docs, 4, bucket_bytes=20_000, path=f"{tmp_path}/out").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(odd_rows)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in got)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
        assert r.grown_shard in (r.shard, 4)
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == sorted(f"shard={k}" for k in shards)
    assert sharding.shard_documents(docs.where("false"), 4).count() == 0


def test_order_is_shuffled(spark, make_docs):
    got = sharding.shard_documents(make_docs([(k, f"t{k}") for k in range(400)]), 2).orderBy("shard", "slot").collect()
    ids = [r.doc_id for r in got if r.shard == 0]
    assert ids != sorted(ids) and abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.3
