import random
import zlib

from evenkeel.llm import queries
from evenkeel.llm.sharding import shard_by_bytes

SF = "/root/testdata/sf0.001"


def brute(docs, shards):
    rows = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0))
    total, before, out, slots = sum(r[1] for r in rows), 0, [], {}
    for i, size, crc in rows:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((i, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    return out


def placed(df, shards):
    rows = shard_by_bytes(df, shards).collect()
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[3], r[4]))


def test_random_sizes(spark, frame):
    rng = random.Random(2)
    docs = [(i, "é" * rng.choice([0, 1, 5, 200, 3000])) for i in rng.sample(range(10_000), 400)]
    assert placed(frame(docs), 16) == brute(docs, 16)


def test_nulls_empty_one_row_and_repeats(spark, frame):
    assert placed(frame([(1, None), (2, ""), (None, "abc")]), 4) == brute([(1, None), (2, ""), (None, "abc")], 4)
    assert placed(frame([(7, "x" * 10**6)]), 16) == [(7, 10**6 + 1, zlib.crc32(b"x" * 10**6), 8, 0)]
    got = placed(frame([(3, "same")] * 200), 4)
    assert sorted((s, k) for *_, s, k in got) == [(s, k) for s in range(4) for k in range(50)]
    assert placed(frame([(1, "a")]).limit(0), 4) == []


def test_query(spark):
    rows = queries.QUERIES["op3_sharding"].run(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows) == brute(docs, 16)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert set(sizes) == set(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)
