import random
from collections import defaultdict

import pytest

from velum.llm import sharding


def check(rows, shards=8, spread=None):
    by = defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1 and 0 <= r.shard < shards
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(r.size for r in rows), max((r.size for r in rows), default=0)
    if spread is not None:
        for k in range(shards):
            assert abs(sum(r.size for r in by[k]) - total / shards) <= spread * total / shards + 2 * largest
    return by


@pytest.mark.parametrize("seed", range(3))
def test_near_equal_bytes_with_hot_texts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "hot text " * 3 if i % 3 == 0 else "é" * rng.randrange(80)) for i in range(4000)]
    rows += [(5001, None), (5002, ""), (None, "no id"), (None, "no id"), (7, "same"), (7, "same"), (6000, "long " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as slot", "'k' as key_hi").repartition(5)
    out = sharding.shard(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "key_hi", "size", "shard", "slot"])
    got = out.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    by = check(got, 8, 2 * sharding.TOLERANCE)
    apart = {r.text for r in got if r.text and "hot" not in r.text and len({k for k in by if any(x.text == r.text for x in by[k])}) > 1}
    assert len(apart) <= 7  # only a boundary parts equal texts


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, "t" * i) for i in range(n)], "doc_id long, text string")
    check(sharding.shard(df).collect())


def test_splitters_are_exact(spark):
    rng = random.Random(9)
    data = [(rng.choice([-(2**63), -5, 0, 2**63 - 1, rng.randrange(-(2**63), 2**63)]), rng.randrange(50), rng.randrange(1, 9)) for _ in range(2000)]
    keys = spark.createDataFrame(data, "hi long, lo long, size long").repartition(3)
    off = 1 << 63
    for key, size, rows in sharding.splitters(keys, 4, 3, 0.001):
        below = [s for h, i, s in data if ((h + off) << 64) + i + off < key]
        assert (sum(below), len(below)) == (size, rows)
