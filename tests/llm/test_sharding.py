import zlib
from collections import Counter, defaultdict

import numpy as np

from flowloom.llm import sharding
from tests.llm import data


def test_differencing_beats_its_largest_item():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 1000, 400))[::-1]
    totals = np.zeros((400, 16), np.int64)
    totals[:, 0] = sizes
    sums, went = sharding.difference(totals)
    assert np.array_equal(np.bincount(went[:, 0], sizes, minlength=16), sums)
    assert sums[0] - sums[-1] <= 4


def test_shards(spark):
    rows = data.odd_rows()
    found = sharding.sharded(spark.createDataFrame(rows, data.SCHEMA)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    groups = defaultdict(set)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1] or "")
    for r in found:
        groups[next(iter(texts[r["doc_id"]]))].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())


def test_several_levels_stay_even(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 40)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('x', cast(1 + id * 7919 % 500 as int)) || id AS text")
    sums = [r["b"] for r in sharding.sharded(docs).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sums) == 16 and max(sums) - min(sums) < 60


def test_empty_table(spark):
    assert sharding.sharded(spark.createDataFrame([], data.SCHEMA)).count() == 0
