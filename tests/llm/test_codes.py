import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import codes
from flowloom.llm.queries import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, id long"


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.integers(1, 70), st.integers(0, 60), st.sampled_from([1, 3, 40, 10_000]), st.integers(0, 2**32))
def test_search_finds_the_lowest_nearest_entry(d, k, n, spread, seed):
    rng = np.random.default_rng(seed)
    parts, entries = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (k, d))
    distances = np.square(parts[:, None] - entries[None]).sum(axis=2)
    index, best = codes.nearest(parts, entries)
    assert index.tolist() == distances.argmin(axis=1).tolist()
    assert best.tolist() == distances.min(axis=1).tolist()


def test_search_looks_at_few_entries():
    rng = np.random.default_rng(1)
    entries = np.arange(64)[:, None] * 1000 + rng.integers(0, 9, (64, 4))
    looks = 0

    class Counted(np.ndarray):
        def __getitem__(self, key):
            nonlocal looks
            looks += isinstance(key, np.ndarray)
            return super().__getitem__(key)

    codes.nearest(entries + 1, entries.view(Counted))
    assert 1 <= looks <= 15  # a few for each of at most three steps; all entries would be 64 steps


def plain(rows):
    good = [(i, v, l) for i, v, l in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in good]
    first = sorted((good[j][0], ints[j]) for j in range(len(good)) if good[j][0] is not None)[:64]
    books = [[v[4 * p : 4 * p + 4] for _, v in first] for p in range(16)]

    def assign(p, v):
        own = v[4 * p : 4 * p + 4]
        distances = [sum((a - b) ** 2 for a, b in zip(own, e, strict=True)) for e in books[p]]
        return distances.index(min(distances)), min(distances)

    for _ in range(2):
        moved = []
        for p in range(16):
            members = [[] for _ in books[p]]
            for v in ints:
                members[assign(p, v)[0]].append(v[4 * p : 4 * p + 4])
            moved.append([[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(books[p], members, strict=True)])
        books = moved
    found, totals = [], {}
    for (i, _, label), v in zip(good, ints, strict=True):
        hits = [assign(p, v) for p in range(16)]
        error = sum(h[1] for h in hits)
        totals[label] = totals.get(label, 0) + error
        found.append((i, "".join(f"{h[0]:02x}" for h in hits), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], sha) for i, c, e, label in found), key=str)


def table():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (90, 64)).astype(np.float32).tolist()
    rows = [(int(i), v, None if i % 7 == 0 else int(i % 3)) for i, v in zip(rng.permutation(90), x, strict=True)]
    odd = [None, [], [1.0], [float("nan")] * 64, [float("inf")] * 64, [None] * 64, [0.5] * 32, [-float("inf")] + [0.0] * 63]
    rows += [(200 + i, v, 1) for i, v in enumerate(odd)] + [(None, x[3], None), (None, [9.0] * 64, 2), (5, x[6], 5), (5, x[7], 5), (6, [0.0] * 64, 5), (6, [-0.001] * 64, 5), (6, [0.0] * 64, 5)]
    return rows + [rows[0]] * 3


@pytest.mark.parametrize("n", [105, 40, 1, 0])
def test_against_a_plain_version(spark, n):
    rows = table()[-n:] if n else []
    frame = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in vector_codes(frame).collect()), key=str)
    assert got == plain(rows)


def test_decoding_gives_the_error_back(spark):
    rows = [r for r in table() if r[0] is not None and r[0] < 100 and r[1] and len(r[1]) == 64]
    frame = spark.createDataFrame([(i, v, l) for i, v, l in rows], "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F

    found, books = codes.compressed(frame, F.col("vec_id"), F.col("embedding"), F.col("label"))
    by_code = sorted((r["vec_id"], r["error"]) for r in found.collect() if np.isfinite(codes.decoded(r["code"], books)).all())
    whole = {r["vec_id"]: codes.decoded(r["code"], books) for r in found.collect()}
    seen = [(i, int(np.square(np.floor(256 * np.float32(v).astype(float)) - 256 * whole[i]).sum())) for i, v, _ in rows if sum(r[0] == i for r in rows) == 1]
    assert set(seen) <= set(by_code)


def test_too_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="64-bit"):
        vector_codes(frame).collect()
