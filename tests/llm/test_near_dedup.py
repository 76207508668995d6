import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowloom.llm import graph, near_dedup, texts
from tests.llm import data


def shingles(text, n):
    w = [x.lower() for x in data.words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain(rows, n):
    """Class and set size of every row, by comparing all texts."""
    sets = [shingles(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), 1 << 60 if r[0] is None else r[0])
    return Counter((r[0], len(sets[i]), (None if least[find(i)] == 1 << 60 else least[find(i)]) if sets[i] else r[0]) for i, r in enumerate(rows))


def copies():
    """Chains of edits, a large group of near copies, a common passage, short texts."""
    rng = random.Random(8)
    rows = data.odd_rows()
    text = data.prose(rng, 100).split(" ")
    for i in range(70):
        some = list(text)
        for _ in range(rng.randrange(4)):
            some[rng.randrange(len(some))] = f"edit{rng.randrange(9)}"
        rows.append(data.row(1000 + i, " ".join(some)))
    for i in range(40):
        rows.append(data.row(2000 + i, data.prose(rng, 30) + " " + " ".join(text[:40]) + " " + data.prose(rng, 20)))
    chain = data.prose(rng, 60).split(" ")
    for i in range(12):
        chain[(5 * i) % len(chain)] = f"link{i}"
        rows.append(data.row(3000 + i, " ".join(chain)))
    return rows + [data.row(4000 + i, "a b c d e f"[: 3 + 2 * (i % 4)]) for i in range(8)]


@pytest.mark.parametrize("often", [64, 4])
def test_classes(spark, monkeypatch, often):
    monkeypatch.setattr(near_dedup, "OFTEN", often)
    monkeypatch.setattr(near_dedup, "SHORT", 6)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = copies()
    found = near_dedup.linked(spark.createDataFrame(rows, data.SCHEMA), words_each=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == plain(rows, 4)


def test_one_of_each_class_stays(spark):
    rows = copies()
    docs = spark.createDataFrame(rows, data.SCHEMA)
    left = near_dedup.deduplicated(docs)
    expected = {(doc, size) for (doc, size, least) in plain(rows, 5) if doc == least}
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, _ in expected)
    assert near_dedup.linked(spark.createDataFrame([], data.SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(8, 60)]
    random.Random(1).shuffle(path)
    found = dict(map(tuple, graph.components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert found == {i: 100 for i in range(101, 141)} | {x: 7 for x in range(8, 60)}


def test_unequal_sets_at_the_threshold_that_meet_only_in_a_long_list(spark):
    """All 144 words of one text among the 180 of another; the 36 others come first in the order of hashes."""
    names = [f"w{i}" for i in range(6000)]
    part = next(texts.slices(pa.array(names)))
    owner, grams = near_dedup.shingle_sets(part, 1)
    names = [names[i] for i in owner[np.argsort(grams)]]
    more, both, rest = names[:36], names[36:180], names[180:]
    rows = [data.row(1, " ".join(both)), data.row(2, " ".join(more + both))]
    # 27 of the 29 values that the smaller set retains are in long lists, and one of those of the larger set
    rows += [data.row(10 + i, " ".join(both[:27] + rest[105 * i : 105 * (i + 1)])) for i in range(40)]
    found = near_dedup.linked(spark.createDataFrame(rows, data.SCHEMA), words_each=1).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == plain(rows, 1)


def test_documents_without_id_link_like_others(spark):
    rng = random.Random(12)
    near = [data.prose(rng, 100) for _ in range(3)]
    rows = [data.row(None, near[0]), data.row(1, near[0] + " tail"), data.row(None, near[1]), data.row(None, near[1] + " tail"), data.row(None, near[1]), data.row(9, near[2]), data.row(8, near[2] + " x"), data.row(None, None), data.row(None, "")]
    docs = spark.createDataFrame(rows, data.SCHEMA)
    found = near_dedup.linked(docs, words_each=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == plain(rows, 4)
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert sum(got.values()) == 5 and {(1, rows[1][1]), (8, rows[6][1]), (None, None), (None, "")} <= set(got)
    assert sum(got[None, x[1]] for x in (rows[2], rows[3])) == 1


def test_copies_in_very_many_partitions_stand_once_in_a_list(spark, monkeypatch):
    rng = random.Random(4)
    one, other = data.prose(rng, 60), data.prose(rng, 60)
    rows = [data.row(i, one if i % 3 else other) for i in range(300)] + [data.row(400, one + " tail")]
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(200)
    search = near_dedup._Search(docs, 4, 80)
    listed = search.lists().mapInArrow(near_dedup._lists(80), "a long, b long, value long, n int, share int").collect()
    assert listed and all(r["a"] != r["b"] for r in listed) and not any(r["b"] is None for r in listed)
    found = near_dedup.linked(docs, words_each=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == plain(rows, 4)


def test_memory_of_a_slice():
    """One text of 8 MB and its shingles, in the arrays that numpy holds at a time."""
    import tracemalloc

    text = " ".join(data.prose(random.Random(1), 40_000).split()) * 40
    part = next(texts.slices(pa.array([text])))
    tracemalloc.start()
    texts.hash_runs(part.data, *part.words())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)
