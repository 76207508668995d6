from collections import Counter, defaultdict

import pytest

from flowloom.llm import mixing
from tests.llm import data


def filled(sizes: dict) -> dict:
    """Targets by sharing again and again until none is above its limit."""
    names = sorted((k for k in sizes if k is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, rest = {}, 1.5 * sum(sizes.values())
    free = set(names)
    while True:
        share = {k: rest * weight[k] / sum(weight[x] for x in free) for k in free}
        above = {k for k in free if share[k] > 2 * sizes[k]}
        if not above:
            return target | share
        for k in above:
            target[k] = 2.0 * sizes[k]
            rest -= target[k]
        free -= above


@pytest.mark.parametrize("block", [16, 1024])
def test_targets_are_met(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = data.odd_rows()
    docs = spark.createDataFrame(rows, data.SCHEMA)
    streamed, mix = mixing.mixed(docs)
    found = mixing.taken(streamed, mix).collect()
    assert Counter((r["doc_id"], r["__size"]) for r in found) == Counter((r[0], len(data.words(r[1]))) for r in rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r["__source"]] += r["__size"]
        taken[r["__source"]] += r["taken"]
        target[r["__source"]] = r["target"]
        assert r["taken"] <= 2 * r["__size"] and r["source_size"] is not None
    assert target == pytest.approx(filled(sizes))
    assert all(abs(taken[k] - target[k]) <= 1 for k in sizes)
    again = mixing.taken(*mixing.mixed(docs)).select("doc_id", "__size", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["__size"], r["taken"]) for r in found)


def test_slots_are_unique_and_even(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', 40) AS text", "concat('s', id % 3) AS source")
    mix = mixing.mixed(docs)[1].toPandas()
    whole = mix.groupby("slot").length.sum()
    assert (whole <= 4).all() and mix.groupby("slot").source_no.nunique().max() == 1
    first = mix[mix.slot < 300].drop_duplicates("slot").source_no.value_counts(normalize=True)
    total = mix.drop_duplicates("slot").source_no.value_counts(normalize=True)
    assert (abs(first - total) < 0.03).all()


def test_documents_of_the_mix(spark):
    docs = spark.createDataFrame(data.odd_rows(), data.SCHEMA)
    mixed = mixing.applied(docs)
    assert mixed.columns == docs.columns
    size = docs.selectExpr("sum(size(split(trim(text), '[ \t\n]+')))").first()[0]
    assert abs(sum(len(data.words(r["text"])) for r in mixed.collect()) / size - 1.5) < 0.02
    empty = spark.createDataFrame([], data.SCHEMA)
    assert mixing.applied(empty).count() == 0 and mixing.taken(*mixing.mixed(empty)).count() == 0
    wordless = spark.createDataFrame([data.row(1, None), data.row(2, " ")], data.SCHEMA)
    assert [r["taken"] for r in mixing.taken(*mixing.mixed(wordless)).collect()] == [0, 0]
