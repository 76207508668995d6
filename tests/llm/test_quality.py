import re
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import quality
from flowloom.llm.queries import op8_quality_rules
from tests.llm import data


def counts(text):
    w = data.words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + i for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for i in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if data.words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_and_limits(spark):
    rows = data.odd_rows() + [data.row(300, "a # b $$\nc d\n\nc d\nc d e | <x>")]
    found = quality.judged(spark.createDataFrame(rows, data.SCHEMA)).collect()
    assert len(found) == len(rows)
    expected = Counter((r[0], *counts(r[1])) for r in rows)
    assert Counter((r["doc_id"], r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"]) for r in found) == expected
    for r in found:
        assert r["__base_failed"] == (r["__n_words"] < 50 or 100 * r["__n_repeat_words"] > 50 * r["__n_words"])
        assert not (r["__kept"] and r["__base_failed"])


def test_outliers_go_and_clean_texts_stay(spark):
    found = op8_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    judged = found[~found.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.3


def test_empty_table_and_columns(spark):
    empty = spark.createDataFrame([], data.SCHEMA)
    assert quality.judged(empty).count() == 0
    docs = spark.createDataFrame(data.odd_rows(), data.SCHEMA)
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert kept.exceptAll(docs).count() == 0


def plain_mcd(x, share, floors):
    """Centre, scatter and determinant by concentration steps on sorted distances, from many random starts."""
    rng, best = np.random.default_rng(5), None
    h = int(np.ceil(share * len(x)))
    for _ in range(200):
        own = x[rng.choice(len(x), 12, replace=False)]
        for _ in range(60):
            centre, scatter = own.mean(0), np.cov(own.T, bias=True)
            scatter = scatter + np.diag(np.maximum(0, np.square(floors) - np.diag(scatter)))
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            own = x[np.argsort(d, kind="stable")[:h]]
        det = np.linalg.slogdet(scatter)[1]
        if best is None or det < best[2]:
            best = centre, scatter, det
    return best


@pytest.mark.parametrize("kind", ["far cluster", "across the axis"])
def test_smallest_determinant_against_a_plain_version(spark, monkeypatch, kind):
    floors = (1e-3,) * 5
    monkeypatch.setattr(quality, "FLOORS", floors)
    rng = np.random.default_rng(7)
    mixing = np.eye(5) + np.array([[0, 0.95, 0.9, 0, 0], [0, 0, 0.9, 0.5, 0], [0, 0, 0, 0.8, 0], [0, 0, 0, 0, 0.7], [0, 0, 0, 0, 0]])
    x = rng.normal(size=(2000, 5)) @ mixing
    if kind == "far cluster":
        x[:400] = rng.normal(size=(400, 5)) * 0.2 + [9, -9, 9, -9, 9]
    else:
        x[:400] = (rng.normal(size=(400, 5)) * 0.3 + [2, -2, 2, -2, 2]) * np.array([1, 1, 1, 1, 1.5])
    rows = [("g", *map(float, v)) for v in x]
    vectors = spark.createDataFrame(rows, "__group string, " + ", ".join(f"__x{i} double" for i in range(5)))
    centre, _, det = plain_mcd(x, quality.SUPPORT, floors)
    every = quality.concentrated(vectors)
    found = quality.smallest(every).toPandas().iloc[0]
    ends = every.toPandas()
    assert sorted(ends.start) == [0, 1, 2, 3] and ends.logdet.max() > ends.logdet.min() + 0.05
    best = ends.sort_values(["logdet", "start"]).iloc[0]
    assert best.m0 == found.m0 and best.p0_1 == found.p0_1
    assert abs(best.logdet - det) < 0.1, (det, ends[["start", "logdet"]])
    assert np.abs(found[[f"m{i}" for i in range(5)]].to_numpy(float) - centre).max() < 0.35
    inverse = np.zeros((5, 5))
    for i in range(5):
        for j in range(i, 5):
            inverse[i, j] = inverse[j, i] = found[f"p{i}_{j}"]
    gap = x - found[[f"m{i}" for i in range(5)]].to_numpy(float)
    out = np.einsum("ij,jk,ik->i", gap, inverse, gap) > quality.CUTOFF
    assert out[400:].mean() < 0.01
    if kind == "far cluster":
        assert out[:400].all()


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame(data.odd_rows(), data.SCHEMA)
    for i, name in enumerate(["__group", "__x0", "m0", "p0_0", "start", "__n_words", "__row", "__kept", "a.b", "a b"]):
        docs = docs.withColumn(name, quality.F.lit(i))
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.filtered(docs.select("doc_id", "text", "lang", "source", "n_chars")).count()
