import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.llm import rules, texts
from flowloom.llm.queries import op12_quality_classifier
from tests.llm import data

SF = "/root/testdata/sf0.1"


def plain(text):
    """Some of the statistics, character by character."""
    text = text or ""
    w = [x.decode() for x in data.words(text)]
    n = max(1, len(w))
    low = ["".join(c.lower() if c.isascii() else c for c in x) for x in w]
    grams = [tuple(low[i : i + 3]) for i in range(len(low) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if data.words(x)]
    return {
        "log_words": np.log1p(len(w)),
        "word_length": min(100, sum(map(len, w)) / n),
        "log_longest_word": np.log1p(max(map(len, w), default=0)),
        "symbol_share": sum(c in "#*$%&|<>{}[]\\^~_=+@" for c in text) / max(1, sum(map(len, w))),
        "mark_share": sum(c in "!?" for c in text) / n,
        "echo_share": sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        "distinct_share": len(set(low)) / n,
        "repeat_share": len(covered) / n,
        "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "words_per_line": min(1000, len(w) / max(1, len(lines))),
        "stop_share": sum(x[-1] in ".!?" for x in w) / n,
    }


@pytest.mark.parametrize("chunk", [texts.CHUNK, 50])
def test_statistics(monkeypatch, chunk):
    monkeypatch.setattr(texts, "CHUNK", chunk)
    rows = [r[1] for r in data.odd_rows() if len(r[1] or "") < 5000] + ["ÀB éC Àb!! x9\n\nx9 ## x9\nx9 ## x9", "\n\n", "a", "A a A a."]
    found = np.concatenate([rules.slice_statistics(p) for p in texts.slices(pa.array(rows), 400)])
    assert found.shape == (len(rows), len(rules.STATISTICS)) and np.isfinite(found).all()
    for text, row in zip(rows, found, strict=True):
        got = dict(zip(rules.STATISTICS, row, strict=True))
        for name, value in plain(text).items():
            assert got[name] == pytest.approx(value), (name, text)
    upper = dict(zip(rules.STATISTICS, found[-4], strict=True))
    assert upper["upper_share"] == pytest.approx(4 / 11) and upper["capital_share"] == pytest.approx(2 / 10)


def test_long_runs_hash_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    bytes_, cut = rng.integers(0, 256, 5000, dtype=np.uint8), np.array([0, 10, 10, 2000, 2003, 4999])
    whole = texts.hash_runs(bytes_, cut, np.append(cut[1:], 5000))
    for chunk in (1, 64, 1990):
        monkeypatch.setattr(texts, "CHUNK", chunk)
        assert (texts.hash_runs(bytes_, cut, np.append(cut[1:], 5000)) == whole).all()


def test_paths_become_rules():
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 2.5)
   If (feature 3 <= -1.0E-4)
    Predict: 0.0
   Else (feature 3 > -1.0E-4)
    Predict: 1.0
  Else (feature 0 > 2.5)
   If (feature 0 <= 7.0)
    Predict: 1.0
   Else (feature 0 > 7.0)
    Predict: 0.0
"""
    found = [str(r) for r in rules.paths(tree)]
    first, third = rules.STATISTICS[0], rules.STATISTICS[3]
    assert found == [f"{first} <= 2.5", f"{first} <= 2.5 and {third} <= -0.0001", f"{first} <= 2.5 and {third} > -0.0001", f"{first} > 2.5", f"{first} <= 7 and {first} > 2.5", f"{first} > 7"]


def test_held_out_accuracy(spark):
    found = op12_quality_classifier(spark, SF)
    held_out = {r["doc_id"]: r["held_out"] for r in found.collect()}
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held_out.items())
    held = found.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert good.predicted.mean() > 0.99 and bad.predicted.mean() < 0.05
    assert (bad.score.to_numpy()[:, None] < good.score.to_numpy()[None, :]).mean() > 0.99


def planted(n=400):
    rng = random.Random(6)
    rows = [data.row(i, data.prose(rng, rng.randrange(30, 90)) if i % 4 else "## ".join(data.prose(rng, 60).split(" "))) for i in range(n)]
    return rows, [(i, int(i % 4 > 0), 0) for i in range(n)]


def test_ensemble_is_sparse_and_compiles_to_a_projection(spark):
    rows, labels = planted()
    docs, labels = spark.createDataFrame(rows + data.odd_rows(), data.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ensemble = rules.train(docs, labels, F.col("quality") == 1)
    assert 1 <= len(ensemble.rules) <= 40
    out = rules.scored(docs, ensemble, {"doc_id": F.col("doc_id"), "kept": F.col("kept"), "score of old": F.col("size")})
    assert out.columns[:4] == ["doc_id", "kept", "score of old", "score"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PythonUDF" not in plan and "Join" not in plan
    got = out.toPandas()
    assert len(got) == len(rows) + len(data.odd_rows()) and got.score.between(0, 1).all()
    # the expression against the rules one by one
    for _, r in got.head(40).iterrows():
        total = ensemble.intercept + sum(w for rule, w in ensemble.rules if all((r[s] > limit) == above for s, above, limit in rule.limits))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)))
    again = rules.train(docs.repartition(3), labels, F.col("quality") == 1)
    assert again == ensemble


def test_few_labels(spark):
    rows, _ = planted(20)
    docs = spark.createDataFrame(rows, data.SCHEMA)
    kinds = "doc_id long, quality int"

    def scores(labels, of=docs):
        return {round(r["score"], 9) for r in rules.scored(of, rules.train(of, spark.createDataFrame(labels, kinds), F.col("quality") == 1), {}).collect()}

    assert scores([]) == {0.5} == scores([(None, 1), (3, None), (99, 0)])
    assert scores([(1, 1), (2, 1)]) == {0.75}
    assert scores([(1, 0), (2, 0), (2, 0)]) == {0.25}
    assert len(scores([(1, 0), (2, 1)])) == 1
    assert scores([(1, 1)], docs.limit(0)) == set()
