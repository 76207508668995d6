import random
import zlib

import numpy as np

from flowloom.llm import toxicity
from flowloom.llm.queries import op1_toxicity
from tests.llm import data


def test_held_out_accuracy(spark):
    found = op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    bad, good = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.95
    assert held[held.toxic == 0].predicted.mean() < 0.03 and held[held.toxic == 1].predicted.mean() > 0.7


def planted():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w = data.prose(rng, rng.randrange(20, 80)).split(" ")
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(w) // 25):
                w[rng.randrange(len(w))] = rng.choice(["nasti", "nastily,", "NASTIER", "vilest"])
        rows.append(data.row(i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_stems_are_learnt_and_labels_of_fold_0_are_not_read(spark):
    rows, labels = planted()
    docs = spark.createDataFrame(rows, data.SCHEMA)
    wrong = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    first, second = (toxicity.scored(docs, toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")), ["doc_id"]).toPandas().set_index("doc_id").score for x in (labels, wrong))
    assert np.allclose(first.sort_index(), second.sort_index())
    truth = {i: t for i, _, t in labels}
    right = [(first[i] >= 0.5) == (truth[i] == 1) for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(right) > 0.97
    unseen = spark.createDataFrame([data.row(1, "kara lora mira nastiest " * 3), data.row(2, "kara lora mira tera " * 3)], data.SCHEMA)
    scores = toxicity.scored(unseen, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ["doc_id"]).toPandas().set_index("doc_id").score
    assert scores[1] > 0.5 > scores[2]


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame(data.odd_rows(), data.SCHEMA)
    for labels in ([], [(5, 1, 0)], [(5, None, None), (6, 1, 1), (6, 1, 0), (None, 1, 1)]):
        trained = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        found = toxicity.scored(docs, trained, ["doc_id"]).collect()
        assert len(found) == len(data.odd_rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.scored(spark.createDataFrame([], data.SCHEMA), trained, ["doc_id"]).count() == 0
