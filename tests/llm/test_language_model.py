import math
import zlib
from collections import Counter, defaultdict

import pytest

from flowloom.llm import language_model
from flowloom.llm.queries import op3_language_model
from tests.llm import data


def discounts(counts):
    n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    if min(n[:2]) <= 0:
        return [0, 0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1]]
    d.append(3 - 4 * y * n[3] / n[2] if n[2] else d[1])
    return [0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))]


class Plain:
    def __init__(self, texts):
        pairs = Counter()
        for text in texts:
            w = ["begin", *self.tokens(text)]
            pairs.update(zip(w, w[1:], strict=False))
        self.pairs, self.times, self.ways, self.context = pairs, Counter(), Counter(), defaultdict(lambda: [0, 0, 0, 0])
        for (v, w), c in pairs.items():
            self.times[w] += c
            self.ways[w] += 1
            self.context[v][0] += c
            self.context[v][min(c, 3)] += 1
        self.n, self.v, self.total = sum(self.times.values()), len(self.times), sum(self.ways.values())
        self.d1, self.d2 = discounts(self.ways.values()), discounts(pairs.values())
        self.g1 = sum(self.d1[min(c, 3)] for c in self.ways.values()) / self.total

    @staticmethod
    def tokens(text):
        return [*(w.lower() for w in data.words(text)), "end"]

    def low(self, w):
        return (self.ways[w] - self.d1[min(self.ways[w], 3)]) / self.total + self.g1 / (self.v + 1)

    def prob(self, v, w):
        if v not in self.context:
            return self.low(w)
        x, c = self.context[v], self.pairs[v, w]
        return (c - self.d2[min(c, 3)]) / x[0] + sum(self.d2[i] * x[i] for i in (1, 2, 3)) / x[0] * self.low(w)


@pytest.mark.parametrize("bucket", [16 << 20, 3000])
def test_scores(spark, monkeypatch, bucket):
    monkeypatch.setattr(language_model, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(language_model, "GATHER", 5000)
    rows = data.odd_rows()
    docs = spark.createDataFrame(rows, data.SCHEMA)
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows}
    model = Plain(r[1] for r in rows if not held[r[0]])
    trained = language_model.train(docs.filter(~language_model.held_out()))
    assert trained["n"] == model.n and trained["v"] == model.v
    found = language_model.scored(docs, trained, ["doc_id", "text"][:1]).collect()
    expected = []
    for r in rows:
        w = ["begin", *Plain.tokens(r[1])]
        base = sum(math.log10((model.times[x] + 0.1) / (model.n + 0.1 * (model.v + 1))) for x in w[1:])
        expected.append((-1 if r[0] is None else r[0], len(w) - 1, sum(model.times[x] > 0 for x in w[1:]), round(base, 4), round(sum(math.log10(model.prob(*p)) for p in zip(w, w[1:], strict=False)), 4)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4), round(r["score"], 4)) for r in found) == sorted(expected)


def test_probabilities_add_up():
    model = Plain(["a b c a b", "b c d", "a b d d"])
    for v in ("a", "b", "begin", "never"):
        assert sum(model.prob(v, w) for w in model.times) + model.prob(v, "unknown") == pytest.approx(1)


def test_held_out_texts_score_better_than_the_base(spark):
    found = op3_language_model(spark, "/root/testdata/sf0.001").filter("held_out").toPandas()
    assert found.score.sum() > found.base_score.sum()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], data.SCHEMA)
    trained = language_model.train(empty)
    assert language_model.scored(empty, trained, ["doc_id"]).count() == 0
    one = language_model.scored(spark.createDataFrame([data.row(1, "a b")], data.SCHEMA), trained, ["doc_id"]).first()
    assert one["n_tokens"] == 3 and one["score"] == 0.0
