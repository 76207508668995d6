"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Every text becomes the statistics ``STATISTICS``, counted over the whole text.
2. A random forest of shallow trees is fitted on labelled rows; every path from a root to a node is a *rule*, a
   conjunction of limits on statistics. Limits of one statistic and side are merged; equal rules are one.
3. A logistic model with an L1 penalty weighs the rules. Several penalties are tried on ``CHECKED`` of the training
   rows; the strongest one that comes within ``SLACK`` of the best log loss is taken, and most weights are zero.
4. The rules that remain become one Spark column expression over the statistics, so scoring is a projection.

Learning uses at most ``TRAIN_DOCS`` labelled rows, those with the smallest hashes of their ids (a documented bound);
they are the only rows gathered for fitting, and Spark ML fits on them. Every document is scored.

Defined cases: null texts are empty; empty and blank texts have statistics of zero and a score like any other. Labels
are ``positive`` or not; rows without label or id teach nothing; of several labels of one id the largest counts,
and repeated documents teach as often as they occur. Without labelled rows the score is 0.5 everywhere, with one
class it is ``(n + 1) / (n + 2)`` of it. Ids may be null when scoring. Very long texts are worked on in chunks. Only the named
columns are read, so others may have any name. An empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm import tables, texts

STATISTICS = (
    "log_words", "word_length", "log_longest_word", "symbol_share", "mark_share", "upper_share", "digit_share", "bare_word_share",
    "echo_share", "distinct_share", "repeat_share", "dup_line_share", "words_per_line", "stop_share", "capital_share",
)
TRAIN_DOCS = 20_000
TREES, DEPTH, LEAF = 24, 4, 20
#: Rules that hold for fewer, or fail for fewer, of the training rows are left out.
SUPPORT = 0.002
PENALTIES = (0.01, 0.003, 0.001, 0.0003)
CHECKED, SLACK = 0.2, 1.02
SLICE = 1 << 20

_SYMBOL, _MARK, _DIGIT, _STOP, _UPPER, _LETTER = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(b"#*$%&|<>{}[]\\^~_=+@")] = True
_MARK[list(b"!?")] = True
_DIGIT[list(b"0123456789")] = True
_STOP[list(b".!?")] = True
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True


def _upper(data: np.ndarray) -> np.ndarray:
    """Upper case letters of ASCII, and those of Latin-1 by their second byte."""
    found = _UPPER[data]
    found[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    return found


def slice_statistics(part: texts.Slice) -> np.ndarray:
    """A row of ``STATISTICS`` for each document."""
    data, rows = part.data, part.rows
    starts, ends = part.words()
    doc = part.doc_of(starts)
    n_words = np.bincount(doc, minlength=rows)
    words, space = np.maximum(n_words, 1), texts.space_bytes(data)

    def chars(wanted: np.ndarray) -> np.ndarray:
        return part.count_in(wanted, part.offsets[:-1], part.offsets[1:])

    def share(marked: np.ndarray) -> np.ndarray:
        return np.bincount(doc[marked], minlength=rows) / words

    leads = ((data & 0xC0) != 0x80) & ~space
    lengths = part.count_in(leads, starts, ends)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, doc, lengths)
    visible = np.maximum(chars(leads), 1)
    letters = chars(_LETTER[data])
    upper = _upper(data)

    lower = part.lower()
    hashes = texts.hash_runs(lower, starts, ends)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    own = texts.hash_ngrams([hashes, doc.astype(texts.U)])
    first = np.zeros(len(own), bool)
    first[np.unique(own, return_index=True)[1]] = True
    at, grams = texts.ngrams(hashes, doc, 3)
    _, inverse, times = np.unique(texts.hash_ngrams([grams, doc[at].astype(texts.U)]), return_inverse=True, return_counts=True)
    repeated = np.zeros(len(hashes), bool)
    for i in range(3):
        repeated[at[times[inverse] > 1] + i] = True

    begin, stop, owner = part.lines()
    worded = part.count_in(~space, begin, stop) > 0
    begin, stop, owner = begin[worded], stop[worded], owner[worded]
    line = texts.hash_ngrams([texts.hash_runs(data, begin, stop), (stop - begin).astype(texts.U), owner.astype(texts.U)])
    again = np.ones(len(line), bool)
    again[np.unique(line, return_index=True)[1]] = False
    lines = np.maximum(np.bincount(owner, minlength=rows), 1)

    columns = [
        np.log1p(n_words),
        np.minimum(visible * (n_words > 0) / words, 100),
        np.log1p(longest),
        chars(_SYMBOL[data]) / visible,
        chars(_MARK[data]) / words,
        chars(upper) / np.maximum(letters, 1),
        chars(_DIGIT[data]) / visible,
        share(part.count_in(_LETTER[data], starts, ends) == 0),
        share(echo),
        share(first),
        share(repeated),
        np.bincount(owner[again], minlength=rows) / lines,
        np.minimum(n_words / lines, 1000),
        share(_STOP[data[ends - 1]] if len(ends) else np.zeros(0, bool)),
        share(upper[starts] | upper[np.minimum(starts + 1, max(len(data) - 1, 0))] & (data[starts] == 0xC3) if len(starts) else np.zeros(0, bool)),
    ]
    return np.stack(columns, axis=1).astype(float)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [slice_statistics(part) for part in texts.slices(batch.column(batch.num_columns - 1), SLICE)]
        if found:
            table = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(table[:, i]) for i in range(len(STATISTICS)))], names=[*batch.schema.names[:-1], *STATISTICS])


def measured(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` and the statistics of every text."""
    df = docs.select(*(c.alias(n) for n, c in keep.items()), F.col("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]]
    return df.mapInArrow(_measure, ", ".join([*fields, *(f"{s} double" for s in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """A conjunction: ``(statistic, above, limit)`` holds where the statistic is above the limit, or else at most it."""

    limits: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        parts = [F.col(s) > limit if above else F.col(s) <= limit for s, above, limit in self.limits]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>' if above else '<='} {limit:.6g}" for s, above, limit in self.limits)


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; ``score`` is the logistic function of the intercept and the weights of the rules that hold."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def merged(path: list[tuple[str, bool, float]]) -> Rule:
    """The rule of a path: of several limits of one statistic and side the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for statistic, above, limit in path:
        key = statistic, above
        tight[key] = limit if key not in tight else (max if above else min)(tight[key], limit)
    return Rule(tuple(sorted((s, above, limit) for (s, above), limit in tight.items())))


_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)$")


def paths(tree: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The rules of all nodes below the root, from the text form of a tree."""
    found, path = [], []
    for line in tree.splitlines():
        if hit := _BRANCH.match(line):
            depth = len(hit[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(hit[2])], hit[3] == ">", float(hit[4])))]
            found.append(merged([p[1] for p in path]))
    return found


def _forest_rules(rows: DataFrame) -> list[Rule]:
    ready = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, subsamplingRate=0.5, maxBins=64, seed=12).fit(ready)
    rules = {rule for tree in forest.trees for rule in paths(tree.toDebugString)}
    rules = sorted(rules, key=lambda r: r.limits)
    if not rules:
        return []
    n, *held = rows.agg(F.count("*"), *(F.count_if(r.column()) for r in rules)).first()
    return [rule for rule, k in zip(rules, held, strict=True) if SUPPORT * n <= k <= (1 - SUPPORT) * n]


def _lasso(rows: DataFrame, penalty: float):
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-4, standardization=False).fit(rows)


def _loss(model, rows: DataFrame) -> float:
    p = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = F.sum(-F.col("weight") * F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))
    return (model.transform(rows).agg(loss).first()[0] or 0.0) / max(1.0, rows.agg(F.sum("weight")).first()[0] or 0.0)


def fitted(rows: DataFrame) -> Ensemble:
    """The ensemble of a stored table of at most ``TRAIN_DOCS`` rows: the statistics, ``label`` (0.0 or 1.0) and ``checked``."""
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, n):
        return Ensemble(math.log((positive + 1) / (n - positive + 1)), ())
    rules = _forest_rules(rows)
    if not rules:
        return Ensemble(math.log((positive + 1) / (n - positive + 1)), ())
    # rows on which the same rules hold are one, with a weight; few remain, and an iteration is one small task
    flags = rows.select("label", "checked", F.concat(*(F.when(r.column(), "1").otherwise("0") for r in rules)).alias("held"))
    flags = flags.groupBy("label", "checked", "held").agg(F.count("*").cast("double").alias("weight"))
    features = array_to_vector(F.transform(F.split("held", "(?!^|$)"), lambda x: x.cast("double"))).alias("features")
    flags = tables.kept(flags.orderBy("held", "label", "checked").coalesce(1).select("label", "checked", "weight", features), "rules-flags").persist()
    try:
        teach, check = flags.filter("not checked"), flags.filter("checked")
        both = teach.agg(F.countDistinct("label")).first()[0] == 2 and len(check.take(1)) == 1
        losses = [_loss(_lasso(teach, p), check) for p in PENALTIES] if both else []
        penalty = next((p for p, x in zip(PENALTIES, losses, strict=False) if x <= SLACK * min(losses)), PENALTIES[-1])
        model = _lasso(flags, penalty)
    finally:
        flags.unpersist()
    weights = [round(float(w), 6) for w in model.coefficients]
    return Ensemble(round(float(model.intercept), 6), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def train(docs: DataFrame, labels: DataFrame, positive: Column, most_docs: int = TRAIN_DOCS) -> Ensemble:
    """``labels``: ``doc_id`` and the columns of ``positive``, null where there is no label; rows not to be learned from are left out before."""
    known = labels.select("doc_id", positive.cast("double").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = tables.kept(known.orderBy(F.xxhash64(F.lit("rules"), "doc_id"), "doc_id").limit(most_docs), "rules-labels")
    # at most TRAIN_DOCS ids
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    found = measured(rows, {"doc_id": F.col("doc_id"), "label": F.col("label")})
    # repeated documents: a bound on rows as well, and an order that is the same each time
    found = found.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*STATISTICS)))
    found = found.orderBy("__nth", F.xxhash64(F.lit("rules"), "doc_id"), "doc_id").limit(most_docs).drop("__nth")
    checked = F.pmod(F.xxhash64(F.lit("checked"), "doc_id"), F.lit(1000)) < 1000 * CHECKED
    dealt = found.withColumn("checked", checked).repartition(8, "doc_id").sortWithinPartitions("doc_id", *STATISTICS)
    return fitted(tables.kept(dealt, "rules-train"))


def scored(docs: DataFrame, ensemble: Ensemble, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep``, ``score`` and the statistics of every document."""
    found = measured(docs, keep)
    return found.select(*(F.col(f"`{n}`") for n in keep), ensemble.score().alias("score"), *STATISTICS)
