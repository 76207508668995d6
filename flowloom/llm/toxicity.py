"""Toxicity by class-conditional Kneser-Ney models.

Each class has a Kneser-Ney model of expressions, the words of its documents in lower case, that backs off
along their beginnings: the longest beginning (the whole word with its end, or a stem) whose counts in the two
classes differ from those of the next shorter one that does by ``DEVIATIONS`` standard deviations has a probability of its
class, ``(max(c - D, 0) + D T p) / N``; how the word goes on from there is shared by both classes and
cancels. Here c counts the documents of the class that hold the beginning, N all its
(document, word) pairs and T its distinct words, and p is the share of the beginning in the pooled counts: what
a class discounts it gives back in proportion to counts that both classes share. So an expression that is
rare, or as frequent in one class as in the other, says nothing, and inflected words are known by their stems.

A document's log-likelihoods under both models are divided by its number of words and compared, over all its
words and over those alone that are much likelier in the toxic class (two limits, ``STRONG``); a logistic curve over these
differences, over the same divided by the root of the number, and over the logs of the latter's sums, turns them into a
score: a long text with few toxic words is so told from one where many words say little. Counts come from the labelled rows of folds 2 to 4, the curve from those of fold 1, where
the fold is crc32(doc_id) mod 5; rows of fold 0 are never learnt from.

``TRAIN_DOCS`` bounds the labelled rows that are used; beyond it they are sampled by hash. The
model's size is so bounded and it goes to the workers with the job. Null and empty texts score as the curve's
value at no evidence. Labels that are null are left out; a document with several labels is toxic if one says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm import tables, texts

#: A beginning that differs less is not told apart from a shorter one.
DEVIATIONS = 4.0
#: Natural log of how much likelier.
STRONG = (2.0, 3.0)
#: Beginnings in fewer documents than this cannot differ so much.
LEAST = 5
TRAIN_DOCS = 20_000
DISCOUNT = 0.75
FOLDS = 5
_WORD_END = 3
_MEASURED = ("n_words", "log_ratio", "strong_ratio", "stronger_ratio")
U = np.uint64


def fold(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(1))


def beginnings(part: texts.Slice) -> tuple[np.ndarray, ...]:
    """The slice's distinct words by number: word and document of each token; then for each byte of each
    word, its end included: hash of the word so far, hash before that byte, its number in the word, the word."""
    data = part.lower()
    starts, ends = part.words()
    doc = part.doc_of(starts)
    _, first, word = np.unique(texts.hash_runs(data, starts, ends), return_index=True, return_inverse=True)
    lengths = (ends - starts)[first] + 1
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(first)), lengths)
    place = np.arange(len(owner)) - begin[owner]
    # every word with its end mark behind it
    text = np.full(len(owner), _WORD_END, np.uint8)
    inside = np.flatnonzero(place < lengths[owner] - 1)
    text[inside] = data[(starts[first][owner] + place)[inside]]
    so_far, before = texts.hash_prefixes(text, place)
    return word, doc, so_far, before, place, owner


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct beginnings of the batch's rows and how many documents of each class have them."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for part in texts.slices(batch.column(0), 4 * texts.SLICE):
            word, doc, so_far, before, place, owner = beginnings(part)
            if len(word) == 0:
                continue
            words = owner[-1] + 1
            once = np.unique(doc * words + word, return_index=True)[1]
            word, is_toxic = word[once], toxic[part.first : part.last][doc[once]]
            by_word = np.stack([np.bincount(word[is_toxic == c], minlength=words) for c in (False, True)], axis=1)
            _, first, index = np.unique(so_far, return_index=True, return_inverse=True)
            counts = [np.bincount(index, by_word[owner, c], minlength=len(first)).astype(np.int64) for c in (0, 1)]
            last = np.append(owner[1:] != owner[:-1], True)[first]
            columns = (so_far[first].view(np.int64), before[first].view(np.int64), place[first], last, *counts)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["gram", "context", "place", "whole", "ordinary", "toxic"])


def log_ratios(found: pd.DataFrame, pairs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The beginnings that tell, in order, with log P(toxic) / P(ordinary).

    ``found``: ``gram``, ``context``, ``place`` and the counts of both classes; ``pairs`` and ``words``: N and T of
    the ordinary and the toxic class.
    """
    found = found.sort_values("place", ignore_index=True)
    grams, contexts = (found[c].to_numpy(np.int64).view(U) for c in ("gram", "context"))
    counts, place = found[["ordinary", "toxic"]].to_numpy(float), found["place"].to_numpy()
    n = np.maximum(pairs, 1)
    share = np.full(len(found), n[1] / n.sum())
    telling = np.zeros(len(found), bool)
    order = np.argsort(grams)
    hit, at = _found(grams[order], contexts)
    parent = np.where(hit, order[at] if len(at) else 0, -1)
    # one length after another; a beginning takes over what its last telling part says
    edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        rows = np.arange(lo, hi)
        share[rows] = np.where(parent[rows] >= 0, share[parent[rows]], n[1] / n.sum())
        expected = counts[rows].sum(axis=1) * share[rows]
        differs = np.abs(counts[rows, 1] - expected) > DEVIATIONS * np.sqrt(expected * (1 - share[rows]) + 1)
        telling[rows] = differs
        share[rows[differs]] = counts[rows[differs], 1] / counts[rows[differs]].sum(axis=1)
    pooled = counts.sum(axis=1, keepdims=True) / n.sum()
    prob = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * np.maximum(words, 1) * pooled) / n
    order = order[telling[order]]
    return grams[order], np.log(prob[order, 1] / prob[order, 0])


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 0:
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, at


def evidence(part: texts.Slice, model: tuple[np.ndarray, ...]) -> np.ndarray:
    """Columns by document: number of words, log P(text | toxic) - log P(text | ordinary), the same of strong words for each limit."""
    word, doc, so_far, _, _, owner = beginnings(part)
    hit, at = _found(model[0], so_far)
    where = np.flatnonzero(hit)
    by_word = np.zeros(owner[-1] + 1 if len(owner) else 0)
    by_word[owner[where]] = model[1][at[where]]  # of several, the last and longest stays
    by_token = by_word[word]
    sums = [np.bincount(doc, w, minlength=part.rows) for w in (None, by_token, *(np.where(by_token > limit, by_token, 0) for limit in STRONG))]
    return np.stack(sums, axis=1).astype(float)


def _features(found: np.ndarray) -> np.ndarray:
    n, total = np.maximum(found[:, 0], 1), found[:, 1]
    columns = [np.ones(len(n)), 20 * np.clip(total / n, -5, 5), np.clip(total / np.sqrt(n), -50, 50)]
    for strong in found[:, 2:].T:
        columns += [20 * np.clip(strong / n, 0, 5), np.clip(strong / np.sqrt(n), 0, 50), np.log1p(strong)]
    return np.stack(columns, axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a ridge-regularised logistic curve, by Newton's method."""
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.1) / (len(y) - y.sum() + 0.9))
    if len(y) == 0 or y.min() == y.max():
        return w
    keep = ridge * np.append(0, np.ones(x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep * w)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measure(model: tuple[np.ndarray, ...], weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(part, model) for part in texts.slices(batch.column(batch.num_columns - 1))]
            if not found:
                continue
            found = np.concatenate(found)
            columns, names = [pa.array(found[:, 0].astype(np.int64)), *(pa.array(x) for x in found[:, 1:].T)], list(_MEASURED)
            if weights is not None:
                columns.append(pa.array(1 / (1 + np.exp(-np.clip(_features(found) @ weights, -500, 500)))))
                names.append("score")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    return run


def _measured(docs: DataFrame, keep: list[str], model: tuple, weights: np.ndarray | None) -> DataFrame:
    df = docs.select(*keep, F.col("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]]
    return df.mapInArrow(_measure(model, weights), ", ".join([*fields, "n_words long, log_ratio double, strong_ratio double, stronger_ratio double", *(["score double"] if weights is not None else [])]))


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS) -> tuple[tuple, np.ndarray]:
    """The models of both classes, and the weights of the curve."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = tables.kept(known.withColumn("fold", fold()).filter("fold > 0"), "labels")
    share = min(1.0, most_docs / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(tables.hinted(known), "doc_id")
    counted = rows.filter("fold > 1").select("text", "toxic").mapInArrow(_count, "gram long, context long, place long, whole boolean, ordinary long, toxic long")
    first = [F.min(c).alias(c) for c in ("context", "place", "whole")]
    grams = tables.kept(counted.groupBy("gram").agg(*first, F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "toxicity")
    pairs = grams.filter("place = 0").agg(F.sum("ordinary"), F.sum("toxic")).first()
    words = grams.filter("whole").agg(F.sum((F.col("ordinary") > 0).cast("int")), F.sum((F.col("toxic") > 0).cast("int"))).first()
    # bounded by the number of training rows
    found = grams.filter(F.col("ordinary") + F.col("toxic") >= LEAST).drop("whole").toPandas()
    model = log_ratios(found, *(np.array([x or 0 for x in r], float) for r in (pairs, words)))
    judged: pd.DataFrame = _measured(rows.filter("fold = 1"), ["toxic"], model, None).toPandas()
    x = _features(judged[list(_MEASURED)].to_numpy(float))
    return model, logistic(x, judged["toxic"].to_numpy(float))


def scored(docs: DataFrame, trained: tuple[tuple, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``n_words``, ``log_ratio`` and ``score`` of every document."""
    return _measured(docs, keep, *trained)
