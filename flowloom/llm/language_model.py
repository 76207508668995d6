"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays.

Tokens are lower-case words and one end per document; the context of a document's first
word is a begin mark. ``P(w | v) = max(c(v,w) - D, 0) / c(v) + g(v) P(w)``, where ``P(w)`` is the same kind
of estimate over continuation counts (how many different words came before w) and goes on to the
uniform distribution over all known tokens and one unknown token. There are three discounts per
order, for counts 1, 2 and more, estimated from counts of counts.

Counting: each task reduces its texts to distinct (context, word, count) entries packed per
bucket (a range of context hashes), so what is shuffled is a few sorted arrays for each task and bucket,
about 9 bytes for each distinct pair. One task per bucket adds them up. Contexts as frequent
as "the", found by a first pass, are spread over all buckets by the hash of the pair, and their totals added up
afterwards. The last pass adds up, by word bucket, counts and continuation counts of words.

The model is one folder below ``spark.checkpoint.dir``: per bucket a file of sorted 64-bit hashes and files
of their values; tasks that run twice write the same files again. Workers map these files into memory and look up each slice's distinct tokens
with binary search, so a worker holds pages, not a copy. Where that folder is not a mounted one, a
worker first copies the files into its own temporary folder and removes them when it ends.

Null texts are empty: their one token is the end. A corpus without training rows gives the uniform
distribution. Equal rows count each on its own.
"""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm import tables, texts
from flowloom.session import scratch_dir

U = np.uint64
END = U(0x9D39247E33776D41)
BEGIN = U(0x2AF7398005AAA5C7)
#: Text bytes for each bucket of the model.
BUCKET_BYTES = 16 << 20
#: Distinct pairs a counting task gathers before it gives them out.
GATHER = 2_000_000


def held_out(doc_id: str = "doc_id", folds: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def tokens(part: texts.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and context hash of every token, ends included, in order."""
    data = part.lower()
    starts, ends = part.words()
    doc = part.doc_of(starts)
    place = np.arange(len(starts)) + doc
    total = len(starts) + part.rows
    hashes = np.full(total, END)
    hashes[place] = texts.hash_runs(data, starts, ends)
    owner = np.repeat(np.arange(part.rows), np.bincount(doc, minlength=part.rows) + 1)
    before = np.empty(total, U)
    before[1:] = hashes[:-1]
    before[np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if total else []] = BEGIN
    return hashes, owner, before


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, their counts added up. ``keys``: one column, or two of a structured pair."""
    order = np.argsort(keys, kind="stable") if keys.ndim == 1 else np.lexsort((keys[:, 1], keys[:, 0]))
    keys, counts = keys[order], counts[order]
    differs = keys[1:] != keys[:-1] if keys.ndim == 1 else (keys[1:] != keys[:-1]).any(axis=1)
    first = np.flatnonzero(np.append(True, differs)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash."""
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _pair_buckets(contexts: np.ndarray, pairs: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs go with their context; those of hot contexts are spread over all buckets."""
    spread = np.isin(contexts, hot) if len(hot) else np.zeros(len(contexts), bool)
    return _bucket(np.where(spread, pairs, contexts), buckets)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_keys)))


def _packed_pairs(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Pairs in order of context: each context once, with its number of followers."""
    first, sizes = _runs(contexts)
    return contexts[first].tobytes(), sizes.astype(np.uint32).tobytes(), words.tobytes(), counts.astype(np.uint32).tobytes()


def _unpacked(contexts: bytes, sizes: bytes, words: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(contexts, U), np.frombuffer(sizes, np.uint32)), np.frombuffer(words, U), np.frombuffer(counts, np.uint32).astype(np.int64)


def _frequent(buckets: int):
    """Tokens that make up more than a fourth of a bucket's share of what this task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, n = np.zeros(0, U), np.zeros(0, np.int64), 0
        for batch in batches:
            for part in texts.slices(batch.column(0)):
                hashes = tokens(part)[2]
                n += len(hashes)
                found, times = np.unique(hashes, return_counts=True)
                some = times * 16 * buckets > len(hashes)
                keys, counts = _added(np.concatenate([keys, found[some]]), np.concatenate([counts, times[some]]))
        keep = counts * 4 * buckets > n
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], names=["token", "times"])

    return run


def _count_pairs(buckets: int, hot: np.ndarray):
    def emit(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, counts = _added(np.concatenate(gathered), np.ones(sum(map(len, gathered)), np.int64))
        where = _pair_buckets(pairs[:, 0], texts.hash_ngrams([pairs[:, 0], pairs[:, 1]]), hot, buckets)
        order = np.argsort(where, kind="stable")
        pairs, counts, where = pairs[order], counts[order], where[order]
        edges = np.searchsorted(where, np.arange(buckets + 1))
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if hi > lo:
                packed = _packed_pairs(pairs[lo:hi, 0], pairs[lo:hi, 1], counts[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["bucket", "contexts", "sizes", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in batches:
            for part in texts.slices(batch.column(0)):
                hashes, _, before = tokens(part)
                gathered.append(np.stack([before, hashes], axis=1))
                n += len(hashes)
                if n >= GATHER:
                    yield from emit(gathered)
                    gathered, n = [], 0
        if gathered:
            yield from emit(gathered)

    return run


def _discounts(ones: list[float]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and more from the numbers of n-grams seen one to four times."""
    n1, n2, n3, n4 = ones
    if min(n1, n2) <= 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 > 0 else d2
    return tuple(float(np.clip(d, 0.05, i + 0.95)) for i, d in enumerate((d1, d2, d3)))


class _Files:
    """Reads and writes whole files of the model's folder, wherever Spark's shared folder is."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        url = urlparse(folder)
        self.local = url.scheme in ("", "file")
        if self.local:
            self.fs, self.path = fs.LocalFileSystem(), url.path
        else:
            self.fs, self.path = fs.FileSystem.from_uri(folder)

    def write(self, name: str, array: np.ndarray) -> None:
        """Written under another name first: a task that runs twice never leaves half a file."""
        self.fs.create_dir(self.path, recursive=True)
        draft = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            out.write(array.tobytes())
        self.fs.move(draft, f"{self.path}/{name}")

    def names(self) -> set[str]:
        from pyarrow import fs

        return {f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.path))}

    def mapped(self, name: str, dtype: type) -> np.ndarray:
        path = f"{self.path}/{name}" if self.local else self._copied(name)
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)

    def _copied(self, name: str) -> str:
        store = sys.modules.setdefault("_flowloom_llm_loaded", types.ModuleType("_flowloom_llm_loaded")).__dict__
        if "folder" not in store:
            store["folder"] = tempfile.mkdtemp()
            atexit.register(shutil.rmtree, store["folder"], True)
        target = os.path.join(store["folder"], f"{abs(hash(self.path))}-{name}")
        if not os.path.exists(target):
            with self.fs.open_input_stream(f"{self.path}/{name}") as source, open(target, "wb") as out:
                shutil.copyfileobj(source, out)
        return target


def _joined(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of all tasks in one bucket, added up, in order of context and word."""
    parts = [_unpacked(*row) for row in zip(frame["contexts"], frame["sizes"], frame["words"], frame["counts"], strict=True)]
    pairs, counts = _added(np.stack([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])], axis=1), np.concatenate([p[2] for p in parts]))
    return pairs[:, 0], pairs[:, 1], counts


def _merge(folder: str, hot: np.ndarray, buckets: int):
    """Adds up one bucket, writes its pairs and contexts, and gives out what goes on.

    ``kind`` 0: per word bucket, how often its words occur and in how many contexts; 1: numbers of pairs
    seen one to four times; 2: totals of hot contexts, of which this bucket has a part.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        files, bucket = _Files(folder), int(frame["bucket"].iloc[0])
        contexts, words, counts = _joined(frame)
        pairs = texts.hash_ngrams([contexts, words])
        order = np.argsort(pairs, kind="stable")
        in_order = counts[order]
        large = np.flatnonzero(in_order >= 255)
        files.write(f"pairs-{bucket:05d}", pairs[order])
        files.write(f"counts-{bucket:05d}", np.minimum(in_order, 255).astype(np.uint8))
        files.write(f"large-{bucket:05d}", large.astype(np.int64))
        files.write(f"large-counts-{bucket:05d}", in_order[large])

        first, _ = _runs(contexts)
        sums = np.stack([np.add.reduceat(counts, first), *(np.add.reduceat((counts == i).astype(np.int64), first) for i in (1, 2)), np.add.reduceat((counts > 2).astype(np.int64), first)], axis=1)
        own = ~np.isin(contexts[first], hot)
        files.write(f"contexts-{bucket:05d}", contexts[first][own])
        files.write(f"context-sums-{bucket:05d}", sums[own].astype(np.float64))

        by_word = np.argsort(words, kind="stable")
        first_word, ways = _runs(words[by_word])
        times = np.add.reduceat(counts[by_word], first_word)
        kinds = words[by_word][first_word]
        edges = np.searchsorted(_bucket(kinds, buckets), np.arange(buckets + 1))
        rows = [(0, b, kinds[lo:hi].tobytes(), times[lo:hi].tobytes(), ways[lo:hi].astype(np.int64).tobytes()) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
        rows.append((1, 0, b"", np.array([(counts == i).sum() for i in (1, 2, 3, 4)], np.int64).tobytes(), b""))
        if not own.all():
            rows.append((2, 0, contexts[first][~own].tobytes(), sums[~own].tobytes(), b""))
        return pd.DataFrame(rows, columns=["kind", "bucket", "words", "times", "ways"])

    return run


def _merge_words(folder: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        files, bucket = _Files(folder), int(frame["bucket"].iloc[0])
        words = np.concatenate([np.frombuffer(x, U) for x in frame["words"]])
        times = np.concatenate([np.frombuffer(x, np.int64) for x in frame["times"]])
        ways = np.concatenate([np.frombuffer(x, np.int64) for x in frame["ways"]])
        order = np.argsort(words, kind="stable")
        first, _ = _runs(words[order])
        times, ways = np.add.reduceat(times[order], first), np.add.reduceat(ways[order], first)
        files.write(f"words-{bucket:05d}", words[order][first])
        files.write(f"times-{bucket:05d}", times)
        files.write(f"ways-{bucket:05d}", ways)
        return pd.DataFrame([{"v": len(first), "n": int(times.sum()), "total": int(ways.sum())} | {f"n{i}": int((ways == i).sum()) for i in (1, 2, 3, 4)} | {"more": int((ways > 2).sum())}])

    return run


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def train(docs: DataFrame, text: str = "text") -> dict:
    """Counts all rows of ``docs`` and writes the model; returns its folder and scalars."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = tables.parts_for(size, BUCKET_BYTES)
    column = docs.select(F.col(text))
    # at most a few tokens for each bucket can pass this limit
    hot = column.mapInArrow(_frequent(buckets), "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    limit = (docs.count() + size / 6) / (4 * buckets)
    hot = np.sort(np.array([r["token"] for r in hot.filter(F.col("times") > limit).collect()], np.int64).view(U))
    folder = scratch_dir(spark, "llm-lm-model")
    counted = column.mapInArrow(_count_pairs(buckets, hot), "bucket int, contexts binary, sizes binary, words binary, counts binary")
    parts = tables.kept(counted.groupBy("bucket").applyInPandas(_merge(folder, hot, buckets), "kind int, bucket int, words binary, times binary, ways binary"), "lm-words")
    # one row of four numbers for each bucket, and one of its hot contexts
    ones = np.zeros(4, np.int64)
    sums = np.zeros((len(hot), 4))
    for r in parts.filter("kind > 0").toLocalIterator():
        if r["kind"] == 1:
            ones += np.frombuffer(r["times"], np.int64)
        else:
            sums[np.searchsorted(hot, np.frombuffer(r["words"], U))] += np.frombuffer(r["times"], np.int64).reshape(-1, 4)
    columns = ("v", "n", "total", "n1", "n2", "n3", "n4", "more")
    merged = parts.filter("kind = 0").groupBy("bucket").applyInPandas(_merge_words(folder), ", ".join(f"{c} long" for c in columns))
    row = merged.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns)).first()
    d1 = _discounts([row["n1"], row["n2"], row["n3"], row["n4"]])
    g1 = (d1[0] * row["n1"] + d1[1] * row["n2"] + d1[2] * row["more"]) / row["total"] if row["total"] else 1.0
    return {"folder": folder, "buckets": buckets, "v": row["v"], "n": row["n"], "total": max(row["total"], 1), "d1": d1, "d2": _discounts(list(ones)), "g1": g1, "hot": hot, "hot_sums": sums}


class Model:
    """The mapped arrays of a model's folder."""

    def __init__(self, params: dict) -> None:
        self.params = params
        self.files = _Files(params["folder"])
        self.open: dict[str, np.ndarray] = {}
        self.present = self.files.names() if params["v"] else set()

    def _array(self, kind: str, bucket: int, dtype: type) -> np.ndarray:
        name = f"{kind}-{bucket:05d}"
        if name not in self.open:
            self.open[name] = self.files.mapped(name, dtype) if name in self.present else np.zeros(0, dtype)
        return self.open[name]

    def _find(self, keys: str, where: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per bucket: which of ``hashes`` (in order of bucket and hash) its sorted array has, and at which places."""
        edges = np.searchsorted(where, np.arange(self.params["buckets"] + 1))
        for b in np.flatnonzero(np.diff(edges)):
            known, asked = self._array(keys, b, U), hashes[edges[b] : edges[b + 1]]
            if len(known):
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = np.flatnonzero(np.asarray(known[at]) == asked)
                yield b, edges[b] + hit, at[hit]

    def word_values(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of distinct tokens in order, and their probabilities without context."""
        p = self.params
        times, ways = np.zeros(len(kinds)), np.zeros(len(kinds))
        for b, rows, at in self._find("words", _bucket(kinds, p["buckets"]), kinds):
            times[rows], ways[rows] = self._array("times", b, np.int64)[at], self._array("ways", b, np.int64)[at]
        return times, _discounted(ways, p["d1"]) / p["total"] + p["g1"] / (p["v"] + 1)

    def context_values(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of distinct contexts in order, and the share that discounting leaves for the lower order."""
        sums = np.zeros((len(contexts), 4))
        for b, rows, at in self._find("contexts", _bucket(contexts, self.params["buckets"]), contexts):
            sums[rows] = self._array("context-sums", b, np.float64).reshape(-1, 4)[at]
        hot = self.params["hot"]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
            rows = np.flatnonzero(hot[at] == contexts)
            sums[rows] = self.params["hot_sums"][at[rows]]
        total = sums[:, 0]
        return total, np.where(total > 0, sums[:, 1:] @ np.array(self.params["d2"]) / np.maximum(total, 1), 1.0)

    def pair_counts(self, where: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(pairs), np.int64)
        for b, rows, at in self._find("pairs", where, pairs):
            found = self._array("counts", b, np.uint8)[at].astype(np.int64)
            many = np.flatnonzero(found == 255)
            if len(many):
                found[many] = self._array("large-counts", b, np.int64)[np.searchsorted(self._array("large", b, np.int64), at[many])]
            counts[rows] = found
        return counts

    def log10(self, part: texts.Slice) -> pd.DataFrame:
        """Per document of the slice: tokens, known tokens, base and model log10 probability."""
        p, buckets = self.params, self.params["buckets"]
        hashes, owner, before = tokens(part)
        kinds, index = np.unique(hashes, return_inverse=True)
        times, prob = self.word_values(kinds)
        contexts, context_index = np.unique(before, return_inverse=True)
        total, left = self.context_values(contexts)
        pair = texts.hash_ngrams([before, hashes])
        where = _pair_buckets(before, pair, p["hot"], buckets)
        order = np.lexsort((pair, where))
        first, sizes = _runs(pair[order])
        counts = np.empty(len(pair))
        counts[order] = np.repeat(self.pair_counts(where[order][first], pair[order][first]), sizes)
        direct = _discounted(counts, p["d2"]) / np.maximum(total[context_index], 1)
        score = np.log10(direct + left[context_index] * prob[index])
        c = times[index]
        base = np.log10((c + 0.1) / (p["n"] + 0.1 * (p["v"] + 1)))
        add = lambda x: np.bincount(owner, x, minlength=part.rows)
        return pd.DataFrame({"n_tokens": np.bincount(owner, minlength=part.rows), "n_known": add(c > 0).astype(np.int64), "base_score": add(base), "score": add(score)})


def _score(params: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(params)
        for batch in batches:
            found = [model.log10(part) for part in texts.slices(batch.column(batch.num_columns - 1))]
            if found:
                table = pd.concat(found, ignore_index=True)
                extra = [pa.array(table[c].to_numpy()) for c in table.columns]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], *table.columns])

    return run


def scored(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the scores of every document."""
    df = docs.select(*keep, F.col(text))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]]
    return df.mapInArrow(_score(model), ", ".join([*fields, "n_tokens long, n_known long, base_score double, score double"]))
