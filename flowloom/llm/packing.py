"""Harmonic packing: pieces of documents in reciprocal-capacity classes, a fixed number to a bin.

A document's tokens (byte-level BPE ids, then one end id) are cut into pieces of whole capacity;
what is left goes, from the longest on, into the class of the largest ``capacity // k`` that it
fills, up to ``CLASSES`` classes. A bin of class k takes exactly k pieces, so bins of a class are filled by counting alone, on
any number of workers; less than k tokens of a bin stay empty. The last class takes rests shorter
than ``capacity / CLASSES`` by next fit: bins close where another piece might not fit.

Of every class at most one bin is not full. Their pieces, a number that the classes bound, are
packed together by first fit decreasing; nothing grows there with the input.

Null texts are empty and hold the end id alone; repeated rows are packed each on its own.
Ids are those of the ``tokenizers`` library. Texts of plain Latin characters are encoded by
``tiktoken`` with the same vocabulary, which gives the same ids faster (tested); all other texts, and
those that spell a special token, by ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm import tables

CAPACITY = 1024
CLASSES = 64
END_ID = 0
VOCABULARY = "byte_bpe_50k"
#: Beyond these, the two libraries might split texts differently.
_UNUSUAL = re.compile("[^\t\n -~¡-ɏ–-…]|<\\|")


def _loaded(name: str, load):
    """One object for each Python worker; what is pickled with a job would be loaded anew for each task."""
    store = sys.modules.setdefault("_flowloom_llm_loaded", types.ModuleType("_flowloom_llm_loaded")).__dict__
    if name not in store:
        store[name] = load()
    return store[name]


def _fast(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _exact(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def encode(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of ``text`` and the end id."""
    if _UNUSUAL.search(text):
        ids = _loaded(f"exact {vocabulary}", lambda: _exact(vocabulary)).encode(text, add_special_tokens=False).ids
    else:
        ids = _loaded(f"fast {vocabulary}", lambda: _fast(vocabulary)).encode_ordinary(text)
    return np.array([*ids, END_ID], np.uint32)


def cuts(tokens: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of so many tokens."""
    out, start = [], 0
    while tokens - start >= capacity:
        out.append((start, capacity, 1))
        start += capacity
    while start < tokens:
        rest = tokens - start
        k = min(-(-capacity // rest), classes)
        length = min(rest, capacity // k)
        out.append((start, length, k))
        start += length
    return out


_PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, __class int{ids}"


def _cut(capacity: int, classes: int, vocabulary: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                doc_ids, texts = (batch.column(i).slice(first, 512) for i in (0, 1))
                rows, row_of, ids_of = [], [], []
                for i, text in enumerate(texts.to_pylist()):
                    ids = encode(text or "", vocabulary)
                    for start, length, k in cuts(len(ids), capacity, classes):
                        part = ids[start : start + length].tobytes()
                        rows.append((start, length, zlib.crc32(part), len(ids), k))
                        row_of.append(i)
                        if with_ids:
                            ids_of.append(ids[start : start + length].astype(np.int32))
                columns = np.array(rows, np.int64).reshape(-1, 5).T
                arrays = [doc_ids.take(pa.array(row_of, pa.int64())), *(pa.array(c) for c in columns[:4]), pa.array(columns[4].astype(np.int32))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "__class"]
                if with_ids:
                    arrays.append(pa.array(ids_of, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _last_bins(capacity: int):
    def fit(pieces: pd.DataFrame) -> pd.DataFrame:
        """First fit decreasing over the few pieces of bins that were not full."""
        pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        free: list[int] = []
        chosen, offsets = [], []
        for length in pieces["length"]:
            b = next((i for i, f in enumerate(free) if f >= length), len(free))
            if b == len(free):
                free.append(capacity)
            chosen.append(b)
            offsets.append(capacity - free[b])
            free[b] -= length
        return pieces.assign(__bin=np.array(chosen, np.int64), offset=np.array(offsets, np.int64))

    return fit


def packed(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` in that sequence, and the ``ids`` if asked for."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = _PIECES.format(id=id_type, ids=", ids array<int>" if with_ids else "")
    pieces = tables.kept(docs.select("doc_id", "text").mapInArrow(_cut(capacity, classes, vocabulary, with_ids), schema), "pieces")
    parts = tables.parts_for(pieces.count(), 50_000)
    pieces = pieces.withColumn("__part", tables.spread("doc_id", "start", "ids_crc32", parts=parts))
    order = ["doc_id", "start", "ids_crc32"]
    counted = tables.running_total(pieces.filter(F.col("__class") < classes), ["__class"], "__part", order, F.lit(1), "__n")
    size = F.expr(f"{capacity} div __class")
    counted = counted.withColumn("__bin", F.expr("__n div __class")).withColumn("offset", F.col("__n") % F.col("__class") * size)
    short = tables.running_total(pieces.filter(F.col("__class") == classes), ["__class"], "__part", order, F.col("length"), "__n")
    # a bin holds the pieces that begin in its window; each is shorter than what the window leaves free
    short = short.withColumn("__bin", F.expr(f"__n div {capacity - capacity // classes + 1}"))
    within = Window.partitionBy("__bin").orderBy("__n", F.col("length").desc())
    short = short.withColumn("offset", F.col("__n") - F.first("__n").over(within))
    numbered = tables.kept(counted.unionByName(short).drop("__n", "__part"), "packed")

    # the last bin of each class, unless it is full
    ends = numbered.groupBy("__class", "__bin").agg(F.count("*").alias("__pieces"))
    last = ends.groupBy("__class").agg(F.max(F.struct("__bin", "__pieces")).alias("l"))
    bins = last.select("__class", F.col("l.__bin").alias("__last"), ((F.col("l.__pieces") < F.col("__class")) | (F.col("__class") == classes)).alias("__open")).toPandas()
    # as many rows as classes; bins of all classes are numbered one after the other
    bins = bins.sort_values("__class", ignore_index=True)
    bins["__base"] = (bins["__last"] + 1).cumsum() - (bins["__last"] + 1)
    table = spark.createDataFrame(bins.astype({"__last": "int64", "__base": "int64"}), "__class int, __last long, __open boolean, __base long")
    placed = numbered.join(F.broadcast(table), "__class")  # at most ``classes`` rows
    left = F.col("__open") & (F.col("__bin") == F.col("__last"))
    full = placed.filter(~left).withColumn("sequence_id", F.col("__base") + F.col("__bin"))
    rest = placed.filter(left).drop("__bin", "offset").withColumn("__all", F.lit(0))
    total = int((bins["__last"] + 1).sum()) if len(bins) else 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    rest = rest.groupBy("__all").applyInPandas(_last_bins(capacity), f"{fields}, __bin long, offset long").withColumn("sequence_id", F.lit(total).cast("long") + F.col("__bin"))
    wanted = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"), *(["ids"] if with_ids else [])]
    return full.select(*wanted).unionByName(rest.select(*wanted))
