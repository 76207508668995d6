"""Shards of nearly equal bytes by Karmarkar-Karp differencing; equal texts stay together.

Differencing works on partial partitions: one total per shard, largest first. The two with the
largest spread are combined in opposite order, the largest total of one with the smallest of the
other, until one partial partition is left. Groups of equal texts are dealt by hash into
buckets of about ``BUCKET`` groups, each differenced in a task of its own; the partial partitions
of up to ``FAN_IN`` buckets are then differenced together, level by level, until one is left.
What a task holds is bounded by these two numbers, whatever the input.

A group is one row there however many copies it has, and a group with a third of all bytes is
combined like any other (its shard then holds little else). Null texts count as empty ones; repeated
rows are copies of each other. Ties go to the group with the smaller key.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import tables

SHARDS = 16
BUCKET = 8192
FAN_IN = 1024


def difference(totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of ``totals``, each in falling order) into one.

    Returns its totals in falling order, and for each row and place the place that it went to.
    """
    n, parts = totals.shape
    sums = [row for row in totals]
    # children[i] and places[i]: what partial partition n + i was combined from, and where their places went
    children: list[tuple[int, int]] = []
    places: list[tuple[np.ndarray, np.ndarray]] = []
    heap = [(-int(row[0] - row[-1]), i) for i, row in enumerate(totals)]
    heapq.heapify(heap)
    rank = np.arange(parts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = sums[a] + sums[b][::-1]
        order = np.argsort(-joined, kind="stable")
        goes = np.empty(parts, np.int64)
        goes[order] = rank
        children.append((a, b))
        places.append((goes, goes[::-1]))
        sums[a] = sums[b] = None
        sums.append(joined[order])
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    final = np.empty((len(sums), parts), np.int64)
    final[-1] = rank
    for i in range(len(children) - 1, -1, -1):
        for child, goes in zip(children[i], places[i], strict=True):
            final[child] = final[n + i][goes]
    return sums[-1], final[:n]


def _first_level(shards: int):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        totals = np.zeros((len(groups), shards), np.int64)
        totals[:, 0] = groups["bytes"]
        _, went = difference(totals)
        return pd.DataFrame({"key": groups["key"], "bytes": groups["bytes"], "bucket": groups["bucket"], "place": went[:, 0].astype(np.int32)})

    return run


def _next_level(shards: int):
    def run(partials: pd.DataFrame) -> pd.DataFrame:
        buckets = np.sort(partials["bucket"].unique())
        totals = np.zeros((len(buckets), shards), np.int64)
        totals[np.searchsorted(buckets, partials["bucket"]), partials["place"]] = partials["bytes"]
        order = np.argsort(-totals, axis=1, kind="stable")
        _, went = difference(np.take_along_axis(totals, order, axis=1))
        to = np.empty_like(went)
        np.put_along_axis(to, order, went, axis=1)
        index = np.searchsorted(buckets, partials["bucket"])
        return partials.assign(to=to[index, partials["place"]].astype(np.int32))[["bucket", "place", "bytes", "upper", "to"]]

    return run


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each document: ``doc_id``, ``size``, ``text_crc32``, ``shard`` and its ``slot`` there."""
    text = F.coalesce("text", F.lit(""))
    files = tables.kept(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")), "shard-files")
    n = files.count()
    buckets = tables.parts_for(n, BUCKET)
    groups = files.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("bucket", tables.spread("key", parts=buckets, seed="bucket").cast("long"))
    dealt = tables.kept(groups.groupBy("bucket").applyInPandas(_first_level(shards), "key binary, bytes long, bucket long, place int"), "shard-groups")

    partials = dealt.groupBy("bucket", "place").agg(F.sum("bytes").alias("bytes"))
    way = None  # bucket, place -> place one level up
    level = buckets
    while way is None or level > 1:
        upper = partials.withColumn("upper", F.expr(f"bucket div {FAN_IN}"))
        moved = tables.kept(upper.groupBy("upper").applyInPandas(_next_level(shards), "bucket long, place int, bytes long, upper long, to int"), "shard-level")
        step = moved.select("bucket", "place", "upper", "to")
        if way is None:
            way = step.select(F.col("bucket").alias("first"), F.col("place").alias("first_place"), F.col("upper").alias("bucket"), F.col("to").alias("place"))
        else:
            way = way.join(step, ["bucket", "place"]).select("first", "first_place", F.col("upper").alias("bucket"), F.col("to").alias("place"))
        partials = moved.groupBy(F.col("upper").alias("bucket"), F.col("to").alias("place")).agg(F.sum("bytes").alias("bytes"))
        level = -(-level // FAN_IN)
    shard_of = dealt.select("key", F.col("bucket").alias("first"), F.col("place").alias("first_place")).join(way, ["first", "first_place"]).select("key", F.col("place").alias("shard"))
    placed = files.join(shard_of, "key").withColumn("__part", tables.spread("doc_id", "key", parts=tables.parts_for(n, 20_000 * shards), seed="slot"))
    return tables.running_total(placed, ["shard"], "__part", ["doc_id", "key"], F.lit(1), "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
