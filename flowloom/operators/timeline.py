"""Ordered look-back over keys of any size, and numbering, without one task per key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_latest(
    left: DataFrame, right: DataFrame, by: str, ts: str, tie: str, values: Sequence[str], block_us: int = 60_000_000
) -> DataFrame:
    """Add to each left row the ``values`` of the latest right row at or before its time.

    Rows are distributed by (key, time block), so a key with a large share of all rows is
    spread over many tasks. What was valid when a block began comes from a table with one
    row per (key, block).
    """
    block = F.expr(f"`{ts}` DIV {block_us}L")
    value = F.struct(*values)
    r = right.select(F.col(by), F.col(ts), F.col(tie).alias("_tie"), value.alias("_value"), block.alias("_block"))
    last = (
        r.groupBy(by, "_block")
        .agg(F.max(F.struct(ts, "_tie", "_value")).alias("_last"))
        .select(by, "_block", F.col("_last._value").alias("_value"))
    )
    wanted = left.select(by, block.alias("_block")).distinct().withColumn("_value", F.lit(None).cast(last.schema["_value"].dataType))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        last.unionByName(wanted)
        .groupBy(by, "_block")
        .agg(F.max("_value").alias("_value"))
        .withColumn("_carried", F.last("_value", ignorenulls=True).over(before))
        .select(by, "_block", "_carried")
    )
    l = left.withColumns({"_block": block, "_is_left": F.lit(1)})
    r = r.withColumn("_is_left", F.lit(0))
    upto = (
        Window.partitionBy(by, "_block").orderBy(ts, "_is_left", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = l.unionByName(r, allowMissingColumns=True).withColumn("_found", F.last("_value", ignorenulls=True).over(upto))
    found = merged.where("_is_left = 1").join(carried, [by, "_block"], "left")
    picked = F.coalesce("_found", "_carried")
    return found.withColumns({v: picked[v] for v in values}).drop("_block", "_is_left", "_tie", "_value", "_found", "_carried")


def numbered(df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based row numbers per group, found per bucket and shifted by the sizes of lower buckets.

    bucket: a rising function of the order with few rows per value.
    """
    groups = list(groups)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(lower), F.lit(0))).drop("_n")
    place = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_place", F.row_number().over(place))
        .join(offsets, [*groups, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_place", "_offset")
    )


_LEVELS = 48


def before_blocks(rows: DataFrame, block: str, parts: Mapping[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """For each value of ``block`` (a number, not negative) what holds of all rows in lower blocks; null where there are none.

    parts: name -> (an aggregation over rows, an aggregation that merges such results). The blocks below j are a
    few dyadic intervals, one for each bit that is set in j. Every block adds to the interval of each length that it
    lies in, and asks for those that make up its past; so all work is hashed by interval and no task sees all blocks.
    """
    names = list(parts)
    merged = [parts[n][1](n).alias(n) for n in names]
    sums = rows.groupBy(block).agg(*(parts[n][0].alias(n) for n in names))
    level = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("_level")
    each = sums.select(F.col(block).cast("bigint").alias(block), *names, level)
    node = F.expr(f"shiftright({block}, _level)")
    nodes = each.groupBy("_level", node.alias("_node")).agg(*merged)
    asked = each.where(F.expr(f"shiftright({block}, _level) & 1 = 1")).select(block, "_level", (node - 1).alias("_node"))
    past = asked.join(nodes, ["_level", "_node"]).groupBy(block).agg(*merged)
    return sums.select(F.col(block).cast("bigint").alias(block)).join(past, block, "left")


def running_sums(rows: DataFrame, order: str, span: int, columns: Mapping[str, str]) -> DataFrame:
    """Adds for each (new name -> column) the sum up to and with the row, in the order of ``order``, a number of which no two rows are equal; null adds 0.

    Rows are put in order within blocks of ``span``; what comes before a block is added by ``before_blocks``. ``rows`` is read
    twice: give a stored table where it is much work.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / span).cast("bigint"))
    parts = {f"_b_{n}": (F.sum(c), F.sum) for n, c in columns.items()}
    upto = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.join(before_blocks(rows, "_block", parts), "_block", "left")
    return found.withColumns({n: F.sum(F.coalesce(c, F.lit(0))).over(upto) + F.coalesce(f"_b_{n}", F.lit(0)) for n, c in columns.items()}).drop("_block", *parts)


def previous(rows: DataFrame, order: str, span: int, columns: Mapping[str, str]) -> DataFrame:
    """Adds for each (new name -> column) the column of the row before, in the order of ``order``; null for the first row."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / span).cast("bigint"))
    last = F.max(F.struct(order, *columns.values()))
    found = rows.join(before_blocks(rows, "_block", {"_last": (last, F.max)}), "_block", "left")
    here = Window.partitionBy("_block").orderBy(order)
    first = F.row_number().over(here) == 1
    picked = {n: F.when(first, F.col("_last")[c]).otherwise(F.lag(c).over(here)) for n, c in columns.items()}
    return found.withColumns(picked).drop("_block", "_last")
