"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

Every source is a stream: its documents in shuffled (hash) order, repeated as often as the target
needs, cut into blocks of ``BLOCK`` words. The mix is a schedule of slots of one block each. Slot n
has the golden-ratio point ``frac(n * phi)``; the source whose interval of cumulative target shares holds
that point gets the slot, and the slot's rank among its source's slots says which block it takes. Any
stretch of slots so holds the sources close to their weights. The points differ
from the shares by a few slots; the schedule ends each source exactly at its target: blocks past
it are cut there, and closing slots at the end take blocks still missing.

Sizes are words. Sources in order of code points, null last, weigh 5, 2, 1, repeating. A target
stops at ``REPEATS`` times its source's size; the excess goes to the others by weight.

Null texts have no words. Documents without words are in no block, and :func:`applied` leaves them out. Repeated rows have places of
their own in the stream. A source with a third of all rows is spread over parts by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm import tables

SHARE = 1.5
REPEATS = 2
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 1024
SEED = "mix-1"
PHI = (math.sqrt(5) - 1) / 2
#: Cells of the unit interval over which points meet the sources' intervals.
CELLS = 4096
#: Slots are numbered in runs of this length; only counts of the runs meet per source.
RUN = 1 << 16
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``__source``, ``__size`` (words of the text) of each document."""
    words = F.expr(f"cast(coalesce(regexp_count(text, '{WORD}'), 0) as bigint)")
    return docs.select(*keep, F.col("source").alias("__source"), words.alias("__size"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row for each source: ``__source``, ``source_no``, ``source_size``, ``target``.

    ``sizes``: documents of :func:`sized`. Sources whose limit binds come first when sorted by limit
    over weight, so one pass over that order finds how high the others' targets rise.
    """
    sums = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())  # one row for each source
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    named = sums.withColumn("source_no", F.row_number().over(by_name) - 1)
    named = named.withColumn("weight", F.element_at(weights, F.col("source_no") % len(WEIGHTS) + 1)).withColumn("limit", F.lit(REPEATS) * F.col("source_size"))
    budget = F.least(F.lit(SHARE), F.lit(float(REPEATS))) * F.sum("source_size").over(everything)
    spent = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    level = named.withColumn("level", (budget - spent) / others).withColumn("bound", F.col("limit") <= F.col("level") * F.col("weight"))
    # past the first source whose limit does not bind the levels only fall, and none binds
    free = F.max(F.when(~F.col("bound"), F.col("level"))).over(everything)
    target = F.when(F.col("bound"), F.col("limit").cast("double")).otherwise(F.least(free * F.col("weight"), F.col("limit").cast("double")))
    return level.select("__source", "source_no", "source_size", target.alias("target"))


def streams(sizes: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """``sizes`` with its source's row and ``begin``: the word of the stream's first round at which it begins."""
    joined = sizes.join(sources, sizes["__source"].eqNullSafe(sources["__source"])).drop(sources["__source"])
    parts = tables.parts_for(rows, 20_000)
    joined = joined.withColumn("__part", tables.spread("doc_id", "__size", parts=parts, seed=SEED))
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id"), F.col("__size")]
    return tables.running_total(joined, ["source_no"], "__part", order, F.col("__size"), "begin").drop("__part")


def slots(sources: DataFrame, total: float) -> DataFrame:
    """The schedule: ``slot`` (from 0), ``source_no``, ``block`` of that source's stream."""
    spark = sources.sparkSession
    n = max(1, math.ceil(total / BLOCK))
    ordered = Window.orderBy("source_no")
    upto = F.sum("target").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(max(total, 1.0))
    ends = sources.select("source_no", "target", upto.alias("high"))
    ends = ends.withColumn("low", F.coalesce(F.lag("high").over(ordered), F.lit(0.0)))
    ends = ends.withColumn("high", F.when(F.row_number().over(Window.orderBy(F.col("source_no").desc())) == 1, F.lit(2.0)).otherwise(F.col("high")))
    # an interval lies in the cells that it touches, so points meet intervals by an equal cell
    cell = F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))))
    intervals = ends.filter(F.floor(F.col("low") * CELLS) < CELLS).select("source_no", "target", "low", "high", cell.alias("cell"))
    wide = 1 << 20
    turns = F.expr(f"id div {wide}") * F.lit((wide * PHI) % 1.0) + F.col("id") % wide * F.lit(PHI)
    points = spark.range(n).select(F.col("id").alias("slot"), (turns % 1.0).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    dealt = points.join(intervals, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    dealt = dealt.select("slot", "source_no", F.expr(f"slot div {RUN}").alias("__run"))
    ranked = tables.running_total(dealt, ["source_no"], "__run", ["slot"], F.lit(1), "block").select("slot", "source_no", F.col("block").cast("long").alias("block"))
    ranked = tables.kept(ranked, "slots")
    needed = sources.select("source_no", F.ceil(F.round("target") / BLOCK).cast("long").alias("blocks"))
    had = needed.join(ranked.groupBy("source_no").agg(F.count("*").alias("had")), "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    short = had.filter(F.col("had") < F.col("blocks"))
    before = F.coalesce(F.sum(F.col("blocks") - F.col("had")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    closing = short.withColumn("first", F.lit(n) + before).select("first", "source_no", "had", F.explode(F.expr("sequence(had, blocks - 1)")).alias("block"))
    closing = closing.select((F.col("first") + F.col("block") - F.col("had")).alias("slot"), "source_no", "block")
    return ranked.join(needed, "source_no").filter(F.col("block") < F.col("blocks")).select("slot", "source_no", "block").unionByName(closing)


def pieces(streamed: DataFrame, schedule: DataFrame) -> DataFrame:
    """The mix: for each slot the documents' words in it, ``start`` and ``length`` counted in words of the document."""
    last = F.round("target").cast("long")
    # a document comes back once for each round of its source's stream that the target reaches
    rounds = F.explode(F.expr("sequence(0L, cast(ceil(target / source_size) as bigint) - 1)"))
    docs = streamed.filter((F.col("__size") > 0) & (F.col("target") > 0)).withColumn("round", rounds)
    docs = docs.withColumn("at", F.col("begin") + F.col("round") * F.col("source_size")).withColumn("to", F.least(F.col("at") + F.col("__size"), last)).filter("at < to")
    blocks = docs.withColumn("block", F.explode(F.expr(f"sequence(at div {BLOCK}, (to - 1) div {BLOCK})")))
    low = F.greatest(F.col("at"), F.col("block") * BLOCK)
    high = F.least(F.col("to"), (F.col("block") + 1) * BLOCK)
    cut = blocks.withColumn("start", low - F.col("at")).withColumn("length", high - low)
    return cut.join(schedule, ["source_no", "block"]).select("slot", "source_no", "block", "doc_id", "begin", "round", "start", "length")


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents with ``begin``, ``source_size`` and ``target`` of their sources; and the pieces of the mix."""
    sizes = tables.kept(sized(docs, ["doc_id"]), "sizes")
    rows = sizes.count()
    sources = tables.kept(targets(sizes), "targets")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    streamed = tables.kept(streams(sizes, sources, rows), "streams")
    return streamed, pieces(streamed, slots(sources, total))


def taken(streamed: DataFrame, mix: DataFrame) -> DataFrame:
    """All documents with ``taken``: how many of their words the mix holds, repeats counted."""
    words = mix.groupBy(F.col("source_no").alias("__no"), F.col("begin").alias("__begin")).agg(F.sum("length").alias("__taken"))
    on = (F.col("source_no") == F.col("__no")) & (F.col("begin") == F.col("__begin")) & (F.col("__size") > 0)
    joined = streamed.join(words, on, "left").drop("__no", "__begin")
    return joined.withColumn("taken", F.coalesce("__taken", F.lit(0)).cast("long")).drop("__taken")


def applied(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each time that a document is taken, its text cut where its source's target ends."""
    place = Window.partitionBy("doc_id", "__hash").orderBy("begin")
    sizes = tables.kept(sized(docs.withColumn("__hash", F.xxhash64("text")), ["doc_id", "__hash"]), "sizes")
    sources = tables.kept(targets(sizes), "targets")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    streamed = tables.kept(streams(sizes, sources, sizes.count()), "streams")
    mix = pieces(streamed, slots(sources, total)).groupBy(F.col("source_no").alias("__no"), F.col("begin").alias("__begin"), "round").agg(F.sum("length").alias("__words"))
    on = (F.col("source_no") == F.col("__no")) & (F.col("begin") == F.col("__begin"))
    numbered = streamed.filter("__size > 0").withColumn("__copy", F.row_number().over(place))
    takes = numbered.join(mix, on).select(F.col("doc_id").alias("__doc"), F.col("__hash").alias("__key"), F.col("__copy").alias("__n"), "__size", "__words")
    # equal rows of one id are told apart by a number
    rows = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__row", F.row_number().over(Window.partitionBy("doc_id", "__hash").orderBy(F.lit(1))))
    joined = rows.join(takes, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__key")) & (F.col("__row") == F.col("__n")))
    cut = F.col("__words") < F.col("__size")
    words = F.expr(f"array_join(slice(regexp_extract_all(text, '{WORD}', 0), 1, cast(__words as int)), ' ')")
    taken_text = joined.withColumn("text", F.when(cut, words).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        taken_text = taken_text.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return taken_text.select(*docs.columns)
