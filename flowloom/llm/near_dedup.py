"""Near-duplicate classes by bottom-k sketches of word shingles, from one hash function.

A document's set holds the hashes of its distinct shingles. Of every set the smallest hashes are
retained, and one inverted list per retained value shows which sets overlap. How many are retained follows
from the set's size: ``n - ceil(t n) + 1`` values, so that two sets with Jaccard similarity t or more
have a retained value in common for certain. Values that are in very many sets come last in the order,
whatever their hash, so that a common passage makes no long lists; any order that is the same for all sets will do.

1. Texts with equal sets are one node (``set_id``, a hash of the set). Sets and sketches of the ``SKETCH``
   smallest hashes (their upper half) are worked out in one pass, which also counts values that repeat.
2. A second pass gives out retained values; lists are read in order, as a stream. Lists of up to
   ``SHORT`` sets give all their pairs; longer ones link each set with the list's ``PIVOTS`` first, those
   with the largest share of very common values: of many copies with edits of their own, the ones with fewest.
3. Pairs whose union sketch estimates a similarity of more than ``DOUBT`` standard deviations below t go.
   Each set's best pair is verified first, on whole sets; then all other pairs between different
   components, and the components in each long list with its pivot; last all pairs that long lists still hold
   between different components. So every link that could join two components is looked at, while copies
   of one text cost a number of pairs that grows with their number.

Null, empty and blank texts have no set and are linked with nothing. Repeated rows are copies. Documents without id link
like others; a class has the smallest id that there is, null if there is none. Two sets
share a 64-bit ``set_id`` by chance once in 10**19 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import graph, tables, texts

SKETCH = 128
SHORT = 24
PIVOTS = 4
DOUBT = 6.0
#: A value counts as very common from so many sets on; the most common ``COMMON`` values are put last.
OFTEN = 64
COMMON = 1_000_000
#: Sets of one part of a long list that are compared with another part in one step.
BLOCK = 1024
U = np.uint64


def shingle_sets(part: texts.Slice, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle, in order of both."""
    data = part.lower()
    starts, ends = part.words()
    doc = part.doc_of(starts)
    hashes = texts.hash_runs(data, starts, ends)
    at, grams = texts.ngrams(hashes, doc, words_each)
    owner = doc[at]
    # texts with fewer words: all of them are one shingle
    count = np.bincount(doc, minlength=part.rows)
    short = np.flatnonzero((count > 0) & (count < words_each))
    if len(short):
        first = np.cumsum(count)[short] - count[short]
        whole = [texts.hash_ngrams([hashes[f + i : f + i + 1] for i in range(c)] + [np.array([c], U)])[0] for f, c in zip(first, count[short], strict=True)]
        owner, grams = np.concatenate([owner, short]), np.concatenate([grams, np.array(whole, U)])
    key = (owner.astype(U) << U(44)) | (grams >> U(20))
    order = np.argsort(key)
    if len(order) and (np.diff(key[order]) == 0)[np.diff(grams[order]) != 0].any():  # the part of the hash in the key is not all of it
        order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1]))[: len(owner)]
    return owner[fresh], grams[fresh]


def _set_ids(owner: np.ndarray, grams: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and id of each document's set."""
    sizes = np.bincount(owner, minlength=rows)
    ids = np.zeros(rows, U)
    full = np.flatnonzero(sizes)
    if len(full):
        ids[full] = texts.hash_ngrams([np.add.reduceat(texts.mix(grams), (np.cumsum(sizes) - sizes)[full]), sizes[full].astype(U)])
    return sizes, ids


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))


_SETS = "doc_id {id}, set_id long, n long, sketch binary, value long, times long"
#: Bytes of text whose shingles a task works out at a time, and values that it counts at a time.
SLICE = 1 << 20
WINDOW = 1 << 21


def _sets(words_each: int):
    names = ["doc_id", "set_id", "n", "sketch", "value", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        kind = pa.null()

        def repeats() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            values, times = values[times > 1], times[times > 1]
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), _longs(values), _longs(times)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for part in texts.slices(batch.column(1), SLICE):
                owner, grams = shingle_sets(part, words_each)
                sizes, ids = _set_ids(owner, grams, part.rows)
                begin = np.cumsum(sizes) - sizes
                halves = (grams >> U(32)).astype(np.uint32)
                sketches = [halves[b : b + min(s, SKETCH)].tobytes() for b, s in zip(begin, sizes, strict=True)]
                n = part.rows
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, n), _longs(ids), _longs(sizes), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                # values in several different sets
                once = np.zeros(n, bool)
                once[np.unique(ids, return_index=True)[1]] = True
                waiting.append(grams[once[owner]])
                if sum(map(len, waiting)) >= WINDOW:
                    yield repeats()
        if waiting:
            yield repeats()

    return run


def _retained(words_each: int, percent: int, shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        common = shared.value
        for batch in batches:
            for part in texts.slices(batch.column(0), SLICE):
                owner, grams = shingle_sets(part, words_each)
                sizes, ids = _set_ids(owner, grams, part.rows)
                # a set that this task has given out already needs no second time
                kinds, first = np.unique(ids, return_index=True)
                first = first[np.fromiter((k not in seen for k in kinds.tolist()), bool, len(kinds)) & (sizes[first] > 0)]
                seen.update(ids[first].tolist())
                wanted = np.zeros(part.rows, bool)
                wanted[first] = True
                use = wanted[owner]
                owner, grams = owner[use], grams[use]
                sizes = np.where(wanted, sizes, 0)
                late = np.zeros(len(grams), bool)
                if len(common):
                    late = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
                # place in the order of values: those that are not very common first, then by hash
                begin = (np.cumsum(sizes) - sizes)[owner]
                lates = np.concatenate([[0], np.cumsum(late)])
                late_before = lates[:-1] - lates[begin]
                late_all = np.bincount(owner, late, minlength=part.rows).astype(np.int64)
                place = np.where(late, (sizes - late_all)[owner] + late_before, np.arange(len(owner)) - begin - late_before)
                keep = place < (sizes - -(-sizes * percent // 100) + 1)[owner]
                share = 1000 * late_all // np.maximum(sizes, 1)
                owner, grams, late = owner[keep], grams[keep], late[keep]
                columns = (pa.array(sizes[owner].astype(np.int32)), pa.array(share[owner].astype(np.int32)), pa.array(late))
                yield pa.RecordBatch.from_arrays([_longs(grams), _longs(ids[owner]), *columns], names=["value", "set_id", "n", "share", "late"])

    return run


def _lists(percent: int):
    """From entries in order of value: pairs of sets, and the entries of long lists (``b`` null)."""

    def alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(n, m).astype(np.int64) >= percent * np.maximum(n, m).astype(np.int64)

    def batch(a: np.ndarray, b: np.ndarray | None, value: np.ndarray, n: np.ndarray, share: np.ndarray) -> pa.RecordBatch:
        other = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32())] if b is not None else [pa.array(value), pa.array(n), pa.array(share)]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64()), *other], names=["a", "b", "value", "n", "share"])

    def begins(value: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (salt[1:] != salt[:-1])))

    def emit(value: np.ndarray, salt: np.ndarray, ids: np.ndarray, n: np.ndarray, share: np.ndarray, pivots: tuple | None) -> Iterator[pa.RecordBatch]:
        """``pivots``: of the first list, if it has begun before."""
        first = begins(value, salt)
        size = np.diff(np.append(first, len(value)))
        run = np.repeat(np.arange(len(first)), size)
        long = (size[run] > SHORT) | (salt >= 0)
        if pivots is not None:
            long[run == 0] = True
        found = []
        for step in range(1, SHORT):
            at = np.flatnonzero((run[step:] == run[:-step]) & ~long[step:])
            at = at[alike(n[at], n[at + step])]
            found.append((ids[at], ids[at + step]))
        rows = np.flatnonzero(long)
        for k in range(PIVOTS if len(rows) else 0):
            at = first[run[rows]] + np.minimum(k, size[run[rows]] - 1)
            pivot, pivot_n = ids[at], n[at]
            if pivots is not None:
                begun = run[rows] == 0
                pivot, pivot_n = np.where(begun, pivots[0][k], pivot), np.where(begun, pivots[1][k], pivot_n)
            ok = (pivot != ids[rows]) & alike(pivot_n, n[rows])
            found.append((pivot[ok], ids[rows][ok]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        if len(both):
            yield batch(both[:, 0], both[:, 1], *[np.zeros(0)] * 3)
        if len(rows):
            yield batch(ids[rows], None, value[rows], n[rows], share[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        pivots = None  # of the list in ``rest``, if part of it has been given out
        for record in batches:
            columns = tuple(record.column(i).to_numpy() for i in range(5))
            if rest is not None:
                columns = tuple(np.concatenate(x) for x in zip(rest, columns, strict=True))
            # tasks that hold copies of one text give out the same entries, which stand side by side
            again = np.zeros(len(columns[0]), bool)
            again[1:] = (columns[0][1:] == columns[0][:-1]) & (columns[2][1:] == columns[2][:-1])
            columns = tuple(x[~again] for x in columns)
            if len(columns[0]) == 0:
                continue
            # the last list may go on in the next batch
            start = int(begins(*columns[:2])[-1])
            if start:
                yield from emit(*(x[:start] for x in columns), pivots)
                pivots = None
            rest = tuple(x[start:] for x in columns)
            if len(rest[0]) > 1 << 14:
                # of a very long list all but one entry, which stands for its value
                known = pivots or (rest[2][:PIVOTS].copy(), rest[3][:PIVOTS].copy())
                yield from emit(*(x[:-1] for x in rest), known)
                rest, pivots = tuple(x[-1:] for x in rest), known
        if rest is not None and len(rest[0]):
            yield from emit(*rest, pivots)

    return run


def _likely(x: np.ndarray, others: list[np.ndarray], totals: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of the set of sketch ``x`` to others, and whether it may be so high; ``totals``: sums of both sizes."""
    t, top = percent / 100, U(1) << U(32)
    lengths = np.array([len(y) for y in others])
    every = np.concatenate(others)
    owner = np.repeat(np.arange(len(others)), lengths)
    last = np.where(lengths < SKETCH, top, every[np.cumsum(lengths) - 1].astype(U))
    limit = np.minimum(last, x[-1] if len(x) == SKETCH else top)  # below it both sketches are whole
    at = np.minimum(np.searchsorted(x, every), len(x) - 1)
    common = np.bincount(owner, x[at] == every, minlength=len(others))
    seen = np.searchsorted(x, limit, side="right") + np.bincount(owner, every <= limit[owner], minlength=len(others)) - common
    # of the union of two sets with similarity t, so much is not seen
    unseen = np.maximum(0.0, 1 - seen / (totals / (1 + t)))
    return common / seen, common / seen >= t - 0.01 - DOUBT * np.sqrt(t * (1 - t) * unseen / seen)


def _estimate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y, total in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                found.append(_likely(x, [y], np.array([total]), percent))
            estimates, keep = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0, bool))
            columns = [batch.column(0), batch.column(1), pa.array(estimates, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in columns], names=["a", "b", "estimate"])

    return run


def _full(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch.column(0), SLICE):
                owner, grams = shingle_sets(part, words_each)
                sizes, ids = _set_ids(owner, grams, part.rows)
                begin = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([_longs(ids), pa.array([grams[b : b + s].tobytes() for b, s in zip(begin, sizes, strict=True)], pa.binary())], names=["id", "grams"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


class _Search:
    def __init__(self, docs: DataFrame, words_each: int, percent: int) -> None:
        self.docs, self.words_each, self.percent = docs.select("doc_id", "text"), words_each, percent
        id_type = docs.schema["doc_id"].dataType.simpleString()
        found = tables.kept(self.docs.mapInArrow(_sets(words_each), _SETS.format(id=id_type)), "sets")
        self.sets = found.filter("times IS NULL").select("doc_id", "set_id", "n", "sketch")
        self.repeats = found.filter("times IS NOT NULL").select("value", "times")
        # one row for each different set
        self.sketches = self.sets.filter("n > 0").groupBy("set_id").agg(F.min("sketch").alias("sketch"), F.min("n").alias("size"))

    def lists(self) -> DataFrame:
        often = self.repeats.groupBy("value").agg(F.sum("times").alias("times")).filter(F.col("times") >= OFTEN)
        common = np.sort(often.orderBy(F.desc("times"), "value").limit(COMMON).select("value").toPandas()["value"].to_numpy(np.int64).view(U))
        shared = self.docs.sparkSession.sparkContext.broadcast(common)
        entries = self.docs.select("text").mapInArrow(_retained(self.words_each, self.percent, shared), "value long, set_id long, n int, share int, late boolean")
        # lists of very common values are dealt to several tasks, and count as long in each
        salt = F.when(F.col("late"), F.pmod("set_id", F.lit(16))).otherwise(-1)
        dealt = entries.select("value", salt.cast("int").alias("salt"), "set_id", "n", "share").repartition("value", "salt")
        return dealt.sortWithinPartitions("value", "salt", F.desc("share"), "n", "set_id")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        x = self.sketches.select(F.col("set_id").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("nx"))
        y = self.sketches.select(F.col("set_id").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("ny"))
        joined = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("total"))
        return joined.mapInArrow(_estimate(self.percent), "a long, b long, estimate double")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (stored) whose whole sets are similar enough."""
        needed = pairs.select(F.col("a").alias("set_id")).distinct().unionByName(pairs.select(F.col("b").alias("set_id")).distinct()).distinct()
        rows = tables.kept(self.sets.join(needed, "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "needed")
        whole = self.docs.join(tables.hinted(rows.select("doc_id").filter("doc_id IS NOT NULL"), 1_000_000), "doc_id").select("text")
        unnamed = rows.filter("doc_id IS NULL").select(F.col("set_id").alias("id"))
        schema = "id long, grams binary"
        full = whole.mapInArrow(_full(self.words_each), schema)
        if unnamed.take(1):
            # sets of which no row has an id are looked for in all texts without id
            without = self.docs.filter("doc_id IS NULL").select("text").mapInArrow(_full(self.words_each), schema)
            full = full.unionByName(without.join(unnamed, "id", "left_semi"))
        full = tables.kept(full.dropDuplicates(["id"]), "full-sets")
        x = full.select(F.col("id").alias("a"), F.col("grams").alias("x"))
        y = full.select(F.col("id").alias("b"), F.col("grams").alias("y"))
        met = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return tables.kept_in_small_batches(met.mapInArrow(_exact(self.percent), "a long, b long"), "verified")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose sets are in different components."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def _cross(percent: int):
    """From two parts of the sets of one pivot: likely pairs between different components."""

    def run(met: pd.DataFrame) -> pd.DataFrame:
        out = []
        left, right = met[met["part"] == met["high"]], met[met["part"] == met["low"]].sort_values("n")
        n = right["n"].to_numpy(np.int64)
        ids, roots, own = (right[c].to_numpy(np.int64) for c in ("a", "root", "own"))
        sketches = [np.frombuffer(v, np.uint32) for v in right["sketch"]]
        for a, root, size, mine, sketch in zip(left["a"], left["root"], left["n"], left["own"], left["sketch"], strict=True):
            lo, hi = np.searchsorted(n, -(-size * percent // 100)), np.searchsorted(n, size * 100 // percent, side="right")
            both = size + n[lo:hi]
            shared = -(-percent * both // (100 + percent))  # at least so many values in both sets
            at = lo + np.flatnonzero((roots[lo:hi] != root) & ((mine <= size - shared) | (own[lo:hi] <= n[lo:hi] - shared)))
            if len(at):
                at = at[_likely(np.frombuffer(sketch, np.uint32), [sketches[i] for i in at], size + n[at], percent)[1]]
                out.append(np.stack([np.minimum(a, ids[at]), np.maximum(a, ids[at])], axis=1))
        both = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame(both, columns=["a", "b"])

    return run


def _rooted(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))


def _pivot_pairs(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """In each long list, of every component one set, with the pivot of all: as many pairs as there are components."""
    one = _rooted(entries, roots).groupBy("value", "root").agg(F.max(F.struct("share", "a")).alias("r"))
    pivots = one.groupBy(F.col("value").alias("v")).agg(F.max("r").alias("p"))
    met = one.join(pivots, F.col("value") == F.col("v")).filter("r.a != p.a")
    return met.select(F.least("r.a", "p.a").alias("a"), F.greatest("r.a", "p.a").alias("b")).distinct()


def _long_pairs(entries: DataFrame, sketches: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Likely pairs that long lists hold between different components.

    Lists of one pivot have mostly the same sets and become one. If all its sets are in one component nothing is
    left of it; others are cut into parts by hash, and each two parts meet in a task of their own. A set's retained values that
    are in no long list are its ``own``: sets that retain one of them in common met in its short list. Of two sets that
    did not, the one whose last retained value comes first in the order has its own values alone: what the other set
    holds of them it would retain too. The other's own values may lie beyond, and be shared. Which set comes first is
    not known here, so a pair goes only if both sets have more own values than the similarity leaves to one alone.
    """
    own = entries.groupBy(F.col("a").alias("id")).agg(F.first("n").alias("n"), F.count("*").alias("listed"))
    own = own.select("id", "n", (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("listed")).cast("long").alias("own"))
    pivots = entries.groupBy(F.col("value").alias("v")).agg(F.max(F.struct("share", "a")).alias("p"))
    members = entries.join(pivots, F.col("value") == F.col("v")).select(F.col("p.a").alias("pivot"), "a").distinct()
    members = _rooted(members, roots)
    mixed = members.groupBy(F.col("pivot").alias("key")).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).filter("r0 != r1")
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("int")
    members = members.join(mixed.select("key", parts.alias("parts")), F.col("pivot") == F.col("key"))
    members = members.join(own, F.col("a") == F.col("id")).drop("id").join(sketches.select("set_id", "sketch"), F.col("a") == F.col("set_id"))
    members = members.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = members.select("pivot", F.greatest("part", "other").alias("high"), F.least("part", "other").alias("low"), "part", "a", "root", "n", "own", "sketch")
    return met.groupBy("pivot", "high", "low").applyInPandas(_cross(percent), "a long, b long").distinct()


def _classed(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """For each document ``doc_id``, ``set_id``, ``n``, ``class`` and the smallest doc_id of the class; without words the class is null."""
    search = _Search(docs, words_each, percent)
    found = tables.kept(search.lists().mapInArrow(_lists(percent), "a long, b long, value long, n int, share int"), "lists")
    entries = found.filter("b IS NULL").select("a", "value", "n", "share")
    likely = tables.kept(search.estimated(found.filter("b IS NOT NULL").select("a", "b").distinct()), "likely")

    def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        more = search.verified(tables.kept(pairs.select("a", "b").distinct(), "pairs"))
        return graph.components(more.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))

    best = likely.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a"))
    roots = graph.components(search.verified(tables.kept(best.select("a", "b"), "pairs")))
    roots = joined(roots, _between(likely.select("a", "b"), roots).unionByName(search.estimated(_pivot_pairs(entries, roots)).select("a", "b")))
    roots = joined(roots, _long_pairs(entries, search.sketches, roots, percent))

    members = search.sets.select("doc_id", "set_id", "n").join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
    members = members.withColumn("class", F.coalesce("root", "set_id")).drop("root")
    names = members.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    empty = members.filter("n = 0").withColumn("class", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return members.filter("n > 0").join(names, "class").unionByName(empty)


def linked(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id of its class."""
    return _classed(docs, words_each, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _with_set(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_set_ids(*shingle_sets(part, words_each), part.rows) for part in texts.slices(batch.column(batch.num_columns - 1), SLICE)]
            if found:
                sizes, ids = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _longs(ids), _longs(sizes)], names=[*batch.schema.names[:-1], "set_of_row", "size_of_set"])

    return run


def _unnamed(docs: DataFrame, found: DataFrame, words_each: int) -> DataFrame:
    """Of the documents without id those that stay: without words, or the first of a class in which no document has an id."""
    rows = docs.filter("doc_id IS NULL").select(F.struct(*docs.columns).alias("row"), "text")
    rows = rows.mapInArrow(_with_set(words_each), f"row {rows.schema['row'].dataType.simpleString()}, set_of_row long, size_of_set long")
    classes = found.filter("class IS NOT NULL AND component_id IS NULL").select(F.col("set_id").alias("set_of_row"), "class").distinct()
    first = rows.filter("size_of_set > 0").join(classes, "set_of_row").dropDuplicates(["class"])
    return first.select("row.*").unionByName(rows.filter("size_of_set = 0").select("row.*"))


def deduplicated(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have another of their class with a smaller id; of rows with one id, one stays,
    and of a class without any id one document."""
    found = tables.kept(_classed(docs, words_each, percent), "classes")
    gone = tables.kept(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    left = docs.join(tables.hinted(gone, 1_000_000), "doc_id", "left_anti")
    rows, named, ids = found.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if named == ids == rows:
        return left
    once = left.filter("doc_id IS NOT NULL")
    once = once if named == ids else once.dropDuplicates(["doc_id"])
    return once if named == rows else once.unionByName(_unnamed(docs, found, words_each))
