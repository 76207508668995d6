"""Near-equal lines by segment partition, and texts without their repeats.

Lines (texts split at ``\\n``) of at least ``words`` words are compared, by default ``WORDS``; shorter ones stay. With
``EVERY``, as the query and the pipeline have it, these are all but blank lines, also those of scripts that
put no spaces between words. Two lines are near if ``EDITS`` or fewer insertions, deletions or
substitutions of bytes of their UTF-8 form turn one into the other; lines below ``EXACT_BELOW`` bytes are near only
if they are equal. Classes are what links of near lines connect.

Every distinct line of l bytes is cut into ``EDITS + 1`` segments, of which at least one stays whole within
so few edits. Segments are indexed by (l, number, hash). A line looks up, for each length that a
near and not longer line can have, those of its substrings that can be that line's segment: around
the segment's place, as far as the edits before and after it allow. Index entries and look-ups meet in lists that are
read in order as a stream; entries carry counts of bytes in 16 bins, and pairs whose counts differ by more
than so many edits can are left out. The rest is verified by banded bit-parallel edit distance on the lines themselves.

Lists of more than ``LONG`` entries (a template with a counter) come last. For classes each of their lines is compared with
the list's ``PIVOTS`` first; then only lines of different classes are, so that a list whose lines are one class by
then is not looked at again. Long lists are cut into parts and each two parts meet in a task of their own.

Equal lines are one node, however many. Null and empty texts have no lines; a text of which every line repeats
earlier ones is left empty. Rows with equal id and text are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import graph, tables, texts

EDITS = 2
WORDS = 5
#: For ``words``: every line that is not blank.
EVERY = 1
EXACT_BELOW = 32
LONG = 2048
PIVOTS = 4
#: A line with more than this share of all lines is joined by a broadcast; there are at most 1 / HOT of them.
HOT = 1e-4
#: Pairs looked at together in memory.
CHUNK = 1 << 20
U = np.uint64
_BIN = (np.arange(256) * 7 ^ np.arange(256) >> 4) & 15
_FACTOR = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def near(a: bytes, b: bytes, edits: int = EDITS) -> bool:
    """Whether so few edits turn ``a`` into ``b``.

    Bit x of ``reach[d]`` stands for the diagonal ``x - edits``: set if d edits or fewer lead to its cell in the
    present column. Only diagonals within the band can lie on a way of so few edits.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    band = (1 << (2 * edits + 1)) - 1
    reach = [((1 << (d + 1)) - 1) << edits for d in range(edits + 1)]  # deletions alone
    for j, byte in enumerate(b, 1):
        same = 0
        allowed = 0
        for x in range(2 * edits + 1):
            i = j - edits + x
            if 0 <= i <= len(a):
                allowed |= 1 << x
                if i > 0 and a[i - 1] == byte:
                    same |= 1 << x
        before = reach
        reach = [before[0] & same & allowed]
        for d in range(1, edits + 1):
            reach.append((before[d] & same | before[d - 1] | before[d - 1] >> 1 | reach[d - 1] << 1) & band & allowed)
        if not reach[edits]:
            return False
    return bool(reach[edits] >> (len(a) - len(b) + edits) & 1)


def trimmed_near(a: bytes, b: bytes, edits: int = EDITS) -> bool:
    """:func:`near` without the part that both begin and end with."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    front = np.flatnonzero(x[:n] != y[:n])
    if len(front) == 0:
        return abs(len(a) - len(b)) <= edits
    start = int(front[0])
    back = np.flatnonzero(x[::-1][: n - start] != y[::-1][: n - start])
    stop = int(back[0]) if len(back) else n - start
    return near(a[start : len(a) - stop], b[start : len(b) - stop], edits)


def _lines(part: texts.Slice, words: int) -> tuple[np.ndarray, ...]:
    """Start, end, document and number there of the lines that are compared, and their ids."""
    starts, ends, doc = part.lines()
    first = np.searchsorted(doc, np.arange(part.rows))
    number = np.arange(len(doc)) - first[doc]
    begins, _ = part.words()
    enough = np.searchsorted(begins, ends) - np.searchsorted(begins, starts) >= words
    starts, ends = starts[enough], ends[enough]
    return starts, ends, doc[enough], number[enough], texts.hash_runs(part.data, starts, ends) & ~U(1)


def _occurrences(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch.column(2)):
                _, _, doc, number, ids = _lines(part, words)
                at = pa.array(doc + part.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number), pa.array(ids.view(np.int64))], names=["doc_id", "text_hash", "number", "line"])

    return run


def _bins(part: texts.Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts modulo 16 of bytes in 16 bins, four bits each."""
    lengths = ends - starts
    owner = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)
    counts = np.bincount(owner * 16 + _BIN[part.data[at]], minlength=16 * len(starts)).reshape(-1, 16)
    return ((counts & 15).astype(U) << (np.arange(16, dtype=U) * U(4))).sum(axis=1, dtype=U)


def _segments(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and length of a segment in lines of so many bytes; the last ones are one longer if need be."""
    each, more = length // (edits + 1), length % (edits + 1)
    late = np.maximum(0, number - (edits + 1 - more))
    return each * number + late, each + (number >= edits + 1 - more)


def _entries(edits: int, words: int):
    def keys(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, number: int) -> np.ndarray:
        content = (sums[start + size] - sums[start]) * inverse[start]
        return texts.hash_ngrams([content, length.astype(U) * U(16) + U(number)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U)
        for batch in batches:
            for part in texts.slices(batch.column(0), texts.SLICE // 2):
                starts, ends, _, _, ids = _lines(part, words)
                kinds, first = np.unique(ids, return_index=True)
                first = first[(ends - starts)[first] >= EXACT_BELOW]
                first = first[~np.isin(ids[first], seen)]
                seen = np.union1d(seen, ids[first])
                starts, ends, ids = starts[first], ends[first], ids[first]
                if len(ids) == 0:
                    continue
                order = np.argsort(starts)
                starts, ends, ids = starts[order], ends[order], ids[order]
                length = ends - starts
                bins = _bins(part, starts, ends)
                powers = np.empty(len(part.data) + 1, U)
                powers[0] = 1
                powers[1:] = _FACTOR
                powers = np.multiply.accumulate(powers)
                inverse = np.empty(len(part.data) + 1, U)
                inverse[0] = 1
                inverse[1:] = _INVERSE
                inverse = np.multiply.accumulate(inverse)
                sums = np.zeros(len(part.data) + 1, U)
                np.cumsum((part.data.astype(U) + U(1)) * powers[:-1], out=sums[1:])
                out = []
                for i in range(edits + 1):
                    place, size = _segments(length, i, edits)
                    out.append((keys(sums, inverse, starts + place, size, length, i), ids, bins))
                    for shorter in range(edits + 1):
                        place, size = _segments(length - shorter, i, edits)
                        for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                            ok = (place + shift >= 0) & (place + shift + size <= length)
                            at = np.flatnonzero(ok)
                            out.append((keys(sums, inverse, (starts + place + shift)[at], size[at], (length - shorter)[at], i), ids[at] | U(1), bins[at]))
                for group in out:
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in group], names=["key", "entry", "bins"])

    return run


def _close(x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    """Whether bin counts allow so few edits: a substitution moves one byte between two bins."""
    total = np.zeros(len(x), np.int64)
    for k in range(16):
        d = ((x >> U(4 * k)) - (y >> U(4 * k))) & U(15)
        total += np.minimum(d, U(16) - d).astype(np.int64)
    return total <= 2 * edits


def _met(key: np.ndarray, entry: np.ndarray, bins: np.ndarray, edits: int) -> Iterator[np.ndarray]:
    """Pairs of an index entry (even) and a look-up (odd) of one key whose counts are close. Entries are in order of key."""
    odd = (entry & U(1)).astype(bool)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    index, probe = np.flatnonzero(~odd), np.flatnonzero(odd)
    begin, stop = np.searchsorted(run[index], run[probe]), np.searchsorted(run[index], run[probe], side="right")
    many = stop - begin
    upto = np.cumsum(many)
    lo = 0
    while lo < len(probe):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, side="right")))
        count = many[lo:hi]
        p = np.repeat(probe[lo:hi], count)
        i = index[np.arange(len(p)) - np.repeat(np.cumsum(count) - count - begin[lo:hi], count)]
        a, b = entry[i], entry[p] & ~U(1)
        keep = np.flatnonzero(a != b)
        keep = keep[_close(bins[i[keep]], bins[p[keep]], edits)]
        if len(keep):
            yield np.unique(np.stack([np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])], axis=1), axis=0)
        lo = hi


def _pairs(edits: int):
    """From entries in order of key: pairs, and the entries of long lists (``key`` not null)."""

    def long(*columns: np.ndarray) -> pa.RecordBatch:
        key, entry, bins = (pa.array(x.view(np.int64)) for x in columns)
        return pa.RecordBatch.from_arrays([entry, entry, key, bins], names=["a", "b", "key", "bins"])

    def emit(key: np.ndarray, entry: np.ndarray, bins: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        ids = entry & ~U(1)
        alone = np.minimum.reduceat(ids, first) == np.maximum.reduceat(ids, first)  # a line's own entries
        use = np.repeat((size <= LONG) & ~alone, size)
        for both in _met(key[use], entry[use], bins[use], edits) if use.any() else ():
            n = len(both)
            yield pa.RecordBatch.from_arrays([*(pa.array(both[:, c].view(np.int64)) for c in (0, 1)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["a", "b", "key", "bins"])
        many = np.repeat(size > LONG, size)
        if many.any():
            yield long(key[many], entry[many], bins[many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        open_key = None  # of a long list that has begun to be given out
        for batch in batches:
            columns = tuple(batch.column(i).to_numpy().view(U) for i in range(3))
            if rest is not None:
                columns = tuple(np.concatenate(x) for x in zip(rest, columns, strict=True))
            rest = None
            if open_key is not None and len(columns[0]):
                other = np.flatnonzero(columns[0] != open_key)
                own = int(other[0]) if len(other) else len(columns[0])
                if own:
                    yield long(*(x[:own] for x in columns))
                open_key = None if len(other) else open_key
                columns = tuple(x[own:] for x in columns)
            key = columns[0]
            if len(key) == 0:
                continue
            start = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            if start:
                yield from emit(*(x[:start] for x in columns))
            rest = tuple(x[start:] for x in columns)
            if len(rest[0]) > LONG:
                yield long(*rest)
                open_key, rest = rest[0][0], None
        if rest is not None:
            yield from emit(*rest)

    return run


def _met_in_parts(edits: int):
    def run(met: pd.DataFrame) -> pd.DataFrame:
        met = met.sort_values("key", kind="stable")
        columns = [met[c].to_numpy(np.int64).view(U) for c in ("key", "entry", "bins")]
        found = list(_met(*columns, edits))
        both = np.unique(np.concatenate(found), axis=0).view(np.int64) if found else np.zeros((0, 2), np.int64)
        if "root" in met.columns and len(both):
            lines, at = np.unique(met["entry"].to_numpy(np.int64) & ~1, return_index=True)
            roots = met["root"].to_numpy(np.int64)[at]
            both = both[roots[np.searchsorted(lines, both[:, 0])] != roots[np.searchsorted(lines, both[:, 1])]]
        return pd.DataFrame(both, columns=["a", "b"])

    return run


def _long_pairs(entries: DataFrame, edits: int) -> DataFrame:
    """Pairs that long lists hold; with a column ``root`` only those of different roots."""
    counts = entries.groupBy("key").agg(F.ceil(F.count("*") / (2 * LONG)).cast("int").alias("parts"))
    parted = entries.join(counts, "key").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
    met = parted.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rooted = ["root"] if "root" in entries.columns else []
    met = met.select("key", F.greatest("part", "other").alias("high"), F.least("part", "other").alias("low"), "entry", "bins", *rooted)
    return met.groupBy("key", "high", "low").applyInPandas(_met_in_parts(edits), "a long, b long")


def _pivot_pairs(entries: DataFrame) -> DataFrame:
    """Every line of a long list with the first few of the list."""
    line = F.expr("entry & ~1L")
    # the first few of each of 64 parts, then of these
    parts = entries.groupBy("key", F.pmod(F.xxhash64("entry"), F.lit(64)).alias("part")).agg(F.min(line).alias("low"))
    pivots = parts.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("low")), 1, PIVOTS).alias("pivots"))
    met = entries.select("key", line.alias("x")).distinct().join(pivots, "key").select("x", F.explode("pivots").alias("p")).filter("x != p")
    return met.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct()


def _line_texts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch.column(0)):
                starts, ends, _, _, ids = _lines(part, words)
                _, first = np.unique(ids, return_index=True)
                data = part.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids[first].view(np.int64)), pa.array([data[s:e] for s, e in zip(starts[first], ends[first], strict=True)], pa.binary())], names=["line", "bytes"])

    return run


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [trimmed_near(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _candidates(docs: DataFrame, edits: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of short lists, and the entries of long ones."""
    entries = docs.select("text").mapInArrow(_entries(edits, words), "key long, entry long, bins long")
    ordered = entries.repartition("key").sortWithinPartitions("key")
    found = tables.kept(ordered.mapInArrow(_pairs(edits), "a long, b long, key long, bins long"), "line-pairs")
    return found.filter("key IS NULL").select("a", "b"), found.filter("key IS NOT NULL").select("key", F.col("a").alias("entry"), "bins")


def _verified(docs: DataFrame, pairs: DataFrame, edits: int, words: int) -> DataFrame:
    pairs = tables.kept(pairs.distinct(), "line-pairs")
    needed = tables.kept(pairs.select(F.col("a").alias("line")).distinct().unionByName(pairs.select(F.col("b").alias("line")).distinct()).distinct(), "needed")
    lines = docs.select("text").mapInArrow(_line_texts(words), "line long, bytes binary").join(tables.hinted(needed, 1_000_000), "line").dropDuplicates(["line"])
    lines = tables.kept(lines, "line-texts")
    x = lines.select(F.col("line").alias("a"), F.col("bytes").alias("x"))
    y = lines.select(F.col("line").alias("b"), F.col("bytes").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return tables.kept_in_small_batches(met.mapInArrow(_verify(edits), "a long, b long"), "line-links")


def links(docs: DataFrame, edits: int = EDITS, words: int = WORDS) -> DataFrame:
    """All pairs ``a < b`` of ids of different lines within so many edits."""
    short, entries = _candidates(docs, edits, words)
    return _verified(docs, short.unionByName(_long_pairs(entries, edits)), edits, words)


def components(docs: DataFrame, edits: int = EDITS, words: int = WORDS) -> DataFrame:
    """``node`` and ``root`` as links give them, without all pairs of long lists."""
    short, entries = _candidates(docs, edits, words)
    if not entries.take(1):
        return graph.components(_verified(docs, short, edits, words))
    roots = graph.components(_verified(docs, short.unionByName(_pivot_pairs(entries)), edits, words))
    rooted = entries.withColumn("node", F.expr("entry & ~1L")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    more = _verified(docs, _long_pairs(rooted.join(mixed, "key"), edits), edits, words)
    return graph.components(more.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))


def occurrences(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``number`` and ``line`` (id) of all lines that are compared."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_occurrences(words), f"doc_id {id_type}, text_hash long, number long, line long")


def classes(docs: DataFrame, found: DataFrame, edits: int = EDITS, words: int = WORDS) -> DataFrame:
    """One row for each distinct line: ``line``, ``copies``, ``class_id``, ``first`` and ``class_first`` (the
    smallest doc_id, text_hash and number where the line, or a line of its class, occurs; a null doc_id is smaller than
    others), ``class_copies``."""
    roots = components(docs, edits, words).select(F.col("node").alias("line"), "root")
    lines = found.groupBy("line").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").alias("d"), "text_hash", "number")).alias("first"))
    lines = lines.join(roots, "line", "left").withColumn("class_id", F.coalesce("root", "line")).drop("root")
    whole = lines.groupBy("class_id").agg(F.min("first").alias("class_first"), F.sum("copies").alias("class_copies"))
    return lines.join(whole, "class_id")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces ``text`` by its lines without those whose numbers are in the last column."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if drop:
                gone = set(drop)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            out.append(text)
        columns = batch.columns[:-1]
        columns[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def deduplicated(docs: DataFrame, edits: int = EDITS, words: int = WORDS) -> DataFrame:
    """The documents, each line only where it or a near one occurs first; texts of which nothing is left go."""
    found = tables.kept(occurrences(docs, words), "lines")
    repeated = tables.kept(classes(docs, found, edits, words).filter("class_copies > 1").select("line", "copies", "class_first"), "repeated")
    often = F.col("copies") > HOT * repeated.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot, rest = repeated.filter(often).drop("copies"), repeated.filter(~often).drop("copies")
    cold = found.join(F.broadcast(hot.select("line")), "line", "left_anti").join(rest, "line")
    again = found.join(F.broadcast(hot), "line").unionByName(cold).filter(F.struct(F.col("doc_id").alias("d"), "text_hash", "number") != F.col("class_first"))
    drops = again.groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).agg(F.collect_set("number").alias("__drop"))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left").drop("__doc", "__hash")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    cut = joined.withColumn("__was", F.size("__drop") > 0).select(*docs.columns, "__was", "__drop").mapInArrow(_cut, f"{schema}, __was boolean")
    left = cut.filter(F.coalesce(~F.col("__was"), F.lit(True)) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("__was"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)
