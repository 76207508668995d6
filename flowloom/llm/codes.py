"""Vector codes of sixteen parts, nearest entries found by equal-average search.

Components become integers, ``floor(256 x)``; vectors are cut into ``PARTS`` equal consecutive parts. A codebook for each
part position starts as that part of the ``ENTRIES`` first vectors by id; each of ``ROUNDS`` rounds assigns every
part to its nearest entry and moves entries to the floored mean of their parts. All of it is integer arithmetic, so
results do not depend on how rows are dealt.

*Equal-average search*: entries are sorted by the sum of their components. By Cauchy-Schwarz the squared distance of
two parts of d components is at least the squared gap of their sums over d. From a part's own sum the search goes
outward, always to the side whose next sum is nearer, and stops where the squared gap over d strictly exceeds the
best distance so far; equal distances go to the lower index, which is why equality goes on. All parts of a slice
take a step at once, and those that have stopped leave the slice.

Spark deals the rows out. A task sums up its rows by part and entry and sends one row for each pair, at most
``PARTS * ENTRIES``; these are added up in a shuffle. Only codebooks, whose size follows from the parameters, reach the
driver and the tasks.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do those whose
number of components is not the commonest one (the larger of equally common ones; no rows if it is not a multiple of
``PARTS``). Rows without id are encoded but start no entry; equal ids start entries in order of their components.
With fewer vectors than ``ENTRIES`` there are as many entries; repeated rows and equal entries are all kept, the
lower one wins. An empty table gives no row. A component of ``LARGEST`` or more is an error, as its squares would
not fit 64 bits. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm import tables

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Parts that take steps together in a task.
SLICE = 1 << 18
LARGEST = float(1 << 18)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, the lowest of equally near ones, and the squared distance."""
    n, d = parts.shape
    k = len(entries)
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    own = parts.sum(axis=1)
    index = np.zeros(n, np.int64)
    best = np.full(n, np.iinfo(np.int64).max)
    live = np.arange(n)
    right = np.searchsorted(ranked, own)
    left = right - 1
    far = np.iinfo(np.int64).max
    while len(live):
        mine = own[live]
        gap_left = np.where(left >= 0, mine - ranked[np.maximum(left, 0)], far)
        gap_right = np.where(right < k, ranked[np.minimum(right, k - 1)] - mine, far)
        go_left = gap_left <= gap_right
        gap = np.where(go_left, gap_left, gap_right)
        # squared gap over d strictly above the best distance, in whole numbers
        bound = -(-np.square(np.minimum(gap, 1 << 31)) // d)
        on = (gap < far) & (bound <= best[live])
        if not on.all():
            live, go_left, left, right = live[on], go_left[on], left[on], right[on]
            if not len(live):
                break
        entry = order[np.where(go_left, left, right)]
        distance = np.square(parts[live] - entries[entry]).sum(axis=1)
        was = best[live]
        better = (distance < was) | ((distance == was) & (entry < index[live]))
        changed = live[better]
        index[changed], best[changed] = entry[better], distance[better]
        left, right = left - go_left, right + ~go_left
    return index, best


def _rows(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors of the rows that take part, in slices."""
    column = batch.column("vector")
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(sizes == dim)
    step = max(1, SLICE // PARTS)
    for i in range(0, len(fit), step):
        at = fit[i : i + step]
        flat = column.take(pa.array(at)).flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim)
        good = np.isfinite(values).all(axis=1)
        if good.any():
            at, values = at[good], values[good]
            if np.abs(values).max() >= LARGEST:
                raise ValueError(f"a component of {LARGEST:.0f} or more has no 64-bit code")
            yield at, np.floor(values * SCALE).astype(np.int64)


def _usable(vector: Column, dim: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & ~bad


def _dimension(vectors: DataFrame) -> int:
    usable = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    common = vectors.filter(usable).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return common["dim"] if common and common["dim"] % PARTS == 0 else 0


def _start(vectors: DataFrame, dim: int) -> np.ndarray:
    """The first codebooks, parts x entries x components."""
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    first = vectors.filter(_usable(F.col("vector"), dim) & F.col("id").isNotNull()).select("id", whole.alias("vector"))
    rows = first.orderBy("id", "vector").limit(ENTRIES).collect()
    found = np.array([r["vector"] for r in rows], np.int64).reshape(len(rows), PARTS, dim // PARTS)
    return found.transpose(1, 0, 2).copy()


def _summing(books: np.ndarray):
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, d), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, rows in _rows(batch, parts * d):
                for p in range(parts):
                    own = rows[:, p * d : (p + 1) * d]
                    index = nearest(own, books[p])[0]
                    counts[p * entries : (p + 1) * entries] += np.bincount(index, minlength=entries)
                    np.add.at(sums, p * entries + index, own)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *(pa.array(sums[used, j]) for j in range(d))], names=["entry", "n", *(f"s{j}" for j in range(d))])

    return run


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, d = books.shape
    columns = [f"s{j}" for j in range(d)]
    summed = vectors.select("vector").mapInArrow(_summing(books), ", ".join(["entry long", "n long", *(f"{c} long" for c in columns)]))
    # at most parts x entries rows
    totals = summed.groupBy("entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *columns])).collect()
    flat = books.reshape(parts * entries, d).copy()
    for r in totals:
        flat[r["entry"]] = [int(r[c]) // int(r["n"]) for c in columns]
    return flat.reshape(books.shape)


def _encoding(books: np.ndarray):
    parts, _, d = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _rows(batch, parts * d):
                code, error = np.zeros((len(at), parts), "S2"), np.zeros(len(at), np.int64)
                for p in range(parts):
                    index, distance = nearest(rows[:, p * d : (p + 1) * d], books[p])
                    code[:, p] = digits[index]
                    error += distance
                text = pa.array([x.decode() for x in code.reshape(-1).view(f"S{2 * parts}")], pa.string())
                taken = batch.take(pa.array(at))
                names = [n for n in taken.schema.names if n != "vector"]
                yield pa.RecordBatch.from_arrays([*(taken.column(n) for n in names), text, pa.array(error)], names=[*names, "code", "error"])

    return run


def trained(vectors: DataFrame) -> np.ndarray:
    """Codebooks of ``vectors`` (``id``, ``vector``), parts x entries x components; without entries if no vector takes part."""
    dim = _dimension(vectors)
    books = _start(vectors, dim) if dim else np.zeros((PARTS, 0, 0), np.int64)
    for _ in range(ROUNDS if books.size else 0):
        books = _moved(vectors, books)
    return books


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """The columns of ``vectors`` but the vector, its ``code`` and ``error``, for every row that takes part."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "vector"]
    schema = ", ".join([*kinds, "code string", "error long"])
    return vectors.mapInArrow(_encoding(books), schema) if books.size else vectors.sparkSession.createDataFrame([], schema)


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p][int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))]) / SCALE


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, vec_id: Column, vector: Column, label: Column) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``code``, ``error`` and ``label_error``, the error of all rows of the same label, null one of them; and the codebooks."""
    vectors = rows.select(vec_id.alias("id"), vector.alias("vector"), label.alias("label"))
    books = trained(vectors)
    found = tables.kept(encoded(vectors, books), "codes")
    totals = tables.kept(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "codes-labels")
    joined = found.join(tables.hinted(totals), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error"), books
