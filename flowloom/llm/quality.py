"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics (``FEATURES``). For every (lang, source)
a minimum-covariance-determinant estimate gives centre and scatter: concentration steps keep
the ``SUPPORT`` share of vectors nearest to the estimate so far and estimate anew from them. They begin at
four deterministic starts: medians and quartile ranges; mean and covariance; and medians with the correlations of
squashed values, or of directions from the median. Of the four ends the one with the smallest determinant counts (ties: the
start named first). A document whose squared Mahalanobis distance is above ``CUTOFF`` is rejected.

The steps are aggregations over all rows, of all starts at once. The nearest share is found from a histogram of log
distances whose cells also hold the moments, so one pass gives both; per group only its cells
meet, never its rows. Estimates of groups are drawn towards those of all rows by the weight of
``PRIOR`` rows, and variances have a floor (``FLOORS``): a statistic that is zero in nearly
every text would else reject any text where it is not. A group of any size follows this rule.

Null texts are empty; null lang or source is a group of its own; empty texts have no words and
fail the fixed limits. Repeated rows are judged alike, each on its own. Of an empty table nothing is left. Further columns
may have any name: whole rows are carried in one column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm import tables, texts

SUPPORT = 0.75
#: The share after the starts, which are rough: fewer vectors, so fewer outliers among them.
FIRST_SUPPORT = 0.5
STEPS = 8
PRIOR = 100
#: One in 200,000 of chi-square with five degrees of freedom.
CUTOFF = 32.3
#: Per statistic: the transformed value, and the least standard deviation.
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share")
FLOORS = (0.5, 0.35, 0.06, 0.15, 0.15)
#: Median of chi-square with five degrees of freedom; scales the scatter of the nearest share.
CHI_MEDIAN = 4.351
CELLS_PER_DOUBLING = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _slice_counts(part: texts.Slice) -> list[np.ndarray]:
    rows = part.rows
    starts, ends = part.words()
    doc = part.doc_of(starts)
    n_words = np.bincount(doc, minlength=rows)
    space = texts.space_bytes(part.data)
    leads = (part.data & 0xC0) != 0x80
    word_chars = part.count_in(leads & ~space, part.offsets[:-1], part.offsets[1:])
    n_symbols = part.count_in(_SYMBOL[part.data], part.offsets[:-1], part.offsets[1:])

    begin, stop, owner = part.lines()
    worded = part.count_in(~space, begin, stop) > 0
    line = texts.hash_ngrams([texts.hash_runs(part.data, begin, stop)[worded], (stop - begin)[worded].astype(texts.U), owner[worded].astype(texts.U)])
    _, firsts = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[firsts] = False
    n_dup_lines = np.bincount(owner[worded][again], minlength=rows)

    hashes = texts.hash_runs(part.data, starts, ends)
    at, grams = texts.ngrams(hashes, doc, 3)
    _, inverse, times = np.unique(texts.hash_ngrams([grams, doc[at].astype(texts.U)]), return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashes), bool)
    found = at[times[inverse] > 1]
    for i in range(3):
        covered[found + i] = True
    n_repeat = np.bincount(doc[covered], minlength=rows)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_slice_counts(part) for part in texts.slices(batch.column("__text"))]
        totals = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)] or [pa.array([], pa.int64())] * len(_COUNTS)
        keep = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *totals], names=[*keep, *(f"__{c}" for c in _COUNTS)])


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of each text, in columns ``__n_words`` and so on."""
    df = docs.select(*keep, F.col("text").alias("__text"))
    fields = [f for f in df.schema.fields if f.name != "__text"]
    return df.mapInArrow(_count, T.StructType([*fields, *(T.StructField(f"__{c}", T.LongType()) for c in _COUNTS)]))


def _vector() -> list[Column]:
    words = F.greatest(F.col("__n_words"), F.lit(1))
    return [
        F.log(words),
        F.least(F.col("__word_chars") / words, F.lit(60.0)),
        F.sqrt(F.col("__n_symbols") / F.greatest(F.col("__word_chars"), F.lit(1))),
        F.sqrt(F.col("__n_dup_lines") / words),
        F.sqrt(F.col("__n_repeat_words") / words),
    ]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _moments() -> list[Column]:
    first = [F.sum(f"__x{i}").alias(f"s{i}") for i in range(len(FEATURES))]
    second = [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"q{i}_{j}") for i, j in _pairs()]
    return [F.count("*").alias("n"), *first, *second]


def _estimate(n: float, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = s / max(n, 1)
    return centre, q / max(n, 1) - np.outer(centre, centre)


def _nearest(cells: pd.DataFrame, share: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Moments of the nearest ``share``, and the median of squared distances."""
    cells = cells.sort_values("cell")
    upto = cells["n"].cumsum().to_numpy()
    total = upto[-1]
    used = cells[np.concatenate([[True], upto[:-1] < share * total])]
    q = np.zeros((len(FEATURES),) * 2)
    for i, j in _pairs():
        q[i, j] = q[j, i] = used[f"q{i}_{j}"].sum()
    median = cells["cell"].to_numpy()[np.searchsorted(upto, 0.5 * total)]
    return float(used["n"].sum()), used[[f"s{i}" for i in range(len(FEATURES))]].sum().to_numpy(float), q, 2.0 ** ((median + 0.5) / CELLS_PER_DOUBLING)


_DIMS = range(len(FEATURES))
_PARAMS = ", ".join(["__group string", "start int", "logdet double", *(f"m{i} double" for i in _DIMS), *(f"p{i}_{j} double" for i, j in _pairs())])


def _params(group: str, start: int, centre: np.ndarray, scatter: np.ndarray, scale: float = 1.0) -> dict:
    """A row of :data:`_PARAMS`; variances are raised to their floor, ``scale`` is not part of the determinant."""
    scatter = scatter + np.diag(np.maximum(0, np.square(FLOORS) - np.diag(scatter)))
    sign, logdet = np.linalg.slogdet(scatter)
    inverse = np.linalg.pinv(scatter * scale)
    return {"__group": group, "start": start, "logdet": logdet if sign > 0 else np.inf, **{f"m{i}": centre[i] for i in _DIMS}, **{f"p{i}_{j}": inverse[i, j] for i, j in _pairs()}}


def _begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The starts of each group from its medians, scales and three sorts of moments of its scaled values."""
    for batch in batches:
        rows = []
        for g in batch.to_dict("records"):
            n, median, scale = g["n"], np.array([g[f"c{i}"] for i in _DIMS]), np.array([g[f"w{i}"] for i in _DIMS])
            rows.append(_params(g["__group"], 0, median, np.diag(scale**2)))
            for start, sort in enumerate(_SORTS, 1):
                centre = np.array([g[f"{sort}{i}"] for i in _DIMS]) / n
                q = np.zeros((len(FEATURES),) * 2)
                for i, j in _pairs():
                    q[i, j] = q[j, i] = g[f"{sort}{i}_{j}"] / n
                if sort == "plain":
                    q, middle = q - np.outer(centre, centre), median + scale * centre
                else:
                    # only the shape of bounded values is used: their correlations, about the median
                    deviation = np.sqrt(np.maximum(np.diag(q), 1e-12))
                    q, middle = q / np.outer(deviation, deviation), median
                    np.fill_diagonal(q, 1.0)
                rows.append(_params(g["__group"], start, middle, q * np.outer(scale, scale)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARAMS.split(", ")])


#: Values whose moments give a start each: as they are, squashed one by one, and directions from the median.
_SORTS = ("plain", "squashed", "direction")


def _starts(vectors: DataFrame) -> DataFrame:
    """For every ``__group`` one row of parameters for each start; two passes over the rows."""
    cut = [F.percentile_approx(f"__x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"c{i}") for i in _DIMS]
    found = vectors.groupBy("__group").agg(*cut)
    scale = [F.greatest((F.col(f"c{i}")[2] - F.col(f"c{i}")[0]) / 1.349, F.lit(FLOORS[i])).alias(f"w{i}") for i in _DIMS]
    found = tables.kept(found.select("__group", *(F.col(f"c{i}")[1].alias(f"c{i}") for i in _DIMS), *scale), "mcd-scales")
    scaled = vectors.select("__group", *(f"__x{i}" for i in _DIMS)).join(tables.hinted(found), "__group")
    scaled = scaled.select("*", *(((F.col(f"__x{i}") - F.col(f"c{i}")) / F.col(f"w{i}")).alias(f"plain_{i}") for i in _DIMS))
    length = F.sqrt(sum((F.col(f"plain_{i}") * F.col(f"plain_{i}") for i in _DIMS), F.lit(0.0)))
    scaled = scaled.select("*", F.greatest(length, F.lit(1e-9)).alias("length"), *(F.tanh(f"plain_{i}").alias(f"squashed_{i}") for i in _DIMS))
    scaled = scaled.select("*", *((F.col(f"plain_{i}") / F.col("length")).alias(f"direction_{i}") for i in _DIMS))
    sums = [F.sum(f"{t}_{i}").alias(f"{t}{i}") for t in _SORTS for i in _DIMS] + [F.sum(F.col(f"{t}_{i}") * F.col(f"{t}_{j}")).alias(f"{t}{i}_{j}") for t in _SORTS for i, j in _pairs()]
    kept = [F.first(f"{c}{i}").alias(f"{c}{i}") for c in "cw" for i in _DIMS]
    return scaled.groupBy("__group").agg(F.count("*").alias("n"), *kept, *sums).mapInPandas(_begin, _PARAMS)


def _concentrate(priors: dict[int, tuple[np.ndarray, np.ndarray]], share: float):
    def step(cells: pd.DataFrame) -> pd.DataFrame:
        start, prior = int(cells["start"].iloc[0]), priors[int(cells["start"].iloc[0])]
        n, s, q, median = _nearest(cells, share)
        centre, scatter = _estimate(n, s, q)
        # a steady scale: the median distance of a good estimate is that of chi-square
        scale = float(np.clip(median / CHI_MEDIAN, 1.0, 4.0)) if cells["scaled"].iloc[0] else 1.0
        w, gap = n / (n + PRIOR), centre - prior[0]
        scatter = w * scatter + ((1 - w) * prior[1] + w * (1 - w) * np.outer(gap, gap)) / scale
        return pd.DataFrame([_params(cells["__group"].iloc[0], start, w * centre + (1 - w) * prior[0], scatter, scale)])

    return step


def _distance() -> Column:
    terms = [F.col(f"p{i}_{j}") * (1 if i == j else 2) * (F.col(f"__x{i}") - F.col(f"m{i}")) * (F.col(f"__x{j}") - F.col(f"m{j}")) for i, j in _pairs()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _cell(distance: Column) -> Column:
    return F.floor(F.log2(F.greatest(distance, F.lit(1e-6))) * CELLS_PER_DOUBLING).cast("int")


def concentrated(vectors: DataFrame) -> DataFrame:
    """Parameters of every ``__group`` after all steps, one row for each start, with the logarithm of the determinant.

    ``vectors`` should be a stored table: it is read twice for the starts and once for each step.
    """
    params = tables.kept(_starts(vectors), "mcd")
    sums = ["n", *(f"s{i}" for i in _DIMS), *(f"q{i}_{j}" for i, j in _pairs())]
    slim = vectors.select("__group", *(f"__x{i}" for i in _DIMS))
    for step in range(STEPS):
        share = SUPPORT if step else FIRST_SUPPORT
        placed = slim.join(tables.hinted(params), "__group").withColumn("cell", _cell(_distance()))
        cells = tables.kept(placed.groupBy("__group", "start", "cell").agg(*_moments()).withColumn("scaled", F.lit(step == STEPS - 1)), "mcd-cells")
        # added up over the groups: one row for each start and cell, of which there are a few hundred
        pooled = cells.groupBy("start", "cell").agg(*(F.sum(c).alias(c) for c in sums)).toPandas()
        if len(pooled) == 0:
            return params
        priors = {}
        for start, own in pooled.groupby("start"):
            n, s, q, _ = _nearest(own, share)
            centre, scatter = _estimate(n, s, q)
            priors[int(start)] = centre, scatter + np.diag(np.maximum(0, np.square(FLOORS) - np.diag(scatter)))
        params = tables.kept(cells.groupBy("__group", "start").applyInPandas(_concentrate(priors, share), _PARAMS), "mcd")
    return params


def smallest(found: DataFrame) -> DataFrame:
    """Of every ``__group`` the parameters with the smallest determinant."""
    best = found.groupBy("__group").agg(F.min_by(F.struct(*found.columns[1:]), F.struct("logdet", "start")).alias("best"))
    return best.select("__group", "best.*").drop("start", "logdet")


def fit(vectors: DataFrame) -> DataFrame:
    """Centre and inverse scatter of every ``__group`` of ``vectors``, from all its rows."""
    return tables.kept(smallest(concentrated(vectors)), "mcd")


def vectors(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the counts (``__n_words`` ..), ``__group`` and the vector (``__x0`` ..) of each document."""
    grouped = docs.withColumn("__group", F.to_json(F.array("lang", "source")))
    return text_counts(grouped, [*keep, "__group"]).select("*", *(x.cast("double").alias(f"__x{i}") for i, x in enumerate(_vector())))


def judge(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """``vectors`` with ``__base_failed``, ``__distance`` (squared, to its group's centre) and ``__kept``."""
    failed = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    placed = vectors.join(tables.hinted(params), "__group").withColumn("__distance", _distance()).drop(*params.columns)
    return placed.withColumn("__base_failed", failed).withColumn("__kept", ~failed & (F.col("__distance") <= CUTOFF))


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and verdict of every document; each text is read once."""
    table = tables.kept(vectors(docs, ["doc_id"]), "quality")
    return judge(table, fit(table))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; texts are read a second time instead of being stored."""
    used = docs.select("lang", "source", "text")
    slim = tables.kept(vectors(used, []), "quality")
    rows = docs.select(F.struct("*").alias("__row"), "lang", "source", "text")
    return judge(vectors(rows, ["__row"]), fit(slim)).filter("__kept").select("__row.*")
