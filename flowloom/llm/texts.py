"""Words, lines and hashes of whole Arrow batches of texts, in numpy.

A *word* is a run of ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit, the same in every worker:
each byte is multiplied by a fixed random number of its position, the products are summed
modulo 2**64 and mixed. Batches are worked on in slices of whole documents of about
``SLICE`` bytes, so that memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 22
CHUNK = 1 << 18
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _randoms(n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U)) * U(0x9E3779B97F4A7C15)) | U(1)


_PLACES = _randoms(1 << 12)


def _places(n: int) -> np.ndarray:
    global _PLACES
    if n > len(_PLACES):
        _PLACES = _randoms(2 * n)
    return _PLACES


def _place_range(first: int, last: int) -> np.ndarray:
    """The random numbers of the places from ``first`` up to ``last``, for places that no table is kept of."""
    return mix(np.arange(first + 1, last + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each ``data[start:end]``; runs may be empty and must not overlap.

    Works on about ``CHUNK`` bytes at a time, so that memory follows neither the slice nor the longest run.
    """
    out = np.zeros(len(starts), U)
    lengths = ends - starts
    for i in np.flatnonzero(lengths > CHUNK):
        total = np.zeros(1, U)
        for at in range(0, int(lengths[i]), CHUNK):
            piece = data[starts[i] + at : min(starts[i] + at + CHUNK, ends[i])]
            total = total + ((piece.astype(U) + U(1)) * _place_range(at, at + len(piece))).sum(dtype=U)
        out[i] = mix(total)[0]
    full = np.flatnonzero((lengths > 0) & (lengths <= CHUNK))
    upto = np.cumsum(lengths[full])
    done = 0
    while done < len(full):
        last = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + CHUNK, side="right")))
        some = full[done:last]
        size, first = lengths[some], starts[some]
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        products = (data[place + np.repeat(first, size)].astype(U) + U(1)) * _places(int(size.max()))[place]
        out[some] = mix(np.add.reduceat(products, begin))
        done = last
    return out


def hash_prefixes(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of runs that lie one after another, the hash of its run up to it, and up to the byte before."""
    if len(data) == 0:
        return np.zeros(0, U), np.zeros(0, U)
    products = (data.astype(U) + U(1)) * _places(int(place.max()) + 1)[place]
    sums = np.cumsum(products)
    first = np.flatnonzero(place == 0)
    base = np.repeat((sums - products)[first], np.diff(np.append(first, len(data))))
    return mix(sums - base), mix(sums - products - base)


def hash_ngrams(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long columns of hashes; the order of columns counts."""
    total = np.zeros(len(parts[0]), U)
    for part, factor in zip(parts, _randoms(64 + len(parts))[64:], strict=True):
        total += part * factor
    return mix(total)


@dataclass
class Slice:
    """Some whole documents of a batch: rows ``first`` up to ``last``, their bytes and offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def lower(self) -> np.ndarray:
        """The bytes with A-Z in lower case."""
        return _LOWER[self.data]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The document, counted from the slice's first, that each byte position lies in."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words start and end."""
        inside = ~_SPACE[self.data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        begins[edges] |= inside[edges]
        stops[edges - 1] |= inside[edges - 1]
        return np.flatnonzero(begins), np.flatnonzero(stops) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every line (texts split at ``\\n``); an empty text is one empty line."""
        feeds = np.flatnonzero(self.data == 10)
        doc = np.concatenate([np.arange(self.rows), self.doc_of(feeds)])
        starts = np.concatenate([self.offsets[:-1], feeds + 1])
        order = np.lexsort((starts, doc))
        doc, starts = doc[order], starts[order]
        last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
        ends = np.where(last, self.offsets[doc + 1], np.append(starts[1:], 0)[: len(doc)] - 1)
        return starts, ends, doc

    def count_in(self, wanted: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many bytes marked in ``wanted`` (by byte position) lie in each run."""
        total = np.concatenate([[0], np.cumsum(wanted)])
        return total[ends] - total[starts]


def space_bytes(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Slice]:
    """The documents of a text column, null as empty, in slices of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of the first word and hash of each run of ``n`` words within one document."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    count = len(hashes) - n + 1
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    return at, hash_ngrams([hashes[at + i] for i in range(n)])
