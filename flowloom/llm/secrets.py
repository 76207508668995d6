"""Secret scans with a worklist of decoded layers.

Every whole text is scanned for three kinds of secrets. Then its encoded parts are unwrapped: URL escapes, Unicode and
HTML escapes, base64 (also wrapped in lines, after a prefix such as ``id-``, or of UTF-16 text), and gzip, zlib or
bzip2 data inside base64, all members of it. Each result is a new layer that is scanned and unwrapped in turn, until no
new layer appears.

*Spans* are given in the text. A layer keeps how its characters lie in the layer that it came from as a few sorted
runs (``Runs``), and a match is mapped up layer by layer, so memory follows the escapes that differ in width, not the
characters. All that comes from compressed data has one place, the base64 run; such data is therefore decompressed as a
stream and looked at in windows of about ``WINDOW`` characters that end where no match, escape or base64 run can go on.
Only a run of more than ``8 * WINDOW`` characters without such an end is cut, with ``OVERLAP`` characters seen twice.

*Fixpoint*: a layer of the same characters that came from the same places is not looked at again, so data that decode to
themselves end; equal layers from different places are each looked at, with the secrets of their text found once.

All three kinds are looked for in every layer. Null texts are empty and hold nothing. Empty and repeated rows give one
row each; ids may be null.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
WINDOW = 1 << 20
OVERLAP = 1 << 16
#: Places that are mapped at a time to tell two layers apart.
CHUNK = 1 << 16

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_UNITS = r"\\u[0-9A-Fa-f]{4}|\\u\{0*[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}"
_ESCAPED = re.compile(rf"(?:%[0-9A-Fa-f]{{2}})+|(?:{_UNITS})+|&#(?:[0-9]{{1,7}}|[xX][0-9A-Fa-f]{{1,6}});|&[A-Za-z][A-Za-z0-9]{{1,31}};")
_UNIT = re.compile(_UNITS)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}+[\x20\t]*+\r?\n[\x20\t]*+)+[A-Za-z0-9+/]{2,}+={0,2}")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\x80-\U0010ffff]*")
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY")
#: Where no match, escape or base64 run goes on: at characters that are in none of them, and at blanks between words.
_BREAK = re.compile(r"[^A-Za-z0-9+/_.=:\s\"'%\\{}&#;-]|(?<=[A-Za-z0-9])\x20+(?=[A-Za-z0-9])|(?<![A-Za-z0-9+/=\s])[\t\r\n]", re.A)
_SPACES = re.compile(r"\x20{9,}")

Span = tuple[int, int, int]


def matches(text: str) -> list[Span]:
    """(start, end, kind) of the secrets of one layer."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


class Runs:
    """Where the items of a layer lie in the layer below it: runs of equal width, one after another.

    Item ``i`` of a run lies at ``source + (i - first) * width``, ``width`` places long.
    """

    def __init__(self) -> None:
        self.first: list[int] = []
        self.source: list[int] = []
        self.width: list[int] = []
        self.size = 0

    def add(self, source: int, width: int, count: int) -> None:
        if count <= 0:
            return
        if self.first and self.width[-1] == width and self.source[-1] + (self.size - self.first[-1]) * width == source:
            self.size += count
            return
        self.first.append(self.size)
        self.source.append(source)
        self.width.append(width)
        self.size += count

    def ends(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_arrays"):
            self._arrays = tuple(np.array(x, np.int64) for x in (self.first, self.source, self.width))
        first, source, width = self._arrays
        run = np.searchsorted(first, items, side="right") - 1
        start = source[run] + (items - first[run]) * width[run]
        return start, start + width[run]


@dataclass
class Layer:
    """A decoded text. ``up`` maps places of characters (first and last of each) to the layer below; ``place`` is set
    instead where all of it has one span in the text."""

    text: str
    below: Layer | None = None
    up: object = None
    place: tuple[int, int] | None = None

    def root(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Span in the text of each part from character ``first`` to character ``last``."""
        layer = self
        while layer.place is None and layer.below is not None:
            start, end = layer.up(first)[0], layer.up(last)[1]
            first, last, layer = start, end - 1, layer.below
        if layer.place is not None:
            return np.full(len(first), layer.place[0]), np.full(len(first), layer.place[1])
        return first, last + 1

    def key(self) -> tuple:
        """Equal for layers of equal characters from equal places."""
        digest = hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()
        if self.place is not None:
            return digest, self.place
        places = hashlib.sha256()
        for lo in range(0, len(self.text), CHUNK):
            at = np.arange(lo, min(lo + CHUNK, len(self.text)))
            for part in self.root(at, at):
                places.update(part.astype(np.int64).tobytes())
        return digest, places.digest()


def _escape(part: str) -> Iterator[tuple[str, list[int]]]:
    """Characters of an escape, and how long each of them is written; nothing if it is none."""
    if part[0] == "%":
        raw = bytes.fromhex(part.replace("%", ""))
        try:
            chars = raw.decode()
            yield chars, [3 * len(c.encode()) for c in chars]
        except UnicodeDecodeError:
            yield raw.decode("latin-1"), [3] * len(raw)
    elif part[0] == "&" and part[1] != "#":
        chars = html5.get(part[1:])
        if chars is not None:
            yield chars, [len(part)] + [0] * (len(chars) - 1)
    elif part[0] == "&":
        code = int(part[3:-1], 16) if part[2] in "xX" else int(part[2:-1])
        if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield chr(code), [len(part)]
    else:
        units = _UNIT.findall(part)
        codes = [int(u[2:].strip("{}"), 16) for u in units]
        chars, widths, i = [], [], 0
        while i < len(codes):
            pair = i + 1 < len(codes) and 0xD800 <= codes[i] < 0xDC00 <= codes[i + 1] < 0xE000
            code = 0x10000 + ((codes[i] - 0xD800) << 10) + codes[i + 1] - 0xDC00 if pair else codes[i]
            chars.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
            widths.append(sum(len(units[j]) for j in range(i, i + 1 + pair)))
            i += 1 + pair
        yield "".join(chars), widths


def _unescaped(layer: Layer) -> Iterator[Layer]:
    out: list[str] = []
    runs = Runs()
    done = 0
    text = layer.text
    for m in _ESCAPED.finditer(text):
        for chars, widths in _escape(m[0]):
            out.append(text[done : m.start()])
            runs.add(done, 1, m.start() - done)
            at = m.start()
            for width in widths:
                # a second character of one entity lies where the first does
                runs.add(at if width else at - widths[0], width or widths[0], 1)
                at += width
            out.append(chars)
            done = m.end()
    if out:
        out.append(text[done:])
        runs.add(done, 1, len(text) - done)
        yield Layer("".join(out), layer, runs.ends, layer.place)


def _from_bytes(chars: str, offset: int, step: int, body: Runs, length: int):
    """Maps characters of decoded base64, which begin at byte ``offset``, to the layer below; ``body``: where its digits are."""
    sizes = None if chars.isascii() else np.cumsum([0] + [len(c.encode()) for c in chars])

    def up(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = (items * step, (items + 1) * step) if sizes is None else (sizes[items], sizes[items + 1])
        start = (first + offset) * 4 // 3
        end = np.minimum((last + offset) * 4 // 3, length - 1)
        return body.ends(start)[0], body.ends(end)[1]

    return up


def _decompressed(raw: bytes) -> Iterator[str]:
    """The text of gzip, zlib or bzip2 data, all members, piece by piece; nothing if it is none of them."""

    def engine(data: bytes):
        if data[:2] == b"\x1f\x8b":
            return zlib.decompressobj(31)
        if data[:3] == b"BZh":
            return bz2.BZ2Decompressor()
        if len(data) >= 6 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and int.from_bytes(data[:2], "big") % 31 == 0 and not data[1] & 32:
            return zlib.decompressobj(15)
        return None

    decode = codecs.getincrementaldecoder("utf-8")("replace")
    while (unpack := engine(raw)) is not None:
        data = raw
        try:
            while True:
                piece = unpack.decompress(data, WINDOW)
                if piece:
                    yield decode.decode(piece)
                data = b"" if isinstance(unpack, bz2.BZ2Decompressor) else unpack.unconsumed_tail
                if unpack.eof or (not piece and not data):
                    break
        except (zlib.error, OSError):
            return
        if not unpack.eof:
            return
        raw = unpack.unused_data
        if raw[:2] not in (b"\x1f\x8b", b"BZ"):
            return


def windows(pieces: Iterator[str]) -> Iterator[str]:
    """Pieces of a text put together to parts that end where no match can go on. Long runs of blanks are shortened, which no match tells apart."""
    held = ""
    for piece in pieces:
        held = _SPACES.sub(" " * 8, held + piece)
        if len(held) < WINDOW:
            continue
        cut = 0
        for m in _BREAK.finditer(held, len(held) - WINDOW):
            cut = m.end()
        if cut:
            yield held[:cut]
            held = held[cut:]
        elif len(held) >= 8 * WINDOW:
            # base64 goes on in whole quadruples from the run's first character
            start = 0
            for m in _BASE64.finditer(held[-OVERLAP * 2 :]):
                start = m.start()
            cut = len(held) - OVERLAP
            cut -= (cut - start) % 4
            yield held
            held = held[cut:]
    if held:
        yield held


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    """Layers from the base64 runs of a layer."""
    text = layer.text
    for m in _WRAPPED.finditer(text):
        body, runs, inside = [], Runs(), re.compile(r"[A-Za-z0-9+/]+")
        for line in inside.finditer(text, m.start(), m.end()):
            body.append(line[0])
            runs.add(line.start(), 1, len(line[0]))
        yield from _decoded(layer, "".join(body), runs, m.start(), m.end())
    for m in _BASE64.finditer(text):
        body = m[0].rstrip("=")
        runs = Runs()
        runs.add(m.start(), 1, len(body))
        yield from _decoded(layer, body, runs, m.start(), m.end())


def _decoded(layer: Layer, body: str, runs: Runs, begin: int, end: int) -> Iterator[Layer]:
    body = body.replace("-", "+").replace("_", "/")
    whole = None

    def packed(raw: bytes) -> Iterator[Layer]:
        nonlocal whole
        for part in windows(_decompressed(raw)):
            if whole is None:
                start, stop = layer.root(np.array([begin]), np.array([end - 1]))
                whole = int(start[0]), int(stop[0])
            yield Layer(part, place=whole)

    for skip in range(4):
        digits = body[skip:]
        if len(digits) % 4 == 1:
            digits = digits[:-1]
        try:
            raw = base64.b64decode(digits + "=" * (-len(digits) % 4))
        except (binascii.Error, ValueError):
            continue
        shifted = Runs()
        first = runs.ends(np.arange(skip, len(body)))[0] if len(runs.first) > 1 else None
        if first is None:
            shifted.add(runs.source[0] + skip, 1, len(digits))
        else:
            for lo, hi in _straight(first[: len(digits)]):
                shifted.add(int(first[lo]), 1, hi - lo)

        def place(chars: str, offset: int, step: int = 1, shifted: Runs = shifted, n: int = len(digits)) -> Layer:
            return Layer(chars, layer, _from_bytes(chars, offset, step, shifted, n), layer.place)

        if skip == 0:
            any_packed = False
            for part in packed(raw):
                any_packed = True
                yield part
            if any_packed:
                return
            try:
                chars = raw.decode()
            except UnicodeDecodeError:
                chars = None
            if chars is not None and _PLAIN.fullmatch(chars):
                yield place(chars, 0)
                return
        # text or compressed data somewhere behind a prefix, or text in two bytes a character
        for part in _READABLE.finditer(raw):
            yield place(part[0].decode(), part.start())
        for part in _WIDE.finditer(raw):
            yield place(part[0].decode("utf-16-le"), part.start(), 2)
        for part in _PACKED.finditer(raw):
            yield from packed(raw[part.start() :])


def _straight(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items that lie side by side."""
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Secrets of the text itself, and those that only decoding shows, in spans of the text."""
    base = matches(text)
    if _ESCAPED.search(text) is None and _BASE64.search(text) is None:
        return base, []
    found: set[Span] = set()
    seen: set[tuple] = set()
    known: dict[bytes, list[Span]] = {}
    root = Layer(text)

    def children(layer: Layer) -> Iterator[Layer]:
        yield from _unescaped(layer)
        yield from _unwrapped(layer)

    # the worklist: of each layer on the way the rest of its children, made as they are asked for
    work = [children(root)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        if key[0] not in known:
            known[key[0]] = matches(layer.text)
        hits = known[key[0]]
        if hits:
            start, end = layer.root(np.array([h[0] for h in hits]), np.array([h[1] - 1 for h in hits]))
            found.update(zip(start.tolist(), end.tolist(), (h[2] for h in hits), strict=True))
        work.append(children(layer))
    return base, sorted(found - set(base))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(1):
            base, more = scan(value.as_py() or "")
            counts = [sum(k == kind for _, _, k in base) for kind in range(3)]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *(x.split()[0] for x in _SCHEMA.split(", "))])


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and digest of what the text itself shows, and all spans."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, f"doc_id {id_type}, {_SCHEMA}")
