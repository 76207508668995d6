"""Capture files as a data source: ``spark.read.format("pcap")`` and ``spark.readStream.format("pcap")``.

Rows are those of :func:`flowloom.sources.pcap.pcap_ingest`. Options: ``path``, a folder whose ``*.pcap`` files are
read, and ``splitBytes``, about how much of a file one task reads.

Planning lists files and reads the head of the large ones. A task finds by itself the record boundary that it
begins with, and the one with which the next task begins, so both tell the same place without the driver. Where
none can be told for sure, the task before reads on.

A stream's offset holds, for each file, the byte up to which its records are complete. Files that grow are followed: a record
that is still being written waits for the next micro-batch. Files may only be appended to. The offset has an entry for
every file of the folder, so captures that are done for should be moved away in time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowloom.sources.pcap import HEAD_BYTES, MAX_RECORD, PACKET_FILE_SCHEMA, _file_form, _opened, first_boundary, read_capture

SPLIT_BYTES = 256 << 20


@dataclass
class Piece(InputPartition):
    """The records of ``path`` from about byte ``at`` to about ``at + step``.

    ``exact``: a record begins at ``at``. Pieces begin before ``last_start``; the last one ends at ``stop``, with the file if it is None.
    """

    path: str
    at: int
    step: int
    exact: bool
    last_start: int
    stop: int | None


def _files(folder: str) -> dict[str, int]:
    """Name and size of the captures of a folder."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder if ":/" in folder else "file://" + folder)
    found = system.get_file_info(fs.FileSelector(inner))
    return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith(".pcap")}


def _path(folder: str, name: str) -> str:
    return f"{folder if ':/' in folder else 'file://' + folder}".rstrip("/") + "/" + name


def _window(stream) -> int:
    """How many bytes :func:`first_boundary` looks at."""
    stream.seek(0)
    return 16 * (_file_form(stream)[2] + 16)


def _pieces(path: str, begin: int, size: int, stop: int | None, split: int) -> list[Piece]:
    """Pieces of the bytes from ``begin`` to ``size``; a boundary is only looked for in bytes before ``size``, which stay as they are."""
    if size - begin <= split:
        return [Piece(path, begin, split, True, begin + 1, stop)]
    with _opened(path) as stream:
        window = _window(stream)
    # boundaries lie in the window behind a start, so those of different pieces are in order
    step = max(split, window)
    last_start = max(begin + 1, size - window)
    return [Piece(path, at, step, at == begin, last_start, stop) for at in range(begin, last_start, step)]


def _read(piece: Piece, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    with _opened(piece.path) as stream:
        size = stream.size()

        def boundary(at: int) -> int | None:
            stream.seek(0)
            return first_boundary(stream, at, size)

        begin = piece.at if piece.exact else boundary(piece.at)
        if begin is None:
            return
        later = (boundary(at) for at in range(piece.at + piece.step, piece.last_start, piece.step))
        end = next((found for found in later if found is not None), piece.stop)
        stream.seek(0)
        for rows in read_capture(stream, begin, end):
            rows.insert(0, "file", piece.path.rsplit("/", 1)[-1])
            yield pa.RecordBatch.from_pandas(rows[PACKET_FILE_SCHEMA.names], schema=schema, preserve_index=False)


def complete_until(stream, size: int) -> int:
    """The byte at which the last complete record of a capture's first ``size`` bytes ends."""
    window = _window(stream)
    at = HEAD_BYTES
    if size > 2 * window:
        stream.seek(0)
        at = first_boundary(stream, size - 2 * window, size) or HEAD_BYTES
    stream.seek(0)
    length = struct.Struct(_file_form(stream)[0] + "I")
    while at + 16 <= size:
        stream.seek(at + 8)
        kept = length.unpack(stream.read(4))[0]
        if kept > MAX_RECORD:
            raise ValueError(f"bad record length at byte {at}")
        if at + 16 + kept > size:
            break
        at += 16 + kept
    return at


class _Reader(DataSourceReader):
    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split = folder, split
        self.schema = to_arrow_schema(PACKET_FILE_SCHEMA)

    def partitions(self) -> list[Piece]:
        return [p for name, size in _files(self.folder).items() for p in _pieces(_path(self.folder, name), HEAD_BYTES, size, None, self.split)]

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        # without any file Spark asks once, for no partition
        return _read(partition, self.schema) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split = folder, split
        self.schema = to_arrow_schema(PACKET_FILE_SCHEMA)
        self.known: dict[str, tuple[int, int]] = {}  # file -> size when last looked at, complete bytes

    def initialOffset(self) -> dict:
        return {"complete": {}}

    def latestOffset(self) -> dict:
        for name, size in _files(self.folder).items():
            if size >= HEAD_BYTES and self.known.get(name, (0, 0))[0] != size:
                with _opened(_path(self.folder, name)) as stream:
                    self.known[name] = size, complete_until(stream, size)
        return {"complete": {name: done for name, (_, done) in sorted(self.known.items())}}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for name, stop in end["complete"].items():
            begin = start["complete"].get(name, HEAD_BYTES)
            if stop > begin:
                pieces += _pieces(_path(self.folder, name), begin, stop, stop, self.split)
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema)

    def commit(self, end: dict) -> None:
        """Nothing is held back for batches that are done."""


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> StructType:
        return PACKET_FILE_SCHEMA

    def _asked(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("the path of a folder of captures is needed")
        return self.options["path"], max(1, int(self.options.get("splitBytes", SPLIT_BYTES)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._asked())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(*self._asked())


def register(spark: SparkSession) -> None:
    """Makes ``format("pcap")`` known to a session. Spark refuses the name in sessions that ``newSession`` makes of one which has it."""
    spark.dataSource.register(PcapSource)
