"""Feeds whose files grow: a data source that reads JSON lines, plain or gzip, up to what is there, as a table or as a stream.

A stream's offset holds the size in bytes that each file had. A batch from one offset to the next gives, of every file that has
grown, the lines that are whole at the new size and were not at the old one. So a gzip file that is cut in the middle of a line, or
of its own compressed data, gives its readable lines now and the others when it has grown; nothing comes twice and a repeated
batch is the same. Files may only be added and be added to. Plain files are read from where the old size ends, and in parts;
a gzip file is unpacked from its start, in chunks, so its memory does not grow with it.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .feeds import BAD, _with_bad

CHUNK, ROWS = 1 << 20, 4096
#: A plain file is read in parts of this size.
PART = 64 << 20


@dataclass
class Part(InputPartition):
    """Bytes ``start`` to ``stop`` of a file; ``last``: a line without an end at ``stop`` counts as one."""

    path: str
    name: str
    start: int
    stop: int
    last: bool


def _files(path: str) -> Iterator[tuple[str, str, int, float]]:
    """(path, name, size, time of last change) of a folder's files, by name; hidden ones and ones in work are none."""
    store, top = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    for info in sorted(found, key=lambda x: x.base_name):
        if info.type == fs.FileType.File and info.base_name[0] not in "._":
            yield f"{path.rstrip('/')}/{info.base_name}", info.base_name, info.size, info.mtime_ns / 1e9


def _readable(member, raw: bytes) -> tuple[bytes, bool]:
    """(what unpacks, whether the rest is damaged): halves are tried on copies, so that all before the damage is had."""
    kept = member.copy()
    try:
        return member.decompress(raw), False
    except zlib.error:
        out = b""
    while len(raw) > 1:
        half = len(raw) // 2
        ahead = kept.copy()
        try:
            out += ahead.decompress(raw[:half])
            kept, raw = ahead, raw[half:]
        except zlib.error:
            raw = raw[:half]
    return out, True


def _unpacked(source, stop: int, start: int) -> Iterator[tuple[bytes, bool]]:
    """(data, whether it was there at ``start``) of the first ``stop`` bytes of gzip members one after the other; what can't be
    unpacked ends it. A chunk ends at ``start``, so that no data is of both sides."""
    at, member = 0, zlib.decompressobj(31)
    while at < stop:
        raw = source.read(min(CHUNK, (start if at < start else stop) - at))
        if not raw:
            break
        at += len(raw)
        out, bad = [], False
        while raw and not bad:
            if member.eof:
                member = zlib.decompressobj(31)
            data, bad = _readable(member, raw)
            out.append(data)
            raw = member.unused_data
        yield b"".join(out), at <= start
        if bad:
            return


def _lines_of_gzip(source, part: Part) -> Iterator[bytes]:
    """The lines whose ends were not there at ``start``."""
    rest = b""
    for data, old in _unpacked(source, part.stop, part.start):
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        if not old:
            yield from lines
    if rest and part.last:
        yield rest


def _line_start(source, at: int) -> int:
    """Where the line begins that holds byte ``at``: after the last line end before it."""
    while at > 0:
        begin = max(0, at - CHUNK)
        source.seek(begin)
        found = source.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def _lines_of_plain(source, part: Part) -> Iterator[bytes]:
    """The lines whose ends lie in the range."""
    at = _line_start(source, part.start)
    source.seek(at)
    rest = b""
    while at < part.stop:
        data = source.read(min(CHUNK, part.stop - at))
        if not data:
            break
        at += len(data)
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        yield from lines
    if rest and part.last:
        yield rest


def _rows(part: Part) -> Iterator[pa.RecordBatch]:
    store, path = fs.FileSystem.from_uri(part.path)
    held: list[str] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.name] * len(held), pa.string()), pa.array(held, pa.string())], ["src_file", "value"])

    with store.open_input_file(path) as source:
        size = 0
        for line in (_lines_of_gzip if part.name.endswith(".gz") else _lines_of_plain)(source, part):
            held.append(line.decode("utf-8", "replace").rstrip("\r"))
            size += len(line)
            if len(held) == ROWS or size > CHUNK:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


def _parts(path: str, name: str, start: int, stop: int, last: bool) -> list[Part]:
    """A file's range; a plain file's in parts, of which each has the lines that end in it."""
    cuts = [start, stop] if name.endswith(".gz") else [*range(start, stop, PART), stop]
    return [Part(path, name, a, b, last and b == stop) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class _Batch(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Part]:
        return [p for path, name, size, _ in _files(self.path) for p in _parts(path, name, 0, size, True)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets: ``sizes`` by file name, and ``done``, the name up to which all files are finished and need no entry any more.

    A file is finished when a batch up to its size is committed and its last change is ``settled`` seconds ago.
    """

    def __init__(self, path: str, settled: float | None) -> None:
        self.path, self.settled, self.done = path, settled, ""

    def initialOffset(self) -> dict:
        return {"done": "", "sizes": {}}

    def latestOffset(self) -> dict:
        return {"done": self.done, "sizes": {name: size for _, name, size, _ in _files(self.path) if name > self.done}}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        top = self.path.rstrip("/")
        return [p for name, size in end["sizes"].items() if name > start["done"] for p in _parts(f"{top}/{name}", name, start["sizes"].get(name, 0), size, False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        if self.settled is None:
            return
        for _, name, size, changed in _files(self.path):
            if name <= self.done:
                continue
            if end["sizes"].get(name) != size or time.time() - changed < self.settled:
                break
            self.done = name


class GrowingFeed(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("growing_feed").load(folder)``: src_file and value, a row for each line.

    Option ``settledSeconds``: files unchanged for so long leave the stream's offsets once they are read, up to the first one that
    is not; without it, all stay. A stream leaves a last line without an end for later; a table has it.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_feed"

    def schema(self) -> str:
        return "src_file string, value string"

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> _Stream:
        settled = self.options.get("settledSeconds")
        return _Stream(self.options["path"], None if settled is None else float(settled))


def growing_feed(spark: SparkSession, path: str, schema: StructType | str, stream: bool = False, settled_s: float | None = None) -> DataFrame:
    """The feed's rows as ``schema`` has them, with ``src_file``; lines that do not parse go."""
    spark.dataSource.register(GrowingFeed)
    reader = (spark.readStream if stream else spark.read).format("growing_feed")
    if settled_s is not None:
        reader = reader.option("settledSeconds", settled_s)
    kind = _with_bad(schema)
    rows = reader.load(path).select("src_file", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("x"))
    return rows.where(F.col("x").isNotNull() & F.col(f"x.{BAD}").isNull()).select(*(f"x.{n}" for n in kind.names if n != BAD), "src_file")
