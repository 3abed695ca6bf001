"""Streaming source over growing JSONL files: only complete appended lines, each exactly once.

The offset holds, for every file that is there, the byte after its last complete line that was given out, and the size and time of
the file at that moment: a file in which neither has changed is not opened again, and one that is gone leaves the offset.  A line still being
written waits; a file that shrank is read again from the start.  Work is split by bytes, so one huge file becomes many tasks.

Besides lines the source gives rows about files (column ``event``): ``truncated`` where a file shrank, ``read_error`` where it
could not be opened, ``readable`` where it could be again.  ``since`` is the file's time as of the read before.  An unreadable file stays where it
was and holds up no other; ``lines`` and ``incidents`` pick the two kinds apart.

Read it with ``spark.readStream.format("jsonl_tail").option("path", folder).load()`` after ``spark.dataSource.register(JsonlTail)``.
``maxBytesPerTrigger`` limits what one batch takes (at least one line of a file); it needs ``frontier``, the path of a small file that
the source keeps beside the checkpoint, as Spark does not tell a reader after a restart how far it had come.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, block bigint, seq bigint, mtime bigint, value string, event string, since bigint"
_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("mtime", pa.int64()), ("value", pa.string()),
                    ("event", pa.string()), ("since", pa.int64())])
_CHUNK = 8 << 20


@dataclass
class Slice(InputPartition):
    """Bytes [start, end) of a file; lines belong to the slice they begin in."""

    file: str
    start: int
    end: int
    limit: int
    mtime: int
    first: bool


@dataclass
class Incidents(InputPartition):
    """What happened to files: (file, time, event, detail, time before)."""

    rows: list[tuple[str, int, str, str, int | None]]


@dataclass
class Mark:
    """Where a file stands: how often it began anew, the byte after the last line given out, size and time then, whether more is there, and an error."""

    turn: int = 0
    at: int = 0
    size: int = -1
    mtime: int = 0
    more: bool = False
    error: str = ""


def _marks(offset: dict) -> dict[str, Mark]:
    return {f: Mark(*m) for f, m in json.loads(offset["files"]).items()}


def _offset(marks: dict[str, Mark]) -> dict:
    return {"files": json.dumps({f: [m.turn, m.at, m.size, m.mtime, m.more, m.error] for f, m in marks.items()}, sort_keys=True)}


def lines(rows: DataFrame) -> DataFrame:
    """The lines of files."""
    return rows.where(F.col("event").isNull()).drop("event", "since")


def incidents(rows: DataFrame) -> DataFrame:
    """What happened to files: (file, event, detail, since, mtime)."""
    return rows.where(F.col("event").isNotNull()).select("file", "event", F.col("value").alias("detail"), "since", "mtime")


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str, suffix: str) -> dict[str, tuple[int, int]]:
    """File -> (size, modification micros) below ``path``."""
    system, root = _filesystem(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: (f.size, (f.mtime_ns or 0) // 1000) for f in found if f.is_file and f.path.endswith(suffix)}


def last_line_end(path: str, file: str, start: int, size: int) -> int:
    """Byte after the last newline in [start, size), found from the back."""
    system, _ = _filesystem(path)
    with system.open_input_file(file) as f:
        at = size
        while at > start:
            low = max(start, at - _CHUNK)
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    return start


def first_line_end(path: str, file: str, start: int, size: int) -> int:
    """Byte after the first newline in [start, size); ``start`` if there is none."""
    system, _ = _filesystem(path)
    with system.open_input_file(file) as f:
        at = start
        f.seek(at)
        while at < size:
            block = f.read(min(_CHUNK, size - at))
            if not block:
                break
            cut = block.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(block)
    return start


def slices(file: str, start: int, end: int, mtime: int, width: int) -> list[Slice]:
    return [Slice(file, a, min(a + width, end), end, mtime, a == start) for a in range(start, end, width)]


def read_slice(path: str, part: Slice) -> Iterator[pa.RecordBatch]:
    system, _ = _filesystem(path)
    with io.BufferedReader(system.open_input_file(part.file), 1 << 20) as f:
        at = part.start
        f.seek(at)
        if not part.first:
            # The line that runs into this slice belongs to the one before.
            f.seek(at - 1)
            at += len(f.readline()) - 1
        seqs, values, held = [], [], 0
        while at < part.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                break
            seqs.append(at)
            values.append(line[:-1].decode("utf-8", "replace"))
            at += len(line)
            held += len(line)
            if held >= _CHUNK:
                yield _batch(part, seqs, values)
                seqs, values, held = [], [], 0
        if seqs:
            yield _batch(part, seqs, values)


def _batch(part: Slice, seqs: list[int], values: list[str]) -> pa.RecordBatch:
    n = len(seqs)
    return pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array([part.start] * n, pa.int64()), pa.array(seqs, pa.int64()),
                                       pa.array([part.mtime] * n, pa.int64()), pa.array(values, pa.string()), pa.nulls(n, pa.string()),
                                       pa.nulls(n, pa.int64())], schema=_ARROW)


def _told(rows: list[tuple[str, int, str, str, int | None]]) -> pa.RecordBatch:
    file, mtime, event, detail, since = (list(c) for c in zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(file), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(mtime, pa.int64()),
                                       pa.array(detail, pa.string()), pa.array(event), pa.array(since, pa.int64())], schema=_ARROW)


class _Options:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".jsonl")
        self.width = int(options.get("slicebytes", options.get("sliceBytes", 128 << 20)))
        self.limit = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 0))) or None
        self.frontier = options.get("frontier")
        if self.limit and not self.frontier:
            raise ValueError("maxBytesPerTrigger needs frontier, a path for the source's own mark")


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.o = _Options(options)
        self._known: dict[str, Mark] | None = None

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _standing(self) -> dict[str, Mark]:
        """The end of the last batch: as this reader saw it, or as the one before wrote it down."""
        if self._known is None and self.o.frontier:
            system, at = _filesystem(self.o.frontier)
            if system.get_file_info(at).is_file:
                with system.open_input_stream(at) as f:
                    self._known = _marks(json.loads(f.read()))
        return self._known or {}

    def _reach(self, file: str, start: int, size: int, budget: int | None) -> int:
        stop = size if budget is None else min(size, start + budget)
        end = last_line_end(self.o.path, file, start, stop)
        return first_line_end(self.o.path, file, start, size) if end == start and stop < size else end

    def latestOffset(self) -> dict:
        known, out, budget = self._standing(), {}, self.o.limit
        found = list_files(self.o.path, self.o.suffix)
        for file, (size, mtime) in sorted(found.items(), key=lambda f: (f[1][1], f[0])):
            old = known.get(file)
            if old and (old.size, old.mtime) == (size, mtime) and not old.more and not old.error:
                out[file] = old
            elif budget is not None and budget <= 0:
                if old:
                    out[file] = old
            else:
                was = old or Mark()
                anew = size < was.at
                start = 0 if anew else was.at
                try:
                    end = self._reach(file, start, size, budget)
                except OSError as e:
                    out[file] = Mark(was.turn, was.at, was.size, was.mtime, was.more, type(e).__name__)
                    continue
                out[file] = Mark(was.turn + anew, end, size, mtime, budget is not None and start + budget < size)
                budget = None if budget is None else budget - (end - start)
        return _offset(out)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = _marks(start), _marks(end)
        out: list[InputPartition] = []
        told = []
        for file, m in b.items():
            was = a.get(file)
            begin = was.at if was and was.turn == m.turn else 0
            out += slices(file, begin, m.at, m.mtime, self.o.width)
            if was and was.turn != m.turn:
                told.append((file, m.mtime, "truncated", None, was.mtime))
            if m.error and (not was or was.error != m.error):
                told.append((file, m.mtime, "read_error", m.error, was.mtime if was and was.size >= 0 else None))
            if was and was.error and not m.error:
                told.append((file, m.mtime, "readable", None, was.mtime))
        if told:
            out.append(Incidents(told))
        # Spark has written this batch down, so it will be run, now or after a restart
        self._known = b
        if self.o.frontier:
            system, at = _filesystem(self.o.frontier)
            with system.open_output_stream(f"{at}.new") as f:
                f.write(json.dumps(end).encode())
            system.move(f"{at}.new", at)
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return iter([_told(partition.rows)]) if isinstance(partition, Incidents) else read_slice(self.o.path, partition)


class WholeReader(DataSourceReader):
    """Batch twin: every complete line of every file."""

    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> list[Slice]:
        out = []
        for file, (size, mtime) in sorted(list_files(self.o.path, self.o.suffix).items()):
            out += slices(file, 0, last_line_end(self.o.path, file, 0, size), mtime, self.o.width)
        return out or [Slice("", 0, 0, 0, 0, True)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(self.o.path, partition) if partition.file else iter(())


class JsonlTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WholeReader:
        return WholeReader(self.options)

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
