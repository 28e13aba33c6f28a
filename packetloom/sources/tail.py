"""A stream over growing, tab-separated sensor logs, followed by byte positions.

The offset of the stream is, for each file, the byte after its last whole line. A batch hands out what lies between two
offsets as byte ranges, so a large log is read by many tasks, and what was read is never read again. A file
that was cut or rewritten is read from its beginning under its new header.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "sensor_log"
SCHEMA = "file string, position bigint, fields string, value string"
#: Bytes of a range, of a read, and before a position that must be the same when the file is read on.
RANGE_BYTES, READ_BYTES, MARK_BYTES = 64 << 20, 1 << 20, 256


@dataclass
class Range(InputPartition):
    """Lines that begin in [begin, end) of a file; ``whole`` if a line begins at ``begin``."""

    file: str
    begin: int
    end: int
    whole: bool
    fields: str


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _mark(file: pa.NativeFile, at: int) -> str:
    """A digest of the bytes just before a position."""
    begin = max(0, at - MARK_BYTES)
    file.seek(begin)
    return hashlib.md5(file.read(at - begin), usedforsecurity=False).hexdigest()


def _last_line_end(file: pa.NativeFile, size: int) -> int:
    """The position after the last line feed; 0 without one."""
    end = size
    while end:
        begin = max(0, end - READ_BYTES)
        file.seek(begin)
        found = file.read(end - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def _header(file: pa.NativeFile, size: int) -> str | None:
    """The ``#fields`` line among the comments a file begins with, without its name.

    Empty if another line comes first; None if it may still come.
    """
    held, at = b"", 0
    while True:
        lines = held.split(b"\n")
        for line in lines[:-1]:
            if line.startswith(b"#fields"):
                return line.decode("utf-8", "replace").strip().partition("\t")[2]
            if not line.startswith(b"#"):
                return ""
        if at >= size:
            return None
        file.seek(at)
        more = file.read(min(READ_BYTES, size - at))
        held, at = lines[-1] + more, at + len(more)


class SensorLog(DataSource):
    """``format("sensor_log")``: options path (a file or folder), pattern (of file names) and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SensorLogReader(dict(self.options))


class SensorLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """Position, mark and header of each file that has a whole line beyond leading comments."""
        store, path = _open(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        files = {}
        for entry in sorted(found, key=lambda e: e.path):
            if entry.type != fs.FileType.File or not entry.size or not fnmatch.fnmatch(entry.base_name, self.pattern):
                continue
            with store.open_input_file(entry.path) as file:
                size = file.size()
                fields, at = _header(file, size), _last_line_end(file, size)
                if fields is not None and at:
                    files[entry.path] = {"at": at, "mark": _mark(file, at), "fields": fields}
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        store, _ = _open(self.path)
        ranges = []
        for path, now in end["files"].items():
            begin, before = 0, start["files"].get(path)
            if before and before["fields"] == now["fields"] and before["at"] <= now["at"]:
                with store.open_input_file(path) as file:
                    begin = before["at"] if _mark(file, before["at"]) == before["mark"] else 0
            for at in range(begin, now["at"], self.range_bytes):
                ranges.append(Range(path, at, min(at + self.range_bytes, now["at"]), at == begin, now["fields"]))
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        with store.open_input_file(partition.file) as file:
            if file.size() < partition.end or _header(file, file.size()) != partition.fields:
                return  # cut after the offset was taken: these lines are gone, the next batch reads the new ones
            at = partition.begin if partition.whole else partition.begin - 1
            file.seek(at)
            held, skip = b"", not partition.whole
            while at < partition.end or held:
                more = file.read(READ_BYTES)
                lines = (held + more).split(b"\n")
                held = lines.pop() if more else b""
                values, places = [], []
                for line in lines:
                    if at >= partition.end:
                        break
                    if not skip and not line.startswith(b"#") and line.strip():
                        values.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                        places.append(at)
                    skip, at = False, at + len(line) + 1
                if values:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.file] * len(values)), pa.array(places, pa.int64()),
                         pa.array([partition.fields] * len(values)), pa.array(values)],
                        names=["file", "position", "fields", "value"],
                    )
                if not more or at >= partition.end:
                    return


def follow(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of the lines appended to the logs under ``path``: file, position, fields (of the header) and value.

    Comments, blank lines and a last line without its line feed are left out; the latter comes when it is
    whole. A file of nothing but comments waits for a header; one that begins with a row has the fields ''. Logs must lie where driver and executors reach them by the same
    name: a shared folder or a store that Arrow's file systems know.
    """
    spark.dataSource.register(SensorLog)
    return (
        spark.readStream.format(FORMAT).option("path", path).option("pattern", pattern)
        .option("rangeBytes", range_bytes).load()
    )
