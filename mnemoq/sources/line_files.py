"""Lines of growing text files as a data source, for batches and streams: splits by byte range, each line with its first
byte, and an unfinished last line held back until its line break is there.

    register(spark)
    spark.read.format("line_files").option("split", "64m").load(folder)
    spark.readStream.format("line_files").load(folder)

Rows are (file, start, value, first): the line's file and first byte, its text, and the first line of the file, which
tells what kind of file it is. The option "files" is a pattern that a file's path below the folder must match as a whole,
"first" one that is looked for in its first line: of a file without it a task reads no more. A split is what a task reads: it begins with the first line that starts in its range and
ends with the last one that does, and holds a piece of PIECE bytes or one line in memory. A file of any size is read so.

A stream's offset says for each file how far it was read (behind a line break) and what its first bytes were. A file that
is shorter than that, or begins otherwise, was cut or replaced and is read from its start again. All of it is in the
offset, so a stream that is started again from its checkpoint goes on where it was.

Defined cases: an empty file, or one without any line break, has no rows yet; empty lines are left out; bytes that are no
UTF-8 become replacement characters; a line break within a character's bytes can't be, as UTF-8 has none there; a file
that is gone has no more rows; names that begin with "." or "_" are passed over. Any file system that pyarrow reaches
by the folder's address will do.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start long, value string, first string"
SPLIT = 64 << 20
PIECE = 1 << 20
HEAD = 256  # bytes that tell whether a file is still the same one


def _bytes(size: str) -> int:
    units = {"k": 10, "m": 20, "g": 30}
    return int(size[:-1]) << units[size[-1].lower()] if size[-1].lower() in units else int(size)


def _files(path: str, names: str | None = None) -> list[fs.FileInfo]:
    """The files at or below a path, by name, of those names that match."""
    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    fits = lambda f: names is None or re.fullmatch(names, f.base_name if info.is_file else f.path[len(root.rstrip("/")) + 1 :])
    return sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_")) and fits(f)), key=lambda f: f.path)


def _tail(file, size: int) -> int:
    """The place behind the last line break of the first ``size`` bytes."""
    end = size
    while end > 0:
        begin = max(0, end - PIECE)
        file.seek(begin)
        at = file.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def _line(file, at: int, size: int) -> bytes:
    """The bytes from a place to the next line break, or to the end."""
    out = []
    file.seek(at)
    while at < size:
        piece = file.read(min(PIECE, size - at))
        if not piece:
            break
        cut = piece.find(b"\n")
        out.append(piece if cut < 0 else piece[:cut])
        if cut >= 0:
            break
        at += len(piece)
    return b"".join(out)


def lines_in(file, start: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines that start in [start, stop) and are finished before ``end``."""
    if start:  # what a line before us began is that split's
        start = start - 1 + len(_line(file, start - 1, end)) + 1
    at, rest = start, []
    file.seek(start)
    read = start
    while at < stop and read < end:
        piece = file.read(min(PIECE, end - read))
        if not piece:
            return
        read += len(piece)
        *whole, last = piece.split(b"\n")
        for line in whole:
            line = b"".join([*rest, line])
            rest = []
            if at >= stop:
                return
            if line:
                yield at, line
            at += len(line) + 1
        rest.append(last)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int
    end: int  # no byte from here on is looked at


def _ranges(path: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(path, a, min(a + split, end), end) for a in range(start, end, split)]


class _Reads:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], _bytes(options.get("split", str(SPLIT)))
        self.names, self.first = options.get("files"), options.get("first")
        self.root = self.path if "://" in self.path or self.path.startswith("/") else f"/{self.path}"

    def read(self, part: Range) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.root)
        try:
            file = system.open_input_file(part.file)
        except FileNotFoundError:  # gone since the offset was taken
            return
        with file:
            first = _line(file, 0, part.end).decode("utf-8", "replace")
            if self.first and not re.search(self.first, first):
                return
            for at, line in lines_in(file, part.start, part.stop, part.end):
                yield part.file, at, line.decode("utf-8", "replace"), first


class LineReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for f in _files(self.root, self.names) for r in _ranges(f.path, 0, f.size, self.split)] or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        return super().read(part) if part.end else iter(())


class LineStream(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{file: [end, bytes of the head, their crc]}; what lies behind the last line break isn't counted yet."""
        system, _ = fs.FileSystem.from_uri(self.root)
        out = {}
        for f in _files(self.root, self.names):
            with system.open_input_file(f.path) as file:
                end = _tail(file, f.size)
                if end:
                    file.seek(0)
                    head = file.read(min(HEAD, end))
                    out[f.path] = [end, len(head), zlib.crc32(head)]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        system, _ = fs.FileSystem.from_uri(self.root)
        out = []
        for path, (stop, _, _) in sorted(end.items()):
            begin, size, crc = start.get(path, [0, 0, 0])
            if begin:
                try:
                    with system.open_input_file(path) as file:
                        if stop < begin or zlib.crc32(file.read(size)) != crc:
                            begin = 0  # cut or replaced
                except FileNotFoundError:
                    continue
            out += _ranges(path, begin, stop, self.split)
        return out

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the stream's own log."""


class LineFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStream:
        return LineStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineFiles)
