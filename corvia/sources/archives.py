"""Zip archives of judgments as a data source: a partition for each archive, members streamed.

An archive is opened where it lies and never held as one value; a member of up to WHOLE bytes is read at once, a longer
one in pieces: of an array, item by item, else line by line. Stores are reached by pyarrow's file systems. Bad
archives give no rows, bad members are skipped; so is a long member that is not UTF-8 from the first bad byte on.
"""

from __future__ import annotations

import codecs
import io
import json
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvia.sources.records import MEMBERS, RECORD, parse_json, record

WHOLE, PIECE = 16 << 20, 1 << 20


def _items(pieces: Iterator[str]) -> Iterator[object]:
    """The values of a JSON array that comes in pieces; ends where it is no JSON."""
    decoder, held, at = json.JSONDecoder(), "", 0
    for piece in pieces:
        held, at = held[at:] + piece, 0
        if held[:1] == "[":
            at = 1
        while True:
            while at < len(held) and held[at] in ", \t\r\n":
                at += 1
            if at >= len(held) or held[at] == "]":
                break
            try:
                value, end = decoder.raw_decode(held, at)
            except ValueError:
                break  # not whole yet
            if end == len(held):
                break  # a number might go on
            yield value
            at = end


def _lines(pieces: Iterator[str]) -> Iterator[object]:
    held = ""
    for piece in pieces:
        *whole, held = (held + piece).split("\n")
        for line in whole:
            yield from _value(line)
    yield from _value(held)


def _value(line: str) -> Iterator[object]:
    try:
        yield json.loads(line)
    except ValueError:
        return


def _pieces(file: io.BufferedIOBase, size: int) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    try:
        while raw := file.read(size):
            yield decoder.decode(raw)
    except UnicodeDecodeError:
        return


def streamed(file: io.BufferedIOBase, size: int = PIECE) -> Iterator[dict]:
    """The objects of a long member, a piece in memory at a time."""
    pieces = _pieces(file, size)
    first = ""
    for piece in pieces:
        first += piece
        if first.strip():
            break
    first = first.lstrip()

    def rest() -> Iterator[str]:
        yield first
        yield from pieces

    for value in _items(rest()) if first[:1] == "[" else _lines(rest()):
        if isinstance(value, dict):
            yield value


def members_of(file, whole: int = WHOLE) -> Iterator[dict]:
    """The objects of all JSON members of an open archive, in their order."""
    try:
        archive = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, OSError, ValueError):
        return
    with archive:
        for info in archive.infolist():
            if not info.filename.lower().endswith(MEMBERS):
                continue
            try:
                if info.file_size <= whole:
                    yield from parse_json(archive.read(info))
                else:
                    with archive.open(info) as member:
                        yield from streamed(member)
            except (zipfile.BadZipFile, OSError, RuntimeError, EOFError, NotImplementedError):
                continue


class ArchivePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.whole = options["path"], int(options.get("whole", WHOLE))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[ArchivePartition]:
        from pyarrow import fs

        store, path = self._store()
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=False))
        names = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))
        return [ArchivePartition(n) for n in names]

    def read(self, partition: ArchivePartition | None) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        store, _ = self._store()
        with store.open_input_file(partition.value) as file:
            name = partition.value.rsplit("/", 1)[-1]
            for found in members_of(file, self.whole):
                yield record(found, name)


class ArchiveSource(DataSource):
    """spark.read.format("judgment_archives").load(path): records of the zip archives at a path."""

    @classmethod
    def name(cls) -> str:
        return "judgment_archives"

    def schema(self):
        return RECORD

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """Records of a zip archive, or of all zip archives in a folder, with the archive's name in source_zip."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).option("whole", whole).load(path)
