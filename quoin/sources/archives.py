"""Archives as Spark data sources: their members, and their texts in parts, read by byte ranges.

    archives.register(spark)
    spark.read.format("archive_members").load(folder)   # path, kind, member, at, size, packed, error
    spark.read.format("archive_texts").load(folder)     # path, kind, part, member, text, error

Reading is planned by size: small archives share a partition, and one that is larger than `splitBytes` is cut into byte ranges, so that many tasks read one archive. A member is of the range in which it begins.
A task reads the directory at an archive's end and its own members; no archive is ever read whole, and a text leaves a task part by part: a chapter of an EPUB in reading order, or a block of paragraphs of a DOCX.

Options: `splitBytes`, `pathGlobFilter` (of file names), `most` (bytes that an archive may unpack to).

What can't be read is a row with its error: a file that is no archive, one with a name that leaves it or that unpacks to too much (one row each, its kind null), an archive of no known kind, a chapter that is damaged (the others
stay). An EPUB whose chapters are empty and an empty folder have no rows. A folder that isn't there fails. Files whose names begin with a dot or an underscore are left out, as Spark's own sources do.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quoin.sources import formats

SPLIT, OPEN = 64 << 20, 1 << 20  # bytes of a partition, and what opening a file counts for
BLOCK, BUFFER = 1 << 20, 1 << 18  # characters of a block of paragraphs, and bytes of one read (smaller archives are one)
ROWS, CHARS = 500, 4 << 20  # of a batch


@dataclass
class Ranges(InputPartition):
    """(path, from, to) of what one task reads."""

    ranges: list[tuple[str, int, int]]


def planned(sizes: list[tuple[str, int]], split: int) -> list[Ranges]:
    """Files in the order of their paths, in ranges of `split` bytes at most, as many to a partition as fit."""
    out: list[Ranges] = []
    room = 0
    for path, size in sorted(sizes):
        for lo in range(0, max(size, 1), split):
            hi = min(lo + split, max(size, 1))
            if not out or hi - lo + OPEN > room:
                out.append(Ranges([]))
                room = split + OPEN
            out[-1].ranges.append((path, lo, hi))
            room -= hi - lo + OPEN
    return out or [Ranges([])]


class _Reader(DataSourceReader):
    fields: list[tuple[str, str]]

    def __init__(self, options) -> None:
        self.root = options["path"]
        self.split = int(options.get("splitBytes", SPLIT))
        self.most = int(options.get("most", formats.ZIP_MOST))
        self.glob = options.get("pathGlobFilter", "*")
        if self.split <= 0:
            raise ValueError("splitBytes must be above 0")

    def _store(self) -> tuple[fs.FileSystem, str]:
        at = self.root[5:] if self.root.startswith("file:/") and not self.root.startswith("file://") else self.root
        return fs.FileSystem.from_uri(at if "://" in at else f"file://{quote(at)}")

    def partitions(self) -> list[Ranges]:
        store, base = self._store()
        found = store.get_file_info(base)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        own = [found] if found.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
        return planned([(i.path, i.size) for i in own if i.is_file and not i.base_name.startswith((".", "_")) and fnmatch.fnmatchcase(i.base_name, self.glob)], self.split)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in self.fields])
        rows, chars = [], 0
        for row in self._rows(partition):
            rows.append(row)
            chars += sum(len(v) for v in row if isinstance(v, str))
            if len(rows) >= ROWS or chars >= CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def _rows(self, partition: Ranges) -> Iterator[tuple]:
        store, base = self._store()
        for path, lo, hi in partition.ranges:
            name = path[len(base) :].lstrip("/") or path.rsplit("/", 1)[-1]
            with store.open_input_file(path) as f:
                try:
                    files = formats.Members(io.BytesIO(f.read()) if f.size() <= BUFFER else io.BufferedReader(f, BUFFER), self.most)
                    kind = files.kind()
                    rows = self.of(files, kind, lo, hi)
                except Exception as e:  # a bad archive is a row with its error, told by the task of its first bytes
                    kind, rows = None, [self.failed(e)] if lo == 0 else []
                for r in rows:
                    yield (name, kind, *r)

    def of(self, files: formats.Members, kind: str | None, lo: int, hi: int) -> Iterator[tuple]:
        """Rows of the members that begin in a range. What fails before the first row is the whole archive's error."""
        raise NotImplementedError

    def failed(self, e: Exception) -> tuple:
        return (*[None] * (len(self.fields) - 3), f"{type(e).__name__}: {e}")


class _Listing(_Reader):
    fields = [("path", "string"), ("kind", "string"), ("member", "string"), ("at", "long"), ("size", "long"), ("packed", "long"), ("error", "string")]

    def of(self, files, kind, lo, hi):
        return ((n, i.header_offset, i.file_size, i.compress_size, None) for n, i in files.infos.items() if lo <= i.header_offset < hi)


class _Texts(_Reader):
    fields = [("path", "string"), ("kind", "string"), ("part", "int"), ("member", "string"), ("text", "string"), ("error", "string")]

    def of(self, files, kind, lo, hi):
        if kind == "epub":
            return self._chapters(files, [(n, m) for n, m in enumerate(formats.spine(files)) if lo <= files.infos[m].header_offset < hi])
        if kind == "docx":
            return self._blocks(files) if lo <= files.infos[formats.DOCUMENT].header_offset < hi else iter(())
        if lo == 0:
            raise ValueError("archive of no known kind")
        return iter(())

    def _chapters(self, files, own):
        for n, member in own:
            try:
                text = formats.html_text(formats.decoded(files[member]))
                if text.strip():
                    yield n, member, text, None
            except Exception as e:  # the other chapters stay
                yield n, member, None, f"{type(e).__name__}: {e}"

    def _blocks(self, files):
        n, lines, chars = 0, [], 0
        try:
            with files.zip.open(files.infos[formats.DOCUMENT]) as xml:
                for line in formats.paragraphs(xml):
                    if lines and chars + len(line) > BLOCK:
                        yield n, formats.DOCUMENT, "\n".join(lines), None
                        n, lines, chars = n + 1, [], 0
                    lines.append(line)
                    chars += len(line) + 1
            if lines:
                yield n, formats.DOCUMENT, "\n".join(lines), None
        except Exception as e:
            yield n, formats.DOCUMENT, None, f"{type(e).__name__}: {e}"


class ArchiveMembers(DataSource):
    READER = _Listing

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in self.READER.fields)

    def reader(self, schema) -> DataSourceReader:
        return self.READER(self.options)


class ArchiveTexts(ArchiveMembers):
    READER = _Texts

    @classmethod
    def name(cls) -> str:
        return "archive_texts"


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    for source in (ArchiveMembers, ArchiveTexts):
        spark.dataSource.register(source)


def members(spark: SparkSession, folder: str, **options) -> DataFrame:
    """What archives hold, by their directories alone."""
    register(spark)
    return spark.read.format("archive_members").options(**options).load(folder)


def texts(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Texts of EPUB and DOCX archives in parts, numbered from 0 in reading order (numbers of empty chapters are left out)."""
    register(spark)
    return spark.read.format("archive_texts").options(**options).load(folder)
