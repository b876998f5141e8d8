"""A Spark data source for delimited members of zip files, read in parts by tasks.

A member is one compressed stream, so a part begins by passing over what lies before it; it is decompressed while it is
read, never written anywhere. A part holds the lines that begin in its range of uncompressed bytes. The file may lie in any
store that pyarrow's file systems open (a plain path, file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import codecs
import csv
import fnmatch
import io
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

BYTES_PER_PART = 64 << 20
CHUNK = 1 << 20


def _open(path: str) -> zipfile.ZipFile:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(system.open_input_file(inner))


def _members(archive: zipfile.ZipFile, pattern: str) -> list[zipfile.ZipInfo]:
    return [m for m in archive.infolist() if not m.is_dir() and fnmatch.fnmatch(m.filename.rsplit("/", 1)[-1].lower(), pattern.lower())]


def _header(archive: zipfile.ZipFile, member: zipfile.ZipInfo, sep: str) -> tuple[list[str], int]:
    """(stripped names, bytes of the header line)."""
    with archive.open(member) as stream:
        line = stream.readline()
    text = line.decode("utf-8-sig", "replace").rstrip("\r\n")
    return [c.strip() for c in next(csv.reader([text], delimiter=sep), [])], len(line)


@dataclass
class Part(InputPartition):
    member: str
    first: int
    end: int
    columns: tuple[str, ...]


class ZipReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.pattern, self.sep = options["path"], options.get("member", "*.csv"), options.get("sep", ",")
        self.step = int(options.get("bytesperpart", BYTES_PER_PART))

    def partitions(self) -> list[Part]:
        out = []
        with _open(self.path) as archive:
            for m in _members(archive, self.pattern):
                columns, start = _header(archive, m, self.sep)
                out += [Part(m.filename, max(at, start), min(at + self.step, m.file_size), tuple(columns)) for at in range(0, m.file_size, self.step) if at + self.step > start]
        return out or [Part("", 0, 0, ())]

    def _lines(self, part: Part):
        """Lines whose first byte lies in [first, end); the byte before first tells whether one begins there."""
        with _open(self.path) as archive, archive.open(part.member) as raw:
            at, skip = 0, max(part.first - 1, 0)
            while at < skip:
                got = raw.read(min(CHUNK, skip - at))
                if not got:
                    return
                at += len(got)
            stream = io.BufferedReader(raw, CHUNK)
            if part.first:
                at += len(stream.readline())  # the rest of the line before
            while at < part.end:
                line = stream.readline()
                if not line:
                    return
                at += len(line)
                yield line

    def read(self, part: Part):
        if not part.member:
            return
        place = {c: i for i, c in enumerate(part.columns)}
        order = [place.get(c) for c in self.names]
        texts = (codecs.decode(line, "utf-8", "replace").rstrip("\r\n") for line in self._lines(part))
        for row in csv.reader((t for t in texts if t), delimiter=self.sep):
            yield tuple(row[i] if i is not None and i < len(row) and row[i] != "" else None for i in order)


class ZipCsvSource(DataSource):
    """Options: path, member (a pattern of file names, default *.csv), sep, bytesPerPart. Every column is a string.

    All members that match are read; columns are those of the first, under stripped names, and a member without one of them gives null. A
    line break inside quotes ends its line, since parts begin at lines. Lines without text are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as archive:
            found = _members(archive, self.options.get("member", "*.csv"))
            if not found:
                raise FileNotFoundError(f"no member like {self.options.get('member', '*.csv')} in {self.options['path']}")
            columns, _ = _header(archive, found[0], self.options.get("sep", ","))
        return StructType([StructField(c, StringType()) for c in columns])

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(schema, self.options)


def zipped(spark: SparkSession, path: str, member: str = "*telemetry*.csv", sep: str = ",", bytes_per_part: int = BYTES_PER_PART) -> DataFrame:
    """The delimited members of a zip file that match the pattern, as text columns."""
    spark.dataSource.register(ZipCsvSource)
    return spark.read.format("zipcsv").option("member", member).option("sep", sep).option("bytesPerPart", bytes_per_part).load(path)


def representative_sample(spark: SparkSession, path: str, k: int, member: str = "*telemetry*.csv", seed: int = 42) -> DataFrame:
    """Up to k rows of each vehicle and lap of a zipped telemetry file, the same at every run: a sampling operator."""
    from lapforge.sources.readers import sample_per_lap

    return sample_per_lap(zipped(spark, path, member), k, seed=seed)
