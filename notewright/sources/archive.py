"""Members of zip archives as tables: a Python data source that streams them on executors.

    spark.dataSource.register(ZipMember)
    spark.read.format("zip_member").option("member", "patients.csv.gz").schema(...).load("archive.zip")

A stored (not deflated) plain CSV member is read as byte ranges of about ``rangeBytes``, cut at line ends, each a task of its
own; a deflated member or one that is itself gzipped is one task, which holds a block of rows at a time. The driver
reads the archives' directories only. A folder is read as all the archives in it; writing gives one archive for each
partition, with the member stored. Paths must be visible to all executors.

Fields may hold line breaks only in members that are not cut; ``rangeBytes`` of 0 cuts none.
"""

from __future__ import annotations

import gzip
import io
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

RANGE_BYTES = 64 << 20
BATCH_BYTES = 1 << 20
_LOCAL_HEADER = 30


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def archives(path: str) -> list[str]:
    """The archive itself, or all of a folder."""
    path = _local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".zip"))
    return [path]


def find_member(names: list[str], name: str) -> str:
    """The member of that file name, in whatever case, with the shortest path."""
    found = sorted((n for n in names if n.lower() == name or n.lower().endswith(f"/{name}")), key=len)
    if not found:
        raise FileNotFoundError(f"{name} is not in the archive")
    return found[0]


@dataclass
class Part(InputPartition):
    """A member, or bytes start to end of a stored one whose data begin at offset."""

    archive: str
    member: str
    offset: int = -1
    start: int = 0
    end: int = 0
    size: int = 0

    def __init__(self, archive, member, offset=-1, start=0, end=0, size=0):
        super().__init__(None)
        self.archive, self.member, self.offset, self.start, self.end, self.size = archive, member, offset, start, end, size


def parts_of(archive: str, name: str, range_bytes: int) -> list[Part]:
    with zipfile.ZipFile(archive) as z:
        info = z.getinfo(find_member(z.namelist(), name))
        if info.compress_type != zipfile.ZIP_STORED or name.endswith(".gz") or not range_bytes or info.file_size <= range_bytes:
            return [Part(archive, info.filename)]
        with open(archive, "rb") as f:
            f.seek(info.header_offset)
            header = f.read(_LOCAL_HEADER)
        names, extra = struct.unpack("<HH", header[26:30])
        offset = info.header_offset + _LOCAL_HEADER + names + extra
        return [Part(archive, info.filename, offset, at, min(at + range_bytes, info.file_size), info.file_size) for at in range(0, info.file_size, range_bytes)]


class _Lines(io.RawIOBase):
    """Header and the lines that begin within a range of a stored member."""

    def __init__(self, part: Part):
        self.file = open(part.archive, "rb")
        self.file.seek(part.offset)
        self.head = self.file.readline()
        at = part.offset + part.start
        if part.start:
            self.file.seek(at - 1)
            self.file.readline()  # the rest of a line that began before
        else:
            at += len(self.head)
            self.file.seek(at)
        self.until, self.last = part.offset + part.end, part.offset + part.size
        self.rest = self.head

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if not self.rest:
            at = self.file.tell()
            if at >= self.until:
                return 0
            block = self.file.read(min(BATCH_BYTES, self.until - at))
            if self.file.tell() >= self.until and not block.endswith(b"\n"):
                block += self.file.readline(self.last - self.file.tell())
            self.rest = block
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n

    def close(self) -> None:
        self.file.close()
        super().close()


class MemberReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Part]:
        size = int(self.options.get("rangebytes", RANGE_BYTES))
        return [p for a in archives(self.options["path"]) for p in parts_of(a, self.options["member"], size)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(self.schema)
        convert = csv.ConvertOptions(column_types={f.name: f.type for f in want}, include_columns=want.names, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False)
        parse = csv.ParseOptions(newlines_in_values=part.offset < 0)
        with zipfile.ZipFile(part.archive) as z:
            raw = io.BufferedReader(_Lines(part), BATCH_BYTES) if part.offset >= 0 else z.open(part.member)
            with raw, gzip.open(raw) if part.member.endswith(".gz") else raw as stream:
                for batch in csv.open_csv(stream, read_options=csv.ReadOptions(block_size=BATCH_BYTES), parse_options=parse, convert_options=convert):
                    yield batch.select(want.names)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class MemberWriter(DataSourceArrowWriter):
    """One archive a partition, under its own name until all are written."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.member, self.folder, self.overwrite = schema, options["member"], _local(options["path"]), overwrite
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f".{self.run}-{uuid.uuid4().hex}.zip.tmp")
        rows = 0
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z, z.open(self.member, "w", force_zip64=True) as f, csv.CSVWriter(f, to_arrow_schema(self.schema)) as out:
            for batch in batches:
                out.write_batch(batch)
                rows += batch.num_rows
        return Written(path if rows else self._removed(path))

    def _removed(self, path: str) -> None:
        os.remove(path)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite and os.path.isdir(self.folder):
            for old in archives(self.folder):
                os.remove(old)
        for i, m in enumerate(messages):
            if m and m.path:
                os.replace(m.path, os.path.join(self.folder, f"part-{i:05d}-{self.run}.zip"))

    def abort(self, messages: list[Written | None]) -> None:
        for f in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            if f.startswith(f".{self.run}-"):
                os.remove(os.path.join(self.folder, f))


class ZipMember(DataSource):
    """The data source zip_member, with options path and member."""

    @classmethod
    def name(cls) -> str:
        return "zip_member"

    def schema(self) -> T.StructType:
        """All columns as strings, by the first archive's header."""
        part = parts_of(archives(self.options["path"])[0], self.options["member"], 0)[0]
        with zipfile.ZipFile(part.archive) as z, z.open(part.member) as raw, gzip.open(raw) if part.member.endswith(".gz") else raw as stream:
            names = next(csv.open_csv(stream, read_options=csv.ReadOptions(block_size=BATCH_BYTES))).schema.names
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> MemberReader:
        return MemberReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> MemberWriter:
        return MemberWriter(schema, self.options, overwrite)


def read_member(spark: SparkSession, path: str, member: str, schema: str | T.StructType | None = None, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A member of an archive, or of all archives of a folder; without a schema all columns are text."""
    spark.dataSource.register(ZipMember)
    reader = spark.read.format("zip_member").option("member", member).option("rangeBytes", range_bytes)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_member(df: DataFrame, path: str, member: str) -> None:
    """A folder of archives, each with the member as stored CSV."""
    df.sparkSession.dataSource.register(ZipMember)
    df.write.format("zip_member").option("member", member).mode("overwrite").save(path)


#: The columns of the patients' member that are of use.
PATIENTS = "subject_id long, gender string, anchor_age long, anchor_year long, anchor_year_group string, dod string"


def patients(spark: SparkSession, path: str) -> DataFrame:
    return read_member(spark, path, "patients.csv.gz", PATIENTS)


def admissions(spark: SparkSession, path: str) -> DataFrame:
    """All columns, as text but for the subject's number."""
    df = read_member(spark, path, "admissions.csv.gz")
    return df.withColumn("subject_id", df.subject_id.cast("long"))
