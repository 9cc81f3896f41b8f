"""Zip archives and workbooks as rows, read where they lie."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, storage, zip_ranges

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


#: Bytes of archives for which there is a task.
TASK_BYTES = 64 << 20
_ENTRY = "archive string, name string, offset long, packed long, size long, method int, crc long, flags int"


def archive_entries(spark: SparkSession, path: str, archives: list[str] | None = None) -> DataFrame:
    """(archive, name, offset, packed, size, method, crc, flags) of all members of the archives under a path; of those whose file name holds one of the texts, if
    any are given. Only the directories at the archives' ends are read."""

    def run(batches):
        for batch in batches:
            for archive, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with storage.open_for_read(archive) as source:
                    for found in batched(zip_ranges.entries(source, length), 10_000):
                        columns = [[archive] * len(found), *zip(*found)]
                        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", *zip_ranges.Entry._fields])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    if archives:
        name = F.element_at(F.split("path", "/"), -1)
        files = files.filter(F.exists(F.array(*map(F.lit, archives)), lambda a: F.contains(name, a)))
    return files.repartition("path").mapInArrow(run, _ENTRY)


def zip_members(spark: SparkSession, path: str, holds: str = "", suffix: str = "", archives: list[str] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(archive, name, content) of the members whose name holds a text and ends in a suffix.

    Members are dealt over tasks, one for each task_bytes of all archives, whatever archive they lie in, and read by range in the order in which they
    lie: a task holds one member. A damaged archive or member stops the query.
    """

    def run(batches):
        opened, source = None, None
        for batch in batches:
            for archive, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != opened:
                    if source is not None:
                        source.close()
                    opened, source = archive, storage.open_for_read(archive)
                found = zip_ranges.Entry(*entry)
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([found.name]), pa.array([zip_ranges.read_member(source, found)], pa.binary())], ["archive", "name", "content"])
        if source is not None:
            source.close()

    held = spark.read.format("binaryFile").load(path).select("length").agg(F.sum("length")).first()[0] or 0
    wanted = archive_entries(spark, path, archives).filter(F.contains("name", F.lit(holds)) & F.endswith("name", F.lit(suffix)))
    dealt = wanted.repartition(min(max(1, -(-held // task_bytes)), 10_000), "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "archive string, name string, content binary")


def write_zips(members: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Writes members(archive, name, content) into folder/archive.zip, members by name, and returns (archive, members, file) of what lies there. An archive is written by one
    task, member after member; none appears before all are written, and what failed attempts left is removed. Null contents are empty. With
    `overwrite` the folder holds nothing else afterwards."""
    sinks.write_archives(members, folder, overwrite)
    return archive_entries(members.sparkSession, folder).groupBy(F.col("archive").alias("file")).agg(F.count(F.lit(1)).alias("members")).select(name_of(F.col("file")).alias("archive"), "members", "file")


def name_of(file: Column) -> Column:
    """An archive's name without folder and extension."""
    return F.regexp_extract(file, r"([^/]*?)(\.zip)?$", 1)


def rezipped(spark: SparkSession, path: str, folder: str, change, archives: list[str] | None = None) -> DataFrame:
    """Archives under a path with their members changed: change() gets (archive, name, content), archive without folder and extension, and returns the same columns,
    which are written to `folder` in place of what lies there. Returns as write_zips()."""
    members = zip_members(spark, path, archives=archives)
    return write_zips(change(members.withColumn("archive", name_of(F.col("archive")))), folder, overwrite=True)


def split_by_folder(spark: SparkSession, path: str, folder: str, holds: str = "") -> DataFrame:
    """An archive for each folder on top of the archives under a path, with the members whose name holds a text. Returns as write_zips()."""
    found = zip_members(spark, path, holds=holds).filter(F.contains("name", F.lit("/")))
    return write_zips(found.select(F.get(F.split("name", "/"), F.lit(0)).alias("archive"), "name", "content"), folder)


def top_folders(members: DataFrame) -> DataFrame:
    return members.select(F.get(F.split("name", "/"), F.lit(0)).alias("folder")).distinct()


def sheet_rows(raw: bytes, sheet: int = 1) -> list[list[str | None]]:
    """The rows of a sheet of an xlsx workbook as texts, with nulls for empty cells."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(x.text or "" for x in item.iter(f"{_SHEET}t")) for item in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
        rows = []
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_SHEET}row"):
            cells: dict[int, str] = {}
            for c in row.findall(f"{_SHEET}c"):
                at = 0
                for letter in re.match("[A-Z]+", c.get("r", "A")).group():
                    at = at * 26 + ord(letter) - 64
                value = c.find(f"{_SHEET}v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(x.text or "" for x in c.iter(f"{_SHEET}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            rows.append([cells.get(i) for i in range(1, max(cells, default=0) + 1)])
    return rows


def workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row_no, cells array) of a sheet of the workbooks under path."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = sheet_rows(raw, sheet)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(1, len(rows) + 1), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["path", "row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row_no int, cells array<string>")
