"""Files by name as data sources to write to: rows in, one file or archive for each name, and nothing before all is written.

Each attempt of a task writes under a hidden folder of its own. When all tasks are done the files move to their names; when the job
fails, or afterwards, the hidden folder goes with all that failed attempts left. Names of files pass through the driver, contents never.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import storage

#: Bytes that are copied at once.
CHUNK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """(where it was written, its name) of each file of a task."""

    files: list[tuple[str, str]]


def _safe(name: str | None) -> str:
    if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
        raise ValueError(f"not a name of a file: {name!r}")
    return name


def _copied(row: dict, put) -> None:
    """What a row adds to its file: its content, or the file that `source` names, piece by piece."""
    if row.get("source"):
        with storage.open_for_read(row["source"]) as source:
            while piece := source.read(CHUNK):
                put(piece)
    content = row.get("content")
    if content is not None:
        put(content.encode() if isinstance(content, str) else content)


class _Writer(DataSourceArrowWriter):
    """Rows of one file follow each other; subclasses say how a row is added."""

    key = "name"

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.own = f"{self.path}/_writing-{uuid.uuid4().hex}"  # the same for all tasks of the job

    def write(self, iterator) -> Written:
        files, name, stream = [], None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if stream is None or row[self.key] != name:
                    if stream is not None:
                        self.close(stream)
                    name = row[self.key]
                    place = f"{self.own}/{uuid.uuid4().hex}"
                    files.append((place, self.named(_safe(name))))
                    stream = self.open(place)
                self.add(stream, row)
        if stream is not None:
            self.close(stream)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = storage.filesystem(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = {name for _, name in files}
        if len(names) != len(files):
            self.abort(messages)
            raise ValueError("several tasks wrote one file: rows of a file must be together")
        system.create_dir(top, recursive=True)
        for folder in {os.path.dirname(f"{top}/{name}") for name in names}:
            system.create_dir(folder, recursive=True)
        for place, name in files:
            system.move(storage.filesystem(place)[1], f"{top}/{name}")
        self._remove(system)
        if self.overwrite:
            for info in system.get_file_info(pafs.FileSelector(top, recursive=True)):
                if info.type == pafs.FileType.File and info.path.removeprefix(f"{top}/") not in names:
                    system.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(storage.filesystem(self.path)[0])

    def _remove(self, system: pafs.FileSystem) -> None:
        own = storage.filesystem(self.own)[1]
        if system.get_file_info(own).type == pafs.FileType.Directory:
            system.delete_dir(own)

    def named(self, name: str) -> str:
        return name

    def open(self, place: str):
        return storage.open_for_write(place)

    def add(self, stream, row: dict) -> None:
        _copied(row, stream.write)

    def close(self, stream) -> None:
        stream.close()


class _ZipWriter(_Writer):
    key = "archive"

    def named(self, name: str) -> str:
        return f"{name}.zip"

    def open(self, place: str):
        out = storage.open_for_write(place)
        return zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), out

    def add(self, stream, row: dict) -> None:
        # a fixed date: the same rows give the same archive
        with stream[0].open(zipfile.ZipInfo(row["name"]), "w", force_zip64=True) as member:
            _copied(row, member.write)

    def close(self, stream) -> None:
        for s in stream:
            s.close()


class NamedFiles(DataSource):
    """Rows (name, content, source): content (text or bytes) and the file that source names are added to the file of that name; nulls add nothing."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


class ZipArchives(DataSource):
    """Rows (archive, name, content, source): a member of archive.zip each."""

    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def writer(self, schema, overwrite: bool) -> _ZipWriter:
        return _ZipWriter(self.options, overwrite)


def _save(df: DataFrame, source: type[DataSource], path: str, overwrite: bool) -> None:
    df.sparkSession.dataSource.register(source)
    df.write.format(source.name()).option("path", path).mode("overwrite" if overwrite else "append").save()


def write_files(rows: DataFrame, path: str, order: list[str] | None = None, overwrite: bool = False) -> None:
    """A file below path for each name of rows(name, content, source, ...), of its rows by `order`. Files of the same names are replaced, with `overwrite` all others go. A file is
    written by one task, row after row; content and source are optional."""
    kept = [c for c in ("name", "content", "source") if c in rows.columns]
    _save(rows.repartition("name").sortWithinPartitions("name", *(order or [])).select(*kept), NamedFiles, path, overwrite)


def write_archives(members: DataFrame, path: str, overwrite: bool = False) -> None:
    """path/archive.zip for each archive of members(archive, name, content, source), members by name."""
    kept = [c for c in ("archive", "name", "content", "source") if c in members.columns]
    _save(members.repartition("archive").sortWithinPartitions("archive", "name").select(*kept), ZipArchives, path, overwrite)


def write_books(spark: SparkSession, tables: DataFrame, images: DataFrame, books: DataFrame, path: str) -> None:
    """For each of books(parish, book) a folder parish/book with tables/tables.jsonl, the lines of tables(parish, book, file_name, table_ord, json) by file and table, and
    copies of images(parish, book, path, name) in images/. A book without tables has an empty file. Images are copied piece by piece."""
    folder = F.concat_ws("/", "parish", "book")
    file = F.concat(folder, F.lit("/tables/tables.jsonl")).alias("name")
    none = F.lit(None).cast("string")
    lines = tables.select(file, "file_name", "table_ord", F.concat("json", F.lit("\n")).alias("content"), none.alias("source"))
    empty = books.select(file, none.alias("file_name"), F.lit(None).cast("int").alias("table_ord"), none.alias("content"), none.alias("source"))
    copies = images.select(F.concat_ws("/", folder, F.lit("images"), "name").alias("name"), none.alias("file_name"), F.lit(None).cast("int").alias("table_ord"), none.alias("content"), F.col("path").alias("source"))
    write_files(lines.unionByName(empty).unionByName(copies), path, ["file_name", "table_ord"])
