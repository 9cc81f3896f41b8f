"""Files of any file system by their address: streams to write, ranges to read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a plain path or an address (file, hdfs, s3, gs)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def open_for_read(uri: str):
    """A seekable file."""
    system, path = filesystem(uri)
    return system.open_input_file(path)


def open_for_write(uri: str):
    """A stream to a new file, with the folders above it."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder that the driver and all tasks reach: below spark.checkpoint.dir, or on one machine without that setting below its folder for temporary files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="folioframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
