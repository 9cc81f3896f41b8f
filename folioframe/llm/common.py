"""Shared storage, loading and batching helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch sent to Python: long texts must not add up.
ARROW_ROWS, ARROW_BYTES = "1000", str(8 << 20)
#: Bytes of text that are put together to be encoded at once, at least.
GATHERED = 8 << 20
_OWN_DIR: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows and by bytes, so a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode only) an own one."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="folioframe-"))
    spark.sparkContext.setCheckpointDir(_OWN_DIR[0])
    return _OWN_DIR[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * i for i in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a URI or plain path (file, hdfs, s3, gs)."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.removeprefix("file://")
    return pafs.FileSystem.from_uri(uri)


def open_for_write(uri: str):
    """An output stream; each task attempt must use a name of its own and report it when done."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def open_for_read(uri: str):
    """A seekable input file for range reads."""
    system, path = filesystem(uri)
    return system.open_input_file(path)


def attempt_name(prefix: str) -> str:
    """A file name that no other attempt of the same task uses; manifests list only those of finished tasks."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{prefix}-{part:06d}-{uuid.uuid4().hex}"


_HELD: dict = {}


def held(key, make: Callable):
    """make(), kept in a Python worker for its next tasks. Workers serve all operators in turn: what another key kept goes first."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def giving_back(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow; when its task ends, free memory goes back to the system, which a worker kept for later tasks would hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
            trim(0)

    return run


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts with at most about `most` bytes of a string column; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = held_bytes = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held_bytes + size > most:
            yield batch.slice(begin, i - begin)
            begin, held_bytes = i, 0
        held_bytes += size
    if begin < len(batch):
        yield batch.slice(begin)


def gathered(batches: Iterator[pa.RecordBatch], column: int, least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together in order until a string column has at least so many bytes; the last one may have fewer."""
    held_back, held_bytes = [], 0
    for batch in batches:
        held_back.append(batch)
        held_bytes += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held_bytes >= least:
            yield pa.concat_batches(held_back)
            held_back, held_bytes = [], 0
    if held_back:
        yield pa.concat_batches(held_back)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return run


class BoundedCache(dict):
    """A dict whose misses are computed, emptied by half a generation when it has grown to `limit`.

    Keys longer than `longest` are computed each time, so memory stays bounded.
    """

    def __init__(self, compute: Callable, limit: int = 1_000_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                # early keys are the frequent ones: keep the older half, drop the newer
                keep = dict(list(self.items())[: self.limit // 2])
                self.clear()
                self.update(keep)
            self[key] = value
        return value
