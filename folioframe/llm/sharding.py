"""Two-pass external shuffle of a table into shards.

Pass 1 scatters rows by seeded hashes into buckets, each small enough for one task's memory. Pass 2
puts each bucket in a canonical order, Fisher-Yates shuffles it with a seed of its own, and writes it.
A shard is the buckets of one shard number one after another.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path

#: Bytes of text that one bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Partitions of the scatter at most; beyond, a task shuffles several buckets, one after another.
PARTITIONS = 20_000


def shard_of(doc_id, shards: int, seed: int):
    """Rendezvous hashing: the shard of the highest hash. One shard more takes rows only into itself."""
    scores = [F.struct(F.xxhash64(doc_id, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*scores)["s"] if shards > 1 else F.lit(0)


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of n places, from the last place down."""
    order = np.arange(n)
    draws = np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """Writes docs(doc_id, text) as Parquet in folders shard=0 ... and returns them as read back:
    doc_id, text, size (UTF-8 bytes + 1), text_crc32, bucket, pos, slot (gapless in the shard), shard, grown_shard.

    doc_id and the number of shards alone decide the shard (law `key`). A bucket also hashes the row's
    place in the input, so a hot id or a hot text is dealt over all buckets of its shard. Null ids are
    hashed like a value of their own; null texts have size 1; repeated rows all stay; an empty table gives an
    empty result; other columns are left out. Only one bucket at a time is in a task's memory.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "shards")
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    n_buckets = int(shards * per_shard)

    placed = (
        docs.select("doc_id", "text")
        .withColumn("_n", F.monotonically_increasing_id())
        .withColumn("shard", shard_of(F.col("doc_id"), shards, seed))
        .withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1, seed))
        .withColumn("bucket", (F.col("shard") * per_shard + F.pmod(F.xxhash64("doc_id", "_n", F.lit(seed + 1)), F.lit(per_shard))).cast("int"))
        .drop("_n")
    )
    fields = [("doc_id", None), ("text", pa.string()), ("shard", pa.int32()), ("grown_shard", pa.int32()), ("bucket", pa.int32())]
    names = [f for f, _ in fields]

    def shuffled(bucket: pa.Table) -> pa.Table:
        crc = np.fromiter((zlib.crc32((t or "").encode()) for t in bucket.column("text").to_pylist()), np.int64, len(bucket))
        bucket = bucket.append_column("text_crc32", pa.array(crc))
        # rows arrive in any order: the same order first, then the permutation
        bucket = bucket.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending")])
        order = fisher_yates(len(bucket), (seed, bucket.column("bucket")[0].as_py()))
        return bucket.take(pa.array(order)).append_column("pos", pa.array(np.arange(len(bucket)), pa.int64()))

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            yield from shuffled(pa.Table.from_batches(held)).to_batches(max_chunksize=1000)
            held.clear()

        for batch in batches:  # sorted by bucket: a task that holds several has one at a time in memory
            buckets = batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1].column(4)[0].as_py() != buckets[a]:
                    yield from flush()
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    schema = f"doc_id {kind}, text string, shard int, grown_shard int, bucket int, text_crc32 long, pos long"
    (
        placed.select(*names)
        .repartitionById(min(n_buckets, PARTITIONS), F.pmod("bucket", F.lit(min(n_buckets, PARTITIONS))))
        .sortWithinPartitions("bucket")
        .mapInArrow(run, schema)
        .write.option("compression", "zstd")
        .partitionBy("shard")
        .parquet(folder)
    )
    stored = spark.read.schema(f"doc_id {kind}, text string, grown_shard int, bucket int, text_crc32 long, pos long, shard int").parquet(folder)
    # a row for each bucket
    counts = stored.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    if n_buckets <= 200_000:  # so at most a few MB
        bases = F.broadcast(bases)
    return stored.join(bases, "bucket").select("doc_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), "text_crc32", "bucket", "pos", (F.col("_base") + F.col("pos")).alias("slot"), "shard", "grown_shard")
