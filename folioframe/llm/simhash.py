"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A (bits 0-22), B (bits 23-45) and C (bits 46-63). Of at
most 3 differing bits (pigeonhole):
  * none in C: one of A, B has at most 1, so the pair shares the key (C, Golay key of that segment);
  * some in C: A and B have at most 2, so A is equal, or B is equal, or each has exactly 1.
    In the last case a shared key is (Golay key of A, Golay key of B), where one side gives all its keys
    of A with its nearest codeword of B and the other its nearest codeword of A with all its keys of B.
Fingerprints that share a key are compared; those within 3 bits are linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import golay
from .common import giving_back, own_names, written
from .components import components

MAX_BITS = 3
#: Fingerprints under one key that one task compares at once; longer lists are dealt in blocks of pairs.
BUCKET = 4096
#: A fingerprint is hot if more than one in so many rows has it: there are fewer hot ones than that.
HOT = 1000
SHINGLE, SEED = 3, 42
_CHUNK = 1 << 14


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all shingles (repeats included) of the lower-cased words; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(width, len(words))
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        for part in range(0, len(bits), 255):  # sums of at most 255 fit a byte
            ones += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and fp (the 64 bits as a signed long) of each row. One pass, no shuffle."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], [*keep, "fp"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(giving_back(run), f"{types}, fp long")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, key) of every key of each fingerprint."""
    u = fps.view(np.uint64)
    mask = np.uint64((1 << 23) - 1)
    a, b, c = (u & mask).astype(np.int64), (u >> np.uint64(23) & mask).astype(np.int64), (u >> np.uint64(46)).astype(np.int64)
    ka, kb, index = golay.keys(a), golay.keys(b), np.arange(len(fps))
    found = [(index, np.int64(3) << 60 | a), (index, np.int64(4) << 60 | b)]
    for kind, k in ((1, ka), (2, kb)):
        for i in range(golay.KEYS):
            has = k[:, i] >= 0
            found.append((index[has], np.int64(kind) << 60 | c[has] << 12 | k[has, i]))
    for first, second, kept in ((ka, kb[:, :1], 0), (ka[:, :1], kb, 1)):
        for i, j in np.ndindex(first.shape[1], second.shape[1]):
            if kept and j == 0:
                continue  # nearest with nearest is there already
            has = (first[:, i] >= 0) & (second[:, j] >= 0)
            found.append((index[has], np.int64(5) << 60 | first[has, i] << 12 | second[has, j]))
    return np.concatenate([i for i, _ in found]), np.concatenate([k for _, k in found])


def bucket_links(fps: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, least node) that connect what is within MAX_BITS inside one bucket: a spanning star of each
    component. Every fingerprint is compared with those not yet reached, so a dense bucket costs little."""
    order = np.argsort(nodes)
    left_fp, left_node = fps.view(np.uint64)[order], nodes[order]
    links = []
    while len(left_fp):
        root, front = left_node[0], left_fp[:1]
        left_fp, left_node = left_fp[1:], left_node[1:]
        while len(front) and len(left_fp):
            near = np.bitwise_count(left_fp ^ front[0]) <= MAX_BITS
            front = np.concatenate([front[1:], left_fp[near]])
            links += [(int(n), int(root)) for n in left_node[near]]
            left_fp, left_node = left_fp[~near], left_node[~near]
    return links


def _keyed(batches):
    for batch in batches:
        node, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        index, key = fuzzy_keys(fp)
        for at in range(0, len(index), 100_000):
            i = index[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 100_000]), pa.array(node[i]), pa.array(fp[i])], ["key", "node", "fp"])


def _linked(batches):
    """Links inside the runs of equal (key, block) of sorted rows; a run may go on in the next batch."""
    held = None
    for table in (*map(pa.Table.from_batches, ([b] for b in batches)), None):
        if table is not None:
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) < 50_000:
                continue
        if held is None or not len(held):
            return
        key, block, node, fp = (held.column(c).to_numpy() for c in ("key", "block", "node", "fp"))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        ends = np.append(cuts, len(key)) if table is None else cuts
        starts = np.append(0, ends[:-1])
        links = []
        for i in np.flatnonzero(ends - starts > 1):
            links += bucket_links(fp[starts[i] : ends[i]], node[starts[i] : ends[i]])
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        held = held.slice(ends[-1]) if len(ends) else held
        if table is None:
            return


def link_fingerprints(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect nodes(node long, fp long; fp distinct) as all pairs within MAX_BITS would.

    Keys with more than `bucket` fingerprints are dealt in blocks: every fingerprint goes to the tasks of
    all pairs of its block with another, so each pair still meets, and no task holds more than two blocks.
    """
    keyed = written(nodes.select("node", "fp").mapInArrow(giving_back(_keyed), "key long, node long, fp long"), "simhash-keys")
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("key", F.ceil(F.col("n") * 2 / bucket).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # blocks i <= j meet in task i * blocks + j
    tasks = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own))
    )
    dealt = keyed.join(hot, "key", "left").select("key", F.explode(tasks).alias("block"), "node", "fp")
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(giving_back(_linked), "a long, b long").distinct()


def _labels(fps: DataFrame) -> DataFrame:
    """(fp, _c, component_id, n): for each fingerprint of fps(doc_id, fp) its component, that one's least doc_id and the fingerprint's rows."""
    # a fingerprint is its own node: rows of one doc_id with unlike texts are told apart, and ids only name components
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("n"))
    nodes = written(nodes.select(F.col("fp").alias("node"), "fp", "_id", "n"), "simhash-nodes")
    found = components(link_fingerprints(nodes))
    labelled = written(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("_c"), "_id", "n"), "simhash-labels")
    named = labelled.groupBy("_c").agg(F.min("_id").alias("component_id"))
    return written(labelled.join(named, "_c").select("fp", "_c", "component_id", "n"), "simhash-named")


def near_duplicates(fps: DataFrame) -> DataFrame:
    """fps(doc_id, fp, ...) with component_id: the least doc_id reachable over fingerprints within MAX_BITS.

    Equal fingerprints are one node from the start, so copies make no pairs. Rows with a null doc_id have the
    component of their fingerprint but never name one (null if none of its rows has an id). Repeated rows all stay.
    Fingerprints with over a HOT-th of all rows, fewer than HOT by that, are broadcast; the others meet their rows by a shuffle.
    """
    labels = _labels(fps)
    total = labels.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > total
    hot = F.broadcast(labels.filter(often).select("fp", "component_id"))
    rest = fps.join(hot, "fp", "left_anti").join(labels.filter(~often).select("fp", "component_id"), "fp")
    return fps.join(hot, "fp").unionByName(rest)


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs(doc_id, text).

    Null and empty texts have fingerprint 0 and are linked like any other; fewer words than a shingle give one
    shingle of all of them; other columns are not read; an empty table gives an empty result.
    """
    fps = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "simhash-fps")
    return near_duplicates(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of the least doc_id (null last, then the first row) of each component of docs(doc_id, text, ...), all columns.

    Fingerprints are written beside the rows with a number for each row, so that rows are told apart even where ids repeat;
    what is dropped, the smaller part, is joined away.
    """
    row, fp = own_names(docs, "_row", "_fp")
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, fp])

    stored = written(docs.mapInArrow(giving_back(run), schema).withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    narrow = stored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    # the best row of each fingerprint and of these the best of each component: a hot component is a few rows by then
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    best = narrow.groupBy("fp").agg(F.min(order).alias("best")).join(_labels(narrow).select("fp", "_c"), "fp")
    kept = written(best.groupBy("_c").agg(F.min("best")["row"].alias("row")).select("row"), "simhash-kept")
    dropped = narrow.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row))
    return stored.join(written(dropped, "simhash-dropped"), row, "left_anti").select(*docs.columns)
