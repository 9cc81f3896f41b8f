"""Token ids as one wavelet matrix per shard file, with rank, select, access and counting.

File: magic, length of the header, header (JSON), document table, then per level the bit-plane
in zstandard blocks. The header holds, for each block, its place in the file and the ones before
it, so a rank touches one block and nothing is unpacked that is not asked for.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_count import byte_symbols
from .common import GATHERED, attempt_name, gathered, open_for_read, open_for_write, shared_path, written
from .segments import PartTable, even_parts

MAGIC = b"FOLIOWM1"
#: Bits of a plane in one compressed block.
BLOCK_BITS = 1 << 18
#: Ids after which a shard is closed; a longer document makes a longer shard.
SHARD_IDS = 4_000_000


def build(ids: np.ndarray, levels: int) -> list[tuple[np.ndarray, int]]:
    """Per level, from the highest bit: the plane (packed bits) and its zeros."""
    kind = np.uint16 if levels <= 16 else np.uint32
    planes, now = [], ids.astype(kind)
    for bit in range(levels - 1, -1, -1):
        ones = (now & kind(1 << bit)).astype(bool)
        low, high = np.compress(~ones, now), np.compress(ones, now)  # by places: on bits without order several times as fast as now[ones]
        planes.append((np.packbits(ones, bitorder="little"), len(low)))
        now = np.concatenate([low, high])
    return planes


def write_shard(out, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, levels: int) -> None:
    """One file: lengths[i] consecutive ids belong to doc_ids[i]."""
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes() + known.tobytes())
    body, place, described = [docs], len(docs), []
    for plane, zeros in build(ids, levels):
        starts, sums, ones = [], [], 0
        for at in range(0, len(plane), BLOCK_BITS // 8):
            block = plane[at : at + BLOCK_BITS // 8]
            packed = pack(block.tobytes())
            starts.append(place)
            sums.append(ones)
            ones += int(np.bitwise_count(block).sum())
            body.append(packed)
            place += len(packed)
        described.append({"zeros": zeros, "at": starts, "ones": sums})
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "doc_bytes": len(docs), "end": place, "planes": described}).encode()
    out.write(MAGIC + struct.pack("<Q", len(header)) + header)
    for part in body:
        out.write(part)


class WaveletFile:
    """Reads one shard; `source` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        if source.read(8) != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<Q", source.read(8))
        self.head = json.loads(source.read(size))
        self.base = 16 + size
        self.n, self.planes = self.head["n"], self.head["planes"]
        self.levels = len(self.planes)
        self.blocks: dict[tuple[int, int], np.ndarray] = {}

    def _raw(self, at: int, end: int) -> bytes:
        self.source.seek(self.base + at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(end - at))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids and their lengths in ids."""
        raw, n = self._raw(0, self.head["doc_bytes"]), self.head["docs"]
        ids, lengths, known = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n)
        return [int(d) if k else None for d, k in zip(ids, known)], lengths

    def _block(self, level: int, block: int) -> np.ndarray:
        if (level, block) not in self.blocks:
            if len(self.blocks) >= 4 * self.levels:
                self.blocks.pop(next(iter(self.blocks)))
            at = self.planes[level]["at"]
            after = at[block + 1] if block + 1 < len(at) else (self.planes[level + 1]["at"] or [self.head["end"]])[0] if level + 1 < self.levels else self.head["end"]
            self.blocks[level, block] = np.frombuffer(self._raw(at[block], after), np.uint8)
        return self.blocks[level, block]

    def _plane(self, level: int) -> np.ndarray:
        parts = [self._block(level, b) for b in range(len(self.planes[level]["at"]))]
        return np.unpackbits(np.concatenate(parts), count=self.n, bitorder="little").view(bool) if parts else np.zeros(0, bool)

    def all_ids(self) -> np.ndarray:
        """Every id in order: the stable partitions are undone from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            ones, zeros = self._plane(level), self.planes[level]["zeros"]
            up = np.empty_like(now)
            up[np.flatnonzero(~ones)] = now[:zeros]
            up[np.flatnonzero(ones)] = now[zeros:] | kind(1 << (self.levels - 1 - level))
            now = up
        return now

    def bit(self, level: int, i: int) -> int:
        at = i % BLOCK_BITS
        return int(self._block(level, i // BLOCK_BITS)[at >> 3] >> (at & 7) & 1)

    def rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, at = divmod(i, BLOCK_BITS)
        sums = self.planes[level]["ones"]
        if block == len(sums):
            block, at = block - 1, BLOCK_BITS
        if block < 0:
            return 0
        data = self._block(level, block)
        ones = sums[block] + int(np.bitwise_count(data[: at >> 3]).sum())
        return ones + (int(data[at >> 3] & ((1 << (at & 7)) - 1)).bit_count() if at & 7 else 0)

    def select(self, level: int, want: int, k: int) -> int:
        """Place of the k-th (from 0) bit equal to want."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank1(level, mid + 1)
            if (ones if want else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            ones, one = self.rank1(level, i), self.bit(level, i)
            value = value << 1 | one
            i = self.planes[level]["zeros"] + ones if one else i - ones
        return value

    def _down(self, token: int, i: int, j: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self.rank1(level, i), self.rank1(level, j)
            if token >> (self.levels - 1 - level) & 1:
                zeros = self.planes[level]["zeros"]
                i, j = zeros + a, zeros + b
            else:
                i, j = i - a, j - b
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences of a token in places i to j."""
        a, b = self._down(token, i, self.n if j is None else j)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        a, b = self._down(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            one, zeros = token >> (self.levels - 1 - level) & 1, self.planes[level]["zeros"]
            i = self.select(level, one, i - zeros if one else i)
        return i


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them, for a batch of texts at once.

    Where white space is even (single spaces and line feeds), texts are cut where the tokenizer's pattern
    always begins a new piece; the library encodes each distinct part once and its ids are remembered. Any
    other text, and any with a special string, goes to the library whole.
    """

    def __init__(self, path: str, kept: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.levels = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.symbols = byte_symbols()
        self.model = self.tokenizer.model
        self.table = PartTable(self._learn, *([kept] if kept else []))

    def _learn(self, parts: list[str]) -> list[list[int]]:
        found: list = [None] * len(parts)
        rest, tokenize, symbols = [], self.model.tokenize, self.symbols
        space = symbols[ord(" ")]
        for i, s in enumerate(parts):
            word = s[1:] if s[0] == " " else s
            if not word.isalpha():
                rest.append(i)
            else:  # letters alone are one piece of the pattern, which the library's model takes at once
                piece = word if word.isascii() else "".join([symbols[b] for b in word.encode()])
                found[i] = [t.id for t in tokenize(piece if word is s else space + piece)]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, how many each has). Null and empty texts have none."""
        special = pc.fill_null(pc.match_substring_regex(texts, "|".join(map(re.escape, self.special))), False) if self.special else None
        parts, counts, whole = even_parts(texts, special)
        ids, lengths = self.table.ids_of(parts)
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        at = np.flatnonzero(whole)
        if not len(at):
            return ids, np.diff(ends)
        found = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in at.tolist():
            found[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the ids of docs(doc_id long, text), each document closed by end_id, in ascending doc_id order.

    Returns the manifest: part, seq, file, n_docs, n_ids, base (ids before the file). It lists the files
    of finished tasks only; those of lost attempts have other names and are never read. Null ids come
    first; equal ids are ordered by a hash of the text; the last key of the range is the row's place in
    the input, so that even a third of all rows with one id and text is dealt over many tasks.
    A null text is empty; an empty table gives an empty manifest; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "wavelet")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
        .withColumn("_h", F.xxhash64("text"))
        .withColumn("_n", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "_h", "_n")
        .sortWithinPartitions("doc_id", "_h", "_n")
        .select("doc_id", "text")
    )

    def run(batches):
        from pyspark import TaskContext

        own, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        names, lengths, chunks, held = [], [], [], 0

        def close():
            nonlocal seq, names, lengths, chunks, held
            ids = np.concatenate(chunks)
            name = f"{folder}/{attempt_name('shard')}"
            with open_for_write(name) as out:
                write_shard(out, names, lengths, ids, max(own.levels, int(end_id).bit_length()))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_docs": [len(names)], "n_ids": [len(ids)]}, pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            seq, names, lengths, chunks, held = seq + 1, [], [], [], 0
            return row

        for batch in gathered(batches, 1, GATHERED):
            docs = batch.column(0).to_pylist()
            ids, sizes = own.encode_all(batch.column(1))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            ends, begin = np.cumsum(sizes), 0
            while begin < len(docs):  # up to the document that fills the shard, or all
                before = int(ends[begin - 1]) if begin else 0
                end = min(int(np.searchsorted(ends, before + shard_ids - held)) + 1, len(docs))
                names += docs[begin:end]
                lengths += sizes[begin:end].tolist()
                chunks.append(ids[before : ends[end - 1]])
                held += len(chunks[-1])
                begin = end
                if held >= shard_ids:
                    yield close()
        if names:
            yield close()

    manifest = written(ordered.mapInArrow(run, "part long, seq long, file string, n_docs long, n_ids long"), "wavelet-manifest")
    # a row for each range partition, not for each document or shard
    totals = sorted(map(tuple, manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()))
    before, bases = 0, []
    for part, n in totals:
        bases.append((part, before))
        before += n
    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return (
        manifest.withColumn("_in", F.coalesce(earlier, F.lit(0)))
        .join(spark.createDataFrame(bases, "part long, _base long"), "part")
        .select("part", "seq", "file", "n_docs", "n_ids", (F.col("_base") + F.col("_in")).alias("base"))
    )


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian)."""
    files = manifest.count()

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_for_read(name) as source:
                    shard = WaveletFile(source)
                    docs, lengths = shard.documents()
                    ids = memoryview(shard.all_ids().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("file", "base").repartition(min(max(files, 1), 4096), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
