"""Cross-tokenizer alignment: which tokens of one tokenizer stand where those of another do, and how often corpus-wide.

Tokens are byte ranges; offsets at which a token of each tokenizer ends cut a text into groups, and each pair of tokens of a group is
linked. A pair of ids is one int64 key (A id << 32 | B id). Documents keep their distinct keys; `np.unique` counts them for
each partition, a range-partitioned sort brings equal keys together, and the sums of the runs are written as sorted shards of keys
and counts, which are memory-mapped and searched (`searchsorted`) when documents look up their pairs.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_count import byte_symbols
from .common import attempt_name, filesystem, giving_back, held, open_for_read, open_for_write, shared_path, slices, written
from .segments import Ragged, SegmentTable, flat, words_of

#: Keys of a shard file, and of the buffer whose distinct keys are counted at once.
SHARD_KEYS, BUFFER_KEYS = 2_000_000, 2_000_000
#: Links of a group from which equal ids are put together before pairs are made.
LARGE_GROUP = 1 << 14
MARK = "▁"


def _runs(sorted_keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and the sums of their weights."""
    if not len(sorted_keys):
        return sorted_keys, weights
    at = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    return sorted_keys[at], np.add.reduceat(weights, at)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return _runs(keys[order], weights[order])


class Aligner:
    """Aligns texts; what a segment gives (tokens, groups, keys) is remembered."""

    def __init__(self, path_a: str, path_b: str, kept: int | None = None):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        self.symbols, self.model = byte_symbols(), self.a.model
        byte_of = {c: bytes([i]) for i, c in enumerate(self.symbols)}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = b"".join(byte_of.get(c, c.encode()) for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: of each segment: tokens of A, of B, groups (-1: its bytes are not those of the text), links
        self.counts = np.zeros((0, 4), np.int64)
        self.text_of: list[str] = []
        self.keys, self.weights = Ragged(np.int64), Ragged(np.int32)
        self.table = SegmentTable(self._learn, self._forget, *([kept] if kept else []))

    def _forget(self, n: int) -> None:
        self.counts = self.counts[:n].copy()
        del self.text_of[n:]
        self.keys.cut(n)
        self.weights.cut(n)

    def _encode_a(self, segments: list[str]) -> list[list[int]]:
        found: list = [None] * len(segments)
        rest = []
        for i, s in enumerate(segments):
            if s.isalpha():  # one piece of the pattern, which the model takes at once
                found[i] = [t.id for t in self.model.tokenize("".join([self.symbols[b] for b in (" " + s).encode()]))]
            else:
                rest.append(i)
        whole = self.a.encode_batch_fast([segments[i] if segments[i][0] in "\n " else " " + segments[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, whole):
            found[i] = e.ids
        return found

    def _learn(self, segments: list[str]) -> None:
        """A segment is a word behind a space, a word with its line feed, or (with a space in front) a whole text."""
        ids_a = self._encode_a(segments)
        # the library puts a space before each text: it stands for the segment's own, and is taken off before a line feed
        ids_b = self.b.encode([s.removeprefix(" ") for s in segments], num_threads=1)
        ids_b = [b[1:] if s[0] == "\n" and b and self.bytes_b[b[0]] == b" " else b for s, b in zip(segments, ids_b)]
        good = []
        for s, a, b in zip(segments, ids_a, ids_b):
            own = s.encode() if s[0] in "\n " else b" " + s.encode()
            size = len(own)
            same = sum(len(self.bytes_a[i]) for i in a) == size == sum(len(self.bytes_b[i]) for i in b)
            good.append(same and b"".join([self.bytes_b[i] for i in b]) == own and b"".join([self.bytes_a[i] for i in a]) == own)
        a, size_a = flat([x if ok else [] for x, ok in zip(ids_a, good)])
        b, size_b = flat([x if ok else [] for x, ok in zip(ids_b, good)])
        a, b = a.astype(np.int64), b.astype(np.int64)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        owner_a = np.repeat(np.arange(len(segments)), size_a)
        owner = np.zeros(len(common), np.int64)
        owner[group_a] = owner_a
        groups = np.bincount(owner, minlength=len(segments))
        keys, weights, of = self._pairs(a, b, in_a, in_b, owner)
        links = np.bincount(owner, weights=(in_a * in_b).astype(np.float64), minlength=len(segments)).astype(np.int64)
        groups = np.where(np.array(good), groups, -1)
        self.counts = np.concatenate([self.counts, np.stack([size_a, size_b, groups, links], axis=1)])
        # keys of a segment once each
        order = np.lexsort((keys, of))
        keys, weights, of = keys[order], weights[order], of[order]
        if len(keys):
            at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])))
            keys, weights, of = keys[at], np.add.reduceat(weights, at), of[at]
        sizes = np.bincount(of, minlength=len(segments))
        self.keys.extend(keys, sizes)
        self.weights.extend(weights, sizes)
        # the groups as text
        left, right = list(map(str, a.tolist())), list(map(str, b.tolist()))
        i = j = g = 0
        n_a, n_b = in_a.tolist(), in_b.tolist()
        for count in groups.tolist():
            parts = []
            for k in range(g, g + max(count, 0)):
                parts.append(",".join(left[i : i + n_a[k]]) + "|" + ",".join(right[j : j + n_b[k]]))
                i, j = i + n_a[k], j + n_b[k]
            g += max(count, 0)
            self.text_of.append(";".join(parts))

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, links, segment) of the links of all groups; a large group is made of its distinct ids."""
        links = in_a * in_b
        begin_a, begin_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        usual = np.where(links <= LARGE_GROUP, links, 0)
        of = np.repeat(np.arange(len(links)), usual)
        within = np.arange(len(of)) - np.repeat(np.cumsum(usual) - usual, usual)
        keys = [a[begin_a[of] + within // in_b[of]] << 32 | b[begin_b[of] + within % in_b[of]]]
        weights, owners = [np.ones(len(of), np.int64)], [owner[of]]
        for g in np.flatnonzero(links > LARGE_GROUP):
            x, n = np.unique(a[begin_a[g] : begin_a[g] + in_a[g]], return_counts=True)
            y, m = np.unique(b[begin_b[g] : begin_b[g] + in_b[g]], return_counts=True)
            keys.append((x[:, None] << 32 | y).ravel())
            weights.append((n[:, None] * m).ravel())
            owners.append(np.full(len(x) * len(y), owner[g]))
        return np.concatenate(keys), np.concatenate(weights), np.concatenate(owners)

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, groups as text, distinct keys, links of each) of each text; without tokens zeros and ''."""
        segments = [([] if not t else words_of(t) or [" " + t]) for t in texts]
        found = []
        for rows in self.table.rows(segments):
            counts = self.counts[rows]
            if not len(rows) or (counts[:, 2] < 0).any():
                found.append((0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)))
                continue
            distinct, times = np.unique(rows, return_counts=True)
            keys, sizes = self.keys.take(distinct)
            weights, _ = self.weights.take(distinct)
            keys, weights = summed(keys, weights * np.repeat(times, sizes))
            names = self.text_of
            found.append((*counts.sum(axis=0).tolist(), ";".join([names[i] for i in rows.tolist()]), keys, weights))
        self.table.settle()
        return found


def pack_keys(keys: np.ndarray, weights: np.ndarray, pack) -> bytes:
    """Sorted keys as differences, and their links, compressed."""
    return pack(np.diff(keys, prepend=0).astype("<i8").tobytes() + weights.astype("<i4").tobytes())


def unpack_keys(data: bytes, unpack) -> tuple[np.ndarray, np.ndarray]:
    raw = unpack(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, "<i4", n, 8 * n).astype(np.int64)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and `links` (packed keys) of each row of docs(doc_id, text). One pass, no shuffle."""

    def run(batches):
        own = held(("align", path_a, path_b), partial(Aligner, path_a, path_b))
        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                found = own.align(batch.column(1).to_pylist())
                n_a, n_b, groups, links = ([f[k] for f in found] for k in range(4))
                shas = [hashlib.sha256(f[4].encode()).hexdigest() if f[0] else "" for f in found]
                packed = [pack_keys(f[5], f[6], pack) for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (n_a, n_b, groups, links)], pa.array(shas, pa.string()), pa.array(packed, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def _partial_counts(batches):
    """(key, documents) of the distinct keys of a buffer of documents."""
    unpack, held_keys, n = zstandard.ZstdDecompressor().decompress, [], 0

    def count():
        keys, counts = np.unique(np.concatenate(held_keys), return_counts=True)
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(counts[at : at + 100_000].astype(np.int64))], ["key", "n"])

    for batch in batches:
        for data in batch.column(0).to_pylist():
            keys, _ = unpack_keys(data, unpack)
            held_keys.append(keys)
            n += len(keys)
            if n >= BUFFER_KEYS:
                yield from count()
                held_keys, n = [], 0
    if n:
        yield from count()


def write_count_shards(stored: DataFrame, folder: str | None = None) -> DataFrame:
    """Manifest (file, n, first, last) of sorted shards that hold how many documents have each key: n keys, then n counts, as int64."""
    folder = folder or shared_path(stored.sparkSession, "align-counts")
    partial_counts = written(stored.select("links").filter("n_links > 0").mapInArrow(giving_back(_partial_counts), "key long, n long"), "align-partial")

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def close(keys, counts):
            name = f"{folder}/{attempt_name('counts')}"
            with open_for_write(name) as out:
                out.write(keys.astype("<i8").tobytes())
                out.write(counts.astype("<i8").tobytes())
            return pa.RecordBatch.from_pydict({"file": [name], "n": [len(keys)], "first": [int(keys[0])], "last": [int(keys[-1])]}, pa.schema([("file", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

        for batch in batches:
            keys, counts = _runs(np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([counts, batch.column(1).to_numpy()]))
            if len(keys) > SHARD_KEYS:  # the last key may go on
                yield close(keys[:-1], counts[:-1])
                keys, counts = keys[-1:], counts[-1:]
        if len(keys):
            yield close(keys, counts)

    # equal keys are of one range
    ordered = partial_counts.repartitionByRange("key").sortWithinPartitions("key")
    return written(ordered.mapInArrow(run, "file string, n long, first long, last long"), "align-manifest")


def read_counts(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard: mapped where the shared folder is a file system of the machine, else read."""
    system, path = filesystem(name)
    if system.type_name == "local":
        both = np.memmap(path, "<i8", "r", shape=(2 * n,))
    else:
        with open_for_read(name) as source:
            both = np.frombuffer(source.read(), "<i8")
    return both[:n], both[n:]


def best_of_a(manifest: DataFrame) -> np.ndarray:
    """The highest count of each A id; the table is bounded by A's vocabulary."""

    def run(batches):
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = read_counts(name, n)
                a = keys >> 32
                at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(np.maximum.reduceat(counts, at))], ["a", "best"])

    found = manifest.select("file", "n").repartition("file").mapInArrow(run, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).toPandas()
    best = np.zeros(int(found["a"].max()) + 1 if len(found) else 1, np.int64)
    best[found["a"].to_numpy()] = found["best"].to_numpy()
    return best


class Lookup:
    """Counts of keys by binary search in the shards that may hold them."""

    def __init__(self, shards: list[tuple[str, int, int]]):
        self.shards = shards  # (file, n, first), by first
        self.firsts = np.array([s[2] for s in shards], np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted keys, each of which a shard holds."""
        found = np.zeros(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for (name, n, _), begin, end in zip(self.shards, cuts[:-1], cuts[1:]):
            if end > begin:
                held_keys, held_counts = read_counts(name, n)
                found[begin:end] = held_counts[np.searchsorted(held_keys, keys[begin:end])]
        return found


def with_counts(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """stored with n_best (links whose count is the highest of their A id) and count_sum (of the counts of all links), without `links`."""
    best = best_of_a(manifest)
    # a shard for each SHARD_KEYS distinct pairs of ids
    shards = sorted(map(tuple, manifest.select("file", "n", "first").collect()), key=lambda s: s[2])

    def run(batches):
        lookup, unpack = Lookup(shards), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            found = [unpack_keys(d, unpack) for d in batch.column(len(batch.columns) - 1).to_pylist()]
            keys, links = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            sizes = np.fromiter((len(k) for k, _ in found), np.int64, len(found))
            distinct, place = np.unique(keys, return_inverse=True)
            counts = lookup.counts(distinct)[place]
            top = counts == best[np.minimum(keys >> 32, len(best) - 1)]
            ends = np.cumsum(sizes)
            sums = []
            for x in (links * top, links * counts):
                upto = np.append(0, np.cumsum(x))
                sums.append(pa.array(upto[ends] - upto[ends - sizes]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sums], [*batch.schema.names[:-1], "n_best", "count_sum"])

    kept = [c for c in stored.columns if c != "links"]
    fields = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in kept)
    return stored.select(*kept, "links").mapInArrow(giving_back(run), f"{fields}, n_best long, count_sum long")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of docs(doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Null and empty texts, and texts whose tokens do not give back a space and the text (those with U+2581), have no tokens: zeros and ''. Repeated rows
    count as often as they stand; null ids stay; other columns are not read; an empty table gives an empty result. Texts are taken whole.
    """
    stored = written(aligned(docs, path_a, path_b), "align-docs")
    return with_counts(stored, write_count_shards(stored))
