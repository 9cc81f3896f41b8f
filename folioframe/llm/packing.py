"""Lexical retrieval packing: token sequences of one length, each filled with documents that BM25 finds alike.

Documents are tokenized; whole windows of long ones are sequences by themselves. What is left, the passages, is dealt into shards by topic (the
token with the greatest BM25 weight in the passage, under corpus-wide statistics), frequent topics over several shards. A task
builds a shard's inverted index. Each seed takes its best unused neighbours, the last of them cut where the window is full; its rest is
the next seed. What a shard has left at its end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import re
from functools import partial
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_count import byte_symbols
from .common import GATHERED, gathered, giving_back, held, written
from .segments import PartTable, even_parts

WINDOW = 4096
#: Passages of a shard, about; its index stays below this many times a window.
SHARD_ROWS = 4096
#: BM25's parameters; the tokens of a seed that are looked up, by weight; the neighbours that are ranked for it.
K1, B, QUERY_TOKENS, NEIGHBOURS = 1.2, 0.75, 24, 64
#: Ids as they are given out, and as they are kept where they fit.
GIVEN, SHORT = "<u4", "<u2"


class WordEncoder:
    """Ids of whole texts under a file of the tokenizers library whose tokens do not reach over white space; words are remembered."""

    def __init__(self, path: str, kept: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = PartTable(self._learn, *([kept] if kept else []))

    def _learn(self, segments: list[str]) -> list[list[int]]:
        found: list = [None] * len(segments)
        rest, tokenize, symbols = [], self.model.tokenize, self.symbols
        for i, s in enumerate(segments):
            if s.isascii():  # letters are one piece of the pattern, which the model takes at once
                if s.isalpha():
                    found[i] = [t.id for t in tokenize(s.lower())]
                    continue
            elif s.isalpha() and s.islower() and is_normalized("NFC", s):
                found[i] = [t.id for t in tokenize("".join([symbols[b] for b in s.encode()]))]
                continue
            rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([segments[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array."""
        # the normalizer makes letters small: where that is plain (it joins no marks to them before), words are remembered so
        special = pc.fill_null(pc.match_substring_regex(texts, "|".join(map(re.escape, self.special))), False) if self.special else pa.array(np.zeros(len(texts), bool))
        plain = pc.fill_null(pc.invert(pc.or_(special, pc.match_substring_regex(texts, r"\pM"))), False)
        parts, counts, whole = even_parts(pc.if_else(plain, pc.ascii_lower(texts), texts), special, spaces=False)
        ids, lengths = self.table.ids_of(parts)
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))].tolist()
        found = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(whole).tolist():
            found[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return found


def kept(path: str, end_id: int) -> str:
    """The kind of integers in which a tokenizer's ids are kept until they are packed."""
    from tokenizers import Tokenizer

    return SHORT if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id) < 1 << 16 else GIVEN


def tokenized(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, doc_tokens, ids) of docs(doc_id, text): the ids of each row with end_id, cut into windows of which the last may be shorter.
    ids are kept() integers. One pass, no shuffle."""
    kind = kept(path, end_id)

    def run(batches):
        own = held(("pack", path), partial(WordEncoder, path))
        for batch in gathered(batches, 1, GATHERED):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1))):
                ids = np.append(ids, end_id).astype(kind)
                rows += [(doc, at, len(ids), ids[at : at + window].tobytes()) for at in range(0, len(ids), window)]
            for at in range(0, len(rows), 1000):
                columns = zip(*rows[at : at + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(run), "doc_id long, start long, doc_tokens long, ids binary")


class Bags:
    """The distinct tokens of passages one behind the other, ascending in each: `tokens`, how often each stands there (`times`), and the passage it is of (`owner`); passage i has
    those from starts[i] to starts[i + 1]. Passages are never empty; all are sorted at once."""

    def __init__(self, passages: list[bytes], kind: str):
        width = 8 * np.dtype(kind).itemsize
        self.lengths = np.fromiter(map(len, passages), np.int64, len(passages)) // np.dtype(kind).itemsize
        small = width == 16 and len(passages) <= 1 << 16
        keys = np.repeat(np.arange(len(passages), dtype=np.uint32 if small else np.uint64), self.lengths)
        keys <<= keys.dtype.type(width)
        keys |= np.frombuffer(b"".join(passages), kind)
        keys.sort()
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.times = np.diff(np.append(at, len(keys))).astype(np.float32)
        keys = keys[at]
        self.owner, self.tokens = (keys >> keys.dtype.type(width)).astype(np.int64), (keys & keys.dtype.type((1 << width) - 1)).astype(np.int64)
        self.starts = np.searchsorted(self.owner, np.arange(len(passages) + 1))


class Statistics:
    """Of all passages, whose ids are integers of a kind: how many there are, their mean length, and how many hold each token (bounded by the vocabulary)."""

    def __init__(self, passages: int, tokens: int, frequency: np.ndarray, kind: str = GIVEN):
        self.kind, self.size = kind, np.dtype(kind).itemsize
        self.mean = tokens / max(passages, 1)
        self.idf = np.log(1 + (passages - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)

    def weights(self, bags: Bags) -> np.ndarray:
        """The BM25 weight of each token in its passage."""
        length = np.float32(K1) * (np.float32(1 - B) + np.float32(B / self.mean) * bags.lengths.astype(np.float32))
        return self.idf[bags.tokens] * (bags.times * np.float32(K1 + 1) / (bags.times + length[bags.owner]))

    def topics(self, passages: list[bytes]) -> np.ndarray:
        """The token of the greatest weight in each passage, the least of equals."""
        if not passages:
            return np.zeros(0, np.int64)
        bags = Bags(passages, self.kind)
        weights = self.weights(bags)
        most = np.flatnonzero(weights == np.maximum.reduceat(weights, bags.starts[:-1])[bags.owner])
        owner = bags.owner[most]
        return bags.tokens[most[np.concatenate([[True], owner[1:] != owner[:-1]])]]


def statistics(passages: DataFrame, kind: str) -> Statistics:
    def run(batches):
        frequency = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(Bags(batch.column(0).to_pylist(), kind).tokens, minlength=len(frequency))
            found[: len(frequency)] += frequency
            frequency = found
        at = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(frequency[at])], ["token", "n"])

    rows, tokens = passages.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids"))).first()
    found = passages.select("ids").mapInArrow(giving_back(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(int(found["token"].max()) + 1 if len(found) else 1, np.int64)
    frequency[found["token"].to_numpy()] = found["n"].to_numpy()
    return Statistics(rows, (tokens or 0) // np.dtype(kind).itemsize, frequency, kind)


def _topics(known: Statistics):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(known.topics(batch.column(0).to_pylist()), pa.int64())], ["topic"])

    return run


def shard_plan(counts: list[tuple[int, int]], rows: int) -> list[tuple[int, int, int]]:
    """(topic, first shard, shards) from (topic, passages): topics in order share a shard until it has about `rows`; one with more has shards of its own."""
    plan, shard, filled = [], 0, 0
    for topic, n in sorted(counts):
        if n > rows:
            shard, filled = shard + bool(filled), 0
            width = -(-n // rows)
            plan.append((topic, shard, width))
            shard += width
            continue
        if filled and filled + n > rows:
            shard, filled = shard + 1, 0
        plan.append((topic, shard, 1))
        filled += n
    return plan


class Index:
    """The inverted index of a shard: for each token the passages that hold it and its weight in each."""

    def __init__(self, passages: list[bytes], known: Statistics):
        self.bags = Bags(passages, known.kind)
        self.weights_of = known.weights(self.bags)
        order = np.argsort(self.bags.tokens, kind="stable")
        self.passages, self.weights = self.bags.owner[order], self.weights_of[order]
        self.tokens, begin = np.unique(self.bags.tokens[order], return_index=True)
        self.ends = np.append(begin, len(order))
        self.used = np.zeros(len(passages), bool)

    def neighbours(self, seed: int, most: int = NEIGHBOURS) -> list[int]:
        """Unused passages by descending score against the seed's weightiest tokens, ties in order; at most so many."""
        scores = np.zeros(len(self.used), np.float32)
        own = slice(self.bags.starts[seed], self.bags.starts[seed + 1])
        chosen = np.argsort(-self.weights_of[own], kind="stable")[:QUERY_TOKENS]
        for at in np.searchsorted(self.tokens, self.bags.tokens[own][chosen]).tolist():
            begin, end = self.ends[at], self.ends[at + 1]
            scores[self.passages[begin:end]] += self.weights[begin:end]
        scores[self.used] = 0
        found = np.flatnonzero(scores)
        if len(found) > most:
            found = found[np.argpartition(-scores[found], most)[:most]]
        return found[np.argsort(-scores[found], kind="stable")].tolist()


def pack(passages: list[bytes], known: Statistics, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (passage, start in it, length). All but the last ones are full; those have lengths of powers of two."""
    index, sizes = Index(passages, known), [len(p) // known.size for p in passages]
    sequences, piece, unused = [], None, iter(range(len(passages)))
    now, room = [], window

    def place(i: int, start: int) -> int | None:
        """Puts what fits of a passage from start on into the window; where it went on, if it did."""
        nonlocal now, room
        length = min(room, sizes[i] - start)
        now.append((i, start, length))
        room -= length
        if not room:
            sequences.append(now)
            now, room = [], window
        return start + length if start + length < sizes[i] else None

    while True:
        if piece is None:  # the next seed
            seed = next((i for i in unused if not index.used[i]), None)
            if seed is None:
                break
            index.used[seed] = True
            piece = (seed, 0)
        seed, start = piece
        rest = place(seed, start)
        piece = None if rest is None else (seed, rest)
        if piece or room == window:
            continue
        for i in index.neighbours(seed):
            index.used[i] = True
            rest = place(i, 0)
            if room == window:  # full
                piece = None if rest is None else (i, rest)
                break
    # the rest: the greatest power of two that is there, again and again
    left = sum(n for _, _, n in now)
    while left:
        take, room = 1 << left.bit_length() - 1, 0
        sequence, left = [], left - take
        while take:
            i, start, n = now.pop(0)
            if n > take:
                now.insert(0, (i, start + take, n - take))
                n = take
            sequence.append((i, start, n))
            take -= n
        sequences.append(sequence)
    return sequences


_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_KINDS = [pa.int64()] * 6 + [pa.binary()]
_NAMES = [f.split()[0] for f in _PIECES.split(", ")]


def packed(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The pieces of all sequences of docs(doc_id, text): doc_id, start (ids of the row before it), length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit integers).

    Null and empty texts are an end id alone; null ids and repeated rows stay as they are, each row packed for itself; other columns are not read; an empty
    table gives no pieces. Equal scores are taken in the order of doc_id, start and ids. A row's ids are cut at windows, and where a window is full.
    """
    stored = written(tokenized(docs, path, end_id, window), "pack-ids")
    known = statistics(stored, kept(path, end_id))
    full = F.octet_length("ids") == known.size * window
    short = stored.filter(~full)
    topics = short.select("ids").mapInArrow(giving_back(_topics(known)), "topic long").groupBy("topic").count()
    plan = shard_plan([tuple(r) for r in topics.collect()], shard_rows)  # a row for each token of the vocabulary at most
    first, width = np.zeros(max((t for t, *_ in plan), default=0) + 1, np.int64), np.ones(max((t for t, *_ in plan), default=0) + 1, np.int64)
    for topic, shard, shards in plan:
        first[topic], width[topic] = shard, shards
    shards = max((s + w for _, s, w in plan), default=1)

    def dealt(batches):
        for batch in batches:
            topic = known.topics(batch.column(3).to_pylist())
            spread = batch.column(4).to_numpy().view(np.uint64) % width[topic].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(first[topic] + spread.astype(np.int64))], [*batch.schema.names[:4], "shard"])

    def given(ids: bytes) -> bytes:
        return np.frombuffer(ids, known.kind).astype(GIVEN).tobytes()

    def widened(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(given, batch.column(6).to_pylist()), pa.binary())], _NAMES)

    def run(batches):
        shard, rows = None, []

        def close():
            out = []
            for k, sequence in enumerate(pack([r[3] for r in rows], known, window)):
                offset = 0
                for i, start, length in sequence:
                    doc, before, total, ids = rows[i]
                    out.append((doc, before + start, length, total, shard << 32 | k, offset, given(ids[known.size * start : known.size * (start + length)])))
                    offset += length
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[at : at + 1000]), _KINDS)], _NAMES)

        for batch in batches:
            for *row, s in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard and rows:
                    yield from close()
                    rows = []
                shard = s
                rows.append(row)
        if rows:
            yield from close()

    # rows alike in all they hold are told apart by their place
    keyed = short.select("doc_id", "start", "doc_tokens", "ids", F.xxhash64("doc_id", "start", F.monotonically_increasing_id()).alias("spread"))
    by_shard = keyed.mapInArrow(giving_back(dealt), "doc_id long, start long, doc_tokens long, ids binary, shard long").repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "start", "ids")
    whole = stored.filter(full).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id())
    whole = whole.select("doc_id", "start", F.lit(window).cast("long").alias("length"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "ids")
    return by_shard.mapInArrow(giving_back(run), _PIECES).unionByName(whole.mapInArrow(giving_back(widened), _PIECES))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
