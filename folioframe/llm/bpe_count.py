"""Token counts by heap-and-linked-list byte-pair merging (no identifiers are emitted).

A text is cut at special strings, then into the pieces of the tokenizer's pattern. In a piece
every byte is a symbol; a heap holds the ranks of adjacent pairs and a doubly linked list the
symbols. The lowest-rank pair (leftmost among equals) merges until none is left, so that
count = symbols at the start - merges.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache

#: The pattern of byte-level byte-pair tokenizers of this kind.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def even_space(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    return " ".join(text.split()) == text.replace("\n", " ")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts of the tokens of whole texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, cache_limit: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[s] for s in byte_symbols()]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES).findall
        self.after_space = BoundedCache(lambda word: self.count_pieces(" " + word), cache_limit)
        self.bare = BoundedCache(self.count_pieces, cache_limit // 4)

    def count_piece(self, piece: bytes) -> int:
        """Symbols left after merging one piece."""
        n = len(piece)
        if n < 2:
            return n
        pairs = self.pairs
        symbol = [self.first[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [found[0] << 32 | i for i in range(n - 1) if (found := pairs.get(symbol[i] << 20 | symbol[i + 1]))]
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = pairs.get(symbol[i] << 20 | symbol[j])
            if found is None or found[0] != top >> 32:
                continue  # one of the two has merged meanwhile
            merges += 1
            symbol[i], symbol[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(symbol[i] << 20 | symbol[k]):
                    heappush(heap, found[0] << 32 | i)
            if (h := before[i]) >= 0 and (found := pairs.get(symbol[h] << 20 | symbol[i])):
                heappush(heap, found[0] << 32 | h)
        return n - merges

    def count_pieces(self, text: str) -> int:
        return sum(self.count_piece(p.encode()) for p in self.pieces(text))

    def count_plain(self, text: str) -> int:
        """Without special strings. Where white space is even, each space begins a new piece and each
        line feed is one of its own, so words can be counted apart and remembered."""
        if not text:
            return 0
        if not even_space(text):
            return self.count_pieces(text)
        lines = text.split("\n")
        total = len(lines) - 1
        after_space, bare = self.after_space.__getitem__, self.bare
        for line in lines:
            words = line.split(" ")
            total += bare[words[0]] + sum(map(after_space, words[1:]))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return self.count_plain(text)
        return len(self.cut.findall(text)) + sum(map(self.count_plain, self.cut.split(text)))


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One per worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: a byte-level BPE file of the tokenizers library, readable on every executor.
    Null and empty texts have no tokens; null ids and repeated rows stay as they are; other columns,
    whatever their names, are not read; an empty table gives an empty result; texts of any length
    are counted whole. Narrow: no shuffle, one pass.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        own = counter(path)
        for batch in batches:
            counts = pa.array([own.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["_id", "n_bytes", "n_tokens"])

    counted = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    ).mapInArrow(run, f"_id {kind.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
