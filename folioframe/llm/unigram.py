"""SentencePiece unigram encoding: the best path through a double-array trie of scored pieces, with byte fallback.

Spaces become the marker U+2581 and one is put in front. Every character without a piece costs the least score less
10, as one unknown; in the path it becomes the pieces of its bytes. Where no piece holds a marker after another character, a
path never crosses the start of a run of markers, so the distinct parts of a batch are solved, all at once, and put back.

A model whose scores are merge ranks (BPE) says in which order pieces were found, not how likely they are: its n-th normal
piece has the log probability of Zipf's law with Mandelbrot's shift, -log((n + SHIFT) * H), n from 0, H making the sum 1.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, held, slices

MARK = "▁"
#: Penalty of an unknown character below the least score.
UNKNOWN = 10.0
#: Shift of the rank in the law that turns merge ranks into log probabilities.
SHIFT = 2.7
#: Bytes of a part up to which it is solved together with others; bytes, with padding, solved at once; bytes of texts in work at once.
TOGETHER, AT_ONCE, IN_WORK = 96, 1 << 19, 1 << 20


class DoubleArray:
    """A trie over bytes in two arrays: a step from state s by byte b goes to base[s] + b if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        size = 1024
        base, check, value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size

        def grow(n: int):
            nonlocal size
            while size < n:
                base.extend([0] * size)
                check.extend([-1] * size)
                value.extend([-1] * size)
                size *= 2

        check[0], free, hint = 0, 257, 257  # so that free - byte is a place
        order = sorted(range(len(keys)), key=keys.__getitem__)
        todo = [(0, 0, len(order), 0)]  # state, range of sorted keys below it, depth
        while todo:
            state, low, high, depth = todo.pop()
            if len(keys[order[low]]) == depth:
                value[state] = values[order[low]]
                low += 1
            if low == high:
                continue
            groups, i = [], low
            while i < high:
                byte, j = keys[order[i]][depth], i
                while j < high and keys[order[j]][depth] == byte:
                    j += 1
                groups.append((byte, i, j))
                i = j
            while free < size and check[free] >= 0:
                free += 1
            # one child fits at the first free place; for more the search goes on where long searches have ended
            at = begin = max(1, (free if len(groups) == 1 else max(free, hint)) - groups[0][0])
            while True:
                grow(at + 257)
                if all(check[at + b] < 0 for b, _, _ in groups):
                    break
                at += 1
            if len(groups) > 1 and at - begin > 32:
                hint = at
            base[state] = at
            for b, i, j in groups:
                check[at + b] = state
                todo.append((at + b, i, j, depth + 1))
        self.base, self.check, self.value = (np.frombuffer(x, np.int32) for x in (base, check, value))

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int]]:
        """The arrays as lists, which a walk step by step, for long parts, reads faster."""
        return self.base.tolist(), self.check.tolist(), self.value.tolist()

    def prefixes(self, data: bytes, start: int) -> list[tuple[int, int]]:
        """(end, value) of every key that data[start:] begins with."""
        (base, check, value), found, state = self.lists, [], 0
        for i in range(start, len(data)):
            to = base[state] + data[i]
            if base[state] == 0 or check[to] != state:
                break
            state = to
            if value[state] >= 0:
                found.append((i + 1, value[state]))
        return found


class Unigram:
    """Encoder and decoder of a list of (piece, score, kind); kinds: normal, unknown, control, byte."""

    def __init__(self, pieces: list[tuple[str, float, str]], dummy_prefix: bool = True):
        self.dummy_prefix = dummy_prefix
        normal = [(p.encode(), i) for i, (p, _, kind) in enumerate(pieces) if kind == "normal" and p]
        self.scores = [s for _, s, _ in pieces]
        self.score_array = np.array(self.scores)
        self.trie = DoubleArray([p for p, _ in normal], [i for _, i in normal])
        self.longest = max((len(p) for p, _ in normal), default=0)
        self.unknown = min((pieces[i][1] for _, i in normal), default=0.0) - UNKNOWN
        self.unk_id = next((i for i, (_, _, kind) in enumerate(pieces) if kind == "unknown"), 0)
        bytes_ = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.byte_ids = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        own = {i: bytes([b]) for b, i in bytes_.items()}
        self.plain = [own.get(i, b"" if kind == "control" else " ⁇ ".encode() if kind == "unknown" else p.replace(MARK, " ").encode()) for i, (p, _, kind) in enumerate(pieces)]
        self.plain_array = pa.array(self.plain, pa.large_binary())
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", pieces[i][0]) for _, i in normal)

    @classmethod
    def load(cls, path: str) -> Unigram:
        """The pieces and log scores of a SentencePiece model file; merge ranks (whole numbers, each its own) give way to Zipf's law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def kind(i: int) -> str:
            return "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unused(i) else "unknown" if model.is_unknown(i) else "normal"

        pieces = [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.vocab_size())]
        normal = [s for _, s, k in pieces if k == "normal"]
        return cls(zipf_scores(pieces) if all(s == int(s) for s in normal) else pieces)

    def best_path(self, data: bytes) -> list[int]:
        """Viterbi over one text: the ids of the path of the largest sum of scores; among equals the one whose last piece is longest."""
        n = len(data)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        prefixes, scores = self.trie.prefixes, self.scores
        i = 0
        while i < n:
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, single = best[i], False
            for end, piece in prefixes(data, i):
                single |= end == i + width
                if here + scores[piece] > best[end]:
                    best[end], back[end] = here + scores[piece], (i, piece)
            if not single and here + self.unknown > best[i + width]:
                best[i + width], back[i + width] = here + self.unknown, (i, -1)
            i += width
        path: list[int] = []
        end = n
        while end > 0:
            start, piece = back[end]
            if piece >= 0:
                path.append(piece)
            elif self.byte_ids is not None:
                path += [self.byte_ids[b] for b in reversed(data[start:end])]
            elif not path or path[-1] != self.unk_id:
                path.append(self.unk_id)  # neighbouring unknowns are one
            end = start
        return path[::-1]

    def best_paths(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for every row of `text` (bytes as numbers, padded with 256): all ids in order, and how many each row has."""
        rows, width = text.shape
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        length = (text < 256).sum(1)
        best = np.full((width + 1, rows), -np.inf)
        best[0] = 0.0
        start, piece = np.zeros((width + 1, rows), np.int16), np.full((width + 1, rows), -1, np.int32)
        columns = np.ascontiguousarray(text.T)
        for i in range(width):
            at = np.flatnonzero((best[i] > -np.inf) & (i < length))
            if not len(at):
                continue
            lead = columns[i, at]
            wide = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single, here, row, state, place = np.zeros(len(at), bool), best[i, at], at, np.zeros(len(at), np.int32), np.arange(len(at))
            for end in range(i + 1, min(width, i + self.longest) + 1):
                to = base[state] + columns[end - 1, row]
                ok = np.flatnonzero((check[to] == state) & ((state == 0) | (base[state] > 0)))
                if not len(ok):
                    break
                row, state, place = row[ok], to[ok], place[ok]
                own = value[state]
                known = np.flatnonzero(own >= 0)
                if len(known):
                    r, p = row[known], own[known]
                    single[place[known]] |= wide[place[known]] == end - i
                    sums = here[place[known]] + self.score_array[p]
                    more = sums > best[end, r]
                    r = r[more]
                    best[end, r], piece[end, r], start[end, r] = sums[more], p[more], i
            left = np.flatnonzero(~single)
            r, end = at[left], i + wide[left]
            sums = here[left] + self.unknown
            more = sums > best[end, r]
            r, end = r[more], end[more]
            best[end, r], piece[end, r], start[end, r] = sums[more], -1, i
        # back from the ends; ids are put into a table from the right
        ids, filled = np.full((rows, width), -1, np.int64), np.full(rows, width)
        row, end, last = np.arange(rows), length.copy(), np.full(rows, -1, np.int64)

        def put(r, found):
            filled[r] -= 1
            ids[r, filled[r]] = found
            last[r] = found

        bytes_ = np.array(self.byte_ids if self.byte_ids is not None else [], np.int64)
        while True:
            row = row[end[row] > 0]
            if not len(row):
                break
            own, begin = piece[end[row], row], start[end[row], row]
            put(row[own >= 0], own[own >= 0])
            odd = row[own < 0]
            if len(odd):
                if self.byte_ids is None:
                    put(odd[last[odd] != self.unk_id], self.unk_id)
                else:
                    low = begin[own < 0]
                    for back in range(1, 5):
                        some = end[odd] - back >= low
                        put(odd[some], bytes_[text[odd[some], end[odd[some]] - back]])
            end[row] = begin
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    def normal(self, text: str) -> str:
        return ((" " if self.dummy_prefix else "") + text).replace(" ", MARK) if text else ""

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the place where each one begins (one more than texts)."""
        filled = pc.fill_null(texts, "").cast(pa.large_string())
        if self.dummy_prefix:
            filled = pc.if_else(pc.equal(filled, ""), filled, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), filled, pa.scalar("", pa.large_string())))
        marked = pc.replace_substring(filled, " ", MARK)
        places = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
        data = np.frombuffer(marked.buffers()[2], np.uint8)[places[0] : places[-1]] if places[-1] > places[0] else np.zeros(0, np.uint8)
        places = places - places[0]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[places] = True
        if self.apart:
            mark = np.zeros(len(data) + 3, bool)  # whether a marker starts here; shifted by 3: whether one has just ended
            mark[3:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            begins[: len(data)] |= mark[3:] & ~mark[:-3]
        begins[-1] = False
        cuts = np.append(np.flatnonzero(begins), len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids, sizes = self.solve(parts.dictionary)
        which = parts.indices.to_numpy(zero_copy_only=False)
        each = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.array(ids))
        coded = each.take(parts.indices).flatten().to_numpy(zero_copy_only=False)
        until = np.concatenate([[0], np.cumsum(sizes[which])])
        return coded, until[np.searchsorted(cuts, places)]

    def solve(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct parts in order, and how many each part has; parts of like length are solved together."""
        bounds = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        data = np.frombuffer(parts.buffers()[2], np.uint8).astype(np.int32)
        length = np.diff(bounds)
        order = np.argsort(length, kind="stable")
        sizes, found = np.zeros(len(parts), np.int64), []
        short = int(np.searchsorted(length[order], TOGETHER, side="right"))
        at = 0
        while at < short:
            some = order[at:short]
            some = some[: max(1, int(np.searchsorted(length[some] * np.arange(1, len(some) + 1), AT_ONCE, side="right")))]
            # no more than half of a table is padding
            some = some[: max(1, int(np.searchsorted(length[some], 2 * max(4, length[some[0]]), side="right")))]
            place = np.arange(length[some[-1]])
            inside = place < length[some][:, None]
            text = np.where(inside, data[np.minimum(bounds[some][:, None] + place, len(data) - 1)], 256)
            ids, sizes[some] = self.best_paths(text)
            found.append(ids)
            at += len(some)
        for i in order[short:]:
            ids = self.best_path(parts[int(i)].as_py())
            sizes[i] = len(ids)
            found.append(np.array(ids, np.int64))
        # from the order of lengths to the order of parts
        ids = np.concatenate(found)
        begin = np.zeros(len(parts), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))], sizes

    def decode_batch(self, ids: np.ndarray, places: np.ndarray) -> list[str]:
        """The text of each range of ids."""
        plain = self.plain_array.take(pa.array(ids))
        if not len(ids):
            return [""] * (len(places) - 1)
        ends = np.frombuffer(plain.buffers()[1], np.int64)[places].tolist()
        data = plain.buffers()[2].to_pybytes() if plain.buffers()[2] else b""
        texts = [data[a:b].decode(errors="replace") for a, b in zip(ends, ends[1:])]
        return [t[1:] if self.dummy_prefix and t.startswith(" ") else t for t in texts]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def zipf_scores(pieces: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """Pieces with log probabilities by their place among the normal ones."""
    ranks = np.cumsum([k == "normal" for _, _, k in pieces]) - 1 + SHIFT
    total = sum(1 / r for r, (_, _, k) in zip(ranks, pieces) if k == "normal")
    return [(p, -float(np.log(r * total)) if k == "normal" else s, k) for r, (p, s, k) in zip(ranks, pieces)]


def model(path: str) -> Unigram:
    return held(("unigram", path), lambda: Unigram.load(path))


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, pieces (array of ids) and decoded (the text read back from the ids) of every row of docs.

    Null and empty texts have no pieces and decode to an empty text; a text of any length is encoded whole; text with the marker
    itself reads back with spaces in its place. Repeated rows all stay, an empty table gives none. One pass without shuffle.
    """
    names = [f"_c{i}" for i in range(len(keep))]

    def run(batches):
        own = model(path)
        for batch in (part for whole in batches for part in slices(whole, 0, IN_WORK)):
            ids, places = own.encode_batch(batch.column(0))
            pieces = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pieces, pa.array(own.decode_batch(ids, places), pa.string())], [*names, "pieces", "decoded"])

    types = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    out = docs.select("text", *(F.col(c).alias(n) for n, c in zip(names, keep))).mapInArrow(giving_back(run), f"{types}, pieces array<int>, decoded string")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "pieces", "decoded")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), decoded_sha256 and round_trip of every row."""

    def run(batches):
        own = model(path)
        for batch in (part for whole in batches for part in slices(whole, 1, IN_WORK)):
            ids, places = own.encode_batch(batch.column(1))
            raw, ends = ids.astype("<u4").tobytes(), (places * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(places)), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.int64()), pa.array(own.decode_batch(ids, places), pa.string())],
                ["doc_id", "text", "n_tokens", "ids_crc32", "decoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, text string, n_tokens long, ids_crc32 long, decoded string")
    return out.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
