"""Texts as sequences of segments that tokenizers encode one by one, and tables of what segments give.

Where white space is even (single spaces and line feeds between words) no token of the tokenizers used here reaches over the
beginning of a word's space or line feed. Then a text is its words: each stands for itself behind a space, or begins with a line feed.
All other texts are one segment. Tables remember segments, so that each is encoded once in a worker.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe_count import even_space

#: Segments a table keeps from batch to batch, and the characters they may have on average. The first ones seen are the frequent ones.
KEPT, KEPT_CHARS = 500_000, 24


def words_of(text: str) -> list[str] | None:
    """The words of a text, the first of a line with its line feed in front; None if white space is not even."""
    return text.replace("\n", " \n").split(" ") if even_space(text) else None


#: White space of any kind that is no single space or line feed between two words, in the words of a regular expression.
UNEVEN = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"


#: Stands between parts; a text with one of its own is not cut. Behind an ASCII letter, anything that is none and no space begins a new piece.
BETWEEN, BEHIND_LETTER = "\0", r"([A-Za-z])([!-@\[-`{-~])"


def even_parts(texts: pa.Array, apart: pa.Array | None = None, spaces: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all parts one behind the other, the parts of each text, whether it is to be taken whole: such a text gives none). Null and empty texts have no parts.

    A part stands for itself: a word with the space before it, a line feed, what follows the letters of a word. Tokenizers with the usual patterns
    begin a new piece with each, so that the parts' tokens are the text's. For those that drop white space, parts are made without (`spaces`). Taken whole
    are texts whose white space is not even and those of `apart`."""
    whole = pc.or_(pc.fill_null(pc.match_substring_regex(texts, UNEVEN), False), pc.fill_null(pc.match_substring(texts, BETWEEN), False))
    whole = pc.or_(whole, apart) if apart is not None else whole
    none = pc.or_(whole, pc.fill_null(pc.equal(pc.binary_length(texts), 0), True))
    marked = pc.replace_substring_regex(texts, BEHIND_LETTER, rf"\1{BETWEEN}\2")
    for space, given in ((" ", f"{BETWEEN} "), ("\n", f"{BETWEEN}\n{BETWEEN}")):
        marked = pc.replace_substring(marked, space, given if spaces else BETWEEN)
    lists = pc.split_pattern(pc.if_else(none, pa.scalar(None, marked.type), marked), BETWEEN)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), counts, whole.to_numpy(zero_copy_only=False)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number of values of each list)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum()), sizes


class Ragged:
    """Rows of values in one array."""

    def __init__(self, kind):
        self.values, self.ends = np.zeros(0, kind), np.zeros(1, np.int64)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values.astype(self.values.dtype, copy=False)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def cut(self, rows: int) -> None:
        self.ends = self.ends[: rows + 1].copy()
        self.values = self.values[: self.ends[-1]].copy()

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of these rows one behind the other, number of values of each)."""
        begin, sizes = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)
        return self.values[at], sizes


class SegmentTable:
    """Numbers segments; `learn` gets the new ones of a batch in order and appends what it stores of them, `forget` drops all but the first n."""

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[int], None], kept: int = KEPT):
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.chars, self.learn, self.forget, self.kept = 0, learn, forget, kept

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the segments of each text."""
        get, index, fresh = self.index.get, self.index, []
        found = []
        for segments in texts:
            numbers = list(map(get, segments))
            if None in numbers:
                for i, n in enumerate(numbers):
                    if n is None:
                        s = segments[i]
                        n = numbers[i] = index.setdefault(s, len(index))
                        if n == len(self.names) + len(fresh):
                            fresh.append(s)
            found.append(np.array(numbers, np.int64))
        if fresh:
            self.learn(fresh)
            self.names += fresh
            self.chars += sum(map(len, fresh))
        return found

    def settle(self) -> None:
        """Between batches: goes back to the first segments when there are too many or too long ones."""
        if len(self.names) > self.kept or self.chars > self.kept * KEPT_CHARS:
            n = min(self.kept, len(self.names)) if self.chars <= self.kept * KEPT_CHARS else len(self.names) // 2
            for s in self.names[n:]:
                del self.index[s]
                self.chars -= len(s)
            del self.names[n:]
            self.forget(n)


class PartTable:
    """Remembers the ids of parts. What a batch has is looked up by Arrow; only parts that are new go to `learn`, which gives the ids of each."""

    def __init__(self, learn: Callable[[list[str]], list[list[int]]], kept: int = 2 * KEPT):
        self.learn, self.kept = learn, kept
        self.known, self.ids = pa.array([], pa.string()), Ragged(np.uint32)

    def ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts one behind the other, how many each has)."""
        coded = parts.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(pc.is_null(found))
        rows = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows[rows < 0] = len(self.known) + np.arange(len(fresh))
        if len(fresh):
            self.ids.extend(*flat(self.learn(fresh.to_pylist())))
            self.known = pa.concat_arrays([self.known, fresh])
        taken = self.ids.take(rows[coded.indices.to_numpy()])
        self.settle()
        return taken

    def settle(self) -> None:
        """Goes back to the first parts, the frequent ones, when there are too many or too long ones: to as many as both limits allow."""
        sizes = pc.binary_length(self.known)
        if len(self.known) > self.kept or (pc.sum(sizes).as_py() or 0) > self.kept * KEPT_CHARS:
            n = min(self.kept, int(np.searchsorted(np.cumsum(sizes.to_numpy(), dtype=np.int64), self.kept * KEPT_CHARS, "right")))
            self.known = pa.concat_arrays([self.known.slice(0, n)])
            self.ids.cut(n)
