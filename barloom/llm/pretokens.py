"""Words of tokenizer files, found in arrays of code points, and a bounded memo of their ids.

Byte-pair merges never cross a word, so a text's ids are the ids of its words. Words are
found for many texts at once with numpy; the ids of a word are kept in a memo of at most
``MEMO_WORDS`` words, which starts anew when it is full. Memory therefore has a bound,
whatever the number of texts. A word is looked up by a 64-bit hash, and its code points are compared with
those of the word that was learned: words that share a hash with another are encoded by themselves.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import regex

from barloom.llm.common import span_hashes, taken

MEMO_WORDS = 3 << 19
#: Code points of all words in the memo.
MEMO_CHARS = 1 << 24
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points below have had the same classes in every Unicode version for long.
STABLE = 0x530
#: After an apostrophe: fixed values of both word patterns.
SHORT_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point below ``STABLE``."""
    kinds = [(r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)]
    out = np.full(STABLE, OTHER, np.uint8)
    for pattern, kind in kinds:
        out[[bool(regex.fullmatch(pattern, chr(c))) for c in range(STABLE)]] = kind
    return out


_UNSTABLE = re.compile(f"[{chr(STABLE)}-{chr(0x10FFFF)}]")


def unstable(text: str) -> bool:
    """Whether a code point's class is to be left to the library."""
    return not text.isascii() and _UNSTABLE.search(text) is not None


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offsets of the texts."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.cumsum([0, *map(len, texts)])


def _runs(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and classes of the runs of one class; whether a run begins a text."""
    kind = classes()[chars]
    new = np.ones(len(chars), bool)
    new[1:] = kind[1:] != kind[:-1]
    begins = np.zeros(len(chars), bool)
    begins[offsets[offsets < len(chars)]] = True
    starts = np.flatnonzero(new | begins)
    return starts, np.append(starts[1:], len(chars)), kind[starts], begins[starts]


def _contractions(
    chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray, first: np.ndarray
) -> list[tuple[int, int, int]]:
    """(apostrophe, end of the ending, end of the letters) where a lone apostrophe opens a short ending."""
    lone = np.flatnonzero(
        (kind[:-1] == OTHER) & (ends[:-1] - starts[:-1] == 1) & (chars[starts[:-1]] == 0x27) & (kind[1:] == LETTER) & ~first[1:]
    )
    out = []
    for k in lone.tolist():
        at, stop = int(starts[k]), int(ends[k + 1])
        after = "".join(map(chr, chars[at + 1 : min(at + 3, stop)].tolist()))
        hit = next((e for e in SHORT_ENDINGS if after.startswith(e)), None)
        if hit:
            out.append((at, at + 1 + len(hit), stop))
    return out


def spaced_words(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the pattern in which a word takes the one blank before it.

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: every code point is in a word.
    """
    if not len(chars):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, kind, first = _runs(chars, offsets)
    cut = np.zeros(len(chars), bool)
    cut[starts] = True
    # A run of white space that a word of the same text follows gives its last blank to that word.
    gap = np.flatnonzero((kind[:-1] == SPACE) & ~first[1:])
    last = ends[gap] - 1
    blank = chars[last] == 0x20
    cut[last] = True
    cut[ends[gap][blank]] = False
    for at, stop, letters in _contractions(chars, starts, ends, kind, first):
        if not cut[at]:  # the blank before it belongs to it: an ordinary word
            continue
        cut[at + 1] = False
        if stop < letters:
            cut[stop] = True
    begin = np.flatnonzero(cut)
    return begin, np.append(begin[1:], len(chars))


def bare_words(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the pattern without white space and with single digits.

    ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``.
    """
    if not len(chars):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, kind, first = _runs(chars, offsets)
    cut = classes()[chars] == NUMBER
    cut[starts] = True
    for at, stop, letters in _contractions(chars, starts, ends, kind, first):
        cut[at + 1] = False
        if stop < letters:
            cut[stop] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(chars))
    word = classes()[chars[begin]] != SPACE
    return begin[word], end[word]


class Memo:
    """Ids of words by hash: sorted keys, one flat array of ids and one of the words themselves."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = MEMO_WORDS):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        # Words have code points below ``STABLE``; places and lengths are below a few times ``MEMO_CHARS``.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.chars, self.begins, self.sizes = np.zeros(0, np.uint16), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def _add(self, keys: np.ndarray, words: list[str], chars: np.ndarray, sizes: np.ndarray) -> None:
        found, lengths = self.learn(words)
        self.starts = _grown(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths, self.ids = _grown(self.lengths, lengths), _grown(self.ids, found)
        self.begins = _grown(self.begins, len(self.chars) + np.cumsum(sizes) - sizes)
        self.chars, self.sizes = _grown(self.chars, chars), _grown(self.sizes, sizes)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.slots = np.insert(self.slots, at, (len(self.slots) + order).astype(np.int32))
        self.keys = np.insert(self.keys, at, keys[order])

    def encode(self, text: str, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of ``text``, one after the other, and the number of ids of each word."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes = ends - starts
        codes, keys = pd.factorize(span_hashes(chars, starts, ends))
        where = np.empty(len(keys), np.int64)  # the first word of each hash
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        later = np.flatnonzero(where[codes] != np.arange(len(codes)))
        apart = later[~_equal(chars, starts[later], sizes[later], chars, starts[where[codes[later]]], sizes[where[codes[later]]])]
        slots = self._find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            if len(self.keys) + len(new) > self.limit or len(self.chars) + int(sizes[where[new]].sum()) > MEMO_CHARS:
                self.clear()
                new = np.arange(len(keys))
            spans = zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)
            own = sizes[where[new]]
            self._add(keys[new], [text[a:b] for a, b in spans], chars[taken(starts[where[new]], own)], own)
            slots = self._find(keys)
        known = _equal(self.chars, self.begins[slots], self.sizes[slots], chars, starts[where], sizes[where])
        if not known.all():
            apart = np.union1d(apart, np.flatnonzero(~known[codes]))
        slots = slots[codes]
        begins, lengths, ids = self.starts[slots].astype(np.int64), self.lengths[slots].astype(np.int64), self.ids
        if len(apart):  # words that share a hash with another word
            found, own = self.learn([text[a:b] for a, b in zip(starts[apart].tolist(), ends[apart].tolist(), strict=True)])
            begins[apart], lengths[apart] = len(ids) + np.cumsum(own) - own, own
            ids = np.append(ids, found)
        return ids[taken(begins, lengths)], lengths


def _grown(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``x`` and ``more``, kept as narrow as ``x``."""
    return np.concatenate([x, more.astype(x.dtype)])


def _equal(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, y: np.ndarray, others: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of ``x`` hold the same as those of ``y``. No span is empty."""
    same = sizes == other_sizes
    at = np.flatnonzero(same)
    if len(at):
        size = sizes[at]
        differ = x[taken(starts[at], size)] != y[taken(others[at], size)]
        if differ.any():
            same[at] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
    return same


def per_text(ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ids of all words cut up by text."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    at = sums[np.searchsorted(starts, offsets)]
    return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


