"""Counts over the words, lines and repeated windows of whole texts, vectorised over many texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from barloom.llm.common import keyed_hashes, mix, raw, word_spans

#: The characters counted as symbols (all ASCII).
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_WEIGHTS = mix(np.arange(101, 101 + WINDOW, dtype=np.uint64)) | np.uint64(1)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _keyed(hashes: np.ndarray, owner: np.ndarray) -> pd.Series:
    """Hashes that are equal only within one text."""
    return pd.Series(mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))))


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_echo_words`` (equal to the
    word before) and ``n_repeat_words`` of each text.

    Lines and windows are compared by 64-bit hashes within a text. A null text has no words.
    """
    data, offsets = raw(texts)
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[starts] += 1
    np.subtract.at(in_word, ends, 1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    out = {
        "n_words": n_words,
        "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
    }
    # A line begins at a text or after a line feed; an empty text has one empty line.
    feeds = np.flatnonzero(data == 0x0A)
    owner_of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    owner = np.concatenate([np.arange(n), owner_of_feed])
    begin = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    last = np.append(owner[1:] != owner[:-1], True)
    end = np.where(last, offsets[owner + 1], np.append(begin[1:] - 1, 0))
    word_sums = np.concatenate([[0], np.cumsum(in_word)])
    with_word = np.flatnonzero(word_sums[end] > word_sums[begin])
    owner, begin, end = owner[with_word], begin[with_word], end[with_word]
    again = _keyed(keyed_hashes(data, begin, end), owner).duplicated().to_numpy()
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)
    # Windows of words that stand twice in a text cover the words they hold.
    covered = np.zeros(len(starts) + 1, np.int64)
    hashes, owner = keyed_hashes(data, starts, ends), np.repeat(np.arange(n), n_words)
    echo = owner[1:][(owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])]
    out["n_echo_words"] = np.bincount(echo, minlength=n)
    if len(starts) >= WINDOW:
        inside = np.flatnonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])
        window = np.zeros(len(starts) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            window += hashes[k : len(window) + k] * _WEIGHTS[k]
        again = inside[_keyed(window[inside], owner[inside]).duplicated(keep=False).to_numpy()]
        covered[again] += 1
        np.subtract.at(covered, again + WINDOW, 1)
    out["n_repeat_words"] = _per_text(np.cumsum(covered[:-1]) > 0, first)
    return {k: v.astype(np.int64) for k, v in out.items()}
