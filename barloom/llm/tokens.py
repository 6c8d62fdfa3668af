"""Ids of many texts by a tokenizer file, equal to the tokenizers library's, for files of byte-level words.

The library's own pass over whole texts takes most of its time for words it has met before.
Here the library encodes each new word once (see ``pretokens``); texts that need more than
words (special tokens, code points whose class may differ between Unicode versions) and
files of another kind go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
from tokenizers import Tokenizer

from barloom.llm import pretokens
from barloom.llm.common import taken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Encoder:
    """``encode(texts)``: one array of ids for each text, as the library's ``encode`` without special tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.by_words = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex")
            and not before.get("add_prefix_space")
            and spec["normalizer"] is None
            and model.get("type") == "BPE"
            and not model.get("dropout")
        )
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        blank = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            blank[i] = token.startswith("Ġ")
        self.opens = blank
        self.memo = pretokens.Memo(self._learn)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that begin with a blank are encoded many at a time and told apart by their first ids."""
        spaced = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        other = sorted(set(range(len(words))).difference(spaced))
        parts = self._whole([words[i] for i in other])
        lengths = [np.array([len(x) for x in parts], np.int64)]
        for k in range(0, len(spaced), 500):
            group = [words[i] for i in spaced[k : k + 500]]
            ids = self._whole(["".join(group)])[0]
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(group):
                parts.append(ids)
                lengths.append(np.diff(at, append=len(ids)))
            else:  # a word of the library's ends elsewhere: ask for each
                parts += (each := self._whole(group))
                lengths.append(np.array([len(x) for x in each], np.int64))
        order = np.array(other + spaced, np.int64)
        size = np.concatenate(lengths)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        begin = np.cumsum(size) - size
        ids = np.concatenate([*parts, np.zeros(0, np.uint32)])
        return ids[taken(begin[place], size[place])], size[place]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return self._whole(texts)
        apart = [i for i, t in enumerate(texts) if pretokens.unstable(t) or any(s in t for s in self.special)]
        plain = list(texts)
        for i in apart:
            plain[i] = ""
        chars, offsets = pretokens.joined(plain)
        starts, ends = pretokens.spaced_words(chars, offsets)
        ids, lengths = self.memo.encode("".join(plain), chars, starts, ends)
        out = pretokens.per_text(ids, lengths, starts, offsets)
        for i, found in zip(apart, self._whole([texts[i] for i in apart]), strict=True):
            out[i] = found
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process; its memo outlives the task."""
    return Encoder(path)
