"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A merge list has a sufficient lookahead (Berglund and van der Merwe, 2023): how far back
from the end of what was read a later symbol can still change the tokens. Merges are applied in
the order of the list, so beside the end a difference moves left only through a merge across
its edge, by the length of that merge's left part, and the next such merge comes later
in the list and has a right part that begins with that left part. The longest such chain bounds
the lookahead. The transducer reads symbols into a buffer, and once it holds more than the
lookahead, emits the tokens that end before it; memory is constant for words of any length.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from barloom.llm import pretokens

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Below this code point every text is in composed form already.
COMPOSED = 0x300
#: Characters of a text that are encoded at once, and where a longer one may be cut.
PART = 1 << 20
_GAP = re.compile("[ \t\n]")
#: Letters whose lower-cased form is longer, or beyond the table of classes.
_FAR = "".join(c for c in map(chr, range(COMPOSED)) if len(c.lower()) > 1 or ord(c.lower()) >= pretokens.STABLE)
#: Texts with these go the long way.
_APART = re.compile(f"[{_FAR}{chr(COMPOSED)}-{chr(0x10FFFF)}]")


@functools.cache
def byte_symbols() -> list[str]:
    """The printable symbol of each byte, by the rule of byte-level vocabularies: those without one go to 256 and up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def sufficient_lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """Symbols from the end of the input beyond which tokens are final."""
    best: dict[str, int] = {}
    longest = 0
    for left, right in merges:
        chain = max((best.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0) + length(left)
        if chain > best.get(left, 0):
            best[left] = chain
            longest = max(longest, chain)
    return longest + 1


class Transducer:
    """Symbols of one word in, ids of its tokens out."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocabulary, self.suffix = vocabulary, suffix
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, lambda s: len(s.removesuffix(suffix)) if suffix else len(s))

    def _merged(self, symbols: list[str]) -> list[str]:
        """All merges of a buffer, the first in the list first, from left to right."""
        rank, none = self.rank, len(self.rank)
        symbols = list(symbols)
        ranks = [rank.get(p, none) for p in zip(symbols[:-1], symbols[1:], strict=True)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            symbols[i] += symbols.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((symbols[i], symbols[i + 1]), none)
        return symbols

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Emit ids as soon as they are final; ``symbols`` is read once and may be of any length."""
        held: list[str] = []
        limit = 2 * self.lookahead + 64
        symbols = iter(symbols)
        ahead = next(symbols, None)
        while ahead is not None:
            symbol, ahead = ahead, next(symbols, None)
            held.append(symbol + self.suffix if ahead is None else symbol)
            if ahead is not None and len(held) >= limit:
                done, stable = 0, len(held) - self.lookahead
                for token in self._merged(held):
                    if done + len(token) > stable:
                        break
                    done += len(token)
                    yield self.vocabulary[token]
                held = held[done:]
        for token in self._merged(held):
            yield self.vocabulary[token]

    def word(self, symbols: str) -> list[int]:
        """Ids of a word; one that the buffer holds whole is merged at its end."""
        if 0 < len(symbols) < self.lookahead:
            whole = [*symbols[:-1], symbols[-1] + self.suffix]
            return [self.vocabulary[token] for token in self._merged(whole)]
        return list(self.stream(symbols))


class StreamDecoder:
    """Ids in, text out: tokens' symbols become bytes, and bytes become text once a character is whole.

    ``pieces`` are the bytes of each token. What is held between two calls is at most the begun bytes of one character.
    ``library`` gives the form of tokenizer files that name no decoder: the tokens as they are, a blank between two.
    """

    def __init__(self, tokens: list[str], pieces: list[bytes], library: bool = False):
        self.tokens, self.pieces, self.library = tokens, pieces, library
        self.reset()

    def reset(self) -> None:
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, i: int) -> str:
        return self.feed_all([i])

    def feed_all(self, ids: list[int]) -> str:
        """The text that a run of ids adds; tokens as they are need no bytes, only whether one came before."""
        if not self.library:
            pieces = self.pieces
            return self.state.decode(b"".join([pieces[i] for i in ids]))
        lead = " " if self.begun and ids else ""
        self.begun = self.begun or bool(ids)
        tokens = self.tokens
        return lead + " ".join([tokens[i] for i in ids])

    def end(self) -> str:
        text = self.state.decode(b"", True)
        self.reset()
        return text

    def decode(self, ids: Iterable[int]) -> str:
        return self.feed_all(list(ids)) + self.end()


class WordCoder:
    """Encoding and decoding by a tokenizer file of lower-cased words with an end-of-word suffix.

    Its steps: special tokens are cut out of the raw text; what is between them is composed (NFC),
    lower-cased and split into words; each word's bytes go through the transducer. The ids of
    the words met lately are kept in a bounded memo.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, self.suffix)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.symbols = byte_symbols()
        self.memo = pretokens.Memo(self._learn)
        lower = np.arange(COMPOSED, dtype=np.uint32)
        for c in range(COMPOSED):
            if chr(c) not in _FAR:
                lower[c] = ord(chr(c).lower())
        self.lower = lower
        self.decimal = [str(i).encode() for i in range(len(self.tokens))]
        self.pieces = self._pieces()

    def _pieces(self) -> list[bytes]:
        """The bytes of each token; a blank follows the end of a word."""
        values, special = {s: b for b, s in enumerate(self.symbols)}, set(self.special.values())
        out = []
        for i, token in enumerate(self.tokens):
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token.removesuffix(self.suffix) if ends else token
            if i in special or not values.keys() >= set(body):
                out.append(token.encode())
            else:
                out.append(bytes(values[c] for c in body) + b" " * ends)
        return out

    def _word(self, word: str) -> list[int]:
        return self.transducer.word("".join(self.symbols[b] for b in word.encode()))

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._word(w) for w in words]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _normal(self, text: str) -> str:
        """Composed and lower-cased character by character, without rules of context."""
        return "".join([c.lower() for c in unicodedata.normalize("NFC", text)])

    def _slow(self, text: str) -> np.ndarray:
        out, at = [], 0
        for hit in self.cut.finditer(text):
            out += [i for w in WORDS.findall(self._normal(text[at : hit.start()])) for i in self._word(w)]
            out.append(self.special[hit[0]])
            at = hit.end()
        out += [i for w in WORDS.findall(self._normal(text[at:])) for i in self._word(w)]
        return np.array(out, np.uint32)

    def cuts(self, text: str) -> Iterator[str]:
        """``text`` in parts of about ``PART`` characters, each but the first from white space on, which is in no word."""
        at = 0
        while hit := _GAP.search(text, at + PART):
            yield text[at : hit.start()]
            at = hit.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A long text is encoded in parts, so that arrays over it stay small."""
        out = self._encoded([t if len(t) <= PART else "" for t in texts])
        for i, text in enumerate(texts):
            if len(text) > PART:
                out[i] = np.concatenate([self._encoded([part])[0] for part in self.cuts(text)])
        return out

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        apart = [i for i, t in enumerate(texts) if not t.isascii() and _APART.search(t) or self.cut.search(t)]
        plain = list(texts)
        for i in apart:
            plain[i] = ""
        chars, offsets = pretokens.joined(plain)
        chars = self.lower[chars]
        starts, ends = pretokens.bare_words(chars, offsets)
        text = chars.astype("<u4").tobytes().decode("utf-32-le")
        ids, lengths = self.memo.encode(text, chars, starts, ends)
        out = pretokens.per_text(ids, lengths, starts, offsets)
        for i in apart:
            out[i] = self._slow(texts[i])
        return out

    def decoder(self, library: bool = False) -> StreamDecoder:
        return StreamDecoder(self.tokens, self.pieces, library)


@functools.lru_cache(maxsize=1)
def coder(path: str) -> WordCoder:
    """One coder a worker process."""
    return WordCoder(path)
