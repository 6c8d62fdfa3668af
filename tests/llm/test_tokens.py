"""Words and ids against the tokenizers library; files, packing and the transducer."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom import storage
from barloom.llm import bpe_codec, common, packing, pretokens, token_files, tokens, transducer
from barloom.llm.pretokens import Memo
from barloom.llm.tokens import Encoder
from barloom.llm.transducer import WordCoder, sufficient_lookahead

PARTS = [*"aB 's'd'll  \n\t 1२2é.,'|<#$ςΣİſ", "'re", "'VE", " '", "don't", "<|endoftext|>", "<|startoftext|>", "　", "你好", "\r\n", "½", "한", "😀"]


def mixtures(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def ids_of(path: str, texts: list[str]) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_give_the_librarys_ids(byte_bpe):
    texts = mixtures(2000)
    assert [x.tolist() for x in Encoder(byte_bpe).encode(texts)] == ids_of(byte_bpe, texts)


def test_a_full_memo_starts_anew(byte_bpe):
    encoder = Encoder(byte_bpe)
    encoder.memo = Memo(encoder._learn, limit=40)
    texts = [f"word{i} and{i} more{i % 7}" for i in range(60)]
    for k in range(0, 60, 5):
        assert [x.tolist() for x in encoder.encode(texts[k : k + 5])] == ids_of(byte_bpe, texts[k : k + 5])
    assert len(encoder.memo.keys) <= 40


def test_transducer_equals_the_library(word_bpe):
    rng = random.Random(3)
    long = ["a" * 4000, "-" * 2500, "ab" * 1500 + "c", "".join(rng.choice("abcdefg") for _ in range(3000))]
    texts = mixtures(1500) + long
    coder = WordCoder(word_bpe)
    found = [x.tolist() for x in coder.encode(texts)]
    assert found == ids_of(word_bpe, texts)
    tokenizer = Tokenizer.from_file(word_bpe)
    for ids in found[:300]:
        assert coder.decoder(library=True).decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_letters_with_a_far_lower_case(word_bpe):
    texts = ["\u023ab \u023e x", "\u0130stanbul", "a" + "".join(map(chr, range(0xC0, 0x300))) + " b"]
    assert [x.tolist() for x in WordCoder(word_bpe).encode(texts)] == ids_of(word_bpe, texts)


def test_long_texts_are_encoded_in_parts(word_bpe, monkeypatch):
    monkeypatch.setattr(transducer, "PART", 40)
    coder = WordCoder(word_bpe)
    texts = [" ".join(mixtures(40, seed)) for seed in range(8)] + ["x" * 300, "e \u0301" * 60, ("don't " * 50).strip(), " \n\t" * 60]
    for text in texts:
        parts = list(coder.cuts(text))
        assert "".join(parts) == text
        assert all(p[0] in " \n\t" for p in parts[1:])
    assert max(len(list(coder.cuts(t))) for t in texts) > 5
    assert [x.tolist() for x in coder.encode(texts)] == ids_of(word_bpe, texts)


def test_transducer_emits_before_the_end_and_holds_little(word_bpe):
    transducer = WordCoder(word_bpe).transducer
    read = 0

    def symbols():
        nonlocal read
        for c in "banana" * 5000:
            read += 1
            yield c

    first = next(transducer.stream(symbols()))
    assert first in transducer.vocabulary.values()
    assert read <= 2 * transducer.lookahead + 70


def test_lookahead_follows_chains():
    assert sufficient_lookahead([("a", "b")]) == 2
    # ab, then c + ab: a difference after "ab" can reach c.
    assert sufficient_lookahead([("ab", "x"), ("c", "ab")]) == 4


def test_decoder_builds_characters_from_bytes(word_bpe):
    coder = WordCoder(word_bpe)
    ids = coder.encode(["héllo 你好 wörld"])[0].tolist()
    assert coder.decoder().decode(ids).split() == ["héllo", "你好", "wörld"]


def test_decoding_in_parts_is_decoding_at_once(word_bpe):
    coder = WordCoder(word_bpe)
    ids = coder.encode(["héllo 你好 <|endoftext|> wörld 😀"])[0].tolist()
    for library in (True, False):
        whole, parts = coder.decoder(library), coder.decoder(library)
        assert "".join([parts.feed_all(ids[:3]), *map(parts.feed, ids[3:7]), parts.feed_all(ids[7:]), parts.end()]) == whole.decode(ids)


def plain_text(library: Tokenizer, ids: list[int]) -> str:
    """The text of ids, by a table of bytes and one look at the whole."""
    values = {s: b for b, s in enumerate(transducer.byte_symbols())}
    out = b""
    for token in map(library.id_to_token, ids):
        if token.startswith("<|") and token.endswith("|>"):
            out += token.encode()
        else:
            out += bytes(values[c] for c in token.removesuffix("</w>")) + (b" " if token.endswith("</w>") else b"")
    return out.decode("utf-8", "replace")


def test_plain_text_has_the_words_of_the_text(word_bpe):
    coder = WordCoder(word_bpe)
    texts = ["", "Straße, 12 Ängste!", "a<|endoftext|>b 你好 😀", "don't\n\tstop"]
    found = [coder.decoder().decode(x.tolist()) for x in coder.encode(texts)]
    assert found == ["", "straße , 1 2 ängste ! ", "a <|endoftext|>b 你好 😀 ", "don 't stop "]


def test_round_trip_operator(spark, awkward, empty, word_bpe):
    out = bpe_codec.round_trip(awkward, word_bpe).collect()
    texts = {(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()}
    assert len(out) == awkward.count()
    expected = sorted(" ".join(map(str, i)) for i in ids_of(word_bpe, [t or "" for _, t in texts]))
    assert sorted({bytes(r.ids).decode() for r in out}) == sorted(set(expected))
    library = Tokenizer.from_file(word_bpe)
    for r in out:
        ids = [int(i) for i in bytes(r.ids).split()]
        assert bytes(r.decoded).decode() == library.decode(ids, skip_special_tokens=False)
        assert bytes(r.plain).decode() == plain_text(library, ids)
    assert bpe_codec.round_trip(empty, word_bpe).count() == 0


def ends(path, texts, end):
    return [[*x, end] for x in ids_of(path, [t or "" for t in texts])]


def test_token_files_round_trip(spark, awkward, empty, byte_bpe):
    stored = token_files.write(awkward, storage.scratch_path(spark, "files"), byte_bpe, 2)
    out = token_files.read(spark, stored).orderBy("start").collect()
    keys = [r.doc_id for r in out]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    at = 0
    for r in out:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    texts = [r.text for r in awkward.select("text").collect()]
    assert sorted(r.ids for r in out) == sorted(ends(byte_bpe, texts, 2))
    assert stored.kind == "<u2"
    none = token_files.write(empty, storage.scratch_path(spark, "files"), byte_bpe, 2)
    assert token_files.read(spark, none).count() == 0


def test_packing_holds_each_id_once(spark, awkward, empty, byte_bpe):
    out = packing.pack(awkward, byte_bpe, 1, length=64, group_docs=4, slack=4).collect()
    sequences: dict[int, list] = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and (64 - at <= 4 or at & (at - 1) == 0)
    texts = {(r.doc_id, r.text) for r in awkward.select("doc_id", "text").where("doc_id in (4, 8)").collect()}
    for key, text in texts:
        pieces = sorted((r for r in out if r.doc_id == key), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
        assert ids == ends(byte_bpe, [text], 1)[0]
    assert sum(r.length for r in out) == sum(map(len, ends(byte_bpe, [r.text for r in awkward.select("text").collect()], 1)))
    assert packing.pack(empty, byte_bpe, 1).count() == 0


def test_tournament_finds_the_first_bin_with_room():
    rng = random.Random(9)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        home = next((b for b in bins if sum(sizes[k] for k in b) + size <= 100), None)
        bins.append([i]) if home is None else home.append(i)
    assert packing.first_fit_decreasing(sizes, 100) == bins


def thue_morse(letters: int, flip: bool = False) -> str:
    """Two such words share every polynomial hash modulo a power of two."""
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(letters))


@pytest.mark.parametrize("letters", [1024, 2048])
def test_words_that_share_a_hash_keep_their_own_ids(spark, byte_bpe, word_bpe, letters):
    first, second = thue_morse(letters), thue_morse(letters, flip=True)
    chars, offsets = pretokens.joined([first, second])
    assert len(set(common.span_hashes(chars, offsets[:-1], offsets[1:]).tolist())) == 1
    library = Tokenizer.from_file(byte_bpe)
    texts = [first, second, f"{first} {second} {first}", f"x {second} {second}"]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = tokens.Encoder(byte_bpe)
    assert [x.tolist() for x in encoder.encode(texts)] == expected
    for text, ids in zip(reversed(texts), reversed(expected), strict=True):  # one by one, from the memo
        assert encoder.encode([text])[0].tolist() == ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    stored = token_files.write(df, str(Path(spark.conf.get("spark.checkpoint.dir")) / f"ties{letters}"), byte_bpe, 2)
    lengths = {r["doc_id"]: r["n_tokens"] for r in token_files.read(spark, stored, with_ids=False).collect()}
    assert lengths == {k: len(x) + 1 for k, x in enumerate(expected)}
    pieces = sorted(packing.pack(df, byte_bpe, 1).collect(), key=lambda r: (r["doc_id"], r["start"]))
    for k, ids in enumerate(expected):
        held = b"".join(bytes(r["ids"]) for r in pieces if r["doc_id"] == k)
        assert np.frombuffer(held, "<u4").tolist() == [*ids, 1]
    words = Tokenizer.from_file(word_bpe)
    coded = {r["doc_id"]: bytes(r["ids"]).decode() for r in bpe_codec.round_trip(df, word_bpe).collect()}
    assert coded == {k: " ".join(map(str, words.encode(t, add_special_tokens=False).ids)) for k, t in enumerate(texts)}


@pytest.mark.parametrize("groups", [64, 1024])
def test_whole_pieces_of_a_long_text_go_to_all_groups(spark, byte_bpe, groups):
    rows = [(0, " a" * 2048 * 150)] + [(k, "b") for k in range(1, groups)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    pieces = packing.pack(df, byte_bpe, 1, group_docs=1).where("doc_id = 0 and length = 2048")
    sizes = [r["count"] for r in pieces.groupBy((F.col("sequence_id") / 2**32).cast("long")).count().collect()]
    assert sum(sizes) == 150 and len(sizes) == min(groups, 150) and max(sizes) <= 3


def test_equal_rows_go_to_all_groups(spark, byte_bpe):
    df = spark.createDataFrame([(7, "the same text")] * 2000, "doc_id long, text string").repartition(3)
    pieces = packing.pack(df, byte_bpe, 1, group_docs=2000 // 32)
    sizes = [r["count"] for r in pieces.groupBy((F.col("sequence_id") / 2**32).cast("long")).count().collect()]
    assert sum(sizes) >= 2000 and len(sizes) >= 32 and max(sizes) <= 2 * sum(sizes) / len(sizes)
