"""Benchmark decontamination: a hash set of the test items' word n-grams, probed by every window of words.

Test items and training texts are lower-cased in A-Z and cut into words (digits, letters and all code
points beyond ASCII). A window is ``size`` consecutive words of an item, or a shorter item as a whole.
Equal windows of all items are one row, with their items. A bit array of their hashes, of fixed size, goes
into the expression that scans a text: it passes over each word once, hashes the window that begins there and
keeps only places whose bit is set. Those meet the windows by hash, and the words
themselves are compared before a place counts as a hit, so no result rests on a hash alone.

The windows are broadcast if they are at most ``BROADCAST_BYTES``, else Spark shuffles both sides; a place
meets one window at most, so neither a passage that many texts share nor a test item that is listed many times
multiplies rows. What is shuffled of a text is its key, its hits and the number of its words. Everything is
DataFrame functions.

Defined results: a null or empty text has no words, no hits and stays as it is; a null or empty item has no
windows; items that repeat an id count once; an item with a null id makes hits, but isn't named; each row of
the texts is judged on its own, rows that repeat an id or have none included; without test items nothing
is hit; empty tables give no rows. Other columns of the texts are kept, those of the items aren't read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import storage

WINDOW = 10
#: Bytes of windows that may be broadcast after a check of their size; what is larger is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: The bit array has 64 bits a window, within these powers of two. A fuller array lets more places pass to the join.
LEAST_BITS, MOST_BITS = 10, 22

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, _BETWEEN), lambda w: w != "")


def _window_hash(hashes: Column, start: Column | int, length: Column | int) -> Column:
    return F.xxhash64(F.slice(hashes, start, length))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``window`` (words), ``length``, ``hash`` and ``items`` (ids as strings, sorted) of each different window."""
    cut = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words"))
    cut = cut.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = cut.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window"))
    named = each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    length = F.size("window")
    hashes = F.transform("window", lambda w: F.xxhash64(w))
    return named.select("window", length.alias("length"), _window_hash(hashes, 1, length).alias("hash"), "items")


def _place(value: Column, bits: int) -> tuple[Column, Column]:
    """Where the bit of a hash stands: the element of the bit array and the bit in it."""
    return F.shiftrightunsigned(value, 64 - bits + 6).cast("int"), F.shiftrightunsigned(value, 64 - bits).bitwiseAND(F.lit(63)).cast("int")


def _bit_array(found: DataFrame, bits: int) -> Column:
    """The set bits of all windows as a constant; 2 ** (bits - 6) numbers at most reach the driver."""
    at, bit = _place(F.col("hash"), bits)
    ones = found.select(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one"))
    filled = [0] * (1 << (bits - 6))
    for row in ones.groupBy("at").agg(F.bit_or("one").alias("ones")).collect():
        filled[row["at"]] = row["ones"]
    return F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")


def hits(texts: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """For ``texts(key, text)``, once for each key: ``key, n_words, spans, items``.

    ``spans`` are the runs of hit words, as ``first`` and ``after`` (from 0, in order); ``items`` the ids of the
    items with windows that occur, sorted. Rows of one key have to have one text.
    """
    stored = storage.materialize(windows(items, item_id, item_text, size), "windows")
    weight = F.sum(F.length(F.array_join("window", " ")) + 8 * F.size("window") + F.length(F.array_join("items", " ")) + 8 * F.size("items") + 64)
    known = stored.agg(F.count("*").alias("n"), weight.alias("bytes"), F.collect_set("length").alias("lengths")).head()
    bits = min(max((64 * known["n"]).bit_length(), LEAST_BITS), MOST_BITS)
    bit_array = _bit_array(stored, bits)

    def may_occur(value: Column) -> Column:
        at, bit = _place(value, bits)
        return F.getbit(F.get(bit_array, at), bit) == 1

    cut = texts.select("key", words(F.col("text")).alias("words"))
    hashed = cut.select("key", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    none = F.array().cast("array<struct<first:int,length:int,hash:bigint,window:array<string>>>")

    def places(length: int) -> Column:
        """Where windows of ``length`` words may occur, with their words."""
        starts = F.sequence(F.lit(1), F.greatest(F.size("hashes") - length + 1, F.lit(1)))
        each = F.transform(starts, lambda i: F.struct(i.alias("i"), _window_hash(F.col("hashes"), i, length).alias("hash")))
        taken = F.transform(
            F.filter(each, lambda c: may_occur(c["hash"])),
            lambda c: F.struct(
                (c["i"] - 1).alias("first"), F.lit(length).alias("length"), c["hash"].alias("hash"), F.slice("words", c["i"], length).alias("window")
            ),
        )
        return F.when(F.size("hashes") >= length, taken).otherwise(none)

    found_at = F.concat(none, *(places(length) for length in sorted(known["lengths"])))
    probed = hashed.select("key", F.size("words").alias("n_words"), F.explode_outer(found_at).alias("p"))
    probed = probed.select("key", "n_words", "p.first", "p.length", F.col("p.hash").alias("p_hash"), F.col("p.window").alias("p_window"))
    known_windows = stored.select("hash", "window", "items")
    if (known["bytes"] or 0) <= BROADCAST_BYTES:
        known_windows = F.broadcast(known_windows)
    same = (F.col("p_hash") == F.col("hash")) & (F.col("p_window") == F.col("window"))
    met = probed.join(known_windows, same, "left").select("key", "n_words", F.when(F.col("hash").isNotNull(), F.struct("first", "length")).alias("hit"), "items")
    each = met.groupBy("key").agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hit"), F.collect_set("items").alias("items"))
    covered = F.transform("hit", lambda h: F.sequence(h["first"], h["first"] + h["length"] - 1))
    each = each.select("key", "n_words", F.array_sort(F.array_distinct(F.flatten(covered))).alias("c"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    opens = F.filter("c", lambda x, i: (i == 0) | (F.get("c", i - 1) != x - 1))
    closes = F.filter("c", lambda x, i: (i == F.size("c") - 1) | (F.get("c", i + 1) != x + 1))
    spans = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("after")))
    return each.select("key", "n_words", spans.alias("spans"), "items")


def n_hit(spans: Column) -> Column:
    """The number of words in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_words``, ``n_hit``, ``n_items``, ``items``, ``contaminated``."""
    # The number of the row, made while it is read, keeps rows apart that have the same id.
    key = F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
    found = hits(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, size=size)
    return found.select(
        F.col("key.id").alias(id_col),
        F.col("n_words").cast("long"),
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.size("spans") > 0).alias("contaminated"),
    )


def _parts(text: Column, spans: Column) -> Column:
    """The words of a text as they stand there, each with the gap before it and whether it is in a span."""
    found, between = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.split(text, _WORD)
    flags = F.flatten(
        F.transform(
            spans,
            lambda s, i: F.concat(
                F.array_repeat(F.lit(False), (s["first"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["after"])).cast("int")),
                F.array_repeat(F.lit(True), (s["after"] - s["first"]).cast("int")),
            ),
        )
    )
    # Words after the last span have no flag, and the last gap has no word.
    parts = F.arrays_zip(found.alias("word"), between.alias("gap"), flags.alias("gone"))
    return F.transform(
        parts,
        lambda x: F.struct(F.coalesce(x["word"], F.lit("")).alias("word"), x["gap"].alias("gap"), F.coalesce(x["gone"], F.lit(False)).alias("gone")),
    )


def cleaned(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, whole_documents: bool = False
) -> DataFrame:
    """``docs`` without the spans that occur in test items, or without the documents that have any.

    What stands between two words of a span goes with it; what stands before and after it stays. Rows without
    hits stay as they are.
    """
    helper = "_decontaminate"
    key = F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    found = hits(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, size=size)
    found = storage.materialize(found.where(F.size("spans") > 0).select("key", "spans"), "contaminated")
    found = found.toDF(f"{helper}_known", f"{helper}_spans")
    rows = docs.select("*", key.alias(f"{helper}_key"))
    same = F.col(f"{helper}_key") == F.col(f"{helper}_known")
    if whole_documents:
        return rows.join(found, same, "left_anti").drop(f"{helper}_key")
    rows = rows.join(found, same, "left").drop(f"{helper}_known", f"{helper}_key")
    parts = _parts(F.col(text_col), F.col(f"{helper}_spans"))
    rows = rows.withColumn(f"{helper}_parts", F.when(F.col(f"{helper}_spans").isNotNull(), parts))
    p = F.col(f"{helper}_parts")
    kept = F.array_join(
        F.transform(
            p,
            lambda x, i: F.concat(
                F.when(x["gone"] & (i > 0) & F.get(p, i - 1)["gone"], "").otherwise(x["gap"]),
                F.when(x["gone"], "").otherwise(x["word"]),
            ),
        ),
        "",
    )
    text = F.when(p.isNull(), F.col(text_col)).otherwise(kept)
    return rows.withColumn(text_col, text).drop(f"{helper}_spans", f"{helper}_parts")
