"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of its lines that aren't blank. Its grams of ``gram`` lines are hashed,
and of each ``window`` grams in a row the smallest is a fingerprint. Such a window spans
``gram + window - 1`` lines, and equal windows choose the same fingerprint, so every run of that many lines
that stands elsewhere as well shares one with it. Positions of a fingerprint are joined with the first
place (by document and line) where it stands in the same window: where other lines follow at the
fingerprint's very first place, a later one that goes on equally is found all the same. Matches of
two documents at one distance are extended in both directions to whole runs, window by window:
a run's next lines are in a window that was matched as well, so no lines are compared twice and
no document is sent to another.

The lines of all runs are deleted. What a line repeats is always earlier, so one copy of everything
stays. A line of ``long_words`` words or more is a run by itself, between other neighbours or as a
whole document. None leaves long lines to the windows.

The result doesn't depend on what winnowing chooses: exactly the lines go that stand in a run of
``gram + window - 1`` lines (two, as given), or are long, and that stood earlier.

First places are found by an aggregation that combines before the shuffle, and positions join
first places, not each other: a run that a third of all documents share costs one row for each
place, and a document's rows are bounded by its lines.

Defined results: a null text is an empty one without lines; blank lines are never deleted nor
compared; documents of one id and text are one document for the comparison and lose the
same lines; a null id comes first; an empty table gives no rows. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import storage

GRAM, WINDOW = 1, 2
#: Words from which a line counts as a passage of its own.
LONG_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that may be broadcast after a check of the size; what is larger is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def short_hash(text: Column) -> Column:
    """60 bits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _document(id_col: str, text_col: str) -> Column:
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("md5"))


def _sized(df: DataFrame, bytes_: Column) -> DataFrame:
    """``df``, to be broadcast if it is small."""
    size = df.agg(F.sum(bytes_)).head()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _fingerprints(lines: DataFrame, gram: int, window: int) -> DataFrame:
    """A row for each window and each long line: ``gram_hash``, ``run_hash``, ``size`` (in lines), ``doc``, ``at`` (its first line, from 0)."""
    run = gram + window - 1

    def chosen(start: Column) -> Column:
        """The smallest gram of the window that begins at ``start`` (from 1), and all lines of the window."""
        smallest = F.array_min(F.slice("grams", start, window))
        return F.struct(smallest.alias("gram_hash"), F.xxhash64(F.slice("hashes", start, run)).alias("run_hash"), F.lit(run).alias("size"), (start - 1).alias("at"))

    windows = F.when(F.size("hashes") >= run, F.transform(F.sequence(F.lit(1), F.size("hashes") - run + 1), chosen)).otherwise(F.array())
    long = F.transform("long", lambda x: F.struct(x["h"].alias("gram_hash"), F.element_at("hashes", x["at"] + 1).alias("run_hash"), F.lit(1).alias("size"), x["at"].alias("at")))
    return lines.select("doc", F.explode(F.concat(windows, long)).alias("x")).select("x.gram_hash", "x.run_hash", "x.size", "doc", "x.at")


def repeated_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """``doc`` (id and text's MD5), ``source`` (the earlier document), ``shift`` (lines further on than there) and ``runs``: first and last lines, from 0, blank ones not counted."""
    run = gram + window - 1
    filled = F.filter(split_lines(text_col), lambda x: F.trim(x) != "")

    def long_line(line: Column, at: Column) -> Column:
        # A line of fewer characters than that many words and the blanks between them needn't be searched.
        enough = (F.length(line) >= 2 * long_words - 1) & (F.regexp_count(line, F.lit(WORD)) >= long_words)
        return F.when(enough, F.struct(at.alias("at"), F.xxhash64(line).alias("h")))

    none = F.array().cast("array<struct<at:int,h:bigint>>")
    texts = df.select(_document(id_col, text_col).alias("doc"), filled.alias("x"))
    hashed = texts.select(
        "doc",
        F.transform("x", short_hash).alias("hashes"),
        F.when(F.size("x") >= gram, F.transform(F.sequence(F.lit(1), F.size("x") - gram + 1), lambda i: F.xxhash64(F.slice("x", i, gram)))).otherwise(F.array()).alias("grams"),
        (none if long_words is None else F.filter(F.transform("x", long_line), lambda y: y.isNotNull())).alias("long"),
    )
    lines = hashed.where((F.size("hashes") >= run) | (F.size("long") > 0)).dropDuplicates(["doc"])
    prints = storage.materialize(_fingerprints(storage.materialize(lines, "lines"), gram, window), "fingerprints")

    key = ["gram_hash", "run_hash", "size"]
    first = prints.groupBy(*key).agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    matches = prints.join(first.drop("n"), key).where(F.struct("doc", "at") != F.col("first"))
    matches = matches.select("doc", F.col("first.doc").alias("source"), (F.col("at") - F.col("first.at")).alias("shift"), "size", "at")
    aligned = matches.repartition("doc").groupBy("doc", "source", "shift", "size").agg(F.sort_array(F.collect_list("at")).alias("at"))
    lows = F.array_except("at", F.transform("at", lambda i: i + 1))
    highs = F.array_except("at", F.transform("at", lambda i: i - 1))
    extended = F.zip_with(lows, highs, lambda a, b: F.struct(a.alias("low"), (b + F.col("size") - 1).alias("high")))
    return aligned.select("doc", "source", "shift", extended.alias("runs"))


def repeated_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """``doc`` (id and text's MD5) and ``deleted``: the lines to delete, from 0, blank ones not counted."""
    runs = repeated_runs(df, id_col, text_col, gram, window, long_words)
    spans = F.flatten(F.collect_list("runs"))
    return runs.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.transform(spans, lambda r: F.sequence(r["low"], r["high"]))))).alias("deleted"))


def dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """``df`` with the text without its repeated lines, ``n_lines`` (not blank) and ``n_deleted``.

    A null text stays null. Extra columns of the two names give way to the counts.
    """
    deleted = storage.materialize(repeated_lines(df, id_col, text_col, gram, window, long_words), "deleted_lines")
    deleted = deleted.select(F.col("doc").alias("_doc"), F.col("deleted").alias("_deleted"))
    rows = df.drop("n_lines", "n_deleted").withColumn("_doc", _document(id_col, text_col))
    joined = rows.join(_sized(deleted, 4 * F.size("_deleted") + 70), "_doc", "left").withColumn("_lines", split_lines(text_col))
    # Places of the lines that aren't blank. Both columns are used more than once, so they are computed once a row.
    joined = joined.withColumn("_filled", F.filter(F.transform("_lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull()))
    gone = F.transform("_deleted", lambda i: F.get("_filled", i))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return joined.withColumns(
        {
            "n_lines": F.size("_filled"),
            "n_deleted": F.coalesce(F.size("_deleted"), F.lit(0)),
            text_col: F.when(F.col("_deleted").isNull(), F.col(text_col)).otherwise(kept),
        }
    ).drop("_doc", "_deleted", "_lines", "_filled")
