"""Exact dedup by sorting contents.

Texts, lower-cased in A-Z only, are dealt by sampled splitters into ranges (a range partition)
and sorted within, by their first bytes, a hash and then the whole text, spilling to disk where
they don't fit. Equal texts are then neighbours and found by full comparison of each text with
the one before it. The splitters have the first bytes, the hash and the id, so a group of copies of any size is spread over as many partitions as its rows
need; the two outer runs of each partition are joined up afterwards, a row or two a partition.

Defined results: a null text is an empty one; of equal texts one row stays, the one with the
smallest (or largest) id, one with a null id only where all are null; of rows with that id too,
one is ``kept``; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import storage
from barloom.llm import common

#: Bytes of a text that a splitter holds.
HEAD = 64

_RUNS = "doc_id long, text_sha256 string, part int, run long, size long, low long, high long, nth long, outer boolean"
_NAMES = ["doc_id", "text_sha256", "part", "run", "size", "low", "high", "nth", "outer"]
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the run of equal texts they are in; of an open run only its ids are held."""
    part, run, last, ids = TaskContext.get().partitionId(), 0, None, []

    def closed(outer: bool) -> pa.RecordBatch:
        keys = pa.concat_arrays(ids)
        n, digest = len(keys), hashlib.sha256(last).hexdigest()
        bounds = pc.min_max(keys)
        columns = [keys, [digest] * n, [part] * n, [run] * n, [n] * n, [bounds["min"].as_py()] * n, [bounds["max"].as_py()] * n, list(range(n)), [outer] * n]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    made: list[pa.RecordBatch] = []
    for batch in batches:
        texts, keys = batch.column("text"), batch.column("doc_id")
        if not len(texts):
            continue
        new = np.ones(len(texts), bool)
        new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or texts[0].as_py() != last
        cuts = [*np.flatnonzero(new).tolist(), len(texts)]
        if cuts[0]:
            ids.append(keys.slice(0, cuts[0]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None:
                made.append(closed(run == 0))
                run += 1
            last, ids = texts[a].as_py(), [keys.slice(a, b - a)]
        if len(made) >= 500:
            yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
            made = []
    if last is not None:
        made.append(closed(True))
    if made:
        yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]


def _joined_up(outer: list) -> list[tuple[int, int, int, int | None, int | None, int]]:
    """Outer runs in order, with size and bounds of the whole run, and the rows of it in partitions before."""
    groups: list[list] = []
    for row in sorted(outer, key=lambda r: (r.part, r.run)):
        # Runs of one partition differ; a run goes on only from the last run of the partition before.
        if groups and groups[-1][-1].text_sha256 == row.text_sha256 and groups[-1][-1].part != row.part:
            groups[-1].append(row)
        else:
            groups.append([row])
    out = []
    for rows in groups:
        size = sum(r.size for r in rows)
        low = min((r.low for r in rows if r.low is not None), default=None)
        high = max((r.high for r in rows if r.high is not None), default=None)
        before = 0
        for r in rows:
            out.append((r.part, r.run, size, low, high, before))
            before += r.size
    return out


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """A row a document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of the normalised text."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    spark = df.sparkSession
    common.bounded_batches(spark)
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), lower.cast("binary").alias("text"))
    # Null ids stand where they are not the row that stays.
    by_id = F.asc_nulls_last("doc_id") if keep == "smallest" else F.asc_nulls_first("doc_id")
    # The splitters compare the first bytes and a hash of the rest, so that a sample of them is small in the driver.
    order = [F.asc("head"), F.asc("hash")]
    rows = rows.withColumns({"head": F.substring("text", 1, HEAD), "hash": F.xxhash64("text")})
    ordered = rows.repartitionByRange(*order, by_id).sortWithinPartitions(*order, F.asc("text"), by_id).select("doc_id", "text")
    runs = storage.materialize(ordered.mapInArrow(_runs, _RUNS), "content_runs")
    # Two rows a partition at most.
    outer = (
        runs.where("outer").groupBy("part", "run").agg(*(F.any_value(c).alias(c) for c in ("text_sha256", "size", "low", "high"))).collect()
    )
    whole = spark.createDataFrame(_joined_up(outer), "part int, run long, all_size long, all_low long, all_high long, before long")
    joined = runs.join(F.broadcast(whole), ["part", "run"], "left")
    size, low, high = (F.when(F.col("all_size").isNull(), F.col(c)).otherwise(F.col(f"all_{c}")) for c in ("size", "low", "high"))
    place = F.col("nth") + F.coalesce("before", F.lit(0))
    first, keep_id = (place == 0, low) if keep == "smallest" else (place == size - 1, high)
    return joined.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), first.alias("kept"), "text_sha256")
