"""Hard negatives by slots of scores.

A row's score is the inner product of its whole-numbered vector with the anchor's. For each positive of an anchor (its
nearest rows of the same label) the nearest rows of other labels within a range of the positive's score are wanted. The
ranges of an anchor's positives overlap, but their upper limits cut the scores into slots that don't: a row of another
label falls into one slot and is kept if it is among the first ``negatives`` there. Going down from an upper limit, what
lies below it is its own slot followed by the slots beneath, so merging the slots' first rows from the lowest up gives
the first rows below every limit; those under the range's lower limit go last.

Anchors are written once in the shared folder and read by every task in blocks, against the task's own rows: a pair is
scored once, in a matrix product, and is never a row. A task combines before the shuffle: it
sends at most ``positives`` rows an anchor in the first pass, ``negatives`` a slot in the second.

Defined results: rows with a null id or label, or a vector that is null or holds a null or non-finite element, take no part; a
shorter vector is filled up with zeros; an id stands for one row, and of rows that repeat it with different labels or vectors the smallest by
label, then vector, counts; ties go to the smaller id; an anchor without positives, and a positive without negatives in range,
give no rows; an empty table gives none. Scores have to fit 63 bits, else the job fails. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom import storage
from barloom.llm import common, files, vectors

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOWEST, HIGHEST = 50, 95
#: Numbers of a block of rows that a task holds, and scores that it computes at once.
ROW_NUMBERS, SCORES = 4 << 20, 2 << 20
#: Anchors a file, and anchors read at once.
FILE_ANCHORS, READ_ANCHORS = 1 << 15, 1 << 10


class _Rows:
    """Rows in ascending order of ids, so that of equal scores the first column is the smallest id."""

    def __init__(self, ids: list[np.ndarray], labels: list[np.ndarray], numbers: list[np.ndarray]):
        width = max(x.shape[1] for x in numbers)
        ids_, labels_ = np.concatenate(ids), np.concatenate(labels)
        order = np.argsort(ids_, kind="stable")
        self.ids, self.labels = ids_[order], labels_[order]
        self.numbers = np.concatenate([vectors.widened(x, width) for x in numbers])[order]
        self.largest = float(np.abs(self.numbers).max()) if self.numbers.size else 0.0


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[_Rows]:
    """A task's rows, some megabytes at once."""
    ids, labels, numbers, held = [], [], [], 0
    for batch in batches:
        good, values, _ = vectors.usable(batch.column("v"))
        if not good.any():
            continue
        ids.append(batch.column("id").to_numpy(zero_copy_only=False)[good])
        labels.append(batch.column("label").to_numpy(zero_copy_only=False)[good])
        numbers.append(vectors.floors(values, scale))
        held += numbers[-1].size + len(ids[-1])
        if held >= ROW_NUMBERS:
            yield _Rows(ids, labels, numbers)
            ids, labels, numbers, held = [], [], [], 0
    if ids:
        yield _Rows(ids, labels, numbers)


def _anchors(paths: list[str], block: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of the written anchors with their numbers; only one block is held."""
    for path in paths:
        system, inner = files.opened(path)
        with system.open_input_file(inner) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=READ_ANCHORS):
                _, values, _ = vectors.usable(batch.column("v"))
                numbers = vectors.floors(values, scale)
                for at in range(0, batch.num_rows, block):
                    yield batch.slice(at, block), numbers[at : at + block]


def _scores(anchors: np.ndarray, rows: np.ndarray, largest: float) -> np.ndarray:
    """Inner products, exactly: in the narrowest numbers that hold every partial sum."""
    width = min(anchors.shape[1], rows.shape[1])
    bound = width * largest * (float(np.abs(anchors).max()) if anchors.size else 0.0)
    if bound >= 2.0**62:
        raise ValueError("scores of these vectors don't fit a long")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return anchors[:, :width].astype(kind) @ rows[:, :width].astype(kind).T


def _first(group: np.ndarray, score: np.ndarray, column: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each group by falling score, then by column; groups may be in any order."""
    order = np.lexsort((column, -score, group))
    ranked = group[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    rank = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    return order[rank < k]


def _above_kth(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the scores of each row of a matrix are not below its k-th largest."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
        return np.nonzero(scores >= least)
    return np.nonzero(np.ones(scores.shape, bool))


def _positives(rows: DataFrame, paths: list[str], scale: int, k: int) -> DataFrame:
    """``anchor_id, positive_id, score``: at most the first ``k`` of an anchor's label from each block of rows."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, scale):
            by_label = {x: np.flatnonzero(held.labels == x) for x in np.unique(held.labels).tolist()}
            for anchors, numbers in _anchors(paths, max(1, SCORES // len(held.ids)), scale):
                ids, labels = (anchors.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                for label in np.unique(labels).tolist():
                    if label not in by_label:
                        continue
                    mine, columns = np.flatnonzero(labels == label), by_label[label]
                    scores = _scores(numbers[mine], held.numbers[columns], held.largest)
                    # One more than wanted, as the anchor itself may be among them.
                    row, at = _above_kth(scores, k + 1)
                    other = held.ids[columns[at]] != ids[mine[row]]
                    row, at = row[other], at[other]
                    kept = _first(row, scores[row, at], at, k)
                    row, at = row[kept], at[kept]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[mine[row]]), pa.array(held.ids[columns[at]]), pa.array(scores[row, at].astype(np.int64))],
                        names=["anchor_id", "positive_id", "score"],
                    )

    found = rows.select("id", "label", "v").mapInArrow(nearest, "anchor_id long, positive_id long, score long")
    return _first_rows(found, k, "positive_id", "anchor_id")


def _first_rows(df: DataFrame, k: int, tie: str, *group: str) -> DataFrame:
    """The first ``k`` rows of each group by falling score; Spark keeps ``k`` a group before its shuffle, too."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), tie)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _slotted(rows: DataFrame, paths: list[str], scale: int, k: int) -> DataFrame:
    """``anchor_id, slot, negative_id, score``: at most the first ``k`` of a slot from each block of rows."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, scale):
            for anchors, numbers in _anchors(paths, max(1, SCORES // len(held.ids)), scale):
                ids, labels, lowest = (anchors.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "lowest"))
                limits = [np.array(x, np.int64) for x in anchors.column("limits").to_pylist()]
                scores = _scores(numbers, held.numbers, held.largest)
                tops = np.array([x[0] for x in limits]).astype(scores.dtype)
                wanted = (scores <= tops[:, None]) & (scores >= lowest.astype(scores.dtype)[:, None]) & (labels[:, None] != held.labels)
                row, at = np.nonzero(wanted)
                score = scores[row, at].astype(np.int64)
                # Slot i holds scores above limit i + 1 and up to limit i; limits fall.
                slot = np.zeros(len(row), np.int64)
                ends = np.searchsorted(row, np.arange(len(ids) + 1))
                for a, limit in enumerate(limits):
                    part = slice(ends[a], ends[a + 1])
                    slot[part] = len(limit) - 1 - np.searchsorted(limit[::-1], score[part], side="left")
                kept = _first(row * (max(map(len, limits), default=0) + 1) + slot, score, at, k)
                row, at = row[kept], at[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(slot[kept], pa.int32()), pa.array(held.ids[at]), pa.array(score[kept])],
                    names=["anchor_id", "slot", "negative_id", "score"],
                )

    found = rows.select("id", "label", "v").mapInArrow(nearest, "anchor_id long, slot int, negative_id long, score long")
    return _first_rows(found, k, "negative_id", "anchor_id", "slot")


def _written(anchors: DataFrame, n: int, name: str) -> tuple[DataFrame, list[str]]:
    """Anchors in files of bounded size in the shared folder, and the files' names."""
    stored = storage.materialize(anchors.repartition(-(-max(n, 1) // FILE_ANCHORS)), name)
    return stored, sorted(stored.inputFiles())


def _percent(score: Column, percent: int, up: bool) -> Column:
    """``percent`` of a score, rounded up or down; no step leaves the range of a long."""
    rest = F.pmod(score, F.lit(100))
    hundreds = F.call_function("div", score - rest, F.lit(100))
    return hundreds * percent + F.call_function("div", rest * percent + (99 if up else 0), F.lit(100))


def _usable(df: DataFrame, id_col: str, label_col: str, vector_col: str, is_anchor: Column) -> DataFrame:
    """``id, label, v, is_anchor`` of the rows that take part, one an id."""
    named = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    infinite = F.lit(float("inf"))
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    rows = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~broken)
    if not rows.groupBy("id").count().where("count > 1").head(1):
        return rows
    first = rows.groupBy("id").agg(F.min(F.struct("label", "v", "is_anchor")).alias("first"))
    return storage.materialize(first.select("id", "first.*"), "usable")


def mine(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels whose score is at least ``lowest`` and at most ``highest`` percent of the positive's. ``is_anchor`` is a
    condition on the columns of ``df``.
    """
    common.bounded_batches(df.sparkSession)
    rows = _usable(df, id_col, label_col, vector_col, is_anchor)
    chosen = rows.where("is_anchor").select("id", "label", "v")
    n = chosen.count()
    anchors, paths = _written(chosen, n, "anchors")
    found = _positives(rows, paths, scale, positives)
    low, high = _percent(F.col("score"), lowest, up=True), _percent(F.col("score"), highest, up=False)
    # A negative score has no range below it.
    ranged = found.withColumns({"low": low, "high": high}).where(F.col("low") <= F.col("high"))
    wanted = ranged.groupBy("anchor_id").agg(
        F.collect_list(F.struct("positive_id", "score", "low", "high")).alias("wanted"),
        F.reverse(F.array_sort(F.collect_set("high"))).alias("limits"),
        F.min("low").alias("lowest"),
    )
    wanted = storage.materialize(wanted, "positives")
    ranges = wanted.select(F.col("anchor_id").alias("id"), "limits", "lowest")
    _, ranged_paths = _written(anchors.join(ranges, "id"), n, "ranges")
    entry = F.struct("slot", (-F.col("score")).alias("down"), "negative_id")
    kept = _slotted(rows, ranged_paths, scale, negatives).groupBy("anchor_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    both = wanted.join(kept, "anchor_id")
    none = F.array().cast("array<struct<slot:int,down:bigint,negative_id:bigint>>")

    def merged(below: Column, slot: Column) -> Column:
        """The first rows of a slot and all slots beneath it, before those of the slots beneath."""
        own = F.filter("entries", lambda e: e["slot"] == slot)
        return F.concat(F.array(F.slice(F.concat(own, F.coalesce(F.get(below, F.lit(0)), none)), 1, negatives)), below)

    upward = F.reverse(F.sequence(F.lit(0), F.size("limits") - 1))
    below = F.aggregate(upward, F.array().cast("array<array<struct<slot:int,down:bigint,negative_id:bigint>>>"), merged)
    each = both.select("anchor_id", "limits", below.alias("below"), F.explode("wanted").alias("w"))
    first = F.get("below", (F.array_position("limits", F.col("w.high")) - 1).cast("int"))
    listed = each.select("anchor_id", "w", F.posexplode(first).alias("at", "e")).where(-F.col("e.down") >= F.col("w.low"))
    return listed.select(
        "anchor_id",
        F.col("w.positive_id").alias("positive_id"),
        (F.col("at") + 1).alias("rank"),
        F.col("e.negative_id").alias("negative_id"),
        F.col("w.score").alias("positive_score"),
        (-F.col("e.down")).alias("negative_score"),
    )
