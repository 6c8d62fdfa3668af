"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids (with an end id) are cut into whole pieces of ``length`` ids and a rest. Whole
pieces fill a sequence each. Rests are dealt by a hash into groups of about ``group_docs``
documents; in each group the rests go, longest first, into the first sequence with room, which
a tournament tree over the capacities finds in logarithmic time. A sequence that stays
emptier than ``slack`` allows is cut at powers of two, where no padding is needed.
Groups are independent and bounded, so work and memory per task do not grow with the corpus;
whole pieces are spread over all groups one by one, so one very long text loads no single task, and rows that
repeat id and text are dealt out like others.

Defined results: a null or empty text is its end id alone; every row is packed, repeated rows
and ids too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.tokens import encoder

GROUP_DOCS = 1024
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
_PIECE = "grp long, doc_id long, start long, doc_tokens long, ids binary"


class Tournament:
    """Capacities of bins as leaves; an inner node has the larger capacity of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it; the bin's number."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes``, which are in descending order."""
    tree = Tournament(max(1, len(sizes)), capacity)
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        k = tree.first_fit(size)
        if k == len(bins):
            bins.append([])
        bins[k].append(i)
    return bins


def cut_at_powers(pieces: list[tuple[int, int, int]], length: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """A sequence of (piece, from, to) as it is if its gap is at most ``slack``, else cut so that each part is a power of two."""
    held = sum(b - a for _, a, b in pieces)
    if length - held <= slack or held & (held - 1) == 0:
        return [pieces]
    out, rest = [], list(pieces)
    while held:
        room = 1 << (held.bit_length() - 1)
        held -= room
        part = []
        while room:
            piece, a, b = rest.pop(0)
            part.append((piece, a, min(b, a + room)))
            if b - a > room:
                rest.insert(0, (piece, a + room, b))
            room -= part[-1][2] - a
        out.append(part)
    return out


def pack(
    df: DataFrame, tokenizer: str, end_id: int, length: int = 2048, group_docs: int = GROUP_DOCS, slack: int = 32,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row a piece: its ids (little-endian, 32 bits), its sequence and its offset there, gapless from 0."""
    spark = df.sparkSession
    common.bounded_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    groups = max(1, math.ceil(rows.count() / group_docs))
    # The number of the row in its partition deals out rows that are equal in id and text, too.
    rows = rows.withColumn("deal", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = encoder(tokenizer).encode(common.filled(part.column("text")).to_pylist())
                keys, deals = part.column("doc_id").to_pylist(), part.column("deal").to_pylist()
                out: list[list] = [[], [], [], [], []]
                for key, deal, ids in zip(keys, deals, found, strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    for start in range(0, len(ids), length):
                        cut = ids[start : start + length]
                        for column, value in zip(out, ((deal + (start // length if len(cut) == length else 0)) % groups, key, start, len(ids), cut.tobytes()), strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["grp", "doc_id", "start", "doc_tokens", "ids"])

    def group(key: tuple, table: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        table = table.combine_chunks()
        docs, starts, whole, ids = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), docs[i] is not None, docs[i] or 0, starts[i], ids[i]))
        bins = first_fit_decreasing([len(ids[i]) // 4 for i in order], length)
        out: list[list] = [[], [], [], [], [], [], []]
        number = 0
        for members in bins:
            for sequence in cut_at_powers([(order[m], 0, len(ids[order[m]]) // 4) for m in members], length, slack):
                offset = 0
                for i, a, b in sequence:
                    row = (docs[i], starts[i] + a, b - a, whole[i], ids[i][4 * a : 4 * b], (grp << 32) | number, offset)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    offset += b - a
                number += 1
        types = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return rows.mapInArrow(pieces, _PIECE).groupBy("grp").applyInArrow(group, SCHEMA)
