"""Decaying running sums ``s_i = s_(i-1) * d + x_i`` as window expressions.

Within a block of ``BLOCK`` bars the recurrence has the closed form
``s_k = sum(x_j * d^-j) * d^k``; all terms are non-negative, so nothing cancels,
and ``d^-BLOCK`` stays far from overflow. The sums at the ends of earlier
blocks are folded into a carry, so a series may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def add_blocks(df: DataFrame, position: str, block: int = BLOCK) -> DataFrame:
    """Add ``_block`` and ``_offset``, the place of a bar within its block."""
    at = F.col(position)
    return df.withColumn("_block", F.floor(at / block).cast("int")).withColumn(
        "_offset", (at % block).cast("int")
    )


def add_decayed_sums(
    df: DataFrame, sums: dict[str, Column], decay: float, block: int = BLOCK
) -> DataFrame:
    """Add one column per entry of ``sums`` (name -> addend ``x``), after ``add_blocks``."""
    inside = (
        Window.partitionBy("symbol", "_block")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy("symbol")
        .orderBy("_block", "date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.col("_offset")
    is_last = offset == block - 1
    df = df.select(
        "*",
        *[
            (
                F.sum(x * F.pow(F.lit(1.0 / decay), offset)).over(inside)
                * F.pow(F.lit(decay), offset)
            ).alias(f"_in_{name}")
            for name, x in sums.items()
        ],
    )
    # At most one entry per earlier block: a century of daily bars has nine.
    df = df.select(
        "*",
        *[
            F.collect_list(F.when(is_last, F.col(f"_in_{name}"))).over(earlier).alias(f"_ends_{name}")
            for name in sums
        ],
    )
    fold = decay**block
    carried = {
        name: F.when(F.col("_block") == 0, 0.0).otherwise(
            F.aggregate(f"_ends_{name}", F.lit(0.0), lambda acc, end: acc * fold + end)
        )
        for name in sums
    }
    return df.select(
        "*",
        *[
            (F.col(f"_in_{name}") + carried[name] * F.pow(F.lit(decay), offset + 1)).alias(name)
            for name in sums
        ],
    ).drop(*[f"_in_{name}" for name in sums], *[f"_ends_{name}" for name in sums])
