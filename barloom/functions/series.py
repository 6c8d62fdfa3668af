"""Windows over one symbol's bars.

A series holds at most one bar per day (``operators.ingest.one_bar_per_day``
enforces it with a map-side-combined aggregate), so a window partition is
bounded by the calendar - about 36,500 rows a century - however many raw rows
a hot symbol has. All windows below share the ``symbol`` partitioning, so any
number of series operators costs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series(*within: str) -> WindowSpec:
    """A symbol's bars; ``within`` names columns that cut them into separate series."""
    return Window.partitionBy("symbol", *within).orderBy("date")


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(n: int, *within: str) -> WindowSpec:
    """The current bar and the ``n - 1`` before it."""
    return series(*within).rowsBetween(1 - n, 0)


def with_gathered(df: DataFrame, columns: dict[str, tuple[Column, int]], *within: str) -> DataFrame:
    """Add arrays (name -> array column, number of bars): the arrays of the last ``n`` bars, one after the other.

    A NULL within an array keeps its place; where there are fewer than ``n`` bars the result is NULL.
    Short spans are put together into longer ones, and those into the whole, so a bar looks back about
    ``3 * n ** (1/3)`` times instead of visiting ``n`` bars.
    """
    width = max(1, round(max(n for _, n in columns.values()) ** (1 / 3)))
    df = df.withColumns({f"_1_{name}": unit for name, (unit, _) in columns.items()})
    sizes = [1]
    while width > 1 and len(sizes) < 3:
        size = sizes[-1]
        longer = {
            f"_{size * width}_{name}": F.concat(*(previous(f"_{size}_{name}", k * size, *within) for k in range(width - 1, 0, -1)), f"_{size}_{name}")
            for name in columns
        }
        df = df.withColumns(longer)
        sizes.append(size * width)

    def whole(name: str, n: int) -> Column:
        parts, behind = [], 0
        for size in reversed(sizes):
            while n - behind >= size:
                parts.append(previous(f"_{size}_{name}", behind, *within) if behind else F.col(f"_{size}_{name}"))
                behind += size
        return F.concat(*reversed(parts))

    held = [f"_{size}_{name}" for size in sizes for name in columns]
    return df.withColumns({name: whole(name, n) for name, (_, n) in columns.items()}).drop(*held)


def position(*within: str) -> Column:
    """0-based position of the bar in its series."""
    return F.row_number().over(series(*within)) - 1


def length() -> Column:
    """Number of bars in the series (ordered frame, so it shares the other windows' node)."""
    frame = series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.count(F.lit(1)).over(frame)


def previous(name: str, n: int = 1, *within: str) -> Column:
    return F.lag(name, n).over(series(*within))


def following(name: str, n: int = 1, *within: str) -> Column:
    return F.lead(name, n).over(series(*within))


def change(name: str, n: int = 1, *within: str) -> Column:
    """Ratio to the value ``n`` bars back; NULL before there is one."""
    return F.try_divide(F.col(name), previous(name, n, *within))
