"""Small bar tables and plain loops to compare with."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import DataFrame, SparkSession

from barloom.schemas import BAR

START = datetime.date(1990, 1, 1)


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def random_walk(symbol: str, n: int, seed: int = 0, start: datetime.date = START) -> list[dict]:
    """``n`` daily bars with closes that wander and high >= low."""
    rng = random.Random(f"{symbol}{seed}")
    close, rows = 100.0, []
    for i in range(n):
        opened = close
        close = max(1.0, close * rng.uniform(0.95, 1.055))
        rows.append(
            {
                "symbol": symbol,
                "date": start + datetime.timedelta(days=i),
                "open": opened,
                "high": max(opened, close) * rng.uniform(1.0, 1.02),
                "low": min(opened, close) * rng.uniform(0.98, 1.0),
                "close": close,
                "volume": float(rng.randint(0, 1000)),
                "adjclose": close * 0.9,
            }
        )
    return rows


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    shuffled = random.Random(7).sample(rows, len(rows))
    values = [tuple(row.get(f.name) for f in BAR.fields) for row in shuffled]
    return spark.createDataFrame(values, BAR)


def by_key(df: DataFrame) -> dict:
    return {(r["symbol"], r["date"]): r.asDict() for r in df.collect()}
