"""Column names and fixed schemas, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

SERIES_KEY = ["symbol", "date"]
PRICES = ["open", "high", "low", "close"]
BAR_VALUES = [*PRICES, "volume", "adjclose"]

BAR = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(name, T.DoubleType()) for name in BAR_VALUES]
)

# One daily feed line: the symbol is not part of it.
FEED_FIELDS = ["Date", "Open", "High", "Low", "Close", "Volume", "AdjClose"]

UNIVERSE = T.StructType(
    [T.StructField(name, T.StringType()) for name in ["ticker", "code", "name", "sector"]]
)

CANDIDATE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("max_date", T.DateType()),
        T.StructField("min_date", T.DateType()),
    ]
)

AVERAGE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("window", T.IntegerType()),
        T.StructField("close_mat", T.DoubleType()),
    ]
)

DIRECTIONAL_VALUES = [
    "tr", "pdm1", "mdm1", "tr14", "pdm14", "mdm14",
    "pdi14", "mdi14", "di14diff", "di14sum", "dx", "adx",
]

DIRECTIONAL = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(name, T.DoubleType()) for name in DIRECTIONAL_VALUES]
)

LEDGER = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("mat1", T.DoubleType()),
        T.StructField("mat2", T.DoubleType()),
        T.StructField("signal", T.IntegerType()),
        T.StructField("cash", T.DoubleType()),
        T.StructField("stock", T.DoubleType()),
        T.StructField("net", T.DoubleType()),
    ]
)
