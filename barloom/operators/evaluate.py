"""Prediction enrichment and precision."""

from __future__ import annotations

import datetime
from bisect import bisect_left
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schemas import SERIES_KEY


COUNTS = ["acc", "acc2", "all"]


class Cell(NamedTuple):
    """One cell of a precision sweep: a probability threshold and a half-open period."""

    threshold: float
    start: datetime.date
    end: datetime.date


def _opens(benchmark: DataFrame) -> DataFrame:
    """Benchmark open per date: at most one row a day, so it may be broadcast."""
    return benchmark.groupBy("date").agg(F.max("open").alias("spxopen"))


def _with_opens(predictions: DataFrame, benchmark: DataFrame) -> DataFrame:
    opens = _opens(benchmark)
    for date, name in [("date2", "spxopen1"), ("date3", "spxopen2")]:
        day = opens.select(F.col("date").alias(date), F.col("spxopen").alias(name))
        predictions = predictions.join(F.broadcast(day), date, "left")
    return predictions


def looked_up(predictions: DataFrame, prices: DataFrame, values: list[str]) -> DataFrame:
    """Predictions with ``<value>1`` at ``date2`` and ``<value>2`` at ``date3``; NULL where there is no price.

    A prediction becomes two look-ups of (symbol, date), which meet the prices in one join and
    are folded back in one aggregate. Equal predictions are counted before and repeated after it.
    """
    key = predictions.columns
    counted = predictions.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.col("date2").alias("date")),
        F.struct(F.lit(2).alias("side"), F.col("date3").alias("date")),
    )
    asked = counted.withColumn("_at", F.explode(sides)).withColumns({"_date": F.col("_at.date"), "_side": F.col("_at.side")}).drop("_at")
    known = prices.select(F.col("symbol").alias("_symbol"), F.col("date").alias("_day"), *[F.col(v).alias(f"_{v}") for v in values])
    found = asked.join(known, (asked["symbol"] == known["_symbol"]) & (asked["_date"] == known["_day"]), "left")
    folded = found.groupBy(*key, "_copies").agg(
        *[F.max(F.when(F.col("_side") == side, F.col(f"_{v}"))).alias(f"{v}{side}") for v in values for side in (1, 2)]
    )
    return folded.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copy", "_copies")


def with_prices(predictions: DataFrame, bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Close and benchmark open at anchor and label date."""
    asked = predictions.select("symbol", "date1", "date2", "date3", "act_diff", "prob", "label")
    return _with_opens(looked_up(asked, bars, ["close"]), benchmark).select(
        "symbol",
        "date1",
        "date2",
        "date3",
        "close1",
        "spxopen1",
        "close2",
        "spxopen2",
        "act_diff",
        "prob",
        "label",
    )


def enrich(
    predictions: DataFrame,
    bars: DataFrame,
    relative: DataFrame,
    benchmark: DataFrame,
    breadth: DataFrame,
) -> DataFrame:
    """Labelled predictions with adjusted and relative close and benchmark open at
    both dates, and breadth at the label date.

    Adjusted and relative closes are put side by side by an aggregate over their union, and
    the predictions look both dates up in it with one join (``looked_up``). Benchmark and
    breadth are reduced to one row a day and broadcast.
    """
    none = F.lit(None).cast("double")
    adjusted = bars.select(*SERIES_KEY, F.col("adjclose").alias("close"), none.alias("relclose"))
    rel = relative.select(*SERIES_KEY, none.alias("close"), F.col("close").alias("relclose"))
    prices = (
        adjusted.unionByName(rel)
        .groupBy(*SERIES_KEY)
        .agg(F.max("close").alias("close"), F.max("relclose").alias("relclose"))
    )
    labelled = predictions.where(F.col("is_labeled") == 1)
    asked = labelled.select("symbol", "date1", "date2", "date3", "prob", "label", "act_diff")
    joined = looked_up(asked, prices, ["close", "relclose"])
    days = breadth.groupBy(F.col("date").alias("date3")).agg(
        F.max("pos").alias("num_pos"), F.max("neg").alias("num_neg")
    )
    return (
        _with_opens(joined, benchmark)
        .join(F.broadcast(days), "date3", "left")
        .select(
            "symbol",
            "date1",
            "date2",
            "date3",
            "prob",
            "label",
            "act_diff",
            "relclose1",
            "relclose2",
            "spxopen1",
            "spxopen2",
            "close1",
            "close2",
            "num_pos",
            "num_neg",
        )
    )


def label_violations(enriched: DataFrame) -> DataFrame:
    """One row: predictions labelled 1 although the relative close fell. Should be 0."""
    wrong = (F.col("label") == 1) & (F.col("relclose2") < F.col("relclose1"))
    return enriched.agg(F.count_if(wrong).alias("violations"))


def _cells(cells: Sequence[Cell]) -> Column:
    """The cells as a literal array of structs, in the order given."""
    rows = ", ".join(
        f"named_struct('threshold', {c.threshold}D, 'start', DATE '{c.start}', 'end', DATE '{c.end}')"
        for c in cells
    )
    return F.expr(f"array({rows})")


def precision_sweep(
    enriched: DataFrame, cells: Sequence[Cell], buffer1: float = 1.0, buffer2: float = 1.0
) -> DataFrame:
    """Precision per cell, next to that of all predictions of the same period.

    One pass over the predictions: each row goes to the cells it falls in and is
    counted there before the shuffle, so what is shuffled is one row per cell and
    task. Cells without predictions have zero counts and precisions.
    """
    wanted = list(dict.fromkeys([*cells, *[Cell(0.0, c.start, c.end) for c in cells]]))
    falls_in = F.filter(
        _cells(wanted),
        lambda c: (F.col("prob") >= c["threshold"])
        & (F.col("date2") >= c["start"])
        & (F.col("date2") < c["end"]),
    )
    key = ["threshold", "start", "end"]
    counted = (
        enriched.select(
            "act_diff", "close1", "close2", F.explode(falls_in).alias("cell")
        )
        .groupBy(*[F.col(f"cell.{name}").alias(name) for name in key])
        .agg(
            F.count_if(F.col("act_diff") >= buffer1).alias("acc"),
            F.count_if(F.try_divide("close2", "close1") >= buffer2).alias("acc2"),
            F.count(F.lit(1)).alias("all"),
        )
    )
    counts = COUNTS
    # One row per cell from here on. The cell with threshold 0 counts its whole period.
    period = Window.partitionBy("start", "end")
    with_base = counted.withColumns(
        {
            f"base_{name}": F.max(F.when(F.col("threshold") == 0, F.col(name))).over(period)
            for name in counts
        }
    )
    grid = enriched.sparkSession.range(1).select(F.inline(_cells(cells)))
    joined = grid.join(F.broadcast(with_base), key, "left").fillna(
        0, [*counts, *[f"base_{name}" for name in counts]]
    )

    return _with_shares(joined)


def _with_shares(counted: DataFrame) -> DataFrame:
    """Cells with their counts and those of their period, and the precisions."""

    def share(part: str, whole: str) -> Column:
        ratio = F.try_divide(F.col(part).cast("double"), F.col(whole))
        return F.when(F.col("all") > 0, ratio).otherwise(0.0)

    return counted.select(
        "threshold",
        "start",
        "end",
        *COUNTS,
        share("acc", "all").alias("precision"),
        share("base_acc", "base_all").alias("base_precision"),
        share("acc2", "all").alias("precision2"),
        share("base_acc2", "base_all").alias("base_precision2"),
    )


def precision_grid(
    enriched: DataFrame, cells: Sequence[Cell], buffer1: float = 1.0, buffer2: float = 1.0
) -> DataFrame:
    """``precision_sweep`` for thousands of cells: a prediction is counted once, whatever their number.

    A prediction is ranked among the thresholds and among the ends of the periods, by binary search, and
    counted for its two ranks before the shuffle. From there on everything is as large as the list of cells:
    sums over both ranks make the count of a cell the difference of two of them.
    """
    spark = enriched.sparkSession
    thresholds = sorted({0.0, *(c.threshold for c in cells)})
    epoch = datetime.date(1970, 1, 1)
    days = sorted({day for c in cells for day in (c.start, c.end)}) or [epoch]
    numbered = enriched.where(F.col("prob").isNotNull() & F.col("date2").isNotNull()).select(
        F.col("prob").cast("double").alias("prob"),
        F.unix_date("date2").cast("double").alias("day"),
        (F.col("act_diff") >= buffer1).alias("right"),
        (F.try_divide("close2", "close1") >= buffer2).alias("right2"),
    )
    ranked = numbered
    for name, rank, ends in (("prob", "t", thresholds), ("day", "d", [float((x - epoch).days) for x in days])):
        splits = [-float("inf"), *ends, float("inf")]
        ranked = Bucketizer(splits=splits, inputCol=name, outputCol=rank, handleInvalid="keep").transform(ranked)
    # Not-a-number counts as larger than every threshold, as in comparisons.
    whole = [F.least(F.col(rank), F.lit(float(n))).cast("int").alias(rank) for rank, n in (("t", len(thresholds)), ("d", len(days)))]
    counted = (
        ranked.select(*whole, "right", "right2")
        .groupBy("t", "d")
        .agg(F.count_if("right").alias("acc"), F.count_if("right2").alias("acc2"), F.count(F.lit(1)).alias("all"))
    )
    ranks = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))).alias("t"))
    ranks = ranks.select("t", F.explode(F.sequence(F.lit(1), F.lit(len(days)))).alias("d"))
    filled = ranks.join(counted, ["t", "d"], "left").fillna(0, COUNTS)
    higher = Window.partitionBy("d").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("t").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = filled.withColumns({c: F.sum(c).over(higher) for c in COUNTS}).withColumns({c: F.sum(c).over(earlier) for c in COUNTS})

    def looked_at(cell: Cell) -> list[tuple[int, int, str, int]]:
        """The sums that a cell and its whole period are made of: rank of threshold, rank of day, for what, sign."""
        first, last = bisect_left(days, cell.start) + 1, bisect_left(days, cell.end) + 1
        rank = {name: bisect_left(thresholds, t) + 1 for name, t in (("own", cell.threshold), ("base", 0.0))}
        if last <= first:
            return []
        return [(rank[name], d, name, sign) for name in rank for d, sign in ((last - 1, 1), (first - 1, -1)) if d]

    wanted = [(*c, looked_at(c)) for c in dict.fromkeys(cells)]
    kind = "threshold double, start date, end date, looked array<struct<t:int,d:int,what:string,sign:int>>"
    table = spark.createDataFrame([(float(t), a, b, looked) for t, a, b, looked in wanted], kind)
    each = table.select("threshold", "start", "end", F.explode_outer("looked").alias("l")).select("threshold", "start", "end", "l.*")
    met = each.join(sums, ["t", "d"], "left")
    totals = [
        F.coalesce(F.sum(F.when(F.col("what") == what, F.col("sign") * F.col(c))), F.lit(0)).alias(prefix + c)
        for what, prefix in (("own", ""), ("base", "base_"))
        for c in COUNTS
    ]
    return _with_shares(met.groupBy("threshold", "start", "end").agg(*totals))


def top_predictions(predictions: DataFrame, score: str, k: int, *tie_break: str) -> DataFrame:
    """The ``k`` highest scores."""
    return predictions.orderBy(F.desc(score), *tie_break).limit(k)


def bottom_predictions(predictions: DataFrame, score: str, k: int, *tie_break: str) -> DataFrame:
    """The ``k`` lowest scores."""
    return predictions.orderBy(F.asc(score), *tie_break).limit(k)


def both_ends(predictions: DataFrame, score: str, k: int, *tie_break: str) -> DataFrame:
    """The ``k`` highest and lowest scores, with ``end`` ``top`` or ``bottom``; give it a stored table."""
    best = top_predictions(predictions, score, k, *tie_break).withColumn("end", F.lit("top"))
    worst = bottom_predictions(predictions, score, k, *tie_break).withColumn("end", F.lit("bottom"))
    return best.unionByName(worst)


def open_predictions(predictions: DataFrame, date: datetime.date | Column) -> DataFrame:
    """Predictions anchored at ``date`` whose label is not known yet, best first."""
    current = F.col("date2") == (date if isinstance(date, Column) else F.lit(date))
    return predictions.where((F.col("is_labeled") == 0) & current).orderBy(F.desc("prob"), "symbol")


def squared_errors(predictions: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row: mean squared error of the prediction, and of always predicting 1.0."""
    return predictions.agg(
        F.avg(F.pow(F.col("label") - F.col(prediction), 2)).alias("mse"),
        F.avg(F.pow(F.col("label") - 1.0, 2)).alias("naive_mse"),
    )
