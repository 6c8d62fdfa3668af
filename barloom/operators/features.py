"""Windowed features and forward labels.

Per-bar terms are computed once and gathered over a sliding frame, so a vector
of ``n`` terms does not repeat the arithmetic of its neighbours.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import series as s
from barloom.functions.scalars import round2, whole_part

STRONG_TREND = 30
UNKNOWN = -1.0


def _ratios(bars: DataFrame, window: int, coach: int, *within: str) -> DataFrame:
    """Add the last ``window`` one-bar ratios as ``features`` and the forward ratio ``_ahead``."""
    if window < 2:
        raise ValueError("a feature window needs at least two bars")
    steps = {"_i": s.position(*within), "_step": s.change("close", 1, *within)}
    ahead = F.try_divide(s.following("close", coach, *within), F.col("close"))
    stepped = bars.withColumns({**steps, "_ahead": ahead})
    return s.with_gathered(stepped, {"features": (F.array("_step"), window)}, *within)


def _whole() -> Column:
    """No value of the vector is missing: a zero or NULL close leaves ratios undefined."""
    return ~F.exists("features", lambda x: x.isNull())


def _anchors(rated: DataFrame, window: int) -> DataFrame:
    return rated.where((F.col("_i") >= window) & F.col("_ahead").isNotNull() & _whole())


def lag_ratio_points(bars: DataFrame, window: int, coach: int, *within: str) -> DataFrame:
    """Regression points: ``window`` one-bar ratios and the ratio ``coach`` bars ahead as label.

    Windows and labels stay among the rows they are given; columns named in ``within``
    cut a symbol's bars into separate series (see ``marked_at``). Anchors with an
    undefined ratio in their window are left out, so every vector has ``window`` values.
    """
    return _anchors(_ratios(bars, window, coach, *within), window).select(
        "symbol", "date", F.col("_ahead").alias("label"), "features", *within
    )


def rising_points(bars: DataFrame, window: int, coach: int) -> DataFrame:
    """Classification points: as ``lag_ratio_points``, label 1.0 when the close ahead is higher."""
    rated = _ratios(bars, window, coach).withColumn(
        "_rises", (s.following("close", coach) > F.col("close")).cast("double")
    )
    return _anchors(rated, window).select(
        "symbol", "date", F.col("_rises").alias("label"), "features"
    )


def marked_at(bars: DataFrame, last_train: datetime.date) -> DataFrame:
    """Bars with ``part``, ``train`` up to a date and ``check`` after it."""
    until = F.col("date") <= F.lit(last_train)
    return bars.withColumn("part", F.when(until, "train").otherwise("check"))


def split_at(bars: DataFrame, last_train: datetime.date) -> tuple[DataFrame, DataFrame]:
    """Bars up to and after a date, to be windowed separately."""
    until = F.col("date") <= F.lit(last_train)
    return bars.where(until), bars.where(~until)


def forward_labels(
    mart: DataFrame, window: int, coach: int, threshold: float = 1.0, unlabeled: int = 1
) -> DataFrame:
    """Add ``date1, date2, date3, act_diff, is_labeled, label`` to bars with ``window`` before them.

    ``date3`` is ``coach`` bars ahead. Past the end of the series it is NULL,
    ``act_diff`` is -1.0 and the label is ``unlabeled``.
    """
    labelled = _labelled(mart, window, coach, threshold, unlabeled)
    return labelled.where(F.col("_i") >= window).drop("_i", "volume")


def _labelled(mart: DataFrame, window: int, coach: int, threshold: float, unlabeled: int) -> DataFrame:
    """All bars as ``forward_labels`` gives them, with their place ``_i``."""
    if window < 2:
        raise ValueError("a feature window needs at least two bars")
    ahead = mart.withColumns(
        {
            "_i": s.position(),
            "date1": s.previous("date", window),
            "date2": F.col("date"),
            "date3": s.following("date", coach),
            "_ahead": F.try_divide(s.following("close", coach), F.col("close")),
        }
    )
    known = F.col("date3").isNotNull()
    return ahead.withColumns(
        {
            "act_diff": F.when(known, F.col("_ahead")).otherwise(UNKNOWN),
            "is_labeled": known.cast("int"),
            "label": F.when(known, (F.col("_ahead") >= threshold).cast("int")).otherwise(unlabeled),
        }
    ).drop("_ahead")


def mart_features(mart: DataFrame, window: int, coach: int, threshold: float = 1.0) -> DataFrame:
    """Labelled anchors with ``features`` of length ``4 * window + 3``.

    In order: one-bar ratios, two-bar ratios, pairs of trend flag and directional
    ratio, then average ratio, directional ratio, trend strength and gap-up label
    of the anchor. Anchors with an undefined ratio in their window are left out.
    """
    direction = round2(F.coalesce(F.try_divide("pdi14", "mdi14"), F.lit(0.0)))
    strong = (F.col("adx") > STRONG_TREND) & (F.col("pdi14") > F.col("mdi14"))
    terms = mart.withColumns(
        {
            "_one": round2(s.change("close")),
            "_two": round2(s.change("close", 2)),
            "_direction": direction,
            "_pair": F.array(strong.cast("double"), direction),
            "_strong": strong,
        }
    )
    # Undefined terms are counted along the series, so that no vector needs to be searched for them.
    terms = terms.withColumns(
        {
            "_gaps": F.count_if(F.col("_one").isNull() | F.col("_strong").isNull()).over(s.so_far()),
            "_gaps_two": F.count_if(F.col("_two").isNull()).over(s.so_far()),
        }
    )
    whole = (
        (F.col("_gaps") == s.previous("_gaps", window))
        & (F.col("_gaps_two") == s.previous("_gaps_two", window - 1))
        & F.col("mat_dual").isNotNull()
        & F.col("adx").isNotNull()
    )

    anchor = F.array(
        round2(F.col("mat_dual")),
        F.col("_direction"),
        whole_part(F.col("adx") / STRONG_TREND).cast("double"),
        F.coalesce(F.col("gupbreak").cast("double"), F.lit(0.0)),
    )
    # Dates and labels come first, while the rows are narrow.
    labelled = _labelled(terms.withColumn("_whole", whole), window, coach, threshold, unlabeled=1)
    spans = {"_ones": (F.array("_one"), window), "_twos": (F.array("_two"), window - 1), "_pairs": (F.col("_pair"), window)}
    gathered = s.with_gathered(labelled, spans).where((F.col("_i") >= window) & F.col("_whole"))
    vectors = gathered.withColumn("features", F.concat("_ones", "_twos", "_pairs", anchor))
    kept = [name for name in mart.columns if name != "volume"]
    return vectors.select(*kept, "features", "date1", "date2", "date3", "act_diff", "is_labeled", "label")


def in_span(points: DataFrame, start: datetime.date, end: datetime.date | None) -> DataFrame:
    """Points whose window starts in the span and whose label falls before its end.

    Points without a label date stay.
    """
    kept = F.col("date1") >= F.lit(start)
    if end is not None:
        kept &= F.col("date3").isNull() | (F.col("date3") < F.lit(end))
    return points.where(kept)


def train_rows(points: DataFrame, end: datetime.date) -> DataFrame:
    """Labelled points whose label falls before ``end``."""
    return points.where((F.col("date3") < F.lit(end)) & (F.col("is_labeled") == 1))


def check_rows(points: DataFrame, start: datetime.date) -> DataFrame:
    """Points anchored after ``start``."""
    return points.where(F.col("date2") > F.lit(start))


def in_parts(points: DataFrame, train_end: datetime.date, check_start: datetime.date) -> DataFrame:
    """Points with ``part``: a row for each of ``train`` and ``check`` that it belongs to, from one pass."""
    train = (F.col("date3") < F.lit(train_end)) & (F.col("is_labeled") == 1)
    check = F.col("date2") > F.lit(check_start)
    parts = F.filter(F.array(F.when(train, "train"), F.when(check, "check")), lambda x: x.isNotNull())
    return points.withColumn("part", F.explode(parts))
