"""Quality rules: base rules, then robust multivariate outliers for each language and source.

Counts of the whole text become a vector of five transformed statistics (``VECTOR``). For each
group of one language and source a minimum-covariance-determinant estimate of centre and
scatter is fitted over all rows of the group that pass the base rules: from two deterministic
starts (quartiles; mean and covariance) concentration steps pass to the half of the rows
with the smallest Mahalanobis distances, the start with the smaller determinant wins, and one
reweighting step uses the rows within the 97.5 % bound. A row further out than the
``KEEP`` quantile of the chi-square distribution is rejected.

A concentration step is one aggregation: rows are counted and summed in fine bins of their
distance, before the shuffle, so a group with a third of all rows is a few hundred
partial sums a task. Groups of fewer than ``MIN_GROUP`` rows are judged with the other small
groups of their language, and these, if still few, with all small groups; a last group that is
still too small is judged by the base rules alone. ``FLOOR`` is the spread below which a
statistic is not told apart: it is added to the scatter, so a statistic that is constant in a
group does not reject what differs from it a little. A floor is small enough for a statistic
to pass the cut alone within its range, where its group's centre and scatter are near 0; repeated
windows are rejected alone by the base rule.

Defined results: a null text has no words and fails the base rules; a null language or source
is a value of its own; extra columns of the results' names give way to them; every row is judged, repeated ones each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import storage
from barloom.llm import common
from barloom.llm.text_stats import text_stats

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_GROUP = 60
STEPS = 5
KEEP = 0.9999
#: Statistic and floor of its spread. The cut is at 5.07 floors, and x_lines goes to 1.
VECTOR = {"x_length": 0.06, "x_symbols": 0.05, "x_repeats": 0.2, "x_lines": 0.18, "x_echo": 0.08}
P = len(VECTOR)
BINS_AN_OCTAVE = 16
#: Groups whose estimates (some 400 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_echo_words", "n_repeat_words"]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_ESTIMATE = "grp string, start int, centre array<double>, precision array<double>, logdet double, rows long"


def chi2_cdf(x: float, p: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the text and with the counts of it; an extra column of a count's name gives way to the count."""
    common.bounded_batches(df.sparkSession)
    others = [f for f in df.schema.fields if f.name != text_col and f.name not in COUNTS]
    rows = df.select(F.col(text_col).alias("_text"), *(F.col(f"`{f.name}`") for f in others))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "_text"):
                counts = text_stats(piece.column("_text"))
                columns = [piece.column(f.name) for f in others] + [pa.array(counts[c], pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in others), *COUNTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"{c} long" for c in COUNTS)])
    return rows.mapInArrow(part, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vectors() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "x_length": F.log(F.greatest("word_chars", F.lit(1)) / words),
        "x_symbols": F.sqrt(F.col("n_symbols") / words),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
        "x_lines": F.sqrt(F.col("n_dup_lines") / lines),
        "x_echo": F.sqrt(F.col("n_echo_words") / words),
    }


def _estimate(centre: np.ndarray, scatter: np.ndarray) -> tuple[list[float], list[float], float]:
    scatter = scatter + np.diag(np.square(list(VECTOR.values())))
    return centre.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])


def _moments(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre, scatter = sums / n, np.zeros((P, P))
    for (i, j), total in zip(_PAIRS, products, strict=True):
        scatter[i, j] = scatter[j, i] = total / n - centre[i] * centre[j]
    return centre, scatter


def _starts(row: pd.DataFrame) -> pd.DataFrame:
    """One row a group to its two starts."""
    out = []
    for r in row.itertuples():
        quartiles = np.stack(r.quartiles)
        robust = _estimate(quartiles[:, 1], np.diag(np.square((quartiles[:, 2] - quartiles[:, 0]) / 1.349)))
        plain = _estimate(*_moments(r.n, np.array(r.sums), np.array(r.products)))
        out += [(r.grp, k, *e, r.n) for k, e in enumerate((robust, plain))]
    return pd.DataFrame(out, columns=["grp", "start", "centre", "precision", "logdet", "rows"])


def _step(bound: float | None):
    """The next estimate from the bins of a group and start: of the nearest half, or of all rows within ``bound``."""

    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        counts = bins.n.to_numpy(float)
        n = counts.sum()
        upto = np.cumsum(counts)
        if bound is None:
            taken = int(np.searchsorted(upto, (n + P + 1) // 2)) + 1
        else:
            taken = max(1, int((bins.bin <= math.floor(math.log2(bound) * BINS_AN_OCTAVE)).sum()))
        share = float(upto[min(taken, len(upto)) - 1] / n)
        sums = np.stack(bins.sums.to_numpy())[:taken].sum(axis=0)
        products = np.stack(bins.products.to_numpy())[:taken].sum(axis=0)
        centre, scatter = _moments(upto[min(taken, len(upto)) - 1], sums, products)
        if share < 1:  # what a part of a normal sample has less of scatter than the whole
            scatter *= share / chi2_cdf(chi2_quantile(share, P), P + 2)
        first = bins.iloc[0]
        return pd.DataFrame([(first.grp, first.start, *_estimate(centre, scatter), int(n))], columns=["grp", "start", "centre", "precision", "logdet", "rows"])

    return run


def _sums() -> list[Column]:
    x = [F.col(c) for c in VECTOR]
    return [
        F.count("*").alias("n"),
        F.array(*(F.sum(c) for c in x)).alias("sums"),
        F.array(*(F.sum(x[i] * x[j]) for i, j in _PAIRS)).alias("products"),
    ]


def _distance() -> Column:
    d = [F.col(c) - F.col("centre")[k] for k, c in enumerate(VECTOR)]
    terms = [d[i] * d[j] * F.col("precision")[i * P + j] * (1 if i == j else 2) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _with(rows: DataFrame, estimates: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(estimates) if small else estimates, "grp", how)


def judged(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``df`` without the text, with the counts, ``base_failed``, ``distance2`` (null where no group judges) and ``kept``."""
    given = [c for c in df.columns if c not in (text_col, *COUNTS, "base_failed", "distance2", "kept")]
    carried = {f"in_{k}": c for k, c in enumerate(given)}  # so no name of a column clashes with one of these
    cell = (F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(name) for c, name in ((lang_col, "_l"), (source_col, "_s")))
    rows = measured(df.select(F.col(text_col).alias("text"), *cell, *(F.col(f"`{c}`").alias(k) for k, c in carried.items())))
    rows = rows.withColumns({"base_failed": base_failed(), **vectors()})
    rows = storage.materialize(rows, "quality_vectors")

    passed = rows.where("not base_failed")
    cells = passed.groupBy("_l", "_s").agg(F.count("*").alias("n")).withColumn("own", F.col("n") >= MIN_GROUP)
    rest = cells.where("not own").groupBy("_l").agg(F.sum("n").alias("rest"))
    named = cells.join(rest, "_l", "left").select(
        "_l", "_s",
        F.when(F.col("own"), F.concat_ws("\x1f", F.lit("s"), "_l", "_s")).when(F.col("rest") >= MIN_GROUP, F.concat_ws("\x1f", F.lit("l"), "_l")).otherwise("all").alias("grp"),
    )
    named = storage.materialize(named, "quality_groups")
    small = named.count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(named) if small else named, ["_l", "_s"], "left")
    fitted = rows.where("not base_failed").select("grp", *VECTOR)

    quartiles = F.array(*(F.percentile(F.round(c, 3), [0.25, 0.5, 0.75]) for c in VECTOR)).alias("quartiles")
    first = fitted.groupBy("grp").agg(quartiles, *_sums()).where(F.col("n") >= MIN_GROUP)
    estimates = storage.materialize(first.mapInPandas(lambda it: map(_starts, it), _ESTIMATE), "quality_estimates")
    for step in range(STEPS + 1):
        last = step == STEPS
        if last:  # the smaller determinant wins and is reweighted
            best = F.min_by(F.struct("centre", "precision"), F.struct("logdet", "start")).alias("best")
            estimates = estimates.groupBy("grp").agg(best).select("grp", F.lit(0).alias("start"), "best.*")
        bins = (
            _with(fitted, estimates.select("grp", "start", "centre", "precision"), small)
            .withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * BINS_AN_OCTAVE))
            .groupBy("grp", "start", "bin")
            .agg(*_sums())
        )
        bound = chi2_quantile(0.975, P) if last else None
        estimates = storage.materialize(bins.groupBy("grp", "start").applyInPandas(_step(bound), _ESTIMATE), "quality_estimates")

    cut = chi2_quantile(KEEP, P)
    out = _with(rows, estimates.select("grp", "centre", "precision"), small, "left").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & (F.col("distance2").isNull() | (F.col("distance2") <= cut))
    return out.select(*(F.col(k).alias(c) for k, c in carried.items()), *COUNTS, "base_failed", "distance2", kept.alias("kept"))
