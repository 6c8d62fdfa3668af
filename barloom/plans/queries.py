"""The registered queries: name -> (Spark callable, SQL text or None).

Every query runs over the whole tables of a folder. Computed doubles are brought
to a fixed number of digits on both sides (``q``), because the two engines add
in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas, storage
from barloom.operators import (
    averages,
    backtest,
    breakouts,
    directional,
    evaluate,
    features,
    indexes,
    ingest,
    mart,
    models,
    prices,
    similarity,
    state,
    trees,
)
from barloom.operators.evaluate import Cell
from barloom.plans import inputs
from barloom.plans.inputs import D, Inputs
from barloom.sinks import records, tables
from barloom.sources import landing, ledger, market

REGISTRY: dict[str, Callable[[Inputs], DataFrame]] = {}

# Months, quarters and years that overlap.
PERIODS = [
    (D(1998 + m // 12, m % 12 + 1, 1), D(1998 + (m + n) // 12, (m + n) % 12 + 1, 1)) for n in (1, 3, 12) for m in range(0, 48, min(n, 3))
]

RATIO_WINDOW, RATIO_COACH = 180, 30
NAIVE_COLUMNS = ["symbol", "date", "label"]
RISING_WINDOW, RISING_COACH = 60, 3
MART_WINDOW, MART_COACH = 30, 1
HOLD_WINDOW, HOLD_COACH = 60, 4

# Thresholds over the whole check period, then one threshold month by month.
SWEEP = [Cell(t / 10, D(1999, 1, 1), D(9999, 4, 1)) for t in range(5, 11)] + [
    Cell(0.6, D(1999 + m // 12, m % 12 + 1, 1), D(1999 + (m + 1) // 12, (m + 1) % 12 + 1, 1))
    for m in range(14)
]
GRID = [Cell(t / 20, start, end) for t in range(20) for start, end in PERIODS]


def query(run: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    REGISTRY[run.__name__] = run
    return run


def q(value: str | Column, digits: int = 4) -> Column:
    """Round just off the half, so that values ending in 5 fall the same way everywhere."""
    scale = 10**digits
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * float(scale) + 0.500001) / float(scale)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All double columns through ``q``."""
    return df.select(
        *[
            q(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )


def checksums(df: DataFrame, column: str = "features") -> DataFrame:
    """An array column as its length, ends and position-weighted sum."""
    terms = F.col(column)
    weighted = F.aggregate(
        F.zip_with(terms, F.sequence(F.lit(1), F.size(terms)), lambda x, k: x * k),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return df.withColumns(
        {
            "n_features": F.size(terms),
            "first_feature": F.element_at(terms, 1),
            "last_feature": F.element_at(terms, -1),
            "weighted_sum": weighted,
        }
    ).drop(column)


# --- inputs and ingest


@query
def bars_daily(m: Inputs) -> DataFrame:
    return rounded(m.bars, 6)


@query
def benchmark_daily(m: Inputs) -> DataFrame:
    return rounded(m.benchmark)


@query
def universe_list(m: Inputs) -> DataFrame:
    """Written as a carriage-return list, scanned, stored tab-separated and scanned again."""
    raw, stored = (storage.scratch_path(m.spark, name) for name in ["universe", "universe_tsv"])
    tables.write_universe(m.universe, raw)
    tables.write_tsv(landing.read_universe(m.spark, raw), stored)
    return landing.read_tsv(m.spark, stored, schemas.UNIVERSE)


@query
def bar_line_scan(m: Inputs) -> DataFrame:
    """Bars landed as text lines; on the 13th of a month the lines lack their last field."""
    columns = [F.col(name).cast("string") for name in ["symbol", "date", *schemas.BAR_VALUES]]
    whole, cut = F.concat_ws(", ", *columns), F.concat_ws(", ", *columns[:-1])
    path = storage.scratch_path(m.spark, "bar_lines")
    m.bars.select(F.when(F.dayofmonth("date") == 13, cut).otherwise(whole)).write.text(path)
    return rounded(landing.read_bar_lines(m.spark, path), 6)


@query
def symbol_feed_scan(m: Inputs) -> DataFrame:
    """The benchmark landed as a feed file; on the 13th the open is not a number."""
    feed = m.benchmark.select(
        F.col("date").alias("Date"),
        F.when(F.dayofmonth("date") == 13, F.lit("n/a"))
        .otherwise(F.col("open").cast("string"))
        .alias("Open"),
        *[F.col(name.lower()).alias(name) for name in schemas.FEED_FIELDS[2:]],
    )
    path = storage.scratch_path(m.spark, "feed")
    feed.write.option("header", True).csv(path)
    return rounded(landing.read_symbol_feed(m.spark, path, "SPX"))


@query
def benchmark_refresh(m: Inputs) -> DataFrame:
    old = market.benchmark(m.spark, m.folder, before=inputs.HISTORY_UNTIL)
    path = storage.scratch_path(m.spark, "benchmark")
    return rounded(ingest.refresh(old, m.benchmark, path))


@query
def refresh_gate(m: Inputs) -> DataFrame:
    """A reload that is long enough is taken; one that lost rows is refused and the old rows stay."""
    old = storage.materialize(m.benchmark, "benchmark")
    short = old.where(F.col("date") < F.lit(inputs.HISTORY_UNTIL))
    try:
        kept = ingest.refresh(old, short, storage.scratch_path(m.spark, "refused"))
    except ValueError:
        kept = old
    taken = ingest.refresh(short, old, storage.scratch_path(m.spark, "taken"))
    both = [df.agg(F.count("*").alias("bars"), F.max("date").alias("last")) for df in (kept, taken)]
    return both[0].withColumn("reload", F.lit("short")).unionByName(both[1].withColumn("reload", F.lit("whole")))


@query
def candidates(m: Inputs) -> DataFrame:
    """Stale and never-loaded symbols; those that have the last day are left out."""
    return ingest.candidates(m.universe, m.partly_loaded, m.loaded_days)


@query
def incremental_landing(m: Inputs) -> DataFrame:
    stale = ingest.candidates(m.universe, m.partly_loaded, m.loaded_days)
    return rounded(ingest.new_bars(m.delta, stale), 6)


@query
def landed_new_bars(m: Inputs) -> DataFrame:
    """Bars landed as a feed file a symbol, scanned, and what candidates lack of them."""
    path = storage.scratch_path(m.spark, "landed")
    tables.write_daily_feed(m.delta, path)
    stale = ingest.candidates(m.universe, m.partly_loaded, m.loaded_days)
    return rounded(ingest.new_bars(landing.read_daily_feed(m.spark, path), stale), 6)


@query
def ledger_landing(m: Inputs) -> DataFrame:
    """Bar lines landed on two days, the second with files of old bars that come late; what each day's run takes."""
    path = storage.scratch_path(m.spark, "landed")
    columns = [F.col(name).cast("string") for name in ["symbol", "date", *schemas.BAR_VALUES]]
    late = F.substring("symbol", 2, 9).cast("int") % 5 == 0
    bars = m.bars.select(F.concat_ws(",", *columns).alias("value"), (late | (F.col("date") >= F.lit(inputs.HISTORY_UNTIL))).alias("late"))
    bars = storage.materialize(bars, "bar_lines")
    parts = []
    with _table(m.spark) as name:
        for run in (1, 2):
            bars.where(F.col("late") == (run == 2)).select("value").write.mode("append").text(path)
            known = landing.ensure_table(m.spark, name, ledger.FILE)
            files = storage.materialize(ledger.new_files(ledger.landed(m.spark, path), known), "files")
            read = ledger.read(m.spark, path, files, landing.read_bar_lines)
            parts.append(storage.materialize(read.withColumn("run", F.lit(run)), "taken"))
            ledger.note(files, name)
    return rounded(parts[0].unionByName(parts[1]), 6)


@query
def merge_upsert(m: Inputs) -> DataFrame:
    return rounded(ingest.merge_bars(m.history, m.delta), 6)


@query
def partition_merge(m: Inputs) -> DataFrame:
    """The delta merged into a history of monthly partitions, and whether a bar's file was written by the merge."""
    month = F.date_format("date", "yyyy-MM")
    with _table(m.spark) as name:
        tables.merge_partitions(m.history, name, ingest.merge_bars, month)
        # One row a file.
        files = storage.materialize(m.spark.read.table(name).select("_metadata.file_path").distinct(), "files")
        tables.merge_partitions(m.delta, name, ingest.merge_bars, month)
        merged = m.spark.read.table(name).select("*", F.col("_metadata.file_path").alias("file_path"))
        rows = merged.join(files.withColumn("old", F.lit(True)), "file_path", "left")
        kept = rows.select(*m.bars.columns, F.col("old").isNull().alias("rewritten"))
        return rounded(storage.materialize(kept, "merged"), 6)


@query
def coverage_summary(m: Inputs) -> DataFrame:
    return ingest.coverage(m.bars)


@query
def completeness_short(m: Inputs) -> DataFrame:
    """Measured against the days of one symbol, so that some symbols are complete."""
    return ingest.short_symbols(m.bars, m.bars.where(F.col("symbol") == "S1"))


@query
def completeness_check(m: Inputs) -> DataFrame:
    return ingest.completeness(m.bars, m.bars.where(F.col("symbol") == "S1"))


@query
def calendar_bounds(m: Inputs) -> DataFrame:
    return ingest.calendar_bounds(m.benchmark)


@query
def latest_date(m: Inputs) -> DataFrame:
    return ingest.latest_date(m.benchmark)


@query
def calendar_parts(m: Inputs) -> DataFrame:
    return ingest.calendar_parts(m.bars)


@query
def fixture_slice(m: Inputs) -> DataFrame:
    return rounded(ingest.bar_slice(m.benchmark, "SPX", D(1998, 1, 1), D(1998, 6, 30)))


# --- prices and indexes


@query
def adjust_prices(m: Inputs) -> DataFrame:
    return rounded(m.adjusted)


@query
def normalize_prices(m: Inputs) -> DataFrame:
    return rounded(m.normalized)


@query
def relative_prices(m: Inputs) -> DataFrame:
    return rounded(m.relative)


@query
def relative_ratios(m: Inputs) -> DataFrame:
    return rounded(prices.relative_ratios(m.adjusted, indexes.mean_index(m.normalized)), 2)


@query
def mean_index(m: Inputs) -> DataFrame:
    return rounded(indexes.mean_index(m.normalized))


@query
def median_index(m: Inputs) -> DataFrame:
    """The running product spans many orders of magnitude, so its logarithm is compared."""
    index = indexes.median_index(m.normalized)
    return rounded(index.select("symbol", "date", F.ln("close").alias("log_close")))


@query
def breadth_daily(m: Inputs) -> DataFrame:
    return indexes.breadth(m.relative)


@query
def breadth_5bar(m: Inputs) -> DataFrame:
    return indexes.breadth_over(m.relative, 5)


# --- indicators


@query
def sma(m: Inputs) -> DataFrame:
    return rounded(averages.moving_averages(m.relative, (8, 20)))


@query
def sma_pair(m: Inputs) -> DataFrame:
    stored = storage.materialize(averages.moving_averages(m.relative, (8, 100)), "averages")
    fast, slow = (stored.where(F.col("window") == n) for n in (8, 100))
    return rounded(averages.join_averages(fast, slow))


@query
def sma_dual(m: Inputs) -> DataFrame:
    return rounded(averages.average_ratio(m.relative, 8, 20))


@query
def sma_calendar(m: Inputs) -> DataFrame:
    """Averages of line prices over calendar days, with days that have no line and days that have several."""
    lines = market.line_prices(m.spark, m.folder)
    return rounded(averages.calendar_averages(lines, (7, 30)))


@query
def sma_calendar_ahead(m: Inputs) -> DataFrame:
    """The same over stored relative bars, with a frame that reaches one day ahead."""
    return rounded(averages.calendar_averages(m.relative, (10,), ahead=1))


@query
def true_range_dm(m: Inputs) -> DataFrame:
    return rounded(directional.movement(m.relative))


@query
def adx(m: Inputs) -> DataFrame:
    return rounded(directional.directional_index(m.relative, digits=None))


@query
def indicators_next_days(m: Inputs) -> DataFrame:
    """Averages and directional index of late bars, from the state of each series before them."""
    relative = storage.materialize(m.relative, "relative")
    cut = F.col("date") >= F.lit(inputs.HISTORY_UNTIL)
    before = storage.materialize(state.state_of(relative.where(~cut)), "state")
    return rounded(state.indicators(state.advance(before, relative.where(cut))).drop("i"))


@query
def upbreak(m: Inputs) -> DataFrame:
    return rounded(breakouts.up_breakouts(m.bars), 6)


@query
def gupbreak(m: Inputs) -> DataFrame:
    return rounded(breakouts.gap_up_breakouts(m.bars), 6)


# --- backtest


@query
def crossover_ledger(m: Inputs) -> DataFrame:
    return rounded(backtest.ledger(backtest.crossover(m.relative, 14, 200, since=None)))


@query
def backtest_summary(m: Inputs) -> DataFrame:
    trades = backtest.ledger(backtest.crossover(m.relative, 14, 200, since=None))
    return rounded(backtest.summary(trades))


@query
def ledger_export(m: Inputs) -> DataFrame:
    """The ledger exported as sorted CSV and read back."""
    path = storage.scratch_path(m.spark, "ledger")
    trades = backtest.ledger(backtest.crossover(m.relative, 14, 200, since=None))
    tables.export_csv(trades, path, "symbol", "date")
    exported = m.spark.read.schema(schemas.LEDGER).option("header", True).csv(path)
    return rounded(exported)


# --- mart, features and labels


@query
def symbol_ids(m: Inputs) -> DataFrame:
    return mart.symbol_ids(m.bars)


@query
def feature_mart(m: Inputs) -> DataFrame:
    return rounded(mart.feature_mart(m.bars, m.benchmark))


@query
def lag_ratio_features(m: Inputs) -> DataFrame:
    marked = features.marked_at(m.relative, inputs.LAST_TRAIN)
    return rounded(checksums(features.lag_ratio_points(marked, RATIO_WINDOW, RATIO_COACH, "part")))


@query
def sma_ratio_features(m: Inputs) -> DataFrame:
    ratio = averages.average_ratio(m.relative, 8, 20).withColumnRenamed("mat_dual", "close")
    return rounded(checksums(features.rising_points(ratio, RISING_WINDOW, RISING_COACH)))


@query
def mart_features(m: Inputs) -> DataFrame:
    points = features.mart_features(m.rated, MART_WINDOW, MART_COACH)
    return rounded(
        checksums(
            points.select(
                "symbol", "date1", "date2", "date3", "act_diff", "is_labeled", "label", "features"
            )
        )
    )


LABEL_COLUMNS = ["symbol", "date1", "date2", "date3", "act_diff", "is_labeled", "label"]


@query
def forward_labels(m: Inputs) -> DataFrame:
    points = features.forward_labels(m.rated, HOLD_WINDOW, HOLD_COACH, unlabeled=-1)
    return rounded(points.select(*LABEL_COLUMNS))


@query
def time_split(m: Inputs) -> DataFrame:
    """Points of an open span, marked as train and check rows; unlabelled ones stay."""
    points = features.forward_labels(m.rated, MART_WINDOW, MART_COACH)
    span = inputs.OPEN_SPAN
    within = features.in_span(points, span.start, D(2001, 6, 1)).select(*LABEL_COLUMNS)
    return rounded(features.in_parts(within, span.train_end, span.check_start))


@query
def buy_hold_baseline(m: Inputs) -> DataFrame:
    points = features.forward_labels(m.rated, HOLD_WINDOW, HOLD_COACH, unlabeled=-1)
    return rounded(models.buy_and_hold(points.select(*LABEL_COLUMNS), inputs.SPANS))


# --- evaluation


@query
def prediction_enrichment(m: Inputs) -> DataFrame:
    return rounded(m.stored.enriched)


@query
def prediction_prices(m: Inputs) -> DataFrame:
    return rounded(evaluate.with_prices(m.stored.held, m.stored.bars, m.stored.benchmark))


@query
def precision_sweep(m: Inputs) -> DataFrame:
    return rounded(evaluate.precision_sweep(m.stored.enriched, SWEEP))


@query
def precision_grid(m: Inputs) -> DataFrame:
    """Twenty thresholds over each month, quarter and year, all in one aggregate."""
    return rounded(evaluate.precision_grid(m.stored.enriched, GRID))


@query
def label_violations(m: Inputs) -> DataFrame:
    """Labels of the 13th of a month are set to 1, so that some are wrong."""
    forced = F.when(F.dayofmonth("date2") == 13, 1).otherwise(F.col("label"))
    return evaluate.label_violations(m.stored.enriched.withColumn("label", forced))


@query
def top_predictions(m: Inputs) -> DataFrame:
    """The 100 best and worst by forward ratio, which stands in for a prediction."""
    scored = m.held.select("symbol", "date2", F.col("act_diff").alias("prediction"), "label")
    stored = storage.materialize(scored, "scored")
    return rounded(evaluate.both_ends(stored, "prediction", 100, "symbol", "date2", "label"))


@query
def open_predictions(m: Inputs) -> DataFrame:
    """The ten best unlabelled predictions of the last date that has any."""
    points = features.forward_labels(m.rated, HOLD_WINDOW, HOLD_COACH, unlabeled=-1)
    pending = points.where(F.col("is_labeled") == 0).select(
        "symbol", "date2", "is_labeled", q(F.col("adx") / 100).alias("prob")
    )
    pending = storage.materialize(pending, "pending")  # a few rows a symbol, read twice
    last = pending.agg(F.max("date2")).scalar()
    return evaluate.open_predictions(pending, last).limit(10)


@query
def regression_errors(m: Inputs) -> DataFrame:
    """Errors of predicting the forward ratio by the mean of the past one-bar ratios."""
    points = features.lag_ratio_points(m.relative, 5, 2)
    mean = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x) / F.size("features")
    return rounded(evaluate.squared_errors(points.withColumn("prediction", mean)))


# --- models


@query
def label_feature_index(m: Inputs) -> DataFrame:
    """Place of each label and, for each feature, its categories if it has few values."""
    points = features.mart_features(m.rated, MART_WINDOW, MART_COACH).select(*LABEL_COLUMNS, "features")
    stored = storage.materialize(models.as_vectors(points), "points")
    return models.indexes_of(features.in_span(stored, inputs.OPEN_SPAN.start, inputs.OPEN_SPAN.end))


@query
def tree_classifier_scores(m: Inputs) -> DataFrame:
    return _scores(m, "tree")


@query
def forest_classifier_scores(m: Inputs) -> DataFrame:
    return _scores(m, "forest")


@query
def logistic_classifier_scores(m: Inputs) -> DataFrame:
    return _scores(m, "logistic")


def _scores(m: Inputs, kind: str) -> DataFrame:
    # Training reads the points several times: they are stored, as vectors, first.
    points = features.mart_features(m.rated, MART_WINDOW, MART_COACH)
    stored = storage.materialize(
        models.as_vectors(points.select(*LABEL_COLUMNS, "features")), "points"
    )
    model, index = models.fit_span(stored, inputs.OPEN_SPAN, kind)
    scored = models.score_span(stored, inputs.OPEN_SPAN, model, index, explain=True)
    # The learned probabilities differ between engines; that they are probabilities of the predicted label, and follow
    # from the model's nodes or coefficients alone, doesn't.
    agrees = (F.col("prob") >= 0.5) == (F.col("predicted_label") == 1)
    explained = F.abs(F.col("prob") - F.col("node_prob")) <= 1e-9
    return rounded(
        scored.select(
            *LABEL_COLUMNS,
            F.col("prob").between(0, 1).alias("is_probability"),
            (agrees | (F.col("prob") == 0.5)).alias("agrees"),
            explained.alias("follows_from_nodes"),
        )
    )


@query
def kept_model_scores(m: Inputs) -> DataFrame:
    """A model trained, stored and loaded to score the last date, whose labels aren't known; next to the scores of the model as trained."""
    points = features.mart_features(m.rated, MART_WINDOW, MART_COACH)
    stored = storage.materialize(models.as_vectors(points.select(*LABEL_COLUMNS, "features")), "points")
    path = storage.scratch_path(m.spark, "kept")
    model, index = models.fit_span(stored, inputs.OPEN_SPAN, "tree")
    models.keep(model, path)
    last = stored.agg(F.max("date2")).scalar()
    rows = stored.where(F.col("date2") == last)
    both = models.score_date(rows, rows.agg(F.max("date2")).head()[0], *models.kept(path)).select(*LABEL_COLUMNS, "prob")
    first = models.score_span(rows, inputs.OPEN_SPAN, model, index).select("symbol", "date2", F.col("prob").alias("first_prob"))
    joined = both.join(first, ["symbol", "date2"], "left")
    return rounded(joined.select(*LABEL_COLUMNS, (F.col("prob") == F.col("first_prob")).alias("same_score")))


@query
def gbt_regression_errors(m: Inputs) -> DataFrame:
    """Fifty trees of depth ten over 180 ratios; the error itself is learned, the rest is fixed."""
    marked = features.marked_at(m.relative, inputs.LAST_TRAIN)
    points = models.as_vectors(features.lag_ratio_points(marked, RATIO_WINDOW, RATIO_COACH, "part"))
    stored = storage.materialize(points, "lag_points")
    train, check = (stored.where(F.col("part") == name) for name in ("train", "check"))
    model = models.fit_regression(train)
    nodes = trees.node_table(m.spark, model)
    followed = trees.regressed(model.transform(check), nodes).select(*NAIVE_COLUMNS, "prediction", "node_prediction")
    scored = storage.materialize(followed, "regressed")
    errors = evaluate.squared_errors(scored)
    by_nodes = evaluate.squared_errors(scored, "node_prediction").select(F.col("mse").alias("node_mse"))
    same = F.abs(F.col("prediction") - F.col("node_prediction")) <= 1e-9
    counts = scored.agg(F.count("prediction").alias("scored"), F.count_if(same).alias("followed"))
    both = counts.select("*", errors.select("mse").scalar().alias("mse"), errors.select("naive_mse").scalar().alias("naive_mse"), by_nodes.scalar().alias("node_mse"))
    return both.select(
        "scored",
        q("naive_mse").alias("naive_mse"),
        (F.col("mse") >= 0).alias("has_mse"),
        "followed",
        (F.abs(F.col("mse") - F.col("node_mse")) <= 1e-9).alias("same_mse"),
    )


@query
def column_cosine_similarity(m: Inputs) -> DataFrame:
    vectors = m.spark.read.parquet(f"{m.folder}/embeddings.parquet")
    return rounded(similarity.column_similarities(vectors, "embedding"), 6)


# --- sinks


@query
def libsvm_roundtrip(m: Inputs) -> DataFrame:
    """Labelled points stored as libsvm text and scanned again."""
    from pyspark.ml.functions import vector_to_array

    path = storage.scratch_path(m.spark, "points")
    points = features.lag_ratio_points(m.relative, 10, 5)
    tables.write_labeled_points(models.as_vectors(points), path)
    scanned = landing.read_labeled_points(m.spark, path, width=10)
    return rounded(checksums(scanned.withColumn("features", vector_to_array("features"))))


@query
def partition_overwrite(m: Inputs) -> DataFrame:
    """Two partitions of a table of bars; the second is replaced and the first stays."""
    late = market.bars(m.spark, m.folder, since=inputs.HISTORY_UNTIL)
    with _table(m.spark) as name:
        tables.write_partition(m.history, name, "early")
        tables.write_partition(late, name, "late")
        tables.write_partition(late.withColumn("volume", F.col("volume") + 1), name, "late")
        return rounded(storage.materialize(m.spark.read.table(name), "partitions"), 6)


@query
def table_append(m: Inputs) -> DataFrame:
    """Two spans of predictions appended to one ORC table."""
    points = features.forward_labels(m.rated, HOLD_WINDOW, HOLD_COACH, unlabeled=-1)
    stored = storage.materialize(points.select(*LABEL_COLUMNS), "labels")
    with _table(m.spark) as name:
        for span in inputs.SPANS:
            tables.write_table(models.buy_and_hold(stored, [span]), name, overwrite=False)
        return rounded(storage.materialize(m.spark.read.table(name), "appended"))


@query
def table_bootstrap(m: Inputs) -> DataFrame:
    """An empty table of bars is made, scanned, filled by a merge and scanned again."""
    with _table(m.spark) as name:
        present = landing.ensure_table(m.spark, name, schemas.BAR)
        before = present.count()
        tables.replace_table(ingest.merge_bars(present, m.delta), name)
        rows = storage.materialize(landing.read_table(m.spark, name), "bootstrap")
        return rounded(rows.withColumn("rows_before", F.lit(before)), 6)


@query
def table_copy(m: Inputs) -> DataFrame:
    """Universe replaced in a fixed number of files and copied to another table; both in one result."""
    with _table(m.spark) as source, _table(m.spark) as target:
        tables.replace_table(m.universe, source, files=3)
        tables.copy_table(m.spark, source, target)
        stored = m.spark.read.table(source)
        files = F.lit(len(stored.inputFiles()) <= 3).alias("few_files")
        both = stored.select("*", files, F.lit("source").alias("part")).unionByName(
            m.spark.read.table(target).select("*", files, F.lit("copy").alias("part"))
        )
        return storage.materialize(both, "copies")


@query
def table_switch(m: Inputs) -> DataFrame:
    """History replaced by all bars with one more column; what is found if the driver ends before or after the commit."""
    bars = storage.materialize(m.bars, "bars")
    history = bars.where(F.col("date") < F.lit(inputs.HISTORY_UNTIL))
    new = bars.withColumns({"step": F.lit("new"), "more": F.lit(1)})
    with _table(m.spark) as name:
        tables.replace_table(history.withColumn("step", F.lit("old")), name)
        tables.staged(new, name)
        before = storage.materialize(landing.ensure_table(m.spark, name, schemas.BAR), "before_commit")
        written = tables.staged(new, name)
        records.commit(m.spark, name, *written)
        after = storage.materialize(landing.ensure_table(m.spark, name, schemas.BAR), "after_commit")
        both = before.withColumns({"more": F.lit(0), "ended": F.lit("before commit")}).unionByName(
            after.withColumn("ended", F.lit("after commit"))
        )
        return rounded(both, 6)


@query
def table_ddl(m: Inputs) -> DataFrame:
    """The schema of the bars as column definitions, with which a table is made and read as a view."""
    with _table(m.spark) as name:
        m.spark.sql(f"CREATE TABLE {name} ({tables.ddl(m.bars)}) USING parquet")
        m.bars.write.mode("append").insertInto(name)
        view = tables.name_view(storage.materialize(m.spark.read.table(name), "made"), f"{name}_view")
        by_name = m.spark.sql(f"SELECT symbol, count(*) AS bars, max(date) AS last FROM {name}_view GROUP BY symbol")
        return by_name.withColumn("columns", F.lit(tables.ddl(view)))


@contextmanager
def _table(spark: SparkSession) -> Iterator[str]:
    """A table name that nobody else has; the table is dropped at the end."""
    name = f"barloom_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        tables.drop_table(spark, name)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: run(Inputs(spark, folder))

    return {name: bind(run) for name, run in REGISTRY.items()}
