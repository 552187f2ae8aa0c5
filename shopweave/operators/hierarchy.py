"""Item demand up the catalog: series of what is known, a forecast for each, sums to category, unit and segment, and what fills their gaps.

Facts come as sums by day (ledger.item_facts). They are summed to buckets before anything else, so that all later steps see one row for
each series and bucket. Unknown is not nought throughout: a bucket with an unknown line is unknown, a bucket in which the shop sold
nothing at all is unknown, and only a bucket with other sales is nought.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopweave.functions import batchfit
from shopweave.functions.columns import bucket, month_index
from shopweave.operators.series import error_metrics, latest_run

SEGMENTS = ("regular", "feeding")
METRICS = ("quantity", "revenue")
ITEM = ("segment", "product_id", "metric")
UNIT = ("segment", "scope", "category", "unit")


@dataclass(frozen=True)
class Period:
    name: str
    horizon: int
    season: int
    test: int
    validation: int
    step: str

    def bucket(self, day: str | Column) -> Column:
        return bucket(day, self.name)

    def index(self, day: str) -> Column:
        """Successive buckets have successive numbers."""
        days = F.datediff(day, F.lit("1970-01-05").cast("date"))
        return {"daily": days, "weekly": F.floor(days / 7).cast("int"), "monthly": month_index(day)}[self.name]

    def after(self, day: str | Column, n: int | Column) -> Column:
        day = F.col(day) if isinstance(day, str) else day
        n = F.lit(n) if isinstance(n, int) else n
        return F.add_months(day, n) if self.name == "monthly" else F.date_add(day, n * (7 if self.name == "weekly" else 1))


PERIODS = {
    "daily": Period("daily", 14, 7, 14, 7, "1 day"),
    "weekly": Period("weekly", 8, 52, 8, 4, "7 days"),
    "monthly": Period("monthly", 12, 12, 8, 4, "1 month"),
}


# Series


def cells(facts: DataFrame, period: Period, *keys: str) -> DataFrame:
    """Facts by keys and bucket: sums of what is known, how much is not, and the last day seen."""
    sums = [F.sum(c).cast("double").alias(c) for c in METRICS] + [F.sum(f"unknown_{c}").alias(f"unknown_{c}") for c in METRICS]
    return facts.groupBy(*keys, period.bucket("day").alias("bucket")).agg(F.max("day").alias("last_day"), *sums)


@dataclass(frozen=True)
class Dates:
    """Of all series: training ends before cutoff, run_start begins the unbroken buckets before it, targets counts the buckets to predict."""

    cutoff: date
    run_start: date
    projection_start: date
    targets: int


def calendar(sold: DataFrame, period: Period, as_of: str) -> Dates:
    """The dates that cells give, one row of which comes to the driver.

    The cutoff stands behind the last bucket with sales that was over by the last day recorded. Targets run from there to the
    horizon behind the present bucket, that of as_of or of the last sale.
    """
    seen = sold.groupBy("bucket").agg(F.max("last_day").alias("last_day"))
    last = seen.agg(F.max("last_day").alias("latest")).withColumn("first", period.bucket("latest"))
    over = F.date_sub(period.after("first", 1), 1) == F.col("latest")
    last = last.select(F.when(over, period.after("first", 1)).otherwise(F.col("first")).alias("limit"))
    # One row meets the list of buckets, here and below.
    closed = seen.join(F.broadcast(last)).filter(period.after("bucket", 1) <= F.col("limit"))
    run = latest_run(closed.select("bucket", F.lit(1).alias("all")), period.index("bucket"), "all").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    now = period.bucket(F.lit(as_of).cast("date"))
    both = last.join(F.broadcast(run)).withColumn("cutoff", F.coalesce(period.after("hi", 1), "limit", now)).withColumn("projection_start", F.greatest("limit", now))
    targets = (period.index("projection_start") + period.horizon - period.index("cutoff")).cast("int")
    return Dates(*both.select("cutoff", F.coalesce("lo", period.after("cutoff", -1)), "projection_start", targets).first())


def dense(values: DataFrame, dates: Dates, covered: DataFrame, period: Period, *keys: str, noughts: bool = True) -> DataFrame:
    """(keys, bucket, value) from the first bucket of each series, or the run's, to the cutoff: values (keys, bucket, value, unknown).

    noughts: a bucket without a row is nought if it is covered; otherwise it is unknown. Series of which nothing is known are left out.
    """
    # Each row brings the empty buckets up to the next one: a window over the few rows there are, and no join with the calendar.
    rows = spans(values, dates, *keys)
    rows = rows.select(*keys, "value", "unknown", F.posexplode(F.sequence("bucket", period.after("_next", -1), F.expr(f"interval {period.step}"))).alias("_k", "bucket"))
    rows = rows if period.name == "daily" else rows.filter(F.col("bucket") >= F.lit(dates.run_start))
    rows = rows.select(*keys, "bucket", *[F.when(F.col("_k") == 0, F.col(c)).alias(c) for c in ("value", "unknown")])
    value = F.when(F.col("unknown") > 0, None).otherwise(F.round("value", 2))
    if not noughts:
        return rows.select(*keys, "bucket", value.alias("value"))
    # As many rows as there are buckets.
    rows = rows.join(F.broadcast(covered.select("bucket").distinct().withColumn("sold", F.lit(True))), "bucket", "left")
    none = F.col("value").isNull() & F.col("unknown").isNull() & F.col("sold")
    return rows.select(*keys, "bucket", F.when(none, 0.0).otherwise(value).alias("value"))


def spans(values: DataFrame, dates: Dates, *keys: str) -> DataFrame:
    """Rows before the cutoff of series of which something is known, each with the bucket of the next one (the cutoff behind the last)."""
    before = values.filter(F.col("bucket") < F.lit(dates.cutoff))
    if "product_id" in keys:
        # Dealt by product alone, so that no later sum of a product's series, of whatever keys, is a shuffle of all their buckets.
        before = before.repartition("product_id")
    by = Window.partitionBy(*keys)
    following = F.lead("bucket", 1).over(by.orderBy("bucket"))
    return before.withColumns({"_next": F.coalesce(following, F.lit(dates.cutoff)), "_known": F.count("value").over(by)}).filter("_known > 0")


def by_metric(sold: DataFrame, *keys: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"unknown_{m}").alias("unknown")) for m in METRICS]))
    return sold.select(*keys, "bucket", each.alias("x")).select(*keys, "bucket", "x.*")


def item_series(sold: DataFrame, dates: Dates, period: Period) -> DataFrame:
    """(segment, product_id, metric, bucket, value) of every item of cells by segment and product; the unallocated product has revenue only."""
    return dense(by_metric(sold, "segment", "product_id"), dates, sold, period, *ITEM)


def unit_series(sold: DataFrame, products: DataFrame, dates: Dates, period: Period) -> DataFrame:
    """(segment, scope, category, unit, bucket, value): quantities by category and unit, and by unit alone (scope: overall).

    A single line of unknown quantity leaves its bucket unknown; different units are never added up.
    """
    both = sold.join(products.select("product_id", "category", "unit"), "product_id").withColumn("scope", F.explode(F.array(F.lit("category"), F.lit("overall"))))
    both = both.withColumn("category", F.when(F.col("scope") == "category", F.col("category")).otherwise(""))
    # Nothing but unknown lines is still a series, of which no bucket can be used.
    sums = both.groupBy(*UNIT, "bucket").agg(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("value"), F.sum("unknown_quantity").alias("unknown"))
    return dense(sums, dates, sold, period, *UNIT)


def revenue_series(sold: DataFrame, dates: Dates, period: Period) -> DataFrame:
    """(segment, bucket, value): the known revenue of all sales of a segment, what no item takes included."""
    sums = sold.groupBy("segment", "bucket").agg(F.sum("revenue").alias("value")).filter("value is not null").withColumn("unknown", F.lit(0))
    return dense(sums, dates, sold, period, "segment", noughts=False)


def scope_series(sold: DataFrame, products: DataFrame, dates: Dates, period: Period, scope: str, metric: str, segment: str = "all", window: int | None = None) -> DataFrame:
    """(scope_id, bucket, value) for a configured scope: overall, category or item; one segment or all; the last `window` buckets or all.

    Quantities of overall and category scopes are told apart by unit.
    """
    own = sold if segment == "all" else sold.filter(F.col("segment") == segment)
    everything = metric == "revenue" and scope == "overall"
    named = own.join(products.select("product_id", "category", "unit"), "product_id", "left" if everything else "inner")
    name = {"overall": F.lit("overall"), "category": F.col("category"), "item": F.col("product_id").cast("string")}[scope]
    name = F.concat(name, F.lit(" / "), F.col("unit")) if metric == "quantity" and scope != "item" else name
    sums = named.groupBy(name.alias("scope_id"), "bucket").agg(F.sum(metric).alias("value"), F.sum(f"unknown_{metric}").alias("unknown"))
    # What no item takes is a row of its own, so the sum of all is known.
    out = dense(sums.withColumn("unknown", F.lit(0)) if everything else sums, dates, own, period, "scope_id")
    return out if window is None else out.filter(F.col("bucket") >= period.after(F.lit(dates.cutoff), -window))


def arrays(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, training_start, values): a series in one row, dealt over all shuffle partitions however small they are: fits cost more than bytes tell."""
    sorted_ = F.array_sort(F.collect_list(F.struct("bucket", "value")))
    series = rows.groupBy(*keys).agg(F.min("bucket").alias("training_start"), F.transform(sorted_, lambda x: x["value"]).alias("values"))
    return series.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def item_arrays(sold: DataFrame, dates: Dates, period: Period) -> DataFrame:
    """arrays(item_series()), dealt by product and without a row for each empty bucket: every bucket of the run has sales, so those are noughts."""
    if period.name == "daily":  # whose series begin before the run
        return arrays(item_series(sold, dates, period), *ITEM)
    rows = spans(by_metric(sold, "segment", "product_id"), dates, *ITEM)
    value = F.when(F.col("unknown") > 0, None).when(F.col("value").isNull() & F.col("unknown").isNull(), 0.0).otherwise(F.round("value", 2))
    start = F.greatest("bucket", F.lit(dates.run_start))
    empty = period.index("_next") - period.index("_start")
    own = F.when(F.col("bucket") == F.col("_start"), F.concat(F.array(value), F.array_repeat(F.lit(0.0), empty - 1))).otherwise(F.array_repeat(F.lit(0.0), empty))
    rows = rows.withColumn("_start", start).filter(F.col("_start") < F.col("_next")).select(*ITEM, F.struct("_start", own.alias("values")).alias("_own"))
    parts = F.array_sort(F.collect_list("_own"))
    return rows.groupBy(*ITEM).agg(F.min("_own._start").alias("training_start"), F.flatten(F.transform(parts, lambda x: x["values"])).alias("values"))


# Forecasts

INACTIVE = "The item is inactive in the catalog."
FEW = "Fewer than six buckets with sales."
NO_SEASON = "A provisional estimate needs more buckets than one season."
NO_BLOCKS = "Too little history for separate validation and test blocks."
FEW_SEEN = "The validation block has too few known buckets."
NO_FIT = "The model could not be fitted."
NO_SCORE = "Estimate from short history; no error was measured."

STATUSES = ("available", "fit_failed", "inactive_item", "insufficient_history", "provisional")
RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("status", "reason", "method", "accuracy_status")]
    + [T.StructField(n, T.IntegerType()) for n in ("supported", "provisional", "total", "known_periods", "nonzero_periods", "interpolated_periods")]
    + [T.StructField(n, T.DoubleType()) for n in ("validation_mae", "mae", "wape", "bias")]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("predicted", "lower", "upper")]
    + [T.StructField("test", T.ArrayType(T.StructType([T.StructField("back", T.IntegerType()), T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType())])))]
)


def lacking(size: int, known: int, season: int) -> str | None:
    """Why so many buckets, of which so many are known, are no training."""
    required = max(24, 2 * season)
    if size < required or known < required:
        return f"{known} known buckets of {required} that training needs."
    return "Less than 60 % of the buckets are known." if known < 0.6 * size else None


def ineligible(values: np.ndarray, season: int) -> str | None:
    return lacking(len(values), int((~np.isnan(values)).sum()), season)


def fit_columns(flat: np.ndarray, bounds: np.ndarray, active: np.ndarray, targets: np.ndarray, period: Period) -> list[pa.Array]:
    """The columns of RESULT of the series flat[bounds[i] : bounds[i + 1]] (nan: unknown), all fits of a kind made together.

    Three fits at most: before the validation block, before the test block, of everything. Only the test block's errors make the
    bounds, which are given within the horizon alone; no block ever chooses anything. A series too short for the blocks but longer
    than a season has one fit, provisional, without error or bounds. Nothing is done series by series but for gaps in them.
    """
    split, begin, season, k = period.test, period.test + period.validation, period.season, len(bounds) - 1
    starts, ends, lengths, most = bounds[:-1], bounds[1:], np.diff(bounds), int(targets.max(initial=0))
    upto, positive = (np.append(0, np.cumsum(x)) for x in (~np.isnan(flat), flat > 0))
    known, nonzero = upto[ends] - upto[starts], positive[ends] - positive[starts]
    places, span = np.flatnonzero(~np.isnan(flat)), np.zeros(k, np.int64)
    seen = known > 0
    span[seen] = places[upto[ends[seen]] - 1] - places[upto[starts[seen]]] + 1
    word = {n: np.full(k, None, object) for n in ("reason", "method", "accuracy_status")} | {"status": np.full(k, "insufficient_history", object)}
    error = {n: np.full(k, np.nan) for n in ("validation_mae", "mae", "wape", "bias")}
    path = {n: np.full((k, most), np.nan) for n in ("predicted", "lower", "upper")}

    def unfit(rows: np.ndarray, less: int) -> np.ndarray:
        """Why series without their last buckets are no training, or None."""
        size, told = lengths[rows] - less, upto[ends[rows] - less] - upto[starts[rows]]
        return np.array([lacking(*x, season) for x in zip(size.tolist(), told.tolist(), strict=True)] + [None], object)[:-1]

    def failed(rows: np.ndarray) -> None:
        word["status"][rows], word["method"][rows], word["reason"][rows] = "fit_failed", "sarima", NO_FIT

    word["status"][~active], word["reason"][~active] = "inactive_item", INACTIVE
    word["reason"][active & (nonzero < 6)] = FEW
    asked = np.flatnonzero(active & (nonzero >= 6))
    word["reason"][asked] = NO_BLOCKS
    asked = asked[lengths[asked] > begin]
    word["reason"][asked] = unfit(asked, 0)
    asked = asked[word["reason"][asked] == None]  # noqa: E711
    word["reason"][asked] = unfit(asked, begin)
    asked = asked[word["reason"][asked] == None]  # noqa: E711
    few = upto[ends[asked] - split] - upto[ends[asked] - begin] < max(2, period.validation // 2)
    word["reason"][asked[few]] = FEW_SEEN
    whole = asked[~few]
    short = active & (nonzero >= 6) & (word["reason"] != None)  # noqa: E711
    brief = short & (lengths <= season)
    word["reason"][brief] = [f"{why} {NO_SEASON}" for why in word["reason"][brief]]
    short = np.flatnonzero(short & ~brief)
    # The middle window has to be as fit for training as the others.
    unable = unfit(whole, split) != None  # noqa: E711
    failed(whole[unable])
    whole = whole[~unable]
    fits = [batchfit.ahead_of(flat, starts[whole], lengths[whole] - less, season, n) for less, n in ((begin, period.validation), (split, split), (0, most))]
    fine = np.logical_and.reduce([f for _, _, f in fits])
    failed(whole[~fine])
    whole, (guessed, held, future) = whole[fine], [m[fine] for m, _, _ in fits]
    word["status"][whole], word["method"][whole] = "available", "sarima"
    path["predicted"][whole] = np.round(future, 2)
    off = np.abs(flat[(ends[whole] - begin)[:, None] + np.arange(period.validation)] - guessed)
    error["validation_mae"][whole] = np.where(np.isnan(off), 0, off).sum(1) / (~np.isnan(off)).sum(1)
    later, told = flat[(ends[whole] - split)[:, None] + np.arange(split)], np.round(held, 2)
    real = ~np.isnan(later)
    size = np.where(real, np.abs(later), 0).sum(1)
    for rows in batchfit.same(real.sum(1)):
        n = int(real[rows[0]].sum())
        if not n:
            continue
        wrong, out = (later - told)[rows][real[rows]].reshape(-1, n), whole[rows]
        error["mae"][out], error["bias"][out] = np.abs(wrong).mean(1), -wrong.mean(1)
        error["wape"][out] = np.divide(np.abs(wrong).sum(1) * 100, size[rows], out=np.full(len(rows), np.nan), where=size[rows] > 0)
        if n >= 8:
            near = future[rows][:, : period.horizon]
            for name, q in zip(("lower", "upper"), np.quantile(wrong, [0.1, 0.9], axis=1), strict=True):
                path[name][out, : near.shape[1]] = np.round(np.maximum(near + q[:, None], 0.0), 2)
    mean, _, fine = batchfit.ahead_of(flat, starts[short], lengths[short], season, most)
    failed(short[~fine])
    fine &= targets[short] > 0
    short = short[fine]
    word["status"][short], word["method"][short], word["accuracy_status"][short], word["reason"][short] = "provisional", "sarima", "unvalidated_short_history", NO_SCORE
    path["predicted"][short] = np.round(mean[fine], 2)

    supported, provisional, tested = np.zeros(k, np.int32), np.zeros(k, np.int32), np.zeros(k, np.int64)
    supported[whole], supported[short], provisional[short], tested[whole] = 1, 1, 1, real.sum(1)
    number = {"supported": supported, "provisional": provisional, "total": np.ones(k), "known_periods": known, "nonzero_periods": nonzero, "interpolated_periods": span - known}
    inside = np.arange(most) < targets[:, None]
    lists = lambda values, many: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), values)
    numbers = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
    back = np.broadcast_to(split - np.arange(split), real.shape)
    made = {n: pa.array(x, pa.string()) for n, x in word.items()} | {n: pa.array(x.astype(np.int32)) for n, x in number.items()}
    made |= {n: numbers(x) for n, x in error.items()} | {n: lists(numbers(x[inside]), targets) for n, x in path.items()}
    blocks = pa.StructArray.from_arrays([pa.array(back[real].astype(np.int32)), pa.array(later[real]), pa.array(told[real])], names=["back", "actual", "predicted"])
    return [made[n] if n in made else lists(blocks, tested) for n in RESULT.names]


def fit_all(series: list[np.ndarray], active: list[bool], targets: list[int], period: Period) -> list[dict]:
    """The outcome of each series (nan: unknown)."""
    bounds = np.append(0, np.cumsum([len(y) for y in series])).astype(np.int64)
    made = fit_columns(np.concatenate([np.zeros(0), *series]), bounds, np.array(active, bool), np.array(targets, np.int64), period)
    return pa.Table.from_arrays(made, names=RESULT.names).to_pylist()


def forecast_series(series: DataFrame, period: Period) -> DataFrame:
    """The columns of RESULT beside those of series (values, active, targets and any keys): one Arrow batch of series is fitted at a time."""
    names = series.columns

    def run(batches):
        for batch in batches:
            values, active, targets = (batch.column(names.index(n)) for n in ("values", "active", "targets"))
            bounds = np.append(0, np.cumsum(pc.list_value_length(values).to_numpy())).astype(np.int64)
            flat = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            made = fit_columns(flat, bounds, active.to_numpy(zero_copy_only=False).astype(bool), targets.to_numpy().astype(np.int64), period)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *RESULT.names])

    return series.mapInArrow(run, T.StructType([*series.schema.fields, *RESULT.fields]))


def steps(found: DataFrame, dates: Dates, period: Period, *keys: str) -> DataFrame:
    """A row for each series and target: keys, status, reason, counts, step, bucket, value, lower, upper."""
    kept = [*keys, "status", "reason", "method", "accuracy_status", "supported", "provisional", "total"]
    rows = found.select(*kept, F.posexplode(F.arrays_zip("predicted", "lower", "upper")).alias("k", "p"))
    return rows.select(*kept, (F.col("k") + 1).alias("step"), period.after(F.lit(dates.cutoff), F.col("k")).alias("bucket"), F.col("p.predicted").alias("value"), "p.lower", "p.upper")


def item_forecasts(series: DataFrame, products: DataFrame, dates: Dates, period: Period) -> DataFrame:
    """Every item's outcome by segment and metric; a product that the catalog lacks counts as active."""
    return estimated(arrays(series, *ITEM), products, dates, period)


def estimated(items: DataFrame, products: DataFrame, dates: Dates, period: Period, *named: str) -> DataFrame:
    """item_forecasts of series in one row each (item_arrays), with the columns of products that are named."""
    rows = items.join(products.select("product_id", "active", *named), "product_id", "left").withColumn("active", F.coalesce("active", F.lit(True)))
    return forecast_series(rows.select(*ITEM, *named, "training_start", "values", "active", F.lit(dates.targets).alias("targets")), period)


def last_year(series: DataFrame, dates: Dates, active: DataFrame | None, *keys: str) -> DataFrame:
    """A plain forecast of monthly series that SQL can make, of the shape of `steps`: the month of last year.

    Available with 24 known months, provisional with more than 12 months of which six have sales, else insufficient_history.
    """
    # Series end with the cutoff, so their last twelve buckets (or fewer) are the months of last year.
    recent = F.collect_list(F.when(F.col("bucket") >= F.add_months(F.lit(dates.cutoff), -12), F.struct("bucket", "value")))
    sizes = series.groupBy(*keys).agg(F.count("value").alias("known"), F.count(F.when(F.col("value") > 0, 1)).alias("positive"), F.count("*").alias("n"), F.array_sort(recent).alias("recent"))
    sizes = sizes.withColumn("active", F.lit(True)) if active is None else sizes.join(active, "product_id", "left").withColumn("active", F.coalesce("active", F.lit(True)))
    enough, some = F.col("known") >= 24, (F.col("positive") >= 6) & (F.col("n") > 12)
    status = F.when(~F.col("active"), "inactive_item").when(F.col("positive") < 6, "insufficient_history").when(enough, "available").when(some, "provisional").otherwise("insufficient_history")
    grid = sizes.withColumn("status", status).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(12))))
    place = F.col("step") - 13 + F.size("recent")
    value = F.when(place >= 0, F.get("recent", F.greatest(place, F.lit(0)))["value"])
    supported = F.col("status").isin("available", "provisional")
    one = lambda c: F.when(c, 1).otherwise(0)
    bucket = F.add_months(F.lit(dates.cutoff), F.col("step") - 1).alias("bucket")
    return grid.select(*keys, "status", one(supported).alias("supported"), one(F.col("status") == "provisional").alias("provisional"), F.lit(1).alias("total"), "step", bucket, F.when(supported, value).alias("value"))


# Sums up the catalog

NODE = ("view", "level", "metric", "unit", "category", "product_id")


def up(parts: DataFrame) -> DataFrame:
    """Item rows once for their segment's view and once for the combined one; revenue is not told apart by unit."""
    rows = parts.withColumn("view", F.explode(F.array("segment", F.lit("combined"))))
    return rows.withColumn("unit", F.when(F.col("metric") == "quantity", F.col("unit")).otherwise(""))


def rolled_up(parts: DataFrame) -> DataFrame:
    """Nodes of the catalog by view: parts (segment, product_id, metric, category, unit, status, supported, provisional, total, step, bucket, value).

    A node's value is the sum of the values known, null if none is; different units never meet. Bounds are withheld: quantiles of items
    do not add up. supported, provisional and total count series, and with them stands what the sum is worth: insufficient_history,
    partial (some series have no estimate), provisional or available. An item of one segment keeps its own status.
    """
    counts = [F.sum(c).alias(c) for c in ("cents", "supported", "provisional", "total")]
    parts = parts.withColumn("cents", F.round("value", 2).cast("decimal(24,2)"))
    # A status is a number while rows are summed: with a text among the sums they would be put in order, not hashed.
    known = F.array(*map(F.lit, STATUSES))
    items = up(parts.withColumn("status", F.array_position(known, F.col("status"))))
    items = items.groupBy("view", "metric", "unit", "category", "product_id", "step", "bucket").agg(*counts, F.element_at(known, F.min("status").cast("int")).alias("own"))
    # Each segment's categories are few rows, from which the combined view and the sums above are made.
    few = parts.withColumn("unit", F.when(F.col("metric") == "quantity", F.col("unit")).otherwise("")).groupBy("segment", "metric", "unit", "category", "step", "bucket").agg(*counts)
    categories = up(few).groupBy("view", "metric", "unit", "category", "step", "bucket").agg(*counts)
    whole = categories.groupBy("view", "metric", "unit", "step", "bucket").agg(*counts)
    shape = ["view", "metric", "unit", "category", "product_id", "step", "bucket", "cents", "supported", "provisional", "total", "own", "level"]
    sums = items.withColumn("level", F.lit("item")).select(*shape)
    for rows, level in ((categories, "category"), (whole, "overall")):
        lacking = {c: F.lit(None).cast(parts.schema[k].dataType) for c, k in (("category", "category"), ("product_id", "product_id"), ("own", "status")) if c not in rows.columns}
        sums = sums.union(rows.withColumns(lacking | {"level": F.lit(level)}).select(*shape))
    none = F.lit(None).cast("double")
    named = sums.withColumns({"value": F.col("cents").cast("double"), "lower": none, "upper": none})
    single = (F.col("level") == "item") & (F.col("total") == 1)
    return judged(named).withColumn("status", F.when(single, F.col("own")).otherwise(F.col("status"))).select(*NODE, "step", "bucket", "value", "lower", "upper", "supported", "provisional", "total", "status", "accuracy_status")


def judged(rows: DataFrame) -> DataFrame:
    """status and accuracy_status from the counts."""
    supported, provisional = F.col("supported"), F.col("provisional")
    status = F.when(supported == 0, "insufficient_history").when(supported < F.col("total"), "partial").when(provisional > 0, "provisional").otherwise("available")
    accuracy = F.when(provisional == supported, "unvalidated_short_history").when(provisional > 0, "mixed_validated_and_unvalidated")
    return rows.withColumns({"status": status, "accuracy_status": accuracy})


def tested(found: DataFrame, dates: Dates, products: DataFrame, period: Period) -> DataFrame:
    """Errors of the nodes' sums over the items' test blocks: what the series with an estimate were, beside what was predicted of them."""
    each = found.select("segment", "product_id", "metric", F.explode("test").alias("t")).join(products.select("product_id", "category", "unit"), "product_id", "left")
    each = each.withColumn("bucket", period.after(F.lit(dates.cutoff), -F.col("t.back")))
    rows = up(each.select("segment", "product_id", "metric", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("unit", F.lit("")).alias("unit"), "bucket", "t.actual", "t.predicted"))
    both = rows.withColumn("level", F.explode(F.array(F.lit("category"), F.lit("overall")))).withColumn("category", F.when(F.col("level") == "category", F.col("category")))
    keys = ("view", "level", "metric", "unit", "category")
    sums = both.groupBy(*keys, "bucket").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
    return error_metrics(sums, *keys).select(*keys, F.col("n").alias("tested"), "mae", "wape", "bias")


def filled(nodes: DataFrame, aggregates: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Segment nodes of quantity without any estimate give way to their own aggregate series; combined ones then add up the segments.

    nodes: of rolled_up, levels overall and category. aggregates: forecasts of unit_series (segment, scope, category, unit, status,
    supported, provisional, total, step, bucket, value). A combined node is made anew for every unit of a scope one of whose
    segments was filled, of the segments that have an estimate; `basis` tells what a node is made of. nodes should be a written table,
    keep writes one.
    """
    keys, out = ["view", "level", "category", "unit"], ("step", "bucket", "value", "supported", "provisional", "total", "status", "basis")
    ours = nodes.filter("metric = 'quantity' and level <> 'item'").withColumn("category", F.coalesce("category", F.lit(""))).withColumn("basis", F.lit("items")).select(*keys, *out)
    segment, combined = ours.filter("view <> 'combined'"), ours.filter("view = 'combined'")
    estimated = segment.groupBy(*keys).agg(F.bool_or(F.col("value").isNotNull()).alias("has")).filter("has").select(*keys)
    basis = F.concat("scope", F.lit("_quantity"))
    spare = aggregates.select(F.col("segment").alias("view"), F.col("scope").alias("level"), "category", "unit", *out[:-1], basis.alias("basis")).join(estimated, keys, "left_anti")
    spare = keep(spare)
    whole = keep(segment.join(spare.select(*keys).distinct(), keys, "left_anti").unionByName(spare))
    # Scopes with a filled segment, and the segments' nodes that have a value at all.
    touched = spare.select("level", "category").distinct()
    useful = whole.join(whole.groupBy(*keys).agg(F.count("value").alias("n")).filter("n > 0").select(*keys), keys).join(touched, ["level", "category"], "left_semi")
    again = useful.groupBy("level", "category", "unit", "step", "bucket").agg(
        F.sum(F.round("value", 2).cast("decimal(24,2)")).cast("double").alias("value"), *[F.sum(c).alias(c) for c in ("supported", "provisional", "total")]
    )
    again = keep(judged(again.withColumns({"view": F.lit("combined"), "basis": F.lit("segment_totals")})).select(*keys, *out))
    kept = combined.join(again.select(*keys).distinct(), keys, "left_anti")
    return whole.unionByName(kept).unionByName(again)


def hierarchy(sold: DataFrame, products: DataFrame, dates: Dates, period: Period, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All nodes with their forecasts, as the shop shows them: items, what they sum to, aggregates where no item has an estimate, and
    overall revenue by the segments' own series. keep writes a table that several branches read."""
    items = keep(estimated(item_arrays(sold, dates, period), products, dates, period, "category", "unit"))

    def nodes(found: DataFrame) -> DataFrame:
        named = {"category": F.coalesce("category", F.lit("unallocated")), "unit": F.coalesce("unit", F.lit(""))}
        return rolled_up(steps(found, dates, period, *ITEM, "category", "unit").withColumns(named))

    # Items' own nodes, nearly all there are, are made once, where they are asked for; series are dealt by product, not each step of them.
    own, above = nodes(items.repartition("product_id")).filter("level = 'item'"), keep(nodes(items).filter("level <> 'item'"))

    def fitted(rows: DataFrame, *keys: str) -> DataFrame:
        rows = arrays(rows, *keys).withColumns({"active": F.lit(True), "targets": F.lit(dates.targets)})
        return keep(steps(forecast_series(rows, period), dates, period, *keys))

    none, no_category, no_product = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("long")
    columns = [*NODE, "step", "bucket", "value", "lower", "upper", "supported", "provisional", "total", "status", "basis"]
    demand = filled(above, fitted(unit_series(sold, products, dates, period), *UNIT), keep)
    demand = demand.withColumns({"metric": F.lit("quantity"), "product_id": no_product, "lower": none, "upper": none})
    money = fitted(revenue_series(sold, dates, period), "segment").withColumns({"view": F.col("segment"), "basis": F.lit("segment_revenue")})
    sums = money.groupBy("step", "bucket").agg(F.sum(F.round("value", 2).cast("decimal(24,2)")).cast("double").alias("value"), *[F.sum(c).alias(c) for c in ("supported", "provisional", "total")])
    sums = judged(sums.withColumns({"view": F.lit("combined"), "lower": none, "upper": none, "basis": F.lit("segment_totals")}))
    place = {"level": F.lit("overall"), "metric": F.lit("revenue"), "unit": F.lit(""), "category": no_category, "product_id": no_product}
    total = money.withColumns(place).select(*columns).unionByName(sums.withColumns(place).select(*columns))
    rest = own.unionByName(above.filter("level = 'category' and metric = 'revenue'")).withColumn("basis", F.lit("items"))
    return rest.select(*columns).unionByName(demand.select(*columns)).unionByName(total)
