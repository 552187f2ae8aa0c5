"""Series on full calendars, where unknown is not nought; runs, gaps, baselines, tests and scores, all by grouped windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopweave.functions.columns import money, month, month_index, program_group, week


def on_calendar(rows: DataFrame, step: str = "1 month", *keys: str) -> DataFrame:
    """(keys, bucket, value) for every bucket between each key's first and last; value is null where there was none."""
    ends = rows.groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    full = ends.select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias("bucket"))
    return full.join(rows, [*keys, "bucket"], "left")


def latest_run(rows: DataFrame, index: Column, *keys: str) -> DataFrame:
    """The rows of each key's last run of consecutive indices."""
    by = Window.partitionBy(*keys)
    marked = rows.withColumn("_i", index).withColumn("_run", F.col("_i") - F.row_number().over(by.orderBy("_i")))
    last = marked.withColumn("_last", F.max("_run").over(by))
    return last.filter("_run = _last").drop("_i", "_run", "_last")


def weekly_run(days: DataFrame, *keys: str) -> DataFrame:
    """Weekly sums over full Monday weeks inside the latest contiguous months: days (keys, day, value)."""
    months = latest_run(days.select(*keys, month().alias("m")).distinct(), month_index("m"), *keys)
    span = months.groupBy(*keys).agg(F.min("m").alias("lo"), F.last_day(F.max("m")).alias("hi"))
    inside = days.join(span, list(keys)).filter((week() >= F.col("lo")) & (F.date_add(week(), 6) <= F.col("hi")))
    weeks = inside.groupBy(*keys, week().alias("bucket")).agg(F.sum("value").alias("value"))
    return latest_run(weeks, F.floor(F.datediff("bucket", F.lit("1970-01-05").cast("date")) / 7), *keys)


def year_over_year(rows: DataFrame, *keys: str) -> DataFrame:
    """Change in percent to the same month last year, only where that is over nought: rows (keys, bucket, value)."""
    before = rows.select(*keys, F.add_months("bucket", 12).alias("bucket"), F.col("value").alias("before"))
    both = rows.join(before, [*keys, "bucket"]).filter("before > 0")
    return both.select(*keys, "bucket", F.round((F.col("value") - F.col("before")) * 100 / F.col("before"), 4).alias("change"))


def serial_correlation(rows: DataFrame, lag: int, *keys: str) -> DataFrame:
    """Correlation with the value `lag` buckets before, null for fewer than lag + 3 points or without variance."""
    by = Window.partitionBy(*keys).orderBy("bucket")
    pairs = rows.withColumn("before", F.lag("value", lag).over(by))
    r = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("value", "before").alias("r"))
    return r.select(*keys, F.when((F.col("n") >= lag + 3) & ~F.isnan("r"), F.round("r", 6)).alias("correlation"))


def interpolated(rows: DataFrame, *keys: str) -> DataFrame:
    """Gaps between two known values filled along a line; gaps at the ends stay: rows on a full calendar (keys, bucket, value)."""
    by = Window.partitionBy(*keys).orderBy("bucket")
    rows = rows.withColumn("_i", F.row_number().over(by))
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("value").alias("v")))
    before = F.last(known, True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_b": before, "_a": after})
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_i") - F.col("_b.i")) / (F.col("_a.i") - F.col("_b.i"))
    return rows.withColumn("filled", F.coalesce("value", line)).drop("_i", "_b", "_a")


MONTHLY_BASELINES = ("previous", "mean_3", "mean_6", "median_3", "last_year")


def baselines(rows: DataFrame, *keys: str) -> DataFrame:
    """Five one-step predictions of each month from the months before: rows on a full calendar (keys, bucket, value)."""
    by = Window.partitionBy(*keys).orderBy("bucket")
    over = lambda n: by.rowsBetween(-n, -1)
    full = lambda n, value: F.when(F.count("value").over(over(n)) == n, value)
    last3 = F.array_sort(F.collect_list("value").over(over(3)))
    return rows.select(
        *keys, "bucket", "value", F.lag("value").over(by).alias("previous"), full(3, F.avg("value").over(over(3))).alias("mean_3"), full(6, F.avg("value").over(over(6))).alias("mean_6"),
        full(3, F.get(last3, F.lit(1))).alias("median_3"), F.lag("value", 12).over(by).alias("last_year"),
    )


def weekly_baselines(rows: DataFrame, *keys: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("bucket")
    four = by.rowsBetween(-4, -1)
    return rows.select(*keys, "bucket", "value", F.lag("value").over(by).alias("previous"), F.when(F.count("value").over(four) == 4, F.avg("value").over(four)).alias("mean_4"), F.lag("value", 52).over(by).alias("last_year"))


def long_predictions(wide: DataFrame, methods: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, bucket, method, actual, predicted) where both are known."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("predicted")) for m in methods]))
    out = wide.select(*keys, "bucket", F.col("value").alias("actual"), each.alias("p")).select(*keys, "bucket", "actual", "p.method", "p.predicted")
    return out.filter("actual is not null and predicted is not null")


def error_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Errors of rows (keys, actual, predicted); percentages are null where the actuals sum to nought."""
    error, size = F.col("predicted") - F.col("actual"), F.sum(F.abs("actual"))
    share = lambda x: F.when(size > 0, F.round(x * 100 / size, 4))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), share(F.sum(F.abs(error))).alias("wape"), share(F.sum(error)).alias("bias_percent"), F.round(F.avg(F.abs(error)), 4).alias("mae"), F.round(F.avg(error), 4).alias("bias"),
        F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"), F.round(F.max(F.abs(error)), 4).alias("max_error"), F.round(F.avg(error * error), 4).alias("mse"),
        F.round(F.avg(F.when(F.col("actual") != 0, F.abs(error / F.col("actual")))) * 100, 4).alias("mape"), F.count(F.when(F.col("actual") == 0, 1)).alias("zero_actuals"), F.round(F.stddev_pop(error), 2).alias("error_stddev"),
    )


def benchmark_select(rows: DataFrame, *keys: str, test: int = 12, validation: int = 6, least: int = 30) -> DataFrame:
    """The baseline with the least validation error and its error on the test months, which never choose.

    rows: the latest contiguous run (keys, bucket, value); keys with fewer than `least` months are insufficient_history.
    """
    ahead = Window.partitionBy(*keys).orderBy(F.desc("bucket"))
    sized = baselines(rows, *keys).withColumn("_back", F.row_number().over(ahead)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    long = long_predictions(sized, MONTHLY_BASELINES, *keys, "_back", "_n").filter(F.col("_n") >= least)
    part = F.when(F.col("_back") <= test, "test").when(F.col("_back") <= test + validation, "validation")
    scored = error_metrics(long.withColumn("part", part).filter("part is not null"), *keys, "method", "part").filter("wape is not null").select(*keys, "method", "part", "wape")
    chosen = scored.filter("part = 'validation'").groupBy(*keys).agg(F.min(F.struct("wape", "method")).alias("c"))
    tested = scored.filter("part = 'test'").select(*keys, "method", F.col("wape").alias("test_wape"))
    best = chosen.select(*keys, F.col("c.method").alias("method"), F.col("c.wape").alias("validation_wape")).join(tested, [*keys, "method"], "left")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("months"))
    status = F.when(F.col("months") < least, "insufficient_history").when(F.col("method").isNull(), "no_error").otherwise("available")
    return sizes.join(best, list(keys), "left").select(*keys, "months", status.alias("status"), "method", "validation_wape", "test_wape")


def error_band(errors: DataFrame, *keys: str) -> DataFrame:
    """The absolute error at rank ceil(0.9 (n + 1)) of each key, the half-width of a 90 % band: errors (keys, actual, predicted)."""
    sizes = F.array_sort(F.collect_list(F.abs(F.col("actual") - F.col("predicted"))))
    each = errors.groupBy(*keys).agg(sizes.alias("s"), F.count("*").alias("n"))
    at = F.least(F.ceil((F.col("n") + 1) * 9 / F.lit(10)), F.col("n")).cast("int")
    return each.select(*keys, "n", F.round(F.element_at("s", at), 4).alias("width"))


def quantile_band(errors: DataFrame, *keys: str, least: int = 8) -> DataFrame:
    """10 % and 90 % quantiles of the signed errors, for at least `least` of them."""
    q = F.expr("percentile(actual - predicted, array(0.1, 0.9))")
    each = errors.groupBy(*keys).agg(F.count("*").alias("n"), q.alias("q")).filter(F.col("n") >= least)
    return each.select(*keys, "n", F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high"))


def demand_class(rows: DataFrame, *keys: str) -> DataFrame:
    """The quadrant of each key's demand by interval and variation: rows on a full calendar (keys, bucket, value).

    An unknown bucket leaves the intervals unknown, so that only complete calendars have a class.
    """
    positive = F.when(F.col("value") > 0, F.struct("bucket", "value"))
    each = rows.groupBy(*keys).agg(F.count("*").alias("buckets"), F.count("value").alias("observed"), F.count(positive).alias("positive"), F.array_sort(F.collect_list(positive)).alias("p"))
    # Folded in order of buckets, so that no digit depends on how rows are dealt.
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "sum", "mean", "m2")])

    def step(a: Column, x: Column) -> Column:
        n, v = a["n"] + 1, x["value"].cast("double")
        mean = a["mean"] + (v - a["mean"]) / n
        return F.struct(n.alias("n"), (a["sum"] + v).alias("sum"), mean.alias("mean"), (a["m2"] + (v - a["mean"]) * (v - mean)).alias("m2"))

    spread = lambda a: F.when(a["n"] > 0, F.sqrt(a["m2"] / a["n"]) / (a["sum"] / a["n"]))
    each = each.withColumn("cv", F.aggregate("p", zero, step, spread))
    adi, cv2 = F.col("buckets") / F.col("positive"), F.col("cv") * F.col("cv")
    enough = (F.col("observed") == F.col("buckets")) & (F.col("buckets") >= 12) & (F.col("positive") >= 4)
    kind = F.when(~enough, "insufficient").when((adi < 1.32) & (cv2 < 0.49), "stable").when(adi < 1.32, "erratic").when(cv2 < 0.49, "intermittent").otherwise("lumpy")
    return each.select(*keys, "observed", "positive", F.when(enough, F.round(adi, 6)).alias("adi"), F.when(enough, F.round(cv2 * 1e6) / 1e6).alias("cv2"), kind.alias("class"))


def skill(scores: DataFrame, model: str, baseline: str, *keys: str) -> DataFrame:
    """100 (1 - model / baseline) of the summed absolute errors on the same targets; null where the baseline has none.

    scores: (keys, bucket, method, actual, predicted). Keys whose targets differ between the two come back as not comparable.
    """
    of = lambda m, name: scores.filter(F.col("method") == m).select(*keys, "bucket", F.abs(F.col("actual") - F.col("predicted")).alias(name))
    both = of(model, "m").join(of(baseline, "b"), [*keys, "bucket"], "full")
    each = both.groupBy(*keys).agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.bool_and(F.col("m").isNotNull() & F.col("b").isNotNull()).alias("comparable"))
    return each.select(*keys, "comparable", F.when(F.col("comparable") & (F.col("b") > 0), F.round((1 - F.col("m") / F.col("b")) * 100, 4)).alias("skill"))


def covered_cutoff(covered: DataFrame) -> DataFrame:
    """First and last month of the latest contiguous coverage: covered (bucket)."""
    one = covered.withColumn("all", F.lit(1))
    return latest_run(one, month_index("bucket"), "all").agg(F.min("bucket").alias("covered_from"), F.max("bucket").alias("covered_to"))


def combined(views: DataFrame, *keys: str) -> DataFrame:
    """regular + feeding where both exist: views (keys, segment, value)."""
    of = lambda s: views.filter(F.col("segment") == s).select(*keys, F.col("value").alias(s))
    return of("regular").join(of("feeding"), list(keys)).select(*keys, (F.col("regular") + F.col("feeding")).alias("value"))


def issued_asof(issues: DataFrame) -> DataFrame:
    """Per target the last complete bundle of three views issued before it began, where combined is the sum of the others to a cent.

    Where no bundle is complete, the last regular and the last feeding value issued, from whichever runs, and no combined one.
    issues (run_id, target, view, value, issued); run_id is null for the latter.
    """
    before = issues.filter("issued < target")
    runs = before.groupBy("target", "run_id", "issued").pivot("view", ["regular", "feeding", "combined"]).agg(F.max("value"))
    whole = F.abs(F.col("regular") + F.col("feeding") - F.col("combined")) <= 0.01
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct("issued", "run_id", F.col(c).alias("v")))
    last = runs.groupBy("target").agg(F.max(F.when(whole, F.struct("issued", "run_id", "regular", "feeding", "combined"))).alias("b"), F.max(at("regular")).alias("r"), F.max(at("feeding")).alias("f"))
    last = last.filter("b is not null or r is not null or f is not null")
    pick = lambda bundle, single: F.when(F.col("b").isNotNull(), F.col(bundle)).otherwise(F.col(single))
    return last.select("target", "b.run_id", pick("b.regular", "r.v").alias("regular"), pick("b.feeding", "f.v").alias("feeding"), "b.combined")


def matched_coverage(periods: DataFrame, reviews: DataFrame) -> DataFrame:
    """Periods with whether a review holds for exactly their present content: both (period, segment, target, revision)."""
    keys = ["period", "segment", "target", "revision"]
    return periods.join(reviews.select(*keys, F.lit(True).alias("hit")).distinct(), keys, "left").withColumn("reviewed", F.coalesce("hit", F.lit(False))).drop("hit")


def prospective_scores(issued: DataFrame, actuals: DataFrame, *keys: str) -> DataFrame:
    """Errors of issued forecasts (keys, bucket, value, lower, upper, baseline) against actuals (keys, bucket, actual)."""
    both = issued.join(actuals, [*keys, "bucket"])
    error = F.col("value") - F.col("actual")
    return both.select(*keys, "bucket", "actual", F.round(error, 4).alias("error"), F.round(F.abs(error), 4).alias("abs_error"), F.round(F.abs(F.col("baseline") - F.col("actual")), 4).alias("baseline_error"), F.col("actual").between(F.col("lower"), F.col("upper")).alias("inside"))


def prospective_report(issued: DataFrame, scores: DataFrame, as_of: str, *keys: str) -> DataFrame:
    """Issued and scored forecasts of each key, and their errors in percent of the actuals; those that have a baseline beside it.

    A month that is not over by as_of awaits its outcome, and no score of it counts; one that is over and has no score awaits review.
    """
    rows = issued.select(*keys, "bucket").join(scores, [*keys, "bucket"], "left").withColumn("open", F.add_months("bucket", 1) > F.lit(as_of).cast("date"))
    rows = rows.withColumns({c: F.when(~F.col("open"), F.col(c)) for c in scores.columns if c not in (*keys, "bucket")})
    size, both = F.abs("actual"), F.col("baseline_error").isNotNull()
    share = lambda error, of: F.when(F.sum(of) > 0, F.round(F.sum(error) * 100 / F.sum(of), 3))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("issued"), F.count("error").alias("scored"), F.count_if("open").alias("awaiting_outcome"), F.count_if(~F.col("open") & F.col("error").isNull()).alias("awaiting_review"), F.round(F.avg("abs_error"), 3).alias("mae"), F.round(F.avg("error"), 3).alias("bias"),
        F.round(F.avg(F.col("inside").cast("double")) * 100, 3).alias("coverage"), share(F.col("abs_error"), size).alias("wape"), F.count("baseline_error").alias("paired"),
        share(F.col("baseline_error"), F.when(both, size)).alias("baseline_wape"), share(F.when(both, F.col("abs_error")), F.when(both, size)).alias("paired_wape"),
    )


def quality_gate(runs: DataFrame, entries: DataFrame, covered: DataFrame, as_of: str, *keys: str, months: int = 12, limit: float = 8.0) -> DataFrame:
    """Why a key's forecasts are not good enough to be relied on, in the order below; none if they are.

    runs (keys, trained_through, trained, error, baseline_error): history long enough, and errors of the test months in percent, the model's below limit and not above the baseline's.
    entries (keys, bucket, actual, predicted, baseline): forecasts saved before their month and scored by reviewed actuals; the last
    unbroken run of them counts, its latest `months`. covered (keys, bucket): reviewed months.
    """
    run = latest_run(entries, F.year("bucket") * 12 + F.month("bucket"), *keys)
    recent = run.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bucket")))).filter(F.col("back") <= months)
    percent = lambda c: F.when(F.sum(F.abs("actual")) > 0, F.round(F.sum(F.abs(F.col(c) - F.col("actual"))) * 100 / F.sum(F.abs("actual")), 4))
    proof = recent.groupBy(*keys).agg(F.count("*").alias("n"), F.max("bucket").alias("last"), percent("predicted").alias("w"), percent("baseline").alias("b"))
    seen = covered.select(*keys, "bucket").distinct().join(runs.select(*keys, "trained_through"), list(keys))
    seen = seen.filter(F.col("bucket").between(F.add_months("trained_through", 1 - months), F.col("trained_through"))).groupBy(*keys).agg(F.count("*").alias("seen"))
    full = runs.join(proof, list(keys), "left").join(seen, list(keys), "left").na.fill(0, ["n", "seen"])
    enough, ahead = F.col("n") >= months, F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -1)
    tests = (
        (~F.col("trained"), "history"), (F.col("trained_through") < ahead, "stale_training"), (F.col("seen") < months, "coverage"),
        (F.col("error").isNull() | (F.col("error") >= limit) | (F.col("error") > F.col("baseline_error")), "retrospective"), (~enough, "few_prospective_months"),
        (enough & (F.col("last") < ahead), "stale_evidence"), (enough & (F.col("w").isNull() | (F.col("w") >= limit)), "error"),
        (enough & (F.col("w").isNull() | F.col("b").isNull() | (F.col("w") > F.col("b"))), "baseline"),
    )
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))
    return full.select(*keys, F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def freshness(rows: DataFrame, as_of: str, unit: str, key: str) -> DataFrame:
    """Last observed day, week or month (unit) of each key against the last closed one before as_of, and the worst state as `combined`.

    rows (key, bucket): bucket is the first day of what was observed; null where a key has nothing.
    """
    date = F.lit(as_of).cast("date")
    closed = {"day": F.date_sub(date, 1), "week": F.date_sub(F.to_date(F.date_trunc("week", date)), 7), "month": F.add_months(F.trunc(date, "month"), -1)}[unit]
    steps = {"day": F.date_diff(closed, "last"), "week": F.floor(F.date_diff(closed, "last") / 7), "month": F.months_between(closed, "last")}[unit].cast("int")
    each = rows.groupBy(key).agg(F.max("bucket").alias("last")).withColumn("missing", F.when(F.col("last").isNotNull(), F.greatest(steps, F.lit(0))))
    state = F.when(F.col("last").isNull(), "unavailable").when(F.col("missing") > 0, "stale").otherwise("current")
    each = each.select(key, F.col("last").alias("last_bucket"), "missing", state.alias("state"))
    stale, known = F.coalesce(F.bool_or(F.col("state") == "stale"), F.lit(False)), F.coalesce(F.bool_and(F.col("state") == "current"), F.lit(False))
    whole = each.agg(F.when(stale, "stale").when(known, "current").otherwise("unavailable").alias("state"))
    return each.union(whole.select(F.lit("combined"), F.lit(None).cast("date"), F.lit(None).cast("int"), "state"))


def feeding_study(sales: DataFrame, as_of: str) -> DataFrame:
    """What is recorded of feeding programs: sales (day, label, revenue) to (section, label, invoices, revenue, months).

    Sections: all (label: first and last day; months: complete months since the last), month (each of the span, without sales too),
    program (by program_group). Absence of invoices is no proof of no demand.
    """
    cells = sales.groupBy(month().alias("bucket"), program_group(F.col("label")).alias("program")).agg(F.count("*").alias("n"), F.sum("revenue").alias("s"), F.min("day").alias("lo"), F.max("day").alias("hi"))
    whole = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("n is not null")
    since = F.months_between(F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -1), F.trunc("hi", "month")).cast("int")
    none, total = F.lit(None).cast("int"), money("s").alias("revenue")
    rows = whole.select(F.lit("all").alias("section"), F.concat_ws("/", "lo", "hi").alias("label"), F.col("n").alias("invoices"), total, F.greatest(since, F.lit(0)).alias("months"))
    months = whole.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))).alias("bucket"))
    by_month = months.join(cells.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "bucket", "left")
    rows = rows.union(by_month.select(F.lit("month"), F.col("bucket").cast("string"), F.coalesce("n", F.lit(0)), total, none))
    by_program = cells.groupBy("program").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return rows.union(by_program.select(F.lit("program"), "program", "n", total, none))


def availability(points: DataFrame, *keys: str) -> DataFrame:
    """Prediction points there are, of those expected: points (keys, value)."""
    return points.groupBy(*keys).agg(F.count("*").alias("expected"), F.count("value").alias("available"), (F.count("*") == F.count("value")).alias("complete"))


def expert_adjusted(paths: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """The latest revision of each key (product, period, segment) applied to a path: absolute, delta or percent; whole cents, never below nought."""
    last = changes.groupBy(*keys).agg(F.max(F.struct("version", "kind", "amount")).alias("c"))
    kind, amount, value = F.col("c.kind"), F.col("c.amount"), F.col("value")
    new = F.when(kind == "absolute", amount).when(kind == "delta", value + amount).when(kind == "percent", value * (100 + amount) / 100).otherwise(value)
    return paths.join(last, list(keys), "left").select(*keys, F.greatest(F.round(new.cast("decimal(24,6)"), 2), F.lit(0)).cast("double").alias("value"))


def overlapping(predictions: DataFrame, start: str, end: str) -> DataFrame:
    """Predictions whose period touches the range, in full: predictions (period_start, period_end, ...)."""
    return predictions.filter((F.col("period_start") <= F.lit(end).cast("date")) & (F.col("period_end") >= F.lit(start).cast("date")))


def centered_window(keys: DataFrame, now: str, around: int) -> DataFrame:
    """`around` months before and after the present one for each key, with the day before which training may look."""
    first = F.add_months(F.trunc(F.lit(now).cast("date"), "month"), -around)
    steps = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * around))).alias("k")).withColumn("bucket", F.add_months(first, F.col("k")))
    return steps.withColumn("cutoff", F.least("bucket", F.trunc(F.lit(now).cast("date"), "month"))).drop("k")


def yearly_path(steps: DataFrame, *keys: str) -> DataFrame:
    """Sums of years that have all twelve monthly steps: steps (keys, bucket, value)."""
    sums = steps.groupBy(*keys, F.year("bucket").alias("year")).agg(F.count("value").alias("n"), F.sum("value").alias("value"))
    return sums.filter("n = 12").drop("n")


def annual_outlook(actuals: DataFrame, forecasts: DataFrame, now: str, *keys: str) -> DataFrame:
    """The year of `now`: closed months as they were, the present one at least as far as it is, the rest forecast.

    Any closed month unknown, or a later one without forecast, makes the year null. actuals and forecasts: (keys, bucket, value) of that year.
    """
    this = F.trunc(F.lit(now).cast("date"), "month")
    both = actuals.withColumnRenamed("value", "a").join(forecasts.withColumnRenamed("value", "f"), [*keys, "bucket"], "full")
    part = F.when(F.col("bucket") < this, F.col("a")).when(F.col("bucket") == this, F.greatest("a", "f")).otherwise(F.col("f"))
    each = both.withColumn("v", part).groupBy(*keys).agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    return each.select(*keys, F.when(F.col("n") == 12, F.round("s", 2)).alias("outlook"))


def issue(projections: DataFrame, actuals: DataFrame, as_of: str, *keys: str) -> DataFrame:
    """Saved projections (keys, origin, bucket, value) as issued forecasts: targets after as_of, the first origin of each target, beside
    the last value observed before as_of: actuals (keys, bucket, value)."""
    day = F.lit(as_of).cast("date")
    last = actuals.filter(F.col("bucket") < F.trunc(day, "month")).groupBy(*keys).agg(F.max_by("value", "bucket").alias("reference"))
    first = projections.filter(F.col("bucket") > day).groupBy(*keys, "bucket").agg(F.min(F.struct("origin", "value")).alias("p"))
    return first.join(last, list(keys), "left").select(*keys, "bucket", "p.origin", "p.value", "reference")


def range_report(keys: DataFrame, actuals: DataFrame, issued: DataFrame, tested: DataFrame, start: str, end: str, *names: str) -> DataFrame:
    """Every month of a range for each key: what was sold, what was issued for it or else predicted in a test, and the error by basis.

    actuals, issued, tested: (names, bucket, value).
    """
    months = keys.select(*names, F.explode(F.expr(f"sequence(trunc(date '{start}', 'month'), date '{end}', interval 1 month)")).alias("bucket"))
    by = [*names, "bucket"]
    rows = months.join(actuals.withColumnRenamed("value", "actual"), by, "left").join(issued.withColumnRenamed("value", "i"), by, "left").join(tested.withColumnRenamed("value", "t"), by, "left")
    basis = F.when(F.col("i").isNotNull(), "issued").when(F.col("t").isNotNull(), "test")
    predicted = F.coalesce("i", "t")
    return rows.select(*by, "actual", predicted.alias("predicted"), basis.alias("basis"), F.round(F.abs(predicted - F.col("actual")), 4).alias("error"))
