"""Queries of series, baselines, tests and scores on the sales ledger, each with its SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.functions.columns import month, month_index
from shopweave.operators import series as op
from shopweave.plans.ledger import AS_OF, SNAPSHOT, snap
from shopweave.plans.prelude import sql
from shopweave.sources.shop import Shop

MONTHLY = f"{SNAPSHOT}, monthly AS (SELECT segment, date_trunc('month', day)::DATE AS bucket, sum(revenue)::DOUBLE AS value FROM snap GROUP BY 1, 2)"
INDEX = "year(bucket) * 12 + month(bucket)"


def runs_sql(source: str, keys: str, name: str = "run") -> str:
    return f"""{name}_marked AS (SELECT *, {INDEX} - row_number() OVER (PARTITION BY {keys} ORDER BY bucket) AS r FROM {source}),
        {name} AS (SELECT * EXCLUDE (r) FROM (SELECT *, max(r) OVER (PARTITION BY {keys}) AS top FROM {name}_marked) WHERE r = top)"""


CALENDAR = """ends AS (SELECT segment, min(bucket) AS lo, max(bucket) AS hi FROM gappy GROUP BY 1),
    cal AS (SELECT segment, unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS bucket FROM ends),
    dense AS (SELECT c.segment, c.bucket, g.value FROM cal c LEFT JOIN gappy g USING (segment, bucket))"""
GAPPY = f"{MONTHLY}, gappy AS (SELECT * FROM monthly WHERE ({INDEX}) % 7 <> 3 AND ({INDEX}) % 11 <> 4), {CALENDAR}"
BASE = f"""{MONTHLY}, {runs_sql('monthly', 'segment')},
    wide AS (SELECT segment, bucket, value, lag(value) OVER w AS previous,
        CASE WHEN count(value) OVER w3 = 3 THEN avg(value) OVER w3 END AS mean_3, CASE WHEN count(value) OVER w6 = 6 THEN avg(value) OVER w6 END AS mean_6,
        CASE WHEN count(value) OVER w3 = 3 THEN list_sort(list(value) OVER w3)[2] END AS median_3, lag(value, 12) OVER w AS last_year FROM run
        WINDOW w AS (PARTITION BY segment ORDER BY bucket), w3 AS (PARTITION BY segment ORDER BY bucket ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
        w6 AS (PARTITION BY segment ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
    long AS (SELECT segment, bucket, method, value AS actual, predicted FROM (UNPIVOT wide ON previous, mean_3, mean_6, median_3, last_year INTO NAME method VALUE predicted))"""
METRICS = """count(*) AS n, CASE WHEN sum(abs(actual)) > 0 THEN round(sum(abs(predicted - actual)) * 100 / sum(abs(actual)), 4) END AS wape,
    CASE WHEN sum(abs(actual)) > 0 THEN round(sum(predicted - actual) * 100 / sum(abs(actual)), 4) END AS bias_percent, round(avg(abs(predicted - actual)), 4) AS mae, round(avg(predicted - actual), 4) AS bias,
    round(sqrt(avg((predicted - actual) * (predicted - actual))), 4) AS rmse, round(max(abs(predicted - actual)), 4) AS max_error, round(avg((predicted - actual) * (predicted - actual)), 4) AS mse,
    round(avg(CASE WHEN actual <> 0 THEN abs((predicted - actual) / actual) END) * 100, 4) AS mape, count(CASE WHEN actual = 0 THEN 1 END) AS zero_actuals, round(stddev_pop(predicted - actual), 2) AS error_stddev"""
#: Forecasts of later months await their outcome.
REPORTED = "1998-03-15"
#: Some days after the last receipt of the driver's tables.
END_OF_DATA = "1998-08-09"
KINDS = "['regular', 'feeding', 'combined']"
ISSUES = f"""issues AS (SELECT run_id, target, view, round(CASE view WHEN 'combined' THEN v + w + CASE WHEN run_id % 5 = 0 THEN 1 ELSE 0 END WHEN 'regular' THEN v ELSE w END, 2) AS value, issued
    FROM (SELECT o_orderkey AS run_id, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS target, o_orderdate::DATE + (o_orderkey % 9 * 7)::INTEGER AS issued,
        (o_orderkey % 1000)::DOUBLE AS v, (o_custkey % 1000)::DOUBLE AS w FROM orders), (SELECT unnest({KINDS}) AS view) WHERE NOT (run_id % 4 = 0 AND view = 'feeding'))"""


def monthly(s: Shop):
    return snap(s).groupBy("segment", month().alias("bucket")).agg(F.sum("revenue").cast("double").alias("value"))


def gappy(s: Shop):
    i = month_index("bucket")
    return op.on_calendar(monthly(s).filter((i % 7 != 3) & (i % 11 != 4)), "1 month", "segment")


def run(s: Shop):
    return op.latest_run(monthly(s), month_index("bucket"), "segment")


def predictions(s: Shop):
    return op.long_predictions(op.baselines(run(s), "segment"), op.MONTHLY_BASELINES, "segment")


def covered(s: Shop):
    return s.receipts.filter("not voided").select(month().alias("bucket")).distinct()


def issues(s: Shop):
    base = s.table("orders").selectExpr(
        "o_orderkey as run_id", "add_months(trunc(o_orderdate, 'month'), 1) as target", "date_add(to_date(o_orderdate), cast(o_orderkey % 9 * 7 as int)) as issued",
        "cast(o_orderkey % 1000 as double) as v", "cast(o_custkey % 1000 as double) as w", "explode(array('regular', 'feeding', 'combined')) as view",
    ).filter("not (run_id % 4 = 0 and view = 'feeding')")
    return base.withColumn("value", F.expr("round(case view when 'combined' then v + w + if(run_id % 5 = 0, 1, 0) when 'regular' then v else w end, 2)"))


def forecasts(s: Shop):
    """Issued forecasts made of the baselines: last year's month, a band of a tenth, the previous month beside it."""
    wide = op.baselines(run(s), "segment")
    return wide.filter("last_year is not null").select("segment", "bucket", F.col("last_year").alias("value"), (F.col("last_year") * 0.9).alias("lower"), (F.col("last_year") * 1.1).alias("upper"), F.col("previous").alias("baseline"))


FORECASTS = f"{BASE}, issued AS (SELECT segment, bucket, last_year AS value, last_year * 0.9 AS lower, last_year * 1.1 AS upper, previous AS baseline FROM wide WHERE last_year IS NOT NULL)"
SCORED = f"""{FORECASTS}, scored AS (SELECT segment, bucket, m.value AS actual, round(i.value - m.value, 4) AS error, round(abs(i.value - m.value), 4) AS abs_error,
    round(abs(i.baseline - m.value), 4) AS baseline_error, m.value BETWEEN i.lower AND i.upper AS inside FROM issued i JOIN monthly m USING (segment, bucket) WHERE ({INDEX}) % 5 <> 0)"""
GATED = """entries AS (SELECT segment, bucket, m.value AS actual, i.value AS predicted, i.baseline FROM issued i JOIN monthly m USING (segment, bucket))"""


def gate(s: Shop):
    """The best baseline of each segment before the gate, its issued forecasts as evidence; odd months of 1995 are not reviewed."""
    months = run(s)
    chosen = op.benchmark_select(months, "segment").select("segment", (F.col("status") == "available").alias("trained"), F.col("test_wape").alias("error"))
    previous = op.error_metrics(predictions(s).filter("method = 'previous'"), "segment").select("segment", F.col("wape").alias("baseline_error"))
    runs = months.groupBy("segment").agg(F.max("bucket").alias("trained_through")).join(chosen, "segment").join(previous, "segment", "left")
    entries = forecasts(s).join(monthly(s).withColumnRenamed("value", "actual"), ["segment", "bucket"]).select("segment", "bucket", "actual", F.col("value").alias("predicted"), "baseline")
    return op.quality_gate(runs, entries, monthly(s).filter("not (year(bucket) = 1995 and month(bucket) % 2 = 1)"), AS_OF, "segment")


def observed(s: Shop, unit: str):
    """Days, weeks or months with sales, by segment."""
    return snap(s).select("segment", F.to_date(F.date_trunc(unit, "day")).alias("bucket")).distinct()


def scored(s: Shop):
    actuals = monthly(s).filter(month_index("bucket") % 5 != 0).withColumnRenamed("value", "actual")
    return op.prospective_scores(forecasts(s), actuals, "segment")


def select_sql() -> str:
    return f"""{BASE}, backed AS (SELECT l.*, r.back, r.months FROM long l JOIN (SELECT segment, bucket, row_number() OVER (PARTITION BY segment ORDER BY bucket DESC) AS back,
            count(*) OVER (PARTITION BY segment) AS months FROM run) r USING (segment, bucket) WHERE r.months >= 30),
        parts AS (SELECT segment, method, CASE WHEN back <= 12 THEN 'test' WHEN back <= 18 THEN 'validation' END AS part,
            CASE WHEN sum(abs(actual)) > 0 THEN round(sum(abs(predicted - actual)) * 100 / sum(abs(actual)), 4) END AS wape FROM backed WHERE back <= 18 GROUP BY 1, 2, 3),
        best AS (SELECT segment, arg_min(method, (wape, method)) AS method, min(wape) AS validation_wape FROM parts WHERE part = 'validation' GROUP BY 1),
        sizes AS (SELECT segment, count(*) AS months FROM run GROUP BY 1)
        SELECT s.segment, s.months, CASE WHEN s.months < 30 THEN 'insufficient_history' WHEN b.method IS NULL THEN 'no_error' ELSE 'available' END AS status, b.method, b.validation_wape, p.wape AS test_wape
        FROM sizes s LEFT JOIN best b USING (segment) LEFT JOIN parts p ON p.segment = b.segment AND p.method = b.method AND p.part = 'test'"""


QUERIES = {
    "latest_contiguous_run": (
        lambda s: op.latest_run(gappy(s).filter("value is not null"), month_index("bucket"), "segment"),
        sql(f", {GAPPY}, known AS (SELECT * FROM dense WHERE value IS NOT NULL), {runs_sql('known', 'segment')} SELECT segment, bucket, value FROM run"),
    ),
    "weekly_complete_run": (
        lambda s: op.weekly_run(snap(s).select("segment", "day", F.col("revenue").alias("value")), "segment").withColumn("value", F.col("value").cast("double")),
        sql(f""", {SNAPSHOT}, ms AS (SELECT DISTINCT segment, date_trunc('month', day)::DATE AS bucket FROM snap), {runs_sql('ms', 'segment', 'mrun')},
            span AS (SELECT segment, min(bucket) AS lo, last_day(max(bucket)) AS hi FROM mrun GROUP BY 1),
            wk AS (SELECT s.segment, date_trunc('week', day)::DATE AS bucket, sum(revenue)::DOUBLE AS value FROM snap s JOIN span USING (segment)
                WHERE date_trunc('week', day)::DATE >= lo AND date_trunc('week', day)::DATE + 6 <= hi GROUP BY 1, 2),
            wm AS (SELECT *, (bucket - DATE '1970-01-05') // 7 - row_number() OVER (PARTITION BY segment ORDER BY bucket) AS r FROM wk)
            SELECT segment, bucket, value FROM (SELECT *, max(r) OVER (PARTITION BY segment) AS top FROM wm) WHERE r = top"""),
    ),
    "yoy_change": (
        lambda s: op.year_over_year(monthly(s), "segment"),
        sql(f", {MONTHLY} SELECT a.segment, a.bucket, round((a.value - b.value) * 100 / b.value, 4) AS change FROM monthly a JOIN monthly b ON b.segment = a.segment AND b.bucket = a.bucket - INTERVAL 1 YEAR WHERE b.value > 0"),
    ),
    "serial_correlation": (
        lambda s: op.serial_correlation(run(s), 1, "segment").join(op.serial_correlation(run(s), 12, "segment").withColumnRenamed("correlation", "seasonal"), "segment"),
        sql(f""", {MONTHLY}, {runs_sql('monthly', 'segment')}, p AS (SELECT segment, value, lag(value) OVER w AS b1, lag(value, 12) OVER w AS b12 FROM run WINDOW w AS (PARTITION BY segment ORDER BY bucket))
            SELECT segment, CASE WHEN count(*) >= 4 AND NOT isnan(corr(value, b1)) THEN round(corr(value, b1), 6) END AS correlation,
                CASE WHEN count(*) >= 15 AND NOT isnan(corr(value, b12)) THEN round(corr(value, b12), 6) END AS seasonal FROM p GROUP BY 1"""),
    ),
    "calendar_series": (lambda s: gappy(s), sql(f", {GAPPY} SELECT * FROM dense")),
    "interpolate_gaps": (
        lambda s: op.interpolated(gappy(s), "segment").select("segment", "bucket", "value", F.round("filled", 4).alias("filled")),
        sql(f""", {GAPPY}, i AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY bucket) AS i FROM dense),
            j AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY segment ORDER BY i) AS bi, min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY segment ORDER BY i DESC) AS ai FROM i)
            SELECT j.segment, j.bucket, j.value, round(coalesce(j.value, b.value + (a.value - b.value) * (j.i - j.bi) / (j.ai - j.bi)), 4) AS filled
            FROM j LEFT JOIN i b ON b.segment = j.segment AND b.i = j.bi LEFT JOIN i a ON a.segment = j.segment AND a.i = j.ai"""),
    ),
    "baseline_predictions": (
        lambda s: predictions(s).withColumn("predicted", F.round("predicted", 3)),
        sql(f", {BASE} SELECT segment, bucket, method, actual, round(predicted, 3) AS predicted FROM long WHERE actual IS NOT NULL"),
    ),
    "walk_forward": (
        lambda s: op.error_metrics(predictions(s), "segment", "method").select("segment", "method", "n", "wape"),
        sql(f", {BASE}, m AS (SELECT segment, method, {METRICS} FROM long GROUP BY 1, 2) SELECT segment, method, n, wape FROM m"),
    ),
    "error_metrics": (
        lambda s: op.error_metrics(predictions(s).withColumns({"actual": F.round(F.col("actual") / 1e6, 2), "predicted": F.round(F.col("predicted") / 1e6, 2)}), "segment", "method"),
        sql(f", {BASE}, small AS (SELECT segment, method, round(actual / 1e6, 2) AS actual, round(predicted / 1e6, 2) AS predicted FROM long) SELECT segment, method, {METRICS} FROM small GROUP BY 1, 2"),
    ),
    "benchmark_select": (lambda s: op.benchmark_select(run(s), "segment"), sql(f", {select_sql()}")),
    "error_band": (
        lambda s: op.error_band(predictions(s), "segment", "method"),
        sql(f""", {BASE}, e AS (SELECT segment, method, abs(actual - predicted) AS e, row_number() OVER (PARTITION BY segment, method ORDER BY abs(actual - predicted)) AS k, count(*) OVER (PARTITION BY segment, method) AS n FROM long)
            SELECT segment, method, n, round(e, 4) AS width FROM e WHERE k = least(((n + 1) * 9 + 9) // 10, n)"""),
    ),
    "quantile_band": (
        lambda s: op.quantile_band(predictions(s), "segment", "method"),
        sql(f""", {BASE} SELECT segment, method, count(*) AS n, round(quantile_cont(actual - predicted, 0.1), 4) AS low, round(quantile_cont(actual - predicted, 0.9), 4) AS high
            FROM long GROUP BY 1, 2 HAVING count(*) >= 8"""),
    ),
    "skill_score": (
        lambda s: op.skill(predictions(s).filter("method in ('mean_6', 'previous')").join(predictions(s).filter("method = 'mean_6'").select("segment", "bucket"), ["segment", "bucket"], "left_semi"), "mean_6", "previous", "segment"),
        sql(f""", {BASE}, p AS (SELECT a.segment, abs(a.actual - a.predicted) AS m, abs(b.actual - b.predicted) AS b FROM long a JOIN long b USING (segment, bucket) WHERE a.method = 'mean_6' AND b.method = 'previous')
            SELECT segment, true AS comparable, round((1 - sum(m) / sum(b)) * 100, 4) AS skill FROM p GROUP BY 1"""),
    ),
    "covered_cutoff": (
        lambda s: op.covered_cutoff(covered(s)),
        sql(f", c AS (SELECT DISTINCT 1 AS one, date_trunc('month', day)::DATE AS bucket FROM receipt WHERE NOT voided), {runs_sql('c', 'one')} SELECT min(bucket) AS covered_from, max(bucket) AS covered_to FROM run"),
    ),
    "combine_views": (
        lambda s: op.combined(monthly(s), "bucket").withColumn("value", F.round("value", 2)),
        sql(f", {MONTHLY} SELECT bucket, round(a.value + b.value, 2) AS value FROM monthly a JOIN monthly b USING (bucket) WHERE a.segment = 'regular' AND b.segment = 'feeding'"),
    ),
    "chart_history": (
        lambda s: snap(s).groupBy(month().alias("bucket")).pivot("segment", ["regular", "feeding"]).agg(F.sum("revenue").cast("double").alias("v"), F.count("revenue").alias("n")),
        sql(f""", {SNAPSHOT} SELECT date_trunc('month', day)::DATE AS bucket, sum(revenue) FILTER (segment = 'regular')::DOUBLE AS regular_v, nullif(count(*) FILTER (segment = 'regular'), 0) AS regular_n,
            sum(revenue) FILTER (segment = 'feeding')::DOUBLE AS feeding_v, nullif(count(*) FILTER (segment = 'feeding'), 0) AS feeding_n FROM snap GROUP BY 1"""),
    ),
    "feeding_study": (
        lambda s: op.feeding_study(snap(s).filter("segment = 'feeding'").join(s.receipts.select(F.col("id").alias("sale_id"), "label"), "sale_id"), AS_OF),
        sql(rf""", {SNAPSHOT}, f AS (SELECT s.day, s.revenue, date_trunc('month', s.day)::DATE AS bucket,
                ' ' || regexp_replace(regexp_replace(lower(strip_accents(label)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g') || ' ' AS words FROM snap s JOIN receipt r ON r.id = s.sale_id WHERE s.segment = 'feeding'),
            p AS (SELECT *, CASE WHEN contains(words, ' dswd ') THEN 'DSWD' WHEN contains(words, ' deped ') THEN 'DepEd' WHEN contains(words, 'las pinas') THEN 'Las Piñas' WHEN contains(words, ' rizal ') THEN 'Rizal'
                ELSE 'Unspecified feeding program' END AS program FROM f),
            cal AS (SELECT unnest(generate_series((SELECT min(bucket) FROM f), (SELECT max(bucket) FROM f), INTERVAL 1 MONTH))::DATE AS bucket)
            SELECT 'all' AS section, min(day) || '/' || max(day) AS label, count(*) AS invoices, sum(revenue)::DOUBLE AS revenue, greatest(date_diff('month', max(day), DATE '{AS_OF}') - 1, 0)::INTEGER AS months FROM f HAVING count(*) > 0
            UNION ALL SELECT 'month', bucket::VARCHAR, count(day), coalesce(sum(revenue), 0)::DOUBLE, NULL FROM cal LEFT JOIN f USING (bucket) GROUP BY bucket
            UNION ALL SELECT 'program', program, count(*), sum(revenue)::DOUBLE, NULL FROM p GROUP BY program"""),
    ),
    "issued_asof": (
        lambda s: op.issued_asof(issues(s)),
        sql(f""", {ISSUES}, runs AS (SELECT target, run_id, issued, max(value) FILTER (view = 'regular') AS regular, max(value) FILTER (view = 'feeding') AS feeding, max(value) FILTER (view = 'combined') AS combined
                FROM issues WHERE issued < target GROUP BY 1, 2, 3),
            whole AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY issued DESC, run_id DESC) AS k FROM runs WHERE abs(regular + feeding - combined) <= 0.01),
            single AS (SELECT target, arg_max(regular, (issued, run_id)) FILTER (regular IS NOT NULL) AS regular, arg_max(feeding, (issued, run_id)) FILTER (feeding IS NOT NULL) AS feeding
                FROM runs WHERE target NOT IN (SELECT target FROM whole) GROUP BY 1)
            SELECT target, run_id, regular, feeding, combined FROM whole WHERE k = 1 UNION ALL SELECT target, NULL, regular, feeding, NULL FROM single WHERE regular IS NOT NULL OR feeding IS NOT NULL"""),
    ),
    "coverage_asof_match": (
        lambda s: op.matched_coverage(
            monthly(s).select(F.lit("monthly").alias("period"), "segment", F.col("bucket").alias("target"), F.floor("value").alias("revision")),
            monthly(s).select(F.lit("monthly").alias("period"), "segment", F.col("bucket").alias("target"), (F.floor("value") + F.when(F.month("bucket") == 4, 1).otherwise(0)).alias("revision")),
        ),
        sql(f", {MONTHLY} SELECT 'monthly' AS period, segment, bucket AS target, floor(value)::BIGINT AS revision, month(bucket) <> 4 AS reviewed FROM monthly"),
    ),
    "prospective_scores": (lambda s: scored(s), sql(f", {SCORED} SELECT * FROM scored")),
    "prospective_report": (
        lambda s: op.prospective_report(forecasts(s), scored(s), REPORTED, "segment"),
        sql(f""", {SCORED}, r AS (SELECT i.segment, i.bucket + INTERVAL 1 MONTH > DATE '{REPORTED}' AS open, s.* EXCLUDE (segment, bucket) FROM issued i LEFT JOIN scored s ON s.segment = i.segment AND s.bucket = i.bucket AND i.bucket + INTERVAL 1 MONTH <= DATE '{REPORTED}')
            SELECT segment, count(*) AS issued, count(error) AS scored, count(*) FILTER (open) AS awaiting_outcome, count(*) FILTER (NOT open AND error IS NULL) AS awaiting_review, round(avg(abs_error), 3) AS mae, round(avg(error), 3) AS bias,
            round(avg(inside::INTEGER) * 100, 3) AS coverage, CASE WHEN sum(abs(actual)) > 0 THEN round(sum(abs_error) * 100 / sum(abs(actual)), 3) END AS wape, count(baseline_error) AS paired,
            round(sum(baseline_error) * 100 / nullif(sum(abs(actual)) FILTER (baseline_error IS NOT NULL), 0), 3) AS baseline_wape,
            round(sum(abs_error) FILTER (baseline_error IS NOT NULL) * 100 / nullif(sum(abs(actual)) FILTER (baseline_error IS NOT NULL), 0), 3) AS paired_wape FROM r GROUP BY 1"""),
    ),
    "quality_gate": (
        gate,
        sql(f""", chosen AS ({'WITH ' + select_sql()}), back AS (WITH {FORECASTS}, {GATED},
                e_marked AS (SELECT *, {INDEX} - row_number() OVER (PARTITION BY segment ORDER BY bucket) AS r FROM entries),
                e_run AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY bucket DESC) AS back FROM (SELECT *, max(r) OVER (PARTITION BY segment) AS top FROM e_marked) WHERE r = top),
                proof AS (SELECT segment, count(*) AS n, max(bucket) AS last, round(sum(abs(predicted - actual)) * 100 / nullif(sum(abs(actual)), 0), 4) AS w, round(sum(abs(baseline - actual)) * 100 / nullif(sum(abs(actual)), 0), 4) AS b
                    FROM e_run WHERE back <= 12 GROUP BY 1),
                sized AS (SELECT segment, max(bucket) AS hi FROM run GROUP BY 1),
                seen AS (SELECT s.segment, count(*) AS seen FROM sized s JOIN monthly m ON m.segment = s.segment AND m.bucket BETWEEN hi - INTERVAL 11 MONTH AND hi WHERE NOT (year(bucket) = 1995 AND month(bucket) % 2 = 1) GROUP BY 1),
                naive AS (SELECT segment, round(sum(abs(predicted - actual)) * 100 / nullif(sum(abs(actual)), 0), 4) AS nw FROM long WHERE method = 'previous' AND actual IS NOT NULL GROUP BY 1)
                SELECT s.segment, hi, coalesce(seen, 0) AS seen, nw, coalesce(n, 0) AS n, last, w, b FROM sized s LEFT JOIN seen USING (segment) LEFT JOIN naive USING (segment) LEFT JOIN proof USING (segment)),
            r AS (SELECT segment, list_filter([CASE WHEN c.status <> 'available' THEN 'history' END, CASE WHEN date_diff('month', hi, DATE '{AS_OF}') > 1 THEN 'stale_training' END, CASE WHEN seen < 12 THEN 'coverage' END,
                CASE WHEN test_wape IS NULL OR test_wape >= 8 OR test_wape > nw THEN 'retrospective' END, CASE WHEN n < 12 THEN 'few_prospective_months' END,
                CASE WHEN n >= 12 AND date_diff('month', last, DATE '{AS_OF}') > 1 THEN 'stale_evidence' END, CASE WHEN n >= 12 AND (w IS NULL OR w >= 8) THEN 'error' END,
                CASE WHEN n >= 12 AND (w IS NULL OR b IS NULL OR w > b) THEN 'baseline' END], lambda x: x IS NOT NULL) AS rs FROM back JOIN chosen c USING (segment))
            SELECT segment, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS passed FROM r"""),
    ),
    "freshness": (
        lambda s: functools.reduce(DataFrame.union, [op.freshness(observed(s, u), END_OF_DATA, u, "segment").withColumn("unit", F.lit(u)) for u in ("day", "week", "month")]),
        sql(f""", {SNAPSHOT}, l AS (SELECT unit, segment, max(date_trunc(unit, day)::DATE) AS last_bucket FROM snap CROSS JOIN (VALUES ('day'), ('week'), ('month')) u(unit) GROUP BY 1, 2),
            n AS (SELECT *, greatest(date_diff(unit, last_bucket, DATE '{END_OF_DATA}') - 1, 0)::INTEGER AS missing FROM l),
            f AS (SELECT unit, segment, last_bucket, missing, CASE WHEN missing > 0 THEN 'stale' ELSE 'current' END AS state FROM n)
            SELECT * FROM f UNION ALL SELECT unit, 'combined', NULL, NULL, CASE WHEN bool_or(state = 'stale') THEN 'stale' ELSE 'current' END FROM f GROUP BY unit"""),
    ),
    "availability": (
        lambda s: op.availability(gappy(s), "segment"),
        sql(f", {GAPPY} SELECT segment, count(*) AS expected, count(value) AS available, count(*) = count(value) AS complete FROM dense GROUP BY 1"),
    ),
    "forecast_overlap": (
        lambda s: op.overlapping(forecasts(s).select("segment", F.col("bucket").alias("period_start"), F.last_day("bucket").alias("period_end"), "value"), "1997-02-10", "1997-05-02"),
        sql(f", {FORECASTS} SELECT segment, bucket AS period_start, last_day(bucket) AS period_end, value FROM issued WHERE bucket <= DATE '1997-05-02' AND last_day(bucket) >= DATE '1997-02-10'"),
    ),
    "centered_window": (
        lambda s: op.centered_window(monthly(s).select("segment").distinct(), "1998-05-17", 3),
        sql(f""", {MONTHLY}, k AS (SELECT DISTINCT segment FROM monthly), b AS (SELECT unnest(generate_series(DATE '1998-02-01', DATE '1998-08-01', INTERVAL 1 MONTH))::DATE AS bucket)
            SELECT segment, bucket, least(bucket, DATE '1998-05-01') AS cutoff FROM k, b"""),
    ),
    "yearly_path": (
        lambda s: op.yearly_path(forecasts(s), "segment").withColumn("value", F.round("value", 1)),
        sql(f", {FORECASTS} SELECT segment, year(bucket)::INTEGER AS year, round(sum(value), 1) AS value FROM issued GROUP BY 1, 2 HAVING count(value) = 12"),
    ),
    "annual_outlook": (
        lambda s: op.annual_outlook(monthly(s).filter("bucket between date '1998-01-01' and date '1998-05-01'"), forecasts(s).filter("year(bucket) = 1998").select("segment", "bucket", "value"), "1998-05-17", "segment"),
        sql(f""", {FORECASTS}, a AS (SELECT * FROM monthly WHERE bucket BETWEEN DATE '1998-01-01' AND DATE '1998-05-01'), f AS (SELECT segment, bucket, value FROM issued WHERE year(bucket) = 1998),
            b AS (SELECT segment, bucket, a.value AS a, f.value AS f FROM a FULL JOIN f USING (segment, bucket)),
            v AS (SELECT segment, CASE WHEN bucket < DATE '1998-05-01' THEN a WHEN bucket = DATE '1998-05-01' THEN greatest(a, f) ELSE f END AS v FROM b)
            SELECT segment, CASE WHEN count(v) = 12 THEN round(sum(v), 2) END AS outlook FROM v GROUP BY 1"""),
    ),
    "issue_forecasts": (
        lambda s: op.issue(
            forecasts(s).select("segment", F.explode(F.array(F.add_months("bucket", -2), F.add_months("bucket", -1))).alias("origin"), "bucket", "value"), monthly(s), "1998-05-17", "segment"
        ),
        sql(f"""{', ' + FORECASTS} SELECT i.segment, i.bucket, (i.bucket - INTERVAL 2 MONTH)::DATE AS origin, i.value,
            (SELECT arg_max(m.value, m.bucket) FROM monthly m WHERE m.segment = i.segment AND m.bucket < DATE '1998-05-01') AS reference FROM issued i WHERE i.bucket > DATE '1998-05-17'"""),
    ),
    "range_report": (
        lambda s: op.range_report(
            monthly(s).select("segment").distinct(), monthly(s), forecasts(s).filter(month_index("bucket") % 2 == 0).select("segment", "bucket", "value"),
            predictions(s).filter("method = 'mean_3'").select("segment", "bucket", F.round("predicted", 3).alias("value")), "1997-02-01", "1998-09-30", "segment",
        ).withColumn("error", F.round("error", 2)),
        sql(f""", {FORECASTS}, k AS (SELECT DISTINCT segment FROM monthly), b AS (SELECT unnest(generate_series(DATE '1997-02-01', DATE '1998-09-30', INTERVAL 1 MONTH))::DATE AS bucket),
            f AS (SELECT segment, bucket, value FROM issued WHERE ({INDEX}) % 2 = 0), t AS (SELECT segment, bucket, round(predicted, 3) AS value FROM long WHERE method = 'mean_3' AND actual IS NOT NULL)
            SELECT k.segment, b.bucket, m.value AS actual, coalesce(f.value, t.value) AS predicted, CASE WHEN f.value IS NOT NULL THEN 'issued' WHEN t.value IS NOT NULL THEN 'test' END AS basis,
                round(round(abs(coalesce(f.value, t.value) - m.value), 4), 2) AS error FROM k CROSS JOIN b
            LEFT JOIN monthly m USING (segment, bucket) LEFT JOIN f USING (segment, bucket) LEFT JOIN t USING (segment, bucket)"""),
    ),
}
