"""The sales ledger for forecasting: snapshots, exact-cent allocation, numbering, identity checks, exports."""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopweave.functions.columns import clean_label, money, month
from shopweave.sources.scratch import written

DEMO = "^2026:[0-9]{6}$"


def snapshot(receipts: DataFrame, decided_lines: DataFrame, as_of: str) -> DataFrame:
    """Receipts before as_of as (sale_id, day, customer_key, customer_name, segment, revenue), void and demo ones left out.

    A receipt whose source states a segment keeps it and its whole amount. The lines of others decide: all non-dairy, it is left out; a
    line to be reviewed, no line or a gross of nought or less, it is unclassified and whole; else its amount is shared by what its
    dairy lines are of all, and `feedin` in the customer's name makes it feeding. The customer is the linked one, else the source's label.
    """
    zero = F.lit(0).cast("decimal(20,2)")
    kept = receipts.filter(~F.col("voided") & (F.col("day") < F.lit(as_of).cast("date")) & ~F.col("reference").rlike(DEMO))
    stated = F.coalesce("explicit_segment", F.lit("")) != ""
    live = kept.filter(~stated).select(F.col("id").alias("receipt_id"))
    sums = decided_lines.join(live, "receipt_id", "left_semi").groupBy(F.col("receipt_id").alias("id")).agg(
        F.coalesce(F.sum(F.when(F.col("decision") == "dairy", F.col("amount"))), zero).alias("dairy"), F.sum("amount").alias("gross"),
        F.bool_and(F.col("decision") == "non_dairy").alias("none"), F.bool_or(F.col("decision") == "review").alias("review"),
    )
    rows = kept.withColumn("stated", stated).join(sums, "id", "left").filter(F.col("stated") | ~F.coalesce("none", F.lit(False)))
    unclear = F.col("gross").isNull() | F.col("review") | (F.col("gross") <= 0)
    # Cents times cents over cents, halves away from nought, in whole numbers.
    cents = F.expr("sign(dairy) * ((2 * cast(amount * 100 as decimal(38,0)) * cast(abs(dairy) * 100 as decimal(18,0)) + cast(gross * 100 as decimal(18,0))) div (2 * cast(gross * 100 as decimal(18,0))))")
    share = F.when(F.col("stated") | unclear, F.col("amount")).otherwise((cents / 100).cast("decimal(20,2)"))
    label = F.regexp_replace(F.coalesce("source_label", F.lit("")), r"^\s+|\s+$", "")
    name = F.when(label != "", label).otherwise(F.coalesce("customer_name", F.lit("Walk-in")))
    key = F.when(F.col("customer_id").isNotNull(), F.concat(F.lit("customer:"), F.col("customer_id"))).when(label != "", F.concat(F.lit("label:"), F.lower(clean_label(label)))).otherwise("walk-in")
    guessed = F.when(unclear, "unclassified").when(F.contains(F.lower(name), F.lit("feedin")), "feeding").otherwise("regular")
    segment = F.when(F.col("stated"), F.col("explicit_segment")).otherwise(guessed)
    return rows.select(F.col("id").alias("sale_id"), "day", key.alias("customer_key"), name.alias("customer_name"), segment.alias("segment"), share.alias("revenue"))


def at_cutoffs(sales: DataFrame, cutoffs: list[str]) -> DataFrame:
    """Totals before each of a few cutoffs: the ledger is summed by day first, and only days meet the cutoffs."""
    days = sales.groupBy("day").agg(F.sum("revenue").alias("r"), F.count("*").alias("n"))
    cuts = sales.sparkSession.createDataFrame([(c,) for c in cutoffs], "cutoff string").select(F.col("cutoff").cast("date").alias("cutoff"))
    met = F.broadcast(cuts).join(days, F.col("day") < F.col("cutoff"), "left")  # a handful of cutoffs
    return met.groupBy("cutoff").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sales"), money(F.sum("r")).alias("revenue"))


def allocated(lines: DataFrame, *order: str) -> DataFrame:
    """Each receipt's net over its lines by largest remainder, to the cent: lines (receipt_id, weight, net_cents, order).

    Weights are whole numbers. Every line gets the floor of its share; the cents left go to the largest remainders, ties in order.
    Receipts whose weights sum to nought get null.
    """
    all_lines = Window.partitionBy("receipt_id")
    rows = lines.withColumn("weights", F.sum("weight").over(all_lines)).withColumn("product", F.expr("cast(net_cents as decimal(38,0)) * cast(weight as decimal(18,0))"))
    rows = rows.withColumn("base", F.expr("if(weights > 0, product div weights, null)")).withColumn("rest", F.expr("if(weights > 0, cast(product - base * cast(weights as decimal(18,0)) as bigint), null)"))
    rank = F.row_number().over(all_lines.orderBy(F.desc("rest"), *order))
    rows = rows.withColumn("left", F.col("net_cents") - F.sum("base").over(all_lines)).withColumn("cents", F.col("base") + F.when(rank <= F.col("left"), 1).otherwise(0))
    return rows.drop("weights", "product", "base", "rest", "left")


#: The product of revenue that no line can take; no catalog has it.
UNALLOCATED = -1
LINE_ORDER = ("line", "product_id", "l_suppkey", "l_extendedprice", "shipped")


def dairy_lines(decided_lines: DataFrame, sales: DataFrame, *order: str) -> DataFrame:
    """Dairy lines of classified sales with their share of the sale's revenue: (receipt_id, day, segment, product_id, quantity, cents).

    A quantity of nought or less is unknown, so is a negative amount; one unknown amount, or a gross of nought, leaves the cents of
    all the sale's lines unknown.
    """
    kept = sales.filter("segment in ('regular', 'feeding')").select(F.col("sale_id").alias("receipt_id"), "day", "segment", F.expr("cast(revenue * 100 as bigint)").alias("net_cents"))
    rows = decided_lines.filter("decision = 'dairy'").join(kept, "receipt_id")
    rows = rows.withColumn("quantity", F.when(F.col("entered_quantity") > 0, F.col("entered_quantity")))
    known = F.expr("bool_and(entered_amount >= 0 and entered_amount is not null)").over(Window.partitionBy("receipt_id"))
    return allocated(rows.withColumn("weight", F.when(known, F.expr("cast(entered_amount * 100 as bigint)")).otherwise(0)), *(order or LINE_ORDER))


def item_facts(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """(day, segment, product_id, quantity, revenue, lines, unknown_quantity, unknown_revenue) from dairy_lines and the sales.

    Sums are of what is known, null where nothing is; unknown_* count the lines that are not. The revenue of sales that no line
    can take is product UNALLOCATED, of unknown quantity.
    """
    by = ("day", "segment", "product_id")
    none = lambda c: (F.count("*") - F.count(c)).alias(f"unknown_{'revenue' if c == 'cents' else c}")
    facts = lines.groupBy(*by).agg(F.sum("quantity").cast("double").alias("quantity"), F.sum("cents").alias("cents"), F.count("*").alias("lines"), none("quantity"), none("cents"))
    kept = sales.filter("segment in ('regular', 'feeding')").withColumnRenamed("sale_id", "receipt_id")
    lost = kept.join(lines.filter("cents is not null").select("receipt_id"), "receipt_id", "left_anti").withColumn("product_id", F.lit(UNALLOCATED).cast("long"))
    n = F.count("*")
    rest = lost.groupBy(*by).agg(F.lit(None).cast("double").alias("quantity"), F.sum(F.expr("cast(revenue * 100 as bigint)")).alias("cents"), n.alias("lines"), n.alias("unknown_quantity"), F.lit(0).cast("long").alias("unknown_revenue"))
    out = facts.withColumn("cents", F.col("cents").cast("long")).unionByName(rest)
    return out.select(*by, "quantity", (F.col("cents").cast("double") / 100).alias("revenue"), "lines", "unknown_quantity", "unknown_revenue")


def segment_monthly(sales: DataFrame) -> DataFrame:
    return sales.groupBy(month().alias("month"), "segment").agg(money(F.sum("revenue")).alias("revenue"), F.count("*").alias("receipts"), F.countDistinct("day").alias("days"))


def customer_profile(sales: DataFrame) -> DataFrame:
    """What each customer of the regular segment buys and how regularly; a lapse is measured from the last sale recorded at all.

    revenue_share is in percent of all regular revenue. Sales without customer or label are no customer: no median is taken of them.
    """
    # One row: the last day of all sales and what regular ones sum to.
    whole = sales.agg(F.max("day").alias("through"), F.sum(F.when(F.col("segment") == "regular", F.col("revenue"))).alias("total"))
    known = sales.filter("customer_key <> 'walk-in' and segment = 'regular'")
    days = known.select("customer_key", "day").distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("customer_key").orderBy("day")))
    gaps = days.select("customer_key", gap.alias("gap")).groupBy("customer_key").agg(
        F.expr("percentile(gap, 0.5)").alias("median_gap"), F.count("gap").alias("n_gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd_gap"), F.count("*").alias("purchase_days")
    )
    each = known.groupBy("customer_key").agg(
        F.count("*").alias("receipts"), F.countDistinct(month()).alias("active_months"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        money(F.sum("revenue")).alias("revenue"), F.expr("percentile(cast(revenue as double), 0.5)").alias("median_receipt"),
    )
    full = each.join(gaps, "customer_key").join(F.broadcast(whole))
    cv = F.when((F.col("n_gaps") >= 3) & (F.col("mean_gap") > 0), F.round(F.col("sd_gap") / F.col("mean_gap"), 6))
    since = F.datediff("through", "last_day")
    share = F.when(F.col("total") != 0, F.round(F.col("revenue") * 100 / F.col("total").cast("double"), 4))
    return full.select(
        "customer_key", "receipts", "purchase_days", "active_months", "first_day", "last_day", since.alias("days_since_last"), "revenue", share.alias("revenue_share"), "median_receipt", "median_gap", cv.alias("gap_cv"),
        F.when(F.col("n_gaps") > 0, since > F.greatest(F.lit(30.0), 3 * F.col("median_gap"))).alias("lapsed"),
    )


def customer_gaps(sales: DataFrame) -> DataFrame:
    days = sales.filter("customer_key <> 'walk-in' and segment = 'regular'").select("customer_key", "day").distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("customer_key").orderBy("day")))
    return days.select("customer_key", "day", gap.alias("gap")).filter("gap is not null")


def calendar_effects(sales: DataFrame) -> DataFrame:
    """Totals of the regular segment by weekday (Monday is 1) and by band of days of the month, each in full."""
    spark = sales.sparkSession
    days = sales.filter("segment = 'regular'").groupBy("day").agg(F.sum("revenue").alias("r"), F.count("*").alias("n"))
    band = F.least(F.floor((F.dayofmonth("day") - 1) / 7) + 1, F.lit(5)).cast("int")
    keys = [("weekday", k) for k in range(1, 8)] + [("band", k) for k in range(1, 6)]
    known = spark.createDataFrame(keys, "kind string, k int")
    cut = days.select(F.lit("weekday").alias("kind"), (F.weekday("day") + 1).cast("int").alias("k"), "r", "n").union(days.select(F.lit("band"), band, "r", "n"))
    return known.join(cut, ["kind", "k"], "left").groupBy("kind", "k").agg(money(F.sum("r")).alias("revenue"), F.coalesce(F.sum("n"), F.lit(0)).alias("receipts"))


def data_quality(receipts: DataFrame, sales: DataFrame, as_of: str) -> DataFrame:
    """Counts that tell how far to trust the snapshot."""
    before = receipts.filter(~F.col("voided") & (F.col("day") < F.lit(as_of).cast("date")))
    own = before.agg(F.count(F.when(F.col("reference").rlike(DEMO), 1)).alias("excluded_demo"), F.count("*").alias("receipts"))
    kept = sales.agg(
        F.count("*").alias("sales"), F.count(F.when(F.col("segment") == "unclassified", 1)).alias("unclassified"), F.count(F.when(F.col("segment") == "feeding", 1)).alias("feeding"),
        F.count(F.when(F.col("revenue") < 0, 1)).alias("negative"), F.count(F.when((F.col("segment") == "regular") & ~F.col("customer_key").startswith("customer:"), 1)).alias("unlinked"), F.datediff(F.lit(as_of).cast("date"), F.max("day")).alias("age_days"),
    )
    return own.join(F.broadcast(kept)).withColumn("excluded_non_dairy", F.expr("receipts - excluded_demo - sales"))  # one row each


#: SI and digits of a number below 2^63 - 1.
PLAIN_INVOICE = "invoice rlike '^SI[0-9]+$' and try_cast(substring(invoice, 3) as decimal(38,0)) < 9223372036854775807"


def invoice_text(number):
    """SI and the number in at least four digits."""
    text = number.cast("string")
    return F.concat(F.lit("SI"), F.when(number < 10000, F.lpad(text, 4, "0")).otherwise(text))


def invoice_taken(receipts: DataFrame) -> DataFrame:
    """(year, number) that new receipts cannot have: recorded in any case, with spaces around, in the very digits they would be written in."""
    rows = receipts.select(F.year("day").alias("year"), F.upper(F.trim("invoice")).alias("invoice")).filter(PLAIN_INVOICE)
    rows = rows.withColumn("number", F.substring("invoice", 3, 20).cast("long"))
    return rows.filter(F.col("invoice") == invoice_text(F.col("number"))).select("year", "number").distinct()


def invoice_seed(receipts: DataFrame) -> DataFrame:
    """Per year the plain SI number, in any case and with spaces around, of the receipt that was dated last, which need not be the largest."""
    plain = receipts.withColumn("invoice", F.upper(F.trim("invoice"))).filter(PLAIN_INVOICE)
    last = plain.groupBy(F.year("day").alias("year")).agg(F.max_by("invoice", F.struct("created_at", "id")).alias("invoice"))
    return last.select("year", F.substring("invoice", 3, 20).cast("long").alias("seed"))


#: Ids or numbers that are ranked in one window, or made in one row.
BLOCK = 100_000


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """rows with k, their rank within the year by key (whole numbers, each once a year): counts of blocks of keys are added up, so a window holds no more than a block."""
    block = F.expr(f"{key} div {BLOCK}")
    counts = rows.groupBy("year", block.alias("block")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("year").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("year", "block", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("year", "block").orderBy(key))
    return rows.withColumn("block", block).join(counts, ["year", "block"]).withColumn("k", F.col("before") + rank).drop("block", "before")


def invoice_assign(waiting: DataFrame, taken: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, year, invoice) for waiting receipts (id, year): the numbers after the year's seed that are not taken, in order of id.

    A year needs no more candidates than it has waiting and taken numbers. They are made by blocks, and numbers and receipts meet by
    rank within the year.
    """
    need = waiting.groupBy("year").agg(F.count("*").alias("n")).join(taken.groupBy("year").agg(F.count("*").alias("t")), "year", "left").join(seeds, "year", "left")
    need = need.select("year", (F.coalesce("seed", F.lit(0)) + 1).cast("long").alias("first"), (F.coalesce("seed", F.lit(0)) + F.col("n") + F.coalesce("t", F.lit(0))).cast("long").alias("last"))
    blocks = need.withColumn("b", F.explode(F.expr(f"sequence(first div {BLOCK}, last div {BLOCK})"))).repartition("year", "b")
    numbers = blocks.select("year", F.explode(F.expr(f"sequence(greatest(first, b * {BLOCK}), least(last, b * {BLOCK} + {BLOCK} - 1))")).alias("number"))
    free = numbers.join(taken.select("year", "number").distinct(), ["year", "number"], "left_anti")
    return ranked(waiting, "id").join(ranked(free, "number"), ["year", "k"]).select("id", "year", invoice_text(F.col("number")).alias("invoice"))


def invoice_duplicates(receipts: DataFrame) -> DataFrame:
    """Paper numbers that repeat within a year, without regard to case and spaces around."""
    paper = receipts.filter("invoice_source <> 'automatic'")
    return paper.groupBy(F.year("day").alias("year"), F.upper(F.trim("invoice")).alias("number")).agg(F.count("*").alias("receipts"), F.min("id").alias("first_id")).filter("receipts > 1")


def submission_conflicts(submissions: DataFrame) -> DataFrame:
    """Each submission beside the first with its (user_id, request_id): new, replay of the same content, or conflict."""
    first = submissions.groupBy("user_id", "request_id").agg(F.min(F.struct("ts", "event_id", "endpoint", "payload")).alias("f"))
    same = (F.col("endpoint") == F.col("f.endpoint")) & (F.col("payload") == F.col("f.payload"))
    label = F.when(F.col("event_id") == F.col("f.event_id"), "new").when(same, "replay").otherwise("conflict")
    return submissions.join(first, ["user_id", "request_id"]).select("event_id", "user_id", "request_id", label.alias("verdict"))


def fingerprint(table: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """One row that is equal for equal sets of rows in any order: count, and two sums over row hashes."""
    row = F.xxhash64(*[c for c in sorted(table.columns) if c not in without])
    return table.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("sum"))


def signatures(facts: DataFrame, *keys: str) -> DataFrame:
    """The fingerprint of each series, so that only changed ones are fitted again."""
    row = F.xxhash64(*[c for c in sorted(facts.columns)])
    return facts.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(row).alias("signature"))


def changed(now: DataFrame, saved: DataFrame, *keys: str) -> DataFrame:
    return now.join(saved, [*keys, "signature"], "left_anti")


def without_demo(table: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """Rows of a table that do not belong to demo receipts."""
    demo = receipts.filter(F.col("reference").rlike(DEMO)).select(F.col("id").alias(key))
    return table.join(demo, key, "left_anti")


def year_closure(receipts: DataFrame, lines: DataFrame, products: DataFrame, batches: DataFrame, customers: DataFrame, first: int, last: int) -> dict[str, DataFrame]:
    """The receipts of whole years and every row they refer to, table by table."""
    kept = receipts.filter(F.year("day").between(first, last) & ~F.col("reference").rlike(DEMO))
    own = lines.join(kept.select(F.col("id").alias("receipt_id")), "receipt_id", "left_semi")
    return {
        "receipt": kept, "line": own, "product": products.join(own.select("product_id").distinct(), "product_id", "left_semi"),
        "batch": batches.join(own.select("batch_id").distinct(), "batch_id", "left_semi"), "customer": customers.join(kept.select("customer_id").distinct(), "customer_id", "left_semi"),
    }


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, table in tables.items():
        row = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.union(row)
    return out


def export_years(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each table (receipts by year) and return the manifest: rows and fingerprint, observed while the rows were written."""
    spark, seen = next(iter(tables.values())).sparkSession, []
    for name, table in tables.items():
        row = F.xxhash64(*sorted(table.columns))
        note = Observation(f"export {name}")
        watched = table.observe(note, F.count("*").alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("sum"))
        if name == "receipt":
            watched.withColumn("year", F.year("day")).write.mode("overwrite").partitionBy("year").parquet(f"{folder}/{name}")
        else:
            watched.write.mode("overwrite").parquet(f"{folder}/{name}")
        found = note.get
        seen.append((name, found["rows"], found["xor"], found["sum"]))
    return spark.createDataFrame(seen, "table_name string, rows long, xor long, sum string")  # one row for each table


def verified_export(manifest: DataFrame, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """The manifest with whether the files read back have its fingerprints."""
    spark, parts = manifest.sparkSession, []
    for name, table in tables.items():
        back = spark.read.schema(table.schema).parquet(f"{folder}/{name}").select(*table.columns)  # without the folders' year
        parts.append(fingerprint(back).select(F.lit(name).alias("table_name"), F.col("rows").alias("r"), F.col("xor").alias("x"), F.col("sum").alias("s")))
    same = (F.col("rows") == F.col("r")) & (F.col("xor") == F.col("x")) & F.col("sum").eqNullSafe(F.col("s"))
    return manifest.join(functools.reduce(DataFrame.union, parts), "table_name").select("table_name", "rows", same.alias("verified"))


def append_once(new: DataFrame, folder: str, *keys: str, buckets: int = 64) -> int:
    """Add to a table only rows whose key it lacks; what is stored never changes. Returns how many were added.

    The table lies in folders by a hash of the key. A folder that gets new keys is written anew, whole, from its stored and its new rows,
    and replaced when the write is done; a key lives in one folder, so it can be in the table once only, whoever writes. Of two writers
    to one folder at a time the later one's folder stays: run it again for what is not there. Of rows that share a key the least counts.
    """
    spark, columns = new.sparkSession, new.columns
    rest = [c for c in columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*columns) if rest else new.distinct()
    once = once.withColumn("key_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    schema = T.StructType([*new.schema.fields, T.StructField("key_bucket", T.IntegerType())])
    try:
        stored = spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], schema)
    # Written before the table changes: the write below must not look at the table twice.
    held = stored.select(*[F.col(k).alias(f"stored_{k}") for k in keys])
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"stored_{k}")) for k in keys])
    fresh = written(once.join(held, same, "left_anti"))
    touched = [r.key_bucket for r in fresh.select("key_bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    note = Observation("append once")
    counted = fresh.observe(note, F.count("*").alias("added"))
    whole = stored.filter(F.col("key_bucket").isin(touched)).select(*schema.names).unionByName(counted.select(*schema.names))
    whole.repartition("key_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_bucket").parquet(folder)
    return note.get["added"]


def report_document(report: DataFrame, kind: str, made: str) -> DataFrame:
    """A small report as one nested document, ready for write.json."""
    rows = F.array_sort(F.collect_list(F.struct(*report.columns)))
    return report.agg(rows.alias("data")).select(F.lit(kind).alias("type"), F.lit(made).alias("generated_at"), "data")


