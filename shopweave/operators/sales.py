"""Sales reports: filters, joins and aggregates over receipts and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.functions.columns import bucket, growth, money, month, product_label, week


def in_period(receipts: DataFrame, start: str, end: str) -> DataFrame:
    """Receipts that count, on local days from start to end, both included."""
    return receipts.filter(~F.col("voided") & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def with_attributes(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their product's data, those at the time of sale before today's."""
    named = lines.join(products.select("product_id", "name", "variant", "category", "unit", "decision"), "product_id", "left")
    return named.withColumn("name", F.coalesce("snap_name", "name"))


def sold_lines(receipts: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of these receipts with product data, day and payment method."""
    kept = receipts.select(F.col("id").alias("receipt_id"), "day", "method", "customer_id", "segment")
    return with_attributes(lines.join(kept, "receipt_id"), products)


def search_history(receipts: DataFrame, start: str, end: str, text: str, methods: tuple[str, ...], statuses: tuple[str, ...], voided: bool = False) -> DataFrame:
    """Receipts by date, payment and a piece of text in the invoice, the customer or the reference."""
    found = receipts.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("method").isin(*methods) & F.col("status").isin(*statuses))
    if not voided:
        found = found.filter(~F.col("voided"))
    part = F.lit(text.lower())
    anywhere = [F.coalesce(F.contains(F.lower(c), part), F.lit(False)) for c in ("invoice", "customer_name", "reference")]
    return found.filter(anywhere[0] | anywhere[1] | anywhere[2])


def order_dates(orders: DataFrame, receipts: DataFrame) -> DataFrame:
    """(order_id, day): the receipt's day, or the order's where there is none."""
    return orders.join(receipts.select(F.col("id").alias("order_id"), "day"), "order_id", "left").select("order_id", F.coalesce("day", "ordered").alias("day"))


def flags(receipts: DataFrame) -> DataFrame:
    """What a list of receipts shows beside the stored columns."""
    imported = F.col("reference").startswith("2026:")
    return receipts.select(
        "id", "day", F.col("encoded_later").alias("is_manually_encoded"),
        (~F.col("voided") & (F.col("status") != "paid") & ~imported).alias("can_update_payment"),
        F.when(~imported, F.col("handled_by")).alias("cashier"),
    )


def visible(receipts: DataFrame, lines: DataFrame, products: DataFrame, handler: int, hidden: tuple[str, ...]) -> DataFrame:
    """A handler's own receipts without any line of a hidden category; one such line hides the receipt."""
    bad = lines.join(products.filter(F.col("category").isin(*hidden)).select("product_id"), "product_id", "left_semi")
    mine = receipts.filter(F.col("handled_by") == handler)
    return mine.join(bad.select(F.col("receipt_id").alias("id")).distinct(), "id", "left_anti")


def decided(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with the product policy's decision; products without one are to be reviewed."""
    policy = products.select("product_id", "decision").dropna()
    return lines.join(policy, "product_id", "left").withColumn("decision", F.coalesce("decision", F.lit("review")))


def revenue_by(receipts: DataFrame, period: str) -> DataFrame:
    return receipts.groupBy(bucket("day", period).alias("bucket")).agg(money(F.sum("amount")).alias("total"))


def best_sellers(sold: DataFrame, top: int) -> DataFrame:
    """The products sold most; a product that changed its name or variant counts under each."""
    sums = sold.groupBy("product_id", "name", "variant").agg(F.sum("quantity").alias("q"))
    return sums.orderBy(F.desc("q"), "product_id", "name", "variant").limit(top).select("product_id", "name", "variant", money("q").alias("quantity"))


def by_category(sold: DataFrame) -> DataFrame:
    """Quantity per category and its share of all, in percent with one decimal."""
    sums = sold.groupBy("category").agg(F.sum("quantity").alias("q"))
    whole = sums.agg(F.sum("q").alias("all_q"))
    share = F.when(F.col("all_q") == 0, 0.0).otherwise(F.round(F.col("q").cast("double") * 100 / F.col("all_q").cast("double"), 1))
    return sums.join(F.broadcast(whole)).select("category", money("q").alias("quantity"), share.alias("percent"))  # one row


def summary(receipts: DataFrame) -> DataFrame:
    return receipts.agg(money(F.sum("amount")).alias("revenue"), F.count("*").alias("receipts"))


def compared(receipts: DataFrame, start: str, end: str, before_start: str, before_end: str) -> DataFrame:
    """Revenue and receipts of two windows in one pass, and their growth."""
    day = lambda text: F.lit(text).cast("date")
    now, before = F.col("day").between(day(start), day(end)), F.col("day").between(day(before_start), day(before_end))
    sums = receipts.filter(~F.col("voided") & (now | before)).agg(
        money(F.sum(F.when(now, F.col("amount")))).alias("revenue"),
        money(F.sum(F.when(before, F.col("amount")))).alias("revenue_before"),
        F.count(F.when(now, 1)).alias("receipts"),
        F.count(F.when(before, 1)).alias("receipts_before"),
    )
    return sums.withColumns(
        {"revenue_growth": growth(F.col("revenue"), F.col("revenue_before")), "receipts_growth": growth(F.col("receipts"), F.col("receipts_before"))}
    )


def drivers(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """Gross of the lines, net of the receipts, average ticket."""
    net = receipts.agg(F.sum("amount").alias("net"), F.count("*").alias("n"))
    gross = lines.join(receipts.select(F.col("id").alias("receipt_id")), "receipt_id", "left_semi").agg(F.sum("amount").alias("gross"))
    both = net.join(F.broadcast(gross))  # one row each
    ticket = F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("net").cast("double") / F.col("n"), 2))
    return both.select(money("gross").alias("gross"), money("net").alias("net"), ticket.alias("average_ticket"), F.col("n").alias("receipts"))


def payment_mix(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("method").agg(F.count("*").alias("receipts"), money(F.sum("amount")).alias("revenue"))


def mix(sold: DataFrame, *keys: str) -> DataFrame:
    """Gross and quantity by category, or by product name over all sizes and variants."""
    return sold.groupBy(*keys).agg(money(F.sum("amount")).alias("gross"), money(F.sum("quantity")).alias("quantity"))


def product_breakdown(sold: DataFrame) -> DataFrame:
    return sold.groupBy(product_label().alias("label")).agg(money(F.sum("amount")).alias("revenue"), money(F.sum("quantity")).alias("quantity")).orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("label"))


def calendar(spark, start: str, end: str, step: str = "1 day") -> DataFrame:
    return spark.sql(f"select explode(sequence(date '{start}', date '{end}', interval {step})) as bucket")


def daily_breakdown(receipts: DataFrame, start: str, end: str) -> DataFrame:
    """Every day of the range, nought where nothing was sold."""
    sums = receipts.groupBy(F.col("day").alias("bucket")).agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    days = calendar(receipts.sparkSession, start, end).join(sums, "bucket", "left")
    return days.select("bucket", money("s").alias("revenue"), F.coalesce("n", F.lit(0)).alias("receipts"))


def weekly_breakdown(receipts: DataFrame, start: str, end: str) -> DataFrame:
    """Weeks from Monday, the first and last cut at the range."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    sums = receipts.groupBy(week().alias("w")).agg(money(F.sum("amount")).alias("revenue"), F.count("*").alias("receipts"))
    return sums.select(F.greatest("w", s).alias("week_start"), F.least(F.date_add("w", 6), e).alias("week_end"), "revenue", "receipts")


def history_summary(receipts: DataFrame) -> DataFrame:
    out = [F.count("*").alias("receipts"), money(F.sum("amount")).alias("revenue")]
    for s in ("paid", "pending", "unknown"):
        out += [F.count(F.when(F.col("status") == s, 1)).alias(f"{s}_count"), money(F.sum(F.when(F.col("status") == s, F.col("amount")))).alias(f"{s}_amount")]
    return receipts.agg(*out)


def order_summary(receipts: DataFrame) -> DataFrame:
    """Orders in all, fulfilled, cancelled, waiting for payment, and what the live ones bring."""
    live = ~F.col("voided")
    return receipts.agg(
        F.count("*").alias("orders"),
        F.count(F.when(live, 1)).alias("fulfilled"),
        F.count(F.when(~live, 1)).alias("cancelled"),
        F.count(F.when(live & (F.col("status") == "pending"), 1)).alias("pending_payment"),
        money(F.sum(F.when(live, F.col("amount")))).alias("active_revenue"),
    )


def customer_totals(customers: DataFrame, receipts: DataFrame) -> DataFrame:
    """Every customer's receipts, last sale and lifetime total. Walk-in sales are left out before the shuffle."""
    sums = receipts.filter(~F.col("voided") & F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count("*").alias("n"), F.max("day").alias("last_day"), F.sum("amount").alias("s"))
    return customers.join(sums, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("receipts"), F.col("last_day").alias("last_sale"), money("s").alias("lifetime"))


def customer_accounts(receipts: DataFrame) -> DataFrame:
    paid = lambda s: money(F.sum(F.when(F.col("status") == s, F.col("amount"))))
    return receipts.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.max("customer_name").alias("name"), F.count("*").alias("purchases"), money(F.sum("amount")).alias("spent"), paid("paid").alias("paid"), paid("pending").alias("pending"),
        paid("unknown").alias("unknown"), F.count(F.when(F.col("status") == "pending", 1)).alias("pending_count"), F.max("day").alias("last_purchase"),
    )


def customer_month_grid(receipts: DataFrame, start: str, end: str) -> DataFrame:
    """Each customer of the range by each month of it, empty months included, months cut at the range's end."""
    sums = receipts.filter(F.col("customer_id").isNotNull()).groupBy("customer_id", month().alias("bucket")).agg(F.sum("amount").alias("s"))
    months = f"explode(sequence(trunc(date '{start}', 'month'), date '{end}', interval 1 month)) as bucket"
    grid = sums.select("customer_id").distinct().select("customer_id", F.expr(months))
    full = grid.join(sums, ["customer_id", "bucket"], "left")
    return full.select("customer_id", F.col("bucket").alias("month"), F.least(F.last_day("bucket"), F.lit(end).cast("date")).alias("month_end"), money("s").alias("spent"))


def customer_kpis(receipts: DataFrame, as_of: str) -> DataFrame:
    """Exact counts of customers by what they did, from one row per customer."""
    each = receipts.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count("*").alias("n"), F.sum("amount").alias("s"), F.max("day").alias("last_day"), F.max(F.col("status") == "pending").alias("pending")
    )
    recent = F.col("last_day") > F.date_sub(F.lit(as_of).cast("date"), 90)
    known = each.agg(
        F.count("*").alias("customers"), F.count(F.when(F.col("n") >= 2, 1)).alias("repeat_customers"), F.count(F.when(F.col("pending"), 1)).alias("pending_customers"),
        F.count(F.when(recent, 1)).alias("active_customers"), F.round(F.sum("s").cast("double") / F.count("*"), 2).alias("average_lifetime"),
    )
    unknown = receipts.filter(F.col("customer_id").isNull()).agg(money(F.sum("amount")).alias("unassigned_revenue"))
    return known.join(F.broadcast(unknown))  # one row each


def top_customers(accounts: DataFrame, top: int) -> DataFrame:
    return accounts.orderBy(F.desc("spent"), "name", "customer_id").limit(top).select("customer_id", "name", "spent")


def report_cube(sold: DataFrame) -> DataFrame:
    """The same sums by payment method, by category, by both, by month, and over all, from one scan."""
    sold = sold.withColumn("month", month())
    return sold.sparkSession.sql("""select method, category, month, cast(grouping_id(method, category, month) as bigint) as level,
        cast(sum(amount) as double) as gross, cast(sum(quantity) as double) as quantity, count(*) as rows
        from {sold} group by grouping sets ((method), (category), (method, category), (month), ())""", sold=sold)


def demo_split(receipts: DataFrame) -> DataFrame:
    """How many receipts are demo data by their reference, and how many are not."""
    return receipts.groupBy(F.col("reference").rlike("^2026:[0-9]{6}$").alias("demo")).agg(F.count("*").alias("receipts"))


def recent_orders(receipts: DataFrame, top: int) -> DataFrame:
    return receipts.filter("not voided").orderBy(F.desc("created_at"), F.desc("id")).limit(top)


def history_page(receipts: DataFrame, page: int, size: int) -> DataFrame:
    """A page of receipts by amount, largest first, unknown ones last; ties by id. The page is cut from a top-k, not a full sort."""
    size = min(size, 200)
    order = [F.desc_nulls_last("amount"), F.asc("id")]
    head = receipts.orderBy(*order).limit(page * size)
    return head.orderBy(*[F.asc_nulls_first("amount"), F.desc("id")]).limit(size) if page > 1 else head


def period_report(receipts: DataFrame, lines: DataFrame, products: DataFrame, start: str, end: str, before_start: str, before_end: str) -> DataFrame:
    """The report of a day, week or month in long form: (section, label, revenue, quantity), beside the period before.

    section total: revenue, previous, growth_percent, average_ticket and gross (lines as recorded); then payment, week, day, category,
    family (product name) and product (name and variant). The quantity is receipts, or pieces where lines are summed. Receipts and lines
    are read once each: both are summed to few cells, which count for all sections they belong to.
    """
    date = lambda d: F.lit(d).cast("date")
    entry = lambda section, label: F.struct(F.lit(section).alias("section"), label.cast("string").alias("label"))
    now, before = F.col("day").between(date(start), date(end)), F.col("day").between(date(before_start), date(before_end))
    each = receipts.filter(~F.col("voided") & (now | before)).groupBy("day", "method").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    calendar = receipts.sparkSession.sql(f"select explode(sequence(date '{start}', date '{end}')) as day, cast(null as string) as method, cast(null as decimal(38,2)) as s, 0l as n")
    places = F.array(
        entry("total", F.lit("revenue")), F.when(now & (F.col("n") > 0), entry("payment", F.col("method"))),
        F.when(now & (F.col("n") > 0), entry("week", F.greatest(week(), date(start)))), F.when(now, entry("day", F.col("day"))),
    )
    cells = each.unionByName(calendar).select("day", "s", "n", F.explode(F.array_compact(places)).alias("at"))
    sums = cells.groupBy("at.section", "at.label").agg(
        F.sum(F.when(now, F.col("s"))).alias("s"), F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("n"), F.sum(F.when(before, F.col("s"))).alias("ps"), F.sum(F.when(before, F.col("n"))).alias("pn"),
    )
    revenue, previous, count = money("s"), money("ps"), F.col("n").cast("double")
    line = lambda label, value, quantity=F.lit(None): F.struct(label.alias("label"), value.alias("revenue"), quantity.cast("double").alias("quantity"))
    totals = F.array(
        line(F.lit("revenue"), revenue, count), line(F.lit("previous"), previous, F.coalesce("pn", F.lit(0))), line(F.lit("growth_percent"), growth(revenue, previous)),
        line(F.lit("average_ticket"), F.when(F.col("n") > 0, F.round(revenue / count, 2)).otherwise(0.0)),
    )
    other = F.array(line(F.col("label"), revenue, F.when(F.col("section") != "day", count)))
    by_receipt = sums.select("section", F.explode(F.when(F.col("section") == "total", totals).otherwise(other)).alias("r")).select("section", "r.label", "r.revenue", "r.quantity")

    sold = sold_lines(in_period(receipts, start, end), lines, products).groupBy("category", "name", "variant").agg(F.sum("amount").alias("s"), F.sum("quantity").alias("q"))
    none = F.lit(None).cast("string")
    empty = receipts.sparkSession.range(1).select(none.alias("category"), none.alias("name"), none.alias("variant"), F.lit(None).cast("decimal(38,2)").alias("s"), F.lit(None).cast("decimal(38,2)").alias("q"), F.lit(True).alias("seed"))
    kinds = F.array(entry("category", F.col("category")), entry("family", F.col("name")), entry("product", product_label()))
    gross = F.array(entry("total", F.lit("gross")))
    spread = sold.withColumn("seed", F.lit(False)).unionByName(empty).select("s", "q", F.explode(F.when(F.col("seed"), gross).otherwise(F.concat(gross, kinds))).alias("at"))
    by_line = spread.groupBy("at.section", "at.label").agg(money(F.sum("s")).alias("revenue"), money(F.sum("q")).alias("quantity"))
    return by_receipt.union(by_line)
