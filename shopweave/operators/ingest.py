"""Raw sales sheets to receipts, names to customers and products, and what to merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopweave.functions.columns import clean_label, match_key, parse_money
from shopweave.sources.scratch import written


def source_date(text: Column, sheet_year: Column | int) -> Column:
    """A date written m/d/y or y-m-d; two-digit years, 223 for 2023; a swap of month and day is put right."""
    t = F.trim(text)
    dated = F.when(t.rlike(r"^\d{1,2}[/.]\d{1,2}[/.]\d{2,4}$"), F.regexp_replace(t, r"(?<=[/.])(?:0{0,2}|0?2)(\d\d)$", "20$1"))
    read = lambda order: F.try_to_timestamp(F.regexp_replace(dated, r"^(\d+)[/.](\d+)[/.](\d+)$", order), F.lit("y-M-d"))
    iso = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t), F.lit("y-M-d"))
    return F.coalesce(iso, read("$3-$1-$2"), read("$3-$2-$1")).cast("date")


def _reviewed(text: Column, aliases: dict[str, str] | None) -> Column:
    """The reviewed name for this text, null if there is none; aliases is a short table kept by hand."""
    if not aliases:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), text)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, however often then names it: written out, long expressions within each other multiply."""
    return F.transform(F.array(value), then)[0]


def canonical_customer(label: Column, aliases: dict[str, str] | None = None, groups: dict[str, str] | None = None) -> Column:
    """A customer's name without marks of cancelled sales and invoice numbers; outlet sales and walk-ins are one name each.

    aliases: reviewed names by lower-case label; groups: reviewed names by label without spaces and punctuation. Null if nothing is left.
    """
    bare = F.regexp_replace(clean_label(label), r"(?i)\(?\s*cancelled\s*\)?", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[ \-_/]+|[ \-_/]+$", ""), r"(?i)\(SI\d+\)", ""))

    def known(plain: Column) -> Column:
        key = F.lower(plain)
        return clean_label(F.coalesce(_reviewed(key, aliases), _reviewed(F.regexp_replace(key, r"\.+$", ""), aliases), plain))

    def grouped(named: Column) -> Column:
        return F.coalesce(_reviewed(F.lower(F.regexp_replace(named, r"[\s._()'’\-]+", "")), groups), named)

    def whole(t: Column) -> Column:
        walk_in = F.lower(t).startswith("walk-in") | F.lower(t).startswith("walk in")
        name = _once(_once(F.trim(F.regexp_replace(t, r"(?i)/\s*walk-in\b", "")), known), grouped)
        return F.when(F.lower(t).startswith("outlet sales"), "Outlet Sales").when(walk_in, "Walk-in").otherwise(F.nullif(name, F.lit("")))

    return _once(bare, whole)


def canonical_product(label: Column, names: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """A product's reviewed name, else its label, codes of letters and a size in upper case.

    names: reviewed names by match_key; aliases: by lower-case label.
    """
    t = clean_label(label)
    t = F.coalesce(_reviewed(match_key(t), names), t)
    key = F.lower(t)
    code = key.rlike(r"^[a-z]{1,5}\d{2,4}$") | key.rlike(r"^pd[lx ]+\d{2,3}$")
    return F.coalesce(_reviewed(key, aliases), F.when(code, F.upper(t)), t)


# Which product names belong to which category; the first that fits counts, at the start, as a whole, or anywhere.
MILK_STARTS = ("raw milk", "raw300", "fml", "cml", "fm", "cm", "tm", "mm", "pm", "bb", "sb", "cara", "melon", "pandan", "ube", "low fat", "toned milk", "pasteurized milk")
MILK_NAMES = ("ml", "m300", "m200", "mml", "uns l", "sdl", "sd300", "pyl", "p300", "p200", "pml", "ice", "raw")
CHEESE_WORDS = ("cheese", "mozza", "yogurt", "yoghurt", "paneer")
CHEESE_NAMES = ("wc", "mog")
SNACK_WORDS = ("ice candy", "pastillas", "pdl", "polvoron", "peanut", "chips", "choco", "cone bite", "butcheron", "banana strips", "barquillos", "cornick", "dried fruit")


def category_of(name: Column) -> Column:
    """The category that a product's name tells."""
    key = F.lower(name)
    anywhere = lambda words: key.rlike("|".join(words))
    return (
        F.when(key.rlike("^(" + "|".join(MILK_STARTS) + ")") | key.isin(*MILK_NAMES), "Milk & Dairy Drinks")
        .when(anywhere(CHEESE_WORDS) | key.isin(*CHEESE_NAMES), "Cheese & Cultured Dairy").when(anywhere(SNACK_WORDS), "Snacks & Desserts").otherwise("Other Products")
    )


def with_aliases(names: DataFrame, aliases: DataFrame, key: str = "key") -> DataFrame:
    """names with column canonical: the reviewed alias of the match key, else the name itself; aliases (key, alias) are distinct."""
    return names.withColumn(key, match_key(F.col("name"))).join(aliases, key, "left").withColumn("canonical", F.coalesce("alias", "name")).drop("alias")


SHEET = "workbook string, sheet string, row int, c0 string, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string, c7 string, formula string"
TICKETS = "workbook string, sheet string, ticket_row int, day date, customer string, invoice string, separate boolean, lines int, amount double, discount double, closed boolean"
#: Rows of a sheet that are looked at together before what holds at their ends is carried on.
BLOCK = 20_000
#: Blocks, of all sheets, that are few enough to be sent to every executor.
FEW_BLOCKS = 2_000_000


def _cells(rows: DataFrame) -> DataFrame:
    """What the cells of SHEET rows say: day, labels, whole cents, and what the formula of the total adds up. Rows of a month's total go."""
    label = lambda c: F.coalesce(clean_label(F.nullif(c, F.lit(""))), F.lit(""))
    # A cast that fails is an error made and caught: a row without formula or number is not asked.
    formula = F.nullif("formula", F.lit(""))
    ref = lambda pattern, k: F.nullif(F.regexp_extract(formula, pattern, k), F.lit("")).try_cast("int")
    sums, cell = r"(?i)^=SUM\(\$?G\$?(\d+):\$?G\$?(\d+)\)$", r"(?i)^=\$?G\$?(\d+)$"
    cents = lambda x: F.round(x * 100).cast("long")
    text = lambda c: F.nullif(c, F.lit(""))
    # As one array the numbers are one small piece of code; written out four times, the method is too long for the JVM to compile.
    numbers = F.transform(F.array(text("c4"), text("c5"), text("c6"), F.when(text("c7").rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.col("c7"))), parse_money)
    read = rows.select(
        "workbook", "sheet", "row", text("c0").alias("c0"), label("c1").alias("customer"), label("c2").alias("invoice"), label("c3").alias("product"), numbers.alias("numbers"),
        ref(sums, 1).alias("top"), ref(sums, 2).alias("bottom"), ref(cell, 1).alias("alone"),
    )
    quantity, price, amount, number = (F.col("numbers")[k] for k in range(4))
    return read.filter(F.upper(label("c0")) != "TOTAL").select(
        "workbook", "sheet", "row", source_date(F.col("c0"), 0).alias("day"), "customer", "invoice", (F.col("product") != "").alias("sold"), F.col("product").rlike(r"(?i)^discoun\s*t$").alias("discount"),
        F.coalesce(quantity > 0, F.lit(False)).alias("counts"), price.isNotNull().alias("priced"), cents(amount).alias("cents"),
        cents(F.coalesce(amount, F.round(quantity * price, 2))).alias("worth"), cents(number).alias("reported"),
        F.when(F.col("bottom") == F.col("row"), F.col("top")).alias("sums_from"), F.coalesce(F.col("alone") == F.col("row"), F.lit(False)).alias("own_total"),
    )


def _chunks(cells: DataFrame) -> DataFrame:
    """cells with segment, the chunk of the sheet that a row is in, and holds, the day that holds at a chunk's first row.

    A chunk begins with the first row of a block that begins a receipt whatever came before, and ends before the next such row of a later
    block. Such rows have a customer, or an invoice other than the last one named. Each block of a sheet tells its last day and invoice
    and that row from the rows that name something; these are carried over the blocks of the sheet and meet the rows again.
    """
    sheet = ["workbook", "sheet"]
    row = Window.partitionBy(*sheet, "block").orderBy("row")
    above, so_far = row.rowsBetween(Window.unboundedPreceding, -1), row.rowsBetween(Window.unboundedPreceding, 0)
    customer, invoice = F.col("customer") != "", F.col("invoice") != ""
    cells = cells.withColumn("block", F.expr(f"row div {BLOCK}"))
    telling = cells.filter(customer | invoice | F.col("day").isNotNull()).withColumn("named", F.when(customer | invoice, F.col("invoice")))
    telling = telling.withColumn("before", F.last("named", True).over(above)).withColumn("held", F.last("day", True).over(so_far))
    latest = lambda test, what: F.max(F.when(test, F.struct("row", what)))[what]
    ends = telling.groupBy(*sheet, "block").agg(
        latest(F.col("day").isNotNull(), "day").alias("day_out"), latest(F.col("named").isNotNull(), "named").alias("named_out"),
        F.min(F.when(customer | invoice & (F.col("before") != F.col("invoice")), F.struct("row", "held"))).alias("sure"),
        F.min(F.when(~customer & invoice & F.col("before").isNull(), F.struct("row", "invoice", "held"))).alias("open"),
    )
    ends = cells.select(*sheet, "block").distinct().join(ends, [*sheet, "block"], "left")
    earlier = Window.partitionBy(*sheet).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("named_in", F.last("named_out", True).over(earlier)).withColumn("day_in", F.last("day_out", True).over(earlier))
    other = F.col("open").isNotNull() & ~F.col("open.invoice").eqNullSafe(F.col("named_in"))
    ends = ends.withColumn("begin", F.when(other, F.struct("open.row", "open.held")).otherwise(F.col("sure")))
    home = F.last(F.when(F.col("begin").isNotNull(), F.col("block")), True).over(earlier)
    ends = written(ends.select(*sheet, "block", F.col("begin.row").alias("begin"), F.coalesce("begin.held", "day_in").alias("begin_day"), F.coalesce(home, F.lit(-1)).alias("home")))
    ends = F.broadcast(ends) if ends.count() <= FEW_BLOCKS else ends
    found = cells.join(ends, [*sheet, "block"])
    return found.withColumn("segment", F.expr("if(row >= begin, block, home)")).withColumn("holds", F.expr("if(row = begin, begin_day, null)"))


@dataclass
class Ticket:
    """A receipt that the next rows may go on with: worth and discount in cents, what its total says, its first line's row."""

    workbook: str
    sheet: str
    row: int
    day: int | None
    customer: str
    invoice: str
    separate: bool
    lines: int = 0
    unpriced: int = 0
    cents: int = 0
    discount: int = 0
    reported: int | None = None
    first: int | None = None
    closed: bool = False


KEY = ("workbook", "sheet", "segment")


def _fresh(batch: pa.RecordBatch, last: tuple | None) -> np.ndarray:
    """Which rows have another key than the row before; last is the key of the row before the batch."""
    fresh = np.zeros(batch.num_rows, bool)
    for name in KEY:
        codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    fresh[0] = last != _key(batch, 0)
    return fresh


def _key(batch: pa.RecordBatch, row: int) -> tuple:
    return tuple(batch.column(name)[row].as_py() for name in KEY)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with the day that holds in each, from holds of a segment's first row on; rows that tell at most a date go."""
    last, day = None, pa.scalar(None, pa.date32())
    for batch in batches:
        if not batch.num_rows:
            continue
        told = pc.coalesce(batch.column("holds"), batch.column("day"))
        at = np.where(told.is_valid().to_numpy(zero_copy_only=False) | _fresh(batch, last), np.arange(batch.num_rows), -1)
        # Place 0 is what held before the batch.
        held = pa.concat_arrays([pa.array([day.as_py()], pa.date32()), told]).take(pa.array(np.maximum.accumulate(at) + 1))
        last, day = _key(batch, batch.num_rows - 1), held[-1]
        says = pc.or_(batch.column("sold"), pc.or_(pc.not_equal(batch.column("customer"), ""), pc.not_equal(batch.column("invoice"), "")))
        yield batch.set_column(batch.schema.get_field_index("holds"), "holds", held).filter(says)


def _next(test: np.ndarray) -> np.ndarray:
    """For each place, and the one after the last, the first place from it on where test holds; len(test) if there is none."""
    at = np.where(np.append(test, True), np.arange(len(test) + 1), len(test))
    return np.minimum.accumulate(at[::-1])[::-1]


def _latest(test: np.ndarray) -> np.ndarray:
    """For each place the last place up to it where test holds; -1 if there is none."""
    return np.maximum.accumulate(np.where(test, np.arange(len(test)), -1))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Receipts of rows in order of sheet, segment and row. Rows that name or total something are asked one by one whether they begin
    a receipt; what receipts come to is summed by batch. One receipt is held from batch to batch, as a few numbers, however long it is."""
    last, now = None, None
    kinds = [pa.string(), pa.string(), pa.int32(), pa.date32(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
    names = [c.split()[0] for c in TICKETS.split(", ")]

    def made(cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def one(t: Ticket) -> pa.RecordBatch:
        whole = t.reported if t.reported is not None and t.unpriced else t.cents + t.discount
        day = pa.array([t.day], pa.int32()).cast(pa.date32())
        return made([[t.workbook], [t.sheet], [t.row], day, [t.customer], [t.invoice], [t.separate], [t.lines], [whole / 100], [t.discount / 100], [t.closed]])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fresh = _fresh(batch, last)
        last = _key(batch, n - 1)
        flag = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        given = lambda name: batch.column(name).is_valid().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        number = lambda name: batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        named, invoiced = (pc.not_equal(batch.column(c), "").to_numpy(zero_copy_only=False) for c in ("customer", "invoice"))
        days, holds = (batch.column(c).cast(pa.int32()) for c in ("day", "holds"))
        sold, discount, row = flag("sold"), flag("discount"), number("row")
        counting = sold & ~discount & flag("counts")
        sums, summed, worth, reported = number("sums_from"), given("sums_from"), number("worth"), number("reported")
        line, plain = _next(counting), _latest(~discount)
        alone = flag("own_total") & sold & ~named & ~invoiced

        def closed(start: int, end: int) -> bool:
            """Whether a SUM has closed the receipt of rows start up to end; a receipt held over has start -1."""
            over = start < 0 and now.lines  # noqa: B023
            at = line[max(start, 0)]  # noqa: B023
            if not over and at >= end or plain[end - 1] < 0:  # noqa: B023
                return bool(over and now.closed)  # noqa: B023
            j = plain[end - 1]  # noqa: B023
            return bool(summed[j] and sums[j] == (now.first if over else row[at]))  # noqa: B023

        starts, separate = [], []
        ask = np.flatnonzero(fresh | named | invoiced | given("day") | alone)
        texts = batch.column("invoice").take(pa.array(ask)).to_pylist()
        asked = zip(ask.tolist(), fresh[ask].tolist(), named[ask].tolist(), texts, days.take(pa.array(ask)).to_pylist(), holds.take(pa.array(ask)).to_pylist(), alone[ask].tolist(), strict=True)
        start, invoice, day = (-1, now.invoice, now.day) if now is not None else (0, None, None)
        for i, first, by_name, text, dated, held, total in asked:
            apart = not first and total and (i > 0 or now is not None) and (closed(start, i) if i else now.closed)
            if first or apart or by_name or text and (text != invoice or held != day) or dated is not None and dated != day:
                starts.append(i)
                separate.append(apart)
                start, invoice, day = i, text, held
        goes_on = not starts or starts[0] > 0
        if not goes_on and now is not None:
            yield one(now)
            now = None
        begin = np.array([0] * goes_on + starts)
        end = np.append(begin[1:], n)
        first = line[begin]
        has_line = first < end
        leads = np.zeros(n, bool)
        leads[first[has_line]] = True
        if goes_on and now.lines:
            leads[: end[0]] = False
        # One amount beside several lines without price is that of them all: they stay unpriced.
        valued = counting & given("worth")
        priced_from = _next(valued & (flag("priced") | leads))[begin]
        if goes_on and now.unpriced < now.lines:
            priced_from[0] = 0
        known = valued & (np.arange(n) >= np.repeat(priced_from, end - begin))
        total_of = lambda x: np.add.reduceat(x.astype(np.int64), begin)  # noqa: B023, E731
        lines, cents, off = total_of(counting), total_of(np.where(known, worth, 0)), total_of(np.where(sold & discount, number("cents"), 0))
        unpriced = lines - total_of(known)
        told = _latest(given("reported"))[end - 1]
        says = told >= begin
        done = np.where(has_line, first, 0)
        ended = has_line & summed[plain[end - 1]] & (sums[plain[end - 1]] == row[done])
        if goes_on:
            now.closed = closed(-1, int(end[0]))
            now.first = now.first if now.lines or not has_line[0] else int(row[first[0]])
            now.lines, now.unpriced, now.cents, now.discount = now.lines + int(lines[0]), now.unpriced + int(unpriced[0]), now.cents + int(cents[0]), now.discount + int(off[0])
            now.reported = int(reported[told[0]]) if says[0] else now.reported
            if not starts:
                continue
            yield one(now)
        k = len(begin) - 1
        get = lambda name: batch.column(name)[int(begin[k])].as_py()  # noqa: B023, E731
        now = Ticket(
            get("workbook"), get("sheet"), get("row"), holds[int(begin[k])].as_py(), get("customer"), get("invoice"), separate[-1], int(lines[k]), int(unpriced[k]), int(cents[k]), int(off[k]),
            int(reported[told[k]]) if says[k] else None, int(row[first[k]]) if has_line[k] else None, bool(ended[k]),
        )
        out = slice(int(goes_on), k)
        if out.start < out.stop:
            take = lambda name: batch.column(name).take(pa.array(begin[out]))  # noqa: B023, E731
            whole = np.where(says & (unpriced > 0), reported[np.maximum(told, 0)], cents + off)
            yield made([take("workbook"), take("sheet"), take("row"), take("holds"), take("customer"), take("invoice"), separate[:-1], lines[out], whole[out] / 100, off[out] / 100, ended[out]])
    if now is not None:
        yield one(now)


def ticketize(rows: DataFrame) -> DataFrame:
    """Receipts (TICKETS) of sheet rows (SHEET: date, customer, invoice, product, quantity, price, amount, total; the total's formula).

    A date holds until the next one. A receipt begins with a customer, with another invoice or the same one on another date, with another
    date, or, where a SUM from its first line has closed the last receipt, with a line that neither names and that is totalled alone.
    Lines without a quantity above 0 count for nothing; a line without amount is worth quantity times price; discounts are added as
    written. A receipt with lines of unknown amount is worth what its total says, if that is a number. Rows without customer, invoice and product tell at most a date.

    Rows are dealt by chunks of sheets (see _chunks) and folded as a stream in order of rows: a sheet is read by many tasks, and none
    holds more than a batch. Cells null or blank are empty; a sheet without rows gives no receipts.
    """
    found = _chunks(written(_cells(rows)))
    found = found.select(*KEY, "row", "holds", "day", "customer", "invoice", "sold", "discount", "counts", "priced", "cents", "worth", "reported", "sums_from", "own_total")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, *KEY).sortWithinPartitions(*KEY, "row").mapInArrow(lambda batches: _fold(_held(batches)), TICKETS)


def issues(rows: DataFrame) -> DataFrame:
    """A row for everything wrong with a parsed line: rows (row_id, day, invoice, customer, amount)."""
    tests = ((F.col("day").isNull(), "invalid_date"), (F.col("invoice").isNull(), "missing_invoice"), (F.col("customer").isNull(), "missing_customer"), (F.col("amount").isNull(), "missing_amount"), (F.col("amount") < 0, "negative_amount"))
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests]))
    return rows.select("row_id", F.explode(found).alias("issue"))


def reconciled(parsed: DataFrame, reported: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Totals of both sides by key, their difference, and whether it is small enough."""
    left = parsed.groupBy(key).agg(F.sum("amount").alias("p"))
    right = reported.groupBy(key).agg(F.sum("amount").alias("r"))
    both = left.join(right, key, "full").na.fill(0, ["p", "r"]).withColumn("off", F.col("p") - F.col("r"))
    return both.select(key, F.col("p").cast("double").alias("parsed"), F.col("r").cast("double").alias("reported"), F.col("off").cast("double").alias("difference"), (F.abs("off") <= tolerance).alias("agrees"))


def cross_sheet_duplicates(tickets: DataFrame, keep: str, drop: str) -> DataFrame:
    """Tickets of sheet `drop` that sheet `keep` of the same workbook has too, by invoice and customer."""
    kept = tickets.filter(F.col("sheet") == keep).select("workbook", "invoice", "customer").distinct()
    return tickets.filter(F.col("sheet") == drop).join(kept, ["workbook", "invoice", "customer"], "left_semi")


def policy_split(lines: DataFrame) -> DataFrame:
    """(receipt_id, kept, excluded, held) of lines (receipt_id, decision, amount, discount): the discount falls by share of the gross, halves up.

    A receipt that mixes kept lines and others, one of them unpriced, is held back: nothing of it is kept.
    """
    zero = F.lit(0).cast("decimal(20,2)")
    keep = F.col("decision") == "dairy"
    sums = lines.groupBy("receipt_id").agg(
        F.coalesce(F.sum(F.when(keep, F.col("amount"))), zero).alias("k"), F.coalesce(F.sum("amount"), zero).alias("g"), F.max("discount").alias("d"),
        (F.bool_or(keep) & F.bool_or(~keep) & F.bool_or(F.col("amount").isNull())).alias("held"),
    )
    cents = F.expr("if(g = 0, 0, (2 * cast(d * 100 as decimal(18,0)) * cast(k * 100 as decimal(18,0)) + cast(g * 100 as decimal(18,0))) div (2 * cast(g * 100 as decimal(18,0))))")
    share = (cents / 100).cast("decimal(20,2)")
    kept, held = F.when(F.col("held"), zero).otherwise(F.col("k") - share), F.col("held")
    return sums.select("receipt_id", kept.cast("double").alias("kept"), (F.col("g") - F.col("d") - kept).cast("double").alias("excluded"), held)


def segment_of(label: Column, flags: Column) -> Column:
    """unclassified if there are quality flags, feeding if the label says so, else regular."""
    return F.when(F.size(flags) > 0, "unclassified").when(F.lower(label).contains("feedin"), "feeding").otherwise("regular")


def source_audit(receipts: DataFrame, splits: DataFrame) -> DataFrame:
    """Per year of source: all revenue, what is kept, excluded and unclassified."""
    joined = receipts.join(splits, receipts["id"] == splits["receipt_id"], "left")
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return joined.groupBy(F.year("day").alias("year")).agg(
        some("amount").alias("source"), F.round(F.coalesce(F.sum("kept"), F.lit(0.0)), 2).alias("kept"), F.round(F.coalesce(F.sum("excluded"), F.lit(0.0)), 2).alias("excluded"),
        some(F.when(F.col("segment") == "unclassified", F.col("amount"))).alias("unclassified"),
    )


def refresh_diff(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """new, updated, unchanged or removed for each key, by a hash of the other columns."""
    digest = lambda df, name: df.select(key, F.xxhash64(*[c for c in sorted(df.columns) if c != key]).alias(name))
    both = digest(new, "n").join(digest(stored, "s"), key, "full")
    verdict = F.when(F.col("s").isNull(), "new").when(F.col("n").isNull(), "removed").when(F.col("n") == F.col("s"), "unchanged").otherwise("updated")
    return both.select(key, verdict.alias("change"))


def catalog(lines: DataFrame) -> DataFrame:
    """Per product: the latest known price by (day, row), the first day it sold."""
    known = F.when(F.col("price") > 0, F.struct("shipped", "receipt_id", "line", "price"))
    return lines.groupBy("product_id").agg(F.max(known)["price"].cast("double").alias("price"), F.min("shipped").alias("first_sale"))


def usual_spelling(names: DataFrame) -> DataFrame:
    """Per key the spelling used most, ties by the spelling: names (key, spelling)."""
    counts = names.groupBy("key", "spelling").agg(F.count("*").alias("n"))
    best = counts.groupBy("key").agg(F.min(F.struct(-F.col("n"), F.col("spelling"))).alias("b"), F.sum("n").alias("uses"))
    return best.select("key", F.col("b.spelling").alias("spelling"), "uses")


def receipt_discount(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """subtotal = the larger of the lines' sum and the amount; discount = what it is over the amount."""
    sums = lines.groupBy(F.col("receipt_id").alias("id")).agg(F.sum(F.expr("cast(quantity * price as decimal(20,2))")).alias("gross"))
    rows = receipts.join(sums, "id", "left").withColumn("sub", F.greatest(F.coalesce("gross", F.lit(0)), F.col("amount")))
    return rows.select("id", F.col("sub").cast("double").alias("subtotal"), (F.col("sub") - F.col("amount")).cast("double").alias("discount"))


def product_keys() -> dict[str, Column]:
    """What makes two products one: name, unit and variant without regard to case and spaces at the ends."""
    return {"key": match_key(F.col("name")), "unit_key": F.lower(F.trim("unit")), "variant_key": F.lower(F.trim(F.coalesce("variant", F.lit(""))))}


def product_merge_plan(products: DataFrame) -> DataFrame:
    """Products with the same product_keys: the least id stays, with the shortest name, of several the one of the least id."""
    groups = products.withColumns(product_keys()).groupBy("key", "unit_key", "variant_key").agg(
        F.min("product_id").alias("keeper"), F.count("*").alias("members"), F.min(F.struct(F.length("name"), F.col("product_id"), F.col("name")))["name"].alias("name")
    )
    return groups.filter("members > 1")


def merge_map(products: DataFrame, plan: DataFrame) -> DataFrame:
    """(product_id, keeper) of every product that goes."""
    keys = list(product_keys())
    keyed = products.withColumns(product_keys()).select("product_id", *keys)
    return keyed.join(plan.select(*keys, "keeper"), keys).filter("product_id <> keeper").select("product_id", "keeper")


def merge_apply(table: DataFrame, mapping: DataFrame, key: str = "product_id") -> DataFrame:
    """Rows pointed at the keeper; keys that do not go stay."""
    names = table.columns
    to = mapping.select(F.col("product_id").alias(key), F.col("keeper").alias("_keeper"))
    return table.join(to, key, "left").withColumn(key, F.coalesce("_keeper", key)).select(*names)


def customer_merge_plan(customers: DataFrame, reviewed: tuple[str, ...] = (), aliases: dict[str, str] | None = None, groups: dict[str, str] | None = None) -> DataFrame:
    """Customers (customer_id, name, phone, email, address) with one canonical name: (key, keeper, members, decision, conflicts).

    They are for review where a contact differs (conflicting_contact), or where all are spelled alike, the name is not a reviewed
    one and no phone or email that all of them have confirms it (unconfirmed). The keeper has the canonical name already, else the least id.
    """
    fields = ("phone", "email", "address")
    rows = customers.withColumn("canonical", canonical_customer(F.col("name"), aliases, groups)).filter("canonical is not null")
    value = lambda c: F.nullif(F.lower(clean_label(F.col(c))), F.lit("")).alias(c)
    # Customers that are written alike become one row, so what a name's rows are compared by is told of few of them.
    alike = rows.groupBy("canonical", "name", *[value(c) for c in fields]).agg(F.min("customer_id").alias("customer_id"), F.count("*").alias("n"))
    # Whether there are several values is all that counts: least and greatest tell it.
    several = lambda c: F.when(F.min(c) == F.max(c), 1).when(F.min(c).isNotNull(), 2).otherwise(0)
    sums = alike.withColumns({"key": F.lower("canonical"), "spelling": F.lower(F.trim("name"))}).groupBy("key").agg(
        F.min(F.struct(F.col("name") != F.col("canonical"), F.col("customer_id")))["customer_id"].alias("keeper"), F.sum("n").alias("members"),
        F.min(F.struct("customer_id", "canonical"))["canonical"].alias("canonical"), several("spelling").alias("spellings"),
        *[several(c).alias(f"{c}_values") for c in fields], *[F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), F.lit(0)).alias(f"{c}_given") for c in fields],
    )
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"{c}_values") > 1, F.lit(c)) for c in fields]))
    sure = F.exists(F.array(*[(F.col(f"{c}_values") == 1) & (F.col(f"{c}_given") == F.col("members")) for c in ("phone", "email")]), lambda x: x)
    unsure = (F.col("spellings") == 1) & ~sure & (~F.col("canonical").isin(*reviewed) if reviewed else F.lit(True))
    decision = F.when(F.size(conflicts) > 0, "conflicting_contact").when(unsure, "unconfirmed").otherwise("merge")
    return sums.filter("members > 1").select("key", "keeper", "members", decision.alias("decision"), F.array_join(conflicts, ",").alias("conflicts"))


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def typed_sheet_rows(rows: DataFrame, year: int) -> DataFrame:
    """Sheet rows as (row_id, day, customer, invoice, product, quantity, price, amount)."""
    blank = lambda c: F.nullif(clean_label(F.col(c)), F.lit(""))
    return rows.select(
        F.concat_ws("/", "workbook", "sheet", "row").alias("row_id"), source_date(F.col("c0"), year).alias("day"), canonical_customer(F.col("c1")).alias("customer"), blank("c2").alias("invoice"),
        canonical_product(F.col("c3")).alias("product"), parse_money(F.col("c4")).alias("quantity"), parse_money(F.col("c5")).alias("price"), parse_money(F.col("c6")).alias("amount"),
    )


