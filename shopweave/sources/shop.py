"""The shop's tables, read from the driver's order, line, part, customer and event tables.

Money is decimal(20,2), quantities and prices decimal(10,2), built from whole cents. Every property is a declarative
plan: only the columns a query uses are read, and filters reach the Parquet scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CENTS = "cast(cast({} as decimal(20,0)) / 100 as decimal({},2))"


class Shop:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def receipts(self) -> DataFrame:
        """A row per receipt. customer_id is null for walk-in sales; moved_day is when the goods moved, day when the sale counts.

        explicit_segment and source_label are what a source recorded of segment and customer; live receipts have no segment of their own.
        """
        customers = self.table("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), "c_mktsegment")
        orders = self.table("orders").selectExpr(
            "o_orderkey as id",
            "if(o_orderkey % 10 = 0, null, o_custkey) as customer_id",
            "o_custkey",
            "o_orderdate as created_at",
            "to_date(o_orderdate) as day",
            "to_date(if(o_orderkey % 4 = 1, o_orderdate + interval 3 days, o_orderdate)) as moved_day",
            "o_orderkey % 4 = 1 as encoded_later",
            CENTS.format("round(o_totalprice * 100)", 20) + " as amount",
            "o_orderkey % 20 = 3 as voided",
            "case o_orderstatus when 'F' then 'paid' when 'O' then 'pending' else 'unknown' end as status",
            "case o_custkey % 3 when 0 then 'cash' when 1 then 'online' else 'unknown' end as method",
            "o_orderkey % 7 as handled_by",
            "if(o_orderkey % 50 = 7, concat('2026:', lpad(cast(o_orderkey % 1000000 as string), 6, '0')), concat('S:', o_orderkey)) as reference",
            "concat(if(o_orderkey % 13 = 0, ' si', 'SI'), lpad(cast((o_orderkey * 7) % 5000 as string), 4, '0')) as invoice",
            "if(o_orderkey % 4 = 0, 'automatic', 'paper') as invoice_source",
        )
        segment = """case when id % 97 = 0 then 'unclassified' when customer_id is null then 'regular'
            when c_mktsegment = 'MACHINERY' then 'feeding' else 'regular' end"""
        label = """case when customer_id is null then 'outlet sales' when c_mktsegment <> 'MACHINERY' then customer_name
            else element_at(array('feeding deped - second batch', 'Rizal  feeding (north)', 'depedx milk', 'Féeding DSWD'), cast(customer_id % 4 as int) + 1) end"""
        named = orders.join(customers, "customer_id", "left").withColumn("segment", F.expr(segment)).withColumn("label", F.expr(label)).drop("c_mktsegment")
        source = "case when id % 8 = 4 then concat(' ', label, ' ') when customer_id is null and id % 3 = 0 then concat('Stall  ', id % 7) else '' end"
        return named.withColumn("explicit_segment", F.expr("if(id % 4 = 0, null, segment)")).withColumn("source_label", F.expr(source))

    @cached_property
    def lines(self) -> DataFrame:
        """A row per receipt line. subtotal may be null; snap_* are the product's data at the time of sale, or null.

        entered_quantity and entered_amount are what was written down: some lines have no amount, a negative one, or no quantity.
        """
        price = "floor((2 * round(l_extendedprice * 100) + l_quantity) / (2 * l_quantity))"
        return self.table("lineitem").selectExpr(
            "l_orderkey as receipt_id",
            "l_linenumber as line",
            "l_partkey as product_id",
            "l_suppkey",
            "l_partkey * 1000 + l_suppkey % 1000 as batch_id",
            "cast(l_quantity as decimal(10,2)) as quantity",
            CENTS.format(price, 10) + " as price",
            "if(l_returnflag = 'N', null, " + CENTS.format("round(l_extendedprice * 100)", 20) + ") as subtotal",
            "if(l_linestatus = 'O', null, concat('part ', l_partkey % 50)) as snap_name",
            "to_date(l_shipdate) as shipped",
            "l_extendedprice",
        ).withColumn("amount", F.expr("cast(coalesce(subtotal, quantity * price) as decimal(20,2))")).withColumns({
            "entered_amount": F.expr("case when line <> 1 then amount when receipt_id % 45 = 9 then null when receipt_id % 45 = 18 then -amount else amount end"),
            "entered_quantity": F.expr("if(line = 1 and receipt_id % 45 = 27, cast(0 as decimal(10,2)), quantity)"),
        })

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey as product_id",
            "p_name as name",
            "if(p_partkey % 3 = 0, '', p_brand) as variant",
            "p_type as category",
            "if(p_size % 2 = 0, 'L', 'unit') as unit",
            "p_partkey % 25 <> 0 as active",
            "p_size as size",
            "case p_partkey % 10 when 1 then 'non_dairy' when 2 then null else 'dairy' end as decision",
        )

    @cached_property
    def batches(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.to_date("l_shipdate")).alias("first"), F.sum("l_quantity").alias("sold"))
        size = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
        return lines.join(size, "l_partkey").selectExpr(
            "l_partkey * 1000 + l_suppkey % 1000 as batch_id",
            "l_partkey as product_id",
            "date_sub(first, 30) as received",
            "date_add(date_sub(first, 30), cast(10 + p_size * 60 as int)) as expiry",
            "cast(sold + 50 as decimal(12,2)) as initial",
            "cast(if((l_partkey + l_suppkey) % 5 = 0, 0, 50) as decimal(12,2)) as remaining",
            "case (l_partkey + l_suppkey) % 17 when 0 then 'expired' when 1 then 'disposed' else 'available' end as status",
            "l_suppkey % 31 = 0 as reference_only",
        )

    @cached_property
    def adjustments(self) -> DataFrame:
        return self.table("lineitem").filter("l_orderkey % 11 = 0").selectExpr(
            "l_partkey * 1000 + l_suppkey % 1000 as batch_id",
            "element_at(array('correction', 'damage', 'spoilage', 'free_taste', 'expired', 'theft', 'sample', 'other'), cast(l_linenumber % 8 as int) + 1) as kind",
            "cast(if(l_linenumber % 3 = 0, -l_quantity, l_quantity) as decimal(12,2)) as quantity",
            "date_add(to_date(l_shipdate), 5) as day",
            "l_orderkey as id",
        )

    @cached_property
    def returns(self) -> DataFrame:
        """Stock that came back from lines of voided receipts."""
        lines = self.lines.filter("receipt_id % 40 = 3").select("receipt_id", "batch_id", "product_id", "quantity")
        return lines.join(self.receipts.filter("voided").select(F.col("id").alias("receipt_id"), "day"), "receipt_id").selectExpr(
            "receipt_id", "batch_id", "product_id", "cast(floor(quantity / 2) as decimal(12,2)) as quantity", "date_add(day, 10) as day"
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey as customer_id", "c_name as name", "c_nationkey as nation", "c_mktsegment as market", "c_acctbal as balance")

    @cached_property
    def submissions(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id", "user_id", "event_id % 700 as request_id", "event_type as endpoint", "cast(floor(value / 100) as bigint) as payload", "ts", "value"
        )
