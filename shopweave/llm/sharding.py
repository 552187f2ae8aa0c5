"""Contiguous shards of near equal bytes: global prefix sums of sizes, cut at equal targets.

A document's size is the UTF-8 length of its text and one. Documents stand in ascending order of doc_id, and the place of each on
the line of all bytes comes from sums within ranges and totals of ranges (order.py): only (doc_id, size, checksum, row) are dealt
and sorted, never texts. Shard k takes the documents whose middle byte lies between k / n and (k + 1) / n of all bytes, so the
bytes of a shard differ from a share by no more than half the documents at its two ends. Sizes alone decide: a group of
equal texts is cut where a target falls within it, wherever one text is repeated more often than a share can hold.

`place` gives the assignment; `write_shards` writes the documents, with all their columns, into a folder for each shard, in
order: its ranges are cut where the assignment says, by comparing keys, without a join.

Defined results: null texts have size 1; rows without doc_id come first; rows of one doc_id stand in order of checksum, equal
rows in any order; very long texts are one document, and a shard that falls within one document stays empty. An empty table
gives no rows. Further columns are kept by `write_shards`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import numbered, parts, saved, shared_dir
from shopweave.llm.order import in_order

KEYS = ["doc_id", "text_crc32", "row"]


def keyed(doc_id: Column, text: Column, row: Column) -> list[Column]:
    """(doc_id, size, text_crc32, row)."""
    text = F.coalesce(text, F.lit(""))
    return [doc_id.cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), row.alias("row")]


def place(keys: DataFrame, n_shards: int, path: str) -> DataFrame:
    """keys (doc_id, size, text_crc32, row), a written table, with shard and slot: the row's place in its shard, from 0."""
    total = keys.agg(F.sum("size")).first()[0] or 1
    placed = in_order(keys, KEYS, "size", path)
    # Whole numbers of 38 digits: exact at any size.
    middle = (2 * F.col("before") + F.col("size")).cast("decimal(28,0)") * F.lit(n_shards).cast("decimal(9,0)")
    placed = placed.withColumn("shard", F.call_function("div", middle, F.lit(2 * total).cast("decimal(28,0)")).cast("int"))
    # At most one row for each shard.
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "row", "shard", (F.col("at") - F.col("first")).alias("slot"))


def assign(docs: DataFrame, n_shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, row, shard, slot) of documents (doc_id, text); texts are read once and not dealt."""
    folder = shared_dir(docs.sparkSession)
    keys = saved(docs.select(*keyed(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id())), f"{folder}/keys")
    return place(keys, n_shards, f"{folder}/ranges")


def folder_column(columns: list[str]) -> str:
    """`shard`, with underscores behind it where documents have such a column."""
    name = "shard"
    while name in map(str.lower, columns):
        name += "_"
    return name


def write_shards(docs: DataFrame, n_shards: int, target: str) -> DataFrame:
    """Write documents into target/shard=k, in order of slot file by file; returns bytes and rows of each shard."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    kept = numbered(docs, f"{folder}/kept")
    keys = saved(kept.select(*keyed(F.col("kept.doc_id"), F.col("kept.text"), F.col("row"))), f"{folder}/keys")
    placed = saved(place(keys, n_shards, f"{folder}/ranges"), f"{folder}/placed")
    # A null doc_id is the least, in structs as in the order.
    key = F.struct(*KEYS)
    cuts = placed.groupBy("shard").agg(F.min(key).alias("key")).orderBy("shard").collect()
    spans = [F.struct(F.struct(*[F.lit(v).cast("long") for v in c.key]).alias("key"), F.lit(c.shard).alias("shard")) for c in cuts]
    to = F.array_max(F.transform(F.filter(F.array(*spans), lambda s: s["key"] <= key), lambda s: s["shard"])) if spans else F.lit(0)
    dealt = kept.select("kept", *keyed(F.col("kept.doc_id"), F.col("kept.text"), F.col("row"))).withColumn("to", to)
    name = folder_column(docs.columns)
    order = [F.col(k).asc_nulls_first() for k in KEYS]
    dealt = dealt.repartitionByRange(parts(spark), *order).sortWithinPartitions("to", *order)
    rows = dealt.select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns], F.col("to").alias(name))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(name).parquet(target)
    return placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def op13_prefix_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return assign(docs, 8).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


#: crc32 of bytes by a table of 256 remainders, made by the recursion.
CRC_SQL = """bits AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), lut AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text that is not null; needs CRC_SQL's tables, lut being joined."""
    of_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {of_bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = f"""
WITH RECURSIVE {CRC_SQL},
sized AS (
  SELECT doc_id::BIGINT AS doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, lut
), line AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM sized
), cut AS (SELECT *, ((2 * before + size) * 8 // (2 * total))::INTEGER AS shard FROM line)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY before) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
