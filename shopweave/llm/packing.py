"""Packing documents into sequences of fixed length by the sum-of-squares rule.

A document's ids end with an end id. One longer than a sequence is cut into full pieces, its first piece being the
rest; full pieces need no packing. The other pieces are dealt at random into groups, each packed by itself: its pieces
come longest first, and each goes where the squared counts of open bins per residual gap sum to least, that is into a
bin with the gap g that makes (change of N(g)^2 + change of N(g - length)^2) smallest, or into a new bin; ties go to
the smallest gap left. Each group keeps only the counts and stacks of open bins for each gap.

Groups hold GROUP pieces on average at any size of the table, so that a task's memory and time do not grow with it; the
price is the few bins that each group leaves part-filled. Null and empty texts are one piece, the end id alone. Rows
with the same doc_id, or without one, stay apart: pieces are keyed by (doc_id, copy number). Empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import no_null, saved, shared_dir
from shopweave.llm.tokens import encoder

GROUP = 8_000
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first takes what is over."""
    first = n % size or size
    return [(0, min(first, n))] + [(at, size) for at in range(first, n, size)]


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool = True) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of documents (doc_id, text); row tells equal doc_ids apart."""
    schema = PIECES + ", ids array<int>" * with_ids

    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, lists = [], []
            encoded = enc.encode_all(batch.column(2).to_pylist())
            for doc_id, row, got in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded, strict=True):
                ids = got + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, row, k, start, length, zlib.crc32(part)))
                    if with_ids:
                        lists.append(np.frombuffer(part, "<i4"))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            out = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            if with_ids:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    rows = no_null(docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text"), "text")
    return rows.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (all below size), in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    for i, length in enumerate(lengths.tolist()):
        # Gaps from length to size - 1 may take it; change[k] is for the gap length + k, leaving the gap k.
        old, new = count[length:size], count[: size - length]
        change = np.where(old > 0, 2 * (new - old) + 2, np.iinfo(np.int64).max)
        if len(change):
            change[0] = 1 - 2 * old[0] if old[0] else change[0]  # full bins are closed and not counted
            k = int(change.argmin())
        if len(change) and change[k] <= 2 * count[size - length] + 1:
            bins[i], gap = open_at[length + k].pop(), k
            offsets[i] = size - length - k
            count[length + k] -= 1
        else:
            bins[i], gap = made, size - length
            made += 1
        if gap:
            open_at[gap].append(int(bins[i]))
            count[gap] += 1
    return bins, offsets


def pack(pieces: DataFrame, size: int, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, row, piece, length, ...); pieces should be a written table."""
    short = pieces.filter(F.col("length") < size)
    full = pieces.filter(F.col("length") >= size)
    n_groups = max(1, -(-short.count() // group))
    keyed = short.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(n_groups)))
    names, kinds = pieces.columns, pieces.dtypes
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds) + ", sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy() for c in ("piece", "row")] + [-table.column("length").to_numpy()])
        table = table.take(pa.array(order))
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), size)
        at = table.column("bin_group")[0].as_py()
        # Even numbers are packed bins, odd ones full pieces.
        made = pa.array(2 * (at + n_groups * bins))
        return table.select(names).append_column("sequence_id", made).append_column("offset", pa.array(offsets))

    packed = keyed.groupBy("bin_group").applyInArrow(run, schema)
    alone = full.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool = True, group: int = GROUP) -> DataFrame:
    """Documents (doc_id, text) as packed pieces; sequences are the rows of one sequence_id in order of offset."""
    pieces = saved(document_pieces(docs, tokenizer, end_id, size, with_ids), shared_dir(docs.sparkSession))
    return pack(pieces, size, group)


def op9_sum_of_squares(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048, with_ids=False).drop("row")
