"""Token ids in binary files: frequency ranks, byte-aligned lengths, control bytes apart from the data bytes.

A file holds a run of documents in ascending doc_id. Its ids are replaced by their rank in the file (the most frequent
id is 0), so that most take one byte. Two bits per rank, four ranks to a control byte, say how many data bytes follow
(1 to 4); control and data bytes stand in separate blocks. The reader looks each control byte up in tables of lengths
and decodes all ranks at once.

Layout, little-endian: magic "SWR1", then uint64 counts of documents, ids and ranks; int64 doc_ids; uint8 flags (1 if
the doc_id is known); uint32 ids per document; uint32 id of each rank; control bytes; data bytes.

One pass over the texts: documents are dealt by ranges of doc_id and a hash of the text, so neither a hot source nor
copies nor rows without doc_id make a hot task, and each task writes a new file whenever it holds FILE_IDS ids, so that
memory is bounded for any table. Every attempt at a task writes under names of its own, and only the files listed in the
attempt that Spark committed are read. Starts come from one window over a row per file, which is one task: 100 TB of
text are some ten million such rows of 100 bytes.

Null and empty texts have the end id alone; very long texts are one document of one file. Rows with the same doc_id stay
apart, in an order that their texts give; rows without doc_id come first. An empty table gives no files and no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopweave.llm.common import no_null, parts, saved, shared_dir
from shopweave.llm.tokens import encoder

MAGIC = b"SWR1"
FILE_IDS = 4_000_000
WRITTEN = "name string, shard int, run int, n_docs long, n_ids long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def rank_bytes(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of uint32 ranks."""
    n = len(ranks)
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-n // 4) * 4, np.uint8)
    code[:n] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    at = np.cumsum(length, dtype=np.int64) - length
    data = np.empty(at[-1] + length[-1] if n else 0, np.uint8)
    data[at] = ranks & 0xFF
    for k in range(1, 4):
        longer = np.flatnonzero(length > k)
        if not len(longer):
            break
        data[at[longer] + k] = ranks[longer] >> np.uint32(8 * k) & 0xFF
    return control, data


#: For each control byte the lengths of its four ranks.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def ranks_of(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks whose control and data bytes these are."""
    length = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(length > k)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list, texts: list[bytes]) -> bytes:
    """A file of these documents; texts are their ids as little-endian uint32."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    count = np.bincount(ids)
    used = np.flatnonzero(count)
    by_rank = used[np.argsort(-count[used], kind="stable")].astype("<u4")
    rank = np.zeros(len(count), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = rank_bytes(rank[ids])
    head = np.array([len(doc_ids), len(ids), len(by_rank)], "<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    blocks = (
        head,
        np.array([d or 0 for d in doc_ids], "<i8"),
        known,
        np.array([len(t) // 4 for t in texts], "<u4"),
        by_rank,
        control,
        data,
    )
    return MAGIC + b"".join(b.tobytes() for b in blocks)


def documents_of(file: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids per document, and all ids of a file."""
    if file[:4] != MAGIC:
        raise ValueError("not a file of token ranks")
    n_docs, n_ids, n_ranks = (int(x) for x in np.frombuffer(file, "<u8", 3, 4))
    at = 28

    def block(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(file, kind, n, at)
        at += got.nbytes
        return got

    doc_ids, known, each = block("<i8", n_docs), block("u1", n_docs), block("<u4", n_docs)
    by_rank, control = block("<u4", n_ranks), block("u1", -(-n_ids // 4))
    ids = by_rank[ranks_of(control, np.frombuffer(file, "u1", -1, at), n_ids)] if n_ids else np.zeros(0, "<u4")
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], each, ids


def put(folder: str, name: str, content: bytes) -> None:
    from pyarrow.fs import FileSystem

    store, path = FileSystem.from_uri(folder.replace("s3a://", "s3://"))
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(content)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode documents (doc_id, text) into files in folder; a row for each file, to be run once (write or save it)."""

    def write(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        shard, run, doc_ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal run, held
            name = f"{shard:07d}-{run:05d}-{uuid.uuid4().hex}.svb"
            put(folder, name, content := file_bytes(doc_ids, texts))
            row = {"name": [name], "shard": [shard], "run": [run], "n_docs": [len(doc_ids)], "n_ids": [held], "n_bytes": [len(content)]}
            run, held = run + 1, 0
            doc_ids.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=list(row))

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                n = len(got) // 4 + 1
                if doc_ids and held + n > file_ids:
                    yield flush()
                doc_ids.append(doc_id)
                texts.append(got + end)
                held += n
        if doc_ids:
            yield flush()

    rows = no_null(docs.select(F.col("doc_id").cast("long"), "text"), "text")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return dealt.select("doc_id", "text").mapInArrow(write, WRITTEN)


def read_token_files(files: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files listed in files (what write_token_files returned): doc_id, start, n_tokens, ids_crc32, ids."""
    spark = files.sparkSession
    kept = READ if with_ids else READ.rpartition(", ")[0]
    if files.isEmpty():
        return spark.createDataFrame([], kept)
    # One row per file of millions of ids: a running sum over them is short.
    order = Window.orderBy("shard", "run").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("first"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.svb").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")

    def read(batches):
        for batch in batches:
            for file, first in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                doc_ids, each, ids = documents_of(file.as_py())
                ends = np.cumsum(each, dtype=np.int64)
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for n, e in zip(each.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(doc_ids, pa.int64()), pa.array(first + ends - each), pa.array(each.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in kept.split(", ")])

    return content.join(starts, "name").select("content", "first").mapInArrow(read, kept)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document of the table, encoded, written in ascending doc_id and read back from the files."""
    import public_tokenizers

    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = saved(write_token_files(docs, f"{folder}/ids", public_tokenizers.path("byte_bpe_50k.json"), end_id=2), f"{folder}/files")
    return read_token_files(files, f"{folder}/ids", with_ids=False)
