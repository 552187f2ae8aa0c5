"""A Merkle manifest of documents: one tree for each language, one over their roots, with a proof for each document.

Leaves are digests of whole rows. Where a leaf stands in its tree (how many doc_ids of its language are smaller) is asked of
bitmaps, not found by sorting: for each language and 64 successive doc_ids a word of bits, merged by `bit_or` with partial
sums before the shuffle, words without bits left out; and directories of popcounts above them, one for each 16 bits of the id
(words in a chunk of 2^16 ids, chunks in 2^32, those in 2^48, and all), so that a running sum never sees more than 65,536
entries, however sparse or dense the ids are. A rank is the sums of its word's four directory entries and the popcount of the bits
below. Words that hold an id more than once (or rows without id) have no rank by bits: their rows alone are put in order (order.py).

Levels are reduced many at a time: leaves are dealt by (tree, place / 4096) and put at slot place % 4096 of an array, written as
one row; an array gives twelve levels in one step and one node to the arrays above, until each tree has one node. The trees' roots,
numbered by language, are leaves of the last tree, which is made by the same steps. Proofs come down the same arrays: each
slot adds its own siblings to those above its array.

Defined results: nulls are fields of their own ("-"), very long texts are hashed whole; rows of one doc_id stand in order of
leaf, rows without doc_id first, in trees of null languages too; equal rows are leaves of their own with equal values up to their
places. An empty table gives an empty manifest. Columns other than the five hashed are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopweave.llm.common import saved, shared_dir
from shopweave.llm.order import in_order
from shopweave.llm.sharding import CRC_SQL, crc_sql

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of an array of slots.
LEVELS = 12
#: The word of rows without doc_id, below all others, at each level of the directories too.
NO_WORD = -(1 << 62)
SLOTS = "array<struct<slot:int,digest:binary,doc_id:bigint,tampered:binary>>"
STEP = re.compile("[LR][0-9a-f]{64}|=")


# Digests


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(columns[f]) for f in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, tampered, row) of documents; tampered is the leaf after tampering, null where there was none.

    A tree's name is "" for the null language and "=" and the language otherwise, which sorts as languages do.
    """
    own = {f: F.col(f) for f in FIELDS}
    hit = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(7)) == 0
    # The text is hashed a second time only where a row is tampered with.
    other = F.when(hit & F.col("n_chars").isNotNull(), leaf({**own, "n_chars": F.col("n_chars").cast("long") + 1}))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), tree.alias("tree"), leaf(own).alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("row"))


def joined(a: str, b: str = "") -> str:
    return hashlib.sha256((a + b).encode()).hexdigest()


def levels_above(digests: list[str], n: int) -> list[list[str]]:
    """The nodes of n levels, digests themselves being the lowest, which is level 0; every two become one."""
    out = [digests]
    for _ in range(n):
        d = out[-1]
        out.append([joined(d[i], d[i + 1]) if i + 1 < len(d) else joined(d[i]) for i in range(0, len(d), 2)])
    return out


def steps_of(levels: list[list[str]], slot: int) -> list[str]:
    """A step for each level: the sibling behind "L" or "R", its side, or "=" where there is none."""
    out = []
    for d in levels[:-1]:
        other = slot ^ 1
        out.append("=" if other >= len(d) else ("L" if other < slot else "R") + d[other])
        slot >>= 1
    return out


def folded(digest: str, steps: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for s in steps:
        digest = joined(digest) if s == "=" else joined(s[1:], digest) if s[0] == "L" else joined(digest, s[1:])
    return digest


def depth(n: int) -> int:
    """Levels above n nodes until one remains."""
    return max(n - 1, 0).bit_length()


def levels_here(n: int, stage: int) -> int:
    """Levels that the arrays of a stage stand for, in a tree of n leaves."""
    return max(0, min(LEVELS, depth(n) - LEVELS * stage))


# Places by bitmaps


def words(leaf_rows: DataFrame) -> DataFrame:
    """(tree, word, bits, n): the bitmap of doc_ids, 64 of them a word, and how many rows a word has."""
    word = F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_WORD)).alias("word")
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 AS int))")
    return leaf_rows.groupBy("tree", word).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


def directory(bitmap: DataFrame) -> DataFrame:
    """words (a written table) with `base`, the rows of the tree in smaller words, and `n_tree`, all its rows.

    An entry of a directory belongs to 16 bits of the id (10 for words), so a running sum goes over at most 65,536 entries, and
    as many meet the entry above them.
    """
    names = ["word", "chunk", "block", "span"]
    sums = [bitmap.select("*", *[F.shiftright("word", by).alias(name) for name, by in zip(names[1:], (10, 26, 42), strict=True)])]
    for k in range(1, len(names)):
        sums.append(sums[-1].groupBy("tree", *names[k:]).agg(F.sum("n").alias("n")))
    above = sums[-1].groupBy("tree").agg(F.lit(0).cast("long").alias("base"), F.sum("n").alias("n_tree"))
    for k in reversed(range(len(names))):
        parent = ["tree", *names[k + 1 : k + 2]]  # a number tells all those above it
        earlier = Window.partitionBy(*parent).orderBy(names[k]).rowsBetween(Window.unboundedPreceding, -1)
        entry = sums[k].withColumn("own", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        got = entry.join(above.select(*parent, F.col("base").alias("over"), "n_tree"), parent)
        above = got.select("tree", names[k], *["bits"] * (k == 0), "n", (F.col("over") + F.col("own")).alias("base"), "n_tree")
    return above


def places(leaf_rows: DataFrame, folder: str) -> DataFrame:
    """(tree, n, pos, digest, doc_id, tampered): each leaf's place in its tree of n leaves, from 0."""
    bitmap = saved(directory(saved(words(leaf_rows), f"{folder}/words")), f"{folder}/directory")
    plain = F.bit_count("bits") == F.col("n")
    rows = leaf_rows.withColumn("word", F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_WORD)))
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, cast(doc_id & 63 AS int))"))
    out = ["tree", F.col("n_tree").alias("n"), "pos", F.col("leaf").alias("digest"), "doc_id", "tampered"]
    ranked = rows.join(bitmap.filter(plain), ["tree", "word"]).withColumn("pos", F.col("base") + below).select(*out)
    repeated = bitmap.filter(~F.coalesce(plain, F.lit(False)))
    if repeated.isEmpty():
        return ranked
    # Keys together name a row, so one id that fills the table is cut into many ranges.
    rest = saved(rows.join(repeated, ["tree", "word"]).withColumn("one", F.lit(1)), f"{folder}/repeated")
    placed = in_order(rest, ["tree", "word", "doc_id", "leaf", "row"], "one", f"{folder}/repeated-order")
    first = placed.groupBy("tree", "word").agg(F.min("at").alias("first"))
    return ranked.unionByName(placed.join(first, ["tree", "word"]).withColumn("pos", F.col("base") + F.col("at") - F.col("first")).select(*out))


# Arrays of slots, up and down


def arrays(nodes: DataFrame) -> DataFrame:
    """(tree, block, n, slots) of nodes (tree, n, pos, digest, ...): 2^LEVELS successive nodes in one row."""
    slot = F.struct((F.col("pos") % (1 << LEVELS)).cast("int").alias("slot"), "digest", "doc_id", "tampered")
    return nodes.groupBy("tree", F.shiftright("pos", LEVELS).alias("block")).agg(F.first("n").alias("n"), F.collect_list(slot).alias("slots"))


def slot_lists(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list, list, list]]:
    """Of each array its digests in hexadecimal, doc_ids and tampered digests, at their slots."""
    for row in batch.column(column):
        table = row.values
        at = np.empty(len(table), np.int64)
        at[table.field("slot").to_numpy()] = np.arange(len(table))
        table = table.take(pa.array(at))
        yield [d.hex() for d in table.field("digest").to_pylist()], table.field("doc_id").to_pylist(), table.field("tampered").to_pylist()


def nodes_above(stage_arrays: DataFrame, stage: int) -> DataFrame:
    """The one node that each array gives, at the place of its block."""

    def run(batches):
        for batch in batches:
            made = [bytes.fromhex(levels_above(digests, levels_here(n, stage))[-1][0]) for n, (digests, _, _) in zip(batch.column(2).to_pylist(), slot_lists(batch, 3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(made, pa.binary())], names=["tree", "n", "pos", "digest"])

    up = stage_arrays.select("tree", "block", "n", "slots").mapInArrow(run, "tree string, n long, pos long, digest binary")
    return up.select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered"))


def grown(nodes: DataFrame, folder: str, max_n: int) -> tuple[list[DataFrame], DataFrame]:
    """Written arrays of each stage, and (tree, digest) of the roots."""
    stages = []
    for stage in range(max(1, -(-depth(max_n) // LEVELS))):
        stages.append(saved(arrays(nodes), f"{folder}/{stage}"))
        nodes = nodes_above(stages[-1], stage)  # a tree that has ended goes up as it is
    return stages, saved(nodes.select("tree", "digest"), f"{folder}/roots")


PATHS = "tree string, pos long, steps string, subroot string, root string"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def paths_below(stage_arrays: DataFrame, stage: int, above: DataFrame, leaves_here: bool) -> DataFrame:
    """The steps from each slot to the root, or at the leaves what they prove.

    above: (tree, pos, steps, subroot, root) of the arrays, by block; steps are those above the array.
    """
    names = [c.split()[0] for c in PROOFS.split(", ")]

    def run(batches):
        for batch in batches:
            tree, block, n, steps, subroot, root = (batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6))
            for i, (digests, doc_ids, tampered) in enumerate(slot_lists(batch, 3)):
                levels = levels_above(digests, levels_here(n[i], stage))
                upper = STEP.findall(steps[i])
                each = [steps_of(levels, s) for s in range(len(digests))]
                if not leaves_here:
                    out = [[tree[i]] * len(each), [(block[i] << LEVELS) + s for s in range(len(each))], ["".join(e) + steps[i] for e in each], [subroot[i]] * len(each), [root[i]] * len(each)]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), *[pa.array(o, pa.string()) for o in out[2:]]], names=[c.split()[0] for c in PATHS.split(", ")])
                    continue
                tail = "".join(s[1:] for s in upper)
                proofs = [joined("".join(s[1:] for s in e), tail) for e in each]
                back = [folded(t.hex() if t else d, e + upper) for d, t, e in zip(digests, tampered, each, strict=True)]
                texts = [digests, [subroot[i]] * len(each), [root[i]] * len(each), proofs, back]
                verified = pa.array([b == root[i] for b in back], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *[pa.array(t, pa.string()) for t in texts], verified], names=names)

    with_paths = stage_arrays.join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
    return with_paths.select("tree", "block", "n", "slots", "steps", "subroot", "root").mapInArrow(run, PROOFS if leaves_here else PATHS)


# The manifest


@dataclass
class Manifest:
    """Written tables: arrays of slots of each stage (leaves first), of the tree over languages, and (tree, pos, digest) of the roots.

    root is None for an empty table.
    """

    stages: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None
    folder: str


def build(docs: DataFrame, folder: str | None = None) -> Manifest:
    """The manifest of documents (doc_id, source, lang, n_chars, text), written in folder."""
    folder = folder or shared_dir(docs.sparkSession)
    rows = saved(leaves(docs), f"{folder}/leaves")
    placed = places(rows, folder)
    most = saved(rows.groupBy("tree").count(), f"{folder}/trees").agg(F.max("count"), F.count("*")).first()
    stages, roots = grown(placed, f"{folder}/arrays", most[0] or 0)
    named = in_order(roots.withColumn("one", F.lit(1)), ["tree"], "one", f"{folder}/roots-order")
    subroots = saved(named.select("tree", F.col("at").alias("pos"), "digest"), f"{folder}/subroots")
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered")]
    top, over = grown(subroots.select(F.lit("").alias("tree"), F.lit(most[1]).cast("long").alias("n"), "pos", "digest", *none), f"{folder}/top", most[1])
    # One row, or none of an empty table.
    root = over.first()
    return Manifest(stages, top, subroots, root.digest.hex() if root else None, folder)


def prove(manifest: Manifest) -> DataFrame:
    """For each document its leaf, subroot, root, the digest of its siblings, and the root that its (tampered) leaf folds to."""
    spark = manifest.subroots.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], PROOFS)
    root = F.lit(manifest.root)
    above = spark.range(1).select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("steps"), root.alias("subroot"), root.alias("root"))
    for k in reversed(range(len(manifest.top))):
        above = paths_below(manifest.top[k], k, above, False)
    own = manifest.subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"), "pos")
    above = own.join(above.select("pos", "steps", "root"), "pos").select("tree", F.lit(0).cast("long").alias("pos"), "steps", "subroot", "root")
    for k in reversed(range(len(manifest.stages))):
        if k:
            above = saved(paths_below(manifest.stages[k], k, above, False), f"{manifest.folder}/paths-{k}")
    return paths_below(manifest.stages[0], 0, above, True)


def op11_bitmap_merkle(spark, sf_dir: str) -> DataFrame:
    """A manifest of all documents, and each one's proof."""
    return prove(build(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(field_sql({"n_chars": n_chars}.get(f, f)) for f in FIELDS) + ")"


ORACLE = f"""
WITH RECURSIVE {CRC_SQL},
rows AS (
  SELECT doc_id::BIGINT AS doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {leaf_sql("n_chars")} AS leaf,
    CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf_sql("(n_chars + 1)")} ELSE {leaf_sql("n_chars")} END AS given
  FROM documents, lut
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows
), low AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (
  SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2, n
), low_path AS (
  SELECT doc_id, leaf, tree, pos AS place, given AS h, pos, 0 AS level, '' AS siblings FROM placed
  UNION ALL
  SELECT p.doc_id, p.leaf, p.tree, p.place, sha256(CASE WHEN o.h IS NULL THEN p.h WHEN o.pos < p.pos THEN o.h || p.h ELSE p.h || o.h END), p.pos // 2, p.level + 1, p.siblings || coalesce(o.h, '')
  FROM low_path p JOIN subroots s ON s.tree = p.tree AND p.level < s.height
  LEFT JOIN low o ON o.tree = p.tree AND o.level = p.level AND o.pos = xor(p.pos, 1)
), root AS (
  SELECT level AS height, h AS root FROM high WHERE n = 1
), path AS (
  SELECT p.doc_id, p.leaf, p.tree, p.place, s.subroot, p.h, s.pos, 0 AS level, p.siblings FROM low_path p JOIN subroots s ON s.tree = p.tree AND p.level = s.height
  UNION ALL
  SELECT p.doc_id, p.leaf, p.tree, p.place, p.subroot, sha256(CASE WHEN o.h IS NULL THEN p.h WHEN o.pos < p.pos THEN o.h || p.h ELSE p.h || o.h END), p.pos // 2, p.level + 1, p.siblings || coalesce(o.h, '')
  FROM path p JOIN root ON p.level < root.height
  LEFT JOIN high o ON o.level = p.level AND o.pos = xor(p.pos, 1)
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, h AS folded_root, h = root AS verified FROM path JOIN root ON path.level = root.height
"""
