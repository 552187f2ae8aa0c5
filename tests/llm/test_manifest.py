"""Shards and Merkle manifests against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shopweave.llm import merkle, sharding
from shopweave.llm.common import saved, shared_dir
from shopweave.llm.order import in_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, row string"


def first_null(v):
    return (v is not None, v or 0)


@pytest.fixture(scope="module")
def hot(spark):
    """A doc_id with a third of the rows, ids of all sizes and signs, copies, nulls."""
    r = random.Random(11)
    ids = [r.choice([r.randint(-70, 70), r.randint(-(1 << 63), (1 << 63) - 1), r.randint(0, 1 << 18)]) for _ in range(400)]
    rows = [(i, r.choice(["", "ab", "é" * 20, None, "x" * 3000]), r.choice(["en", "de", None, "", "é"]), "s", r.choice([None, 3]), "clash", "c") for i in sorted(set(ids))]
    rows += [(7, f"copy {k % 40}", "en", None, k % 3, None, None) for k in range(200)]
    rows += [(None, "no id", r.choice(["en", None]), None, 1, None, None) for _ in range(20)]
    rows += [((1 << 63) - 1, "last", "en", "s", 1, None, None), (-(1 << 63), "least", "en", "s", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# Order


def test_in_order(spark, hot):
    rows = saved(hot.select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).alias("w"), F.monotonically_increasing_id().alias("no")), shared_dir(spark))
    got = sorted(in_order(rows, ["doc_id", "no"], "w", shared_dir(spark)).collect(), key=lambda r: r.at)
    assert [r.at for r in got] == list(range(hot.count()))
    assert [(first_null(r.doc_id), r.no) for r in got] == sorted((first_null(r.doc_id), r.no) for r in rows.collect())
    before = 0
    for r in got:
        assert r.before == before
        before += r.w


# Shards


def shards_by_hand(rows, n):
    line = sorted(((first_null(r.doc_id), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in rows), key=lambda x: x[:2])
    total, before, out, slots = sum(x[2] for x in line), 0, [], Counter()
    for key, crc, size in line:
        shard = (2 * before + size) * n // (2 * total)
        out.append((key, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards(corpus, hot, n):
    for docs in (corpus, hot):
        got = sorted((first_null(r.doc_id), r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.assign(docs, n).collect())
        assert got == sorted(shards_by_hand(docs.collect(), n))


def test_bytes_of_shards_are_near_equal(hot):
    rows = sharding.assign(hot, 8).collect()
    each, largest = Counter(), max(r["size"] for r in rows)
    for r in rows:
        each[r.shard] += r["size"]
    assert set(each) == set(range(8))
    assert all(abs(b - sum(each.values()) / 8) <= largest for b in each.values())


def test_written_shards(spark, hot):
    target = shared_dir(spark)
    report = {r.shard: (r.bytes, r.n_rows) for r in sharding.write_shards(hot, 5, target).collect()}
    want = defaultdict(list)
    for r in sorted(sharding.assign(hot, 5).collect(), key=lambda r: (r.shard, r.slot)):
        want[r.shard].append((r.doc_id, r.text_crc32))
    back = spark.read.parquet(target)
    assert set(back.columns) == {*hot.columns, "shard_"}
    placed = back.select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    got = defaultdict(list)
    for r in sorted(placed, key=lambda r: (r.shard_, r.f, r.i)):
        got[r.shard_].append((r.doc_id, zlib.crc32((r.text or "").encode())))
    assert got == want
    assert report == {k: (sum(len((r.text or "").encode()) + 1 for r in placed if r.shard_ == k), len(v)) for k, v in want.items()}
    assert Counter(tuple(map(str, r))[:7] for r in back.select(*hot.columns).collect()) == Counter(tuple(map(str, r)) for r in hot.collect())


def test_shards_of_one_long_text_and_of_nothing(spark, nothing):
    docs = spark.createDataFrame([(1, "a" * 90000), (2, "b"), (3, None)], "doc_id int, text string")
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs, 8).collect()} == {1: (3, 0), 2: (7, 0), 3: (7, 1)}
    assert sharding.assign(nothing, 8).collect() == []
    assert sharding.write_shards(nothing, 8, shared_dir(spark)).collect() == []


# Manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, n_chars):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(text, (r.doc_id, r.source, r.lang, n_chars, r.text)))


def manifest_by_hand(rows):
    trees = defaultdict(list)
    for r in rows:
        given = leaf_of(r, r.n_chars + 1 if r.n_chars is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else r.n_chars)
        trees[r.lang].append((first_null(r.doc_id), leaf_of(r, r.n_chars), given, r.doc_id))

    def up(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def climb(levels, pos, value, siblings):
        for level in levels[:-1]:
            other = level[pos ^ 1] if pos ^ 1 < len(level) else ""
            value = h(value, other) if pos % 2 == 0 else h(other, value)
            siblings.append(other)
            pos //= 2
        return value

    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    low = {t: up([x[1] for x in sorted(trees[t])]) for t in names}
    high, out = up([low[t][-1][0] for t in names]), []
    for k, t in enumerate(names):
        for pos, (_, leaf, given, doc_id) in enumerate(sorted(trees[t])):
            siblings = []
            value = climb(high, k, climb(low[t], pos, given, siblings), siblings)
            out.append((doc_id, leaf, low[t][-1][0], high[-1][0], h(*siblings), value, value == high[-1][0]))
    return out


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest(corpus, hot, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    for docs in (corpus,) if levels == 1 else (corpus, hot):
        want = sorted(map(str, manifest_by_hand(docs.collect())))
        # Arrays of two to 4,096 slots give the same tree.
        assert rows_of(merkle.prove(merkle.build(docs))) == want
    assert any("False" in w for w in want) and any("True" in w for w in want)


def test_manifest_of_one_and_of_nothing(spark, nothing):
    one = spark.createDataFrame([(5, "t", None, None, None, "", "")], SCHEMA)
    (row,) = merkle.prove(merkle.build(one)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("1:5", "-", "-", "-", "1:t") and row.proof_sha256 == h() and row.verified
    empty = merkle.build(nothing)
    assert empty.root is None and merkle.prove(empty).collect() == []


def test_ranks_of_dense_and_sparse_ids(spark):
    r = random.Random(3)
    ids = [*range(200_000, 203_000), *(r.randint(-(1 << 62), 1 << 62) for _ in range(3000))]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.lit("=en").alias("tree"), F.lit(b"x").alias("leaf"), F.lit(None).cast("binary").alias("tampered"), F.col("doc_id").alias("row"))
    got = {x.doc_id: x.pos for x in merkle.places(rows, shared_dir(spark)).collect()}
    assert got == {d: k for k, d in enumerate(sorted(ids))}
