"""Exact URL rules without a join: a cascade of Bloom filters over all keys that the corpus can ask for.

A rule is a host (it fits its subdomains too) and the beginning of a path; its key is both put together. A url can ask
for one key per shape, that is per pair (labels in the host, length of the path) that occurs in the list. The universe is
every key that any url of the corpus asks for. Level 1 of the cascade encodes the listed keys; level 2 the keys of the
universe that level 1 takes for listed though they are not; level 3 the listed keys that level 2 holds too; and so on
until no key is mistaken. A key's answer is the parity of the first level that lacks it, and is exact for every key of
the universe, with no join while urls are judged.

All of it is column expressions. A level is cut by a hash of the key into filters of at most MAX_BITS bits, each a binary
literal; only the set 64-bit words go through the driver, a filter at a time. MAX_PARTS filters a level (some forty million
listed keys, 48 MB) are what an expression should carry: beyond that the list is joined (`use_join`), by key, with the same result. The
url rows are never dealt while the cascade is built: they are filtered where they are, and what a level mistakes is
made distinct before it is dealt, so that a hot host or url costs one row per task.

Null urls and those without "://" have an empty host and path, fit no rule and are allowed. Equal urls are judged alike. A key that is
listed both ways is allowed. Of fitting rules the longest key wins, of equally long ones that with the longer host.
An empty list allows everything; an empty table gives no rows; very long urls are judged whole. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import saved, shared_dir

MAX_BITS, MAX_PARTS = 1 << 23, 48
#: Bits for each key in level 1 and in the later ones, whose mistakes are only among what is left.
BITS_FIRST, BITS_LATER = 10, 4


def parsed(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    after = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    pages = pages.withColumn("_after", F.coalesce(after, F.lit("")))
    host = F.translate(F.regexp_extract("_after", r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract("_after", r"^[^/?#]*([^?#]*)", 1)).drop("_after")


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """The pairs (labels, length of the path) in the list: at most labels of a host times lengths of a path."""
    found = rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("k")).distinct()
    return sorted((r.n, r.k) for r in found.collect())


def asked(shapes: list[tuple[int, int]]) -> Column:
    """The keys that a url asks for, as structs (chars, host_chars, key)."""
    if not shapes:
        return F.expr("cast(array() as array<struct<chars:int,host_chars:int,key:string>>)")
    known = ", ".join(f"named_struct('n', {n}, 'k', {k})" for n, k in shapes)
    return F.expr(f"""transform(filter(array({known}), s -> s.n <= size(split(host, '\\\\.')) and s.k <= length(path)),
        s -> named_struct(
            'chars', length(substring_index(host, '.', -s.n)) + s.k,
            'host_chars', length(substring_index(host, '.', -s.n)),
            'key', concat(substring_index(host, '.', -s.n), substring(path, 1, s.k))))""")


class Level:
    """Bloom filters as literals, one for each part of the keys."""

    def __init__(self, number: int, bits: int, hashes: int, parts: int):
        self.number, self.bits, self.hashes, self.parts = number, bits, hashes, parts
        self.contents: list[bytes] = []

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-self.number)), F.lit(self.parts))

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(self.bits)) for j in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        out = self.among(key, self.contents[-1])
        for i, content in enumerate(self.contents[:-1]):
            out = F.when(self.part(key) == i, self.among(key, content)).otherwise(out)
        return out

    def among(self, key: Column, content: bytes) -> Column:
        out = F.lit(True)
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substring(F.lit(content), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0)
        return out


def parts_of(n: int, number: int) -> int:
    return max(1, math.ceil(n * (BITS_FIRST if number == 1 else BITS_LATER) / MAX_BITS))


def level_of(keys: DataFrame, n: int, number: int) -> Level:
    """A filter of the n keys; the words of a part that are not nought come to the driver, at most MAX_BITS / 64."""
    per_key, parts = BITS_FIRST if number == 1 else BITS_LATER, parts_of(n, number)
    bits = 64 * math.ceil(max(1, n * per_key / parts) / 64)
    level = Level(number, bits, max(1, round(per_key * math.log(2))), parts)
    for part in range(parts):
        own = keys.filter(level.part(F.col("key")) == part) if parts > 1 else keys
        at = own.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("v"))
        content = bytearray(bits // 8)
        for r in words.collect():
            content[8 * r.w : 8 * r.w + 8] = (r.v % (1 << 64)).to_bytes(8, "little")
        level.contents.append(bytes(content))
    return level


class Cascade:
    """The levels; `holds` is exact for every key of the universe they were made over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[k - 1].holds(key), F.lit(k % 2 == 0)).otherwise(out)
        return out


def cascade(listed: DataFrame, urls: DataFrame, folder: str) -> Cascade | None:
    """Over the universe in column `asked` of urls; None if the list is too long for the filters of a level."""
    listed = saved(listed.select("key").distinct(), f"{folder}/listed")
    n = listed.count()
    if parts_of(n, 1) > MAX_PARTS:
        return None
    if not n:
        return Cascade([])
    levels = [level_of(listed, n, 1)]
    taken = urls.select(F.explode(F.filter("asked", lambda a: levels[0].holds(a.key))).alias("a"))
    wrong = taken.select(F.col("a.key").alias("key")).distinct().join(listed, "key", "left_anti")
    now, other = saved(wrong, f"{folder}/level-1"), listed
    while n := now.count():
        if parts_of(n, 2) > MAX_PARTS:
            return None
        level = level_of(now, n, len(levels) + 1)
        levels.append(level)
        now, other = saved(other.filter(level.holds(F.col("key"))), f"{folder}/level-{len(levels)}"), now
    return Cascade(levels)


def judge(pages: DataFrame, rules: DataFrame, use_join: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages (page_id, url) by rules (host, path, verdict: allow or block)."""
    spark, folder = pages.sparkSession, shared_dir(pages.sparkSession)
    rules = rules.dropna(subset=["host", "path", "verdict"])
    keyed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    urls = parsed(pages.select("page_id", "url")).withColumn("asked", asked(shapes_of(rules)))
    made = {}
    for verdict in () if use_join else ("allow", "block"):
        made[verdict] = cascade(keyed.filter(F.col("verdict") == verdict), urls, f"{folder}/{verdict}")
    if use_join or None in made.values():
        return judge_by_join(urls, keyed, folder)
    fits = {verdict: longest(c) for verdict, c in made.items()}
    urls = urls.select("page_id", "host", "path", fits["allow"].alias("a"), fits["block"].alias("b"))
    best = F.greatest("a", "b")
    blocked = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b") > F.col("a")))
    return urls.select("page_id", "host", "path", best["key"].alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def longest(listed: Cascade) -> Column:
    """The longest key asked for that is listed, or null."""
    return F.array_max(F.filter("asked", lambda a: listed.holds(a.key)))


def judge_by_join(urls: DataFrame, keyed: DataFrame, folder: str) -> DataFrame:
    """The same for lists that no literal holds: distinct keys meet the list, and the urls their keys."""
    once = keyed.groupBy("key").agg(F.min("verdict").alias("verdict"))  # allow comes before block
    # Written once: numbered rows are read twice.
    rows = saved(urls.withColumn("row", F.monotonically_increasing_id()), f"{folder}/numbered")
    met = rows.select("row", F.explode("asked").alias("a")).withColumn("key", F.col("a.key")).join(once, "key")
    best = met.groupBy("row").agg(F.max(F.struct("a", "verdict")).alias("m"))
    out = rows.join(best, "row", "left")
    return out.select("page_id", "host", "path", F.col("m.a.key").alias("rule"), F.coalesce("m.verdict", F.lit("allow")).alias("verdict"))


#: The list of the query: host, beginning of the path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op3_bloom_cascade(spark, sf_dir: str) -> DataFrame:
    """Every url of pages against RULES."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
), parts AS (
    SELECT page_id,
        translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
    SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
        row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS k
    FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
"""
