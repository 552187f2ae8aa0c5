"""Secrets in documents, found once per content: an incremental ledger of blobs.

A text's address is the SHA-256 of its bytes. The ledger, a folder of Parquet tables, remembers which (address, rule,
version) have been scanned and what was found. A scan takes every version of every path (here: document row), keeps one row of
each address that lacks some rule at its present version, runs on it only the rules it lacks, appends to the ledger, and
joins the findings of all addresses back to all paths. A second scan of the same texts reads no text but to address it;
a new version of one rule rescans with that rule alone, and findings of older versions no longer count.

Copies cost one scan, whatever their number. The join of a hot address back to its paths is one row against many, which
Spark splits. Spans are (kind, start, end) in code points, end exclusive. Null text counts as empty; very long texts are scanned whole, one
at a time. Rows that repeat or lack doc_id each come back. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import no_null, numbered, saved, shared_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of pattern over the UTF-8 bytes, of which those with `least` bytes in group `group` count.

    hint: one of these is in the lower-cased bytes of any text with a match; empty: unknown.
    """

    name: str
    version: int
    pattern: bytes
    group: int = 0
    least: int = 1
    any_case: bool = False
    hint: tuple[bytes, ...] = ()

    def spans(self, raw: bytes, low: bytes) -> list[tuple[int, int]]:
        if self.hint and not any(h in low for h in self.hint):
            return []
        found = re.compile(self.pattern, re.IGNORECASE if self.any_case else 0).finditer(raw)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: A PEM key to its end line; without one, its header fields and base64 lines, the last of which may be short. Line ends may be escaped.
_EOL = rb"(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*)"
_PEM = (
    rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:"
    rb"(?:(?!-----)[\s\S])*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    rb"|(?:" + _EOL + rb"+[A-Za-z-]+: [^\r\n\\]*)*(?:(?:" + _EOL + rb"+|[ \t]+)?[A-Za-z0-9+/]{24,}={0,2})+"
    rb"(?:" + _EOL + rb"(?:[A-Za-z0-9+/]{4})*[A-Za-z0-9+/]{2}(?:==|[A-Za-z0-9+/]=|[A-Za-z0-9+/]{2})(?=" + _EOL + rb"|\Z))?)?"
)

#: The base rules, in their order; any rule after them adds spans.
BASE = (
    Rule("assign", 1, rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, (b"passw", b"secret", b"token", b"api")),
    Rule("access", 1, rb"AKIA[A-Z0-9]+", least=20, hint=(b"akia",)),
    # Runs of at least 24 are the runs of [0-9a-f]+ that pass.
    Rule("hex", 1, rb"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("private_key", 2, _PEM, hint=(b"private key-----",)),
    Rule("web_token", 1, rb"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint=(b"eyj",)),
    Rule("forge_token", 1, rb"gh[pousr]_[A-Za-z0-9]{36,}", hint=(b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
)
SPANS = "array<struct<start:long,end:long>>"
LEDGER = f"blob binary, rule string, version int, spans {SPANS}"


def ledger_at(spark, folder: str) -> DataFrame:
    """What has been scanned so far; none if the ledger is new."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def points(raw: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Byte positions as code points."""
    if raw.isascii():
        return [{"start": a, "end": b} for a, b in spans]
    out, at, n = [], 0, 0
    for a, b in spans:
        n += len(raw[at:a].decode())
        out.append({"start": n, "end": n + b - a if raw[a:b].isascii() else n + len(raw[a:b].decode())})
        n, at = out[-1]["end"], b
    return out


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows of the ledger for blobs (blob, text, known: names of rules already scanned)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for blob, text, known in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode()
                low = raw.lower()
                rows += [(blob, r.name, r.version, points(raw, r.spans(raw, low))) for r in rules if r.name not in known]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int32(), span), strict=True)], names=["blob", "rule", "version", "spans"])

    return blobs.select("blob", "text", "known").mapInArrow(run, LEDGER)


def scan_new(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks and append to it; returns the rows added."""
    return scan_rows(addressed(docs), ledger, rules)


def scan_rows(rows: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The same of rows (text, row, blob); rows of one text that share a number are all scanned, which changes no finding."""
    spark = rows.sparkSession
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    now = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")
    known = ledger_at(spark, ledger).join(F.broadcast(now), ["rule", "version"], "left_semi").groupBy("blob").agg(F.collect_set("rule").alias("known"))
    # One row for each address: that with the least number. rows is read twice, so a number has to come from what the row holds, or be written.
    first = rows.groupBy("blob").agg(F.min("row").alias("row"))
    due = first.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))).filter(F.size("known") < len(rules))
    blobs = rows.join(due.select("row", "blob", "known").hint("shuffle_hash"), ["row", "blob"])
    scanned = saved(scan(blobs, rules), f"{shared_dir(spark)}/scanned")
    scanned.write.mode("append").parquet(ledger)
    return scanned


def addressed(docs: DataFrame) -> DataFrame:
    """Rows numbered by what they hold: another scan of docs, however its rows are dealt, gives each row the same number."""
    return with_blob(docs.select("doc_id", "text")).withColumn("row", F.xxhash64("blob", "doc_id"))


def with_blob(rows: DataFrame) -> DataFrame:
    return no_null(rows, "text").withColumn("blob", F.unhex(F.sha2("text", 256)))


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found: array of (start, rank of the rule, kind, end), ascending) of every row of docs."""
    spark = docs.sparkSession
    order = spark.createDataFrame([(r.name, r.version, k) for k, r in enumerate(rules)], "rule string, version int, rank int")
    hits = ledger_at(spark, ledger).filter(F.size("spans") > 0).join(F.broadcast(order), ["rule", "version"])
    each = hits.select("blob", F.transform("spans", lambda s: F.struct(s.start.alias("start"), F.col("rank"), F.col("rule").alias("kind"), s.end.alias("end"))).alias("s"))
    # An address may have been scanned twice by tasks or runs that overlapped: equal spans count once.
    found = each.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("found"))
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.join(found, "blob", "left").select("doc_id", F.coalesce("found", empty).alias("found"))


def scan_documents(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date, then the findings of every row."""
    scan_new(docs, ledger, rules)
    return findings(docs, ledger, rules)


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every span of a secret in text replaced by mark, and n_chars, if there, set anew; other rows stay as they are."""
    names, spark = docs.columns, docs.sparkSession
    table = numbered(docs, f"{shared_dir(spark)}/numbered")
    rows = with_blob(table.select("kept.text", "row"))
    scan_rows(rows, ledger, rules)
    now = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")
    hits = ledger_at(spark, ledger).filter(F.size("spans") > 0).join(F.broadcast(now), ["rule", "version"], "left_semi")
    found = hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found"))
    held = table.select("kept.text", "kept", "row")
    # Few texts hold a secret: addresses meet the findings first, and rows their findings by number.
    due = saved(rows.select("row", "blob").join(found, "blob").select("row", "found"), f"{shared_dir(spark)}/due")
    both = held.join(due.hint("shuffle_hash"), "row", "left")
    both = both.withColumn("mark", F.lit(mark))
    # From left to right: what lies between the spans, and a mark for each stretch of spans.
    step = """aggregate(found, named_struct('at', 0L, 'out', ''), (a, s) -> if(s.end <= a.at, a, named_struct(
        'at', s.end, 'out', concat(a.out, substring(text, cast(a.at as int) + 1, cast(greatest(s.start - a.at, 0L) as int)), if(s.start < a.at, '', mark)))),
        a -> concat(a.out, substring(text, cast(a.at as int) + 1)))"""
    both = both.withColumn("new", F.when(F.col("found").isNotNull(), F.expr(step)))

    def column(c: str):
        old = F.col("kept").getField(c)
        value = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}.get(c)
        return (old if value is None else F.when(F.col("new").isNotNull(), value).otherwise(old)).alias(c)

    return both.select(*map(column, names))


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts and joined spans of what findings returns."""
    names = [r.name for r in base]
    told = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    of_base = F.filter("found", lambda s: s.kind.isin(names))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(found, s -> s.kind = '{n}')) as long)").alias(f"n_{n}") for n in names],
        F.sha2(F.array_join(F.transform(of_base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", told), ",").alias("spans"),
    )


def op7_blob_ledger(spark, sf_dir: str) -> DataFrame:
    """All documents against a new ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(scan_documents(docs, f"{shared_dir(spark)}/ledger"))
