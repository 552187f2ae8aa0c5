"""Quality rules: counts of each text, and robust outliers among the texts of the same language and source.

Base counts are column expressions over the whole text. Four statistics of each text that passes the base limits are
transformed (log of the mean word length; square root of the share of symbols; shares of repeated lines and of words in
repeated windows, of ten lines and fifty words more than there are, so that one repeat in a short text is small). For each language and source the minimum-covariance-determinant estimate of centre and scatter is
found by concentration steps, until no determinant falls any more, from two deterministic starts (medians with absolute
deviations; spatial signs), the one with the smaller determinant kept, then corrected for consistency and reweighted once. A text is rejected if its squared
Mahalanobis distance exceeds the CUTOFF quantile of chi-square with four degrees of freedom.

Each step is two small aggregations over a written table of the statistics, with partial sums before any shuffle, so a
source with a third of all rows is no hot task. Subsets are cut at approximate quantiles of the distances (sketches of
bounded size). FLOORS are added to each scatter, as most texts have no symbols or repeated lines at all and a scatter of
nought would reject the first that has one. Groups of fewer than LEAST texts are pooled by language, then all together;
if even those are fewer, they are judged by the estimate of all texts that pass. If these are fewer than LEAST too,
nothing but the base limits rejects.

Windows are compared by 64-bit hashes: among the n windows of a text, two different ones count as equal with a chance
of n^2 / 2^65. Null and empty texts have no words and fail the base limits. Null languages and sources are groups of their own.
Rows may repeat or lack doc_id: each is judged by itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import no_null, saved, shared_dir

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
SUBSET, REWEIGHT, CUTOFF = 0.75, 0.975, 0.999
#: Concentration ends when no group's log of the determinant falls by more than STILL, or after STEPS.
STEPS, STILL, LEAST = 30, 1e-3, 100
#: Near the deviation that clean texts have in v0; a symbol in a text of fifty words is 0.06 in v1, a repeat in a short one some 0.06 in v2 and v3.
FLOORS = (0.03, 0.03, 0.05, 0.05)
MORE_LINES, MORE_WORDS = 10, 50
#: The group of what remains too small to have its own estimate.
EVERY = "*"
STATS = ("v0", "v1", "v2", "v3")
#: Tables of at most so many groups (some 200 bytes each) are broadcast.
MAX_GROUPS = 20_000
DIM = len(STATS)


def chi2_cdf(x: float, even: int) -> float:
    """Of chi-square with an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, even // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, even) < q else (low, mid)
    return high


def consistency(q: float) -> float:
    """By which the scatter of the central share q is too small under a normal distribution."""
    return q / chi2_cdf(chi2_quantile(q, DIM), DIM + 2)


def without(column: str, letters: str) -> Column:
    return F.length(F.translate(column, letters, ""))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts, n_lines and base_failed to rows with text (not null)."""
    words = F.array_remove(F.split(F.translate("text", BLANKS, " " * len(BLANKS)), " "), "")
    rows = docs.withColumn("_w", words).withColumn("n_words", F.size("_w").cast("long"))
    rows = rows.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != ""))
    windows = F.expr("""if(n_words < 3, cast(array() as array<struct<h:bigint,i:int>>), transform(
        sequence(0, cast(n_words as int) - 3), i -> named_struct('h', xxhash64(_w[i], _w[i + 1], _w[i + 2]), 'i', i)))""")
    rows = rows.withColumn("_s", windows).withColumn("_m", F.size("_s"))
    # Most texts repeat nothing; the others sort their windows by hash, and neighbours tell what repeats.
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct(F.transform("_s", lambda s: s.h))) < F.col("_m"), F.sort_array("_s")))
    at = F.expr("""if(_s is null, cast(array() as array<int>), sort_array(transform(filter(sequence(0, _m - 1),
        j -> _s[j].h = get(_s, j - 1).h or _s[j].h = get(_s, j + 1).h), j -> _s[j].i)))""")
    rows = rows.withColumn("_at", at)
    # Each repeated window covers three words, or as far as the next one.
    repeat = F.expr("""aggregate(_at, named_struct('n', 0L, 'to', -1), (a, i) -> named_struct(
        'n', a.n + i + 3 - greatest(i, a.to), 'to', i + 3), a -> a.n)""")
    rows = rows.withColumns(
        {
            "word_chars": without("text", BLANKS).cast("long"),
            "n_symbols": (F.length("text") - without("text", SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat,
        }
    )
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return rows.withColumn("base_failed", failed).drop("_w", "_lines", "_s", "_m", "_at")


def by_group(groups: DataFrame) -> DataFrame:
    """A written table of groups for joining rows to it: broadcast if it is small, so that a hot group's rows stay where they are."""
    return F.broadcast(groups) if groups.count() <= MAX_GROUPS else groups


def transformed(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "v0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "v1": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            "v2": F.col("n_dup_lines") / (F.col("n_lines") + MORE_LINES),
            "v3": F.col("n_repeat_words") / (F.col("n_words") + MORE_WORDS),
        }
    )


def grouped(rows: DataFrame, folder: str) -> DataFrame:
    """Adds grp: language and source, or what small groups are pooled in; EVERY where even that is small, null if all rows are few."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    fine = F.col("n") >= LEAST
    by_lang = sizes.filter(~fine).groupBy("lang").agg(F.sum("n").alias("n"))
    rest = by_lang.filter(~fine).agg(F.sum("n").alias("n_rest"))
    every = sizes.agg(F.sum("n").alias("n_every"))
    name = F.to_json(F.struct("lang", "source"))
    named = (
        sizes.join(by_lang.select(F.col("lang").alias("l"), F.col("n").alias("n_lang")), F.col("lang").eqNullSafe(F.col("l")), "left")
        .join(F.broadcast(rest), how="left")  # one row
        .join(F.broadcast(every), how="left")  # one row
        .select(
            F.col("lang").alias("g_lang"),
            F.col("source").alias("g_source"),
            F.when(fine, name).when(F.col("n_lang") >= LEAST, F.to_json(F.struct("lang"))).when(F.col("n_rest") >= LEAST, F.lit("{}")).when(F.col("n_every") >= LEAST, F.lit(EVERY)).alias("grp"),
        )
    )
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rows.join(by_group(saved(named, f"{folder}/names")), same, "left").drop("g_lang", "g_source")


def moments(rows: DataFrame) -> DataFrame:
    """Centre and scatter of each group."""
    means = [F.avg(v).alias(f"m{i}") for i, v in enumerate(STATS)]
    scatter = [F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)]
    return rows.groupBy("grp").agg(*means, *scatter)


def factored(estimate: DataFrame, scale: float = 1.0) -> DataFrame:
    """grp, centre, the Cholesky factor of the scatter times scale with FLOORS added, and the log of the determinant."""
    for i in range(DIM):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") * F.lit(scale) + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 4))) if i == j else value / F.col(f"l{j}{j}")
            estimate = estimate.withColumn(f"l{i}{j}", value)
    det = sum((F.log(f"l{i}{i}") for i in range(DIM)), F.lit(0.0))
    factor = [f"l{i}{j}" for i in range(DIM) for j in range(i + 1)]
    return estimate.select("grp", *[f"m{i}" for i in range(DIM)], *factor, det.alias("det"))


def distances(rows: DataFrame, factor: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance under their group's estimate (a written table)."""
    names = rows.columns
    rows = rows.join(by_group(factor), "grp", "left")
    for i, v in enumerate(STATS):
        z = F.col(v) - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return rows.select(*names, sum((F.col(f"z{i}") ** 2 for i in range(DIM)), F.lit(0.0)).alias("d2"))


def concentrated(rows: DataFrame, factor: DataFrame, folder: str, share: float = SUBSET) -> DataFrame:
    """The moments of the share of each group that lies nearest under the estimate."""
    near = distances(rows, factor)
    cut = near.groupBy("grp").agg(F.percentile_approx("d2", share, 10_000).alias("cut"))
    return moments(near.join(by_group(saved(cut, folder)), "grp").filter("d2 <= cut"))


def starts(rows: DataFrame, folder: str) -> list[DataFrame]:
    """Two first estimates: medians with absolute deviations, and spatial signs about the medians."""
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(v, 0.5, 10_000).alias(f"m{i}") for i, v in enumerate(STATS)])
    middle = saved(middle, f"{folder}/middle")
    centred = rows.join(by_group(middle), "grp")
    off = centred.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(v) - F.col(f"m{i}")), 0.5, 10_000).alias(f"d{i}") for i, v in enumerate(STATS)])
    zero = {f"c{i}{j}": F.lit(0.0) for i in range(DIM) for j in range(i)}
    plain = middle.join(off, "grp").withColumns({f"c{i}{i}": (1.4826 * F.col(f"d{i}")) ** 2 for i in range(DIM)} | zero)
    length = F.sqrt(sum(((F.col(v) - F.col(f"m{i}")) ** 2 for i, v in enumerate(STATS)), F.lit(1e-12)))
    signs = centred.select("grp", *[((F.col(v) - F.col(f"m{i}")) / length).alias(v) for i, v in enumerate(STATS)])
    turned = moments(signs).drop(*[f"m{i}" for i in range(DIM)]).join(middle, "grp")
    return [saved(factored(plain), f"{folder}/plain"), saved(factored(turned), f"{folder}/turned")]


def estimates(rows: DataFrame, folder: str) -> DataFrame:
    """The reweighted estimate of each group of rows (a written table with grp and STATS), factored."""
    best = None
    for s, factor in enumerate(starts(rows, folder)):
        for k in range(STEPS):
            before = factor.select("grp", F.col("det").alias("before"))
            factor = saved(factored(concentrated(rows, factor, f"{folder}/cut-{s}-{k}")), f"{folder}/start-{s}-{k}")
            # A start need not be a scatter of any subset: its determinant may be the smaller one.
            if k and factor.join(before, "grp").filter(F.col("det") < F.col("before") - STILL).isEmpty():
                break
        if best is None:
            best = factor
        else:
            other = factor.select("grp", F.struct(*[c for c in factor.columns if c != "grp"]).alias("b"))
            both = best.select("grp", F.struct(*[c for c in factor.columns if c != "grp"]).alias("a")).join(other, "grp")
            best = both.select("grp", F.when(F.col("b.det") < F.col("a.det"), F.col("b")).otherwise(F.col("a")).alias("e")).select("grp", "e.*")
    best = saved(best, f"{folder}/best")
    near = distances(rows, best).filter(F.col("d2") <= consistency(SUBSET) * chi2_quantile(REWEIGHT, DIM))
    return saved(factored(moments(near), consistency(REWEIGHT)), f"{folder}/final")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the counts, base_failed, d2, kept) of documents (doc_id, text, lang, source)."""
    folder = shared_dir(docs.sparkSession)
    rows = no_null(docs.select("doc_id", "lang", "source", "text"), "text")
    rows = saved(transformed(base_counts(rows).drop("text")), f"{folder}/counts")
    passed = rows.filter(~F.col("base_failed"))
    named = saved(grouped(passed, folder), f"{folder}/grouped")
    of_group = named.filter(F.col("grp").isNotNull() & (F.col("grp") != EVERY))
    if not named.filter(F.col("grp") == EVERY).isEmpty():
        of_group = of_group.union(named.withColumn("grp", F.lit(EVERY)))
    fit = estimates(of_group, folder)
    scored = distances(named, fit).drop("grp").withColumn("kept", F.coalesce(F.col("d2") <= chi2_quantile(CUTOFF, DIM), F.lit(True)))
    failed = rows.filter("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return scored.unionByName(failed)


def op8_robust_outliers(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
