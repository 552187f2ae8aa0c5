"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are column expressions. Shallow trees of a random forest are grown on a bounded sample of
labelled rows (at most MAX_ROWS of them, those with the smallest hash of doc_id), and every path from a root to a node
becomes a rule: a conjunction of comparisons. A lasso logistic regression over the rules' truth values leaves few with a
weight, and these are compiled into one column expression, so that scoring is one pass over the documents without Python
and without a shuffle.

Labels are read only where crc32(doc_id as text) mod 5 is not 0; doc_id, lang and source are no inputs of the score.
Null and empty texts have statistics of nought and a score like any text. Rows may repeat or lack doc_id: each is scored
by itself (held_out is null without doc_id). Labels that repeat count once, by their maximum; null labels do not count.
Without labels, or with labels of one kind, every score is the share of label 1 (1.0 if there are none). Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import no_null, saved, shared_dir

MAX_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 7
ACCEPT = 0.3
BLANKS = " \t\n\x0b\x0c\r"
STATS = (
    "words", "word_chars", "lines", "line_words", "upper", "digits", "symbols", "marks", "exclaims",
    "bars", "distinct", "repeated_lines", "ended_lines", "same_next", "word_symbols", "longest",
)


def statistics(docs: DataFrame) -> DataFrame:
    """Adds STATS to rows with text (not null)."""
    size = lambda c: F.length(c).cast("double")
    over = lambda a, b: a / F.greatest(b, F.lit(1.0))
    less = lambda letters: size("text") - size(F.translate("text", letters, ""))
    rows = docs.withColumns(
        {
            "_w": F.array_remove(F.split(F.translate("text", BLANKS, " " * len(BLANKS)), " "), ""),
            "_l": F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != ""),
            "_chars": size("text") - (size("text") - size(F.translate("text", BLANKS, ""))),
        }
    ).withColumns({"_n": F.size("_w").cast("double"), "_m": F.size("_l").cast("double")})
    chars, n, m = F.col("_chars"), F.col("_n"), F.col("_m")
    rows = rows.withColumns(
        {
            "words": F.log1p(n),
            "word_chars": over(chars, n),
            "lines": F.log1p(m),
            "line_words": F.log1p(over(n, m)),
            "upper": over(size("text") - size(F.regexp_replace("text", r"\p{Lu}+", "")), chars),
            "digits": over(less("0123456789"), chars),
            "symbols": over(less("#*$%&|<>"), chars),
            "marks": over(less(".,;:?"), n),
            "exclaims": over(less("!"), n),
            "bars": over(less("|"), n),
            "distinct": over(F.size(F.array_distinct("_w")).cast("double"), n),
            "repeated_lines": over(m - F.size(F.array_distinct("_l")).cast("double"), m),
            "ended_lines": over(F.size(F.filter("_l", lambda x: F.rtrim(x).rlike(r"[.!?]$"))).cast("double"), m),
            "same_next": over(F.expr("cast(size(filter(sequence(0, size(_w)), i -> get(_w, i) = get(_w, i + 1))) as double)"), n),
            "word_symbols": over(F.size(F.filter("_w", lambda x: x.rlike(r"[#*$%&|<>!]"))).cast("double"), n),
            "longest": F.log1p(F.coalesce(F.array_max(F.transform("_w", lambda x: F.length(x))), F.lit(0))),
        }
    )
    return rows.drop("_w", "_l", "_chars", "_n", "_m")


@dataclass(frozen=True)
class Rule:
    """Holds where every (statistic, above, threshold) does: value > threshold if above, else value <= threshold."""

    terms: frozenset[tuple[str, bool, float]]

    def column(self) -> Column:
        tests = [F.col(s) > F.lit(t) if above else F.col(s) <= F.lit(t) for s, above, t in sorted(self.terms)]
        return reduce(lambda a, b: a & b, tests)

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>' if above else '<='} {t:.6g}" for s, above, t in sorted(self.terms))


@dataclass
class Model:
    """log odds of label 1: base plus the weights of the rules that hold; without rules, the probability `share`."""

    base: float
    weights: list[tuple[Rule, float]]
    share: float | None = None

    def score(self) -> Column:
        if self.share is not None:
            return F.lit(float(self.share))
        total = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights], F.lit(self.base))
        return 1 / (1 + F.exp(-total))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Statistics and label of the labelled rows to learn from."""
    known = labels.filter((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows rows of 16 bytes, whatever the size of the tables.
    rows = no_null(docs.select("doc_id", "text"), "text").join(F.broadcast(chosen), "doc_id")
    return statistics(rows).select("label", *STATS)


def tree_rules(tree) -> list[Rule]:
    """One rule for each node below the root."""
    out = []

    def walk(node, terms: frozenset) -> None:
        if terms:
            out.append(Rule(terms))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            stat, at = STATS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), terms | {(stat, False, at)})
            walk(node.rightChild(), terms | {(stat, True, at)})

    walk(tree._java_obj.rootNode(), frozenset())
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    folder = shared_dir(docs.sparkSession)
    rows = saved(sample(docs, labels, max_rows), f"{folder}/sample")
    seen = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    if not seen.n or seen.share in (0.0, 1.0):
        return Model(0.0, [], seen.share if seen.n else 1.0)
    # A sample of bounded size needs few tasks.
    rows = saved(VectorAssembler(inputCols=list(STATS), outputCol="features").transform(rows.coalesce(2)).select("label", "features", *STATS), f"{folder}/vectors")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.7, seed=SEED)
    trees = forest.fit(rows.select("label", "features")).trees
    rules = sorted({r for t in trees for r in tree_rules(t)}, key=str)
    if not rules:
        return Model(0.0, [], seen.share)
    truth = [r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    rows = saved(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(rows.select("label", *truth)).select("label", "features"), f"{folder}/rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=80).fit(rows)
    return Model(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs (with text), score and predicted of every row."""
    names = docs.columns
    rows = statistics(docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in names], F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("score", model.score())
    return rows.select(*[F.col(f"`in_{c}`").alias(c) for c in names], "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model accepts, with their columns.

    A filter on the score would be pushed below the statistics and repeat them in every rule; a list of one row, or none, is not.
    """
    names = docs.columns
    held = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    kept = score(held, model).select(F.explode(F.when(F.col("predicted") == 1, F.array("row"))).alias("row"))
    return kept.select("row.*")


def op1_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of their labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return scored.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
