"""The classifier's statistics and scores against plain Python."""

import math
import re

from pyspark.sql import functions as F

from shopweave.llm import quality_model
from shopweave.llm.common import no_null

BLANK = r"[ \t\n\x0b\x0c\r]"


def by_hand(text):
    words = [w for w in re.split(BLANK, text) if w]
    lines = [x for x in text.split("\n") if re.sub(BLANK, "", x)]
    chars, n, m = sum(map(len, words)), len(words), len(lines)
    over = lambda a, b: a / max(b, 1)
    count = lambda letters: sum(c in letters for c in text)
    return {
        "words": math.log1p(n),
        "word_chars": over(chars, n),
        "lines": math.log1p(m),
        "line_words": math.log1p(over(n, m)),
        "upper": over(sum(c.isupper() and c.lower() != c for c in text), chars),
        "digits": over(count("0123456789"), chars),
        "symbols": over(count("#*$%&|<>"), chars),
        "marks": over(count(".,;:?"), n),
        "exclaims": over(count("!"), n),
        "bars": over(count("|"), n),
        "distinct": over(len(set(words)), n),
        "repeated_lines": over(m - len(set(lines)), m),
        "ended_lines": over(sum(bool(re.search(r"[.!?]\r?$", x.rstrip(" "))) for x in lines), m),
        "same_next": over(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        "word_symbols": over(sum(bool(re.search(r"[#*$%&|<>!]", w)) for w in words), n),
        "longest": math.log1p(max(map(len, words), default=0)),
    }


def test_statistics_equal_plain_python(spark, corpus):
    odd = ["a a a b b", "End.\nEnd.\r\nno end\n\n \t\nLast! ", "||| ## 12 ÀÉ ñ", "x" * 50_000, "one\x0btwo\x0cthree", " !", "😀 😀", None]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows = quality_model.statistics(no_null(docs, "text")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = by_hand(r.text)
        assert set(want) == set(quality_model.STATS)
        for name, value in want.items():
            assert abs(r[name] - value) < 1e-9, (name, r.text[:60])


def test_scores_are_the_rules_weights(spark, corpus):
    labels = corpus.filter("doc_id is not null").select("doc_id", (F.length(F.coalesce("text", F.lit(""))) > 300).cast("int").alias("quality"))
    docs = corpus.filter("doc_id is not null").select("doc_id", "text")
    model = quality_model.fit(docs, labels, max_rows=200)
    assert model.weights
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    for r in quality_model.score(docs, model).collect():
        s = by_hand(texts[r.doc_id])
        total = model.base + sum(w for rule, w in model.weights if all((s[name] > t) == above for name, above, t in rule.terms))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9 and r.predicted == int(r.score >= 0.3)
