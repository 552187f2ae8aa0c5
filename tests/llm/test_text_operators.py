import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopweave.llm import decontaminate, html_blocks, ngram_join, quality_model, quality_rules, secrets_scan, url_filter
from shopweave.llm.common import shared_dir
from shopweave.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(docs, n, num, den):
    sets = {}
    for k, (_, text) in enumerate(docs):
        w = BLANK_WORDS.findall((text or "").translate(LOWER))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in sets:
        groups.setdefault(find(k), []).append(docs[k][0])
    least = {g: min((d for d in own if d is not None), default=None) for g, own in groups.items()}
    return [(docs[k][0], len(sets[k]), least[find(k)] if sets[k] else docs[k][0]) for k in sets]


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (2, 60), (1, 50)])
def test_ngram_join(corpus, n, num):
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    got = ngram_join.jaccard_components(corpus, n, num, 100)
    assert sorted(map(str, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(
        f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in brute_components(docs, n, num, 100)
    )


@pytest.mark.parametrize("limits", [{}, {"HOT": 40, "OFTEN": 2, "RUN": 4000, "BUCKET": 5000}, {"HOT": 10**9, "TOP": 60, "HELD": 2000, "BUCKET": 20_000, "RUN": 3000}, {"MANY": 3}])
def test_ngram_join_with_frequent_grams(spark, monkeypatch, limits):
    """Groups so large that their n-grams close the global order, are passed on unheld, or meet their rows by broadcast; one n-gram in a hundredth of the texts."""
    import random

    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(60)]
    texts = []
    for _ in range(1500):
        t = list(base)
        for _ in range(r.choice((0, 0, 1, 1, 2, 3, 9))):
            t[r.randrange(60)] = r.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(r.choice(words) for _ in range(50)) for _ in range(300)]
    texts += [f"one gram in some {' '.join(r.choice(words) for _ in range(r.randint(0, 12)))}" for _ in range(40)]
    rows = list(enumerate(texts))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85, 100)
    want = {d: c for d, _, c in brute_components_fast(rows, 4, 85, 100)}
    assert {x.doc_id: x.component_id for x in got.collect()} == want


def test_word_hashes():
    """One hash for each word, the same wherever it stands, in a known value on any machine."""
    words = ["a", "ab", "abcdefgh", "abcdefghi", "b\x00", "é", "日本語の", "x" * 1000, "x" * 1001, "a"]
    h = ngram_join.word_hashes("\t" + " \n".join(words) + "\r").tolist()
    assert len(h) == 10 and len(set(h)) == 9 and h[0] == h[-1]
    assert ngram_join.word_hashes("ABCDEFGHI")[0] == h[3] and ngram_join.word_hashes(" \x0b").size == 0
    assert ngram_join.word_hashes("a").tolist() == [h[0]]


def brute_components_fast(rows, n, num, den):
    """The same by an index of all n-grams, for more rows."""
    sets, first, root, at = [], {}, {}, {}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for d, text in rows:
        w = text.split()
        s = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        sets.append(s)
        root[d] = d
        if s in first:
            root[find(d)] = find(first[s])
            continue
        first[s] = d
        for x, k in Counter(x for g in s for x in at.get(g, ())).items():
            if den * k >= num * (len(s) + len(sets[x]) - k):
                a, b = sorted((find(d), find(x)))
                root[b] = a
        for g in s:
            at.setdefault(g, []).append(d)
    low = {}
    for d, _ in rows:
        low[find(d)] = min(low.get(find(d), d), d)
    return [(d, len(sets[d]), low[find(d)]) for d, _ in rows]


@pytest.mark.parametrize("step", ["one_of_each", "redact"])
def test_rows_dealt_anew_keep_their_numbers(spark, tmp_path, step):
    """The files are packed into other partitions between the first scan and the last, as on a cluster that lost an executor."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, text(i - i % 3) if i < 30 else text(i) + (" password: hunter22" if i % 4 == 0 else "")) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(24, "doc_id").write.parquet(f"{tmp_path}/docs")
    docs, conf = spark.read.parquet(f"{tmp_path}/docs"), ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    out = ngram_join.one_of_each(docs) if step == "one_of_each" else secrets_scan.redact(docs, f"{tmp_path}/ledger")
    try:
        spark.conf.set(conf[0], "1g")
        spark.conf.set(conf[1], "1")
        got = {r.doc_id: r.text for r in out.collect()}
    finally:
        for c in conf:
            spark.conf.unset(c)
    if step == "one_of_each":
        assert got == {i: t for i, t in rows if i >= 30 or i % 3 == 0}
    else:
        assert got == {i: t.replace("password: hunter22", "[secret]") for i, t in rows}


def otherwise_each_time(docs):
    """docs from a source that gives its rows in another order whenever it is read."""

    def run(frames):
        for frame in frames:
            yield frame.sample(frac=1)

    return docs.mapInPandas(run, docs.schema)


def test_no_text_is_missed_when_rows_are_dealt_anew(spark, tmp_path):
    rows = [(i, f"w{i} " * 30 + f"password: hunter{i}") for i in range(200)]
    docs = otherwise_each_time(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = {r.doc_id: len(r.found) for r in secrets_scan.scan_documents(docs, f"{tmp_path}/ledger").collect()}
    assert found == dict.fromkeys(range(200), 1)
    pages = spark.createDataFrame([(i, f"http://h{i}.example.com/a") for i in range(200)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.example.com", "/", "block") for i in range(200)], "host string, path string, verdict string")
    judged = url_filter.judge(otherwise_each_time(pages), listed, True).collect()
    assert {r.page_id: r.rule for r in judged} == {i: f"h{i}.example.com/" for i in range(200)}


def test_marks_may_hold_quotes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "password: hunter22 x")], "doc_id long, text string")
    assert secrets_scan.redact(docs, f"{tmp_path}/ledger", mark="<it's \\gone>").first().text == "<it's \\gone> x"


def test_one_of_each(corpus, nothing):
    kept = ngram_join.one_of_each(corpus)
    assert kept.columns == corpus.columns
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    full = [c for _, n, c in brute_components(docs, 5, 80, 100) if n]
    empty = sum(not BLANK_WORDS.findall(t or "") for _, t in docs)
    assert kept.count() == len(set(full)) + empty
    assert ngram_join.one_of_each(nothing).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 302), (302, 300), (7, 7), (400, 399)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300, 302: 300, 399: 399, 400: 399}
    assert components(spark.createDataFrame([], "a long, b long"), shared_dir(spark)).collect() == []


def brute_passages(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, passage in items:
        p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (passage or "").translate(LOWER))
        size = min(window, len(p))
        grams = {tuple(p[i : i + size]) for i in range(len(p) - size + 1)} if p else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("max_windows", [10_000, 12])
def test_wu_manber(corpus, spark, max_windows):
    texts = [r.text for r in corpus.orderBy("doc_id").collect()]
    items = [(1, texts[5]), (2, texts[6]), (10, "one"), (11, "one two"), (3, None), (4, ""), (5, texts[5]), (6, "same same same"), (7, "mira, LOKE ñune")]
    bench = spark.createDataFrame([(*i, "x") for i in items] + [(None, "one", "x")], "item_id long, text string, spans string")
    found = decontaminate.contamination(decontaminate.find_passages(corpus.select("doc_id", "text"), bench, 13, max_windows))
    got = sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found.collect())
    assert got == sorted(brute_passages(r.text, items) for r in corpus.collect())
    clean = decontaminate.uncontaminated(corpus, bench)
    assert clean.columns == corpus.columns
    assert clean.count() == sum(not (h > 0 and 20 * h >= n) for n, h, _, _ in got)


def test_wu_manber_of_nothing(corpus, nothing, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_passages(corpus, none).filter("size(spans) > 0").count() == 0
    assert decontaminate.find_passages(nothing, none).count() == 0


SECRETS = [
    "password: hunter22 and Token='abc_' api_key=ABCDEF123", "passwd = short", "password: token: abcdefgh", "é SECRET => x secret:\"zzzzzz\"", None, "",
    "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 12, "AKIA123", "f" * 24, "F" * 30, "0123456789abcdef01234567g", "日本 deadbeef" + "0" * 20, "ſecret: abcdefgh", "-----BEGIN RSA PRIVATE KEY-----",
]


def brute_secrets(text):
    cased = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    kinds = "|".join(map(cased, ("password", "passwd", "secret", "token", "api"))).replace(cased("api"), cased("api") + "_?" + cased("key"))
    assign = re.compile(rf"""({kinds})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_spans(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SECRETS * 2)], "doc_id long, text string, blob int").repartition(3)
    rows = secrets_scan.digest(secrets_scan.scan_documents(docs, f"{shared_dir(spark)}/ledger")).collect()
    assert len(rows) == len(SECRETS) * 2
    for r in rows:
        want = brute_secrets(SECRETS[r.doc_id % len(SECRETS)])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == (want.split(",") if want else [])
        assert r.n_assign == want.count("assign:")


def test_ledger_is_incremental(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    ledger, base = f"{shared_dir(spark)}/ledger", secrets_scan.BASE
    blobs = len({t or "" for t in SECRETS})
    assert secrets_scan.scan_new(docs, ledger, base).count() == 3 * blobs
    assert secrets_scan.scan_new(docs.union(docs), ledger, base).count() == 0
    more = docs.union(spark.createDataFrame([(99, "token=abcdefghi")], docs.schema))
    assert secrets_scan.scan_new(more, ledger, base).count() == 3
    from dataclasses import replace

    newer = (replace(base[0], version=2, least=100), *base[1:])
    assert secrets_scan.scan_new(more, ledger, newer).count() == blobs + 1
    assert secrets_scan.digest(secrets_scan.findings(more, ledger, newer)).agg(F.sum("n_assign")).first()[0] == 0
    assert secrets_scan.digest(secrets_scan.findings(more, ledger, base)).agg(F.sum("n_assign")).first()[0] > 0


def test_redact(spark, nothing, corpus):
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "k") for i, t in enumerate(SECRETS)], "doc_id long, text string, n_chars long, found string")
    got = {r.doc_id: r for r in secrets_scan.redact(docs, f"{shared_dir(spark)}/ledger").collect()}
    assert got[0].text == "[secret] and Token='abc_' [secret]" and got[0].n_chars == len(got[0].text)
    assert got[9].text == "[secret]" and got[4].text is None and got[1].text == "passwd = short" and got[12].text == "日本 [secret]"
    assert got[0].found == "k"
    assert secrets_scan.redact(nothing, f"{shared_dir(spark)}/ledger").collect() == []
    assert secrets_scan.redact(corpus, f"{shared_dir(spark)}/ledger").count() == corpus.count()


def test_private_keys_go_whole(spark):
    import base64
    import time

    raw = base64.b64encode(bytes(range(256)) * 2 + b"xyz").decode()
    body = "\n".join(raw[i : i + 64] for i in range(0, len(raw), 64))
    assert len(body.rsplit("\n", 1)[1]) < 64
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,0123\n\n"
    keys = [f"{head}\n{body}\n{end}", f"{head}\n{fields}{body}\n{end}", f"{head}\\n{body}\\n{end}".replace("\n", "\\n"), f"{head} {body} {end}".replace("\n", " ")]
    open_keys = [f"{head}\n{body}", f"{head}\n{fields}{body}", f"{head}\n{body}\n", f"{head}\r\n" + body.replace("\n", "\r\n"), f"{head}\n{body[:129]}"]
    texts = [f"é my key:\n{k}\nand some words" for k in keys] + [f"é my key:\n{k.rstrip()}\nand some words" for k in open_keys] + [f"{head} is how a key begins", f"{keys[0]}{keys[0]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in secrets_scan.redact(docs, f"{shared_dir(spark)}/ledger").orderBy("doc_id").collect()]
    assert got == ["é my key:\n[secret]\nand some words"] * 9 + ["[secret] is how a key begins", "[secret][secret]"]
    rule, many = next(r for r in secrets_scan.RULES if r.name == "private_key"), (f"{head}\n{body}\n" * 3000).encode()
    began = time.time()
    assert len(rule.spans(many, many.lower())) == 3000 and time.time() - began < 5


URLS = [
    "http://a.net/x", "http://net", "http://NET/", "https://www.example.net/en/1?q#f", "https://example.net/en", "http://xexample.net/de/", "http://b.example.com/de/", "http://example.com/en/",
    "ftp://x.org/fr/", "x.org/fr/", "", None, "http://", "http:///net/", "a://b://c.net/", "http://a.net?x=/", "http://a.org/fr/é", "http://net./x",
]


def brute_verdict(url, rules):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("use_join", [False, True])
def test_url_rules(spark, use_join):
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string")
    rules = spark.createDataFrame([(*r, 1) for r in url_filter.RULES] + [(None, "/", "block", 1)], "host string, path string, verdict string, key int")
    for r in url_filter.judge(pages, rules, use_join).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(URLS[r.page_id % len(URLS)], url_filter.RULES), URLS[r.page_id % len(URLS)]


@pytest.mark.parametrize(("max_bits", "max_parts"), [(url_filter.MAX_BITS, url_filter.MAX_PARTS), (6400, 48), (6400, 2)])
def test_cascade_with_many_keys(spark, monkeypatch, max_bits, max_parts):
    """Lists long enough for mistakes at several levels."""
    # As one filter, as several, and as a list too long for filters.
    monkeypatch.setattr(url_filter, "MAX_BITS", max_bits)
    monkeypatch.setattr(url_filter, "MAX_PARTS", max_parts)
    listed = [(f"h{i}.com", "/", "block" if i % 3 else "allow") for i in range(0, 3000, 2)]
    pages = [(i, f"http://h{i}.com/x") for i in range(3000)]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got == {i: (f"h{i}.com/" if i % 2 == 0 else None, "block" if i % 2 == 0 and i % 3 else "allow") for i in range(3000)}


def test_url_rules_of_nothing(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge(pages, rules).first().verdict == "allow"
    full = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    assert url_filter.judge(pages.filter("false"), full).collect() == []


def brute_counts(text):
    t = text or ""
    w = BLANK_WORDS.findall(t)
    lines, seen = 0, set()
    for line in t.split("\n"):
        if BLANK_WORDS.search(line):
            lines += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), lines, len(repeat)


def test_base_counts(corpus):
    got = quality_rules.judge(corpus)
    rows = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect())
    assert rows == sorted(brute_counts(r.text) for r in corpus.collect())
    assert got.filter("base_failed and kept").count() == 0
    assert got.filter("base_failed <> (n_words < 50 or 2 * n_repeat_words > n_words)").count() == 0


def test_outliers_are_rejected(spark, nothing):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    good = [(i, " ".join(word() for _ in range(r.randint(60, 300))), "en", "s") for i in range(400)]
    bad = [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "s") for i in range(20)]
    got = {x.doc_id: x.kept for x in quality_rules.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in range(400)) >= 398 and not any(got[1000 + i] for i in range(20))
    assert quality_rules.judge(nothing).collect() == []


def test_moderate_outliers_and_remainders(spark):
    import random

    r = random.Random(9)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n)]
    good = [(i, " ".join(words(r.randint(60, 300))), "en", "s") for i in range(300)]
    symbols = [(1000 + i, " ".join(w + ("#$" if k % 3 == 0 else "") for k, w in enumerate(words(150))), "en", "s") for i in range(10)]
    long = [(2000 + i, " ".join(w + w[:2] for w in words(150)), "en", "s") for i in range(10)]
    lines = [(3000 + i, "\n".join([x := " ".join(words(4)), *(" ".join(words(16)) for _ in range(4)), x]), "en", "s") for i in range(5)]
    few = [(4000 + i, " ".join(w + "###" for w in words(100)), "xx", "t") for i in range(5)] + [(5000 + i, " ".join(words(150)), "xx", "t") for i in range(5)]
    docs = spark.createDataFrame(good + symbols + long + lines + few, "doc_id long, text string, lang string, source string")
    rows = quality_rules.judge(docs).collect()
    got = {x.doc_id: x.kept for x in rows}
    assert len(rows) == docs.count() and all(x.d2 is not None for x in rows)
    assert not any(got[k] for k in got if 1000 <= k < 3000 or 4000 <= k < 5000)
    assert all(got[k] for k in got if 3000 <= k < 4000 or k >= 5000) and sum(got[i] for i in range(300)) >= 297


def test_chi_square():
    assert abs(quality_rules.chi2_quantile(0.975, 4) - 11.143) < 1e-3
    assert abs(quality_rules.chi2_cdf(6.0, 2) - 0.950213) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><script>var t="</p>";</script><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad -->
<div class="ad">Buy now, it is cheap.</div><article><h1>Head &amp; more</h1><p><b>First
 line.<br><p>Second &lt;x&gt; 1 < 2 &copy.</p><p>Be.</p></article><form>Send us your words about this page and we will read them all soon.</form><footer>&copy; us</footer>"""


def test_main_text(spark):
    tree = html_blocks.trained()
    assert html_blocks.main_text(PAGE, tree) == "Head & more First line. Second <x> 1 < 2 ©. Be."
    for page in html_blocks.PAGES:
        blocks = html_blocks.blocks_of(page)
        assert [html_blocks.is_main(tree, x) for x in html_blocks.features(blocks)] == [b.label for b in blocks]
    for odd in ("<", "<p", "<p>a<", "</p></p>", "<!-- x", "<script>x", "<a href='x>y", "&#xffffff;", "\0"):
        html_blocks.main_text(odd, tree)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in html_blocks.extract(pages).collect())
    assert got == [(0, 0, 0), (1, 47, 47), (1, 47, 47), (2, 0, 0)]
    assert html_blocks.extract(pages.filter("false")).collect() == []


def test_quality_model(spark, corpus, nothing):
    import random
    import zlib

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    texts = [" ".join(word() + ("$$$" if i % 5 == 0 else "") for _ in range(r.randint(20, 100))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)] + [(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, labels, max_rows=200)
    assert model.weights and all(0 < len(rule.terms) <= quality_model.DEPTH for rule, _ in model.weights)
    got = {x.doc_id: x.predicted for x in quality_model.score(docs.drop("score"), model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == (i % 5 != 0) for i in held) >= 0.97 * len(held)
    assert quality_model.score(corpus, model).count() == corpus.count()
    kept = quality_model.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())
    none = labels.filter("false")
    assert quality_model.score(docs.select("doc_id", "text"), quality_model.fit(docs, none)).agg(F.min("score")).first()[0] == 1.0
    one = quality_model.fit(docs, labels.filter("quality = 0"))
    assert quality_model.score(docs.select("doc_id", "text"), one).agg(F.max("predicted")).first()[0] == 0
    assert quality_model.score(nothing, model).collect() == []


def words(n):
    return " ".join(["word"] * n)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>Long text <span class="share">x</span> more text.</p></article>', "Long text x more text."),
        (f'<div><span class="search">q</span><p>{words(30)}</p><p>{words(40)}</p></div>', words(70)),
        ("<html><head><title>T</title><meta x><body><article><p>No head end here.</p></article>", "No head end here."),
        ("<article><svg viewBox=x><p>One two three.</p><p>Four</p></article>", "One two three. Four"),
        ("<article><select><p>One two three.</p></article>", "One two three."),
        ("<article><object data=x/><p>One two three.</p></article>", "One two three."),
        ("<article><svg><text>no</text></svg><p>One two three.</p><script>never ends", "One two three."),
        ('<article class="social-policy"><p>One two three.</p></article>', "One two three."),
        ('<article class="legal"><p>One two three.</p></article>', "One two three."),
        ('<article class="post notice"><p>One two three.</p></article>', "One two three."),
        ('<main id="follow"><p>One two three.</p></main>', "One two three."),
        ('<article><p>One two three.</p></article><section id="responses"><p>Well said, every word.</p></section>', "One two three."),
        ('<article><p>One two three.</p><article class="comment"><p>Well said, every word.</p></article></article>', "One two three."),
        ('<article><p>One two three.</p><div class="socialShare-buttons">Share this</div></article>', "One two three."),
        ("<article><p>So <math><mi>x</mi><mo>=</mo></math> it is</p></article>", "So x= it is"),
    ],
)
def test_markup_of_all_kinds(page, text):
    assert html_blocks.main_text(page, html_blocks.trained()) == text


def test_neighbours_decide_without_telling_names():
    """No article element and no names: short blocks among long ones stay, those among links go."""
    link = lambda n: f"<div><a href=x>{words(n)}</a></div>"
    body = f"<h1>{words(6)}</h1><p>{words(40)}</p><p>short one</p><p>{words(50)}</p><h2>{words(3)}</h2><p>{words(30)}</p>"
    page = f"<body>{link(1) * 4}{body}{link(7) * 3}<div>{words(5)}</div>{link(2) * 3}</body>"
    assert html_blocks.main_text(page, html_blocks.trained()) == " ".join([words(46), "short one", words(83)])
    used = set()

    def walk(node):
        if isinstance(node, html_blocks.Split):
            used.add(html_blocks.FEATURES[node.feature])
            walk(node.below), walk(node.above)

    walk(html_blocks.trained())
    assert used & {"words_before", "words_after"} and used & {"links_before", "links_after"}
    right = [html_blocks.is_main(html_blocks.trained(), x) == b.label for p in html_blocks.drawn(200, seed=99) for x, b in zip(html_blocks.features(p), p, strict=True)]
    assert sum(right) > 0.98 * len(right)
