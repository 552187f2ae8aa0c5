import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Small documents with every odd case: nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""
    r = random.Random(5)
    words = [a + b for a in ("be", "lo", "mi", "ta", "ñu", "É") for b in ("ra", "ke", "sto", "ne", "x.", "y,", "'s")]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [make(r.randint(1, 90)) for _ in range(30)]
    base = make(120).split(" ")
    for _ in range(12):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = r.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), None, "", "   ", "\n\n", "one", "one two", "ONE two", make(4000), "a\tb\nc  d\r\n e", "x<|endoftext|>y", "日本語 の テキスト 😀"]
    texts += ["line one is here\n" * 40, "same same same " * 40, "!!! ### $$$ %%% " * 30]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s", "s", "t", None]), None if t is None else len(t), "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "a row without an id", None, None, 3, None, None), (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row string, n_words int")


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
