"""Alignment of two tokenizers against a plain walk over every byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from shopweave.llm import align
from shopweave.llm.common import saved, shared_dir
from shopweave.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {v: k for k, v in byte_letters().items()}

    def of(text):
        """(id, bytes) of each token of A and of B, or nothing."""
        if not text:
            return [], []
        own = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        want = (" " + text).encode()
        return (own, other) if all(b"".join(x for _, x in t) == want for t in (own, other)) else ([], [])

    return of


def spans(tokens):
    out, at = [], 0
    for i, content in tokens:
        out.append((i, at, at + len(content)))
        at += len(content)
    return out


def by_hand(texts, of):
    links, groups, sizes = [], [], []
    for text in texts:
        a, b = map(spans, of(text))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        made, start = [], 0
        for cut in cuts:
            made.append((start, cut, [i for i, s, e in a if start <= s and e <= cut], [i for i, s, e in b if start <= s and e <= cut]))
            start = cut
        own, k = [], 0
        for i, s, e in a:
            while k < len(b) and b[k][2] <= s:
                k += 1
            m = k
            while m < len(b) and b[m][1] < e:
                own.append((i, b[m][0]))
                m += 1
        links.append(own), groups.append(made), sizes.append((len(a), len(b)))
    count = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for own, made, (n_a, n_b) in zip(links, groups, sizes, strict=True):
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, _, x, y in made)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(made), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), digest))
    return out, groups, count


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(4)
    parts = ["the", " of", "\n", "  ", " \n", "\t", "É", "ñandú", " don't", "'s", "123", "²", "!!", " ###", "😀", " ", "\x1f", "<|endoftext|>", "<s>", "</s>", "<0x41>", "日本", ".", ",", "Ω", "\r\n", "\0", "▁", "é", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(600)]
    letters = "abcdefghijklmnopqrstuvwxyzéüñßàÂł"
    texts += [" ".join("".join(r.choices(letters, k=r.randint(1, 12))) + r.choice(("", "", ",", ".", "'s", "7", "\nx")) for _ in range(30)) for _ in range(80)]
    texts += [None, "", " ", "\n", "a", " a", "a ", "a\n", "日" * 400, "x" * 5000, "🙂é" * 200, "</s><unk>", "ab cd " * 300]
    return texts


def counted(spark, texts, size):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id int, text string, lot string, pairs int").repartition(3)
    of_lots = saved(align.lots(docs, A, B, size), shared_dir(spark))
    rows = align.document_counts(of_lots, align.pair_counts(of_lots, 32000)).collect()
    return of_lots.count(), [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("size", [2000, align.LOT])
def test_documents_equal_a_plain_walk(spark, odd_texts, libraries, size):
    want, _, _ = by_hand(odd_texts, libraries)
    n, got = counted(spark, odd_texts, size)
    assert got == want
    assert n > 10 or size == align.LOT
    # B gives a space back for this letter.
    lost = [w for w, t in zip(want, odd_texts, strict=True) if t and "▁" in t]
    assert lost and all(w == (0, 0, 0, 0, 0, 0, "") for w in lost)


def test_groups_and_pairs(spark, odd_texts, libraries):
    docs = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    _, groups, count = by_hand(odd_texts, libraries)
    got = {r.doc_id: [(g.start, g.end, list(g.a), list(g.b)) for g in r.groups] for r in align.aligned(docs, A, B).collect()}
    assert got == dict(enumerate(groups))
    of_lots = saved(align.lots(docs, A, B, 3000), shared_dir(spark))
    assert {(r.pair // 32000, r.pair % 32000): r["count"] for r in align.pair_counts(of_lots, 32000).collect()} == count


def test_units_and_whole_texts_agree(odd_texts):
    kinds = align.Both(A, B)
    texts = [t or "" for t in odd_texts]
    assert sum(map(kinds.cuttable, texts)) > 100
    one = kinds.lot(texts)
    kinds.in_units = False
    other = kinds.lot(texts)
    assert one.digests() == other.digests()
    assert one.of_texts(one.n_groups).tolist() == other.of_texts(other.n_groups).tolist()


@pytest.mark.parametrize("near", [1, 8])
def test_halving_finds_every_shared_end(near, monkeypatch):
    monkeypatch.setattr(align, "NEAR", near)
    r = np.random.default_rng(6)
    for n, share in [(1, 1), (2, 0.5), (40, 0.3), (400, 0.02), (400, 0.9), (3000, 0.0)]:
        for _ in range(8):
            size = 4 * n
            ends = [np.append(np.flatnonzero(r.random(size - 1) < 0.3) + 1, size) for _ in range(2)]
            common = np.flatnonzero(r.random(size - 1) < share * 0.3) + 1
            ends = [np.unique(np.append(e, common)) for e in ends]
            first = np.array([size])
            known = [np.searchsorted(e, first) for e in ends]
            cut = align.shared_ends(*ends, *known)
            both = np.intersect1d(*ends)
            assert [e[c].tolist() for e, c in zip(ends, cut, strict=True)] == [both.tolist()] * 2
            stretch, a, b = align.links(*ends, cut[1])
            start = [np.append(0, e[:-1]) for e in ends]
            overlap = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if start[0][i] < ends[1][j] and start[1][j] < ends[0][i]] if n < 3000 else list(zip(a.tolist(), b.tolist(), strict=True))
            assert list(zip(a.tolist(), b.tolist(), strict=True)) == overlap and len(stretch) == len(ends[0]) + len(ends[1]) - len(both)


def test_nothing_and_repeats(spark, nothing, corpus, libraries):
    of_lots = saved(align.lots(nothing, A, B), shared_dir(spark))
    assert align.document_counts(of_lots, align.pair_counts(of_lots, 32000)).collect() == []
    assert align.aligned(nothing, A, B).collect() == []
    rows = corpus.collect()
    want, _, _ = by_hand([r.text for r in rows], libraries)
    of_lots = saved(align.lots(corpus, A, B, 5000), shared_dir(spark))
    got = align.document_counts(of_lots, align.pair_counts(of_lots, 32000)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, got)) == sorted(key((r.doc_id, *w)) for r, w in zip(rows, want, strict=True))


def test_a_worker_holds_one_small_lot():
    """However many texts a batch brings, what a worker makes of them at a time stays small."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(40_000)]
    texts = [" ".join(r.choices(words, k=500)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    kinds, n, taken = align.Both(A, B), 0, []
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for doc_ids, own in align.in_lots([batch], align.LOT):
        lot = kinds.lot(own)
        lot.pairs(), lot.digests()
        taken += doc_ids
        n += 1
        del lot
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert taken == list(range(len(texts))) and n > 1
    assert most < 80e6


def test_numbers_are_as_wide_as_they_must_be():
    for largest in (0, 255, 256, 65_535, 65_536, 2**33):
        numbers = np.array([0, largest, 1], np.int64)
        raw = align.packed(numbers)
        assert align.unpacked(raw, 3).tolist() == numbers.tolist()
        assert len(raw) == 3 * np.min_scalar_type(largest).itemsize
    assert align.packed(numbers[:0]) == b"" and len(align.unpacked(b"", 0)) == 0
