import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopweave.llm import packing, token_files, tokens
from shopweave.llm.common import saved, shared_dir
from shopweave.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(tokenizer, tokenizer_path):
    enc, r = Encoder(tokenizer_path), random.Random(1)
    parts = ["the", " of", "\n", "  ", " \n", "\t", "É", "ñandú", "don't", "'s", "123", "²", "!!", " ###", "😀", "\u00a0", "\x1f", "<|endoftext|>", "日本", ".", ",", "Ω", "\r\n", "\0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    letters = "abcdefghijklmnopqrstuvwxyzéüñßàÂł"
    texts += [" ".join("".join(r.choices(letters, k=r.randint(1, 12))) + r.choice(("", "", ",", ".", "'s", "7")) for _ in range(30)) for _ in range(300)]
    for text, ids in zip(texts, enc.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, text), repr(text)
        assert r.random() < 0.9 or enc.encode(text) == ids


def test_texts_in_many_lots(tokenizer, tokenizer_path, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 3)
    monkeypatch.setattr(tokens, "TOGETHER", 100)
    enc, r = Encoder(tokenizer_path), random.Random(2)
    texts = [" ".join(f"w{r.randint(0, 400)}ord, {chr(97 + r.randint(0, 25))}x" for _ in range(9)) for _ in range(200)]
    for text, ids in zip(texts, enc.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, text)


class Asked:
    """A model that notes what it is asked."""

    def __init__(self, model):
        self.model, self.texts = model, []

    def tokenize(self, text):
        self.texts.append(text)
        return self.model.tokenize(text)


def test_each_piece_is_asked_once(tokenizer, tokenizer_path):
    enc = Encoder(tokenizer_path)
    enc.model = asked = Asked(enc.model)
    texts = [" ".join(f"{a} word, 7 wörd. word!\n{b}{a}'s" for b in "xyz") for a in ("new", "old", "odd")]
    for text, ids in zip(texts, enc.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, text)
    letters = "".join(asked.texts)
    assert [letters.count(x) for x in ("Ġword", "ĠwÃ¶rd", "'s", "Ġ7", "xnew")] == [1] * 5
    # All but the line break itself, and the nothing behind the last piece, in one call.
    assert sum(x not in ("", "Ċ") for x in asked.texts) == 1


def test_pieces_one_by_one(tokenizer_path):
    """Where tokens may go over the border of two pieces, pieces are asked one by one."""
    one, many, r = Encoder(tokenizer_path), Encoder(tokenizer_path), random.Random(4)
    assert many.in_runs
    one.in_runs = False
    texts = ["".join(r.choice(["a", "Été", " b", " 7", "\nc", ".", "'s", " '", "\n"]) for _ in range(r.randint(1, 12))) for _ in range(500)]
    assert list(one.encode_all(texts)) == list(many.encode_all(texts))
    units = pa.array([" ", "\n", "", " a,b", "日", "\nx"], pa.large_string())
    for enc in (one, many):
        ids, starts, lengths, usual = enc.ids_of(units)
        got = [ids[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
        assert usual.tolist() == [True] * 4 + [False, True]
        assert got == [b"" if u == "日" else enc.whole(u) for u in units.to_pylist()]


@pytest.mark.parametrize("merge", [("Ċ", "a"), ("b", "Ċ"), ("b", "Ġ"), ("Ġ", "a")])
def test_tokens_over_borders(tmp_path, merge):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {c: i for i, c in enumerate([*tokens.byte_letters().values(), "".join(merge)])}
    made = Tokenizer(models.BPE(vocabulary, [merge]))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(path := str(tmp_path / "tokenizer.json"))
    enc = Encoder(path)
    assert enc.in_runs == (merge == ("Ġ", "a"))
    for text in ("b a\na b\nb", "ab, ab\nab"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids_of(made, text)


def test_ranks_round_trip():
    r = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.rank_bytes(ranks)
        assert token_files.ranks_of(control, data, n).tolist() == ranks.tolist()


def test_file_round_trip():
    ids = [np.array(x, "<u4") for x in ([5, 5, 5, 9], [], [70000, 5])]
    doc_ids, each, got = token_files.documents_of(token_files.file_bytes([3, None, 7], [x.tobytes() for x in ids]))
    assert (doc_ids, each.tolist(), got.tolist()) == ([3, None, 7], [4, 0, 2], [5, 5, 5, 9, 70000, 5])
    with pytest.raises(ValueError):
        token_files.documents_of(b"????" + bytes(40))


def test_token_files(corpus, tokenizer, tokenizer_path):
    folder = shared_dir(corpus.sparkSession)
    # Files of an attempt that was lost lie in the same folder and are not read.
    token_files.write_token_files(corpus, f"{folder}/a", tokenizer_path, 7, file_ids=400).collect()
    files = saved(token_files.write_token_files(corpus, f"{folder}/a", tokenizer_path, 2, file_ids=500), f"{folder}/f")
    assert files.count() > 4
    got = sorted(token_files.read_token_files(files, f"{folder}/a").collect(), key=lambda r: r.start)
    at, before = 0, (False, 0)
    for g in got:
        assert g.start == at and g.n_tokens == len(g.ids) and g.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes())
        assert before <= (before := (g.doc_id is not None, g.doc_id or 0))
        at += g.n_tokens
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((g.doc_id, list(g.ids)) for g in got), key=key) == sorted(((r.doc_id, [*ids_of(tokenizer, r.text), 2]) for r in corpus.collect()), key=key)


def test_token_files_of_nothing(nothing, tokenizer_path):
    folder = shared_dir(nothing.sparkSession)
    files = saved(token_files.write_token_files(nothing, f"{folder}/a", tokenizer_path, 2), f"{folder}/f")
    assert token_files.read_token_files(files, f"{folder}/a").collect() == []


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)]
    assert packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_sum_of_squares_rule():
    """Each step takes a place with the least sum of squared counts, found by trying all."""
    r = random.Random(3)
    size, lengths = 20, [r.randint(1, 19) for _ in range(300)]
    bins, offsets = packing.sum_of_squares(np.array(lengths), size)
    left: dict[int, int] = {}

    def cost(gaps):
        return sum(gaps.count(g) ** 2 for g in set(gaps) if g)

    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        gaps = list(left.values())
        tries = [cost([*gaps, size - n])]
        for g in {g for g in gaps if g >= n}:
            other = list(gaps)
            other.remove(g)
            tries.append(cost([*other, g - n]))
        assert o == size - left.get(b, size)
        left[b] = left.get(b, size) - n
        assert left[b] >= 0 and cost(list(left.values())) == min(tries)


def test_packing(corpus, tokenizer, tokenizer_path):
    rows = packing.pack_documents(corpus, tokenizer_path, 0, 64, group=20).collect()
    sequences: dict[int, list] = {}
    docs: dict[tuple, list] = {}
    for r in rows:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.row), []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    texts = sorted(([*ids_of(tokenizer, r.text), 0] for r in corpus.collect()))
    made = []
    for own in docs.values():
        own.sort(key=lambda r: r.piece)
        assert all(r.length == 64 for r in own[1:])
        made.append([i for r in own for i in r.ids])
    assert sorted(made) == texts
    # Two bins may stay part-filled in each of the groups, beside the least number possible.
    assert len(sequences) <= -(-sum(map(len, texts)) // 64) + 2 * max(1, -(-len(rows) // 20))


def test_packing_nothing(nothing, tokenizer_path):
    assert packing.pack_documents(nothing, tokenizer_path, 0, 64).collect() == []


def test_pieces_count(corpus, tokenizer_path):
    n = packing.document_pieces(corpus, tokenizer_path, 0, 64, with_ids=False).agg(F.countDistinct("row")).first()[0]
    assert n == corpus.count()
