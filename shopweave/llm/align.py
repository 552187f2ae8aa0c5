"""Cross-tokenizer alignment: groups of tokens between shared ends, found by divide and conquer, and which ids go together.

A (byte-level BPE) and B (SentencePiece BPE) cut the same bytes, a space and the text. An interval whose end is shared is
searched for a common end of a token near its middle: tokens of A from the middle outwards, each looked up among the ends of B by
bisection; both halves are searched in the same way, and an interval without a common end inside is a leaf: one group. All
intervals of a level are searched together in numpy; one where the common end is far from the middle is looked through as a whole.

Both tokenizers end a token before a single space or line break, so texts start as the intervals between these, and an
interval that recurs among the texts of a lot (a word, mostly) is tokenised and divided once. Where that reasoning might not hold
(white space in a row or at an end, unusual characters, other kinds of models) a text is one interval, and the libraries tokenise it whole.

Lots of LOT characters of text (or one longer text) are written as one row each: what the digests need, which interval stands where,
and the lot's different id pairs with the number of its documents that hold them. Pairs are summed over lots; the sums go back to the
lots that have the pair, so no link of a document is ever dealt out, and a pair that all documents have is one row a lot.

Defined results: null and empty texts, and texts whose bytes the ids of A or B do not give back, have no tokens; rows of
one doc_id are rows of their own, and each counts; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import no_null, saved, shared_dir
from shopweave.llm.tokens import BLANKS, Encoder, worker_memory

#: Characters of text in a lot: a worker's memory follows it. Texts of a batch that are made Python's at a time.
LOT, ROWS = 1_000_000, 200
#: Tokens looked at on each side of the middle before an interval is looked through as a whole.
NEAR = 8


# Divide and conquer


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B end where one of the other ends.

    ends are ascending byte offsets on one axis; known_a and known_b are the numbers of the tokens that end the first intervals.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    cut_a[known_a], cut_b[known_b] = True, True
    # Intervals: tokens lo <= i < hi of A, low <= j < high of B, the last of each ending together.
    hi, high = known_a + 1, known_b + 1
    lo, low = np.append(0, hi)[:-1], np.append(0, high)[:-1]
    while True:
        open_ = (hi - lo > 1) & (high - low > 1)
        lo, hi, low, high = lo[open_], hi[open_], low[open_], high[open_]
        if not len(lo):
            return cut_a, cut_b
        at_a, at_b = near_middle(ends_a, ends_b, lo, hi, low, high)
        found = at_a >= 0
        lo, hi, low, high, at_a, at_b = (x[found] for x in (lo, hi, low, high, at_a, at_b))
        cut_a[at_a], cut_b[at_b] = True, True
        lo, hi = np.concatenate([lo, at_a + 1]), np.concatenate([at_a + 1, hi])
        low, high = np.concatenate([low, at_b + 1]), np.concatenate([at_b + 1, high])


def near_middle(ends_a, ends_b, lo, hi, low, high) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the tokens of a common end inside it that is near its middle, or -1."""
    at_a, at_b = np.full(len(lo), -1), np.full(len(lo), -1)
    middle, left = (lo + hi - 2) // 2, np.arange(len(lo))
    for k in range(2 * NEAR):
        token = middle[left] + ((k + 1) // 2 if k % 2 else -(k // 2))
        inside = (token >= lo[left]) & (token < hi[left] - 1)
        asked, token = left[inside], token[inside]
        b = np.searchsorted(ends_b, ends_a[token])
        same = ends_b[b] == ends_a[token]
        at_a[asked[same]], at_b[asked[same]] = token[same], b[same]
        # An interval is done when it has its cut or no token is left at this distance on either side.
        far = (k + 1) // 2
        left = left[(at_a[left] < 0) & ((middle[left] - far >= lo[left]) | (middle[left] + far < hi[left] - 1))]
        if not len(left):
            return at_a, at_b
    for i in left.tolist():
        tokens = np.arange(lo[i], hi[i] - 1)
        b = np.searchsorted(ends_b, ends_a[tokens])
        both = np.flatnonzero(ends_b[b] == ends_a[tokens])
        if len(both):
            k = both[np.abs(tokens[both] - middle[i]).argmin()]
            at_a[i], at_b[i] = tokens[k], b[k]
    return at_a, at_b


def links(ends_a: np.ndarray, ends_b: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last byte, token of A, token of B) of every overlapping pair: one for each stretch between successive ends."""
    stretch = np.sort(np.concatenate([ends_a, ends_b[~cut_b]]), kind="stable")
    return stretch, np.searchsorted(ends_a, stretch), np.searchsorted(ends_b, stretch)


# Tokens of both


class Plain(Encoder):
    """Ids of a space and the text, strings of special tokens being plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []

    def whole(self, text: str) -> bytes:
        return super().whole(" " + text)


class Both:
    """The ids of both tokenizers for many texts."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = Plain(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: b for b, letter in self.a.letters.items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        usual = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        # Cuts before single blanks hold for B where no piece has a blank behind another character or a line break.
        first = self.b.encode("a\nb", out_type=str)
        self.in_units = self.a.plain and not any("▁" in p.lstrip("▁") or "\n" in p for p in usual) and first[0] == "▁a" and first[1] == "<0x0A>"
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.len_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.len_b = np.array(list(map(len, self.bytes_b)), np.int64)
        digits = lambda n, end: [b"%d" % i + end for i in range(n)]
        #: Ids in decimal with what follows them: within A, last of A, within B, last of B.
        self.decimal = digits(self.n_a, b",") + digits(self.n_a, b"|") + digits(self.n_b, b",") + digits(self.n_b, b";")
        self.len_decimal = np.array(list(map(len, self.decimal)), np.int64)

    def cuttable(self, text: str) -> bool:
        return self.in_units and text != "" and text[0] not in " \n" and text[-1] not in " \n" and not any(b in text for b in BLANKS)

    def ids_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of B of units that begin with a space or a line break, one behind the other, and how many each has."""
        got = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1) if units else []
        # Before a line break the model puts a blank that does not belong to the unit.
        got = [ids if u[0] == " " else ids[1:] for u, ids in zip(units, got, strict=True)]
        return np.fromiter(chain.from_iterable(got), np.int64), np.array(list(map(len, got)), np.int64)

    def lot(self, texts: list[str]) -> Lot:
        """Each text as a list of units, units with their tokens."""
        fine = np.array([self.cuttable(t) for t in texts], bool)
        joined = pa.array([t for t, f in zip(texts, fine, strict=True) if f], pa.large_string())
        cut = pc.replace_substring(pc.replace_substring(joined, " ", "\0 "), "\n", "\0\n")
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), cut, pa.scalar("", pa.large_string())), "\0")
        coded = lists.flatten().dictionary_encode()
        # The library's regular expressions and ours agree on usual characters only.
        usual = pc.match_substring_regex(coded.dictionary, r"^[\n -~¡-ɏ]*$").to_numpy(zero_copy_only=False)
        at, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy()
        strange = np.concatenate([[0], np.cumsum(~usual[at])])[bounds]
        fine[np.flatnonzero(fine)[np.diff(strange) > 0]] = False
        keep = usual[at] & np.repeat(np.diff(strange) == 0, np.diff(bounds))
        used = np.zeros(len(usual), bool)
        used[at[keep]] = True
        units = coded.dictionary.filter(pa.array(used))
        number = np.cumsum(used) - 1
        # Texts taken whole are units of their own, behind the others.
        alone = np.flatnonzero(~fine & np.array([t != "" for t in texts], bool))
        of_units = number[at[keep]].astype(np.int64)
        n_units = np.zeros(len(texts), np.int64)
        n_units[fine] = np.diff(bounds)[np.diff(strange) == 0]
        n_units[alone] = 1
        offsets = np.append(0, np.cumsum(n_units))
        where = np.empty(offsets[-1], np.int64)
        is_alone = np.zeros(offsets[-1], bool)
        is_alone[offsets[:-1][alone]] = True
        where[~is_alone] = of_units
        where[is_alone] = len(units) + np.arange(len(alone))

        ids, starts, lengths, _ = self.a.ids_of(units)
        ends = np.cumsum(lengths)
        ids_a = ids[np.arange(lengths.sum()) + np.repeat(starts - (ends - lengths), lengths)].astype(np.int64)
        names = units.to_pylist()
        ids_b, n_b = self.ids_b(names)
        whole = [texts[i] for i in alone.tolist()]
        more_a = [np.frombuffer(self.a.whole(t), "<u4").astype(np.int64) for t in whole]
        more_b = [np.array(self.b.encode(t, num_threads=1), np.int64) for t in whole]
        lengths, n_b = (np.concatenate([n, np.array(list(map(len, more)), np.int64)]) for n, more in ((lengths, more_a), (n_b, more_b)))
        names = [u.encode() for u in names] + [b" " + t.encode() for t in whole]
        return Lot(self, names, np.concatenate([ids_a, *more_a]), lengths, np.concatenate([ids_b, *more_b]), n_b, where, offsets)


def both(path_a: str, path_b: str) -> Both:
    memory = worker_memory()
    if getattr(memory, "both_paths", None) != (path_a, path_b):
        memory.both, memory.both_paths = Both(path_a, path_b), (path_a, path_b)
    return memory.both


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of successive runs."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


class Lot:
    """Texts as units, and units as groups of tokens.

    where: the unit of each place, offsets: where each text's places start. Texts with a unit whose bytes do not come back have no places.
    """

    def __init__(self, kinds: Both, names: list[bytes], ids_a, n_a, ids_b, n_b, where, offsets):
        good = self.comes_back(kinds, names, ids_a, n_a, ids_b, n_b)
        lost = np.diff(np.concatenate([[0], np.cumsum(~good[where])])[offsets]) > 0
        where = where[np.repeat(~lost, np.diff(offsets))]
        offsets = np.append(0, np.cumsum(np.where(lost, 0, np.diff(offsets))))
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)

        self.kinds, self.where, self.offsets, self.ids_a, self.ids_b = kinds, where, offsets, ids_a, ids_b
        self.ends_a, self.ends_b = np.cumsum(kinds.len_a[ids_a]), np.cumsum(kinds.len_b[ids_b])
        last_a, last_b = (np.cumsum(n)[good] - 1 for n in (n_a, n_b))
        self.cut_a, self.cut_b = shared_ends(self.ends_a, self.ends_b, last_a, last_b)
        self.bounds_a, self.bounds_b = (np.append(0, np.cumsum(n)) for n in (n_a, n_b))
        self.n_groups = sums(self.cut_a, self.bounds_a)

    @staticmethod
    def comes_back(kinds: Both, names, ids_a, n_a, ids_b, n_b) -> np.ndarray:
        """Units whose bytes the ids of A and of B give."""
        out = np.ones(len(names), bool)
        size = np.array(list(map(len, names)), np.int64)
        for ids, n, table, length in ((ids_a, n_a, kinds.bytes_a, kinds.len_a), (ids_b, n_b, kinds.bytes_b, kinds.len_b)):
            bounds = np.append(0, np.cumsum(n))
            content = b"".join(map(table.__getitem__, ids.tolist()))
            at = np.append(0, np.cumsum(length[ids]))[bounds]
            out &= np.diff(at) == size
            if content != b"".join(names):
                out &= np.array([content[s:e] == name for s, e, name in zip(at[:-1].tolist(), at[1:].tolist(), names, strict=True)], bool)
        return out & (size > 0)

    def of_texts(self, of_units: np.ndarray) -> np.ndarray:
        """What the units of each text sum to."""
        return sums(of_units[self.where], self.offsets)

    def spelled(self) -> list[bytes]:
        """Of each unit its groups: a1,a2|b1;a3|b2,b3; with a semicolon at the end."""
        k = self.kinds
        group_a, group_b = (np.cumsum(cut) - cut for cut in (self.cut_a, self.cut_b))
        # A token of A stands behind the tokens of B of earlier groups, a token of B behind those of A up to its own group.
        ends_of_a, ends_of_b = np.flatnonzero(self.cut_a) + 1, np.append(0, np.flatnonzero(self.cut_b) + 1)
        order = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        order[np.arange(len(self.ids_a)) + ends_of_b[group_a]] = self.ids_a + k.n_a * self.cut_a
        order[np.arange(len(self.ids_b)) + ends_of_a[group_b]] = 2 * k.n_a + self.ids_b + k.n_b * self.cut_b
        content = b"".join(map(k.decimal.__getitem__, order.tolist()))
        at = np.append(0, np.cumsum(k.len_decimal[order]))[self.bounds_a + self.bounds_b].tolist()
        return [content[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]

    def digests(self) -> list[str]:
        names, at, where = self.spelled(), self.offsets.tolist(), self.where.tolist()
        return [hashlib.sha256(b"".join(map(names.__getitem__, where[s:e]))[:-1]).hexdigest() if e > s else "" for s, e in zip(at[:-1], at[1:], strict=True)]

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """The id pair of every link of the units (A's id * n_b + B's id), and where each unit's links start."""
        stretch, a, b = links(self.ends_a, self.ends_b, self.cut_b)
        ends = np.append(0, self.ends_a)[self.bounds_a]
        return self.ids_a[a] * self.kinds.n_b + self.ids_b[b], np.searchsorted(stretch, ends, "right")

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs, ascending; how many texts hold each; the pair's number for each link, and where units' links start."""
        key, bounds = self.linked()
        different, number = np.unique(key, return_inverse=True)
        # Once for each text and unit, then once for each text and pair.
        text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        n = max(1, len(bounds) - 1)
        held = np.unique(text * n + self.where)
        text, unit = held // n, held % n
        many = np.diff(bounds)[unit]
        ends = np.cumsum(many)
        link = np.arange(many.sum()) + np.repeat(bounds[unit] - (ends - many), many)
        m = max(1, len(different))
        held = np.unique(np.repeat(text, many) * m + number[link])
        return different, np.bincount(held % m, minlength=len(different)), number, bounds


# Spark


LOTS = (
    "lot long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
    "places binary, offsets binary, numbers binary, linked binary, pairs array<long>, held array<int>"
)
DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, groups array<struct<start:bigint,end:bigint,a:array<int>,b:array<int>>>"


def in_lots(batches, size: int):
    """(doc_ids, texts) of size characters together, or one longer text."""
    doc_ids, texts, held = [], [], 0
    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and held + len(text) > size:
                yield doc_ids, texts
                doc_ids, texts, held = [], [], 0
            doc_ids.append(doc_id)
            texts.append(text)
            held += len(text)
    if texts:
        yield doc_ids, texts


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from nought on, each in as few bytes as the largest needs."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0)).newbyteorder("<")).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.zeros(0, np.int64)


def lot_row(kinds: Both, no: int, doc_ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """A lot's row of LOTS; what it was made of is freed with the call."""
    lot = kinds.lot(texts)
    different, held, number, bounds = lot.pairs()
    counts = [lot.of_texts(np.diff(b)) for b in (lot.bounds_a, lot.bounds_b)] + [lot.of_texts(lot.n_groups)]
    raw = [packed(lot.where), lot.offsets.astype("<i8").tobytes(), packed(number), np.diff(bounds).astype("<i4").tobytes()]
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([no], pa.int64()), pa.array([doc_ids], longs), *[pa.array([c], longs) for c in counts], pa.array([lot.digests()], pa.list_(pa.string()))]
        + [pa.array([r], pa.binary()) for r in raw]
        + [pa.array([different], longs), pa.array([held.astype(np.int32)], pa.list_(pa.int32()))],
        names=[c.split()[0] for c in LOTS.split(", ")],
    )


def lots(docs: DataFrame, path_a: str, path_b: str, size: int = LOT) -> DataFrame:
    """A row for each lot of documents (doc_id, text), to be run once (save it)."""

    def run(batches):
        kinds, no = both(path_a, path_b), TaskContext.get().partitionId() << 31
        for k, (doc_ids, texts) in enumerate(in_lots(batches, size)):
            yield lot_row(kinds, no + k, doc_ids, texts)
            pa.default_memory_pool().release_unused()

    rows = no_null(docs.select(F.col("doc_id").cast("long"), "text"), "text")
    return rows.mapInArrow(run, LOTS)


def pair_counts(of_lots: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): in how many documents ids of A and B (A's id * n_b + B's id) are linked, and whether no other B has more for A."""
    listed = of_lots.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").cast("long").alias("held"))
    counts = listed.groupBy("pair").agg(F.sum("held").alias("count"))
    counts = saved(counts.withColumn("a_id", F.expr(f"pair div {n_b}")), shared_dir(of_lots.sparkSession))
    # As many rows as A has ids, at most.
    most = counts.groupBy("a_id").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "a_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def document_counts(of_lots: DataFrame, counts: DataFrame) -> DataFrame:
    """The digest columns of each document, from written lots and the pairs' counts."""
    listed = of_lots.select("lot", F.explode("pairs").alias("pair")).join(counts, "pair").select(F.col("lot").alias("of_lot"), "pair", "count", "best")

    def run(lot: pa.Table, pairs: pa.Table) -> pa.Table:
        row = {c: lot.column(c)[0] for c in lot.column_names}
        offsets, linked = (np.frombuffer(row[c].as_py(), kind) for c, kind in (("offsets", "<i8"), ("linked", "<i4")))
        bounds = np.append(0, np.cumsum(linked))
        where, number = unpacked(row["places"].as_py(), offsets[-1]), unpacked(row["numbers"].as_py(), bounds[-1])
        order = np.argsort(pairs.column("pair").to_numpy())
        # Links of a unit, then units of a document.
        each = [pairs.column("count").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64), np.ones(len(order), np.int64)]
        count, best, n = (sums(sums(of_pair[number], bounds)[where], offsets) for of_pair in each)
        same = [row[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups")]
        return pa.Table.from_arrays([*same, pa.array(n), pa.array(best), pa.array(count), row["digests"].values], names=[c.split()[0] for c in DOCS.split(", ")])

    fields = of_lots.select(*[c.split()[0] for c in LOTS.split(", ") if c.split()[0] not in ("pairs", "held")])
    return fields.groupBy("lot").cogroup(listed.groupBy("of_lot")).applyInArrow(run, DOCS)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups) of documents: for each group its bytes (of a space and the text) and the ids of A and B in it."""

    def run(batches):
        kinds = both(path_a, path_b)
        for doc_ids, texts in in_lots(batches, LOT // 8):
            lot = kinds.lot(texts)
            out = []
            for s, e in zip(lot.offsets[:-1].tolist(), lot.offsets[1:].tolist(), strict=True):
                groups, start = [], 0
                for u in lot.where[s:e].tolist():
                    a0, a1, b0, b1 = lot.bounds_a[u], lot.bounds_a[u + 1], lot.bounds_b[u], lot.bounds_b[u + 1]
                    base = start - (lot.ends_a[a0 - 1] if a0 else 0)
                    last_a, last_b = np.flatnonzero(lot.cut_a[a0:a1]) + a0 + 1, np.flatnonzero(lot.cut_b[b0:b1]) + b0 + 1
                    for p, q, r, t in zip([a0, *last_a[:-1]], last_a, [b0, *last_b[:-1]], last_b, strict=True):
                        end = int(base + lot.ends_a[q - 1])
                        groups.append({"start": start, "end": end, "a": lot.ids_a[p:q].tolist(), "b": lot.ids_b[r:t].tolist()})
                        start = end
                out.append(groups)
            ints = pa.list_(pa.int32())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", ints), ("b", ints)]))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(out, kind)], names=["doc_id", "groups"])

    return no_null(docs.select(F.col("doc_id").cast("long"), "text"), "text").mapInArrow(run, GROUPS)


def op12_halved_alignment(spark, sf_dir: str) -> DataFrame:
    """Groups and links of both public tokenizers over all documents."""
    import public_tokenizers
    import sentencepiece

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    of_lots = saved(lots(spark.read.parquet(f"{sf_dir}/documents.parquet"), a, b), shared_dir(spark))
    n_b = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    return document_counts(of_lots, pair_counts(of_lots, n_b))
