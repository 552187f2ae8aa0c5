"""Benchmark passages in documents, found by Wu-Manber search over words.

Patterns are windows of consecutive benchmark words. As in the published method, a table says for every block of
two words how far the search may jump when it sees that block at the end of the window it looks at: the distance from the block's
last place in any pattern to the pattern's end, or, for a block in no pattern, past it. Where the jump is nought, the
patterns that end in this block are listed by their first block; those that begin right are compared word for word.
Patterns of different lengths form searches of their own, so that one short item does not shorten all jumps; those of
one word are single look-ups.

Words: ASCII letters and digits and all characters beyond ASCII; A-Z are lower-cased; all else parts words. The items pass
the driver as a stream and go to the executors in blocks of at most MAX_WINDOWS words (or one item), so what a worker holds is
bounded. A benchmark of one block needs no shuffle of documents. A larger one takes one search after the other over numbered
documents, each with a written table of the rows it hits, and these tables are then merged and joined by number.

Null texts have no words; very long texts are searched whole, in one task. Documents may repeat or lack doc_id: each row is
judged by itself. Items without item_id or words are left out; items with equal windows all count. Empty tables: no rows, or
no hits. Other columns are kept, but those named like a new one (n_words, spans, items), which give way to it.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopweave.llm.common import numbered, saved, shared_dir
from shopweave.llm.tokens import worker_memory

WINDOW = 13
MAX_WINDOWS = 500_000
#: Each ASCII byte that parts words becomes a space, A-Z become a-z; bytes of characters beyond ASCII stay.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    size = min(window, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


class Search:
    """The windows of one length: jumps, and windows by last and first block."""

    def __init__(self, patterns: list[tuple[tuple[bytes, ...], int]]):
        self.length = len(patterns[0][0])
        self.jump: dict[tuple[bytes, bytes], int] = {}
        self.ends: dict[tuple[bytes, bytes], dict[tuple[bytes, bytes], list]] = {}
        for words, number in patterns:
            for at in range(1, self.length):
                block, left = (words[at - 1], words[at]), self.length - 1 - at
                self.jump[block] = min(self.jump.get(block, left), left)
            first = words[:2]
            self.ends.setdefault(words[-2:], {}).setdefault(first, []).append((words, number))

    def hits(self, words: list[bytes]):
        """(start, number of the window), wherever one stands."""
        size, jump, ends, n = self.length, self.jump, self.ends, len(words)
        far, at = size - 1, size - 1
        while at < n:
            block = (words[at - 1], words[at])
            step = jump.get(block, far)
            if step:
                at += step
                continue
            start = at - far
            for pattern, number in ends[block].get((words[start], words[start + 1]), ()):
                if tuple(words[start : at + 1]) == pattern:
                    yield start, number
            at += 1


class Windows:
    """All windows of some items; number k stands for the items owners[k]."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        numbers: dict[tuple[bytes, ...], int] = {}
        self.owners: list[list[str]] = []
        for item, text in items:
            for pattern in dict.fromkeys(windows_of(words_of(text), window)):
                if (k := numbers.setdefault(pattern, len(numbers))) == len(self.owners):
                    self.owners.append([])
                self.owners[k].append(item)
        self.single = {p[0]: k for p, k in numbers.items() if len(p) == 1}
        by_length: dict[int, list] = {}
        for p, k in numbers.items():
            if len(p) > 1:
                by_length.setdefault(len(p), []).append((p, k))
        self.searches = [Search(p) for p in by_length.values()]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches of hit words (start, end), apart from each other and ascending, and the items found."""
        found, items = [], set()
        for search in self.searches:
            for start, number in search.hits(words):
                found.append((start, start + search.length))
                items.update(self.owners[number])
        if self.single:
            for at, word in enumerate(words):
                if (number := self.single.get(word)) is not None:
                    found.append((at, at + 1))
                    items.update(self.owners[number])
        return joined(found), items


def joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


SPANS = "array<struct<start:long,end:long>>"


def search(docs: DataFrame, items: list[tuple[str, str]], window: int, n_words: str, spans: str, found: str) -> DataFrame:
    """docs (with text) and three more columns: their words, stretches hit (word positions, end exclusive), items found."""
    names = docs.columns
    at = names.index("text")
    broadcast, mark = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        memory = worker_memory()
        if getattr(memory, "windows_of", None) != mark:
            memory.windows, memory.windows_of = Windows(broadcast.value, window), mark
        windows = memory.windows
        for batch in batches:
            counts, hits, of_items = [], [], []
            for text in batch.column(at):
                words = words_of(text.as_py() or "")
                hit, of = windows.find(words)
                counts.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in hit])
                of_items.append(sorted(of))
            more = [pa.array(counts, pa.int64()), pa.array(hits, span), pa.array(of_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, n_words, spans, found])

    added = T.StructType.fromDDL(f"{n_words} long, {spans} {SPANS}, {found} array<string>")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def item_blocks(benchmark: DataFrame, max_windows: int):
    """The items (item_id as string, text) in blocks whose texts have at most max_windows words, or one item each."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna()
    block, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(row.text))
        if block and size + n > max_windows:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    yield block


#: Stretches of several blocks of windows, in order, become stretches apart from each other.
MERGE = f"""aggregate(array_sort(all_spans), cast(array() as {SPANS}), (a, s) -> case
    when size(a) > 0 and s.start <= element_at(a, -1).end
    then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end))))
    else concat(a, array(s)) end)"""


NEW = ("n_words", "spans", "items")


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs (text and other columns) with n_words, spans and items: each row's hit stretches and the items they come from."""
    blocks = item_blocks(benchmark, max_windows)
    first, second = next(blocks), next(blocks, None)
    names = [c for c in docs.columns if c not in NEW]
    own = lambda of: [F.col(f"{of}.`{c}`") for c in names]
    if second is None:
        held = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("kept"))
        return search(held, first, window, *NEW).select(*own("kept"), *NEW)
    folder = shared_dir(docs.sparkSession)
    held, found = numbered(docs, f"{folder}/numbered"), []
    for k, block in enumerate(chain([first, second], blocks)):
        hits = search(held.select("row", F.col("kept.text").alias("text")), block, window, *NEW)
        # Every row's words are counted by the first search; the others write the rows they hit.
        hits = hits.select("row", *NEW) if not k else hits.filter(F.size("items") > 0).select("row", *NEW)
        found.append(saved(hits, f"{folder}/block-{k}"))
    every = reduce(DataFrame.union, found).groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    every = every.select("row", "n_words", F.expr(MERGE).alias("spans"), "items")
    return held.join(every, "row").select(*own("kept"), *NEW)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    held = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return contamination(find_passages(held, benchmark, window)).filter("not contaminated").select("row.*")


def contamination(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from what find_passages returns: a twentieth of the words is too much."""
    return found.select(
        *[c for c in found.columns if c not in ("spans", "items")],
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op5_wu_manber(spark, sf_dir: str) -> DataFrame:
    """Every document against all windows of 13 words of the benchmark table."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(find_passages(docs.select("doc_id", "text"), benchmark)).drop("text")
