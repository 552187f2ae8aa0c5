"""Exact Jaccard self-join of word n-gram sets, vertically partitioned, and its connected components.

Words are cut at ASCII white space and A-Z lower-cased. Documents with the same set are one class; copies cost no pairs. N-grams have one global order: by document frequency, rarest first.

1. One pass over the texts gives each document's class and set size, and the n-grams that are frequent in one run of
   texts. Those seen HOT times or more (the MAX_HOT most frequent of them) close the global order and need no counting,
   so no task gets the rows of a hot one.
2. A second pass gathers runs of RUN n-grams, one node for each class of a run, and deals every (n-gram, node) by range of
   n-grams in some eight bytes: n-grams as differences, nodes as numbers in their run. Counting there gives document
   frequencies; n-grams of one node cannot overlap with anything and stay behind as a number. A bucket is read in pieces:
   an n-gram that turns out to have TOP rows or more has its place in the order whatever follows, and its rows are passed
   on without being held. Copies in different runs are nodes of their own, at most one a run, and linked by their class.
3. What is shared goes back to its run, where each node has its shared n-grams in global order, cut into fragments: octaves
   of document frequency. Nodes without a shared n-gram in their prefix (the first n - ceil(t n) + 1) can have no link and end here.
4. Candidates share a prefix n-gram; size and position bound their overlap from above, which must reach what the
   threshold needs. Of each n-gram's nodes the one with the n-gram at its earliest position is the leader, and all others are paired with it
   alone: as many pairs as rows. Overlaps are counted by fragment and summed per pair.
5. What these links connect needs no more pairs. Pairs of different components are then taken from each bucket, by size
   bands in which position still allows a link, and verified likewise. So no link between components is lost, while the
   pairs inside a group of thousands of near copies are never listed.

Sets are compared as 64-bit hashes of n-grams: two different n-grams of one pair of documents with n n-grams each are
taken for one with a chance of about n^2 / 2^64. Classes are known by 128-bit digests of their sets.

Null and empty texts have no set and link with nothing; texts with fewer words than an n-gram have one, the whole
sequence; very long texts are sets like any other, in one task. Rows with equal texts, or equal doc_ids, all come back;
doc_id null gets the component of its class. An empty table gives an empty result. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import no_null, numbered, parts, saved, shared_dir
from shopweave.llm.graph import components

LOWER = bytes(range(256)).lower()
WORD_BYTE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: N-grams that a task gathers before it deals them; n-grams in a bucket, on average; n-grams of a bucket held at once.
RUN, BUCKET, HELD = 1_000_000, 1_000_000, 3_000_000
#: An n-gram is counted in a run from OFTEN classes on; seen HOT times, its rows are dealt by class. MAX_HOT numbers of 8 bytes are broadcast.
OFTEN, HOT, MAX_HOT = 8, 50_000, 1_000_000
#: Document frequencies are an order up to TOP.
TOP = 60_000
#: Prefix n-grams of more classes than MANY, at most MAX_MANY of them, meet their rows by broadcast, all others by shuffle.
MANY, MAX_MANY = 500, 100_000
PACKED = "bucket int, run long, docs binary, nodes binary, grams binary, ords binary"
#: A class (two halves of its digest) and the size of its set.
DOC = np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<u4")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine: eight bytes after eight."""
    raw = text.encode().translate(LOWER)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = WORD_BYTE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    start, length = edges[::2], edges[1::2] - edges[::2]
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    left, on = length.copy(), np.arange(len(start))
    h = mixed(length.astype(np.uint64) + np.uint64(1))
    at = start.copy()
    while len(on):
        block = eight[at[on]] & (ALL >> (np.uint64(64) - np.uint64(8) * np.minimum(left[on], 8).astype(np.uint64)))
        h[on] = mixed(h[on] ^ block)
        at[on] += 8
        left[on] -= 8
        on = on[left[on] > 0]
    return h


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word n-grams."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(n, len(h))
    m = len(h) - k + 1
    a = np.full(m, k, np.uint64)
    for j in range(k):
        a = mixed(a) ^ h[j : j + m]
    return np.unique(mixed(a))


def class_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def memberships(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, row, class, n) of each row, and rows (gram, seen) of n-grams frequent in one run of classes."""
    kinds = {"doc_id": pa.int64(), "row": pa.int64(), "class": pa.binary(), "n": pa.int64(), "gram": pa.int64(), "seen": pa.int64()}

    def run(batches):
        held, classes, size = [], set(), 0

        def rows(**cols):
            k = len(next(iter(cols.values())))
            filled = [c if isinstance(c, pa.Array) else pa.nulls(k, t) if c is None else pa.array(c, t) for c, t in ((cols.get(name), t) for name, t in kinds.items())]
            return pa.RecordBatch.from_arrays(filled, names=list(kinds))

        def often():
            nonlocal size
            grams, count = np.unique(np.concatenate(held), return_counts=True)
            many = count >= OFTEN
            held.clear(), classes.clear()
            size = 0
            return rows(gram=grams[many].view(np.int64), seen=count[many])

        for batch in batches:
            known, sizes = [], []
            for text in batch.column(1):
                grams = shingles(text.as_py(), n)
                c = class_of(grams) if len(grams) else None
                known.append(c)
                sizes.append(len(grams))
                if c is not None and c not in classes:
                    classes.add(c)
                    held.append(grams)
                    size += len(grams)
                if size >= RUN:
                    yield often()
            yield rows(doc_id=batch.column(0), row=batch.column(2), **{"class": known}, n=sizes)
        if held:
            yield often()

    return docs.mapInArrow(run, "doc_id long, row long, class binary, n long, gram long, seen long")


def packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of PACKED. Those with docs tell the classes of a run, those without ords are to be counted, others go to their run."""
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])


def narrow(grams: np.ndarray) -> bytes:
    """Ascending numbers as the first one and differences of six bytes, if they fit."""
    steps = np.diff(grams)
    if len(steps) and int(steps.max()) < 1 << 48:
        return grams[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return grams.astype("<u8").tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    """The n numbers that narrow was given."""
    if len(raw) == 8 * n:
        return np.frombuffer(raw, "<u8")
    out = np.zeros((n, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8)
    out[1:, :6] = np.frombuffer(raw, np.uint8, -1, 8).reshape(-1, 6)
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Bucket:
    """The (n-gram, node) pairs of a bucket, read in pieces."""

    def __init__(self):
        self.runs: list[int] = []
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.over = 0, np.zeros(0, np.uint64)

    def add(self, run: int, nodes: bytes, grams: bytes) -> None:
        nodes = np.frombuffer(nodes, "<u2")
        self.more.append((wide(grams, len(nodes)), nodes, np.full(len(nodes), len(self.runs), np.uint32)))
        self.runs.append(run)
        self.size += len(nodes)

    def sort(self) -> np.ndarray:
        """Pairs in order of n-grams; gives the document frequency of each pair's n-gram."""
        grams, nodes, runs = (np.concatenate(x) for x in zip(*self.more, strict=True))
        order = np.argsort(grams)
        self.more = [(grams[order], nodes[order], runs[order])]
        edges = np.flatnonzero(np.diff(grams[order], prepend=~grams[order[:1]]))
        df = np.diff(np.append(edges, len(grams)))
        return np.repeat(df, df)

    def rows(self, which: np.ndarray, ords: np.ndarray) -> pa.RecordBatch:
        grams, nodes, runs = (x[which] for x in self.more[0])
        order = np.argsort(runs)
        grams, nodes, runs, ords = grams[order], nodes[order], runs[order], ords[which][order]
        edges = [*np.flatnonzero(np.diff(runs.astype(np.int64), prepend=-1)).tolist(), len(runs)]
        cut = ((self.runs[runs[a]], nodes[a:b], grams[a:b], ords[a:b]) for a, b in zip(edges, edges[1:], strict=False))
        return packed([(None, run, None, x.tobytes(), y.astype("<u8").tobytes(), z.astype("<u2").tobytes()) for run, x, y, z in cut])

    def relieve(self) -> Iterator[pa.RecordBatch]:
        """Pass on the rows of n-grams that have TOP of them, now or before."""
        df = self.sort()
        grams = self.more[0][0]
        out = (df >= TOP) | np.isin(grams, self.over)
        if out.any():
            yield self.rows(out, np.full(len(out), TOP))
            self.over = np.union1d(self.over, grams[out])
            self.more = [tuple(x[~out] for x in self.more[0])]
        self.size = len(self.more[0][0])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.more:
            df = self.sort()
            df[np.isin(self.more[0][0], self.over)] = TOP
            yield self.rows(df > 1, np.minimum(df, TOP))


def fragments(docs: DataFrame, n: int, num: int, den: int, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(node, class, n, fragment, at, grams): each node's shared n-grams in global order, `at` being the fragment's first position.

    Only nodes with a shared n-gram in their prefix. hot: the n-grams that close the global order, ascending, and their order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(batches):
        hot_grams, hot_order = sent.value
        held, known, seen, size, base = [], [], set(), 0, None

        def flush():
            nonlocal size, base
            grams, node = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), list(map(len, held)))
            order = np.argsort(grams)
            grams, node = grams[order], node[order]
            cold = np.ones(len(grams), bool)
            rows = [(base % buckets, base, np.array(known, DOC).tobytes(), None, None, None)]
            if len(hot_grams):
                at = np.minimum(np.searchsorted(hot_grams, grams), len(hot_grams) - 1)
                cold = hot_grams[at] != grams
                if not cold.all():
                    is_hot = ~cold
                    rows.append((base % buckets, base, None, node[is_hot].tobytes(), grams[is_hot].astype("<u8").tobytes(), hot_order[at[is_hot]].tobytes()))
            grams, node = grams[cold], node[cold]
            bucket = bucket_of(grams, buckets)
            edges = [*np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)).tolist(), len(grams)]
            rows += [(int(bucket[a]), base, None, node[a:b].tobytes(), narrow(grams[a:b]), None) for a, b in zip(edges, edges[1:], strict=False)]
            held.clear(), known.clear(), seen.clear()
            size, base = 0, None
            return packed(rows)

        for batch in batches:
            for text, row in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                grams = shingles(text.as_py(), n)
                if len(grams) and (c := class_of(grams)) not in seen:
                    base = row if base is None else base
                    seen.add(c)
                    held.append(grams)
                    known.append((int.from_bytes(c[:8], "little"), int.from_bytes(c[8:], "little"), len(grams)))
                    size += len(grams)
                if size >= RUN or len(held) == 1 << 16:
                    yield flush()
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket()
        for batch in batches:
            due = pa.compute.and_(pa.compute.is_null(batch.column("docs")), pa.compute.is_null(batch.column("ords")))
            if (passed := batch.filter(pa.compute.invert(due))).num_rows:
                yield passed
            due = batch.filter(due)
            for row in zip(*(due.column(c) for c in ("run", "nodes", "grams")), strict=True):
                bucket.add(*(x.as_py() for x in row))
                if bucket.size >= HELD:
                    yield from bucket.relieve()
        yield from bucket.finish()

    def cut(table: pa.Table) -> pa.Table:
        docs, own, grams, ords = (b"".join(x for x in table.column(c).to_pylist() if x) for c in ("docs", "nodes", "grams", "ords"))
        known, own, grams, ords = np.frombuffer(docs, DOC), np.frombuffer(own, "<u2"), np.frombuffer(grams, "<u8"), np.frombuffer(ords, "<u2")
        order = np.lexsort((grams, own.astype(np.uint32) << np.uint32(16) | ords))
        own, grams, ords = own[order].astype(np.int64), grams[order], ords[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(np.append(first, len(own)))
        total = known["n"][own[first]].astype(np.int64)
        alone = total - size
        keep = alone < total - -(-num * total // den) + 1
        every, octave = np.repeat(keep, size), np.log2(np.maximum(ords, 1)).astype(np.int32)
        pos = np.arange(len(own)) - np.repeat(first, size) + np.repeat(alone, size)
        own, grams, octave, pos = own[every], grams[every], octave[every], pos[every]
        cuts = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(octave, prepend=-1) != 0))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(own)).astype(np.int32)), pa.array(grams.view(np.int64)))
        of = known[own[cuts]]
        names = pa.array([a.tobytes() for a in np.stack([of["a"], of["b"]], axis=1).astype("<u8")], pa.binary())
        nodes = pa.array(own[cuts] + table.column("run")[0].as_py())
        return pa.table([nodes, names, pa.array(of["n"].astype(np.int64)), pa.array(octave[cuts]), pa.array(pos[cuts].astype(np.int64)), lists], names=["node", "class", "n", "fragment", "at", "grams"])

    rows = docs.mapInArrow(deal, PACKED)
    counted = rows.groupBy("bucket").applyInArrow(count, PACKED)
    return counted.groupBy("run").applyInArrow(cut, "node long, class binary, n long, fragment int, at long, grams array<long>")


class Rule:
    """The threshold num / den as integer column expressions."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: str):
        """How many n-grams the prefix of a set of n has."""
        return F.expr(f"{n} - ({self.num} * {n} + {self.den - 1}) div {self.den} + 1")

    def needed(self, x: str, y: str) -> str:
        """The overlap at which sets of x and y link."""
        return f"(({self.num} * ({x} + {y}) + {self.num + self.den - 1}) div {self.num + self.den})"

    def possible(self, nx: str, i: str, ny: str, j: str):
        """Sizes, and positions of a shared n-gram with nothing shared before it, still allow a link."""
        return F.expr(f"{self.den} * least({nx}, {ny}) >= {self.num} * greatest({nx}, {ny}) and least({nx} - {i}, {ny} - {j}) >= {self.needed(nx, ny)}")

    def linked(self, overlap: str, nx: str, ny: str):
        return F.expr(f"{self.den} * {overlap} >= {self.num} * ({nx} + {ny} - {overlap})")


def frequent(keys: DataFrame, key: str, path: str) -> DataFrame:
    """The keys of more than MANY rows, at most MAX_MANY of them, of keys (key, rows)."""
    return saved(keys.filter(F.col("rows") > MANY).orderBy(F.desc("rows"), key).limit(MAX_MANY).select(key), path)


def by_key(rows: DataFrame, other: DataFrame, key: str, many: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with other (a row for each key); the rows of the keys in many (see frequent) stay where they are."""
    few = rows.join(F.broadcast(many), key, "left_anti").join(other, key, how)
    warm = rows.join(F.broadcast(many), key, "left_semi") if how == "left" else rows
    return few.union(warm.join(F.broadcast(other.join(F.broadcast(many), key, "left_semi")), key, how))


def verified(pairs: DataFrame, cut: DataFrame, rule: Rule) -> DataFrame:
    """The links (a, b) among pairs (a, na, b, nb): overlaps by fragment, summed per pair."""
    left = pairs.join(cut.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga")), "a")
    right = cut.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = left.join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("k"))
    overlap = partial.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("overlap"))
    return overlap.filter(rule.linked("overlap", "na", "nb")).select("a", "b")


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, smaller node first."""
    swap = F.col("x") > F.col("y")
    return pairs.select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"),
        F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("na"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"),
        F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("nb"),
    ).distinct()


def node_components(cut: DataFrame, rule: Rule, folder: str) -> DataFrame:
    """(node, component) of the nodes in cut (a written table) that have links."""
    open_n = rule.prefix("n") - F.col("at")
    prefix = cut.filter(open_n > 0).select("node", "n", F.posexplode(F.slice("grams", F.lit(1), open_n.cast("int"))).alias("k", "gram"), "at")
    prefix = prefix.select("gram", "node", "n", (F.col("at") + F.col("k")).alias("pos"))
    leaders = prefix.groupBy("gram").agg(F.min(F.struct("pos", "n", "node")).alias("l"), F.count("*").alias("rows")).filter("rows > 1")
    leaders = saved(leaders.select("gram", F.col("l.node").alias("lead"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lpos"), "rows"), f"{folder}/leaders")
    many = frequent(leaders, "gram", f"{folder}/many")

    def by_gram(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
        return by_key(rows, other, "gram", many, how)

    first = by_gram(prefix, leaders).filter("node <> lead").filter(rule.possible("n", "pos", "ln", "lpos"))
    first = first.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("lead").alias("y"), F.col("ln").alias("ny"))
    pairs = saved(ordered(first), f"{folder}/pairs")
    links = saved(verified(pairs, cut, rule), f"{folder}/links")
    # Nodes of one class are linked without a look.
    nodes = cut.select("class", "node").distinct()
    copies = nodes.join(nodes.groupBy("class").agg(F.min("node").alias("b")), "class").filter("node > b").select(F.col("node").alias("a"), "b")
    labels = saved(components(links.union(copies), f"{folder}/components"), f"{folder}/labels")

    def label(df: DataFrame, key: str, name: str) -> DataFrame:
        named = labels.select(F.col("node").alias(key), F.col("component").alias("found"))
        return df.join(named, key, "left").withColumn(name, F.coalesce("found", key)).drop("found")

    main = saved(label(leaders.select("gram", "lead"), "lead", "main").select("gram", "main"), f"{folder}/main")
    rows = saved(by_gram(label(prefix, "node", "comp"), main).select("gram", "node", "n", "pos", "comp", "main"), f"{folder}/rows")
    odd = saved(rows.filter("comp <> main").select("gram").distinct(), f"{folder}/odd")
    rows = saved(by_gram(rows, odd, "left_semi"), f"{folder}/odd-rows")
    # The longer set meets shorter ones by bands of 2 % in size, up to the size that its position allows.
    band = "cast(floor(50 * ln({})) as int)"
    top = f"least(n, (n - pos) * {rule.num + rule.den} div {rule.num} - n)"
    low = f"(({rule.num} * n + {rule.den - 1}) div {rule.den})"
    longer = rows.filter(F.expr(f"{top} >= {low}")).withColumn("band", F.explode(F.expr(f"sequence({band.format(low)}, {band.format(top)})")))
    longer = longer.select("gram", "band", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("i"), F.col("comp").alias("cx"), "main")
    shorter = rows.filter(F.expr(f"n - pos >= {rule.needed('n', 'n')}")).withColumn("band", F.expr(band.format("n")))
    shorter = shorter.select("gram", "band", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("j"), F.col("comp").alias("cy"), F.col("main").alias("main_y"))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, ["gram", "band"]).filter("cx <> cy and ny <= nx").filter(rule.possible("nx", "i", "ny", "j")).select("x", "nx", "y", "ny")

    rest = met(longer.filter("cx <> main"), shorter).union(met(longer.filter("cx = main"), shorter.filter("cy <> main_y")))
    rest = saved(ordered(rest).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), f"{folder}/rest")
    more = saved(verified(rest, cut, rule), f"{folder}/more")
    if more.isEmpty():
        return labels
    return components(more.union(labels.select(F.col("node"), F.col("component"))), f"{folder}/all")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, first_row) of documents (doc_id, text) whose n-gram sets link at Jaccard num / den.

    row numbers the rows of docs (monotonically_increasing_id); first_row is that of the component's least (doc_id, row).
    """
    return row_components(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), n, num, den)


def row_components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The same of documents (doc_id, text, row); row is read in one scan only."""
    spark, folder, rule = docs.sparkSession, shared_dir(docs.sparkSession), Rule(num, den)
    rows = no_null(docs.select(F.col("doc_id").cast("long"), "text", "row"), "text")
    found = saved(memberships(rows, n), f"{folder}/members")
    members = found.filter("n is not null").select("doc_id", "row", "class", "n")
    size = members.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams")).first()
    seen = found.filter("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= HOT)
    seen = seen.orderBy(F.desc("seen"), "gram").limit(MAX_HOT).toPandas()  # at most MAX_HOT pairs of numbers
    grams = seen.gram.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    hot = grams[order], (TOP + 1 + np.minimum(5000, 100 * np.log2(seen.seen.to_numpy(float)))).astype(np.uint16)[order]
    buckets = max(parts(spark), -(-size.grams // BUCKET))
    cut = saved(fragments(rows, n, num, den, hot, buckets), f"{folder}/fragments")
    labels = node_components(cut, rule, folder)
    named = cut.select("class", "node").distinct().join(labels, "node").groupBy("class").agg(F.min("component").alias("linked"))
    # Rows come together by class, then classes by component: neither copies nor groups of near copies meet in one task.
    class_id = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    classes = saved(members.filter("n > 0").groupBy("class").agg(F.min(class_id).alias("first"), F.count("*").alias("rows")), f"{folder}/classes")
    alone = F.concat(F.lit("class "), F.hex("class"))
    classes = saved(classes.join(named, "class", "left").withColumn("component", F.coalesce(F.col("linked").cast("string"), alone)), f"{folder}/named")
    least = saved(classes.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("rows")), f"{folder}/least")
    groups = by_key(classes.select("class", "component"), least.drop("rows"), "component", frequent(least, "component", f"{folder}/big"))
    groups = saved(groups.select("class", "least"), f"{folder}/groups")
    named = by_key(members.filter("n > 0"), groups, "class", frequent(classes, "class", f"{folder}/copied"))
    named = named.select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first_row"))
    return named.union(members.filter("n = 0").select("doc_id", "row", "n", F.col("doc_id"), F.col("row")))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The first document of each component, with the columns of docs; documents without a set all stay."""
    held = numbered(docs, f"{shared_dir(docs.sparkSession)}/numbered")
    found = row_components(held.select("kept.doc_id", "kept.text", "row"), n, num, den)
    extra = saved(found.filter("row <> first_row").select("row"), shared_dir(docs.sparkSession))
    return held.join(extra.hint("shuffle_hash"), "row", "left_anti").select("kept.*")


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under sets of 4-word shingles that link at 85 / 100."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, n=4, num=85, den=100).drop("row", "first_row")
