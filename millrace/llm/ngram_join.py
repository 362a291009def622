"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups of linked documents.

Texts become sets of word shingles (64-bit hashes). Equal sets are one node; all work is on nodes.

* Order. Shingles are ordered by (hot, hash). Hot ones are the most frequent over all documents, by
  counts of each document's lowest-hashed tenths; their table has at most ``HOT_MOST`` rows, the
  threshold rises until it fits, so it may be broadcast. The order decides cost only, never results.
* Prefixes. A node of n shingles whose l-prefix has n - ceil(t n) + l of them shares l prefix
  shingles at least with any node similar to it. Each node picks the l that costs least by the
  counts of its prefix: postings to read, plus candidates to verify, of which there are at most
  sum(count - 1) / l. A pair needs min(l, l') shared prefix shingles before it is verified.
* Families. Near copies of one text share most of their common shingles, so that prefixes alone would pair all with
  all. So each node looks for a pivot, by minima of hashes, the likely base text being the one with the
  largest share of hot shingles. Of a pivot's nodes only what they differ in from it is kept. Two of them differ in just
  the tokens that one of these differences holds and not the other, so similar ones that aren't both similar to the
  pivot share part of their differences: the same multi-match prefixes, of differences now and ordered by
  their exact counts, find them. What all copies have in common is in no difference and pairs nothing.
* Across families postings pair nodes of different pivots only.
* Bounds. Before sets are fetched, pairs meet as bitmaps of token parities, about a thirtieth of the sets: the bits
  in which two differ are at most the tokens that only one has, which bounds the similarity from above.
* Groups. Links are joined into components by minimum labels and pointer jumping; pairs that are joined already
  need no proof.

Words are runs of characters that aren't white space, A-Z lower-cased; texts with fewer words than a
shingle are one shingle; null texts and those without words have none and link with nothing. Equal
sets link; repeated rows are equal sets. A null doc_id is carried, and names a group only if all its
ids are null. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, vec

#: Rows of the broadcast table of hot shingles, at most.
HOT_MOST = 500_000
HOT_LEAST = 8
#: What verifying a candidate costs, in postings read.
VERIFY = 50
#: l is at most this; each step costs a posting and asks for a shared shingle more.
LONGEST = 8
#: Documents that share a shingle which isn't hot, as an estimate.
COLD = 1.5
#: Lowest-hashed shingles that are counted, as a multiple of the longest prefix.
POOL = 1.25
#: Texts are counted whole if so large a share of their lowest-hashed shingles is hot.
CROWDED = 0.25
#: Parts of the hash range whose minima are compared to find pivots.
KEYS = 8
#: A node is of a pivot's family from a similarity of so many percent, or of the threshold if that is lower.
LOOSE = 50
#: Ids of so many rows at most are broadcast; more are joined by shuffle.
SMALL = 200_000
#: Postings of one shingle that meet in one task, about; longer lists are dealt in blocks of this.
BLOCK = 1024
#: A family is dealt in so many blocks, of so many nodes at least and at most; two blocks meet in one task.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 16, 128, 32768

_U = np.uint64
SETS = "doc_id long, mark long, n long, node long, keys array<long>, cold double, ell int, prefix array<long>, bits binary"


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = vec.flat(texts)
    for a, b, block, at in vec.blocks(data, offsets):
        starts, ends, docs = vec.word_spans(block, at)
        words = vec.span_hashes(block, starts, ends, lower=True)
        windows = vec.window_hashes(words, width)
        for k in range(b - a):
            i, j = docs[k], docs[k + 1]
            if j - i >= width:
                yield np.unique(windows[i : j - width + 1])
            elif j > i:
                yield vec.window_hashes(words[i:j], int(j - i)) ^ _U(j - i)
            else:
                yield np.zeros(0, _U)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _pool(n: int, percent: int) -> int:
    return int(POOL * (n - least_overlap(n, percent) + LONGEST))


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])


def _counting(width: int, percent: int, first=None):
    """Counts of tokens by task: each text's lowest-hashed ones, or, given a first table of hot tokens, the whole
    sets of the texts in whose lowest-hashed ones hot tokens are common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = first.value[0] if first is not None else None
        own, size = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                part = s[: _pool(len(s), percent)]
                if hot is not None:
                    if not len(hot) or not len(part) or _among(part, hot).mean() < CROWDED:
                        continue
                    part = s
                own.append(part)
                size += len(part)
                if size >= 1 << 20:
                    yield _counted(own)
                    own, size = [], 0
        if own:
            yield _counted(own)

    return run


def _among(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.searchsorted(hot, tokens)
    at[at == len(hot)] = 0
    return hot[at] == tokens


def _bounded_table(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and their counts; the least count rises until HOT_MOST rows hold them."""
    steps = sorted(((r.k, r.m) for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    least, total = 63, 0
    for k, m in steps:
        if total + m > HOT_MOST:
            break
        least, total = k, total + m
    table = counts.filter(F.col("n") >= F.lit(2) ** F.lit(int(least))).toArrow()
    tokens, n = table.column("token").to_numpy().view(_U), table.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def hot_shingles(texts: DataFrame, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hot shingles, sorted, and their counts, in two passes.

    The first counts each text's lowest-hashed shingles, about a tenth. Where hot ones are common among them, as in
    families of near copies, prefixes reach beyond; so the second counts such texts whole."""

    def counts(first=None) -> DataFrame:
        got = texts.mapInArrow(common.tidied(_counting(width, percent, first)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        return common.written(got.filter(F.col("n") >= HOT_LEAST), "hot")

    spark = texts.sparkSession
    one = counts()
    first = spark.sparkContext.broadcast(_bounded_table(one))
    two = counts(first)
    first.unpersist()
    return _bounded_table(one.union(two).groupBy("token").agg(F.max("n").alias("n")))


def ell_of(df: np.ndarray, least: int) -> int:
    """The l that costs least for a set whose tokens, in order, are in so many sets, and whose partners share ``least``."""
    read = np.cumsum(df)
    ells = np.arange(1, min(LONGEST, least) + 1)
    own = len(df) - least + ells
    return int(np.argmin(read[own - 1] + VERIFY * (read[own - 1] - own) / ells)) + 1


def choose(tokens: np.ndarray, hot: np.ndarray, counts: np.ndarray, percent: int) -> tuple[int, np.ndarray, int]:
    """(l, l-prefix, number of tokens that aren't hot) of a set."""
    n = len(tokens)
    least = least_overlap(n, percent)
    df, cold = np.full(n, COLD), n
    if len(hot):
        at = np.searchsorted(hot, tokens)
        at[at == len(hot)] = 0
        is_hot = hot[at] == tokens
        rare = tokens[~is_hot]
        cold = len(rare)
        df = np.concatenate([df[:cold], counts[at[is_hot]]])
        tokens = np.concatenate([rare, tokens[is_hot]])
    ell = ell_of(df, least)
    return ell, tokens[: n - least + ell], cold


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of tokens by hash, in a power of two of bits, at least two a token."""
    size = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    counts = np.bincount((tokens >> _U(64 - (size.bit_length() - 1))).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the number of tokens that only one of two sets has: bits that differ.

    Bits of the larger bitmap are folded, by exclusive or of neighbours, to the size of the smaller: tokens are
    placed by leading bits of their hash, so a fold is what the smaller size would have made."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        bits = np.unpackbits(x).reshape(len(y) * 8, -1)
        x = np.packbits(np.bitwise_xor.reduce(bits, axis=1))
    return int(_ONES[x ^ y].sum(dtype=np.int64))


def _bounded(percent: int):
    """Keeps the pairs that may be similar by their bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            kept = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                both = na[i] + nb[i]
                d = max(apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)), abs(na[i] - nb[i]))
                most = (both - d) // 2
                if 100 * most >= percent * (both - most):
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return run


def _prepare(hot, width: int, percent: int):
    edges = (np.arange(KEYS, dtype=_U) * _U((1 << 64) // KEYS)).astype(_U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = hot.value
        seen: set[int] = set()  # 8 bytes of hash a node; a task needn't send a prefix twice
        for batch in batches:
            n, node, keys, cold, ells, prefixes, bits = [], [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                own = vec.set_hash(s) if len(s) else None
                node.append(own)
                if own is None or own in seen:
                    for column in (keys, cold, ells, prefixes, bits):
                        column.append(None)
                    continue
                seen.add(own)
                at = np.searchsorted(s, edges)
                keys.append(s[np.unique(at[at < len(s)])].view(np.int64))
                ell, prefix, rare = choose(s, tokens, counts, percent)
                ells.append(ell), prefixes.append(prefix.view(np.int64)), bits.append(bitmap(s)), cold.append(rare / len(s))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, longs), pa.array(cold, pa.float64()), pa.array(ells, pa.int32()), pa.array(prefixes, longs), pa.array(bits, pa.binary())], names=["doc_id", "mark", "n", "node", "keys", "cold", "ell", "prefix", "bits"])

    return run


def _full(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sets = [], []
            for s in shingle_sets(batch.column(0), width):
                if len(s):
                    own = vec.set_hash(s)
                    if own not in seen:
                        seen.add(own)
                        nodes.append(own), sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inter, union = [], []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            inter.append(int((both[1:] == both[:-1]).sum()))
            union.append(len(both) - inter[-1])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "total"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts sorted batches where the keys change: tables of whole groups, one batch of rows at a time, plus what the
    last group had before."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if rest and v[0] != rest[-1].column(k)[rest[-1].num_rows - 1].as_py():
                change[0] = True
        cuts = np.flatnonzero(change)
        if not len(cuts):
            rest.append(batch)
            continue
        if first := [*rest, *([batch.slice(0, cuts[-1])] if cuts[-1] else [])]:
            yield pa.Table.from_batches(first)
        rest = [batch.slice(cuts[-1])]
    if rest:
        yield pa.Table.from_batches(rest)


def _meet(percent: int):
    """Pairs of nodes of different pivots that share a shingle within a cell, a row a shingle.

    Rows are token, cell, node, pivot (null: the node itself) and meta: l, two bits of side and, in 32 bits, the set's
    size. Rows of sides 1 and 2 pair across only, those of side 0 among themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["token", "cell"]):
            t, c, q, meta = (table.column(k).to_numpy() for k in ("token", "cell", "node", "meta"))
            p = table.column("pivot").combine_chunks()
            p = np.where(p.is_null().to_numpy(zero_copy_only=False), q, p.fill_null(0).to_numpy(zero_copy_only=False))
            order = np.lexsort((q, c, t))
            t, c, q, p, meta = t[order], c[order], q[order], p[order], meta[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            once = new.copy()
            once[1:] |= q[1:] != q[:-1]
            q, p, meta, new = q[once], p[once], meta[once], new[once]
            ell, side, n = meta >> 34, meta >> 32 & 3, meta & 0xFFFFFFFF
            ends = np.append(np.flatnonzero(new)[1:], len(q))[np.cumsum(new) - 1]

            def pairs(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
                fits = (p[j] != p[i]) & (100 * n[j] >= percent * n[i]) & (100 * n[i] >= percent * n[j]) & ((side[j] != side[i]) | (side[i] == 0))  # noqa: B023
                i, j = i[fits], j[fits]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(q[j]), pa.array(np.minimum(ell[i], ell[j]).astype(np.int32))], names=["a", "b", "need"])  # noqa: B023

            # Step by step through short lists, all at once; row by row through what is left of long ones.
            rows, step = np.arange(len(q)), 0
            while len(rows) > 64:
                step += 1
                rows = rows[rows + step < ends[rows]]
                yield from pairs(rows, rows + step)
            for i in rows:
                later = np.arange(i + step + 1, ends[i])
                yield from pairs(np.full(len(later), i), later)

    return run


def _differ(percent: int):
    """What each node and its pivot don't share, as hashes that differ by side; nodes too far from it are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, n, linked, parts = [], [], [], [], []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([x, y])
                order = np.argsort(both, kind="stable")
                both = both[order]
                twice = np.zeros(len(both), bool)
                twice[1:] = both[1:] == both[:-1]
                shared = int(twice.sum())
                total = len(both) - shared
                if 100 * shared < min(LOOSE, percent) * total:
                    continue
                twice[:-1] |= twice[1:]
                at.append(i), size.append(len(x)), n.append(len(y)), linked.append(100 * shared >= percent * total)
                parts.append(vec.mix(both[~twice] + (order[~twice] < len(x)).astype(_U)).tobytes())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(parts, pa.binary())], names=["pivot", "node", "size", "n", "linked", "parts"])

    return run


def differing(d: int, n: int, size: int, linked: bool, percent: int) -> int:
    """How many hashes at least a node's difference of ``d`` from its pivot shares with that of any node similar to it.

    With c = (1 - t) / (1 + t), sets of a and b tokens are similar if they differ in c (a + b) at most. Both differences
    overlap in half of what they hold beyond that. Two nodes that are similar to the pivot need no proof, so
    one of the pair exceeds its own bound to the pivot."""
    c = (100 - percent) / (100 + percent)
    if linked:
        return math.floor((1 - c) * d / 2 - 1e-9) + 1
    over = d - c * (n + size)
    other = max(1, d - n * (100 - percent) // percent)
    return max(1, math.ceil((over + (1 - c) * other) / 2 - 1e-9))


def _within(percent: int):
    """Links among the nodes of a pivot, by multi-match prefixes of what they differ in from it, in cells of two blocks.

    Of links within a cell only those are given that join what others haven't joined yet."""

    def links(table: pa.Table) -> tuple[list[int], list[int]]:
        node, n, linked, side = (table.column(k).to_numpy() for k in ("node", "n", "linked", "side"))
        size = table.column("size")[0].as_py()
        open_ = np.flatnonzero(~linked)
        if len(node) < 2 or not len(open_):
            return [], []
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table.column("parts")]
        lengths = np.array([len(s) for s in sets])
        tokens, index, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, ends = np.repeat(np.arange(len(sets)), lengths), np.cumsum(lengths)
        order = np.lexsort((index, counts[index], owner))  # in each set, rare ones first
        index = index[order]
        sets = [index[e - k : e] for e, k in zip(ends, lengths, strict=True)]
        least = [differing(len(s), int(n[i]), size, bool(linked[i]), percent) for i, s in enumerate(sets)]
        ells = np.array([ell_of(counts[s], k) for s, k in zip(sets, least, strict=True)])
        prefixes = [s[: len(s) - k + e] for s, k, e in zip(sets, least, ells, strict=True)]
        flat = np.concatenate(prefixes)
        who = np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])[np.argsort(flat, kind="stable")]
        upto = np.cumsum(np.bincount(flat, minlength=len(tokens)))
        root = list(range(len(sets) + 1))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in np.flatnonzero(linked):
            root[i] = len(sets)
        a, b = [], []
        for i in open_:
            lists = [who[upto[t] - k : upto[t]] for t in prefixes[i] if (k := upto[t] - (upto[t - 1] if t else 0)) > 1]
            if not lists:
                continue
            met = np.bincount(np.concatenate(lists), minlength=len(sets))
            near = (met >= np.minimum(ells, ells[i])) & (100 * n >= percent * n[i]) & (100 * n[i] >= percent * n) & ((side != side[i]) | (side == 0))
            near[i] = False
            for j in np.flatnonzero(near):
                if (linked[j] or j > i) and top(i) != top(j):
                    apart = len(sets[i]) + len(sets[j]) - 2 * len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if (100 + percent) * apart <= (100 - percent) * int(n[i] + n[j]):
                        root[top(i)] = top(j)
                        a.append(int(node[i])), b.append(int(node[j]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["pivot", "cell"]):
            p, c = table.column("pivot").to_numpy(), table.column("cell").to_numpy()
            cuts = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (c[1:] != c[:-1])))
            a, b = [], []
            for s, e in zip(cuts, np.append(cuts[1:], len(p)), strict=True):
                for all_, own in zip((a, b), links(table.slice(s, e - s)), strict=True):
                    all_ += own
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class Join:
    def __init__(self, docs: DataFrame, width: int, percent: int) -> None:
        self.spark, self.docs, self.width, self.percent = docs.sparkSession, docs, width, percent
        common.ship(self.spark)
        hot = hot_shingles(docs.select("text"), width, percent)
        self.hot = self.spark.sparkContext.broadcast(hot)
        common.free_shuffles(self.spark)
        self.rows = common.written(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(common.tidied(_prepare(self.hot, width, percent)), SETS), "shingles")
        #: A row a node: its smallest doc_id.
        self.nodes = common.written(self.rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "nodes")
        self.sets: DataFrame | None = None

    def small(self, df: DataFrame) -> DataFrame:
        """With a hint to broadcast, if its counted rows are few."""
        return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df

    def fetch(self, nodes: DataFrame) -> None:
        """Reads the texts of ``nodes`` again and adds their full sets to self.sets."""
        want = nodes.distinct()
        if self.sets is not None:
            want = want.join(self.sets.select("node"), "node", "left_anti")
        ids = common.written(self.nodes.join(want, "node").select("doc_id").distinct(), "wanted")
        named = self.docs.join(self.small(ids.filter("doc_id is not null")), "doc_id", "left_semi").select("text")
        if ids.filter("doc_id is null").limit(1).count():
            named = named.union(self.docs.filter("doc_id is null").select("text"))
        got = named.mapInArrow(common.tidied(_full(self.width)), "node long, tokens binary").join(self.small(want), "node", "left_semi")
        got = common.written(got, "sets")
        common.free_shuffles(self.spark)
        self.sets = got if self.sets is None else self.sets.union(got)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, common, total) of distinct pairs of nodes, written."""
        pairs = common.written(pairs, name + "-pairs")
        common.free_shuffles(self.spark)
        self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        with common.batches_of(self.spark, 256):
            return common.written(self.with_sets(pairs).mapInArrow(common.tidied(_verify), "a long, b long, common long, total long"), name)

    def with_sets(self, pairs: DataFrame) -> DataFrame:
        x = self.sets.withColumnsRenamed({"node": "a", "tokens": "x"})
        y = self.sets.withColumnsRenamed({"node": "b", "tokens": "y"})
        return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y")

    def bounded(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b) of the pairs whose bitmaps leave room for a similarity of ``percent``."""
        bits = self.rows.filter("bits is not null").select("node", "n", "bits")
        x, y = bits.withColumnsRenamed({"node": "a", "n": "na", "bits": "x"}), bits.withColumnsRenamed({"node": "b", "n": "nb", "bits": "y"})
        with common.batches_of(self.spark, 2048):
            kept = pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "na", "nb", "x", "y").mapInArrow(common.tidied(_bounded(self.percent)), "a long, b long")
            return common.written(kept.distinct(), name)

    def similar(self):
        return F.col("common") * 100 >= F.col("total") * self.percent

    def pivots(self) -> DataFrame:
        """(a, b): a likely base text a of each node b that has one.

        Of the nodes with the same minimum in a part of the hash range, the one with the largest share of hot tokens
        leads; a node follows who leads it in most parts, two at least, and leaders follow theirs."""
        order = F.struct("cold", "n", "node")
        keys = self.rows.filter("keys is not null").select("node", "n", "cold", F.explode("keys").alias("key"))
        leaders = keys.groupBy("key").agg(F.min(order).alias("leader"), (F.min("node") != F.max("node")).alias("several")).filter("several").select("key", "leader")
        met = keys.join(leaders, "key").filter(F.col("leader.node") != F.col("node")).groupBy("node", "leader").agg(F.count(F.lit(1)).alias("keys")).filter("keys > 1")
        best = F.min(F.struct(-F.col("keys"), "leader")).alias("best")
        lead = common.written(met.groupBy("node").agg(best).select("node", F.col("best.leader.node").alias("lead")), "leads")
        while True:
            up = self.small(lead.select(F.col("node").alias("at"), F.col("lead").alias("further")))
            lead = common.written(lead.join(up, lead["lead"] == up["at"], "left").select("node", F.coalesce("further", "lead").alias("lead"), F.col("further").isNotNull().alias("moved")), "leads")
            if not lead.filter("moved").limit(1).count():
                return lead.select(F.col("lead").alias("a"), F.col("node").alias("b"))
            lead = lead.select("node", "lead")

    def families(self) -> DataFrame:
        """(pivot, node, size, n, linked, parts): nodes near a pivot and what they differ in from it."""
        pairs = common.written(self.pivots(), "pivots")
        self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        with common.batches_of(self.spark, 256):
            return common.written(self.with_sets(pairs).mapInArrow(common.tidied(_differ(self.percent)), "pivot long, node long, size long, n long, linked boolean, parts binary"), "families")

    def inside(self, families: DataFrame) -> DataFrame:
        """Links between nodes of one family."""
        counts = families.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.min("linked").alias("done")).filter("members > 1 and not done")
        size = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("members") / BLOCKS)))
        blocks = F.ceil(F.col("members") / size).cast("long")
        rows = families.join(self.small(counts.select("pivot", blocks.alias("blocks"))), "pivot")
        mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cell = F.shiftleft(F.least("other", mine), 31) + F.greatest("other", mine)
        side = F.when(F.col("other") == mine, 0).when(F.col("other") > mine, 1).otherwise(2)
        rows = rows.select("pivot", cell.alias("cell"), side.alias("side"), "node", "size", "n", "linked", "parts")
        met = rows.repartition(common.partitions(self.spark), "pivot", "cell").sortWithinPartitions("pivot", "cell")
        with common.batches_of(self.spark, 2048):
            return common.written(met.mapInArrow(common.tidied(_within(self.percent)), "a long, b long"), "inside")

    def crowded(self, posts: DataFrame) -> DataFrame:
        """(token, top, chunks, blocks) of shingles with over ``BLOCK`` postings: the pivot with most of them, those
        in chunks, and the others in blocks. Hot shingles only, so its rows are at most HOT_MOST."""
        tokens, counts = self.hot.value
        many = self.spark.createDataFrame(pa.table({"token": tokens.view(np.int64)[counts > BLOCK]}))
        by = posts.join(F.broadcast(many), "token").groupBy("token", F.coalesce("pivot", "node").alias("pivot")).agg(F.count(F.lit(1)).alias("n"))
        all_ = by.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "pivot")).alias("most"))
        part = lambda x: F.ceil(x / F.lit(BLOCK)).cast("long")
        return common.written(all_.filter(F.col("n") > BLOCK).select("token", F.col("most.pivot").alias("top"), part(F.col("most.n")).alias("chunks"), part(F.col("n") - F.col("most.n")).alias("blocks")), "crowded")

    def across(self, members: DataFrame) -> DataFrame:
        """(a, b): pairs of nodes of different pivots that share prefix shingles enough."""
        posts = self.rows.filter("prefix is not null").select("node", "n", "ell", "prefix").join(self.small(members), "node", "left")
        posts = posts.select("node", "pivot", (F.shiftleft(F.col("ell").cast("long"), 34) + F.col("n")).alias("meta"), F.explode("prefix").alias("token"))
        # A crowded shingle's postings are dealt in cells, so no task gets a long list whole: chunks of its largest
        # family against blocks of the others, and those blocks among themselves.
        posts = posts.join(F.broadcast(self.crowded(posts)), "token", "left")
        zero = F.lit(0).cast("long")
        upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<long>"))
        chunk, block = F.pmod(F.xxhash64("node"), F.col("chunks")), F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1)))
        code = lambda kind, i, j, side: F.shiftleft(F.shiftleft(F.lit(kind).cast("long"), 30) + i, 32) + F.shiftleft(j, 2) + side
        of_top = F.transform(upto(F.col("blocks")), lambda j: code(1, chunk, j, F.lit(1)))
        of_rest = F.concat(
            F.transform(upto(F.col("chunks")), lambda i: code(1, i, block, F.lit(2))),
            F.transform(upto(F.col("blocks")), lambda o: code(0, F.least(o, block), F.greatest(o, block), F.when(o == block, 0).when(o > block, 1).otherwise(2))),
        )
        cells = F.when(F.col("top").isNull(), F.array(zero)).when(F.col("top") == F.coalesce("pivot", "node"), of_top).otherwise(of_rest)
        posts = posts.select("token", F.explode(cells).alias("code"), "node", "pivot", "meta")
        posts = posts.select("token", F.shiftright("code", 2).alias("cell"), "node", "pivot", (F.col("meta") + F.shiftleft(F.col("code").bitwiseAND(F.lit(3).cast("long")), 32)).alias("meta"))
        dealt = posts.repartition(common.partitions(self.spark), "token", "cell").sortWithinPartitions("token", "cell")
        met = dealt.mapInArrow(common.tidied(_meet(self.percent)), "a long, b long, need int")
        return common.written(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need")).filter("met >= need").select("a", "b"), "across")

    def components(self) -> DataFrame:
        """(node, label): the smallest node of the component, of nodes with links."""
        families = self.families()
        links = self.inside(families).unionByName(families.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        common.free_shuffles(self.spark)
        labels = self.labels(links)
        side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias("l" + c))
        near = self.across(families.select("node", "pivot")).join(side("a"), "a", "left").join(side("b"), "b", "left")
        near = self.bounded(near.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"), "near")
        more = self.verified(near.select("a", "b"), "across").filter(self.similar()).select("a", "b")
        return self.labels(links.unionByName(more))

    def labels(self, links: DataFrame) -> DataFrame:
        """(node, label) of nodes with links: the smallest node that links reach."""
        both = common.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
        label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        label = common.written(label, "labels")
        while True:
            heard = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("heard"))
            new = label.join(heard, label.node == heard.a, "left").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
            jump = label.select(F.col("node").alias("at"), F.col("label").alias("further"))
            new = new.join(jump, new.label == jump["at"], "left").select("node", F.least("label", "further").alias("label"), "old")
            new = common.written(new, "labels")
            if not new.filter("label != old").limit(1).count():
                return new.select("node", "label")
            label = new.select("node", "label")


def linked_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text)."""
    join = Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent)
    groups = common.written(join.components(), "components")
    named = join.nodes.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = common.written(named.join(first, "label").select("node", "component_id"), "named")
    return join.rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of ``docs``, one with the smallest doc_id, null ids last; all columns.

    A row is known by its doc_id and a hash of its text, so rows that share a doc_id, or have none, are told
    apart; of rows equal in both one stays. Rows without words stay."""
    join = Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent)
    groups = common.written(join.components(), "components")
    rows = join.rows.filter("node is not null").groupBy("node", "doc_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    rows = common.written(rows.join(groups, "node", "left").select("doc_id", "mark", "node", "times", F.coalesce("label", "node").alias("label")), "labelled")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "mark")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node")) & (F.col("mark") == F.col("best.mark"))
    # Out go the rows that don't stay and those that would stay more than once, which come back once.
    out = common.written(rows.join(best, "label").filter(~stays | (F.col("times") > 1)).select(F.col("doc_id").alias("out_id"), F.col("mark").alias("out_mark"), stays.alias("back")), "gone")

    def chosen(some: DataFrame, how: str) -> DataFrame:
        few = some.limit(SMALL + 1).count() <= SMALL
        same = docs["doc_id"].cast("long").eqNullSafe(some["out_id"]) & (F.xxhash64(docs["text"]) == some["out_mark"])
        return docs.join(F.broadcast(some) if few else some, same, how)

    left = chosen(out.select("out_id", "out_mark"), "left_anti")
    back = out.filter("back").select("out_id", "out_mark")
    if not back.limit(1).count():
        return left
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("one")
    return left.union(chosen(back, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(one).select("one.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(common.documents(spark, sf_dir), 3, 90)
