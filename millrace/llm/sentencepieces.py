"""SentencePiece encoding and decoding by suffix-array matching.

Text is cut where no piece can cross: before runs of spaces. The distinct parts of a batch that no
earlier batch had are joined into one code array, and a suffix array of it, sorted by as many
characters as the longest piece has, is searched for all pieces at once: each narrows its range of
suffixes a character at a time by binary search. The ranges give every occurrence of every piece, the
edges; they are sorted by position. Relaxing them merges neighbouring symbols, in all parts at a
time, along the best edge that spans two, the best score first and the leftmost of equals, as the
library does for models of type BPE, until no edge joins two symbols. Characters without a piece
become byte pieces.

Decoding joins the pieces' text, turns the space mark into spaces and drops the first.

Null texts count as empty and have no pieces. Repeated rows stay rows; a null doc_id is carried; an
empty table gives an empty result. Very long parts without spaces are cut between characters that
stand together in no piece; what is longer than ``LONG`` even so is merged alone with a heap."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

MARK = "▁"
LONG = 200
#: Characters of new parts that are matched at a time, and parts remembered by a task's process.
CHUNK = 400_000
REMEMBERED = 700_000

_models: dict[str, Pieces] = {}


class Pieces:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        self.text = [p.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.rank = {self.text[i]: (-p.get_score(i), i) for i in plain}
        self.unknown = p.unk_id()
        if any(MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("pieces that cross a space aren't supported")
        order = sorted(plain, key=lambda i: (-p.get_score(i), i))
        place = np.zeros(n, np.int64)
        place[order] = np.arange(len(order))
        self.place = place  # merge order of each id
        letters = sorted({c for i in plain for c in self.text[i]})
        self.code = {c: k + 2 for k, c in enumerate(letters)}  # 0 ends a part, 1 is any other character
        self.size = len(letters) + 2
        self.longest = max(len(self.text[i]) for i in plain)
        self.ids = np.array(plain)
        self.lengths = np.array([len(self.text[i]) for i in plain])
        self.codes = np.zeros((len(plain), self.longest), np.int32)
        for k, i in enumerate(plain):
            self.codes[k, : len(self.text[i])] = [self.code[c] for c in self.text[i]]
        self.lines = not any("\n" in self.text[i] for i in plain)  # no piece crosses a line's end
        self.beside = {self.text[i][k : k + 2] for i in plain for k in range(len(self.text[i]) - 1)}
        top = max(map(ord, letters)) + 1
        self.table = np.ones(top + 1, np.int32)
        for c, k in self.code.items():
            self.table[ord(c)] = k
        self.out = [b""] * n
        for i in plain:
            self.out[i] = self.text[i].replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self.out[self.unknown] = " ⁇ ".encode()
        self.known: dict[str, int] = {}
        self.clear()

    @staticmethod
    def load(path: str) -> Pieces:
        if path not in _models:
            _models[path] = Pieces(path)
        return _models[path]

    def clear(self) -> None:
        self.known.clear()
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # -- matching

    def fallback(self, c: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in c.encode()] if self.bytes else [self.unknown]

    def _suffixes(self, x: np.ndarray) -> np.ndarray:
        """The starts of all suffixes in order of their first ``longest`` codes: four at once, then by doubling."""
        key, k = x.astype(np.int64), 4
        for j in range(1, k):
            key *= self.size
            key[:-j] += x[j:]
        while True:
            order = np.argsort(key)
            if k >= self.longest:
                return order
            s = key[order]
            rank = np.empty(len(x), np.int64)
            rank[order] = np.cumsum(np.append(True, s[1:] != s[:-1]))
            key = rank * (len(x) + 1)
            key[:-k] += rank[k:]
            k *= 2

    def edges(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position * (longest + 1) + length, id) of all occurrences of pieces in codes, sorted."""
        order = self._suffixes(x)
        n = len(x)
        padded = np.concatenate([x, np.zeros(self.longest, x.dtype)])
        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n)

        def bound(rows: np.ndarray, depth: int, right: bool) -> np.ndarray:
            a, b, want = lo[rows].copy(), hi[rows].copy(), self.codes[rows, depth]
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, n - 1)] + depth]
                less = (seen <= want) if right else (seen < want)
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            return a

        rows = np.arange(len(self.ids))
        for depth in range(self.longest):
            rows = rows[(self.lengths[rows] > depth) & (lo[rows] < hi[rows])]
            if not len(rows):
                break
            low, high = bound(rows, depth, False), bound(rows, depth, True)
            lo[rows], hi[rows] = low, high
        count = np.maximum(hi - lo, 0)
        first = np.cumsum(count) - count
        at = order[np.arange(count.sum()) - np.repeat(first - lo, count)]
        keys = at * (self.longest + 1) + np.repeat(self.lengths, count)
        ids = np.repeat(self.ids, count)
        by = np.argsort(keys)
        return keys[by], ids[by]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts in a row, and how many each has."""
        text = "\0".join(parts) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = self.table[np.minimum(points, len(self.table) - 1)]
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths + 1) - 1
        x = x.copy()
        x[ends] = 0
        keys, ids = self.edges(x)
        wide = self.longest + 1
        place = self.place

        def edge(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
            """The id of the piece over each span, or -1."""
            key = starts * wide + (stops - starts)
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            return np.where((stops - starts < wide) & (keys[at] == key), ids[at], -1) if len(keys) else np.full(len(starts), -1)

        none = 1 << 40
        start = np.flatnonzero(x)
        part = np.repeat(np.arange(len(parts)), lengths)
        stop = start + 1
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def joins(k: np.ndarray) -> np.ndarray:
            """The merge order of the symbol at k with the next one."""
            out = np.full(len(k), none)
            fits = np.flatnonzero(k + 1 < len(start))
            fits = fits[part[k[fits] + 1] == part[k[fits]]]
            found = edge(start[k[fits]], stop[k[fits] + 1])
            out[fits] = np.where(found >= 0, place[found], none)
            return out

        best = joins(np.arange(len(start)))
        while len(start):
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            least = np.minimum.reduceat(best, heads)
            sizes = np.diff(np.append(heads, len(start)))
            over = least == none
            if over.any():
                rest = np.repeat(over, sizes)
                done.append((part[rest], start[rest], stop[rest]))
                keep = ~rest
                start, stop, part, best = start[keep], stop[keep], part[keep], best[keep]
                least, sizes = least[~over], sizes[~over]
                if not len(start):
                    break
                heads = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(best == np.repeat(least, sizes))
            merged = hit[np.append(True, part[hit[1:]] != part[hit[:-1]])]
            stop[merged] = stop[merged + 1]
            keep = np.ones(len(start), bool)
            keep[merged + 1] = False
            merged = merged - np.arange(len(merged))  # one symbol fewer for each merge before
            start, stop, part, best = start[keep], stop[keep], part[keep], best[keep]
            changed = np.concatenate([merged, merged[merged > 0] - 1])
            best[changed] = joins(changed)
        part, start, stop = (np.concatenate(c) for c in zip(*done, strict=True))
        by = np.argsort(start)
        part, start, stop = part[by], start[by], stop[by]
        got = edge(start, stop)
        missing = np.flatnonzero(got < 0)  # single characters without a piece
        if len(missing):
            chars, which = np.unique(points[start[missing]], return_inverse=True)
            instead = [np.array(self.fallback(chr(c)), np.int64) for c in chars]
            count = np.ones(len(got), np.int64)
            count[missing] = np.array([len(i) for i in instead])[which]
            first = np.cumsum(count) - count
            got, part = np.repeat(got, count), np.repeat(part, count)
            for k, own in enumerate(instead):
                at = first[missing[which == k]]
                for j, i in enumerate(own):
                    got[at + j] = i
        return got.astype(np.int32), np.bincount(part, minlength=len(parts))

    def _alone(self, part: str) -> list[int]:
        """One long part, merged with a heap: the same order of merges."""
        symbols: list[str | None] = list(part)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(symbols)
            if j < len(symbols) and (r := self.rank.get(symbols[i] + symbols[j])):
                heapq.heappush(heap, (r, i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [k for s in symbols if s is not None for k in ([self.rank[s][1]] if s in self.rank else [x for c in s for x in self.fallback(c)])]

    def _learn(self, parts: list[str]) -> None:
        """Encodes new parts and remembers them."""
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        some: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal some, size
            if some:
                ids, n = self._encode_parts(some)
                found.append(ids), counts.append(n)
            some, size = [], 0

        owner: list[int] = []  # the part of each cut
        for i, p in enumerate(parts):
            cuts = [0, len(p)]
            if len(p) > LONG or "\0" in p:
                cuts = [0, *(k for k in range(1, len(p)) if p[k - 1 : k + 1] not in self.beside), len(p)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                cut = p[a:b]
                owner.append(i)
                if len(cut) > LONG or "\0" in cut:
                    flush()
                    ids = np.array(self._alone(cut), np.int32)
                    found.append(ids), counts.append(np.array([len(ids)]))
                    continue
                some.append(cut)
                size += len(cut) + 1
                if size >= CHUNK:
                    flush()
        flush()
        each = np.bincount(owner, np.concatenate(counts), len(parts)).astype(np.int64)
        first = len(self.starts) - 1
        self.known.update(zip(parts, range(first, first + len(parts)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(each)])
        self.flat = np.concatenate([self.flat, *found])

    def parts(self, text: str) -> list[str]:
        """The text with its space marks, cut before each run of them and around line ends."""
        if not text:
            return []
        out: list[str] = []
        run = MARK  # marks that go before the next word
        lines = text.replace(MARK, " ").split("\n") if self.lines else [text.replace(MARK, " ")]
        for k, line in enumerate(lines):
            if k:
                out += [run, "\n"] if run else ["\n"]
                run = ""
            words = line.split(" ")
            if not k and "" not in words:
                out += [MARK + w for w in words]
                run = ""
                continue
            if words[0]:
                out.append(run + words[0])
                run = ""
            for w in words[1:]:
                run += MARK
                if w:
                    out.append(run + w)
                    run = ""
        return out + [run] if run else out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.parts(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.clear()
        known = self.known
        every = [p for c in cut for p in c]
        if new := list(dict.fromkeys(p for p in every if p not in known)):
            self._learn(new)
        at = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
        begin = self.starts[at]
        n = self.starts[at + 1] - begin
        total = np.append(0, np.cumsum(n))
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1] - begin, n)]
        return np.split(ids, total[np.cumsum([len(c) for c in cut])[:-1]]) if cut else []

    def decode(self, ids: np.ndarray) -> str:
        joined = b"".join([self.out[i] for i in ids])
        return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def _steps(column: pa.Array, size: int = 2 << 20) -> Iterator[list[str]]:
    some: list[str] = []
    n = 0
    for t in column:
        some.append(t.as_py() or "")
        n += len(some[-1])
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in batches:
            at = 0
            for texts in _steps(batch.column(1)):
                ids = pieces.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], names=["doc_id", "ids"])
                at += len(texts)

    return run


def encoded(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row; no shuffle."""
    common.ship(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(common.tidied(_encoder(model_path)), f"doc_id {kind}, ids array<int>")


def decoded(tokens: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    common.ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(i.values.to_numpy()) if i.is_valid else "" for i in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(common.tidied(run), f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in batches:
            at = 0
            for texts in _steps(batch.column(1)):
                ids = pieces.encode(texts)
                whole = [pieces.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                sha = [hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(i) for i in ids], pa.int64()), pa.array(sha), pa.array(whole)], names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])
                at += len(texts)

    return run


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 32-bit little-endian numbers) and round_trip of each row."""
    common.ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(common.tidied(_digests(model_path)), f"doc_id {kind}, n_tokens long, ids_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
