"""Toxicity of texts after noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (letters folded to a-z, one class for
   other letters, one for word boundaries). Only the table of counts reaches the driver.
2. Suspicious tokens (with digits or symbols that may stand for letters, a letter three times or more
   in a row, letters set apart by dots) become lattices of what may have been meant, each choice with
   a channel probability; Viterbi decoding under the character model picks the reading. Plain words
   are their own only path. Runs of three or more single letters, digits or symbols set apart by
   spaces, punctuation around them aside, become one lattice with or without a word's end at each
   gap. Neither has a greatest length nor a least share of letters.
3. A logistic model scores the restored text by the words it has. It is fitted on a bounded sample of
   labelled rows (``PER_CLASS`` rows a label, those with the least hashes of the id): words that toxic texts have
   clearly more often, counted where the texts are, become features, ``MOST_FEATURES`` at most; only which of
   those each sampled text has reaches the driver. Ridge-regularised Newton steps set the weights, and the
   sample's classes are weighted back to their shares.

A null text counts as empty and scores like any text without such words. Repeated rows score alike, a
null doc_id is carried. Without labelled rows of both kinds every score is the share of toxic labels
(0 without any). Labels that repeat a doc_id all count."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, vec

PER_CLASS = 3000
MOST_FEATURES = 400
CACHE = 200_000
CACHED = 64  # bytes of a token whose reading is kept

SYMBOLS = 28
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[192:] = 27
_LETTER = _SYMBOL > 0
_LETTER[128:] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[97:123] = _PLAIN[65:91] = True
_WORD = _LETTER.copy()
_WORD[48:58] = True

#: What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Characters that may set letters apart.
APART = ".-_*~'·"
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET if ord(c) < 128]] = True
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in APART if ord(c) < 128]] = True
STANDS, LEFT_OUT, FEWER, BOUNDARY, WITHIN, GAP = math.log(0.5), math.log(0.3), math.log(0.4), math.log(0.05), math.log(0.8), math.log(0.2)


# --- character model ---------------------------------------------------------------------------


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        data, offsets = vec.flat(batch.column(0))
        for _, _, block, at in vec.blocks(data, offsets):
            s = _SYMBOL[block].astype(np.int32)
            whole = (block & 0xC0) != 0x80
            kept = np.zeros(len(block) + 1, np.int64)
            np.cumsum(whole, out=kept[1:])
            s = np.insert(s[whole], kept[at], 0)
            if len(s) > 2:
                total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])


class CharacterModel:
    """log P(c | a, b), interpolated with bigrams and unigrams."""

    def __init__(self, counts: np.ndarray, weight: float = 20.0) -> None:
        n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        n[0, 0, 0] = 0
        one = n.sum((0, 1)) + 1
        one /= one.sum()
        two = n.sum(0)
        two = (two + weight * one) / (two.sum(1, keepdims=True) + weight)
        three = (n + weight * two[None]) / (n.sum(2, keepdims=True) + weight)
        self.log = np.log(three).tolist()


def corpus_model(texts: DataFrame) -> CharacterModel:
    common.ship(texts.sparkSession)
    rows = texts.mapInArrow(common.tidied(_trigrams), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r.code] = r.n
    return CharacterModel(counts)


# --- decoding ----------------------------------------------------------------------------------


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the readings and their channel log-probabilities."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, k = token[i], j - i
        if c.isalpha():
            out.append([(c * k, 0.0)] if k < 3 else [(c, FEWER), (c * 2, FEWER), (c * k, math.log(0.2))])
        elif c in LEET:
            out.append([(x * m, STANDS * k) for x in LEET[c] for m in {k, 1 if k > 2 else k}] + [(" ", BOUNDARY)])
        elif c in APART:
            out.append([("", LEFT_OUT), (" ", BOUNDARY)])
        elif c == " ":
            out.append([("", WITHIN), (" ", GAP)])
        else:
            out.append([(" ", 0.0)])
        i = j
    return out


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest reading of a token, lower-cased; a space stands for a word boundary."""
    log = model.log
    # What was read is a chain of (before, text), which paths share, so that the time is linear in the length.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in [*lattice(token.lower()), [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, read) in states.items():
            for text, p in choices:
                x, y, s = a, b, score + p
                for c in text:
                    z = _code(c)
                    s += log[x][y][z]
                    x, y = y, z
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (read, text))
        states = new
    read = max(states.values(), key=lambda v: v[0])[1]
    parts = []
    while read is not None:
        read, text = read
        parts.append(text)
    return "".join(reversed(parts)).strip()


# --- words of a block ---------------------------------------------------------------------------


def suspicious(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens need decoding."""

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total[ends] - total[starts]

    length = ends - starts
    leet = count(_LEET[block])
    inner = np.zeros(len(block), bool)
    if len(block) > 2:
        inner[1:-1] = _APART[block[1:-1]] & (_LETTER | _LEET)[block[:-2]] & (_LETTER | _LEET)[block[2:]]
    s = _SYMBOL[block]
    triple = np.zeros(len(block), bool)
    if len(block) > 2:
        triple[2:] = (s[2:] > 0) & (s[2:] < 27) & (s[2:] == s[1:-1]) & (s[2:] == s[:-2])
    # A run that began in an earlier token can't count: white space has symbol 0.
    last = block[ends - 1] if len(starts) else np.zeros(0, np.uint8)
    closing = (last == ord("!")) | (last == ord("|"))  # alone they end a sentence or a cell
    return (count(inner) > 0) | (count(triple) > 0) | ((leet > closing) & (length > 1))


def singles(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token the place of its only letter, digit or symbol that may be one, punctuation around it aside; -1 if it has more or none."""
    places = np.flatnonzero(_WORD[block])
    lo, hi = np.searchsorted(places, starts), np.searchsorted(places, ends)
    at = np.where((ends - starts == 1) & _LEET[block[starts]], starts, -1) if len(starts) else np.zeros(0, np.int64)
    one = hi - lo == 1
    at[one] = places[lo[one]]
    return at


class Reader:
    """Word hashes of a block's restored text: (document, hash) pairs, a pair a word."""

    def __init__(self, model: CharacterModel) -> None:
        self.model, self.cache = model, {}

    def restored(self, token: str) -> list[int]:
        found = self.cache.get(token)
        if found is None:
            found = [vec.text_hash(w) for w in decode(token, self.model).split(" ") if w]
            if len(token) <= CACHED:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[token] = found
        return found

    def words(self, block: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, docs = vec.word_spans(block, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(docs))
        places = np.flatnonzero(_LETTER[block])
        lo, hi = np.searchsorted(places, starts), np.searchsorted(places, ends)
        has = hi > lo
        core_starts, core_ends = places[lo[has]], places[hi[has] - 1] + 1
        hashes, of = [vec.span_hashes(block, core_starts, core_ends, lower=True)], [doc[has]]
        odd = np.flatnonzero(suspicious(block, starts, ends))
        more: list[int] = []
        more_of: list[int] = []
        raw = block.tobytes() if len(odd) else b""
        for k in odd:
            for h in self.restored(raw[starts[k] : ends[k]].decode(errors="replace")):
                more.append(h), more_of.append(doc[k])
        # Letters set apart by spaces: runs of three or more tokens of one letter of a document.
        core = singles(block, starts, ends)
        single = core >= 0
        if single.any():
            edge = np.diff(np.concatenate([[0], single.view(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                for x, y in self._parts(doc, a, b):
                    if y - x >= 3:
                        for h in self.restored(" ".join(block[core[x:y]].tobytes().decode())):
                            more.append(h), more_of.append(doc[x])
        if more:
            hashes.append(np.array(more, np.uint64)), of.append(np.array(more_of, np.int64))
        return np.concatenate(of), np.concatenate(hashes)

    @staticmethod
    def _parts(doc: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
        while a < b:
            e = min(b, a + int(np.searchsorted(doc[a:b], doc[a], "right")))
            yield a, e
            a = e


# --- the classifier -----------------------------------------------------------------------------


def _word_sets(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for batch in batches:
            data, offsets = vec.flat(batch.column(1))
            sets = []
            for a, b, block, at in vec.blocks(data, offsets):
                of, h = reader.words(block, at)
                sets += [np.unique(h[of == k]).tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(sets, pa.binary())], names=["toxic", "words"])

    return run


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, words) -> how many toxic and other texts of a batch have each word."""
    for batch in batches:
        toxic = batch.column(0).to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        if sets:
            words, at = np.unique(np.concatenate(sets), return_inverse=True)
            label = np.repeat(toxic, [len(s) for s in sets])
            a = np.bincount(at, weights=label, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(a), pa.array(np.bincount(at, minlength=len(words)) - a)], names=["word", "a", "b"])


def _having(words: np.ndarray):
    """(toxic, words) -> toxic and the places of the chosen words that a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [np.flatnonzero(np.isin(words, np.frombuffer(x.as_buffer(), np.uint64))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(has, pa.list_(pa.int64()))], names=["toxic", "has"])

    return run


class Classifier:
    """Words (sorted hashes), their weights and the intercept."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, base: float) -> None:
        self.words, self.weights, self.base = words, weights, base

    def scores(self, of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.base)
        if len(self.words) and len(hashes):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            hit = self.words[at] == hashes
            pairs = np.unique(of[hit] * len(self.words) + at[hit])
            np.add.at(z, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(share: float) -> Classifier:
    """Every text has the same score."""
    p = min(max(share, 1e-13), 1 - 1e-9)
    return Classifier(np.zeros(0, np.uint64), np.zeros(0), math.log(p / (1 - p)))


def fit(words: np.ndarray, rows: list[tuple[int, list[int]]], shares: tuple[float, float]) -> Classifier:
    """words: the features, sorted. rows: label and features of each sampled text. shares: of the labels 0 and 1 among all labelled rows."""
    y = np.array([r[0] for r in rows], float)
    positive = y.sum()
    x = np.zeros((len(rows), len(words) + 1))
    x[:, -1] = 1
    for i, (_, has) in enumerate(rows):
        x[i, has] = 1
    weight = np.where(y == 1, shares[1] / positive, shares[0] / (len(y) - positive)) * len(rows)
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(len(words), 0.5), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w += step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(words, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, model) -> Classifier:
    """From the rows of ``labels`` (doc_id, toxic) with texts in ``docs``; model: a broadcast CharacterModel."""
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return constant(0.0)
    total = sum(n.values())
    shares = n.get(0, 0) / total, n.get(1, 0) / total
    least = [labels.filter(F.col("toxic") == c).orderBy(F.xxhash64(F.col("doc_id"), F.lit(23)), "doc_id").limit(PER_CLASS) for c in (0, 1)]
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(least[0].union(least[1])), "doc_id").select("toxic", "text")
    sets = common.written(sample.mapInArrow(common.tidied(_word_sets(model)), "toxic int, words binary").distinct(), "word-sets")  # copies of a text count once
    sizes = {r.toxic: r.n for r in sets.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return constant(shares[1])
    lift = F.log((F.col("a") + 0.5) / (sizes[1] + 1)) - F.log((F.col("b") + 0.5) / (sizes[0] + 1))
    counts = sets.mapInArrow(common.tidied(_by_word), "word long, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    telling = counts.filter((F.col("a") >= max(2, 0.01 * sizes[1])) & (lift > math.log(3)))
    chosen = telling.orderBy((-F.col("a") * lift).asc(), "word").limit(MOST_FEATURES).select("word").toArrow()  # how much a word tells, by how often it is met
    words = np.sort(chosen.column(0).to_numpy().view(np.uint64))
    rows = sets.mapInArrow(common.tidied(_having(words)), "toxic int, has array<long>").toArrow().to_pylist()
    return fit(words, sorted((r["toxic"], r["has"]) for r in rows), shares)


def _score(model, classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, c = Reader(model.value), classifier.value
        for batch in batches:
            data, offsets = vec.flat(batch.column(2))
            parts = [c.scores(*reader.words(block, at), b - a) for a, b, block, at in vec.blocks(data, offsets)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text); no shuffle of texts."""
    spark = docs.sparkSession
    common.ship(spark)
    model = spark.sparkContext.broadcast(corpus_model(docs.select("text")))
    classifier = spark.sparkContext.broadcast(train(docs, labels, model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(common.tidied(_score(model, classifier)), f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.crc_mod("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    return toxicity(common.documents(spark, sf_dir), labels, held_out)
