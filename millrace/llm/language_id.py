"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's bytes become classes (A-Z as a-z, digits, white space and other ASCII one class each, bytes
of multi-byte characters themselves) and are cut into windows of a fixed length that cover the whole
text. Filters of widths 2, 3 and 4 over byte embeddings, maximum pooling over the window and a
softmax give a window's probabilities; the text's are their mean, weighted by letters.

At prediction a filter's part of two adjacent bytes is one row of a table, so each width costs a
lookup or two a byte and no multiplication. Training sees a bounded sample: about ``PER_LABEL``
documents a label, chosen by hash, and ``WINDOWS`` windows of each.

Null texts and those without a letter are ``und`` with score 0. Documents without lang don't train.
Repeated rows get the same answer each; a null doc_id is carried (and counts as the text '' for the
choice of held-out rows). Without any labelled document every text is ``und``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, vec

PER_LABEL = 500
WINDOWS = 8
LENGTH = 256
DIM = 8
FILTERS = 8
WIDTHS = (2, 3, 4)
EPOCHS = 6

PAD, SPACE, DIGIT, OTHER = 0, 27, 28, 29
CLASS = np.full(256, OTHER, np.uint8)
CLASS[97:123] = CLASS[65:91] = np.arange(1, 27)
CLASS[vec.SPACE] = SPACE
CLASS[48:58] = DIGIT
CLASS[128:] = 30 + np.arange(128)
CLASSES = 158
LETTER = np.zeros(CLASSES, bool)
LETTER[1:27] = LETTER[30:] = True


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all documents of a block, and the document offsets in windows."""
    counts = -(-np.diff(offsets) // LENGTH)
    at = np.concatenate([[0], np.cumsum(counts)])
    x = np.zeros(int(at[-1]) * LENGTH, np.uint8)
    x[np.arange(len(data)) + np.repeat(at[:-1] * LENGTH - offsets[:-1], np.diff(offsets))] = CLASS[data]
    return x.reshape(-1, LENGTH), at


class Network:
    def __init__(self, labels: list[str], seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        self.labels = labels
        self.embedding = r.normal(0, 0.5, (CLASSES, DIM)).astype(np.float32)
        self.filters = [r.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = r.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.base = np.zeros(len(labels), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, size: int = 64, rate: float = 0.01, seed: int = 2) -> None:
        r = np.random.default_rng(seed)
        params = [self.embedding, *self.filters, self.bias, self.dense, self.base]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        counts = np.maximum(np.bincount(y, minlength=len(self.labels)), 1)
        weight = (len(y) / len(self.labels) / counts).astype(np.float32)
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(order), size):
                at = order[i : i + size]
                grads = self._gradients(x[at], y[at], weight)
                step += 1
                now = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, a, b in zip(params, grads, m, v, strict=True):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= now * a / (np.sqrt(b) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n = np.arange(len(x))
        e = self.embedding[x]
        pooled, places = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            spread = np.concatenate([e[:, k : LENGTH - w + 1 + k] for k in range(w)], axis=2)
            z = spread @ f
            places.append(z.argmax(1))
            pooled.append(np.take_along_axis(z, places[-1][:, None], 1)[:, 0])
        pre = np.concatenate(pooled, 1) + self.bias
        h = np.maximum(pre, 0)
        logits = h @ self.dense + self.base
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[n, y] -= 1
        d = (p * weight[y][:, None] / len(x)).astype(np.float32)
        dh = (d @ self.dense.T) * (pre > 0)
        de = np.zeros_like(self.embedding)
        df = []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own = dh[:, k * FILTERS : (k + 1) * FILTERS]
            codes = x[n[:, None, None], places[k][:, :, None] + np.arange(w)]
            patch = self.embedding[codes].reshape(len(x), FILTERS, w * DIM)
            df.append(np.einsum("nf,nfi->if", own, patch))
            back = own[:, :, None] * f.T[None]
            np.add.at(de, codes.ravel(), back.reshape(-1, DIM))
        return [de, *df, dh.sum(0), h.T @ d, d.sum(0)]

    def tables(self) -> dict:
        """The network with embeddings multiplied out: what prediction looks up."""
        parts = [[self.embedding @ f[k * DIM : (k + 1) * DIM] for k in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray((a[:, None] + b[None]).reshape(-1, FILTERS))

        two, three, four = parts
        return {"labels": self.labels, "two": pair(*two), "three": pair(*three[:2]), "third": three[2], "four": pair(*four[:2]), "fourth": pair(*four[2:]), "bias": self.bias, "dense": self.dense, "base": self.base}


def probabilities(t: dict, x: np.ndarray, step: int = 512) -> np.ndarray:
    """Softmax of each window."""
    out = np.empty((len(x), len(t["labels"])), np.float32)
    for i in range(0, len(x), step):
        c = x[i : i + step].astype(np.int32)
        pair = c[:, :-1] * CLASSES + c[:, 1:]
        z = [t["two"].take(pair, 0).max(1)]
        wide = t["three"].take(pair[:, :-1], 0)
        wide += t["third"].take(c[:, 2:], 0)
        z.append(wide.max(1))
        wide = t["four"].take(pair[:, :-2], 0)
        wide += t["fourth"].take(pair[:, 2:], 0)
        z.append(wide.max(1))
        logits = np.maximum(np.concatenate(z, 1) + t["bias"], 0) @ t["dense"] + t["base"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        out[i : i + step] = p / p.sum(1, keepdims=True)
    return out


def _predict(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        for batch in batches:
            data, offsets = vec.flat(batch.column(2))
            best, score = [], []
            for _, _, block, at in vec.blocks(data, offsets):
                x, docs = windows(block, at)
                p = probabilities(t, x) if len(x) else np.zeros((0, len(t["labels"])))
                p = p * (LETTER[x].sum(1) + 1e-6)[:, None]
                total = np.zeros((len(p) + 1, p.shape[1]))
                np.cumsum(p, axis=0, out=total[1:])
                own = total[docs[1:]] - total[docs[:-1]]
                own /= np.maximum(own.sum(1, keepdims=True), 1e-30)
                best.append(own.argmax(1))
                score.append(own.max(1) if own.size else np.zeros(len(own)))
            best = np.concatenate(best) if best else np.zeros(0, np.int64)
            score = np.concatenate(score) if score else np.zeros(0)
            und = ~np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)
            names = np.array([*t["labels"], "und"], object)
            best[und], score[und] = len(t["labels"]), 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, text) -> the windows to train on, evenly spread over each text."""
    for batch in batches:
        ids, langs, rows = [], [], []
        for i, lang, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            b = np.frombuffer(text.as_py().encode(), np.uint8)
            x, _ = windows(b, np.array([0, len(b)]))
            for k in np.unique(np.linspace(0, len(x) - 1, min(WINDOWS, len(x))).astype(int)) if len(x) else ():
                if LETTER[x[k]].sum() >= 8:
                    ids.append(i.as_py()), langs.append(lang.as_py()), rows.append(x[k].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["doc_id", "lang", "x"])


def train(labelled: DataFrame, per_label: int = PER_LABEL) -> Network | None:
    """A network from a table of doc_id, text and lang; at most about ``per_label`` documents a label are read in full."""
    common.ship(labelled.sparkSession)
    sizes = {r.lang: r.n for r in labelled.filter("lang is not null and text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(17)), 11) / F.lit(float(1 << 53))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, per_label / n)]), F.col("lang"))
    sample = labelled.filter("lang is not null and text is not null").filter(u < share).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    rows = sample.mapInArrow(common.tidied(_sampled), "doc_id long, lang string, x binary").orderBy(F.xxhash64("doc_id", "lang", "x"), "doc_id", "lang", "x").limit(2 * WINDOWS * per_label * len(sizes)).toArrow().to_pylist()  # the same rows each time, should the bound bind
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] or 0, r["x"]))
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    net = Network(labels)
    net.train(np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(-1, LENGTH), np.array([labels.index(r["lang"]) for r in rows]))
    return net


def identify(docs: DataFrame, net: Network | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text); no shuffle."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", held_out.alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    common.ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(common.tidied(_predict(spark.sparkContext.broadcast(net.tables()))), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = common.crc_mod("doc_id", 4) == 2
    net = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text"), net, held_out)
