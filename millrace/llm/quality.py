"""Quality rules by weak supervision.

Each rule looks at one property of a text and votes good, bad or abstains. Texts with the same votes
are alike to the model, so all it needs is the count of each vote pattern, at most 3 ** rules of
them, counted over all documents. Expectation-maximisation finds, without labels, the share of good
texts and of each family of faults, and how often each rule faults either: its false alarms among good
texts and its hits in its own family. Several rules look at each family, so that it is their agreement that shows
a fault: a rule that faults texts to which all others have no objection is found to be noisy and outvoted, two
that seldom come together but in their family are believed. The posterior probability that a text is good then replaces a
list of rules that must all pass. Texts that fail the base limits are rejected whatever the model says.

Words are runs of characters that aren't white space. A null text has no words and fails. Empty
tables give empty results, repeated rows the same verdict each, a null doc_id is carried. Ties in the
posterior (exactly a half) keep the text. Long texts are measured whole, in blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, vec

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
#: The posterior probability of being good from which a text is kept.
THRESHOLD = 0.5
#: Pseudo-votes for each rate and its first guess: false alarms, hits in a rule's own family, faults in others.
PSEUDO, ALARM, HIT, STRAY = 10.0, 0.02, 0.6, 0.05
#: A family of faults is one whose rules hit more often than not, and others don't; no rule is held to be without false alarms.
LEAST_HIT, MOST_STRAY, LEAST_ALARM = 0.5, 0.5, 0.003

_FLAG = {}
for _name, _chars in {"symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "shout": b"!|", "stop": b".!?", "digit": b"0123456789"}.items():
    _FLAG[_name] = np.zeros(256, bool)
    _FLAG[_name][list(_chars)] = True
_FLAG["point"] = (np.arange(256) & 0xC0) != 0x80
_FLAG["word_point"] = _FLAG["point"] & ~vec.SPACE
_FLAG["letter"] = _FLAG["upper"] | _FLAG["lower"] | (np.arange(256) >= 0xC0)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shout", "n_stops", "n_distinct", "n_stutter"]
FEATURES = ", ".join(f"{c} long" for c in COUNTS)


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash, whether its document has it more than once, and whether it has had it before."""
    key = vec.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    again, twice = np.empty(len(k), bool), np.empty(len(k), bool)
    again[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, again


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of each document of a block."""
    n = len(offsets) - 1
    starts, ends, docs = vec.word_spans(data, offsets)
    words = vec.span_hashes(data, starts, ends)
    word_doc = np.repeat(np.arange(n), np.diff(docs))
    found = {"n_words": np.diff(docs)}
    for name, flag in (("word_chars", "word_point"), ("n_symbols", "symbol"), ("n_upper", "upper"), ("n_letters", "letter"), ("n_shout", "shout")):
        found[name] = _per_doc(_FLAG[flag][data], offsets)
    found["n_stops"] = _per_doc(_FLAG["stop"][data[ends - 1]], docs) if len(ends) else np.zeros(n, np.int64)
    found["n_distinct"] = _per_doc(~_repeats(words, word_doc)[1], docs)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (word_doc[1:] == word_doc[:-1])
    found["n_stutter"] = _per_doc(again, docs)
    # Lines: from each document's start or the byte after \n, to the next \n or the document's end.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]))
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_doc + 1])
    last = np.append(line_doc[1:] != line_doc[:-1], True)
    line_ends = np.where(last, offsets[line_doc + 1], line_ends - 1)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_doc = line_starts[has_word], line_ends[has_word], line_doc[has_word]
    at = np.searchsorted(line_doc, np.arange(n + 1))
    found["n_lines"] = np.diff(at)
    found["n_dup_lines"] = _per_doc(_repeats(vec.span_hashes(data, line_starts, line_ends), line_doc)[1], at)
    windows = vec.window_hashes(words, WINDOW)
    inside = np.flatnonzero(word_doc[: len(windows)] == word_doc[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    twice = inside[_repeats(windows[inside], word_doc[inside])[0]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    found["n_repeat_words"] = _per_doc(np.cumsum(cover[:-1]) > 0, docs)
    return found


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


#: The rules, by the family of faults that each looks at.
NAMES = ["length", "upper", "word_length", "stops", "symbols", "letters", "shout", "repeats", "distinct", "lines", "stutter"]
FAMILIES = [["length", "upper", "word_length", "stops"], ["symbols", "letters", "shout"], ["repeats", "distinct", "lines", "stutter"]]
RULES = len(NAMES)


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """A column a rule, as in NAMES: 1 good, 2 bad, 0 abstains."""
    n = f["n_words"]

    def rule(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, 2, np.where(good, 1, 0))

    symbols, repeated, upper = _ratio(f["n_symbols"], n), _ratio(f["n_repeat_words"], n), _ratio(f["n_upper"], f["n_letters"])
    length, letters, shout = _ratio(f["word_chars"], n), _ratio(f["n_letters"], f["word_chars"]), _ratio(f["n_shout"], n)
    stops, dups, stutter = _ratio(f["n_stops"], n), _ratio(f["n_dup_lines"], f["n_lines"]), _ratio(f["n_stutter"], n)
    distinct = f["n_distinct"] / np.sqrt(np.maximum(n, 1))  # hardly depends on the length of sound texts
    return np.stack(
        [
            rule(n >= 40, n < LEAST_WORDS),
            rule(upper < 0.15, upper > 0.4),
            rule((length >= 3) & (length <= 12), (length < 2) | (length > 16)),
            rule((stops > 0.02) & (stops < 0.4), (stops == 0) & (n > 60)),
            rule(symbols < 0.02, symbols > 0.1),
            rule(letters > 0.9, letters < 0.87),
            rule(shout < 0.05, shout > 0.3),
            rule(repeated < 0.03, repeated > 0.18),
            rule(distinct > 2.8, distinct < 2.2),
            rule((dups == 0) & (f["n_lines"] > 1), (dups > 0.3) & (f["n_dup_lines"] > 2)),
            rule(stutter < 0.03, stutter > 0.1),
        ],
        axis=1,
    )


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def _batch(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    data, offsets = vec.flat(texts)
    parts = [measure(block, at) for _, _, block, at in vec.blocks(data, offsets)]
    f = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS}
    return f, pattern(votes(f)) if len(texts) else np.zeros(0, np.int64)


def _base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED * f["n_words"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc_id, all counts, pattern."""
    for batch in batches:
        f, p = _batch(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[c], pa.int64()) for c in COUNTS), pa.array(p, pa.int64())], names=["doc_id", *COUNTS, "pattern"])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, counts = np.unique(_batch(batch.column(0))[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["pattern", "n"])


def fit(counts: dict[int, int], steps: int = 500) -> dict[int, float]:
    """Pattern -> posterior probability of being good, by expectation-maximisation on pattern counts.

    Texts are good or of one family of faults. Estimated are the share of each kind and how often each rule faults a
    text of it; abstentions say nothing. ``PSEUDO`` votes, however many texts there are, stand for the first guesses."""
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    weight = np.array([counts[int(p)] for p in patterns], float)
    v = patterns[:, None] // 3 ** np.arange(RULES) % 3
    says_good, says_bad = (v == 1).astype(float), (v == 2).astype(float)
    own = np.array([[name in family for name in NAMES] for family in FAMILIES])
    guess = np.vstack([np.full(RULES, ALARM), np.where(own, HIT, STRAY)])
    low = np.vstack([np.full(RULES, LEAST_ALARM), np.where(own, LEAST_HIT, 1e-6)])
    high = np.vstack([np.full(RULES, 1 - 1e-6), np.where(own, 1 - 1e-6, MOST_STRAY)])
    fault, share = guess.copy(), np.append(0.85, np.full(len(own), 0.15 / len(own)))
    post = np.zeros((len(patterns), len(share)))
    for _ in range(steps):
        log = np.log(share) + says_bad @ np.log(fault).T + says_good @ np.log(1 - fault).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        w = (post * weight[:, None]).T
        share = np.clip(w.sum(1) / weight.sum(), 1e-9, 1)
        fault = np.clip((w @ says_bad + PSEUDO * guess) / (w @ (says_good + says_bad) + PSEUDO), low, high)
    return {int(p): float(x) for p, x in zip(patterns, post[:, 0], strict=True)}


def model(texts: DataFrame) -> dict[int, float]:
    """The posterior of each pattern of votes in a table of one column of texts."""
    common.ship(texts.sparkSession)
    rows = texts.mapInArrow(common.tidied(_patterns), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return fit({r.pattern: r.n for r in rows})


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, all counts, base_failed, good (the posterior) and kept, a row for each row of ``docs``."""
    spark = docs.sparkSession
    common.ship(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    found = common.written(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(common.tidied(_features), f"doc_id {kind}, {FEATURES}, pattern long"), "quality")
    rows = found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    good = fit({r.pattern: r.n for r in rows})
    table = F.broadcast(spark.createDataFrame(list(good.items()), "pattern long, good double"))  # 3 ** RULES rows at most
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return found.join(table, "pattern").select("doc_id", *COUNTS, failed.alias("base_failed"), "good", (~failed & (F.col("good") >= THRESHOLD)).alias("kept"))


def _keep(posterior: dict[int, float], at: int):
    kept = np.array(sorted(p for p, x in posterior.items() if x >= THRESHOLD), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, p = _batch(batch.column(at))
            yield batch.filter(pa.array(np.isin(p, kept) & ~_base_failed(f)))

    return run


def good_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns; no shuffle but of pattern counts."""
    posterior = model(docs.select(text_column))
    return docs.mapInArrow(common.tidied(_keep(posterior, docs.columns.index(text_column))), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")
