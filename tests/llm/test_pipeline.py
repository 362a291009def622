"""Queries of the subpackage against their SQL, and the pipeline against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import assert_same
from test_operators import WORD, brute_groups

import corpus_pipeline
from millrace import llm
from millrace.llm import common, mixing, quality

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, spark, sf, duck):
    assert_same(llm.queries()[name](spark, sf), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_runs(name, spark, sf):
    assert llm.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n // 9)) + "."
    base = [prose(90) for _ in range(60)]
    near = base[0].split(" ")
    near[40] = "changed"
    texts = [*base, base[1], base[1] + " ", " ".join(near), "too short", ("same same same same same " * 30).strip(), None]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), "test-stage")
        left[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == df.columns
    ids = {n: {x.doc_id for x in rows} for n, rows in left.items()}
    assert ids["quality"] == set(range(63))
    assert ids["exact dedup"] == set(range(63)) - {1, 60}  # 61 has a space more
    assert ids["near dedup"] == ids["exact dedup"] - {62}
    assert ids["mixing"] <= ids["near dedup"]
    assert all(x.round_trip for x in left["sentencepieces"])
    assert len(left["sentencepieces"]) == len(left["mixing"])


def brute_counts(text):
    """What the quality rules look at, in plain Python."""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = [any(grams[tuple(words[j : j + 5])] > 1 for j in range(max(0, k - 4), min(k, len(words) - 5) + 1)) for k in range(len(words))]
    chars = "".join(words)
    return {
        "n_words": len(words), "word_chars": len(chars), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": sum(repeated), "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_letters": sum(c.isalpha() if c.isascii() else True for c in text), "n_shout": sum(c in "!|" for c in text), "n_stops": sum(w[-1] in ".!?" for w in words),
        "n_distinct": len(set(words)), "n_stutter": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def test_run_against_brute_force(spark, sf):
    """Every stage's decisions over the whole small table, and every encoded row, by plain Python and the library."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts = [brute_counts(d.text or "") for d in docs]
    f = {c: np.array([x[c] for x in counts]) for c in quality.COUNTS}
    patterns = quality.pattern(quality.votes(f))
    good = quality.fit(dict(Counter(int(p) for p in patterns)))
    sound = [d for d, c, p in zip(docs, counts, patterns, strict=True) if c["n_words"] >= 10 and 100 * c["n_repeat_words"] <= 20 * c["n_words"] and good[int(p)] >= 0.5]
    classes = {}
    for d in sound:
        classes.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d.text), []).append(d)
    unique = [min(c, key=lambda d: (-len(d.text), d.doc_id)) for c in classes.values()]
    groups = {}
    for i, _, g in brute_groups([(d.doc_id, d.text) for d in unique], 5, 80):
        groups.setdefault(g, []).append(i)
    left = {min(g) for g in groups.values()}
    assert len(docs) > len(sound) > len(unique) > len(left) > 0
    rows = corpus_pipeline.run(spark, sf).collect()
    took = Counter(r.doc_id for r in rows)
    assert set(took) <= left and max(took.values()) <= 3
    mixed = [d for d in unique if d.doc_id in left]
    words, taken = Counter(), Counter()
    for d in mixed:
        n = len(WORD.findall(d.text))
        words[d.source] += n
        taken[d.source] += n * took[d.doc_id]
    most = max(len(WORD.findall(d.text)) for d in mixed)
    for source, target in mixing.targets(list(words.items())).items():
        assert abs(taken[source] - target) <= most
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {d.doc_id: d.text for d in mixed}
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.round_trip and (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
