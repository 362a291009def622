"""The training-data operators on small tables: nulls, empties, ties, repeats, clashing names, brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from millrace.llm import common, exact_dedup, language_id, line_dedup, mixing, ngram_join, pii, quality, sentencepieces, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts, source="s"):
    return [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]


ODD = ["", None, " ", "\n", "a", "a", "a b", "A  b", "a\nb\na", "é ñ ß", "x" * 5000, "word " * 3000, "\ttab\x0bv\x0cf\r", "😀 emoji 😀", "1.2.3.4 a@b.cd"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = rows_of(ODD) + [(None, "null id", None, None, 7), (4, "a", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- exact dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


def test_exact_dedup(spark, odd, empty):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_exact([(r.doc_id, r.text) for r in odd.collect()])
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert exact_dedup.exact_duplicates(empty).count() == 0
    stay = exact_dedup.without_duplicates(odd)
    assert stay.columns == odd.columns and stay.count() == len(kept)
    assert exact_dedup.without_duplicates(empty).count() == 0


def test_exact_dedup_chains_collisions(spark, monkeypatch):
    """All texts in one bucket with few hashes: only byte comparison can tell them apart."""
    texts = [f"t{i % 7} {'x' * (i % 3)}" for i in range(60)]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    entries = exact_dedup.index_entries(exact_dedup.placed(df.select("doc_id", "text")), 0, 1)
    from pyspark.sql import functions as F

    same = entries.withColumn("h", F.lit(5).cast("long"))
    monkeypatch.setattr(exact_dedup, "index_entries", lambda *a: same)
    got = exact_dedup.exact_duplicates(df).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_exact(list(enumerate(texts)))


def test_directory_doubles(spark):
    from pyspark.sql import functions as F

    entries = spark.range(20000).select(F.xxhash64("id").alias("h"), F.lit(100).cast("long").alias("n_bytes"))
    d = exact_dedup.directory(entries, capacity=50_000)
    assert d.sizes.sum() == 2_000_000 and d.sizes.max() <= 50_000
    hot = entries.union(spark.range(1000).select(F.lit(77).cast("long"), F.lit(100_000).cast("long")))
    assert exact_dedup.directory(hot, capacity=50_000).depth <= d.depth + 2  # one heavy hash doesn't double it
    cells = d.cells(7).to_pydict()
    assert cells["cell"] == list(range(2**d.depth)) and cells["bucket"] == sorted(cells["bucket"]) and max(cells["bucket"]) == len(d.sizes) - 1
    assert cells["owner"] == sorted(cells["owner"]) and set(cells["owner"]) == set(range(7))  # ranges of keys
    shallow = exact_dedup.directory(entries, capacity=100, deepest=5)
    assert shallow.depth == 5 and shallow.sizes.sum() == 2_000_000 and len(shallow.sizes) == 32


def test_exact_dedup_overfull_buckets(spark, monkeypatch):
    """A directory that may not double and tiny windows: owners still tell all classes apart."""
    monkeypatch.setattr(exact_dedup, "DEEPEST", 1)
    monkeypatch.setattr(exact_dedup, "BUCKET_BYTES", 10)
    monkeypatch.setattr(exact_dedup, "BUCKET_LEAST", 10)
    texts = [f"text {i % 83} {' ' * (i % 5)}" for i in range(400)]
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(8)
    got = exact_dedup.exact_duplicates(df).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_exact(list(enumerate(texts)))
    assert exact_dedup.without_duplicates(df).count() == 83


# --- line dedup


def brute_lines(rows, least):
    key = lambda s: s.strip(common.SPACES).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    seen = Counter()
    for t in {r: None for r in rows}:
        for k in {key(x) for x in (t[1] or "").split("\n")}:
            seen[k] += 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark, odd, empty):
    r = random.Random(1)
    pool = ["Alpha", " alpha ", "beta", "", "gamma x", "\tGAMMA x"] + [f"u{i}" for i in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for i in range(60)]
    df = spark.createDataFrame([(*x, "en", "s", 0) for x in rows], DOCS)
    for least in (2, 5, 10):
        got = line_dedup.without_common_lines(df, min_docs=least).collect()
        assert sorted([(g.doc_id, g.n_lines, g.n_dropped, g.text) for g in got], key=str) == brute_lines(rows, least)
    assert line_dedup.without_common_lines(empty).count() == 0
    out = line_dedup.without_common_lines(odd, min_docs=2).collect()
    want = brute_lines([(x.doc_id, x.text) for x in odd.collect()], 2)
    assert sorted([(g.doc_id, g.n_lines, g.n_dropped, g.text) for g in out], key=str) == want


# --- n-gram join


def brute_groups(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        g = find(i)
        ids[g] = min([x for x in (ids.get(g), d) if x is not None], default=None)
    return sorted([(d, len(sets[i]), ids[find(i)]) for i, (d, _) in enumerate(rows)], key=str)


def near_copies(n, seed, edits=2, vocabulary=200):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    rows = []
    base = [word() for _ in range(120)]
    for i in range(n):
        if r.random() < 0.15:
            base = [word() for _ in range(r.choice([1, 2, 5, 40, 120, 200]))]
        t = list(base)
        for _ in range(r.randint(0, edits)):
            t[r.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "width", "percent", "edits"), [(1, 3, 90, 3), (2, 5, 80, 6), (3, 3, 90, 8), (4, 2, 70, 12)])
def test_ngram_join(spark, seed, width, percent, edits):
    rows = near_copies(150, seed, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in ngram_join.linked_groups(df, width, percent).collect()], key=str)
    assert got == brute_groups(rows, width, percent)


def test_ngram_join_hot_shingles(spark, monkeypatch):
    """A passage in every document, a tiny table of hot shingles, blocks of crowded ones: the same links."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, f"{t} {passage}" if i % 2 else t) for i, t in near_copies(120, 9, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in ngram_join.linked_groups(df, 3, 90).collect()], key=str)
    assert got == brute_groups(rows, 3, 90)


@pytest.mark.parametrize(("width", "percent", "edits"), [(3, 90, 6), (5, 80, 8)])
def test_ngram_join_family(spark, monkeypatch, width, percent, edits):
    """A family of 400 copies whose similarities lie around the threshold, dealt in blocks, and another beside it."""
    monkeypatch.setattr(ngram_join, "LEAST_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r = random.Random(width)
    bases = [[f"w{r.randrange(5000)}" for _ in range(150)] for _ in range(2)]
    rows = []
    for i in range(400):
        t = list(bases[i % 7 == 0])
        for _ in range(r.randint(1, edits)):
            t[r.randrange(len(t))] = f"w{r.randrange(5000)}" if r.random() < 0.5 else f"w{r.randrange(3)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in ngram_join.linked_groups(df, width, percent).collect()], key=str)
    assert got == brute_groups(rows, width, percent)
    assert len({g for *_, g in got}) > 5


def test_ngram_join_odd(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted([tuple(r) for r in ngram_join.linked_groups(odd, 3, 90).collect()], key=str)
    assert got == brute_groups(rows, 3, 90)
    assert ngram_join.linked_groups(empty).count() == 0
    assert ngram_join.without_linked(empty).count() == 0


def test_without_linked_keeps_a_row_a_group(spark, empty):
    """Null ids, ids that several texts share and equal rows: one row a group, by the smallest id."""
    base = [t for _, t in near_copies(40, 5, 2)]
    long = [f"{' '.join(f'u{k}x{j}' for j in range(90))}" for k in range(6)]
    close = lambda t: t + " end"
    texts = [(None, long[0]), (None, close(long[0])), (None, close(long[0])), (1, long[1]), (5, close(long[1])), (5, long[2]), (5, long[2]), (None, close(long[2])), (7, long[3]), (None, long[4]), (None, ""), (8, "")]
    rows = texts + [(100 + i if i % 3 else None, t) for i, t in enumerate(base)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = ngram_join.without_linked(df, 3, 80)
    assert got.columns == df.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert Counter(left) <= Counter(rows)
    # Groups by brute force over places, as ids don't tell rows apart.
    place = {i: rows[i] for i in range(len(rows))}
    groups = {}
    for i, n, g in brute_groups([(i, t) for i, (_, t) in place.items()], 3, 80):
        groups.setdefault(g if n else ("empty", i), []).append(place[i])
    assert len(left) == len(groups)
    for members in groups.values():
        least = min(members, key=lambda m: (m[0] is None, m[0] or 0))[0]
        assert sum(m in left for m in set(members)) == 1 and any(m in left for m in members if m[0] == least)
    assert ngram_join.without_linked(empty).columns == empty.columns


def test_prefixes_are_complete():
    """Two similar sets share min(l, l') prefix shingles at least, whatever l each picks."""
    import numpy as np

    r = np.random.default_rng(3)
    hot = np.sort(r.integers(0, 1 << 63, 50, dtype=np.uint64))
    counts = r.integers(2, 100, 50)
    for _ in range(200):
        n = int(r.integers(1, 60))
        a = np.unique(np.concatenate([r.choice(hot, n // 2), r.integers(0, 1 << 63, n - n // 2, dtype=np.uint64)]))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.08], r.integers(0, 1 << 63, 1, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            la, pa, _ = ngram_join.choose(a, hot, counts, 80)
            lb, pb, _ = ngram_join.choose(b, hot, counts, 80)
            assert len(np.intersect1d(pa, pb)) >= min(la, lb)


# --- mixing


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 187.5, "b": 75.0, "c": 37.5}
    capped = mixing.targets([("a", 10), ("b", 500), (None, 500)])
    assert capped["a"] == 30 and sum(capped.values()) == pytest.approx(1010)


def test_mixing(spark, odd, empty):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), "en", r.choice(["a", "b", "c", "d", None]), 0) for i in range(800)]
    df = spark.createDataFrame(rows, DOCS)
    table = df.select("doc_id", "source", mixing.word_count(df.text).alias("size"))
    by, params = mixing.balance(table)
    got = mixing.with_copies(table, params).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.with_copies(table, mixing.balance(table)[1]).collect()))
    taken = Counter()
    for x in got:
        assert 0 <= x.copies <= 3
        taken[x.source] += x.copies * x["size"]
    for s, (_, target) in by.items():
        assert abs(taken[s] - target) <= 60
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


# --- texts to numbers


def test_token_counts(spark, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = f"file://{tmp_path}/cache"
    t = Tokenizer.from_file(path)
    texts = odd.union(spark.createDataFrame([(99, "a <|endoftext|> b", None, None, 0)], DOCS))
    for _ in range(2):  # the second time every count comes from the cache
        got = token_counts.token_counts(texts, path, cache).collect()
        want = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in texts.collect()]
        assert sorted(map(str, [(g.doc_id, g.n_bytes, g.n_tokens) for g in got])) == sorted(map(str, want))
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({r.text or "" for r in texts.collect()})
    assert token_counts.token_counts(empty, path, cache).count() == 0


def test_sentencepieces(spark, odd, empty):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    p = SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(r.choice("abcdeiou thsn  \n.1éß日😀") for _ in range(r.randint(1, 80))) for _ in range(500)]
    own = sentencepieces.Pieces(path)
    got = own.encode(texts)
    assert [list(g) for g in got] == p.encode(texts)
    assert [own.decode(g) for g in got] == texts
    ids = sentencepieces.encoded(odd, path)
    back = {str((x.doc_id, x.text)) for x in sentencepieces.decoded(ids, path).collect()}
    assert back == {str((x.doc_id, x.text or "")) for x in odd.collect()}
    assert sentencepieces.encoded(empty, path).count() == 0


def test_sentencepieces_long_parts(monkeypatch):
    """Of parts without spaces only cuts that are still too long are merged alone."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    r = random.Random(7)
    texts = ["".join(r.choice("日本語😀abé1Ж") for _ in range(n)) for n in (150, 201, 900, 5000)] + ["word " * 50 + "日x😀" * 200 + " end", "x" * 3000, "a" * 250 + "日" + "b" * 250, "a\0b" * 100]
    alone: list[str] = []
    merge = sentencepieces.Pieces._alone
    monkeypatch.setattr(sentencepieces.Pieces, "_alone", lambda self, part: alone.append(part) or merge(self, part))
    got = sentencepieces.Pieces(path).encode(texts)
    assert [list(g) for g in got] == SentencePieceProcessor(model_file=path).encode(texts)
    assert alone and all(len(p) > sentencepieces.LONG or "\0" in p for p in alone)


def test_quality_counts(spark, odd, empty):
    got = {str(r.doc_id) + str(r.word_chars): r for r in quality.quality(odd).collect()}
    for x in odd.collect():
        t = x.text or ""
        w = WORD.findall(t)
        g = got[str(x.doc_id) + str(sum(map(len, w)))]
        lines, seen, dups = t.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        mark = [False] * len(w)
        for k in range(len(w) - 4):
            if grams[tuple(w[k : k + 5])] > 1:
                mark[k : k + 5] = [True] * 5
        assert (g.n_words, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), len(re.findall(r"[#*$%&|<>]", t)), dups, sum(mark))
        assert g.base_failed == (len(w) < 10 or 100 * sum(mark) > 20 * len(w))
        assert not (g.base_failed and g.kept)
    assert quality.quality(empty).count() == 0
    assert quality.good_documents(odd).columns == odd.columns and quality.good_documents(empty).count() == 0


def test_quality_model_finds_faults():
    """Families that never come together are both found, by rules that agree; rules that are often alone are outvoted."""
    import numpy as np

    def pattern(*bad):
        return int(quality.pattern(np.array([[2 if n in bad else 1 for n in quality.NAMES]]))[0])

    good, a, b = pattern(), pattern("symbols", "letters"), pattern("distinct", "stutter")
    counts = {good: 9000, a: 300, b: 250}
    for alone, n in (("upper", 10), ("upper", 400), ("letters", 40), ("shout", 15000), ("stutter", 900)):
        post = quality.fit(counts | {pattern(alone): n})
        assert [post[p] >= 0.5 for p in (good, a, b, pattern(alone))] == [True, False, False, True], alone
    # The noisy rule's vote beside two that agree changes nothing, nor does its approval.
    post = quality.fit(counts | {pattern("upper"): 3000, pattern("upper", "symbols", "letters"): 60})
    assert post[pattern("upper", "symbols", "letters")] < 0.5 <= post[pattern("upper")]
    assert quality.fit({}) == {}


@pytest.mark.parametrize("size", [10, 1000, 100000])
def test_quality_model_at_any_size(size):
    """The same shares of patterns give the same verdicts, however many texts there are."""
    import numpy as np

    def pattern(*bad):
        return int(quality.pattern(np.array([[2 if n in bad else 1 for n in quality.NAMES]]))[0])

    post = quality.fit({pattern(): 95 * size, pattern("symbols", "letters"): 3 * size, pattern("upper"): 2 * size})
    assert [x >= 0.5 for x in (post[pattern()], post[pattern("symbols", "letters")], post[pattern("upper")])] == [True, False, True]


def test_quality_against_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality(docs).filter("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(bad) <= 0.05 * len(bad)


# --- models


def test_language_id(spark, sf, odd, empty):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    held = common.crc_mod("doc_id", 4) == 2
    net = language_id.train(docs.filter(~held), per_label=120)
    got = language_id.identify(docs.select("doc_id", "text"), net, held).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    found = {str(r.doc_id): r for r in language_id.identify(odd, net, held).collect()}
    assert found["0"].lang_pred == found["1"].lang_pred == "und" and found["0"].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.identify(empty, net, held).count() == 0
    nothing = language_id.train(empty)
    assert nothing is None
    assert {r.lang_pred for r in language_id.identify(odd, nothing, held).collect()} == {"und"}


def test_toxicity(spark, sf, odd, empty):
    base = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = common.crc_mod("doc_id", 5) == 0
    model = toxicity.corpus_model(docs.select("text"))
    for word, want in {"1d10t": "idiot", "m0r0n": "moron", "stuuuupid": "stupid", "i.d.i.o.t": "idiot", "l0s3r": "loser", "disgu$ting": "disgusting"}.items():
        assert toxicity.decode(word, model) == want
    plain = "In the ththis onand er that the reanin of and the tionand this in hethe"
    tests = [(900001, f"{plain} 1d10t {plain} m0r0n st00pid worthl3ss"), (900002, plain), (900003, f"{plain} i d i o t and l o s e r {plain} scum")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(tests, "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity.toxicity(more, labels.filter(~held), held).collect()}
    assert [got[i].predicted for i in (900001, 900002, 900003)] == [1, 0, 1]
    truth = labels.filter(held).collect()
    clean = [got[r.doc_id].predicted for r in truth if r.toxic == 0]
    assert sum(clean) <= 0.03 * len(clean)
    scored = toxicity.toxicity(odd, labels, held).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.toxicity(empty, labels.limit(0), held).count() == 0


def test_toxicity_reads_long_dense_and_spaced(spark, sf):
    """Words stretched, dotted, spaced or disguised beyond any length or share of letters are read."""
    import numpy as np

    from millrace.llm import vec

    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    reader = toxicity.Reader(toxicity.corpus_model(docs.select("text")))
    cases = {
        "5h17": "shit", "$h!7": "shit", "1d1075": "idiot", "st" + "u" * 60 + "pid": "stupid", "m" + "o" * 40 + "r.o.n": "moron", "x.y.z.x.y.z.x.y.z.x.y.z.m0r0n!": "moron",
        "i d i o t.": "idiot", "i d i o t!": "idiot", '"i d i o t"': "idiot", "a s t u p i d i d i o t": "idiot", "1 d i 0 t": "idiot", "w o r t h l e s s m o r o n s t u p i d l o s e r": "loser",
    }
    for text, want in cases.items():
        data = np.frombuffer(text.encode(), np.uint8)
        assert vec.text_hash(want) in reader.words(data, np.array([0, len(data)]))[1].tolist(), text
    assert toxicity.decode(" ".join("idiot" * 20000), reader.model).count("diot") > 10000  # linear in the length


def brute_pii(t):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda m: re.sub(r"\D", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m.group())]


def test_pii(spark, odd, empty):
    r = random.Random(8)
    alphabet = ["a", "Z", "0", "1", "4", "255", "256", ".", "@", "-", " ", "+", "(", ")", "%", "_", "é", "😀", "\n", "4111111111111111", "a@b.cd", "1.2.3.4", "+1 (255) 555-8013"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(rows_of(texts + ODD), DOCS)
    for g in pii.personal_data(df).collect():
        t = (texts + ODD)[g.doc_id] or ""
        base = [f"{k}:{s.start}:{s.end}" for k in pii.KINDS for s in g["base_" + k]]
        assert base == brute_pii(t), t
        spans = [(s.start, s.end) for k in pii.KINDS for s in g["base_" + k]]
        added = [(s.start, s.end) for s in g.added]
        assert all(e <= a or b <= s for s, e in added for a, b in spans)
        assert all(e <= a or b <= s for i, (s, e) in enumerate(added) for a, b in added[:i])
    found = spark.createDataFrame([(1, "mail joe (at) site dot com now"), (2, "call (255) 555-8013 please"), (3, "see it at home. Then go 12.5.2001"), (4, "78[.]241[.]210[.]149")], "doc_id long, text string")
    got = {g.doc_id: [s.kind for s in g.added] for g in pii.personal_data(found).collect()}
    assert got == {1: ["email"], 2: ["phone"], 3: [], 4: ["ip"]}
    assert pii.personal_data(empty).count() == 0 and pii.personal_data(odd).count() == odd.count()


def brute_proposed(t):
    """Each place a card's, a phone's or an IP address's form can stand, whatever overlaps it."""
    card, phone = (re.compile(pii.RANGES[k]) for k in ("card", "phone"))
    ip = re.compile(pii.GENERATORS["ip"])
    out = set()
    for a in range(len(t)):
        if m := ip.match(t, a):
            out.add(("ip", a, m.end()))
        if t[a] not in "(0123456789" or (t[a].isdigit() and a and t[a - 1].isdigit()):
            continue
        for b in range(a + 1, len(t) + 1):
            if b < len(t) and t[b].isdigit():
                continue
            if card.match(t[a:b]):
                out.add(("card", a, b))
            if phone.match(t[a:b]) and not (a and re.match("[0-9A-Za-z+]", t[a - 1])) and not (a and t[a - 1] == "(" and phone.match(t[a - 1 : b])):
                out.add(("phone", a, b))
    base = [x.split(":") for x in brute_pii(t)]
    return {x for x in out if all(x[2] <= int(a) or int(b) <= x[1] for _, a, b in base)}


def test_pii_proposes_every_span(spark):
    """Numbers beside one another or beside a base span, and e-mails before further labels."""
    r = random.Random(12)
    alphabet = ["555-123-4567", "2024-01-02", "192.168.0.1", "3782 822463 10005", "(201) ", "00", "0", "12", "4", " ", " ", "-", ".", "/", "(", ")", "x", "+1 ", "é", "[.]", "_"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_candidates(pii.with_base(df)).collect()
    for g in rows:
        assert {(c.kind, c.start, c.end) for c in g.candidates if c.kind != "email"} == brute_proposed(g.text), g.text
    cases = {
        "555-123-4567 555-987-6543": ["555-123-4567", "555-987-6543"], "2024-01-02 555-123-4567": ["555-123-4567"], "192.168.0.1 555-123-4567": ["555-123-4567"],
        "3782 822463 10005 555-123-4567": ["3782 822463 10005", "555-123-4567"], "3782 822463 10005 12": ["3782 822463 10005"], "write joe @ site.com. Then go": ["joe @ site.com"],
    }
    found = {g.doc_id: sorted(list(cases)[g.doc_id][s.start : s.end] for s in g.added) for g in pii.personal_data(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_clashing_names(spark):
    """Input columns named like an operator's own don't disturb it."""
    rows = [(1, "one two three four five six seven eight nine ten", "en", "s", 1, 5, "x", 0.5, 3)]
    df = spark.createDataFrame(rows, DOCS + ", size long, digest string, score double, n_words int")
    import public_tokenizers

    assert token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), common.scratch_path(spark, "cache")).count() == 1
    assert exact_dedup.exact_duplicates(df).count() == line_dedup.without_common_lines(df).count() == ngram_join.linked_groups(df).count() == 1
    assert quality.quality(df).count() == pii.personal_data(df).count() == 1
    assert mixing.mixed_documents(df).columns == quality.good_documents(df).columns == exact_dedup.without_duplicates(df).columns == df.columns


def test_names_of_the_index(spark):
    """Columns named like those of the dedup operators, and names that need quoting, come back unchanged."""
    names = [n for n, _ in exact_dedup.ENTRY] + ["cell", "bucket", "owner", "__length", "c0", "c1", "row", "runs", "d1", "d2", "gone", "__runs", "n_lines", "n_dropped", "a.b", "pos", "line", "key"]
    texts = ["same text\nx", "same  text\nx", "other", None]
    rows = [(i, t, "en", "s", i, *[100 * i + k for k in range(len(names))]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS + "".join(f", `{n}` int" for n in names))
    kept = exact_dedup.without_duplicates(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[1], rows[2], rows[3]]
    assert exact_dedup.exact_duplicates(df).count() == 4
    lines = line_dedup.without_common_lines(df, min_docs=2)
    got = {r.doc_id: r.asDict() for r in lines.collect()}
    assert [got[i]["n_dropped"] for i in range(4)] == [1, 1, 0, 0] and [got[i]["n_lines"] for i in range(4)] == [2, 2, 1, 1]
    for r in rows:
        want = dict(zip([n + "_before" if n in ("n_lines", "n_dropped") else n for n in names], r[5:], strict=True))
        assert {n: got[r[0]][n] for n in want} == want


def test_line_dedup_counts_documents(spark):
    """A document is an id with a text: repeated rows are one, null ids and several texts of an id are told apart."""
    import duckdb

    rows = [(1, f"common\nown {i}") for i in range(5)] + [(None, f"common\nnull {i}") for i in range(4)] + [(2, "common\ntwice")] * 6 + [(3, "common")]
    rows += [(i, "rare\n" + "x" * i) for i in range(4, 13)] + [(4, "rare\nxxxx")] * 9
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)
    got = line_dedup.without_common_lines(df).collect()
    assert sorted([(g.doc_id, g.n_lines, g.n_dropped, g.text) for g in got], key=str) == brute_lines(rows, 10)
    assert sum(g.n_dropped for g in got) == 16
    c = duckdb.connect()
    c.register("documents", df.select("doc_id", "text").toArrow())
    assert sorted(c.execute(line_dedup.SQL).fetchall(), key=str) == sorted([(g.doc_id, g.n_lines, g.n_dropped, hashlib.sha256(g.text.encode()).hexdigest()) for g in got], key=str)


def test_pii_recall_in_documents(spark, sf):
    """Made-up personal data within documents that have none: forms the patterns miss are found, nothing else is."""
    r = random.Random(99)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def luhn(start, k):
        body = start + digits(k - 1 - len(start))
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def groups(s, sep, *sizes):
        return sep.join(s[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))

    octets = lambda: [str(r.randint(1, 254)) for _ in range(4)]
    forms = {
        "email": [lambda: "anna.berg[at]example.org", lambda: "jo (at) mail-host (dot) net", lambda: "garcia at correo dot com"],
        "ip": [lambda: "[.]".join(octets()), lambda: "(.)".join(octets())],
        "card": [lambda: groups(luhn("4", 16), ".", 4, 4, 4, 4), lambda: groups(luhn("37", 15), " ", 4, 6, 5)],
        "phone": [lambda: f"({r.randint(201, 989)}) {r.randint(200, 999)}-{digits(4)}", lambda: f"{r.randint(201, 989)}-{r.randint(200, 999)}-{digits(4)}"],
        None: [lambda: "2021-03-04", lambda: f"978-3-16-{digits(6)}-0", lambda: "1,234,567.89", lambda: digits(8), lambda: "look at noon. Then"],
    }
    plain = [x.text for x in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").collect() if x.text and " " in x.text and len(x.text) < 3000 and not re.search("[0-9@]", x.text)]
    rows, planted = [(i, t) for i, t in enumerate(plain[:200])], {}
    for kind, makers in forms.items():
        for make in makers * 12:
            words, span = r.choice(plain).split(" "), make()
            at = r.randrange(1, len(words))
            left = " ".join(words[:at]) + " "
            planted[len(rows)] = kind, len(left), len(left) + len(span)
            rows.append((len(rows), left + span + r.choice([" ", ", ", ". "]) + " ".join(words[at:])))
    found, wrong, wanted = Counter(), 0, Counter(k for k, *_ in planted.values())
    for g in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        kind, *place = planted.get(g.doc_id, (None, 0, 0))
        for s in g.added:
            if kind and (s.kind, s.start, s.end) == (kind, *place):
                found[kind] += 1
            else:
                wrong += 1
    assert wrong <= 0.02 * len(planted) and all(found[k] >= 0.9 * n for k, n in wanted.items() if k)


def test_pii_places_of_many_matches(spark):
    """More matches than are summed together: each place is right."""
    text = " ".join(f"é{i}@x.de" if i % 2 else f"10.0.{i % 256}.1" for i in range(1200))
    g = pii.with_base(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = {"ip": [m.span() for m in re.finditer(r"10\.0\.[0-9]+\.1", text)]}
    want["email"] = [m.span(1) for m in re.finditer(r"é([0-9]+@x\.de)", text)]
    for kind, spans in want.items():
        assert [(s.start, s.end) for s in g["base_" + kind]] == spans and len(spans) > pii.CHUNK


def test_language_id_against_plain_convolution(spark, odd):
    """Table lookups give what convolving embeddings, pooling and a softmax written out give."""
    import numpy as np

    net = language_id.Network(["aa", "bb", "cc"], seed=7)
    net.bias += np.linspace(-0.2, 0.2, len(net.bias), dtype=np.float32)
    r = random.Random(3)
    texts = [x.text for x in odd.collect()] + ["".join(r.choice("abc é ñ1.\n") for _ in range(r.choice([1, 3, 255, 256, 257, 1000]))) for _ in range(30)]

    def plain(text):
        data = (text or "").encode()
        if not re.search(r"[^\W\d_]", text or ""):
            return "und", 0.0
        total = np.zeros(3)
        for i in range(0, len(data), language_id.LENGTH):
            classes = [int(language_id.CLASS[b]) for b in data[i : i + language_id.LENGTH]]
            letters = sum(bool(language_id.LETTER[c]) for c in classes)
            classes += [language_id.PAD] * (language_id.LENGTH - len(classes))
            pooled = []
            for w, f in zip(language_id.WIDTHS, net.filters, strict=True):
                pooled.append(np.max([np.concatenate(net.embedding[classes[k : k + w]]) @ f for k in range(len(classes) - w + 1)], axis=0))
            z = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.dense + net.base
            p = np.exp(z - z.max())
            total += p / p.sum() * (letters + 1e-6)
        total /= total.sum()
        return net.labels[int(total.argmax())], float(total.max())

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(df, net, common.crc_mod("doc_id", 4) == 2).collect()}
    for i, t in enumerate(texts):
        label, score = plain(t)
        assert got[i][0] == label and got[i][1] == pytest.approx(score, abs=1e-4)


def test_toxicity_scores_against_plain_words():
    """A score is the logistic of the weights of the words a text has, each once, whatever block it is read in."""
    import numpy as np

    from millrace.llm import vec

    weights = {"foo": 1.5, "bär": -0.7, "it's": 2.0, "stupid": 3.0}
    hashes = {vec.text_hash(w): v for w, v in weights.items()}
    words = np.sort(np.array(list(hashes), np.uint64))
    c = toxicity.Classifier(words, np.array([hashes[int(w)] for w in words]), -1.0)
    reader = toxicity.Reader(toxicity.CharacterModel(np.ones(toxicity.SYMBOLS**3)))
    r = random.Random(5)
    pool = ["foo", "FOO,", "(foo)", "foofoo", "bär", "Bär.", "it's", "its", "other", "\n", "-", "é"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(200)]

    def plain(text):
        cores = {re.sub(r"^[^a-zA-Z\x80-\U0010ffff]+|[^a-zA-Z\x80-\U0010ffff]+$", "", t).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)) for t in text.split()}
        return 1 / (1 + math.exp(1.0 - sum(weights.get(w, 0.0) for w in cores)))

    data = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, data)])
    scores = c.scores(*reader.words(np.frombuffer(b"".join(data), np.uint8), at), len(texts))
    assert scores == pytest.approx([plain(t) for t in texts])


def test_mixing_solves_the_balance(spark):
    """The multipliers are the dual's optimum: words meet targets, mean log-lengths stay; copies follow rates and hashes alone."""
    r = random.Random(12)
    rows = [(i, r.choice(["a", "b", "c", "d"]), int(r.lognormvariate(4, 1))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    by, params = mixing.balance(df)
    for source, a, b, centre, _, threshold, capped in params:
        sizes = [n for _, s, n in rows if s == source]
        if capped:
            assert by[source][1] == pytest.approx(3 * sum(sizes))
            continue
        rates = [3 / (1 + 2 * math.exp(-(a + b * (math.log1p(n) - centre)))) for n in sizes]
        assert sum(n * x for n, x in zip(sizes, rates, strict=True)) == pytest.approx(by[source][1], rel=1e-4)
        assert sum(n * x * (math.log1p(n) - centre) for n, x in zip(sizes, rates, strict=True)) == pytest.approx(0, abs=1e-3 * sum(sizes))
        assert 0 <= threshold <= 4
    shuffled = df.repartition(7)
    assert params == mixing.balance(shuffled)[1]  # whatever the order of sums
    copies = {x.doc_id: x.copies for x in mixing.with_copies(df, params).collect()}
    assert copies == {x.doc_id: x.copies for x in mixing.with_copies(shuffled, params).collect()}
