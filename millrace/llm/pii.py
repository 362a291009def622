"""Personal data in texts, with DataFrame functions only: base patterns, plus candidates judged by boosted trees.

Base spans are the leftmost non-overlapping matches of one pattern a kind that pass the kind's check
(IP parts, Luhn, digit counts). Generators with high recall then propose further, overlapping spans
of obfuscated or unusual form: e-mail and IP forms from every start, by lookahead, e-mails with each
number of labels, and for cards and phones every range of the digit groups of a run of them, so that
a number beside another or beside a base span is proposed by itself. Gradient-boosted trees score
each by its format and context; scores are calibrated, each kind has its threshold, and overlapping
accepted spans are taken likeliest first, the longer first if equally likely. Base spans always stay
and push out what overlaps them.

Spark gives matches without places. A text split by the same pattern gives what stands between the
matches, so places are running sums of lengths in code points. The patterns here are the contract's,
written so that no start is tried inside a run it can't match from, as Java's matcher would.

The trees are fitted in numpy on a bounded set (``EXAMPLES`` texts) made from templates, with
features from the very expressions used on documents, and become CASE expressions.

Null texts count as empty. Rows stay rows, repeated ones too; a null doc_id is carried; an empty
table gives an empty result. Places are summed in chunks of matches and then over the chunks, so that texts with
very many matches don't copy all sums for each."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 6000
TREES = 80
PRECISION = 0.9

#: The contract's patterns, with possessive repeats and guards in place of starts that must fail.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOCAL = r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:[(\[{<]\x20?(?i:at)\x20?[)\]}>]|(?<=\x20)at(?=\x20)|@)\x20?[A-Za-z0-9-]{1,63}+"
_LABEL = r"(?:\x20?(?:\.|[(\[{<]\x20?(?i:dot)\x20?[)\]}>]|(?<=\x20)dot(?=\x20))\x20?[A-Za-z0-9-]{1,63}+)"
LABELS = 5
#: Looked for from every start.
GENERATORS = {
    "email": rf"(?<![A-Za-z0-9._%+-]){_LOCAL}{_LABEL}{{1,{LABELS}}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?[\[({]?(?:\.|dot)[\])}]?\x20?[0-9]{1,3}+){3}(?![0-9]|\.[0-9])",
}
#: Digit groups in a row; each range of them that is whole a card's or a phone's form is proposed.
RUN = r"\(?[0-9]++(?:[\x20().\-/_]++[0-9]++)*+"
RANGES = {
    "card": r"^[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}$",
    "phone": r"^(?:00[1-9]|\(?0?[1-9])[0-9\x20().\-/]{5,18}[0-9]$",
}
#: What these two forms imply: no longer range or one of more groups matches, nor a run that is shorter.
WIDEST, MOST_GROUPS, SHORTEST = 55, 19, 7
#: What a text must have for a pattern to match at all; cheap scans that spare most texts the patterns.
_DIGIT = r"[0-9]"
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(_DIGIT),
    "phone": lambda t: t.contains("+"),
}
GENERATOR_GATES = {
    "email": lambda t: t.contains("@") | t.rlike(r"[(\[{<]\x20?(?i:at)") | (t.contains(" at ") & (t.contains(" dot ") | t.rlike(r"\x20at\x20[A-Za-z0-9-]++\x20?(?:\.|[(\[{<])\x20?[A-Za-z0-9]"))),
    "ip": lambda t: t.rlike(_DIGIT),
}
CONTEXT = r"(?i)(mail|contact|phone|tel|call|fax|mobil|card|visa|iban|credit|pay|addr|host|server|reach|write|kontakt|ruf|correo|contacto|courriel)"
FEATURES = ["kind", "digits", "letters", "length", "others", "luhn", "brackets", "sign", "before", "after", "context", "groups", "widest", "sentence", "spaces", "trunk"]


#: Matches whose places are summed together.
CHUNK = 256
_NONE = "cast(array() as array<struct<start:int,end:int,match:string,left:string,right:string>>)"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(parts: Column) -> Column:
    """The place of each of an array of structs (gap, n): after the gap before it and all gaps and lengths before that."""

    def chunk(c: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)), zero, lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out")))

    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(parts) / CHUNK).cast("int") - 1, F.lit(0))), chunk)
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out"))
    shifted = lambda acc, x: F.array(F.transform(x["out"], lambda y: y + acc["at"]))
    return F.flatten(F.aggregate(chunks, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], shifted(acc, x)).alias("out")))["out"])


def _spans(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start, end, match, left, right>>: places in code points, and the text beside each match."""

    def parts(z: Column) -> Column:
        gap = lambda i: F.coalesce(F.get(z["p"], i), F.lit(""))
        return F.transform(z["m"], lambda m, i: F.struct(m.alias("m"), F.length(m).alias("n"), F.length(gap(i)).alias("gap"), F.right(gap(i), F.lit(24)).alias("left"), F.substring(gap(i + 1), 1, 2).alias("right")))

    def placed(p: Column, starts: Column) -> Column:
        return F.transform(p, lambda x, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + x["n"]).alias("end"), x["m"].alias("match"), x["left"].alias("left"), x["right"].alias("right")))

    # Bound, so that each pattern runs over a text just twice.
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    found = _bound(both, lambda z: _bound(parts(z), lambda p: _bound(_starts(p), lambda s: placed(p, s))))
    return F.when(gate, found).otherwise(F.expr(_NONE))


def _beside(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The 24 code points before a place and the two after one."""
    return F.substring(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24))), F.substring(text, end + 1, F.lit(2))


def _every_start(text: Column, pattern: str, gate: Column) -> Column:
    """As _spans, but of the match at every start, overlapping ones too: a lookahead consumes nothing."""

    def parts(z: Column) -> Column:
        # A text is not split at its very start, so a match there has no part before it.
        first = F.size(z["p"]) - F.size(z["m"]) - 1
        return F.transform(z["m"], lambda m, i: F.struct(m.alias("m"), F.lit(0).alias("n"), F.when(i + first < 0, 0).otherwise(F.length(F.get(z["p"], i + first))).alias("gap")))

    def placed(p: Column, starts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = F.get(starts, i)
            left, right = _beside(text, start, start + F.length(x["m"]))
            return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("match"), left.alias("left"), right.alias("right"))

        return F.transform(p, one)

    both = F.struct(F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1)).alias("m"), F.split(text, f"(?={pattern})", -1).alias("p"))
    found = _bound(both, lambda z: _bound(parts(z), lambda p: _bound(_starts(p), lambda s: placed(p, s))))
    return F.when(gate, found).otherwise(F.expr(_NONE))


def _emails(text: Column) -> Column:
    """From every start, the span with each number of labels."""

    def prefixes(s: Column) -> Column:
        cut = F.array(*[F.regexp_extract(s["match"], f"^{_LOCAL}{_LABEL}{{{n}}}+", 0) for n in range(1, LABELS + 1)])

        def span(m: Column) -> Column:
            right = F.substring(F.concat(F.substring(s["match"], F.length(m) + 1, F.lit(2)), s["right"]), 1, 2)
            return F.struct(s["start"].alias("start"), (s["start"] + F.length(m)).alias("end"), m.alias("match"), s["left"].alias("left"), right.alias("right"))

        return F.transform(F.filter(F.array_distinct(cut), lambda m: m != ""), span)

    return F.flatten(F.transform(_every_start(text, GENERATORS["email"], GENERATOR_GATES["email"](text)), prefixes))


def _runs(text: Column) -> Column:
    """array<struct<start, end, match, left, right, paren>>: the ranges of digit groups that may be a card or a phone; with ``paren``, a bracket stands before."""
    runs = F.filter(_spans(text, RUN, text.rlike(_DIGIT)), lambda r: F.length(r["match"]) >= SHORTEST)

    def ranges(run: Column, groups: Column) -> Column:
        def start(g: Column, i: Column) -> Column:
            # What may be looked at from this start on: 24 before it, the widest range, two after.
            lead = F.least(g["start"], F.lit(24))
            window = F.substring(run["match"], g["start"] - lead + 1, lead + WIDEST + 2)

            def span(w: Column, h: Column) -> Column:
                n = h["end"] - g["start"]
                left = F.right(F.concat(run["left"], F.substring(w, F.lit(1), lead)), F.lit(24))
                right = F.substring(F.concat(F.substring(w, lead + n + 1, F.lit(2)), run["right"]), 1, 2)
                return F.struct((run["start"] + g["start"]).alias("start"), (run["start"] + h["end"]).alias("end"), F.substring(w, lead + 1, n).alias("match"), left.alias("left"), right.alias("right"))

            near = F.filter(F.slice(groups, i + 1, F.lit(MOST_GROUPS)), lambda h: (h["end"] - g["start"]).between(SHORTEST - 1, WIDEST))
            return F.element_at(F.transform(F.array(window), lambda w: F.transform(near, lambda h: span(w, h))), 1)

        return F.flatten(F.transform(groups, start))

    bound = F.transform(runs, lambda r: F.struct(r.alias("r"), _spans(r["match"], "[0-9]+", F.lit(True)).alias("g")))
    return F.flatten(F.transform(bound, lambda z: ranges(z["r"], z["g"])))


def _bracketed(s: Column) -> Column:
    """The span with the bracket before it, where that has a phone's form."""
    wide = F.concat(F.lit("("), s["match"])
    more = F.struct((s["start"] - 1).alias("start"), s["end"].alias("end"), wide.alias("match"), F.substring(s["left"], F.lit(1), F.length(s["left"]) - 1).alias("left"), s["right"].alias("right"))
    return F.when(s["left"].endswith("(") & wide.rlike(RANGES["phone"]), more).otherwise(s)


def _generated(kind: str) -> Column:
    if kind == "email":
        return _emails(F.col("text"))
    if kind == "ip":
        return _every_start(F.col("text"), GENERATORS["ip"], GENERATOR_GATES["ip"](F.col("text")))
    if kind == "card":
        return F.filter("ranges", lambda s: s["match"].rlike(RANGES["card"]))
    return F.filter(F.transform("ranges", _bracketed), lambda s: s["match"].rlike(RANGES["phone"]) & ~s["left"].rlike("[0-9A-Za-z+]$"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the match's digits pass Luhn; only up to 19 digits are looked at, longer ones fail elsewhere."""
    digits = F.reverse(F.substring(_digits(match), 1, 19))

    def term(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda a, i: F.coalesce(term(a, i), a)) % 10 == 0)


_CHECK = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def _valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _CHECK[kind](s["match"]))


def with_base(rows: DataFrame) -> DataFrame:
    """Adds an array a kind of the base spans of column ``text``."""
    for kind in KINDS:
        rows = rows.withColumn("base_" + kind, _valid(kind, _spans(F.col("text"), BASE[kind], GATES[kind](F.col("text")))))
    return rows


def _features(s: Column, kind: int) -> Column:
    m = s["match"]
    groups = F.filter(F.split(m, r"[^0-9]+", -1), lambda g: g != "")
    flag = lambda c: c.cast("double")
    values = [
        F.lit(float(kind)),
        flag(F.length(_digits(m))),
        flag(F.length(F.regexp_replace(m, r"\P{L}", ""))),
        flag(F.length(m)),
        flag(F.length(F.regexp_replace(m, r"[\p{L}0-9\x20]", ""))),
        flag(_luhn(m)),
        flag(m.rlike(r"[(\[{<]")),
        flag(m.rlike(r"@|[(\[{<]\x20?(?i:at)|\x20dot\x20|[(\[{]\.|[(\[{<]\x20?(?i:dot)")),
        flag(s["left"].rlike(r"[\p{L}0-9._/=-]$")),
        flag(s["right"].rlike(r"^[\p{L}0-9/=%-]|^[.,][\p{L}0-9]|^\x20?[(\[{<]")),
        flag(s["left"].rlike(CONTEXT)),
        flag(F.size(groups)),
        flag(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))),
        flag(m.rlike(r"\.\x20")),
        flag(F.length(F.regexp_replace(m, r"[^\x20]", ""))),
        F.length(F.regexp_extract(m, r"^\(?(0{1,2})[1-9]", 1)).cast("double"),
    ]
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS[kind]).alias("kind"), *[v.alias(n) for v, n in zip(values, ["f_" + n for n in FEATURES], strict=True)])


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _proposed(kind: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: _features(s, kind))


def with_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``candidates``: proposed spans with features, none that overlaps a base span; what lies beside one is proposed by itself."""
    base = F.concat(*[F.col("base_" + k) for k in KINDS])
    rows = rows.withColumn("base_all", base).withColumn("ranges", _runs(F.col("text")))
    found = []
    for i, kind in enumerate(KINDS):
        found.append(_proposed(i, F.filter(_generated(kind), lambda s: ~F.exists("base_all", lambda b: _overlaps(s, b)))))
    return rows.withColumn("candidates", F.concat(*found))


# --- boosted trees -------------------------------------------------------------------------------


class Trees:
    """Depth-2 regression trees on the logistic loss: (feature, cut, (left node), (right node)) with leaf values."""

    def __init__(self) -> None:
        self.base, self.trees, self.scale, self.shift = 0.0, [], 1.0, 0.0
        self.threshold = [2.0] * len(KINDS)

    @staticmethod
    def _cut(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, float]:
        best = (0.0, 0, np.inf)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for c in (values[1:] + values[:-1]) / 2 if len(values) < 24 else np.quantile(values, np.linspace(0.04, 0.96, 24)):
                left = rows[x[rows, f] <= c]
                right = rows[x[rows, f] > c]
                if len(left) < 5 or len(right) < 5:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - whole
                best = max(best, (float(gain), f, float(c)))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = 0.3) -> None:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            value = lambda rows, g=g, h=h: float(rate * g[rows].sum() / (h[rows].sum() + 1))
            rows = np.arange(len(y))
            gain, f, c = self._cut(x, g, h, rows)
            if gain <= 1e-6:
                break
            sides = []
            for part in (rows[x[:, f] <= c], rows[x[:, f] > c]):
                gain2, f2, c2 = self._cut(x, g, h, part)
                if gain2 > 1e-6:
                    a, b = part[x[part, f2] <= c2], part[x[part, f2] > c2]
                    sides.append((f2, c2, value(a), value(b)))
                    z[a] += sides[-1][2]
                    z[b] += sides[-1][3]
                else:
                    sides.append((f, np.inf, value(part), 0.0))
                    z[part] += sides[-1][2]
            self.trees.append((f, c, *sides))

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, c, left, right in self.trees:
            low = x[:, f] <= c
            for side, rows in ((left, low), (right, ~low)):
                z += np.where(rows, np.where(x[:, side[0]] <= side[1], side[2], side[3]), 0.0)
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray, text: np.ndarray) -> None:
        """Platt's scaling, then by kind the middle of the thresholds with about the best F1 of those with a precision of ``PRECISION``.

        ``text``: which text each candidate is of. As overlapping ones give way to the likeliest, only a text's likeliest,
        the longest of equals, counts for thresholds."""
        z = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([(z * (y - p)).sum() - 1e-3 * (a - 1), (y - p).sum()])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
            da, db = np.linalg.solve(h, g)
            a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        self.scale, self.shift = float(a), float(b)
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        order = np.lexsort((-x[:, FEATURES.index("length")], -p, text))
        first = np.zeros(len(p), bool)
        first[order[np.append(True, text[order][1:] != text[order][:-1])]] = True
        for k in range(len(KINDS)):
            own = first & (x[:, 0] == k)
            order = np.argsort(-p[own], kind="stable")
            hits, taken = np.cumsum(y[own][order]), np.arange(1, own.sum() + 1)
            f1 = np.where(hits >= PRECISION * taken, 2 * hits / (taken + max(1.0, y[own].sum())), 0)
            if len(f1) and f1.max() > 0:
                good, scores = np.flatnonzero(f1 >= f1.max() - 0.01), p[own][order]
                self.threshold[k] = float((scores[good[0]] + scores[min(good[-1] + 1, len(scores) - 1)]) / 2)

    def column(self, c: Column) -> Column:
        """The calibrated probability of a candidate struct."""
        f = lambda i: c["f_" + FEATURES[i]]

        def leaf(side: tuple) -> Column:
            if np.isinf(side[1]):
                return F.lit(side[2])
            return F.when(f(side[0]) <= side[1], F.lit(side[2])).otherwise(F.lit(side[3]))

        z = F.lit(self.base)
        for feature, cut, left, right in self.trees:
            z = z + F.when(f(feature) <= cut, leaf(left)).otherwise(leaf(right))
        return 1 / (1 + F.exp(-(z * self.scale + self.shift)))


def _templates(n: int, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(left context, span, right context, kind or -1): made-up texts, half of them with personal data of odd form."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9)))

    def luhn(k: int) -> str:
        body = digits(k - 1)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def grouped(s: str, sep: str, sizes: tuple[int, ...]) -> str:
        out = []
        for k in sizes:
            out.append(s[:k])
            s = s[k:]
        return sep.join([x for x in [*out, s] if x])

    def failing(k: int) -> str:
        n = luhn(k)
        return n[:-1] + str((int(n[-1]) + r.randint(1, 9)) % 10)

    octet = lambda: str(r.randint(1, 254))
    at = lambda: r.choice(["(at)", "[at]", " (at) ", " [at] ", "{at}", " <at> ", "(AT)"])
    dot = lambda: r.choice([".", "(dot)", "[dot]", " dot ", " [dot] ", "."])
    emails = [
        lambda: f"{word()}.{word()}{at()}{word()}{dot()}{r.choice(['com', 'org', 'de', 'fr', 'es', 'net'])}",
        lambda: f"{word()}{r.choice('.-_')}{word()}{at()}{word()}{dot()}{word()}{dot()}{r.choice(['com', 'org', 'uk'])}",
        lambda: f"{word()} at {word()} dot {r.choice(['com', 'org', 'net'])}",
        lambda: f"{word()} @ {word()}.{r.choice(['com', 'org', 'net'])}",
    ]
    ips = [
        lambda: r.choice(["[.]", "(.)", "{.}", " . ", "[dot]"]).join(octet() for _ in range(4)),
    ]
    cards = [
        lambda: grouped(luhn(16), r.choice([".", "/", "  ", "_"]), (4, 4, 4)),
        lambda: grouped(luhn(15), r.choice([" ", "-", ""]), (4, 6)),
        lambda: luhn(13),
    ]
    phones = [
        lambda: f"({r.randint(201, 989)}) {r.randint(200, 999)}-{digits(4)}",
        lambda: f"{r.randint(201, 989)}-{r.randint(200, 999)}-{digits(4)}",
        lambda: f"{r.randint(201, 989)}.{r.randint(200, 999)}.{digits(4)}",
        lambda: f"00{r.randint(20, 99)}{r.choice(' -/')}{digits(r.randint(2, 4))}{r.choice(' -/')}{digits(r.randint(5, 8))}",
        lambda: f"00{r.randint(20, 99)} {digits(3)} {digits(r.randint(5, 7))}",
        lambda: f"00{r.randint(1, 99)} {' '.join(digits(r.randint(2, 4)) for _ in range(3))}",
        lambda: f"0{digits(3)}/{digits(7)}",
    ]
    good = [(kind, f) for kind, own in enumerate((emails, ips, cards, phones)) for f in own]
    bad = [
        lambda: f"{word()} at {word()}. {word().title()}",
        lambda: f"{word()} at {word()}.{digits(2)}",
        lambda: f"{word()}@{word()}",
        lambda: f"{word()} at the {word()}. {word().title()}.",
        lambda: ".".join(str(r.randint(0, 30)) for _ in range(r.choice([3, 5, 6]))),
        lambda: f"{r.randint(1, 12)}.{r.randint(0, 9)}. {r.randint(1, 9)}.{r.randint(0, 9)}",
        lambda: grouped(failing(16), r.choice([".", "/", " "]), (4, 4, 4)),
        lambda: failing(r.randint(13, 19)),
        lambda: " ".join(digits(r.randint(1, 3)) for _ in range(9)),
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}",
        lambda: f"{r.randint(1900, 1999)}-{r.randint(2000, 2030)}",
        lambda: f"{r.randint(1, 9)}{digits(2)}.{digits(3)}.{digits(3)}",
        lambda: digits(r.randint(7, 12)),
        lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"{digits(2)} ({digits(2)}) {digits(3)} {digits(2)}",
    ]
    hints = ["mail", "contact", "call me at", "tel", "phone", "card", "pay with", "host", "kontakt", "correo"]
    out = []
    for i in range(n):
        kind, made = r.choice(good) if i % 2 else (-1, r.choice(bad))
        left = f"{word()} {word()} " + (r.choice(hints) + r.choice([" ", ": "]) if r.random() < (0.5 if i % 2 else 0.1) else "")
        right = r.choice([".", ",", " " + word(), "", "\n" + word(), ". " + word().title()])
        out.append((left, made(), right, kind))
    return out


_fitted: dict[int, Trees] = {}


def model(spark: SparkSession, examples: int = EXAMPLES) -> Trees:
    """The trees, fitted once a process: two thirds of the examples to grow, one to calibrate."""
    if examples not in _fitted:
        made = _templates(examples)
        texts = spark.createDataFrame([(i, a + b + c, len(a), len(a) + len(b), y) for i, (a, b, c, y) in enumerate(made)], "i int, text string, a int, b int, y int")
        rows = with_candidates(with_base(texts)).select("i", "a", "b", "y", F.explode("candidates").alias("c")).collect()
        x = np.array([[r.c["f_" + f] for f in FEATURES] for r in rows], float)
        # A candidate is right if its text is personal data of its kind, no part of it and no more.
        y = np.array([(r.c["f_kind"], r.c["start"], r.c["end"]) == (r.y, r.a, r.b) for r in rows], float)
        grow = np.array([r.i % 3 != 0 for r in rows])
        trees = Trees()
        trees.fit(x[grow], y[grow])
        trees.calibrate(x[~grow], y[~grow], np.array([r.i for r in rows])[~grow])
        _fitted[examples] = trees
    return _fitted[examples]


def _likeliest(spans: Column) -> Column:
    """Of spans that overlap the likeliest, then the longest; one that only overlaps a dropped one stays."""
    ranked = F.array_sort(F.transform(spans, lambda c: F.struct((-c["p"]).alias("unlikely"), (c["start"] - c["end"]).alias("short"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["p"].alias("p"))))

    def take(acc: Column, c: Column) -> Column:
        one = F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["p"].alias("p")))
        return F.when(F.exists(acc, lambda o: _overlaps(o, c)), acc).otherwise(F.concat(acc, one))

    return F.aggregate(ranked, F.expr("cast(array() as array<struct<kind:string,start:int,end:int,p:double>>)"), take)


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, an array a kind of base spans, and ``added``: (kind, start, end, p) of the spans the trees accept."""
    trees = model(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = with_candidates(with_base(rows))
    scored = F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), trees.column(c).alias("p")))
    threshold = F.create_map(*[x for k, t in zip(KINDS, trees.threshold, strict=True) for x in (F.lit(k), F.lit(t))])
    rows = rows.withColumn("accepted", F.filter(scored, lambda c: c["p"] >= F.element_at(threshold, c["kind"])))
    return rows.select("doc_id", *["base_" + k for k in KINDS], _likeliest(F.col("accepted")).alias("added"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(common.documents(spark, sf_dir))
    base = [_named(k, F.col("base_" + k)) for k in KINDS]
    every = [_named(k, F.array_sort(F.concat(_places(F.col("base_" + k)), _places(F.filter("added", _is(k)))))) for k in KINDS]
    return found.select(
        "doc_id",
        *[F.size("base_" + k).cast("long").alias("n_" + k) for k in KINDS],
        F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*every), ",").alias("spans"),
        F.size(F.concat(*every)).cast("long").alias("n_spans"),
    )
