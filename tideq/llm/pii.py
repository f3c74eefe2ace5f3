r"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds.

Generators with high recall propose spans: the base patterns (e-mail, IP
address, card, telephone number), and secrets after a keyword, long hex
strings, spelt-out e-mail addresses, local telephone numbers and bare numbers
of nine to eleven digits. A span's features are its format (kind, length,
digits, separators, variety of characters, checks that it passes) and its
context (a keyword shortly before it). Boosted trees, fitted on the driver from
counts of the candidates of all documents by their features in steps, give each a score; a threshold
for each kind, set on documents that were not fitted, selects. The trees run as
SQL conditions. Spans that pass a base rule always stay.

There are no labelled spans to learn from, so labels are weak: a candidate of a
base pattern is positive if it passes its rule; of another generator, if a
keyword for its kind stands before it. Trees see neither, so that they must tell
the two apart by format and by the signs before the span; a kind for which they
can't at the precision asked for gives no spans.

Positions come from the gaps between matches: the text is split by the pattern,
and lengths are summed. Patterns are written so that no long run of characters
is scanned again from each of its characters, and repeat possessively, which
Java matches without recursion.

Only DataFrame functions are used, and fitting on the collected counts.

Defined results: null text counts as empty; rows with equal ids are each
answered; without a single candidate of either label only base spans are given;
extra columns aren't read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: All kinds, in the order in which spans with one start are listed.
KINDS = (*BASE, "secret", "hex", "spelt_email", "local_phone", "number")
#: Java patterns of the generators; the first four match what the base rules match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"""(?i)(?<![a-z0-9])(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?[^\s"',;]{6,}+""",
    "hex": r"(?<![0-9A-Za-z])[0-9a-f]{16,}+(?![0-9A-Za-z])",
    "spelt_email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9A-Za-z.+-])[0-9]{9,11}+(?![0-9A-Za-z])",
}
#: The value behind the keyword of a secret, whatever signs it holds.
SECRET_VALUE = r"""(?i)^[a-z_-]+["']?\s{0,3}[:=]\s{0,3}["']?(.*)$"""
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "phone": "+", "secret": "[:=]", "spelt_email": r"[\[(][aA][tT]"}
#: Words that, shortly before a candidate, speak for its kind.
KEYWORDS = {
    "secret": r"token|password|passwd|pwd|secret|key", "hex": r"token|password|passwd|pwd|secret|key", "spelt_email": r"mail|contact|write",
    "local_phone": r"phone|tel|call|fax|mobile", "number": r"ssn|passport|account|social|licen[cs]e",
}
BEFORE = 24
#: What trees may ask; the rule and the keyword that make the labels are not among them.
FEATURES = ("kind", "length", "digits", "letters", "separators", "variety", "groups", "assigned")
#: Items of a block of a running fold.
BLOCK = 64
#: Steps to which features are rounded up where candidates are counted; beyond the last, ``BEYOND``.
STEPS = (*range(13), 16, 20, 24, 32, 48, 64, 128)
BEYOND = 1 << 31
#: Different values of a feature up to which a tree tries a cut at each.
CUTS = 32
#: Threshold of a kind of which no candidate was held back to calibrate it.
UNCALIBRATED = 0.5
CANDIDATE = "struct<kind:int,start:int,stop:int,length:double,digits:double,letters:double,separators:double,variety:double,groups:double,assigned:double,valid:double,keyword:double>"


def matches(text: Column, pattern: str, needs: str = "[0-9]", least: int = 0) -> Column:
    """(start, stop, found, before) of each match of at least so many characters, in code points, the stop exclusive; ``before`` are the up to ``BEFORE`` characters before it.

    These are carried from gap to gap: taken from the text, each would cost a walk from its beginning.
    """
    kind = "struct<start:int,stop:int,found:string,before:string>"
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(F.transform(gaps, lambda g: F.struct(F.length(g).alias("chars"), F.right(g, F.lit(BEFORE)).alias("end"))).alias("gap"), found.alias("found"))
    last = lambda *parts: F.right(F.concat(*parts), F.lit(BEFORE))

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        begin = held["at"] + x["gap"]["chars"]
        end = begin + F.length(x["found"])
        before = last(held["tail"], x["gap"]["end"])
        state = F.struct(end.alias("at"), last(before, x["found"]).alias("tail"))
        return state, F.struct(begin.alias("start"), end.alias("stop"), x["found"].alias("found"), before.alias("before"))

    there = text.contains(needs) if len(needs) <= 2 else text.rlike(needs)
    placed = running(F.filter(both, lambda x: x["found"].isNotNull()), F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, kind)
    return F.when(there, F.filter(placed, lambda x: x["stop"] - x["start"] >= least) if least else placed).otherwise(F.array().cast(f"array<{kind}>"))


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step`` (state, item), which also gives the next state, makes of each item in order: an array of type ``kind``.

    A fold copies its state at each step, so one that gathers all results takes quadratic time. Here items are
    folded in blocks of ``BLOCK``: first for the state alone, which is kept at each block's start,
    then each block by itself for its results.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(held: Column, x: Column) -> Column:
        state, out = step(held["state"], x)
        return F.struct(state.alias("state"), F.concat(held["out"], F.array(out)).alias("out"))

    def of(every: Column) -> Column:
        block = lambda i: F.slice(every, i * BLOCK + 1, BLOCK)
        on = lambda held, i: F.struct(
            F.aggregate(block(i), held["state"], lambda s, x: step(s, x)[0]).alias("state"), F.concat(held["seen"], F.array(held["state"])).alias("seen")
        )
        blocks = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int"))
        starts = F.aggregate(blocks, F.struct(start.alias("state"), F.array_repeat(start, 0).alias("seen")), on, lambda held: held["seen"])
        parts = F.transform(starts, lambda s, i: F.aggregate(block(i), F.struct(s.alias("state"), empty.alias("out")), one, lambda held: held["out"]))
        return F.when(F.size(every) > 0, F.flatten(parts)).otherwise(empty)

    # a name for the items: an expression used in a lambda would be computed for each of its calls
    return F.get(F.transform(F.array(items), of), F.lit(0))


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def value(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """Whether a match of a base pattern passes its rule; true for other generators."""
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        digits = digits_of(found)
        return F.when(F.length(digits).between(12, 19), passes_luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(found)).between(9, 15)
    return F.lit(True)


def _described(text: Column, kind: str) -> Column:
    """Candidates of one generator with their features."""

    def one(x: Column) -> Column:
        value, start, before = x["found"], x["start"], x["before"]
        if kind == "secret":  # the span is the value behind the keyword
            value = F.regexp_extract(x["found"], SECRET_VALUE, 1)
            start = x["stop"] - F.length(value)
            before = F.right(F.concat(before, F.substring(x["found"], F.lit(1), F.length(x["found"]) - F.length(value))), F.lit(BEFORE))
        before = F.lower(before)
        size = F.length(value)
        digits = F.length(digits_of(value))
        letters = F.length(F.regexp_replace(value, r"[^\p{L}]", ""))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), x["stop"].alias("stop"), size.cast("double").alias("length"),
            digits.cast("double").alias("digits"), letters.cast("double").alias("letters"), (size - digits - letters).cast("double").alias("separators"),
            F.size(F.array_distinct(F.split(F.lower(value), ""))).cast("double").alias("variety"),
            F.size(F.split(value, "[^0-9A-Za-z]+")).cast("double").alias("groups"),
            (x["found"].rlike("[:=]") | before.rlike("[:=(][ \"']*$")).cast("double").alias("assigned"),
            passes(kind, x["found"]).cast("double").alias("valid"),
            (before.rlike(KEYWORDS[kind]) if kind in KEYWORDS else F.lit(False)).cast("double").alias("keyword"),
        )

    # runs of fewer than nine digits are no candidates
    got = F.transform(matches(text, PATTERNS[kind], NEEDS.get(kind, "[0-9]"), 9 if kind == "card" else 0), one)
    return got.cast(f"array<{CANDIDATE}>")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with candidates: an array of overlapping spans of all generators."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumn("_text", text)
    for kind in KINDS:
        named = named.withColumn(f"_{kind}", _described(F.col("_text"), kind))
    return named.withColumn("candidates", F.concat(*(F.col(f"_{k}") for k in KINDS))).drop("_text", *(f"_{k}" for k in KINDS))


# ---- boosted trees ---------------------------------------------------------

Tree = tuple  # (feature, cut, below, above), or a number


@dataclass
class Model:
    intercept: float
    trees: list[Tree]
    thresholds: dict[int, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        def walk(tree: Tree, rows: np.ndarray) -> np.ndarray:
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            feature, cut, below, above = tree
            return np.where(rows[:, feature] <= cut, walk(below, rows), walk(above, rows))

        return 1 / (1 + np.exp(-(self.intercept + sum((walk(t, x) for t in self.trees), np.zeros(len(x))))))

    def expression(self, value: dict[str, Column]) -> Column:
        """The score as a column, from columns of the features."""

        def walk(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, cut, below, above = tree
            return F.when(value[FEATURES[feature]] <= float(cut), walk(below)).otherwise(walk(above))

        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, (walk(t) for t in self.trees), F.lit(float(self.intercept)))))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, depth: int, rate: float, least: float = 1.0) -> Tree:
    leaf = float(-rate * g.sum() / (h.sum() + least))
    if depth == 0 or w.sum() < 4:
        return leaf
    best = (1e-6, 0, 0.0)
    for f in range(x.shape[1]):
        cuts = np.unique(x[:, f])
        if len(cuts) > CUTS:
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12), method="lower"))
        for cut in cuts:
            low = x[:, f] <= cut
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl**2 / (hl + least) + (g.sum() - gl) ** 2 / (h.sum() - hl + least) - g.sum() ** 2 / (h.sum() + least)
            if low.any() and not low.all() and gain > best[0]:
                best = (gain, f, float(cut))
    gain, f, cut = best
    if gain <= 1e-6:
        return leaf
    low = x[:, f] <= cut
    return (f, cut, *(_grow(x[side], g[side], h[side], w[side], depth - 1, rate) for side in (low, ~low)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4, precision: float = 0.98, weight: np.ndarray | None = None, held: np.ndarray | None = None) -> Model:
    """Trees from the rows that aren't ``held`` (a third, if it isn't given); from the rest, for each kind, the lowest threshold that keeps the precision.

    ``weight`` is how often each row is there.
    """
    w = np.ones(len(y)) if weight is None else weight.astype(float)
    share = float(np.clip(np.average(y, weights=w) if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Model(float(np.log(share / (1 - share))), [], {})
    if not len(y) or y.min() == y.max():
        return model
    held = np.arange(len(y)) % 3 == 2 if held is None else held
    a, b, v = x[~held], y[~held], w[~held]
    for _ in range(rounds):
        p = model.score(a)
        model.trees.append(_grow(a, v * (p - b), v * p * (1 - p), v, depth, rate))
    p = model.score(x[held])
    for kind in range(len(BASE), len(KINDS)):
        mine = x[held][:, 0] == kind
        if not mine.any():
            model.thresholds[kind] = UNCALIBRATED
            continue
        order = np.argsort(p[mine], kind="stable")
        scores, all_, right = p[mine][order], w[held][mine][order], (w[held] * y[held])[mine][order]
        all_, right = (np.cumsum(c[::-1])[::-1] for c in (all_, right))
        for threshold in np.unique(np.append(scores[scores >= 0.5], 0.5)):
            at = np.searchsorted(scores, threshold)
            if at < len(scores) and right[at] / all_[at] >= precision:
                model.thresholds[kind] = float(threshold)
                break
    return model


def _stepped(value: Column) -> Column:
    """The smallest of ``STEPS`` that is no less: a cut at a step tells stepped and plain values apart alike."""
    steps = F.when(value <= STEPS[0], float(STEPS[0]))
    for step in STEPS[1:]:
        steps = steps.when(value <= step, float(step))
    return steps.otherwise(float(BEYOND))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model from the candidates of all documents, counted by their features in steps; a third of the documents is held back for the thresholds.

    What the driver gets is a row for each different set of steps, labels and fold, not for each candidate.
    """
    named = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(3)).alias("fold"), F.col(text_col).alias("text"))
    spans = candidates(named).select("fold", F.explode("candidates").alias("c"))
    stepped = [(F.col(f"c.{f}").cast("double") if f == "kind" else _stepped(F.col(f"c.{f}"))).alias(f) for f in FEATURES]
    label = F.when(F.col("c.kind") < len(BASE), F.col("c.valid")).otherwise(F.col("c.keyword")).alias("label")
    counted = spans.select(*stepped, label, (F.col("fold") == 2).cast("double").alias("held")).groupBy(*FEATURES, "label", "held").agg(F.count("*").cast("double").alias("n"))
    rows = sorted(tuple(r) for r in counted.collect())
    x = np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES) + 3)
    return fit(x[:, : len(FEATURES)], x[:, -3], weight=x[:, -1], held=x[:, -2] == 1)


def find_spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and added_spans: arrays of (start, kind index, stop), in order."""
    found = candidates(docs, text_col)
    base = F.filter("candidates", lambda x: (x["kind"] < len(BASE)) & (x["valid"] == 1))

    def chosen(x: Column) -> Column:
        value = {f: x[f].cast("double") for f in FEATURES}
        least = F.lit(2.0)
        for kind, threshold in model.thresholds.items():
            least = F.when(x["kind"] == kind, F.lit(threshold)).otherwise(least)
        return (x["kind"] >= len(BASE)) & (model.expression(value) >= least) & (x["stop"] > x["start"])

    span = "array<struct<start:int,kind:int,stop:int>>"
    plain = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))).cast(span)
    found = found.withColumn("base_spans", plain(base)).withColumn("_more", plain(F.filter("candidates", chosen)) if model.thresholds else F.array().cast(span))
    # base spans and the others in one order: from the end each learns where the next base span begins, from the start how far those before it reach
    marked = lambda spans, base: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.lit(base).alias("base")))
    every = F.array_sort(F.concat(marked("base_spans", True), marked("_more", False)))
    whole = "struct<start:int,kind:int,stop:int,base:boolean,free:boolean>"

    def ahead(following: Column, x: Column) -> tuple[Column, Column]:
        free = x["base"] | (x["stop"] <= following)
        return F.when(x["base"], x["start"]).otherwise(following), F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), x["base"].alias("base"), free.alias("free"))

    def behind(reached: Column, x: Column) -> tuple[Column, Column]:
        """Base spans and spans taken reach on; a span is taken if nothing before reaches into it."""
        free = x["base"] | (x["free"] & (x["start"] >= reached))
        return F.when(free, F.greatest(reached, x["stop"])).otherwise(reached), F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), x["base"].alias("base"), free.alias("free"))

    looked = running(F.reverse(every), F.lit(2**31 - 1), ahead, whole)
    taken = F.filter(running(F.reverse(looked), F.lit(-1), behind, whole), lambda x: x["free"] & ~x["base"])
    added = F.transform(taken, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))).cast(span)
    return found.withColumn("added_spans", F.when(F.size("_more") > 0, added).otherwise(F.array().cast(span))).drop("_more", "candidates")


def count_of(spans: str, kind: str) -> Column:
    """How many spans are of the kind. (A second argument of the lambda, even one with a default, would be the span's place.)"""
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each of the sorted spans replaced by its kind in angle brackets; overlapping ones merge."""
    names = F.array(*(F.lit(k) for k in KINDS))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        mark = F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), F.lit("<"), F.get(names, x["kind"]), F.lit(">"))).otherwise("")
        return F.greatest(at, x["stop"]), mark

    reached = F.coalesce(F.array_max(F.transform(spans, lambda x: x["stop"])), F.lit(0))
    return F.concat(F.array_join(running(spans, F.lit(0), step, "string"), ""), F.substring(text, reached + 1, F.length(text)))
