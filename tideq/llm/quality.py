"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Boosting goes round the features
and pairs in turn, each time fitting one shallow tree to the gradients summed by
bin and adding it to that feature's lookup table. A score is the sum of one
cell of each table, through the logistic function.

The model is fitted on the driver from at most ``sample`` labelled rows, the
first by hash of their id. Scoring is one pass over the texts.

Defined results: a null text counts as empty and is scored like any other; rows
with equal ids are all scored; a label that is null doesn't count, of several
for one id the lowest does; if the labels are all alike or there are none, every
score is the share of label 1, or 0.5. Columns beyond id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digits", "stops", "commas", "symbols", "pipes",
    "spaces", "distinct_words", "top_word", "adjacent_repeats", "distinct_pairs", "log_lines", "line_length",
    "lines_ended", "repeated_lines", "symbol_words", "upper_words", "one_letter_words", "char_entropy", "word_entropy",
)
#: Character classes of code points below this; all above count as the letter class.
_KNOWN = 0x250


def _classes() -> np.ndarray:
    out = np.zeros((_KNOWN + 1, 6))
    for c in range(_KNOWN):
        x = chr(c)
        out[c] = (x.isupper(), x.isdigit(), x in ".?!", x in ",;:", not x.isalnum() and not x.isspace() and x not in ".?!,;:'\"-()", x.isspace())
    return out


_CLASS = _classes()
_SYMBOL_END = re.compile(r"[^\w\s.?!,;:'\")-]+$")


def _entropy(counts: np.ndarray) -> float:
    share = counts[counts > 0] / max(1, counts.sum())
    return float(-(share * np.log2(share)).sum())


def features_of(text: str | None) -> list[float]:
    """One value for each of ``FEATURES``."""
    text = text or ""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), _KNOWN)
    chars = np.bincount(points, minlength=_KNOWN + 1)
    n = max(1, len(points))
    upper, digits, stops, commas, symbols, spaces = (chars @ _CLASS) / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counted = Counter(words)
    counts = np.fromiter(counted.values(), dtype=np.int64, count=len(counted))
    pairs = max(1, len(words) - 1)
    lines = [line for line in text.split("\n") if line.strip()]
    k = max(1, len(lines))
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.sum()) / m, float(lengths.max(initial=0)),
        upper, digits, stops, commas, symbols, chars[ord("|")] / n, spaces,
        len(counted) / m, float(counts.max(initial=0)) / m,
        sum(map(str.__eq__, words, words[1:])) / pairs, len(set(zip(words, words[1:]))) / pairs,
        np.log1p(len(lines)), len(text) / k, sum(line.rstrip()[-1] in ".?!" for line in lines) / k, 1 - len(set(lines)) / k,
        sum(c for w, c in counted.items() if _SYMBOL_END.search(w)) / m,
        sum(c for w, c in counted.items() if len(w) > 1 and w.isupper()) / m,
        float((lengths == 1).sum()) / m, _entropy(chars), _entropy(counts),
    ]


def feature_frame(texts: pd.Series) -> np.ndarray:
    return np.array([features_of(text) for text in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Lookup tables of an additive model."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, one in enumerate(self.tables):
            total += one[at[:, f]]
        for (f, g), two in zip(self.pairs, self.pair_tables):
            total += two[at[:, f], at[:, g]]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    return g * g / (h + least)


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best gain and place of one cut of summed gradients ``g`` and curvatures ``h``."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl, least) + _gain(g.sum() - gl, h.sum() - hl, least) - _gain(g.sum(), h.sum(), least)
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _shallow(g: np.ndarray, h: np.ndarray, least: float, leaves: int = 3) -> np.ndarray:
    """A tree of few leaves over ordered bins: the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_cut(g[a:b], h[a:b], least), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        _, cut, a, b = best
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + least)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """A tree of two levels over a grid: the first axis that pays more is cut, then the other on either side."""
    best = (-1.0, g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        _, cut = _cut(a.sum(axis=1), b.sum(axis=1), least)
        out, gain = np.zeros(a.shape), -float(_gain(a.sum(), b.sum(), least))
        for rows in (slice(0, cut), slice(cut, None)):
            column_g, column_h = a[rows].sum(axis=0), b[rows].sum(axis=0)
            _, across = _cut(column_g, column_h, least)
            for columns in (slice(0, across), slice(across, None)):
                sg, sh = column_g[columns].sum(), column_h[columns].sum()
                out[rows, columns] = -sg / (sh + least)
                gain += float(_gain(sg, sh, least))
        if gain > best[0]:
            best = (gain, out.T if turn else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 32, pairs: int = 8, least: float = 2.0) -> Model:
    """Cyclic boosting of shallow trees into lookup tables, then of the pairs that reduce the loss most."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    share = y.mean() if len(y) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    at = model.bins(x)
    total = np.full(len(x), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _shallow(np.bincount(at[:, f], g, len(table)), np.bincount(at[:, f], h, len(table)), least)
            table += step
            total += step[at[:, f]]

    def grid(f: int, k: int, v: np.ndarray) -> np.ndarray:
        shape = (len(model.tables[f]), len(model.tables[k]))
        return np.bincount(at[:, f] * shape[1] + at[:, k], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    found = sorted(((_shallow_pair(grid(f, k, g), grid(f, k, h), least)[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)
    model.pairs = [(f, k) for gain, f, k in found[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[f]), len(model.tables[k]))) for f, k in model.pairs]
    for _ in range(rounds // 2):
        for (f, k), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * _shallow_pair(grid(f, k, g), grid(f, k, h), least)[1]
            table += step
            total += step[at[:, f], at[:, k]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 20_000) -> Model:
    """Model of ``label_col`` from at most ``sample`` labelled documents that are not held out."""
    wanted = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label_col).cast("double").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(feature_frame(batch["text"]), columns=list(FEATURES))
            yield out.assign(_label=batch["_label"].to_numpy())

    # of rows with one id the smallest text is learned from, so that repeated ids add no rows
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", _label double"
    got = rows.select("text", "_label").mapInPandas(run, schema).toPandas()
    return fit(got[list(FEATURES)].to_numpy(dtype=np.float64), got["_label"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, for every row; a column that has this name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(feature_frame(text)))

    return docs.withColumn(score_col, scored("text"))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1), predicted (1 if score >= 0.5) for every row."""
    return score(docs.select("doc_id", "text"), train(docs, labels, label_col, sample)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
