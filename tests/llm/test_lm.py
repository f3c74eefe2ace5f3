import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tideq.llm import lm

ODD = [(1, None), (2, ""), (3, "A a A \x0b a"), (3, "A a A \x0b a"), (3, "other"), (None, "null id"), (None, None), (9, "ſ K\x1f é É" + " a b" * 3000), (16, "q" * 70_000)]


def words(text):
    return (text or "").encode().lower().split()


def by_dictionaries(rows, order, tuning_texts, rounds=25, least_gain=1e-4):
    """The model of the same definition over tuples of words: (id, text) -> results."""
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows}
    padded = [(d, t, [None] * (order - 1) + words(t) + [0]) for d, t in rows]

    def count(chosen):
        grams, contexts = Counter(), Counter()
        for seq in chosen:
            for i in range(order - 1, len(seq)):
                for k in range(1, order + 1):
                    grams[tuple(seq[i - k + 1 : i + 1])] += 1
                    contexts[tuple(seq[i - k + 1 : i])] += 1
        return grams, contexts

    train = [(t, s) for d, t, s in padded if not held[d]]
    known = {w for _, s in train for w in s[order - 1 :]}
    uni = 1 / (len(known) + 1)

    def estimates(seq, i, grams, contexts):
        level, f = 0, [uni]
        for k in range(1, order + 1):
            context = contexts[tuple(seq[i - k + 1 : i])]
            if context:
                level = k
            f.append(grams[tuple(seq[i - k + 1 : i + 1])] / max(context, 1))
        seen = contexts[tuple(seq[i - level + 1 : i])] if level else 1
        return (level, math.floor(math.log2(seen))), f

    part = count([s for t, s in train if t not in tuning_texts])
    tokens = [estimates(s, i, *part) for t, s in train if t in tuning_texts for i in range(order - 1, len(s))]
    weights, before = {}, -math.inf
    start = lambda level: [1 / (level + 1)] * (level + 1) + [0] * (order - level)
    for _ in range(rounds if tokens else 0):
        mass, likely = {}, 0.0
        for b, f in tokens:
            parts = [x * y for x, y in zip(weights.get(b, start(b[0])), f)]
            mass[b] = [m + x / sum(parts) for m, x in zip(mass.get(b, [1.0] * (b[0] + 1) + [0.0] * (order - b[0])), parts)]
            likely += math.log(sum(parts)) / len(tokens)
        weights = {b: [x / sum(m) for x in m] for b, m in mass.items()}
        if likely - before < least_gain:
            break
        before = likely
    every = count([s for _, s in train])
    n = sum(len(s) - order + 1 for _, s in train)
    out = []
    for d, _, s in padded:
        places = range(order - 1, len(s))
        found = [estimates(s, i, *every) for i in places]
        score = sum(math.log10(sum(x * y for x, y in zip(weights.get(b, start(b[0])), f))) for b, f in found)
        base = sum(math.log10((every[0][(s[i],)] + 1) / (n + len(known) + 1)) for i in places)
        out.append((d, held[d], len(s) - order + 1, sum(s[i] in known for i in places), n, base, score))
    return out


def tuned(spark, texts):
    """Texts that the operator holds back for the weights."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", F.pmod(F.xxhash64("text"), F.lit(10)))
    return {r.text for r in rows.where("h = 0").collect()}


def check(spark, rows, docs, order, block_chars):
    got = [tuple(r) for r in lm.score_texts(docs, order=order, block_chars=block_chars).collect()]
    tuning = tuned(spark, {t or "" for _, t in rows})
    want = by_dictionaries([(d, t or "") for d, t in rows], order, tuning)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_all_documents_against_dictionaries(spark, docs, order):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows, docs, order, 60_000)


def test_odd_rows_in_one_block_and_in_many(spark):
    rows = ODD + [(100 + i, f"a b c {i % 5} a b d") for i in range(60)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score long")
    check(spark, rows, docs, 3, 10**9)
    check(spark, rows, docs, 3, 2_000)
    assert lm.score_texts(docs.limit(0)).count() == 0


def test_without_training_rows_all_is_uniform(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    from pyspark.sql import functions as F

    row = lm.score_texts(docs, held=F.lit(True)).first()
    assert (row.train_tokens, row.n_known, row.score) == (0, 0, 0.0)


def test_probabilities_of_all_words_and_an_unknown_one_sum_to_one():
    """Behind each context: seen in full, by its last word only, and not at all."""
    rng = np.random.default_rng(3)
    words, n = ["a", "b", "c"], {"a b": 5, "b": 9}
    after = {"a b": {"a": 3, "c": 1, None: 1}, "b": {"a": 4, "b": 1, "c": 2, None: 2}, "": {"a": 9, "b": 8, "c": 5, None: 4}}
    any_word = 1 / (len(words) + 2)
    weights = lm.uniform(3) * rng.random((4 * lm.WIDTH, 4))
    weights /= weights.sum(axis=1, keepdims=True)
    total = sum(after[""].values())
    for c3, c2 in ((n["a b"], n["b"]), (0, n["b"]), (0, 0)):
        counted = object.__new__(lm.Counted)
        every = [*words, None, "unknown"]
        counts = (after[""], after["b"] if c2 else {}, after["a b"] if c3 else {})
        counted.counts = [np.array([c.get(w, 0) for w in every]) for c in counts]
        counted.contexts = [np.full(len(every), x) for x in (total, c2, c3)]
        bucket, ratio = counted.estimates()
        p = weights[bucket][:, 0] * any_word + (weights[bucket][:, 1:] * ratio).sum(axis=1)
        assert p.sum() == pytest.approx(1) and (p > 0).all()


def test_better_than_the_base_on_held_out_texts(docs):
    rows = [r for r in lm.score_texts(docs).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_messages_of_some_orders_are_their_part_of_all(spark):
    rows = [(i % 2, i % 2, f"a b {i % 3} c d", 1) for i in range(9)]
    blocks = spark.createDataFrame(rows, "block long, kind int, text string, copies long")
    asked = lambda *orders: sorted(tuple(r) for r in lm._messages(blocks, 3, 4, range(*orders)).collect())
    short, longest = asked(1, 3), asked(3, 4)
    assert sorted(short + longest) == asked(1, 4)
    assert max(r[0] for r in short) < 8 <= min(r[0] for r in longest)


def test_counts_take_no_more_bytes_than_they_need(spark):
    """A message of one count a byte, answers without the counts that their block doesn't read; large ones and a key of small numbers come back whole."""
    for values in ([1, 255], [0], [1, 256, 2**40], [2**62]):
        counts = np.array(values, dtype=np.int64)
        assert len(data := lm.planes(counts, 1)) == len(values) * max(1, (max(values).bit_length() + 7) // 8)
        assert lm.unplanes(data, np.int64, len(values)).tolist() == values
    keys = np.array([0, 3], dtype=np.uint64)
    assert len(lm.planes(keys)) == 16 and lm.unplanes(lm.planes(keys), np.uint64).tolist() == [0, 3]
    rows = [(i % 3, i % 3, "a b a c", 1) for i in range(9)]
    blocks = spark.createDataFrame(rows, "block long, kind int, text string, copies long")
    messages = lm._messages(blocks, 2, 1, range(1, 3))
    assert all(len(r.counts) * 8 == len(r["keys"]) for r in messages.collect())
    answers = [r for r in lm._answers(messages, 1).collect() if r.block >= 0]
    sizes = {(r.block, r.range): len(r["keys"]) // 8 for r in messages.collect()}
    assert answers and all(len(r.total) == sizes[r.block, r.range] and (r.kept is not None) == (r.block == lm.TUNING) for r in answers)
