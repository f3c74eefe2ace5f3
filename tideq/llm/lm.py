"""Language-model scores by deleted interpolation.

The probability of a word is a mixture of the maximum-likelihood estimates of
all orders up to ``order`` and of one share for any word; the mixture's weights
depend on how often the longest seen context was counted, in powers of two. They
are learned by expectation-maximisation on a tenth of the training texts, whose
counts are deleted from the estimates meanwhile; the estimates then used count
all training texts.

How it runs: documents are dealt to blocks by a hash. A block sorts its n-grams'
64-bit hashes and sends each range of hashes its part of them, each distinct
n-gram once; a range adds up what all blocks send and answers every block with the corpus's
counts of the n-grams that it asked for. So a common n-gram costs one entry a
block and no task holds the occurrences of one; blocks and ranges are bounded in
characters (``block_chars``), their numbers grow with the input. With very many blocks a message falls
to one n-gram, which is the volume of a plain shuffle of n-grams.
Two different n-grams share a hash with odds of 2^-64 a pair: a count of one would be off, no row is lost.

Defined results: null and empty texts are the end alone; a null id counts as an
empty one and is trained on; rows repeated in id and text are scored once and
returned as often as they stand there, and train as often; an
empty table gives an empty result; without training tokens all weight is with the uniform share; words
are cut at ASCII white space only, of any length. Only ``doc_id`` and ``text`` are read: no further column
of any name is carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideq.llm.common import written

START, END = np.uint64(0x53), np.uint64(0x45)
#: Classes of documents: counted, counted only once the weights are learned, not learned from.
KEPT, TUNING, HELD_OUT = 0, 1, 2
#: Buckets of context frequency for each order.
WIDTH = 64
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of each context followed by each word."""
    x = context * _A + word
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _C
    return x ^ (x >> np.uint64(32))


def planes(values: np.ndarray, least: int = 8) -> bytes:
    """64-bit values byte by byte, so that what neighbours share stands together and compresses; of the bytes above ``least`` no more than a value needs."""
    rows = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    width = 8
    while width > least and not rows[width - 1].any():
        width -= 1
    return rows[:width].tobytes()


def unplanes(data: bytes, kind: type, size: int | None = None) -> np.ndarray:
    """The values again; ``size`` says how many if they may have fewer than 8 bytes."""
    part = np.frombuffer(data, np.uint8).reshape(*((8, -1) if size is None else (-1, size)))
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, : len(part)] = part.T
    return out.view(kind).ravel()


class Grams:
    """All n-grams of some texts, each text between ``order`` - 1 starts and one end."""

    def __init__(self, texts: list[str], order: int):
        self.pads = order - 1
        words: list[bytes] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = text.encode().lower().split()
            sizes[i] = len(found)
            words.extend(found)
        hashes = {w: xxhash.xxh64_intdigest(w) for w in dict.fromkeys(words)}
        flat = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        self.sizes = sizes + 1  # words and the end
        self.doc = np.repeat(np.arange(len(texts)), self.sizes + self.pads)
        first = np.concatenate(([0], np.cumsum(self.sizes + self.pads)))[:-1]
        self.place = np.arange(len(self.doc)) - np.repeat(first, self.sizes + self.pads)
        seq = np.full(len(self.doc), START, dtype=np.uint64)
        last = first + self.sizes + self.pads - 1
        is_word = self.place >= self.pads
        is_word[last] = False
        seq[is_word] = flat
        seq[last] = END
        self.keys = [seq]  # by order; without meaning at places before the order's first
        for _ in range(1, order):
            self.keys.append(np.concatenate(([START], mix(self.keys[-1][:-1], seq[1:]))) if len(seq) else seq)

    def counted(self, k: int) -> np.ndarray:
        """Places whose n-gram of order ``k`` (from 1) is counted: of lower orders also the last start, which is a context."""
        return np.flatnonzero(self.place >= (self.pads if k > self.pads else self.pads - 1))


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The number of each key's range; it grows with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def slices(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of each range that holds any of the sorted keys."""
    home = range_of(keys, ranges)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(home)) + 1, [len(home)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b > a:
            yield int(home[a]), a, b


def _messages(blocks: DataFrame, order: int, ranges: int, orders: range) -> DataFrame:
    """(range, block, kind, keys, counts) of each block and range with common n-grams of ``orders``."""

    def send(batch: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(batch["text"].tolist(), order)
        times = batch["copies"].to_numpy(np.int64)
        weigh = bool((times != 1).any())
        rows = []
        for k in orders:
            at = grams.counted(k)
            keys = grams.keys[k - 1][at]
            by = np.argsort(keys)
            keys = keys[by]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts = np.add.reduceat(times[grams.doc[at]][by], starts) if weigh else np.diff(np.append(starts, len(keys)))
            keys = keys[starts]
            rows += [((k - 1) * ranges + r, planes(keys[a:b]), planes(counts[a:b], 1)) for r, a, b in slices(keys, ranges)]
        out = pd.DataFrame(rows, columns=["range", "keys", "counts"])
        return out.assign(block=batch["block"].iat[0], kind=batch["kind"].iat[0])[["range", "block", "kind", "keys", "counts"]]

    return blocks.groupBy("block").applyInPandas(send, "range long, block long, kind int, keys binary, counts binary")


def _answers(messages: DataFrame, ranges: int) -> DataFrame:
    """(block, range, kept, total): for each message the counts of its keys in the corpus, ``kept`` for tuning blocks alone; with block -1 the range's words: how many distinct, kept, tuning."""

    def add_up(batch: pd.DataFrame) -> pd.DataFrame:
        keys = [unplanes(x, np.uint64) for x in batch["keys"]]
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        counts = np.concatenate([unplanes(x, np.int64, n) for x, n in zip(batch["counts"], sizes.tolist())])
        kind = np.repeat(batch["kind"].to_numpy(np.int64), sizes)
        every = np.concatenate(keys)
        by = np.argsort(every)
        every = every[by]
        new = np.concatenate(([True], every[1:] != every[:-1]))
        starts = np.flatnonzero(new)
        kept, tuning = (np.add.reduceat(np.where(kind[by] == k, counts[by], 0), starts) for k in (KEPT, TUNING))
        total = kept + tuning
        which = np.empty(len(by), dtype=np.int64)
        which[by] = np.cumsum(new) - 1
        ends = np.cumsum(sizes)
        number = int(batch["range"].iat[0])
        held = [planes(kept[which[a:b]], 1) if k == TUNING else None for k, a, b in zip(batch["kind"].tolist(), (ends - sizes).tolist(), ends.tolist())]
        rows = [(block, number, part, planes(total[which[a:b]], 1), None) for block, part, a, b in zip(batch["block"].tolist(), held, (ends - sizes).tolist(), ends.tolist())]
        if number < ranges:
            word = every[starts] != START
            kept, tuning = kept[word], tuning[word]
            rows.append((-1, number, None, None, [int((kept + tuning > 0).sum()), int(kept.sum()), int(tuning.sum())]))
        return pd.DataFrame(rows, columns=["block", "range", "kept", "total", "words"])

    return messages.groupBy("range").applyInPandas(add_up, "block long, range long, kept binary, total binary, words array<long>")


class Counted:
    """Of each token of a block its n-gram's and its context's count, by order from 1."""

    def __init__(self, texts: list[str], answers: pd.DataFrame, order: int, ranges: int, total: int, part: str):
        grams = Grams(texts, order)
        self.sizes = grams.sizes
        token = np.flatnonzero(grams.place >= grams.pads)
        answered = dict(zip(answers["range"].tolist(), answers[part]))
        here = []
        for k in range(1, order + 1):
            at = grams.counted(k)
            keys = grams.keys[k - 1][at]
            by = np.argsort(keys)
            keys = keys[by]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            found = [unplanes(answered[(k - 1) * ranges + r], np.int64, b - a) for r, a, b in slices(keys[new], ranges)]
            counts = np.zeros(len(grams.place), dtype=np.int64)
            counts[at[by]] = np.concatenate(found)[np.cumsum(new) - 1]
            here.append(counts)
        self.counts = [c[token] for c in here]
        self.contexts = [np.full(len(token), total), *(c[token - 1] for c in here[:-1])]

    def estimates(self) -> tuple[np.ndarray, np.ndarray]:
        """Each token's weight bucket, and its estimates by order: 0 beyond the longest seen context."""
        level = np.zeros(len(self.counts[0]), dtype=np.int64)
        seen = np.ones(len(level), dtype=np.int64)
        ratio = []
        for k, (count, context) in enumerate(zip(self.counts, self.contexts), 1):
            level[context > 0] = k
            seen = np.where(context > 0, context, seen)
            ratio.append(count / np.maximum(context, 1))
        return level * WIDTH + np.log2(seen).astype(np.int64), np.stack(ratio, axis=1)


def uniform(order: int) -> np.ndarray:
    """Weights by bucket: as much for each order whose context was seen, and for any word."""
    level = np.arange((order + 1) * WIDTH)[:, None] // WIDTH
    allowed = np.arange(order + 1)[None, :] <= level
    return allowed / allowed.sum(axis=1, keepdims=True)


def learn(estimates: DataFrame, order: int, any_word: float, rounds: int = 25, least_gain: float = 1e-4) -> np.ndarray:
    """Weights by bucket that make (bucket, f1, f2, ..., n) likeliest: one grouped sum a round, until a token gains under ``least_gain``.

    Each allowed weight starts from and keeps one token of its own, so that no word's probability is 0.
    """
    weights, before = uniform(order), -math.inf
    allowed = weights > 0
    spark = estimates.sparkSession
    names = [f"l{k}" for k in range(order + 1)]
    for _ in range(rounds):
        known = F.broadcast(spark.createDataFrame([(b, *map(float, row)) for b, row in enumerate(weights)], f"bucket long, {', '.join(f'{n} double' for n in names)}"))
        parts = [F.col("l0") * any_word, *(F.col(f"l{k}") * F.col(f"f{k}") for k in range(1, order + 1))]
        p = sum(parts[1:], parts[0])
        shares = estimates.join(known, "bucket").groupBy("bucket").agg(*(F.sum(F.col("n") * part / p).alias(n) for part, n in zip(parts, names)), F.sum(F.col("n") * F.log(p)).alias("gain"), F.sum("n").alias("n"))
        rows = shares.collect()  # at most one row a bucket
        if not rows:
            break
        masses = allowed.astype(float)
        for r in rows:
            masses[r["bucket"]] += [r[n] for n in names]
        weights = masses / masses.sum(axis=1, keepdims=True)
        likely = sum(r["gain"] for r in rows) / sum(r["n"] for r in rows)
        if likely - before < least_gain:
            break
        before = likely
    return weights


def held_out(remainder: int = 2, of: int = 7) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of == remainder


def score_texts(docs: DataFrame, held: Column | None = None, order: int = 3, block_chars: int = 3_000_000, tuning_of: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of ``docs`` (doc_id, text); ``held`` says which rows aren't learned from.

    One in ``tuning_of`` training texts, by a hash of the text, is held back for the weights.
    """
    kind = F.when(F.col("held_out"), HELD_OUT).when(F.pmod(F.xxhash64("text"), F.lit(tuning_of)) == 0, TUNING).otherwise(KEPT)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (held_out() if held is None else held).alias("held_out"))
    row = ["doc_id", "held_out", F.xxhash64("text").alias("h"), F.length("text").alias("l")]
    repeated = rows.groupBy(*row).count().where("count > 1").limit(1).count() > 0
    rows = rows.groupBy("doc_id", "text", "held_out").agg(F.count("*").alias("copies")) if repeated else rows.withColumn("copies", F.lit(1).cast("long"))
    rows = rows.withColumn("kind", kind)
    sizes = {r["kind"]: r["chars"] for r in rows.groupBy("kind").agg(F.sum(F.length("text") + 2).alias("chars")).collect()}
    several = F.create_map(*(F.lit(x) for k in (KEPT, TUNING, HELD_OUT) for x in (k, sizes.get(k, 0) // block_chars + 1)))
    ranges = sum(sizes.values()) // block_chars + 1
    number = F.pmod(F.xxhash64("doc_id", "text"), several[F.col("kind")])
    blocks = rows.withColumn("block", (F.col("kind").cast("long") * (1 << 40) + number))

    # the longest n-grams are the larger half of all: asked by themselves, so that the messages of the others have gone from the disks by then
    parts = [ks for ks in (range(1, order), range(order, order + 1)) if ks]
    answers = reduce(DataFrame.unionByName, [written(_answers(_messages(blocks, order, ranges, ks), ranges)) for ks in parts])
    words = answers.where("block = -1").agg(*(F.coalesce(F.sum(F.col("words")[i]), F.lit(0)) for i in range(3))).first()
    distinct, kept, tuning = map(int, words)
    any_word = 1 / (distinct + 1)
    counts = answers.where("block >= 0").select("block", "range", "kept", "total")

    names = [f"f{k}" for k in range(1, order + 1)]

    def tune(batch: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        times = batch["copies"].to_numpy(np.int64)
        counted = Counted(batch["text"].tolist(), found, order, ranges, kept, "kept")
        bucket, ratio = counted.estimates()
        # few tokens of one block are alike: Spark adds them up
        return pd.DataFrame({"bucket": bucket, **dict(zip(names, ratio.T)), "n": np.repeat(times, counted.sizes)})

    schema = f"bucket long, {', '.join(f'{n} double' for n in names)}, n long"
    of_tuning = F.col("block").between(TUNING << 40, (HELD_OUT << 40) - 1)
    seen = blocks.where(F.col("kind") == TUNING).groupBy("block").cogroup(counts.where(of_tuning).drop("total").groupBy("block")).applyInPandas(tune, schema)
    weights = learn(written(seen.groupBy("bucket", *names).agg(F.sum("n").alias("n"))), order, any_word)

    total = kept + tuning
    id_kind = docs.select("doc_id").dtypes[0][1]

    def score(batch: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        counted = Counted(batch["text"].tolist(), found, order, ranges, total, "total")
        bucket, ratio = counted.estimates()
        mixed = weights[bucket]
        p = mixed[:, 0] * any_word + (mixed[:, 1:] * ratio).sum(axis=1)
        words = counted.counts[0]
        starts = np.cumsum(counted.sizes) - counted.sizes
        of_doc = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame(
            {
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": counted.sizes, "n_known": of_doc((words > 0).astype(np.int64)), "train_tokens": total,
                "base_score": of_doc(np.log10((words + 1) / (total + distinct + 1))), "score": of_doc(np.log10(p)), "copies": batch["copies"],
            }
        )

    schema = f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, copies long"
    scored = blocks.groupBy("block").cogroup(counts.drop("kept").groupBy("block")).applyInPandas(score, schema)
    if repeated:
        scored = scored.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return scored.drop("copies")
