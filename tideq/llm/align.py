"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

In a task, texts are taken in chunks of bounded size. Both tokenizers' tokens become tables of
byte starts keyed by document; ``pandas.merge_asof`` finds for each token's start
the other side's token that covers it, and the union of both directions is all
overlaps. Overlaps of equal ends close a group. Each document keeps its distinct
linked id pairs; Spark counts in how many documents each pair is linked, and joins the
counts back. The pairs are at most one vocabulary times the other; their table
is broadcast only within a stated size and joined by a shuffle beyond it.

Defined results: null and empty texts, and texts that either tokenizer doesn't
give back byte by byte, have no tokens: zeros and no digest. Rows repeated in id
and text count as documents of their own; ids may be null; an empty table gives an
empty result; a text is never cut, however long. Only ``doc_id`` and ``text``
are read: no further column of any name is carried.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideq.llm.common import broadcast_within, written

#: Characters that are aligned at a time; a longer text is a chunk of its own.
CHUNK_CHARS = 1_000_000
#: Links of one group beyond which its distinct ids are counted first.
WIDE = 1 << 16


class Tokenizer:
    """Ids of texts, and the bytes of each id; ``prefix`` is what the tokenizer adds before a text by itself."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes], prefix: str):
        self.encode, self.bytes, self.prefix = encode, token_bytes, prefix
        self.sizes = np.array([len(b) for b in token_bytes], dtype=np.int64)
        self.shown = np.array([f"{i}{mark}" for mark in (",", "|", ";") for i in range(len(token_bytes))], dtype=object)


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE of a JSON file, its special tokens as plain text.

    If the file's merges make the ids one after the other, ids are ranks, and the
    faster of the two libraries gives the same ids.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    alphabet = byte_alphabet()
    special = {t["id"] for t in spec.get("added_tokens", [])}
    vocabulary = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
    token_bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
    merged = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in spec["model"]["merges"]]
    in_order = [spec["model"]["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged)))
    before = spec.get("pre_tokenizer") or {}
    if in_order and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and spec.get("normalizer") is None:
        import public_tokenizers
        import tiktoken

        known = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in vocabulary.items()}, special_tokens={})
        return Tokenizer(lambda texts: [known.encode_ordinary(t) for t in texts], token_bytes, "")
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return Tokenizer(lambda texts: [slow.encode(t, add_special_tokens=False).ids for t in texts], token_bytes, "")


@lru_cache(maxsize=4)
def pieces(path: str) -> Tokenizer:
    """A piece model, which writes a space as U+2581 and adds one before a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    shown = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    token_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
    return Tokenizer(lambda texts: model.encode(texts, num_threads=1), token_bytes, " ")


class Side:
    """One tokenizer's tokens of a chunk: ids, documents, byte starts and ends along the whole chunk."""

    def __init__(self, tokenizer: Tokenizer, ids: list[list[int]]):
        self.counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.fromiter((i for one in ids for i in one), np.int64, int(self.counts.sum()))
        self.doc = np.repeat(np.arange(len(ids)), self.counts)
        self.ends = np.cumsum(tokenizer.sizes[self.ids])
        self.starts = self.ends - tokenizer.sizes[self.ids]
        self.tokenizer = tokenizer

    def table(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "start": self.starts, name: np.arange(len(self.ids))})


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of tokens that share a byte: each start with the token that covers it, in both directions."""
    left, right = a.table("a"), b.table("b")
    there = pd.merge_asof(left, right, on="start", by="doc")
    back = pd.merge_asof(right, left, on="start", by="doc")
    new = b.starts != a.starts[back["a"].to_numpy()]  # equal starts stand in the first direction
    return np.concatenate((there["a"].to_numpy(), back["a"].to_numpy()[new])), np.concatenate((there["b"].to_numpy(), back["b"].to_numpy()[new]))


def groups(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides, numbered along the chunk."""
    at, bt = overlaps(a, b)
    closing = a.ends[at] == b.ends[bt]
    out = []
    for side, places in ((a, at[closing]), (b, bt[closing])):
        last = np.zeros(len(side.ids), dtype=np.int64)
        last[places] = 1
        out.append(np.cumsum(last) - last)
    return out[0], out[1]


def links(a: Side, b: Side, of_a: np.ndarray, of_b: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, id pair and number of links of each distinct linked id pair; a pair is a's id times the size of b's vocabulary, plus b's id."""
    width, span = len(b.tokenizer.bytes), len(a.tokenizer.bytes) * len(b.tokenizer.bytes)
    n = int(of_a[-1]) + 1 if len(of_a) else 0
    in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    first_b = np.cumsum(in_b) - in_b
    wide = in_a * in_b > WIDE
    reach = np.where(wide, 0, in_b)[of_a]
    total = int(reach.sum())
    step = np.arange(total) - np.repeat(np.cumsum(reach) - reach, reach)
    keys = np.repeat(a.doc * span + a.ids * width, reach) + b.ids[np.repeat(first_b[of_a], reach) + step]
    keys.sort()
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if total else np.zeros(0, dtype=np.int64)
    keys, times = keys[new], np.diff(np.append(new, total))
    for group in np.flatnonzero(wide).tolist():
        mine, yours = of_a == group, of_b == group
        ids_a, n_a = np.unique(a.ids[mine], return_counts=True)
        ids_b, n_b = np.unique(b.ids[yours], return_counts=True)
        doc = int(a.doc[np.argmax(mine)])
        keys = np.concatenate((keys, doc * span + (ids_a[:, None] * width + ids_b).ravel()))
        times = np.concatenate((times, (n_a[:, None] * n_b).ravel()))
    if wide.any():
        keys, which = np.unique(keys, return_inverse=True)
        times = np.bincount(which, weights=times).astype(np.int64)
    return keys // span, keys % span, times


def written_groups(a: Side, b: Side, of_a: np.ndarray, of_b: np.ndarray) -> list[str]:
    """Of each document its groups as text: ids of one side by commas, sides by a bar, groups by semicolons."""
    n_docs = len(a.counts)
    n = int(of_a[-1]) + 1 if len(of_a) else 0
    behind = np.concatenate(([0], np.cumsum(np.bincount(of_b, minlength=n))))
    before = np.concatenate(([0], np.cumsum(np.bincount(of_a, minlength=n))))
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (of_a, of_b))
    out = np.empty(len(of_a) + len(of_b), dtype=object)
    size_a, size_b = len(a.tokenizer.bytes), len(b.tokenizer.bytes)
    out[np.arange(len(of_a)) + behind[of_a]] = a.tokenizer.shown[a.ids + size_a * last_a]
    out[np.arange(len(of_b)) + before[of_b + 1]] = b.tokenizer.shown[b.ids + 2 * size_b * last_b]
    parts = out.tolist()
    edges = np.concatenate(([0], np.cumsum(a.counts + b.counts))).tolist()
    return ["".join(parts[edges[i] : edges[i + 1]])[:-1] for i in range(n_docs)]


def ids_of(tokenizer: Tokenizer, texts: list[str]) -> list[list[int]]:
    """Ids by text; none where their bytes aren't a space and the text."""
    filled = [i for i, text in enumerate(texts) if text]
    found: list[list[int]] = [[] for _ in texts]
    before = " ".removesuffix(tokenizer.prefix) if tokenizer.prefix else " "
    for i, ids in zip(filled, tokenizer.encode([before + texts[i] for i in filled])):
        if b"".join(map(tokenizer.bytes.__getitem__, ids)) == b" " + texts[i].encode():
            found[i] = ids
    return found


def align(texts: list[str], first: Tokenizer, second: Tokenizer) -> pa.RecordBatch:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of each text; pairs are distinct, with their links in times."""
    ids = [ids_of(t, texts) for t in (first, second)]
    both = [bool(x and y) for x, y in zip(*ids)]
    a, b = (Side(t, [x if ok else [] for x, ok in zip(one, both)]) for t, one in zip((first, second), ids))
    of_a, of_b = groups(a, b)
    doc, pair, times = links(a, b, of_a, of_b, len(texts))
    n_groups = np.bincount(a.doc, weights=np.append(of_a[1:] != of_a[:-1], True)[: len(of_a)], minlength=len(texts)).astype(np.int64)
    n_links = np.bincount(doc, weights=times, minlength=len(texts)).astype(np.int64)
    digests = [hashlib.sha256(t.encode()).hexdigest() if ok else "" for t, ok in zip(written_groups(a, b, of_a, of_b), both)]
    offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pair, times)]
    values = [pa.array(x, pa.int64()) for x in (a.counts, b.counts, n_groups, n_links)]
    return pa.RecordBatch.from_arrays([*values, pa.array(digests, pa.string()), *lists], names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def aligned(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of ``docs`` (doc_id, text): what a document holds by itself."""
    kind = docs.select("doc_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_level(json_path), pieces(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in chunks(texts):
                out = align(texts[start:end], first, second)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *out.columns], names=["doc_id", *out.schema.names])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): in how many rows each pair is linked, and whether no pair of the same first id is in more; ``width`` is the size of the second vocabulary."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")).withColumn("a", F.call_function("div", F.col("pair"), F.lit(width)))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, json_path: str, model_path: str, most_pairs: int = 3_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) what ``aligned`` tells, with n_best and count_sum in the place of pairs and times.

    ``most_pairs``: pairs that are broadcast at most.
    """
    rows = written(aligned(docs, json_path, model_path).withColumn("row", F.monotonically_increasing_id()))  # numbers are fixed by writing them
    known = written(pair_counts(rows, len(pieces(model_path).bytes)))
    every = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    counted = every.join(broadcast_within(known, most_pairs, F.lit(17), 64_000_000), every["pairs"] == known["pair"])
    sums = counted.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "row", "left").drop("row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
