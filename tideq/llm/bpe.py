"""Byte-level BPE encoding and decoding with numpy matrices of equally long pieces.

A text is cut by the tokenizer's pattern. Pieces that a task has not met before
are put in buckets by length, each bucket a matrix with one row a piece. In
every round each row merges its leftmost pair of minimum rank, found by a hash
table of pairs, and the rows are closed up again. Rows that have no pair left
leave the matrix.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes; unpaired surrogates cannot occur in Spark strings; rows
may repeat; further columns are kept apart from the ones named here.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beyond this many bytes a piece is merged along a linked list with a heap, in
#: the same order of merges: a matrix as wide would take quadratic time.
WIDEST = 256
#: Pieces that a task remembers before it starts anew.
REMEMBERED = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What pads a row: as the left or right of a pair it is in no table.
PAD = 2**31 - 1
NEVER = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a byte-level vocabulary, and its pairs in an open-addressing table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.text = {rank: str(rank) for rank in self.token}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.pairs = pairs
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.size = 1 << bits
        self.keys = np.full(self.size, -1, dtype=np.int64)
        self.values = np.full(self.size, NEVER, dtype=np.int32)
        for key, rank in pairs.items():
            at = ((key * int(_MIX)) & (2**64 - 1)) >> int(self.shift)
            while self.keys[at] != -1:
                at = (at + 1) % self.size
            self.keys[at], self.values[at] = key, rank

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str) -> Vocabulary:
        """Reads a rank file: base64 of the token, a space, the rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; ``NEVER`` where the pair doesn't merge or is padding."""
        key = left.astype(np.int64) << 32 | right
        at = ((key.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NEVER)
        open_ = np.flatnonzero((found != key) & (found != -1))
        at, key = at[open_], key[open_]
        while open_.size:
            at = (at + 1) & (self.size - 1)
            found = self.keys[at]
            hit = found == key
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (found != -1)
            open_, at, key = open_[go], at[go], key[go]
        return out

    def merge_rows(self, rows: np.ndarray) -> list[list[int]]:
        """Token ids of each row of byte tokens, padded with ``PAD`` at the end.

        A round takes one cell out of every row that is left, so that all stay
        equally wide.
        """
        out: list[list[int]] = [[]] * len(rows)
        which, wide = np.arange(len(rows)), rows.shape[1]
        ranks = self.rank_of(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), wide - 1)
        while True:
            one = np.arange(len(which))
            best = ranks.argmin(axis=1) if wide > 1 else np.zeros(len(which), dtype=np.int64)
            lowest = ranks[one, best] if wide > 1 else np.full(len(which), NEVER)
            done = lowest == NEVER
            if done.any():
                ended = rows[done]
                for i, ids, n in zip(which[done].tolist(), ended.tolist(), (ended != PAD).sum(axis=1).tolist()):
                    out[i] = ids[:n]
                keep = ~done
                which, rows, ranks, best, lowest = which[keep], rows[keep], ranks[keep], best[keep], lowest[keep]
                if not len(which):
                    return out
                one = np.arange(len(which))
            rows[one, best] = lowest
            stays = np.ones(rows.shape, dtype=bool)
            stays[one, best + 1] = False
            rows = rows[stays].reshape(len(which), wide - 1)
            stays = stays[:, 1:]
            ranks = ranks[stays].reshape(len(which), wide - 2)
            wide -= 1
            for side in (-1, 0):
                at = best + side
                ok = np.flatnonzero((at >= 0) & (at < wide - 1))
                at = at[ok]
                ranks[ok, at] = self.rank_of(rows[ok, at], rows[ok, at + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one very long piece: lowest rank first, then leftmost."""
        import heapq

        ids = [int(self.byte[b]) for b in piece]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if 0 <= a and b < n and (new := rank((ids[a] << 32) | ids[b])) is not None:
                    heapq.heappush(heap, (new, a, ids[a], ids[b]))
        return [x for x, here in zip(ids, alive) if here]

    def encode_pieces(self, pieces: list[bytes], cells: int = 2_000_000) -> list[list[int]]:
        """Ids of each piece; a bucket's matrix has at most ``cells`` cells."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > WIDEST:
                out[i] = self.merge_long(piece)
            elif (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
            elif piece:
                buckets.setdefault((len(piece) + 3) // 4 * 4, []).append(i)
        for wide, members in buckets.items():
            step = max(1, cells // wide)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                flat = np.frombuffer(b"".join(pieces[i].ljust(wide, b"\0") for i in part), dtype=np.uint8)
                rows = self.byte[flat].reshape(len(part), wide)
                size = np.array([len(pieces[i]) for i in part])
                rows[np.arange(wide)[None, :] >= size[:, None]] = PAD
                for i, ids in zip(part, self.merge_rows(rows)):
                    out[i] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


#: Texts whose characters all lie below this one are cut by the standard library.
_NEAR = 0x250


def _near(pattern: str) -> Callable[[str], list[str]] | None:
    r"""The same cuts for texts of characters below ``_NEAR``: \p{L}, \p{N} and \s spelt out for ``re``, which is faster."""

    def spelt(shown: str) -> str:
        return "".join(rf"\u{c:04x}" for c in range(_NEAR) if regex.fullmatch(shown, chr(c)))

    letters, numbers, spaces = (spelt(x) for x in (r"\p{L}", r"\p{N}", r"\s"))
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\S", f"[^{spaces}]")
    out = out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]")
    return None if re.search(r"\\[^u]", out) else re.compile(out).findall


class Encoder:
    """Encodes batches of texts and remembers pieces between them."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self._cut, self._cut_near = vocabulary, regex.compile(pattern).findall, _near(pattern)
        self._is_far = re.compile(f"[^\0-{chr(_NEAR - 1)}]").search
        self.known: dict[str, list[int]] = {}

    def cut(self, text: str) -> list[str]:
        return self._cut(text) if self._cut_near is None or self._is_far(text) else self._cut_near(text)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        group: list[list[str]] = []
        held = 0
        for text in texts:
            group.append(self.cut(text))
            held += len(group[-1])
            if held > 200_000:
                yield from self._ids(group)
                group, held = [], 0
        yield from self._ids(group)

    def _ids(self, group: list[list[str]]) -> Iterator[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list({piece for pieces in group for piece in pieces} - self.known.keys())
        self.known.update(zip(new, self.vocabulary.encode_pieces([piece.encode() for piece in new])))
        get = self.known.__getitem__
        for pieces in group:
            yield [i for ids in map(get, pieces) for i in ids]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, ids (array<int>, or none if not ``with_ids``), n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary.load(path)
        encoder = Encoder(vocabulary, pattern)
        text_of = vocabulary.text.__getitem__
        for texts in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
            for ids in encoder.encode(["" if text is None else text for text in texts]):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(text_of, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                if with_ids:
                    out["ids"].append(np.array(ids, dtype=np.int32))
            yield pd.DataFrame(out)

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    encoded = F.pandas_udf(run, schema)
    return docs.select(F.col(id_col), encoded(text_col).alias("_encoded")).select(id_col, "_encoded.*")
