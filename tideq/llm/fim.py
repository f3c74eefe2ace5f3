"""Fill-in-middle transformation with piece tables.

A batch of documents is a table of descriptors (buffer, start, length) over two
kinds of immutable buffers: the documents' texts and the sentinels. A cut splits
a descriptor, an arrangement permutes descriptors, and no text is copied until the
pieces are streamed into a hash or an output. What was arranged is read back from
the output alone: the sentinels found there give descriptors over the output, and
the inverse permutation puts them in their first order.

Defined results: a null text counts as empty; an empty text, or one that holds a
sentinel, stays plain; a null id draws as the empty text; repeated rows and ids
give equal rows; an empty table gives an empty result; positions are code points.
Only ``doc_id`` and ``text`` are read: no further column of any name is carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: The forms and the order in which each has prefix, middle, suffix (0 to 2) and the three sentinels (3 to 5).
FORMS = {"plain": (0, 1, 2, 3, 4, 5), "psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
#: Code points that are encoded at a time.
CHUNK = 1 << 20
_BUFFER = "".join(SENTINELS)
_STARTS = np.cumsum([0, *map(len, SENTINELS)])


class Pieces:
    """Descriptors, one row a document: ``buffer`` 0 is the document's own text, 1 the sentinels."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.buffer, self.start, self.length = buffer, start, length

    @classmethod
    def whole(cls, sizes: np.ndarray) -> Pieces:
        """One piece for each document of so many code points."""
        sizes = np.asarray(sizes, dtype=np.int64)[:, None]
        return cls(np.zeros_like(sizes), np.zeros_like(sizes), sizes)

    def cut(self, at: np.ndarray) -> Pieces:
        """Each row's piece around position ``at`` split in two there; a cut at an end makes an empty piece."""
        ends = np.cumsum(self.length, axis=1)
        hit = np.minimum((ends < at[:, None]).sum(axis=1), self.length.shape[1] - 1)
        rows = np.arange(len(at))
        column = np.arange(self.length.shape[1] + 1)
        source = column[None, :] - (column[None, :] > hit[:, None])
        buffer, start, length = (np.take_along_axis(x, source, axis=1) for x in (self.buffer, self.start, self.length))
        left = at - (ends[rows, hit] - self.length[rows, hit])
        length[rows, hit] = left
        length[rows, hit + 1] -= left
        start[rows, hit + 1] += left
        return Pieces(buffer, start, length)

    def with_sentinels(self, used: np.ndarray) -> Pieces:
        """The three sentinels behind each row's pieces, of no length where not ``used``."""
        shape = (len(used), len(SENTINELS))
        sizes = np.where(used[:, None], np.diff(_STARTS)[None, :], 0)
        more = Pieces(np.ones(shape, dtype=np.int64), np.broadcast_to(_STARTS[:-1], shape), sizes)
        return Pieces(*(np.concatenate(x, axis=1) for x in ((self.buffer, more.buffer), (self.start, more.start), (self.length, more.length))))

    def arranged(self, order: np.ndarray) -> Pieces:
        """Each row's pieces in the order of its row of ``order``."""
        return Pieces(*(np.take_along_axis(x, order, axis=1) for x in (self.buffer, self.start, self.length)))

    def stream(self, row: int, text: str) -> Iterator[str]:
        for buffer, start, length in zip(self.buffer[row].tolist(), self.start[row].tolist(), self.length[row].tolist()):
            whole = _BUFFER if buffer else text
            for at in range(start, start + length, CHUNK):
                yield whole[at : min(at + CHUNK, start + length)]


def digest(pieces: Iterator[str]) -> str:
    """Hex SHA-256 of the pieces' UTF-8, piece by piece."""
    seen = hashlib.sha256()
    for piece in pieces:
        seen.update(piece.encode())
    return seen.hexdigest()


def orders(forms: np.ndarray) -> np.ndarray:
    return np.array([FORMS[form] for form in forms], dtype=np.int64).reshape(-1, 6)


def inverse(order: np.ndarray) -> np.ndarray:
    """The permutation that puts back what ``order`` has arranged."""
    return np.argsort(order, axis=1)


def arrange(texts: list[str], first: np.ndarray, second: np.ndarray, forms: np.ndarray) -> Pieces:
    """The output's descriptors: each text cut at ``first`` <= ``second`` and arranged by its form."""
    cut = Pieces.whole(np.fromiter(map(len, texts), np.int64, len(texts))).cut(first).cut(second)
    return cut.with_sentinels(forms != "plain").arranged(orders(forms))


def read_back(outputs: list[str], forms: np.ndarray) -> Pieces:
    """Descriptors over the outputs, in the order of the original text."""
    found = np.zeros((len(outputs), 6, 2), dtype=np.int64)  # start and length, in the order of the output
    for i, (output, form) in enumerate(zip(outputs, forms)):
        if form == "plain":
            found[i, 0, 1] = len(output)
            continue
        at, places = 0, np.argsort(FORMS[form])[3:]
        for place, sentinel in sorted(zip(places.tolist(), SENTINELS)):
            start = output.index(sentinel, at)
            found[i, place] = start, len(sentinel)
            at = start + len(sentinel)
        starts = found[i, ::2].sum(axis=1)  # sentinels and texts take turns
        found[i, 1::2, 0] = starts
        found[i, 1::2, 1] = np.append(found[i, 2::2, 0], len(output)) - starts
    back = Pieces(np.zeros(found.shape[:2], dtype=np.int64), found[:, :, 0], found[:, :, 1]).arranged(inverse(orders(forms)))
    return Pieces(back.buffer[:, :3], back.start[:, :3], back.length[:, :3])


def _draw(k: int) -> Column:
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, arranged_share: int = 90, spm_share: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256 of ``docs`` (doc_id, text); shares in percent.

    Cuts and form are drawn from a hash of the id, so a lost task draws them again alike.
    """
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(_draw(k).alias(f"h{k + 1}") for k in range(4)))
    kind = docs.select("doc_id").dtypes[0][1]

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            h = batch[["h1", "h2", "h3", "h4"]].to_numpy(np.int64)
            a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            holds = np.fromiter((any(s in text for s in SENTINELS) for text in texts), bool, len(texts))
            plain = (n == 0) | holds | (h[:, 2] % 100 >= arranged_share)
            forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_share, "spm", "psm")).astype(object)
            first, second = np.minimum(a, b), np.maximum(a, b)
            pieces = arrange(texts, first, second, forms)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n": n,
                    "form": forms,
                    "prefix_chars": pd.Series(first, dtype="Int64").mask(plain),
                    "middle_chars": pd.Series(second - first, dtype="Int64").mask(plain),
                    "output": ["".join(pieces.stream(i, text)) for i, text in enumerate(texts)],
                    "output_sha256": [digest(pieces.stream(i, text)) for i, text in enumerate(texts)],
                }
            )

    return drawn.mapInPandas(transform, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def restored(outputs: DataFrame, with_text: bool = True) -> DataFrame:
    """``outputs`` (output, form and more) with text, if wanted, and restored_sha256 in the place of output: what output and form alone give back."""
    kept = [c for c in outputs.columns if c != "output"]
    more = [("text", "string")] * with_text + [("restored_sha256", "string")]

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["output"].tolist()
            pieces = read_back(texts, batch["form"].to_numpy(object))
            out = batch[kept].copy()
            if with_text:
                out["text"] = ["".join(pieces.stream(i, text)) for i, text in enumerate(texts)]
            out["restored_sha256"] = [digest(pieces.stream(i, text)) for i, text in enumerate(texts)]
            yield out

    types = dict(outputs.dtypes)
    return outputs.mapInPandas(restore, ", ".join(f"`{c}` {t}" for c, t in [*((c, types[c]) for c in kept), *more]))
