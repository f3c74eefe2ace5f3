"""Benchmark decontamination: MinHash containment search, partitioned by size.

Texts become words (lower case, runs of letters and digits) and shingles of
``shingle`` words. Items are put in partitions by their number of shingles. For
each partition a document is cut into overlapping windows twice as long as the
partition's longest item, so that an item and a window have sizes of one order
however long the document is. Item and window are sketched by one-permutation
MinHash: of the hashes that fall in one bin the least is kept. An item becomes a
candidate for a document if they share the least hash of any bin, and is then
verified by counting its distinct shingles that the whole document has.

With two bins for each shingle of a window, a shingle in both is in both
sketches four times in five, so an item of 9 shingles with 0.8 of them in a
window is missed about once in ten thousand; items of more, far less often.
Partitions with smaller items get 64 bins a shingle.

Only DataFrame functions are used. The items' sketches are broadcast while they
are below a bound, and are joined by a shuffle beyond it, as are candidates.

Defined results: a text of fewer words than a shingle is one shingle, of all its
words, and matches only another such text with the same words; null and empty
texts and texts without words match nothing; rows with null ids are not
reported; of rows with equal ids the larger containment counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideq.llm.common import broadcast_within, checkpointed, free_name

#: Rows up to which one side of a join is broadcast.
SKETCHES = 500_000
CANDIDATES = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _starts(words: Column, shingle: int) -> Column:
    n = F.size(words)
    return F.when(n >= shingle, F.sequence(F.lit(0), n - shingle)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def shingle_texts(words: Column, shingle: int) -> Column:
    return F.transform(_starts(words, shingle), lambda i: F.array_join(F.slice(words, i + 1, shingle), " "))


def shingle_hashes(words: Column, shingle: int) -> Column:
    return F.transform(_starts(words, shingle), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(shingle))))


def _least_of_bins(hashes: Column, bits: int) -> Column:
    """Of each sorted array of hashes, the first of every bin (the upper ``bits``)."""
    return F.transform(
        hashes,
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 64 - bits) != F.shiftright(F.get(s, i - 1), 64 - bits))),
    )


def _sketch(hashes: Column, partition: int, longest: int, bits: int, whole: bool) -> Column:
    """Structs (part, least) of an array of hashes, in windows unless ``whole``."""
    n = F.size(hashes)
    starts = F.array(F.lit(0)) if whole else F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(longest))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda s: F.sort_array(hashes if whole else F.slice(hashes, s + 1, 2 * longest)))
    least = F.array_distinct(F.flatten(_least_of_bins(windows, bits)))
    return F.transform(least, lambda x: F.struct(F.lit(partition).alias("part"), x.alias("least")))


def _partitions(least: int, most: int) -> list[tuple[int, int, int]]:
    """(smallest, longest, bits) of each partition of item sizes, each of a factor of 8 at most."""
    out, low = [], least
    while low <= most:
        high = min(most, low * 8)
        bins = 2 * high * (2 if low > 8 else 64)
        out.append((low, high, max(1, (bins - 1).bit_length())))
        low = high + 1
    return out


def contained(
    docs: DataFrame, items: DataFrame, shingle: int = 5, at_least: float = 0.8,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, shared, n_shingles, containment for each item of which a document has ``at_least`` that share of shingles."""
    known = (
        items.where(F.col(item_id).isNotNull())
        .select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("w"))
        .select("item_id", F.array_distinct(shingle_texts(F.col("w"), shingle)).alias("texts"), F.array_distinct(shingle_hashes(F.col("w"), shingle)).alias("hashes"))
        .where(F.size("texts") > 0)
    )
    known = checkpointed(known)
    span = known.agg(F.min(F.size("hashes")).alias("least"), F.max(F.size("hashes")).alias("most")).first()
    parts = _partitions(span["least"], span["most"]) if span["least"] else []
    none = F.array().cast("array<struct<part:int,least:bigint>>")
    item_sketch, doc_sketch = none, none
    for number, (low, high, bits) in enumerate(parts):
        mine = _sketch(F.col("hashes"), number, high, bits, whole=True)
        item_sketch = F.when(F.size("hashes").between(low, high), mine).otherwise(item_sketch)
        doc_sketch = F.concat(doc_sketch, _sketch(F.col("hashes"), number, high, bits, whole=False))
    sketches = known.select("item_id", F.explode(item_sketch).alias("s")).select("item_id", "s.part", "s.least")

    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = named.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", shingle_hashes(F.col("w"), shingle).alias("hashes"))
    # an outer explode: a filter on the sketch's size would have it computed twice
    sketched = hashed.select("doc_id", F.explode_outer(doc_sketch).alias("s")).select("doc_id", "s.part", "s.least")
    candidates = checkpointed(sketched.join(broadcast_within(sketches, SKETCHES), ["part", "least"]).select("doc_id", "item_id").distinct())

    by_doc = candidates.groupBy("doc_id").agg(F.collect_list("item_id").alias("item_ids"))
    found = (
        named.join(broadcast_within(by_doc, CANDIDATES, F.octet_length(F.array_join(F.col("item_ids").cast("array<string>"), "")) + F.size("item_ids") * 16 + 32), "doc_id")
        .select("doc_id", "item_ids", words_of(F.col("text")).alias("w"))
        .select("doc_id", "item_ids", F.array_distinct(shingle_texts(F.col("w"), shingle)).alias("doc_texts"))
        .select("doc_id", "doc_texts", F.explode("item_ids").alias("item_id"))
        .join(broadcast_within(known.select("item_id", "texts"), CANDIDATES, F.octet_length(F.array_join("texts", "")) + F.size("texts") * 24), "item_id")
        .select("doc_id", "item_id", F.size(F.array_intersect("texts", "doc_texts")).alias("shared"), F.size("texts").alias("n_shingles"))
    )
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.max("shared").cast("long").alias("shared"), F.max("n_shingles").cast("long").alias("n_shingles"))
        .withColumn("containment", F.col("shared") / F.col("n_shingles"))
        .where(F.col("containment") >= at_least)
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` without the rows whose text contains an item.

    Rows are told apart by a hash of their text, so that null or repeated ids
    neither keep nor lose a row. Extra columns of any name are carried along.
    """
    mine = free_name(docs, "leaked")
    key = F.xxhash64(F.lit("|"), F.col(text_col))
    named = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    leaked = checkpointed(contained(named, items, **options).select(F.col("doc_id").alias(mine)).distinct())
    return docs.join(broadcast_within(leaked, CANDIDATES), key == F.col(mine), "left_anti")
