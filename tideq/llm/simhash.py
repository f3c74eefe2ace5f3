"""Near duplicates by SimHash fingerprints, searched with vantage-point trees.

A fingerprint has 64 bits; two documents link if theirs differ in at most
``radius`` bits (3). Exact copies share a fingerprint and are folded first, so
that the search sees each fingerprint once.

Two fingerprints at 3 bits or fewer differ in at most one bit of one of their
two halves. So there are two trees, one for each half, whose nodes split by the
Hamming distance of that half to a vantage point; a search of radius 1 goes
down both sides of a node only near its boundary. (Over all 64 bits the radius
is 3, and for even fingerprints over half of the queries would lie at each
boundary.) The driver builds the upper levels from a bounded sample; they only
decide which shard gets what and lose no pair whatever the sample was. Each
fingerprint has a home shard in each tree and is also sent, as a query, to the
shards that its ball overlaps. Within a shard the same splitting goes on, by
the half and then by all bits, down to blocks that are compared exactly. A shard returns
a spanning forest of its links, not the pairs.

:func:`one_of_each` has to find similar shingle sets (Jaccard 0.8), which differ
in about 10 of 64 bits; no tree prunes at that radius. To the trees' links it
adds those of equal parts: the range of hashes is cut into ``PARTS`` parts, and
the ``LEAST`` smallest of a text's hashes in a part make a key. Two texts of
similarity 0.8 share a given key at odds of 0.8 ** LEAST, and one of all keys at
over 0.99. Texts under one key are compared if they are at most ``CROWD``; in a
more crowded key each meets the smallest and the largest, and what is like
neither is cut finer by a second key of its own and met in the same way; that
brings most of a group together. Then all texts of a crowded key that aren't in
one group yet are compared, in tiles, so that no link between groups is lost;
the parities of their shingles in ``64 * ODD`` classes, which bound what two
sets can have in common, go before. Each
pair is verified by its whole shingle sets, in Spark, hubs being salted.

Defined results: null and empty texts, and texts without words, have the
fingerprint zero and link like any other; rows with equal ids or texts are all
returned; a null id takes part but is never a component's smallest id. An empty
table gives an empty result. Columns beyond the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideq.llm.common import broadcast_within, checkpointed, connected_components, free_name, written

#: Masks of the two trees.
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)
ALL_BITS = 0xFFFFFFFFFFFFFFFF
#: Fingerprints that the driver takes to build the upper levels of the trees.
SAMPLE = 32_768
#: Fingerprints that a home shard should get.
SHARD = 8_192
#: Pairs that are compared at once.
BLOCK = 1 << 19
#: Parts of the range of hashes, and hashes of a part that make a key.
PARTS, LEAST = 12, 4
#: Texts under a key that are all compared.
CROWD = 8
#: Pairs of one hub that meet one copy of its shingles.
HUB = 256
#: Texts outside its largest group that one task compares with all texts of a crowded key.
TILE = 1024
#: Columns of 64 bits each that tell which of so many classes of shingles a text has an odd number of.
ODD = 16


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """Unsigned XXH64 of each shingle, repeats included; of all words if they are fewer; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    end = start + sizes - 1
    n = len(words) - shingle + 1
    return np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(start[:n].tolist(), end[shingle - 1 :].tolist())), dtype=np.uint64, count=n
    )


def majority(hashes: np.ndarray) -> int:
    """The bits that are in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[part : part + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is in over half of the shingles' hashes."""
    return majority(shingle_hashes(text, shingle))


def part_keys(distinct: np.ndarray) -> list[int]:
    """A signed key for each part that holds any of the sorted ``distinct`` hashes, of its smallest ones."""
    cuts = np.searchsorted(distinct, np.array([(k << 64) // PARTS for k in range(PARTS)], dtype=np.uint64))
    parts = (distinct[a : min(b, a + LEAST)] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(distinct)]))
    return [xxhash.xxh64_intdigest(part.tobytes(), 42) - (1 << 63) for part in parts if len(part)]


def odd_classes(distinct: np.ndarray) -> np.ndarray:
    """Of each class of hashes whether there is an odd number of the ``distinct`` ones, as bits of ``ODD`` signed longs: two sets differ in at least as many hashes as bits."""
    counts = np.bincount((distinct & np.uint64(64 * ODD - 1)).astype(np.int64), minlength=64 * ODD)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(text, shingle) for text in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(text_col).alias("fp"))


class Tree:
    """Upper levels of a vantage-point tree over the bits of ``mask``."""

    def __init__(self, sample: np.ndarray, mask: int, leaves: int, seed: int = 0):
        self.mask = np.uint64(mask)
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, threshold, inside, outside; a leaf is ~number
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._build(np.unique(sample & self.mask), leaves, rng)

    def _build(self, points: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        if leaves > 1 and len(points) > 1:
            vantage = points[rng.integers(len(points))]
            far = np.bitwise_count(points ^ vantage).astype(np.int64)
            cut = int(np.sort(far)[(len(far) - 1) // 2])
            inside = far <= cut
            if not inside.all():
                at = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                pair = [self._build(points[x], half, rng) for x, half in ((inside, leaves // 2), (~inside, leaves - leaves // 2))]
                self.nodes[at] = (int(vantage), cut, *pair)
                return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``fps``, their leaf, and whether that leaf is home, for all leaves that the balls overlap."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(self.root, np.arange(len(fps)), np.ones(len(fps), dtype=bool))]
        while todo:
            node, which, home = todo.pop()
            if node < 0:
                out.append((which, ~node, home))
                continue
            if not len(which):
                continue
            vantage, cut, inside, outside = self.nodes[node]
            far = np.bitwise_count((fps[which] ^ np.uint64(vantage)) & self.mask).astype(np.int64)
            go = far - radius <= cut
            todo.append((inside, which[go], home[go] & (far[go] <= cut)))
            go = far + radius > cut
            todo.append((outside, which[go], home[go] & (far[go] > cut)))
        return (
            np.concatenate([w for w, _, _ in out]),
            np.concatenate([np.full(len(w), leaf, dtype=np.int64) for w, leaf, _ in out]),
            np.concatenate([h for _, _, h in out]),
        )


class Forest:
    """Spanning forest of links between positions, folded when many have come together."""

    def __init__(self, n: int, most: int = 1 << 20):
        self.label, self.held, self.count, self.most = np.arange(n), [], 0, most

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.held.append((u, v))
            self.count += len(u)
            if self.count > self.most:
                self.fold()

    def fold(self) -> np.ndarray:
        """Smallest position reachable from each position."""
        if self.held:
            u, v = (np.concatenate(x) for x in zip(*self.held))
            label = self.label
            while True:
                a, b = label[u], label[v]
                differ = a != b
                if not differ.any():
                    break
                u, v, a, b = u[differ], v[differ], a[differ], b[differ]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (deeper := label[label]).tobytes() != label.tobytes():
                    label = deeper
            self.label, self.held, self.count = label, [], 0
        return self.label


def link(fps: np.ndarray, home: np.ndarray, mask: int, radius: int = 3, half_radius: int = 1, seed: int = 0) -> np.ndarray:
    """Smallest position linked to each of ``fps`` by pairs of a home fingerprint and any other."""
    forest, rng = Forest(len(fps)), np.random.default_rng(seed)
    todo = [(np.flatnonzero(home), np.arange(len(fps)), np.uint64(mask), half_radius, 0)]
    while todo:
        inner, asked, bits, reach, failed = todo.pop()
        if not len(inner) or not len(asked):
            continue
        if len(inner) * len(asked) > BLOCK and len(inner) > 64:
            vantage = fps[inner[rng.integers(len(inner))]]
            near = np.bitwise_count((fps[inner] ^ vantage) & bits).astype(np.int64)
            cut = int(np.sort(near)[(len(near) - 1) // 2])
            inside = near <= cut
            if inside.all() and failed < 3:
                todo.append((inner, asked, np.uint64(ALL_BITS), radius, failed + 1))
                continue
            if not inside.all():
                far = np.bitwise_count((fps[asked] ^ vantage) & bits).astype(np.int64)
                todo.append((inner[inside], asked[far - reach <= cut], bits, reach, 0))
                todo.append((inner[~inside], asked[far + reach > cut], bits, reach, 0))
                continue
        step = max(1, BLOCK // len(inner))
        for start in range(0, len(asked), step):
            part = asked[start : start + step]
            u, v = np.nonzero(np.bitwise_count(fps[inner][:, None] ^ fps[part][None, :]) <= radius)
            u, v = inner[u], part[v]
            other = u != v
            forest.add(u[other], v[other])
    return forest.fold()


def _links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) between fingerprints that connect what links within ``radius`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    taken = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    leaves = max(1, min(len(taken) // 8, -(-n // SHARD)))
    half_radius = radius // 2
    trees = spark.sparkContext.broadcast([Tree(taken, mask, leaves, seed) for seed, mask in enumerate(HALVES)])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(dtype=np.int64)
            for number, tree in enumerate(trees.value):
                which, leaf, home = tree.route(fps.view(np.uint64), half_radius)
                yield pd.DataFrame({"tree": number, "leaf": leaf, "fp": fps[which], "home": home})

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("fp", kind="stable")
        fps = shard["fp"].to_numpy(dtype=np.int64)
        roots = link(fps.view(np.uint64), shard["home"].to_numpy(dtype=bool), HALVES[int(shard["tree"].iloc[0])], radius, half_radius)
        linked = roots != np.arange(len(fps))
        return pd.DataFrame({"u": fps[linked], "v": fps[roots[linked]]})

    routed = distinct.select("fp").mapInPandas(route, "tree int, leaf long, fp long, home boolean")
    return routed.groupBy("tree", "leaf").applyInPandas(search, "u long, v long").distinct()


def _grouped(marked: DataFrame, radius: int, more: DataFrame | None = None) -> DataFrame:
    """fp, root, least_id of each distinct fingerprint of ``marked`` (doc_id, fp); root is the fingerprint that stands for its component.

    ``more`` has links (u, v) of fingerprints beside those within ``radius``.
    """
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    links = _links(distinct, radius)
    roots = connected_components(links if more is None else links.unionByName(more)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id (smallest doc_id reachable), for every row of ``docs``."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    placed = _grouped(marked, radius)
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = placed.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether two sets' sizes allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity)


def _met(keys: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of texts to verify, of ``keys`` (key, t, n); and the texts of crowded keys with the smallest and largest of these (lo, hi).

    A crowded key's hub is the pair's v.
    """

    shared = keys.groupBy("key").agg(F.count("*").alias("k"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.min_by("n", "t").alias("lo_n"), F.max_by("n", "t").alias("hi_n"))
    shared = written(shared.where("k > 1"))
    two = shared.where((F.col("k") == 2) & _alike("lo_n", "hi_n", similarity)).select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    members = written(keys.join(shared.where("k > 2"), "key"))
    few = members.where(F.col("k") <= CROWD).select("key", F.col("t").alias("u"), F.col("n").alias("u_n"))
    some = few.join(few.select("key", F.col("u").alias("v"), F.col("u_n").alias("v_n")), "key").where((F.col("u") < F.col("v")) & _alike("u_n", "v_n", similarity))
    crowded = members.where(F.col("k") > CROWD)
    hubs = (crowded.where((F.col("t") != F.col(end)) & _alike("n", f"{end}_n", similarity)).select(F.col("t").alias("u"), F.col(end).alias("v")) for end in ("lo", "hi"))
    return reduce(DataFrame.unionByName, (x.select("u", "v") for x in (two, some, *hubs))).distinct(), crowded


def _apart(crowded: DataFrame, groups: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of texts of a crowded key in different ones of ``groups`` (node, root), whose sizes and parities allow the similarity.

    One text of each such pair is outside the key's largest group: these texts are dealt to tiles, and each tile meets all texts of the key.
    """
    members = written(crowded.select("key", "t", "n").join(groups.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t")))
    largest = members.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("all"), F.max(F.struct("k", "root")).alias("largest"))
    tiles = largest.select("key", F.col("largest.root").alias("top"), F.ceil((F.col("all") - F.col("largest.k")) / TILE).cast("int").alias("tiles"))
    tiles = written(tiles.where("tiles > 0"))
    open_keys = members.join(broadcast_within(tiles, 500_000), "key").join(texts.select("t", "odd"), "t")
    sides = {"u": F.pmod(F.xxhash64("t"), F.col("tiles")).cast("int"), "v": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))}
    u, v = (
        (open_keys.where("root <> top") if x == "u" else open_keys).select(
            "key", "top", tile.alias("tile"), F.col("t").alias(x), F.col("n").alias(f"{x}_n"), F.col("root").alias(f"{x}_root"), *(F.get("odd", F.lit(i)).alias(f"{x}_{i}") for i in range(ODD))
        )
        for x, tile in sides.items()
    )
    # the side whose texts of one key and tile are buffered comes second
    met = v.join(u.drop("top"), ["key", "tile"]).where((F.col("u_root") != F.col("v_root")) & ((F.col("v_root") == F.col("top")) | (F.col("u") < F.col("v"))))
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"u_{i}").bitwiseXOR(F.col(f"v_{i}"))) for i in range(ODD)))
    sizes = F.col("u_n") + F.col("v_n")
    common = F.floor((sizes - differ) / 2)
    near = met.where(_alike("u_n", "v_n", similarity) & (common >= (sizes - common) * F.lit(similarity)))
    return near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str, key: Column, shingle: int, similarity: float) -> DataFrame:
    """Of the pairs (u, v) of texts those whose shingle sets have the Jaccard similarity; ``rows`` (row, t) says which row of ``docs``, told by ``key``, holds a text."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(text, shingle)).view(np.int64) for text in texts])

    asked = written(pairs.groupBy("v").agg(F.count("*").alias("links")))
    wanted = pairs.select(F.col("u").alias("t")).unionByName(asked.select(F.col("v").alias("t"))).distinct()
    places = written(rows.join(wanted, "t").groupBy("t").agg(F.min("row").alias("row")))
    found = docs.select(key.alias("row"), F.col(text_col).alias("text")).join(broadcast_within(places, 500_000), "row").select("t", "text").dropDuplicates(["t"])
    sets = written(found.select("t", shingles("text").alias("s")))
    # a hub's shingles are copied for every so many of its links
    copies = F.ceil(F.col("links") / HUB).cast("int")
    hubs = sets.withColumnRenamed("t", "v").join(asked, "v").select("v", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.col("s").alias("b"))
    dealt = pairs.join(asked, "v").select("u", "v", F.pmod(F.xxhash64("u", "v"), copies).cast("int").alias("copy"))
    both = dealt.join(sets.select(F.col("t").alias("u"), F.col("s").alias("a")), "u").join(hubs, ["v", "copy"])
    sized = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("sizes"))
    return written(sized.where(F.col("common") >= (F.col("sizes") - F.col("common")) * F.lit(similarity)).select("u", "v"))


def _similar(docs: DataFrame, marked: DataFrame, text_col: str, key: Column, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) of fingerprints, of texts whose shingle sets are similar; ``marked`` has row, fp, t (the text's hash), n (shingles), keys, odd."""
    texts = written(marked.where(F.size("keys") > 0).groupBy("t").agg(*(F.min(c).alias(c) for c in ("fp", "n", "keys", "odd"))))
    pairs, crowded = _met(texts.select(F.explode("keys").alias("key"), "t", "n"), similarity)
    pairs, rows = written(pairs), marked.select("row", "t")
    first = _verified(pairs, docs, rows, text_col, key, shingle, similarity)

    # texts of a crowded key that are like neither its smallest nor its largest
    both = first.unionByName(first.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rest = crowded.where("t <> lo and t <> hi").select("key", "t", "n", "lo", "hi")
    for end in ("lo", "hi"):
        rest = rest.join(both.select(F.col("u").alias("t"), F.col("v").alias(end)), ["t", end], "left_anti")
    finer = rest.select("key", "t", "n").join(texts.select("t", "keys"), "t").select("key", "t", "n", F.explode("keys").alias("other")).where("key <> other")
    more, _ = _met(finer.select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "t", "n").distinct(), similarity)
    more = written(more.join(pairs, ["u", "v"], "left_anti"))
    second = _verified(more, docs, rows, text_col, key, shingle, similarity)
    found = first.unionByName(second)

    # texts of a crowded key that these haven't brought into one group
    apart = _apart(crowded, written(connected_components(found)), texts, similarity)
    last = written(apart.join(pairs, ["u", "v"], "left_anti").join(more, ["u", "v"], "left_anti"))
    found = found.unionByName(_verified(last, docs, rows, text_col, key, shingle, similarity))
    for end in "uv":
        found = found.join(texts.select(F.col("t").alias(end), F.col("fp").alias(f"{end}_fp")), end)
    return found.select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v")).where("u <> v").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null ids last), then of the smallest hash of the whole row.

    Texts link if their fingerprints are within ``radius`` bits or the Jaccard
    similarity of their shingle sets is at least ``similarity``.
    Rows are told apart by a hash of all their columns, not by their ids; of
    wholly equal rows one stays. Extra columns of any name are carried along.
    """
    row, fate = free_name(docs, "row"), free_name(docs, "fate")
    key = F.xxhash64(*(F.to_json(F.col(c)) if kind.startswith("map") else F.col(c) for c, kind in docs.dtypes))

    @F.pandas_udf("fp long, t long, n long, keys array<long>, odd array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        found = []
        for text in texts:
            hashes = shingle_hashes(text, shingle)
            distinct = np.unique(hashes)
            # the hashes' own hash: texts of equal shingles in equal order
            whole = xxhash.xxh64_intdigest(hashes.tobytes(), 42) - (1 << 63)
            found.append((np.uint64(majority(hashes)).view(np.int64), whole, len(distinct), part_keys(distinct), odd_classes(distinct)))
        return pd.DataFrame(found, columns=["fp", "t", "n", "keys", "odd"])

    marked = docs.select(key.alias("row"), F.col(id_col).cast("long").alias("doc_id"), sketch(text_col).alias("x"))
    marked = written(marked.select("row", "doc_id", "x.*"))
    links = _similar(docs, marked, text_col, key, shingle, similarity)
    placed = marked.join(_grouped(marked.select("doc_id", "fp"), radius, links).select("fp", "root"), "fp").groupBy("root", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    stays = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("stays"))
    # only rows that go, or of which there are several, are looked up
    fates = placed.join(stays, "root").select(F.col("row").alias(row), F.when(F.col("row") != F.col("stays.row"), F.lit(0)).when(F.col("n") > 1, F.lit(1)).alias(fate)).where(F.col(fate).isNotNull())
    fates = checkpointed(fates.groupBy(row).agg(F.max(fate).alias(fate)))
    told = docs.withColumn(row, key).join(broadcast_within(fates, 500_000), row, "left")
    several = told.where(F.col(fate) == 1).dropDuplicates([row])
    return told.where(F.col(fate).isNull()).unionByName(several).select(docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
