import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideq.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {g: min((x for x in members if x is not None), default=None) for g, members in groups.items()}
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_against_plain():
    for text in (None, "", "  \n", "One", "a b", "A b C", "the cat sat on the mat " * 9, "É é x y\x0bz w"):
        assert simhash.fingerprint_of(text) == plain_fingerprint(text), text


def test_components_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = dict(zip([r[0] for r in rows], components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows])))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("spread", [64, 6])
def test_shards_lose_no_link(spread):
    rng = np.random.default_rng(spread)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    flips = [{int(b) for b in rng.integers(0, 64, rng.integers(0, spread))} for _ in range(900)]
    fps = np.unique(np.array([int(centre) ^ sum(1 << b for b in some) for some in flips], dtype=np.uint64))
    forest = simhash.Forest(len(fps))
    for number, mask in enumerate(simhash.HALVES):
        tree = simhash.Tree(fps[::7], mask, 16, number)
        which, leaf, home = tree.route(fps, 1)
        assert np.array_equal(np.sort(which[home]), np.arange(len(fps)))
        for shard in np.unique(leaf):
            mine = leaf == shard
            roots = simhash.link(fps[which[mine]], home[mine], mask)
            forest.add(which[mine], which[mine][roots])
    want = components(list(range(len(fps))), [int(x) for x in fps])
    assert list(forest.fold()) == want


def test_odd_rows(spark):
    rows = spark.createDataFrame([(5, None, "x"), (3, "", "y"), (3, "", "y"), (None, "a b c d", "z"), (9, "a b c d", "z")], "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(rows).collect())
    assert got == [(0, 9), (3, 3), (3, 3), (5, 3), (9, 9)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
    assert rows.limit(1).select(simhash.hex_digits(F.lit(-1).cast("long"))).first()[0] == "f" * 16


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(a == b)


def test_similar_texts_against_all_pairs(spark):
    """Scattered edits, one crowded group among them: what stays, against components of all pairs."""
    rng = np.random.default_rng(7)
    texts = []
    for group in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5_000, rng.integers(40, 400))]
        for _ in range(40 if group == 0 else rng.integers(1, 6)):
            edits = rng.integers(0, len(words), max(1, len(words) // 120))
            texts.append(" ".join(f"e{x}" if i in edits else w for i, (w, x) in enumerate(zip(words, rng.integers(0, 5_000, len(words))))))
    sets = [set(simhash.shingle_hashes(text, 5).tolist()) for text in texts]
    fps = [simhash.fingerprint_of(text, 5) for text in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 or bin(fps[i] ^ fps[j]).count("1") <= 3:
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    print(links, len(texts), len(want), len(got - want))
    assert links > 400
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want))


def test_pairs_in_crowded_keys_against_all_pairs(spark):
    """Texts that share most of their words, like only in pairs: all keys of many pairs are crowded, and so are their finer keys."""
    rng = np.random.default_rng(11)
    words = lambda name, n: [f"{name}{x}" for x in rng.integers(0, 10**6, n)]
    common, texts = words("c", 600), []
    for _ in range(60):
        own = words("p", 60)
        texts += [" ".join(common + own + words("u", 40)) for _ in range(2)]
    sets = [set(simhash.shingle_hashes(text, 5).tolist()) for text in texts]
    links = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}
    assert links == {(i, i + 1) for i in range(0, 120, 2)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs, radius=0).collect()} == set(range(0, 120, 2))
    # parities bound the shingles in which two sets differ
    odd = [simhash.odd_classes(np.array(sorted(s), dtype=np.uint64)) for s in sets]
    assert all(np.bitwise_count((odd[i] ^ odd[0]).view(np.uint64)).sum() <= len(sets[i] ^ sets[0]) for i in range(120))
