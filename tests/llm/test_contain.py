import re

from tideq.llm import contain


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def test_against_brute_force(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    known = {r.item_id: shingles(r.text) for r in items.collect()}
    want = set()
    for r in docs.collect():
        mine = shingles(r.text)
        want |= {(r.doc_id, i) for i, s in known.items() if s and len(s & mine) / len(s) >= 0.8}
    got = {(r.doc_id, r.item_id) for r in contain.contained(docs, items).collect()}
    assert want and got == want


def test_sizes_and_odd_rows(spark):
    words = [f"w{i}" for i in range(4000)]
    items = [(1, " ".join(words[:5])), (2, " ".join(words[100:130])), (3, " ".join(words[500:1500])), (4, "two words"), (5, None), (None, "x y z u v w"), (6, "")]
    rows = [(1, " ".join(words)), (2, "Two, WORDS!"), (3, "has two words in it and more"), (4, None), (None, " ".join(words)), (1, "other"), (5, " ".join(words[102:130]))]
    got = {(r.doc_id, r.item_id): r.containment for r in contain.contained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): 1.0, (2, 4): 1.0, (5, 2): 24 / 26}
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert contain.contained(docs, none).count() == 0 and contain.clean(docs, none).count() == len(rows)
