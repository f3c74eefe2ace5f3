import numpy as np

from tideq.llm import ann


def exact(rows, k=20, every=20):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    out = {}
    for i, v in fine:
        if i % every == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in rows.collect()])
    got = {}
    for r in ann.nearest(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    scores = {q: dict(x) for q, x in want.items()}
    assert all(abs(s - scores[q].get(i, s)) < 1e-12 for q, x in got.items() for i, s in x)


def test_many_cells_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 40)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]
    rows += [(600, None), (620, [0.0] * 6), (640, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (660, [float("nan")] * 6), (680, [1.0]), (None, [1.0] * 6), (7, rows[7][1])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=4, confidence=0.999).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact([r for r in rows if r[0] != 680 and r != rows[-1]])
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.97 * sum(map(len, want.values()))
    assert got[0] == [i for i, _ in want[0]]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.nearest(few).count() == 2 and ann.nearest(few.limit(0)).count() == 0


def test_chi_square():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_repeated_rows_hide_no_neighbour(spark):
    """Forty copies of the nearest row count once."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.standard_normal(6)]) for i in range(60)]
    query = np.array(rows[20][1])
    order = sorted((-float(np.dot(query, x)), i) for i, x in rows if i != 20)[:20]
    table = spark.createDataFrame(rows + [rows[order[0][1]]] * 40, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.nearest(table).where("query_id = 20").orderBy("rank").collect()]
    assert got == [i for _, i in order]
