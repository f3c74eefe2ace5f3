import numpy as np

from tideq.llm import quality


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got["predicted"] == got["quality"]).mean() >= 0.95


def test_interaction_is_learnt():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x" * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    same = spark.createDataFrame([(2, 1), (2, None), (2, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.classify(docs, same).collect())
    assert quality.classify(docs.limit(0), same).count() == 0
