import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideq.llm import fim

ODD = ["", "a", "<P>", "x <M> y", "<P", "S><S", "🎉é日本" * 50, "a\x00b\n", "x" * 3_000_000]


def plainly(doc_id, text):
    """The transformation by slices of strings."""
    text = text or ""
    seed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(seed[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_all_documents_against_slices(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = fim.restored(fim.fill_in_middle(docs).withColumn("kept", F.col("output"))).collect()
    assert len(out) == len(texts)
    for r in out:
        want = plainly(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.kept) == want
        assert r.text == texts[r.doc_id] and r.restored_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    rows = [(i, t, "c") for i in range(30) for t in ODD[:-1]] + [(7, ODD[-1], "c"), (None, "abc", "c"), (None, "abc", "c"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = sorted(fim.restored(fim.fill_in_middle(docs).withColumn("kept", F.col("output"))).collect(), key=str)
    want = sorted(((d, *plainly(d, t), t or "") for d, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.kept, r.text) for r in out), key=str) == want
    assert fim.restored(fim.fill_in_middle(docs.limit(0))).count() == 0


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_cuts_at_every_pair_of_places(form):
    text = "ab<cd>"
    pairs = [(a, b) for a in range(7) for b in range(a, 7)]
    first, second = np.array(pairs).T
    forms = np.array([form] * len(pairs), dtype=object)
    pieces = fim.arrange([text] * len(pairs), first, second, forms)
    outputs = ["".join(pieces.stream(i, text)) for i in range(len(pairs))]
    back = fim.read_back(outputs, forms)
    assert ["".join(back.stream(i, o)) for i, o in enumerate(outputs)] == [text] * len(pairs)
    order = fim.orders(forms)
    assert (np.take_along_axis(order, fim.inverse(order), axis=1) == np.arange(6)).all()
