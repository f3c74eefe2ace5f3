import re
import time

import numpy as np
from pyspark.sql import functions as F

from tideq.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)
ODD = [
    None, "", "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 4111 1111 1111 1111-5555 +1 (212) 555-0000- 1.2.3 +" + "9" * 30 + " é🎉a@b.cd",
    "a" * 100_000 + " " + "1" * 100_000 + " " + "1-" * 30_000 + " b@" + "c." * 20_000, "4111111111111111", "call 212-555-0000 token = \"0123456789abcdef01234567\"",
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            fine = (True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, kind != 2 or 12 <= len(digits) <= 19 and luhn(digits), kind != 3 or 9 <= len(digits) <= 15)
            if fine[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_plain(spark, docs):
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    found = pii.find_spans(rows, pii.train(rows)).collect()
    assert all([tuple(x) for x in r.base_spans] == base(r.text) for r in found)
    for r in found:
        taken = [(x.start, x.stop) for x in [*r.base_spans, *r.added_spans] if x.kind >= len(pii.BASE)]
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))


def test_trees_and_sql_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (600, len(pii.FEATURES))).astype(float)
    model = pii.fit(x, (x[:, 7] > 4).astype(float))
    rows = spark.createDataFrame([tuple(float(v) for v in r) for r in x[:50]], ", ".join(f"{f} double" for f in pii.FEATURES))
    got = [r[0] for r in rows.select(model.expression({f: F.col(f) for f in pii.FEATURES})).collect()]
    assert np.allclose(got, model.score(x[:50])) and model.thresholds
    assert ((model.score(x) >= 0.5) == (x[:, 7] > 4)).mean() > 0.99


def test_redaction_and_empty(spark):
    rows = spark.createDataFrame([(1, "to a@b.cd, é 1.2.3.4!"), (1, None)], "doc_id long, text string")
    model = pii.Model(0.0, [], {})
    got = [r[0] for r in pii.find_spans(rows, model).select(pii.redact(F.col("text"), F.col("base_spans"))).collect()]
    assert got == ["to <email>, é <ip>!", None]
    assert pii.find_spans(rows.limit(0), pii.train(rows.limit(0))).count() == 0


def test_candidates_of_any_length_and_case(spark):
    texts = ["password: " + "a1" * 160, "k " + "0123456789abcdef" * 10, "mail bob [AT] example [DOT] org now", "api_key=abc123xyz==", "password: ab=cdefgh"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, pii.KINDS[c.kind], texts[r.doc_id][c.start : c.stop]) for r in pii.candidates(rows).collect() for c in r.candidates if c.kind >= len(pii.BASE)}
    assert got >= {(0, "secret", "a1" * 160), (1, "hex", "0123456789abcdef" * 10), (2, "spelt_email", "bob [AT] example [DOT] org"), (3, "secret", "abc123xyz=="), (4, "secret", "ab=cdefgh")}


def test_added_spans_keep_apart_from_base_ones_and_each_other(spark):
    """The fold over all spans in order against a plain one, with every candidate chosen."""
    texts = [
        "token=a@b.cd5 212-555-0000 +1 212-555-0000 secret: 4111111111111111 x", "password: 0123456789abcdef0123 0123456789abcdef0123 bob[at]x.org",
        "pwd=212-555-0000;key 0123456789 api_key=0123456789 1.2.3.4 secret=abcdef1.2.3.4", "",
    ] + ["212-555-0000 a@b.cd token=abcdefgh " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.Model(0.0, [], {k: 0.0 for k in range(len(pii.BASE), len(pii.KINDS))})
    found = {r.doc_id: r for r in pii.find_spans(rows, model).collect()}
    for r in pii.candidates(rows).collect():
        fixed = [tuple(x) for x in found[r.doc_id].base_spans]
        want, at = [], -1
        for start, kind, stop in sorted((c.start, c.kind, c.stop) for c in r.candidates if c.kind >= len(pii.BASE)):
            if start >= at and stop > start and not any(a < stop and start < b for a, _, b in fixed):
                want.append((start, kind, stop))
                at = stop
        assert [tuple(x) for x in found[r.doc_id].added_spans] == want


def test_many_matches_in_one_text(spark):
    """50,000 addresses: work that grew with the square of the matches would take minutes."""
    n = 50_000
    rows = spark.createDataFrame([(1, "é a@b.cd " * n)], "doc_id long, text string")
    model = pii.Model(0.0, [], {k: 0.5 for k in range(len(pii.BASE), len(pii.KINDS))})
    began = time.perf_counter()
    r = pii.find_spans(rows, model).select(F.size("base_spans").alias("n"), F.col("base_spans")[n - 1].alias("last"), F.size("added_spans").alias("added")).first()
    assert (r.n, tuple(r.last), r.added) == (n, (9 * n - 7, 0, 9 * n - 1), 0)
    assert time.perf_counter() - began < 60


def test_query_counts_base_spans_by_kind(spark, tmp_path):
    """Counts of the query against the plain base rules; a text of an address alone gave one of each kind."""
    from tideq.llm import queries

    texts = ["a@b.cd", "a@b.cd 1.2.3.4 4.3.2.1 +1 212-555-0000", *(t for t in ODD if t is None or len(t) < 1000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op10_pii_spans(spark, str(tmp_path)).collect():
        kinds = [kind for _, kind, _ in base(texts[r.doc_id])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in range(4)]


def test_all_documents_are_learned_from(spark, monkeypatch):
    """The counts that the trees get are those of every candidate, however many documents there are."""
    rows = spark.range(25_000).selectExpr("id doc_id", "concat('token=abc', id, ' 1.2.3.', id % 400) text")
    seen = {}
    fit = pii.fit
    monkeypatch.setattr(pii, "fit", lambda x, y, **more: seen.update(more, x=x, y=y) or fit(x, y, **more))
    pii.train(rows)
    ips = seen["x"][:, 0] == pii.KINDS.index("ip")
    assert seen["weight"][ips].sum() == 25_000 and len(seen["weight"]) < 200
    assert seen["weight"][ips & (seen["y"] == 1)].sum() == sum(i % 400 <= 255 for i in range(25_000))
    assert 0.3 < seen["weight"][seen["held"]].sum() / seen["weight"].sum() < 0.37
