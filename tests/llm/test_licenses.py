import math

import numpy as np
from pyspark.sql import functions as F

from tideq.llm import licenses


def test_notices_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing"), ("a/b/c/y.txt", "text\nLicensed under CC BY-NC 4.0. More text follows here."),
        ("a/b/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/z.txt", "q"), ("w.txt", ""), (None, None), ("a/b/x.txt", "nothing"),
        ("e/f.txt", "a driver's licence is not enough to drive a lorry in most places"),
    ]
    got = [(r.path, r.own_license, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("a/LICENSE", "MIT", "MIT", None), ("a/b/x.txt", None, "MIT", "a"), ("a/b/x.txt", None, "MIT", "a"), ("a/b/c/y.txt", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
            ("a/b/c/LICENSE", "GPL-3.0", "GPL-3.0", None), ("a/b/c/d/z.txt", None, "GPL-3.0", "a/b/c"), ("w.txt", None, None, None), (None, None, None, None), ("e/f.txt", None, None, None),
        ],
        key=str,
    )
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_known_lines_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    line = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    got = licenses.notices(docs.select("doc_id", F.lit("p").alias("path"), "text")).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        want = [v for k, v in line.items() if k in r.text.split("\n")]
        assert not want or r.own_license in want
        assert r.own_license is None or "licens" in r.text.lower()


def test_versions_names_and_identifiers(spark):
    """Notices of other versions and names are none of the known ones; identifier lines are; ties and clashing columns."""
    want = {
        "This work is licensed under the GNU General Public License, version 1.": None, "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "SPDX-License-Identifier: Zlib": None, "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "Released under the Frobnicate License.": None, "Licensed under the Apache License, Version 1.1.": None, "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-SA 3.0.": None,
    }
    rows = spark.createDataFrame([(f"d/{i}", t, "x", "y", "z") for i, t in enumerate(want)], "path string, text string, own_dir string, near string, own_license string")
    out = licenses.scan(rows, file_share=2.0)
    assert sorted(out.columns) == sorted(["path", "own_dir", "near", "own_license", "own_score", "notice_share", "license", "inherited_from"])
    got = {r.path: (r.own_license, r.own_dir, r.near) for r in out.collect()}
    assert got == {f"d/{i}": (name, "x", "y") for i, name in enumerate(want.values())}


def test_scores_against_plain_cosines(spark):
    """The best template of each text's sentences by brute force over dense vectors."""
    texts = [t for _, t in licenses.TEMPLATES] + ["Permission is granted to use the MIT software.\nAll rights reserved.", "no notice", "", None, "copyright " * 5000]
    frequency = {v: sum(v in licenses.terms_of(t or "") for t in texts) for v in licenses.VOCABULARY}
    got = licenses.notices(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")).collect()
    idf = lambda t: math.log((1 + len(texts)) / (1 + frequency.get(t, 0))) + 1
    for r in got:
        scores = []
        for part in licenses.segments_of(texts[r.i]):
            mine = licenses.terms_of(part)
            for name, text in licenses.TEMPLATES:
                theirs = licenses.terms_of(text)
                every = sorted(mine.keys() | theirs.keys())
                a, b = (np.array([c[t] * idf(t) for t in every]) for c in (mine, theirs))
                if licenses.must_have(name, text) <= mine.keys():
                    scores.append((float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), name))
        best = max(scores, default=(0.0, None))[0]
        assert (r.own_license is None) == (best < 0.6) and (r.own_license is None or abs(r.own_score - best) < 1e-9)
