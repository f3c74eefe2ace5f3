"""Licence scan: TF-IDF cosine of notices to templates, then inheritance from the nearest directory.

A file's text is cut into sentences and lines. Those that hold an anchor word of
licence language (every template has one) are compared to every template by the
cosine of sparse TF-IDF vectors; the best at ``threshold`` or more is the file's
own licence. A template counts only if the notice has its numbers and what it
has of the licence's name, so another version or name is no match. A file of which notices make up at least ``file_share`` is a
licence file of its directory. Files without a notice take the licence of the
licence file in their directory or its nearest ancestor, by an equi-join on
ancestor paths.

Document frequencies count all files.

Defined results: null and empty texts have no notice; a null path inherits
nothing; of two licence files in one directory the higher score counts, then
the smaller path; equal scores go to the template first in order; of equal
paths each row is answered by itself for its own notice. Further columns are
carried along, and one that has the name of a result is replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideq.llm.common import broadcast_within, checkpointed, free_name

# Notices by which each licence is known.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the license conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("CC0-1.0", "Licensed under CC0 1.0, dedicated to the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "Copyright. All rights reserved."),
)
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in TEMPLATES) if name != "Proprietary")
ANCHOR = re.compile(r"licen[sc]e|copyright|permission|redistribution|public domain|spdx", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_CUT = re.compile(r"(?<=[.!?])\s+|\n+")


def terms_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def must_have(name: str, text: str) -> frozenset[str]:
    """Terms of a template without which a notice is of another licence or version: its numbers, and what it has of the licence's name."""
    own = terms_of(name)
    return frozenset(t for t in terms_of(text) if t.isdigit() or t in own)


VOCABULARY = frozenset(term for _, text in TEMPLATES for term in terms_of(text))


def segments_of(text: str | None) -> list[str]:
    """Sentences and lines that hold an anchor word."""
    return [s for s in _CUT.split(text) if ANCHOR.search(s)] if text and ANCHOR.search(text) else []


class Templates:
    """Unit TF-IDF vectors of the templates; terms that none has weigh most."""

    def __init__(self, frequency: dict[str, int], files: int):
        self.rarest = log(1 + files) + 1
        self.idf = {t: log((1 + files) / (1 + min(files, frequency.get(t, 0)))) + 1 for t in VOCABULARY}
        self.vectors = [(name, self._unit(terms_of(text))) for name, text in TEMPLATES]
        self.musts = [must_have(name, text) for name, text in TEMPLATES]

    def _unit(self, terms: Counter) -> dict[str, float]:
        weighed = {t: n * self.idf.get(t, self.rarest) for t, n in terms.items()}
        norm = sqrt(sum(w * w for w in weighed.values())) or 1.0
        return {t: w / norm for t, w in weighed.items()}

    def best(self, segment: str) -> tuple[float, str]:
        mine = self._unit(terms_of(segment))
        scores = [sum(w * mine.get(t, 0.0) for t, w in vector.items()) if must <= mine.keys() else 0.0 for (_, vector), must in zip(self.vectors, self.musts)]
        top = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return scores[top], self.vectors[top][0]


def notices(files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``files`` (path, text) with own_license, own_score and notice_share in place of the text."""
    spark = files.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch["text"]:
                n += 1
                seen.update(VOCABULARY.intersection(_WORD.findall((text or "").lower())))
        yield pd.DataFrame({"term": ["", *seen], "n": [n, *seen.values()]})

    counted = files.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = {r["term"]: r["n"] for r in counted}
    shared = spark.sparkContext.broadcast(Templates(frequency, frequency.pop("", 0)))

    @F.pandas_udf("own_license string, own_score double, notice_share double")
    def score(texts: pd.Series) -> pd.DataFrame:
        own: list[tuple[str | None, float | None, float]] = []
        for text in texts:
            found = [(*shared.value.best(s), len(s)) for s in segments_of(text)]
            found = [x for x in found if x[0] >= threshold]
            if found:
                best = max(found, key=lambda x: x[0])
                own.append((best[1], best[0], sum(x[2] for x in found) / len(text)))
            else:
                own.append((None, None, 0.0))
        return pd.DataFrame(own, columns=["own_license", "own_score", "notice_share"])

    plain = files.drop("own_license", "own_score", "notice_share")
    own = free_name(plain, "own")
    return plain.withColumn(own, score("text")).drop("text").select("*", f"{own}.*").drop(own)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """(depth, directory) of the file's directory and each one above; the root is ''."""
    parts = F.split(directory(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))


def scan(files: DataFrame, threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """``files`` without text, with own_license, own_score, license and inherited_from (a directory, or null)."""
    marked = checkpointed(notices(files.drop("license", "inherited_from"), threshold))
    near, own_dir = free_name(marked, "near"), free_name(marked, "own_dir")
    order = Window.partitionBy("dir").orderBy(F.desc("own_score"), "path")
    held = (
        marked.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("notice_share") >= file_share))
        .select(directory(F.col("path")).alias("dir"), "path", "own_license", "own_score")
        .withColumn("n", F.row_number().over(order))
        .where("n = 1")
        .select("dir", F.col("own_license").alias("dir_license"))
    )
    asking = marked.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select("path").distinct()
    # directories are far fewer than files: the ancestors of each are looked up once
    dirs = asking.select(directory(F.col("path")).alias("own_dir")).distinct()
    climbed = dirs.select("own_dir", F.explode(ancestors(F.concat("own_dir", F.lit("/x")))).alias("a")).select("own_dir", "a.depth", "a.dir")
    nearest = climbed.join(held, "dir").groupBy("own_dir").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("near"))
    nearest = broadcast_within(checkpointed(nearest.select(F.col("own_dir").alias(own_dir), F.col("near").alias(near))), 200_000)
    return (
        marked.withColumn(own_dir, directory(F.col("path")))
        .join(nearest, own_dir, "left")
        .withColumn("license", F.coalesce("own_license", f"{near}.dir_license"))
        .withColumn("inherited_from", F.when(F.col("own_license").isNull(), F.col(f"{near}.dir")))
        .drop(own_dir, near)
    )
