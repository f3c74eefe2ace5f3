import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tideq.llm import align

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "\n\n x", "<|endoftext|> <s></s>", "日本語テキスト🎉" * 40, "a▁b", "x" * 4000, "!?" * 3000, "ﬁ ½ é", "a\x00b", "🏴‍☠️ " * 9, " lead", "trail  "]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plainly(text, libraries):
    """(a ids, b ids) of each group, by walking along the bytes."""
    a, b = libraries
    if not text:
        return []
    whole = b" " + text.encode()
    alphabet = align.byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    shown = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, shown)]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(ids_a):
        group = ([ids_a[i]], [ids_b[j]])
        at_a, at_b, i, j = at_a + len(bytes_a[i]), at_b + len(bytes_b[j]), i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                group[0].append(ids_a[i])
                at_a, i = at_a + len(bytes_a[i]), i + 1
            else:
                group[1].append(ids_b[j])
                at_b, j = at_b + len(bytes_b[j]), j + 1
        out.append(group)
    return out


def by_loops(rows, libraries):
    found = [(d, plainly(t, libraries)) for d, t in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    count = Counter(pair for one in linked for pair in one)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (d, g), one in zip(found, linked):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        n_best = sum(n for p, n in one.items() if count[p] == best[p[0]])
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(one.values()), n_best, sum(n * count[p] for p, n in one.items()), digest))
    return sorted(out, key=str)


def run(docs, **more):
    return sorted((tuple(r) for r in align.align_corpus(docs, JSON, MODEL, **more).collect()), key=str)


def test_all_documents_against_loops(docs, libraries):
    assert run(docs) == by_loops([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], libraries)


@pytest.mark.parametrize("more", [{}, {"most_pairs": 0}])
def test_odd_rows(spark, libraries, more):
    rows = [*enumerate(ODD), (1, "a"), (1, "a"), (None, "a"), (None, None)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, row int")
    assert run(docs, **more) == by_loops(rows, libraries)
    assert run(docs.limit(0)) == []


def test_wide_groups_and_small_chunks(spark, libraries, docs, monkeypatch):
    rows = [*enumerate(ODD)] + [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(20).collect()]
    first, second = align.byte_level(JSON), align.pieces(MODEL)
    want = align.align([t or "" for _, t in rows], first, second)
    monkeypatch.setattr(align, "WIDE", 3)
    assert align.align([t or "" for _, t in rows], first, second).equals(want)


def test_both_libraries_give_the_same_ids(docs, libraries):
    texts = [r.text for r in docs.select("text").collect()] + [t for t in ODD if t]
    assert align.byte_level(JSON).encode(texts) == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]
