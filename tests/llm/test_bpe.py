import hashlib

import public_tokenizers
import tiktoken

from tideq.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", "a" * 3000, "!" * 700, "  \n\n  x" * 90, "日本語テキスト🎉" * 50, "x" * 257 + "ab" * 300, " 　 y", "<|endoftext|>", "é́\x00"]


def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.Vocabulary.load(PATH).ranks, special_tokens={})


def test_ids_equal_the_library_and_round_trip(docs):
    texts = [r.text for r in docs.select("text").collect()] + ODD
    vocabulary = bpe.Vocabulary.load(PATH)
    got = list(bpe.Encoder(vocabulary, PATTERN).encode(texts))
    assert got == [reference().encode_ordinary(t) for t in texts]
    assert [vocabulary.decode(ids) for ids in got] == [t.encode() for t in texts]


def test_long_pieces_merge_in_the_same_order():
    vocabulary = bpe.Vocabulary.load(PATH)
    for piece in (b"abcabcabd" * 20, b"the" * 60, bytes(range(256))):
        assert [vocabulary.merge_long(piece)] == [vocabulary.merge_rows(vocabulary.byte[list(piece)][None, :].copy())[0]]


def test_nulls_repeats_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, 0), (1, "ab", 1), (None, "ab", 2)], "doc_id long, text string, n_tokens long")
    out = {(r.doc_id, r.n_tokens): r for r in bpe.encode_documents(rows, PATH, PATTERN).collect()}
    assert out[(1, 0)].ids == [] and out[(1, 0)].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[(None, 1)].ids == out[(1, 1)].ids
    assert bpe.encode_documents(rows.limit(0), PATH, PATTERN).count() == 0
