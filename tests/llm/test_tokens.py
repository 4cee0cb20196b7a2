import random

import pytest
from pyspark.sql import functions as F

from wakegraph.llm import tokens

ENC = tokens.encoding()


def texts():
    random.seed(5)
    words = ["class", "return ", "\n", "    ", "é", "日本語", "<|endoftext|>", "'s", "12345", "{}", "　", "\t\n ", "x" * 40, "--->", "it's"]
    own = ["".join(random.choice(words) for _ in range(random.choice([3, 60, 700]))) for _ in range(25)]
    boiler = " ".join(f"shared line {i} of the licence\n" for i in range(80))
    return own + [boiler + own[0], own[1] + boiler, boiler, boiler, own[3], "", None, " ", "\n\n", "日" * 3000, "a" * 5000, "ab " * 4000, "  \n" * 900]


@pytest.mark.parametrize("mean", [16, 512])
def test_ids_equal_encoding_in_one_piece(spark, mean):
    data = [(i, t, "x", b"h") for i, t in enumerate(texts())] + [(0, texts()[0], "x", b"h"), (None, "null id", "x", b"h")]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string, hash binary")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode_documents(docs, mean=mean).collect()), key=repr)
    assert got == sorted(((i, ENC.encode_ordinary(t) if t else []) for i, t, *_ in data), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_documents(docs).count() == 0


@pytest.mark.parametrize("mean", [16, 64, 512])
def test_torn_joins_are_repaired(mean):
    random.seed(mean)
    for _ in range(150):
        letters = ["a", "b", "é", "日", "7", "!", "　", "\n", " ", '"'][: random.choice([4, 7, 10])]
        text = "".join(random.choice(letters) for _ in range(random.choice([40, 900])))
        chunks, exact = next(tokens.chunked([text.encode()], mean))
        ids = tokens.join_chunks(ENC, chunks, exact, [tokens._encode(ENC, c) for c in chunks])
        assert ids.tolist() == ENC.encode_ordinary(text)


def test_cuts_depend_on_the_text_alone():
    own = [t.encode() for t in texts() if t]
    together = list(tokens.chunked(own, 64))
    for t, (chunks, exact) in zip(own, together):
        assert b"".join(chunks) == t
        assert next(tokens.chunked([t], 64)) == (chunks, exact)


def test_equal_stretches_share_chunks(spark):
    shared = "".join(f"line {i} {i * 7919 % 1000}\n" for i in range(400))
    docs = spark.createDataFrame([(1, "head " + shared), (2, shared + " tail"), (3, "nothing alike")], "doc_id long, text string")
    assert tokens.shared_chunks(docs).count() >= 5


def test_filter_misses_no_hash(spark):
    hashes = [random.Random(i).randbytes(16) for i in range(200)]
    bits = tokens.shared_filter(spark.createDataFrame([(h,) for h in hashes], "hash binary"))
    assert all(tokens._in_filter(bits, h) for h in hashes)
    assert sum(tokens._in_filter(bits, random.Random(i + 10_000).randbytes(16)) for i in range(200)) < 5


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.n_tokens) for r in tokens.token_counts(docs).collect()} == {(1, 3), (2, 0), (3, 0)}
    assert tokens.token_counts(docs.where(F.lit(False))).count() == 0
