"""Against the tiktoken library, and the round trip."""
import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quarry.llm import bpe
from quarry.llm.common import documents

HARD = ["", None, "a", "  ", "\n\n  x", "it's  we'll 'S", "naïve Ünïcödé 漢字 🙂🙃", "x" * 5000, "ab" * 3000, "   " * 400,
        "<|endoftext|> plain", "\x00\x01\x7f", "12345 67890", "!!!***$$$", "tie", "tie", "é" * 999]


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(own, text):
    ids = own.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(5000))
    assert all(h.find(k) == i for i, k in enumerate(keys)) and h.find(b"other") == -1
    assert bpe.PerfectHash([]).find(b"x") == -1


def test_hard_texts(spark, docs, own):
    got = bpe.digests(docs(list(enumerate(HARD)))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: expected(own, t) for i, t in enumerate(HARD)}


def test_whole_table(spark, own):
    got = bpe.op4_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    rows = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: expected(own, t) for i, t in rows}


def test_extra_and_clashing_columns(spark, docs):
    from pyspark.sql import functions as F
    ranks, pattern = bpe.vocabulary()
    df = docs([(1, "some text"), (1, "some text")]).withColumn("ids", F.lit("x")).withColumn("Decoded", F.lit(1))
    out = bpe.decode(bpe.encode(df, ranks, pattern), ranks)
    assert [bytes(r["decoded"]) for r in out.collect()] == [b"some text"] * 2
    assert bpe.digests(docs([])).count() == 0
