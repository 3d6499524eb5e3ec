import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quarry.llm import token_files as tf

TEXTS = ["", None, "Hello, World!", "  two  spaces\n\nand lines\t tab", "don't we'll I'D", "naïve Étude, ÀÇ÷×µª Σσς ΑΣ ΑΣ.",
         "<|endoftext|> mid<|startoftext|>dle <|endoftext|", "é ́a å", "x" * 5000, "1234 5,6 ² ½ Ⅷ",
         "日本語 テキスト 👩‍👩‍👧", "a b c\x0bd\x1ce\x85f", "İstanbul ıI ß ẞ ſ", "word. word, Word WORD; word! word? word:",
         "it's 'tis o'clock 'S", " lead", "trail ", "\r\n mixed \r"]


@pytest.fixture(scope="module")
def spec():
    return tf.vocabulary()


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def rows_of(catalogue):
    fields = [T.StructField("ids", T.ArrayType(T.LongType()))]
    return sorted(map(tuple, tf.read_ids(catalogue, lambda: lambda row: [row.tolist()], fields).collect()),
                  key=lambda r: (r[1], r[0] is not None, r[0] or 0))


def test_encoder_equals_the_library(spec, library):
    encode = tf.encoder(spec, "<u2")
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "É", "ß", "'", "s", " ", "\n", "\t", ".", ",", "1", "́", "Σ", "日", "<|endoftext|>", " ", "-", "µ"]
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u2").tolist() == library(t), repr(t)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    t = Tokenizer.from_str(spec)
    encode = tf.encoder(spec, "<u4")
    for text in filter(None, TEXTS):
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_files_hold_every_document_in_order(spark, docs, tmp_dir, spec, library):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "first"), (7, "second"), (7, "second"), (-3, "minus")]
    catalogue = tf.write_ids(docs(rows).repartition(5), spec, f"file:{tmp_dir}/ids", end_id=1, shard_rows=4)
    got = rows_of(catalogue)
    assert len(got) == len(rows)
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    at = 0
    for _, start, n, ids in got:
        assert start == at and n == len(ids)
        at += n
    want = sorted((str(k), tuple(library(t) + [1])) for k, t in rows)
    assert sorted((str(k), tuple(ids)) for k, _, _, ids in got) == want
    names = [r[0] for r in catalogue.select("shard").distinct().collect()]
    assert len(names) >= len(rows) // 4
    found = [ids for name in names for ids in tf.ShardReader(name).find(7)]
    assert sorted(map(tuple, (i.tolist() for i in found))) == sorted(tuple(library(t) + [1]) for t in ("first", "second", "second"))
    assert all(tf.ShardReader(name).find(10 ** 9) == [] for name in names)


def test_query_digest_and_empty_table(spark, on_disk, library):
    rows = [(2, "b b"), (1, None), (3, "ein Wort")]
    got = [tuple(r) for r in tf.op12_token_files(spark, on_disk(rows)).orderBy("doc_id").collect()]
    at, want = 0, []
    for k, t in sorted(rows):
        ids = library(t) + [1]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tf.op12_token_files(spark, on_disk([])).collect() == []


def test_extra_columns_with_clashing_names(spark, tmp_dir, spec):
    df = spark.createDataFrame([(1, "a", 5, "x", 9)], "doc_id long, text string, id int, part string, tie int")
    assert [r[:3] for r in rows_of(tf.write_ids(df, spec, f"{tmp_dir}/clash"))] == [(1, 0, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_index_is_minimal(n):
    keys = [tf.key_bytes(i * 7919) for i in range(n)]
    index = tf.PerfectIndex.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(n))
    others = index.slots([tf.key_bytes(f"x{i}") for i in range(100)])
    assert others.min() >= -1 and others.max() < max(n, 1)


def test_ids_take_two_bytes_where_they_fit(spec):
    assert tf.id_type(spec, 1) == "<u2" and tf.id_type(spec, 1 << 16) == "<u4"
