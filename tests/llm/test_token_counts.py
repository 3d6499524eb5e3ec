"""Against the tokenizers library on whole texts."""
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_counts as tc
from quarry.llm.common import documents

CONFIG = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_str(CONFIG)


def whole(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False))


def test_splices_match_whole_texts(tok):
    rng = random.Random(7)
    bits = ["word ", "  ", "\n", "<|endoftext|>", "<|endof", "é", "漢字", "🙂", "12", "'re", "don't ", "!!", "\t \n ", "x" * 40]
    one = lambda t: tok.encode(t, add_special_tokens=False)
    margin = tc.edge_margin(CONFIG)
    for _ in range(60):
        text = "".join(rng.choices(bits, k=rng.randint(0, 400)))
        assert tc.count_spliced(one, text, margin, chunk=150, overlap=40) == whole(tok, text)


def test_no_boundary_widens_to_the_end(tok):
    one = lambda t: tok.encode(t, add_special_tokens=False)
    for text in ("x" * 5000, " " * 5000, "ab" * 2000 + " c", "\n" * 3000 + "y" * 3000):
        assert tc.count_spliced(one, text, tc.edge_margin(CONFIG), chunk=100, overlap=30) == whole(tok, text)


def test_defined_cases(spark, docs, tok):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "<|endoftext|> x"), (5, "word and " * 9000)]
    got = tc.count_tokens(docs(rows), CONFIG).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted((i, whole(tok, t)) for i, t in rows)
    assert tc.count_tokens(docs([]), CONFIG).count() == 0


def test_pieces_match_whole_texts(spark, docs, tok):
    rng = random.Random(11)
    bits = ["word", " ", " ", "  ", "\n", "<|endoftext|>", "<|endof", "é", "漢", "\u00a0", "\u0085", "\x1c", "\u200b", "12", "'re", "'", "!!", "\t"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(400)]
    got = tc.count_tokens(docs(rows), CONFIG).select("doc_id", "n_tokens").collect()
    assert dict(map(tuple, got)) == {i: whole(tok, t) for i, t in rows}


def test_whole_table(spark, tok):
    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r[1:]) for r in tc.op10_token_counts(spark, sf).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    rows = documents(spark, sf).select("doc_id", "text").collect()
    assert got == {i: (len(t.encode()), n := whole(tok, t), n > 512) for i, t in rows}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tc.edge_margin('{"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "ByteLevel"}}')
    token = '{"content": "%s", "single_word": false, "lstrip": false, "rstrip": false}'
    plain = '{"normalizer": null, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": false}, "added_tokens": [%s]}'
    assert tc.edge_margin(plain % (token % "abc")) == 7
    with pytest.raises(ValueError):
        tc.edge_margin(plain % (token % "zqxj wvkp"))
