"""Each stage against a brute-force version on what the stage before kept."""
import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from quarry.llm import secret_scan, toxicity
from quarry.llm.common import cut, documents, table
import test_decontaminate as td
import test_ngram_join as tn

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(cp.STAGES)

    clean = cut(steps["toxicity"](spark, docs, sf), "t")
    model = toxicity.fit(toxicity.training_part(docs), toxicity.training_part(table(spark, sf, "labels")))
    finder = toxicity.Finder(model.features)
    expected = {i for i, t in rows.items() if model.bias + sum(model.weights[k] for k in finder.find(t.encode())) < 0}
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == COLUMNS and set(kept) == expected and len(kept) > 150

    single = cut(steps["ngram_jaccard"](spark, clean, sf), "t")
    classes = tn.brute(list(kept.items()))
    kept = {i: kept[i] for i, n, low in classes if n == 0 or i == low}
    assert single.columns == COLUMNS and {r["doc_id"]: r["text"] for r in single.collect()} == kept

    apart = cut(steps["decontamination"](spark, single, sf), "t")
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in td.brute(list(kept.items()), items) if r[5]}
    kept = {i: t for i, t in kept.items() if i not in bad}
    assert bad and apart.columns == COLUMNS and {r["doc_id"]: r["text"] for r in apart.collect()} == kept

    masked = cut(steps["secret_scan"](spark, apart, sf), "t")
    kept = {i: secret_scan.redact(t.encode()) for i, t in kept.items()}
    got = masked.collect()
    assert masked.columns == COLUMNS and {r["doc_id"]: r["text"] for r in got} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in got) and any("[SECRET]" in t for t in kept.values())
    assert not any(re.search("[0-9a-f]{24}", t) for t in kept.values())

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = sorted(map(tuple, steps["byte_bpe"](spark, masked, sf).collect()))
    ids = {i: own.encode_ordinary(t) for i, t in kept.items()}
    assert final == sorted((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
                            hashlib.sha256(kept[i].encode()).hexdigest()) for i, x in ids.items())
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == final


def test_rows_that_repeat(spark, docs, on_disk):
    text = "one two three four five six seven eight"
    rows = [(2, text), (2, text), (3, text + " nine"), (None, None), (None, None), (None, text), (4, ""), (5, "other words")]
    left = sorted((tuple(r)[:2] for r in cp.drop_near_copies(spark, docs(rows), "").collect()), key=repr)
    assert left == sorted([(2, text), (None, None), (None, None), (4, ""), (5, "other words")], key=repr)
    null_only = cp.drop_near_copies(spark, docs([(None, text), (None, text + " x")]), "").collect()
    assert len(null_only) == 1


def test_empty_tables(spark, on_disk):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert cp.run(spark, on_disk([], labels=labels, benchmark=items)).count() == 0
    assert cp.run(spark, on_disk([(1, "a b"), (1, "a b"), (None, None)], labels=labels, benchmark=items)).count() == 2
