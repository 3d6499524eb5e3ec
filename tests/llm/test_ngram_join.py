"""Against all pairs on small tables."""
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import ngram_join as nj


def shingles(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").split(" ")
    ws = [w for part in ws for w in part.replace("\t", " ").replace("\n", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                top[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(rows):
        low.setdefault(find(x), []).append(i)
    return sorted(((i, len(sets[x]), min((k for k in low[find(x)] if k is not None), default=None))
                   for x, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows, docs):
    found = nj.link_documents(docs(rows)).select("id", "n", "component").collect()
    return sorted(map(tuple, found), key=repr)


def family(rng, size, words, edits, vocabulary=4000):
    base = [f"v{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(size):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(words)] = f"e{rng.randrange(vocabulary)}"
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("small,block,spread", [(32, 192, 8), (3, 4, 6), (1, 2, 3)])
def test_families_of_near_copies(spark, docs, monkeypatch, small, block, spread):
    monkeypatch.setattr(nj, "SMALL", small)
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "WANTED", 100 * (block - 2))
    rng = random.Random(small)
    texts = []
    for k in range(spread):
        texts += family(rng, rng.randint(2, 14), rng.randint(20, 90), 1 + k % 4)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{family(rng, 1, 30, 0)[0]} {passage}" for _ in range(12)] + [passage] * 4 + ["Tiny Text"] * 2 + ["tiny text", "tiny"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows, docs) == brute(rows)


def test_defined_cases(spark, docs):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "a b c d"), (9, "A B\x0bC D"), (9, "a b c d"), (4, "É b c d"), (3, "é b c d"),
            (1, "x " * 50), (2, "X x " * 3), (None, "null id text here now"), (None, None), (10, "null id text here NOW"),
            (11, "w " * 4000 + "end"), (12, "w " * 3000 + "end"), (13, " ".join(map(str, range(30000)))),
            (14, " ".join(map(str, range(100, 30000))))]
    got = run(spark, rows, docs)
    assert got == brute(rows)


def test_empty_table(spark, docs):
    assert run(spark, [], docs) == []


def test_boundary_similarity(spark, docs):
    a = [f"t{i}" for i in range(18)]                      # 14 shingles
    rows = [(1, " ".join(a[:16])), (2, " ".join(a[:13])), (3, " ".join(a[:12]))]   # 12, 9 and 8 shingles
    assert run(spark, rows, docs) == [(1, 12, 1), (2, 9, 1), (3, 8, 1)]
    rows = [(1, " ".join(a[:16])), (3, " ".join(a[:12]))]
    assert run(spark, rows, docs) == [(1, 12, 1), (3, 8, 3)]


def test_keep_one_with_clashing_names(spark, docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = docs([(1, text), (2, text + " end"), (3, "other words here")])
    for name in ("__hash", "text_hash", "id", "root", "__stays", "__bucket"):
        rows = rows.withColumn(name, F.lit(name))
    left = nj.keep_one(rows)
    assert left.columns == rows.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_texts_of_common_passages_are_not_compared_by_blocks(spark, docs, monkeypatch):
    """A full count table ties them to one group; no text of it may be dealt to ever more tasks."""
    monkeypatch.setattr(nj, "SKETCH_BITS", 10)
    monkeypatch.setattr(nj, "SMALL", 4)
    monkeypatch.setattr(nj, "BLOCK", 4)
    rng = random.Random(5)
    texts = [" ".join(f"u{k}w{i}" for i in range(60)) for k in range(8000)]
    passages = [" ".join(f"p{j}w{i}" for i in range(14)) for j in range(48)]
    texts += [" ".join([f"v{k}w{i}" for i in range(56)] + rng.sample(passages, 4)) for k in range(240)]
    near = [texts[-1] + " and some more", "one " + texts[5], texts[8000] + " end"]
    dealt, verified = [], nj.verified
    monkeypatch.setattr(nj, "verified", lambda rows: (dealt.append(rows.count()), verified(rows))[1])
    got = run(spark, list(enumerate(texts + near)), docs)
    assert {c[:1] + c[2:] for c in got if c[0] != c[2]} == {(8240, 8239), (8241, 5), (8242, 8000)}
    assert sum(dealt) < 3 * 240


def test_counts_of_many_tasks_are_summed(spark, docs, monkeypatch):
    """The table has every shingle of every row, whatever a task's counts were packed in."""
    monkeypatch.setattr(nj, "SKETCH_BITS", 14)
    often = " ".join(f"o{i}" for i in range(9))
    rows = docs([(k, f"{often} x{k}") for k in range(700)] + [(None, None), (1, "")])
    counts = nj.token_counts(rows.repartition(7), "text")
    words = nj.WordHash()
    want = nj.np.bincount(nj.spots(nj.np.concatenate([nj.shingle_set((t or "").encode(), words) for (t,) in rows.select("text").collect()]),
                                   1 << 14), minlength=1 << 14)
    assert counts.tolist() == want.tolist() and counts.max() >= 700
    assert not nj.token_counts(rows.limit(0), "text").any()
