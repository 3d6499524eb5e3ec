"""Against a plain version of the contract."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        ws = words(t)
        if ws:
            n = min(13, len(ws))
            for k in range(len(ws) - n + 1):
                wins.setdefault(tuple(ws[k:k + n]), set()).update(() if i is None else (str(i),))
    lengths = {len(w) for w in wins}
    out = []
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k:k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[w]
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def run(spark, sf):
    return sorted((tuple(r) for r in dc.op7_decontaminate(spark, sf).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


@pytest.fixture
def bench(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


LONG = " ".join(f"w{i}" for i in range(30))


def test_planted(spark, on_disk, bench):
    items = [(1, LONG), (2, LONG), (10, "Éa eb"), (3, "solo"), (4, None), (5, "!!"), (None, "ghost word"),
             (6, "x y x y x y x y x y x y x y x y"), (7, "K1 q")]
    docs = [(1, LONG.upper()), (2, "z " * 300 + LONG), (3, "z " * 500 + " ".join(LONG.split()[4:17])), (4, None), (5, ""),
            (6, "éa eb"), (7, "Éa\x00EB!"), (8, "a solo b"), (9, " ".join(LONG.split()[:12])), (10, "ghost word"),
            (11, "x y " * 20), (11, "x y " * 20), (12, "K1 q"), (None, LONG), (13, " - ".join(LONG.split())), (14, "SOLO " * 50)]
    assert run(spark, on_disk(docs, benchmark=bench(items))) == brute(docs, items)


def test_random(spark, on_disk, bench):
    rng = random.Random(3)
    text = lambda a, b: " ".join(rng.choices("abc", k=rng.randint(a, b)))
    items = [(i, text(1, 20)) for i in range(12)]
    docs = [(i, text(0, 60)) for i in range(80)]
    assert run(spark, on_disk(docs, benchmark=bench(items))) == brute(docs, items)


def test_empty_tables(spark, on_disk, bench):
    assert run(spark, on_disk([(1, "a b")], benchmark=bench([]))) == brute([(1, "a b")], [])
    assert run(spark, on_disk([], benchmark=bench([(1, "a b")]))) == []


def test_joins_by_shuffle_beyond_the_bound(spark, on_disk, bench, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    items, docs = [(1, LONG), (2, "solo")], [(1, "z " * 40 + LONG), (2, "solo"), (3, "none")]
    assert run(spark, on_disk(docs, benchmark=bench(items))) == brute(docs, items)


def test_removal(spark, docs, bench):
    rows = [(1, "z " * 800 + LONG + " end!"), (2, LONG), (3, None), (4, "clean"), (4, "clean"), (None, LONG)]
    items = bench([(1, LONG)])
    left = dc.remove_contaminated(docs(rows), items)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r[0] for r in left.collect())) == [1, 3, 4, 4]
    cleaned = {r[0]: r[1] for r in dc.remove_spans(docs(rows), items).collect()}
    assert words(cleaned[1]) == ["z"] * 800 + ["end"] and cleaned[3] is None and cleaned[4] == "clean"
    assert words(cleaned[2]) == []


def test_main_path_is_native(spark):
    plan = dc.op7_decontaminate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_clashing_names(spark, docs, bench):
    rows = docs([(1, "z " * 100 + LONG), (2, LONG), (3, "clean")])
    for name in ("hits", "__hits", "id", "text_hash", "__id", "pos", "key"):
        rows = rows.withColumn(name, F.lit(name))
    cleaned = {r["doc_id"]: r for r in dc.remove_spans(rows, bench([(1, LONG)])).collect()}
    assert words(cleaned[2]["text"]) == [] and cleaned[3]["text"] == "clean" and cleaned[1]["__hits"] == "__hits"
    left = dc.remove_contaminated(rows, bench([(1, LONG)]))
    assert left.columns == rows.columns and [r["doc_id"] for r in left.collect()] == [3]


def test_very_long_text(spark, on_disk, bench):
    items = [(1, LONG), (2, "solo"), (None, "no id here")]
    docs = [(1, "z y " * 40_000 + LONG + " q" * 20_000 + " solo"), (2, "no id here " * 20_000)]
    assert run(spark, on_disk(docs, benchmark=bench(items))) == brute(docs, items)


def test_texts_do_not_go_through_the_key_join(spark, docs, bench, monkeypatch):
    """With nothing broadcast, what is shuffled by window key holds no word array of a text."""
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(dc, "cut", lambda df, name: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        windows = dc.item_windows(bench([(1, LONG)]))
        plan = dc.verified_hits(docs([(1, LONG)]), windows, [13], "text", "doc_id")._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and "key" in node.condition().toString():
            joins.append([node.children().apply(i).output().mkString(",") for i in range(2)])
    assert joins and all("ws#" not in side for sides in joins for side in sides)
