"""The per-script parse (pure Python, no Spark): facts it emits; and how scripts are dealt out to tasks."""

from pyspark.sql.functions import spark_partition_id

from quarry.operators import codefacts
from quarry.operators.codefacts import parse_source


def facts(src, kind):
    return [r for r in parse_source(src, 1, 1) if r["fact"] == kind]


def test_syntax_error_gives_one_error_row():
    rows = parse_source("def f(:\n  pass", 3, 4)
    assert len(rows) == 1 and rows[0]["fact"] == "error" and rows[0]["script_id"] == 3


def test_calls_receivers_and_branch_arms():
    src = "import a.b as ab\nif x:\n    ab.c.load('p')\nelse:\n    q().w.load(k=1)\nload('z')\n"
    calls = [c for c in facts(src, "call") if c["name"] == "load"]
    assert [(c["receiver"], c["receiver_root"], c["receiver_is_call"], c["branch_arm"]) for c in calls] == [
        ("ab.c", "ab", False, "body"), ("q().w", "q", True, "orelse"), (None, None, False, None)]
    assert calls[1]["in_orelse"] and not calls[0]["in_orelse"]


def test_argument_parts():
    src = "load(f'{a}/x/{b[\"k\"]}', self.p, 1 + n, [1, 2], key={'z': None}, other=g(1))"
    args = [r for r in facts(src, "arg") if r["call_ord"] == 1]
    by_slot = {}
    for r in args:
        by_slot.setdefault(r["slot"], []).append((r["kind"], r["value"], r["fmt"]))
    assert by_slot["0"] == [("ref", "a", "fstring"), ("lit", "/x/", "fstring"), ("sub", "b", "fstring")]
    assert by_slot["1"] == [("attr", "self.p", "plain")]
    assert by_slot["2"] == [("lit", "1", "concat"), ("ref", "n", "concat")]
    assert by_slot["3"] == [("lit", "[1, 2]", "plain")]
    assert by_slot["key"] == [("lit", '{"z": null}', "plain")]
    assert by_slot["other"] == [("expr", "g(1)", "plain")]


def test_bindings_dict_entries_self_attributes_and_defs():
    src = ("cfg = {'a': 'x', 'b': 2}\n(t1, t2) = 1, 2\nclass K:\n    def __init__(self, c):\n"
           "        self.c = c\n    def m(self):\n        v: int = 3\n        return 1\n")
    binds = facts(src, "bind")
    keyed = sorted((b["name"], b.get("slot"), b["value"]) for b in binds if b.get("slot") is not None)
    assert keyed == [("cfg", '"a"', "x"), ("cfg", '"b"', "2")]
    selfb = [b for b in binds if b["name"] == "self.c"][0]
    assert selfb["scope"] == "K" and selfb["qual"] == "K.__init__" and selfb["kind"] == "ref"
    names = sorted(d["name"] for d in facts(src, "def"))
    assert names == ["K", "__init__", "cfg", "m"]  # no tuple or annotated targets
    params = [(p["scope"], p["name"], p.get("slot")) for p in facts(src, "param")]
    assert ("K.__init__", "c", "1") in params and ("K.m", "self", "0") in params


def test_imports():
    rows = facts("import os.path\nimport numpy as np\nfrom a.b import c as d, e\nfrom . import rel\n", "import")
    assert [(r["name"], r["module"], r["qual"]) for r in rows] == [
        ("os", "os.path", "os"), ("np", "numpy", "numpy"), ("d", "a.b", "a.b.c"), ("e", "a.b", "a.b.e"), ("rel", ".", "..rel")]


def test_no_length_or_depth_is_too_much():
    long_line = "p='a'; q='" + "x" * 2_000_000 + "'; p='b'\nload(p)\n"
    binds = [r for r in facts(long_line, "bind") if r["name"] == "p"]
    call = facts(long_line, "call")[0]
    assert [b["value"] for b in sorted(binds, key=lambda r: r["pos"])] == ["a", "b"] and call["pos"] > max(b["end_pos"] for b in binds)
    assert len(facts("x" + ".f()" * 2000, "call")) == 2000
    assert len(facts("load(" + "+".join(["'a'"] * 5000) + ")", "arg")) == 5000
    nested = "".join(" " * i + "if x:\n" for i in range(90)) + " " * 90 + "load(1)\n"
    assert facts(nested, "call")[0]["branch_depth"] == 90


def test_parse_is_linear():
    import time
    start = time.process_time()
    rows = parse_source("load('a', k=b + 1)\n" * 40_000, 1, 1)
    assert len(rows) == 40_000 * 4 and time.process_time() - start < 30


def test_source_text_with_other_line_ends():
    src = "load(a(1),\r\n  é(2))\rload(b(3))\n# \x0c\nload(c(\n4))"
    assert [r["value"] for r in facts(src, "arg") if r["kind"] == "expr"] == ["a(1)", "é(2)", "b(3)", "c(\n4)"]


def test_never_executes():
    # a script that would raise or have side effects if run is only parsed
    rows = parse_source("raise SystemExit(1)\nopen('/x', 'w').write('y')\n", 1, 1)
    assert {r["fact"] for r in rows} == {"call", "arg"}


def test_scripts_of_one_split_are_dealt_out(spark, monkeypatch):
    sources = [f"load({i})\n" for i in range(40)] + ["load('x')\n" * 30, None, None]
    scripts = spark.createDataFrame([(i, i, s) for i, s in enumerate(sources)],
                                    "script_id long, script_ord long, source string").coalesce(1)
    monkeypatch.setattr(codefacts, "TASK_SCRIPTS", 10)
    monkeypatch.setattr(codefacts, "TASK_CHARS", 1_000)
    assert codefacts.parse_tasks(scripts) == 5 and codefacts.parse_tasks(scripts.limit(0)) == 1
    monkeypatch.setattr(codefacts, "TASK_CHARS", 100)
    found = codefacts.extract_facts(scripts)
    assert found.rdd.getNumPartitions() == codefacts.parse_tasks(scripts) == 7
    rows = found.filter("fact = 'call'").withColumn("task", spark_partition_id()).collect()
    assert len(rows) == 40 + 30 and len({r["task"] for r in rows}) > 4
