"""Call inventory end to end on hand-written programs and on the templated corpus."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import calls as C
from quarry.operators import callgraph, values
from quarry.operators.calls import dedup_calls, render_args, render_kwargs
from quarry.operators.codefacts import extract_facts
from quarry.plans.calls import apply_policies, call_inventory, extract_calls, io_inventory
from quarry.session import materialize
from quarry.sources.scripts import targets_frame
from scripts_fixture import ATTRIBUTE_PATHS, NAMED_TABLES, THREE_ARMS, UNCALLED, UNDEFINED_PART


def corpus(spark, sources):
    return spark.createDataFrame([(i, i, s) for i, s in enumerate(sources)],
                                 "script_id long, script_ord long, source string")


def shown(df):
    return sorted((r.function, r.caller, r.a, r.k) for r in
                  df.select("function", "caller", render_args().alias("a"), render_kwargs().alias("k")).collect())


def test_reads_resolved_through_attributes(spark):
    rows = extract_calls(corpus(spark, [ATTRIBUTE_PATHS]), targets_frame(spark, ["load"]))
    assert shown(rows) == [("load", "self.engine.open()", '["mem://north"]', "{}"), ("load", "self.engine.open()", '["mem://south"]', "{}")]


def test_table_names_from_fstring_of_parameters(spark):
    rows = extract_calls(corpus(spark, [NAMED_TABLES]), targets_frame(spark, ["saveAsTable"]))
    assert [a for _, _, a, _ in shown(rows)] == ['["lab.scores"]', '["lab.trials"]']


def test_undefined_name_in_fstring_is_partial(spark):
    rows = extract_calls(corpus(spark, [UNDEFINED_PART]), targets_frame(spark, ["saveAsTable"]), branches="taken")
    got = rows.select(F.col("args")[0].alias("v")).collect()
    assert [(r.v.kind, r.v.value) for r in got] == [("partial", "lab.")]


def test_uncalled_function_not_recorded(spark):
    inv = call_inventory(corpus(spark, UNCALLED), targets_frame(spark, ["emit"]))
    everything = inv.calls.count()
    kept = apply_policies(inv.calls)
    assert everything == 3 and shown(kept) == [("emit", "direct_call", '["hello"]', "{}")]


def test_dedup_is_type_aware_and_kwarg_order_free(spark):
    src = ["f(1)\nf(True)\nf(1.0)\nf(1)\ng(a=1, b='x')\ng(b='x', a=1)\n"]
    rows = extract_calls(corpus(spark, src), targets_frame(spark, ["f", "g"]))
    got = shown(rows)
    assert [a for fn, _, a, _ in got if fn == "f"] == ["[1.0]", "[1]", "[true]"]
    assert len([1 for fn, *_ in got if fn == "g"]) == 1


def test_first_occurrence_kept(spark):
    rows = extract_calls(corpus(spark, ["x = 1\nf('a')", "f('a')\nf('b')"]), targets_frame(spark, ["f"]))
    got = sorted((r.script_id, r.line, r.occurrences) for r in rows.collect())
    assert got == [(0, 2, 2), (1, 2, 1)]


def test_parameters_follow_each_call_site(spark):
    src = ["def w(p, q='d'):\n    save(p, mode=q)\nw('one')\nw('two', q='x')\nw(q='y', p='three')\n"]
    rows = extract_calls(corpus(spark, src), targets_frame(spark, ["save"]))
    assert shown(rows) == [
        ("save", "direct_call", '["one"]', '{"mode": "d"}'),
        ("save", "direct_call", '["three"]', '{"mode": "y"}'),
        ("save", "direct_call", '["two"]', '{"mode": "x"}'),
    ]


def test_recursion_terminates(spark):
    src = ["def r(n):\n    save(n)\n    r(n)\nr('a')\n"]
    rows = extract_calls(corpus(spark, src), targets_frame(spark, ["save"]))
    assert shown(rows) == [("save", "direct_call", '["a"]', "{}")]


def test_io_inventory_directions(spark):
    sources = [ATTRIBUTE_PATHS, NAMED_TABLES, THREE_ARMS, "load(path='mem://k')\nx.saveAsTable(name='t')\nload()\nload(fmt=1)\n"]
    got = sorted(((r.direction, r.target) for r in io_inventory(corpus(spark, sources)).collect()), key=repr)
    assert got == sorted([("sink", "lab.scores"), ("sink", "lab.trials"), ("sink", "t"), ("source", "mem://k"), ("source", "mem://north"),
                          ("source", "mem://same"), ("source", "mem://south"), ("source", None), ("source", None)], key=repr)


def test_quarantine_and_policies_on_templates(spark):
    from quarry.sources.corpus import templated_scripts
    inv = call_inventory(templated_scripts(spark, "/root/testdata/sf0.001"), targets_frame(spark, ["load", "saveAsTable"]))
    quarantined = {r.script_id for r in inv.quarantine.collect()}
    assert quarantined and all(k % 8 == 5 for k in quarantined)
    taken = apply_policies(inv.calls, branches="taken").filter(F.col("branch_arm") == "orelse").count()
    assert taken == 0
    chained = apply_policies(inv.calls).count() - apply_policies(inv.calls, drop_chained_load=True).count()
    assert chained == len([k for k in range(150) if k % 8 == 0])


def test_rebinding_reads_previous_value(spark):
    src = ["base = 's3a://b'\nbase = base + '/raw'\nname = f'{base}/t'\nload(name)\nbase = 'later'\n"]
    rows = extract_calls(corpus(spark, src), targets_frame(spark, ["load"]))
    assert shown(rows) == [("load", "direct_call", '["s3a://b/raw/t"]', "{}")]


# Sources whose load(p) must not be reported with a literal that it does not get.
UNKNOWN_VALUE = [
    "p='stale'\nfor p in ['a']:\n    load(p)\n",
    "p='stale'\np, q = 'a', 'b'\nload(p)\n",
    "p='stale'\nwith o() as p:\n    load(p)\n",
    "p='stale'\ntry:\n    o()\nexcept E as p:\n    load(p)\n",
    "p='stale'\nimport p\nload(p)\n",
    "p='stale'\ndef p(): pass\nload(p)\n",
    "p='stale'\ndel p\nload(p)\n",
    "p='stale'\nif (p := o()):\n    load(p)\n",
    "p='one'\ndef f():\n    global p\n    p='two'\nf()\nload(p)\n",
    "p='one'\ndef f():\n    load(p)\nf()\np='two'\n",
    "p='one'\ndef outer():\n    p=o()\n    def inner():\n        load(p)\n    inner()\nouter()\n",
    "cfg={'k':'old'}\ncfg[o()]='new'\nload(cfg['k'])\n",
    "cfg={'k':'old'}\ncfg=o()\nload(cfg['k'])\n",
]


def test_never_a_wrong_literal(spark):
    rows = call_inventory(corpus(spark, UNKNOWN_VALUE), targets_frame(spark, ["load"])).calls
    got = {r.script_id: r.v.kind for r in rows.select("script_id", F.col("args")[0].alias("v")).collect()}
    assert got == dict.fromkeys(range(len(UNKNOWN_VALUE)), "symbol")


def test_entries_follow_their_latest_binding(spark):
    rows = extract_calls(corpus(spark, ["cfg={'k':'old','j':'x'}\ncfg['k']='new'\nload(cfg['k'])\nload(cfg['j'])\ncfg={'k':'late'}\nload(cfg['k'])\n"]),
                         targets_frame(spark, ["load"]))
    assert [a for _, _, a, _ in shown(rows)] == ['["late"]', '["new"]', '["x"]']


# Sources whose load() runs.
LIVE = [
    "class K:\n    load('a')\n",
    "class B:\n    def m(self): load('a')\nclass K(B):\n    def go(self): self.m()\nK().go()\n",
    "class B:\n    def __init__(self): load('a')\nclass J(B):\n    pass\nJ()\n",
    "def f():\n    def a(): load('a')\n    def b(): a()\n    b()\nf()\n",
    "def h(): load('a')\nk = h\nk()\n",
    "def h(): load('a')\nrun(h)\n",
]


def test_live_calls_stay(spark):
    rows = extract_calls(corpus(spark, LIVE), targets_frame(spark, ["load"]), dedup=False)
    assert {r.script_id for r in rows.collect()} == set(range(len(LIVE)))


def test_literals_keep_their_types_and_not_their_order(spark):
    src = "load({'a':1,'b':2})\nload({'b':2,'a':1})\nload({1:'x'})\nload({'1':'x'})\nload((1,2))\nload([1,2])\n"
    rows = extract_calls(corpus(spark, [src]), targets_frame(spark, ["load"]))
    assert [r.line for r in rows.collect()] == [1, 3, 4, 5, 6]          # also the final order


def test_order_of_the_result(spark):
    rows = extract_calls(corpus(spark, ["load(2)\nload(1)\n", "load(0)\n"]), targets_frame(spark, ["load"]))
    assert [(r.script_id, r.line) for r in rows.collect()] == [(0, 1), (0, 2), (1, 1)]


def test_tables_of_the_corpus_are_not_broadcast(spark):
    """A few MB of Parquet may be 100 times as much in the driver's memory: repeated names and scopes compress well."""
    facts = materialize(extract_facts(corpus(spark, [ATTRIBUTE_PATHS, NAMED_TABLES])), "facts", partition_by=["fact"])
    reach = facts.select("script_id", "scope").distinct()
    joined = [callgraph.call_places(facts), callgraph.place_edges(facts), C.call_instances(facts, reach), C.root_hops(facts)[0],
              values.value_parts(facts), values.site_shapes(facts), values.signatures(facts), values.entry_sites(facts, reach, reach)]
    for df in joined:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
