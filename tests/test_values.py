"""Which calls may run and what their arguments may be, form by form."""

import pytest
from pyspark.sql import functions as F

from quarry.operators.calls import dedup_calls, render_args, render_kwargs
from quarry.operators.callgraph import calling_edges, place_edges
from quarry.operators.codefacts import extract_facts
from quarry.plans.calls import apply_policies, call_inventory, extract_calls
from quarry.sources.scripts import targets_frame


def corpus(spark, sources):
    return spark.createDataFrame([(i, i, s) for i, s in enumerate(sources)], "script_id long, script_ord long, source string")


def loads(spark, sources, **more):
    """Per script the sorted first arguments of its load calls that may run."""
    inv = call_inventory(corpus(spark, sources), targets_frame(spark, ["load"]), **more)
    out = {i: [] for i in range(len(sources))}
    for r in apply_policies(inv.calls).select("script_id", render_args().alias("a"), render_kwargs().alias("k")).collect():
        out[r.script_id].append(r.a + (r.k if r.k != "{}" else ""))
    return {i: sorted(set(v)) for i, v in out.items()}


# Ways to run a function that are no plain call of its name: each load() runs.
INDIRECT = {
    "decorated": "import atexit\n@atexit.register\ndef f(): load('a')\n",
    "in a list": "def f(): load('a')\nfor g in [f]:\n    g()\n",
    "dict value": "def f(): load('a')\nd = {'k': f}\nd['k']()\n",
    "returned": "def f(): load('a')\ndef make(): return f\nmake()()\n",
    "default argument": "def f(): load('a')\ndef run(g=f): g()\nrun()\n",
    "property": "class K:\n    @property\n    def p(self): load('a')\nK().p\n",
    "with": "class K:\n    def __enter__(self): load('a')\n    def __exit__(self, *e): pass\nwith K(): pass\n",
    "tuple": "def f(): load('a')\ng, h = f, 1\ng()\n",
    "called object": "class K:\n    def __call__(self): load('a')\nk = K()\nk()\n",
    "attribute store": "def f(): load('a')\nb = o()\nb.run = f\nb.run()\n",
    "conditional": "def f(): load('a')\n(f if c else o)()\n",
    "getattr": "class K:\n    def run(self): load('a')\ngetattr(K(), 'run')()\n",
    "lambda": "def f(): load('a')\ng = lambda: f()\ng()\n",
    "generator": "def f():\n    load('a')\n    yield 1\nlist(f())\n",
    "own attribute": "def f(): load('a')\nclass K:\n    def __init__(self):\n        self.run = f\n    def go(self): self.run()\nK().go()\n",
    "alias of alias": "def f(): load('a')\ng = f\nh = g\nh()\n",
    "bound method": "class K:\n    def m(self): load('a')\nk = K().m\nk()\n",
    "globals": "def f(): load('a')\nglobals()['f']()\n",
    "getattr of a computed name": "class K:\n    def run(self): load('a')\ngetattr(K(), 'r' + 'un')()\n",
    "decorated class": "@keep\nclass K:\n    def __init__(self): load('a')\n",
    "yielded": "def f(): load('a')\ndef g():\n    yield f\nfor h in g(): h()\n",
}
# Functions that nothing runs or hands on.
DEAD = {
    "never called": "def f(): load('a')\n",
    "called by the dead": "def f(): load('a')\ndef g(): f()\n",
    "alias in the dead": "def f(): load('a')\ndef g():\n    h = f\n    h()\n",
    "alias that is not called": "def f(): load('a')\ng = f\n",
    "another class's method": "class A:\n    def m(self): load('a')\nclass B:\n    def m(self): pass\n    def go(self): self.m()\nB().go()\n",
    "class never made": "class K:\n    def __init__(self): load('a')\n",
    "method never read": "class K:\n    def m(self): load('a')\nK()\n",
    "own name only in itself": "def f():\n    load('a')\n    f()\n",
}


def test_indirect_calls_run(spark):
    got = loads(spark, list(INDIRECT.values()))
    assert {k: got[i] for i, k in enumerate(INDIRECT)} == dict.fromkeys(INDIRECT, ['["a"]'])


def test_what_nothing_runs_does_not(spark):
    got = loads(spark, list(DEAD.values()))
    assert {k: got[i] for i, k in enumerate(DEAD)} == dict.fromkeys(DEAD, [])


def test_many_calls_and_methods_of_one_name_form_no_pairs(spark):
    n = 2000
    src = "".join(f"class K{i}:\n    def m(self): pass\n    def go(self, o): o.m()\n" for i in range(n)) + "K0().go(K1())\n"
    facts = extract_facts(corpus(spark, [src]))
    assert calling_edges(facts).count() + place_edges(facts).count() < 20 * n


# What load() may get: by Python's rules for arguments, defaults and parameters.
SIGNATURES = {
    "default": ("def f(p='d'): load(p)\nf()\n", ['["d"]']),
    "default and given": ("def f(p='d'): load(p)\nf()\nf('x')\n", ['["d"]', '["x"]']),
    "default by name": ("D = 'd'\ndef f(p=D): load(p)\nf()\n", ['["d"]']),
    "starred": ("def f(a, b, c=0): load(b)\nf(*[1, 2], 'z')\n", ["[<b>]"]),
    "starred, keyword behind": ("def f(a, b, c=0): load(c)\nf(*[1, 2], c='k')\n", ['["k"]']),
    "before the star": ("def f(a, *r): load(a)\nf('x', *[1])\n", ['["x"]']),
    "two stars": ("def f(a, b='d'): load(b)\nf('x', **o)\n", ["[<b>]"]),
    "two stars, given": ("def f(a, b='d'): load(b)\nf('x', b='k', **o)\n", ['["k"]']),
    "rest": ("def f(a, *r, **k): load(r, x=k)\nf(1, 2, z=3)\n", ['[<r>]{"x": <k>}']),
    "keyword only": ("def f(a, *, k='d'): load(k)\nf('x')\nf('x', k='y')\n", ['["d"]', '["y"]']),
    "positional only": ("def f(a, /, b): load(a)\nf('x', b='y')\n", ['["x"]']),
    "static": ("class A:\n    @staticmethod\n    def m(p, q): load(q)\nA.m('x', 'y')\n", ['["y"]']),
    "static through an object": ("class A:\n    @staticmethod\n    def m(p, q): load(q)\nA().m('x', 'y')\n", ['["y"]']),
    "class method": ("class A:\n    @classmethod\n    def m(cls, p): load(p)\nA.m('x')\n", ['["x"]']),
    "method": ("class A:\n    def m(self, p): load(p)\nA().m('x')\n", ['["x"]']),
    "unbound method": ("class A:\n    def m(self, p): load(p)\nA.m(o, 'x')\n", ['["x"]']),
    "class or object": ("class A:\n    def m(self, p): load(p)\nB = A\nB.m(o, 'x')\n", ["[<p>]"]),
    "constructor": ("class A:\n    def __init__(self, p, q='d'): load(p, k=q)\nA('x')\n", ['["x"]{"k": "d"}']),
    "through super": ("class A:\n    def __init__(self, p): load(p)\nclass B(A):\n    def __init__(self):\n        super().__init__('x')\nB()\n", ['["x"]']),
    "alias": ("def f(p): load(p)\ng = f\ng('x')\n", ['["x"]']),
    "defined twice": ("if c:\n    def f(p, q): load(p)\nelse:\n    def f(q, p): load(p)\nf('x', 'y')\n", ["[<p>]"]),
    "two hops": ("def g(v, s='t'): load(f'{v}.{s}')\ndef f(p): g(p)\nf('x')\n", ['["x.t"]']),
    "arguments agree": ("def f(p, q): load(p + q)\nf('a', 'b')\nf('c', 'd')\n", ['["ab"]', '["cd"]']),
    "dict passed on": ("c = {'k': 'x'}\ndef f(d): load(d['k'])\nf(c)\n", ['["x"]']),
}


def test_arguments_by_signature(spark):
    got = loads(spark, [s for s, _ in SIGNATURES.values()])
    assert {k: got[i] for i, k in enumerate(SIGNATURES)} == {k: v for k, (_, v) in SIGNATURES.items()}


# What load() may get where arms and loops bind.
FLOW = {
    "loop, bound below": ("p = 'a'\nfor i in o():\n    load(p)\n    p = 'b'\n", ['["a"]', '["b"]']),
    "while, bound below": ("p = 'a'\nwhile o():\n    load(p)\n    p = 'b'\n", ['["a"]', '["b"]']),
    "loop, bound above": ("p = 'a'\nfor i in o():\n    p = 'b'\n    load(p)\n", ['["b"]']),
    "after a loop": ("p = 'a'\nfor i in o():\n    p = 'b'\nload(p)\n", ['["a"]', '["b"]']),
    "nested loops": ("p = 'a'\nfor i in o():\n    for j in o():\n        load(p)\n    p = 'b'\n", ['["a"]', '["b"]']),
    "inner loop, outer binds first": ("p = 'a'\nfor i in o():\n    p = 'c'\n    for j in o():\n        load(p)\n        p = 'b'\n", ['["b"]', '["c"]']),
    "try": ("p = 'a'\ntry:\n    p = 'b'\nexcept E:\n    pass\nload(p)\n", ['["a"]', '["b"]']),
    "if": ("p = 'a'\nif c:\n    p = 'b'\nload(p)\n", ['["a"]', '["b"]']),
    "if and else": ("p = 'a'\nif c:\n    p = 'b'\nelse:\n    p = 'd'\nload(p)\n", ['["a"]', '["b"]', '["d"]']),
    "inside the other arm": ("p = 'a'\nif c:\n    p = 'b'\nelse:\n    load(p)\n", ['["a"]']),
    "bound again in the arm": ("p = 'a'\nif c:\n    p = 'x'\n    p = 'b'\nload(p)\n", ['["a"]', '["b"]']),
    "bound after the arm": ("p = 'a'\nif c:\n    p = 'b'\np = 'd'\nload(p)\n", ['["d"]']),
    "entry": ("c = {'k': 'a'}\nif o():\n    c['k'] = 'b'\nload(c['k'])\n", ['["a"]', '["b"]']),
    "whole dict in an arm": ("c = {'k': 'a'}\nif o():\n    c = {'k': 'b'}\nload(c['k'])\n", ['["a"]', '["b"]']),
    "break": ("p = 'a'\nfor i in o():\n    p = 'x'\n    if i:\n        break\n    p = 'b'\nload(p)\n", ['["a"]', '["b"]', '["x"]']),
    "unknown in an arm": ("p = 'a'\nif c:\n    p = o()\nload(p)\n", ['["a"]', "[<p>]"]),
    "parameter": ("def f(p):\n    if c:\n        p = 'b'\n    load(p)\nf('x')\n", ['["b"]', '["x"]']),
    "own attribute": ("class K:\n    def __init__(self):\n        self.p = 'a'\n    def set(self):\n        self.p = 'b'\n    def go(self):\n        load(self.p)\nK().go()\n",
                      ['["a"]', '["b"]']),
    "same choice twice": ("p = 'a'\nif c:\n    p = 'b'\nload(p + p)\n", ['["aa"]', '["bb"]']),
    "match": ("p = 'a'\nmatch o():\n    case 1:\n        p = 'b'\n    case 2:\n        load(p)\n", ['["a"]']),
    "too many": ("p = 'a'\n" + "".join(f"if c{i}:\n    p = 'b{i}'\n" for i in range(40)) + "load(p)\n", ["[<p>]"]),
}


def test_arguments_by_flow(spark):
    got = loads(spark, [s for s, _ in FLOW.values()])
    assert {k: got[i] for i, k in enumerate(FLOW)} == {k: v for k, (_, v) in FLOW.items()}


# What load() gets if the first arm of every if runs.
TAKEN = {
    "value of the first arm": ("if c:\n    p = 'a'\nelse:\n    p = 'b'\nload(p)\n", ['["a"]']),
    "certain": ("p = 'a'\nif c:\n    p = 'b'\nload(p)\n", ['["b"]']),
    "called from else only": ("def f(): load('a')\nif c:\n    pass\nelse:\n    f()\n", []),
    "defined in both": ("if c:\n    def f(): load('a')\nelse:\n    def f(): load('b')\nf()\n", ['["a"]']),
    "elif": ("if c:\n    load('a')\nelif d:\n    load('b')\nelse:\n    load('x')\n", ['["a"]']),
    "loops stay": ("p = 'a'\nfor i in o():\n    if c:\n        p = 'b'\nload(p)\n", ['["a"]', '["b"]']),
    "call site in else": ("def f(p): load(p)\nif c:\n    f('a')\nelse:\n    f('b')\n", ['["a"]']),
}


def test_first_arms(spark):
    got = loads(spark, [s for s, _ in TAKEN.values()], branches="taken")
    assert {k: got[i] for i, k in enumerate(TAKEN)} == {k: v for k, (_, v) in TAKEN.items()}
    with pytest.raises(ValueError, match="branch policy"):
        call_inventory(corpus(spark, ["load(1)"]), targets_frame(spark, ["load"]), branches="some")


# Where the receiver of load() stems from an import (its path), or not (None).
ROOTS = {
    "import": ("import a\na.read.load()\n", "a.read"),
    "alias": ("import a\nspark = a.b\nspark.read.load()\n", "a.b.read"),
    "own attribute": ("import a\nclass K:\n    def __init__(self):\n        self.session = a.make()\n    def go(self): self.session.read.load()\nK().go()\n", "a.make().read"),
    "long chain": ("import a as v0\n" + "".join(f"v{i + 1} = v{i}.s{i}\n" for i in range(30)) + "v30.load()\n",
                   "a." + ".".join(f"s{i}" for i in range(30))),
    "through a function's variable": ("from a import b\ndef f():\n    s = b.c\n    s.load()\nf()\n", "a.b.c"),
    "no import": ("s = make().b\ns.read.load()\n", None),
    "bound twice": ("import a\ns = a.b\ns = o()\ns.load()\n", None),
    "circle": ("import a\nx = y.a\ny = x.b\nx.load()\n", None),
    "import of two": ("try:\n    import a as m\nexcept E:\n    import b as m\nm.load()\n", "b"),
}


def test_roots_through_aliases(spark):
    inv = call_inventory(corpus(spark, [s for s, _ in ROOTS.values()]), targets_frame(spark, ["load"]))
    got = {r.script_id: r.root_path for r in inv.calls.select("script_id", "root_path").collect()}
    assert {k: got[i] for i, k in enumerate(ROOTS)} == {k: v for k, (_, v) in ROOTS.items()}


def test_chained_loads_keep_import_roots(spark):
    src = ["import a\ns = a.get()\ns.read().load('x')\n", "s.read().load('x')\n", "import a\na.read().load('x')\n", "s.load('x')\n"]
    rows = extract_calls(corpus(spark, src), targets_frame(spark, ["load"]), drop_chained_load=True, dedup=False)
    assert sorted(r.script_id for r in rows.collect()) == [0, 2, 3]


def test_dedup_combines_before_it_sorts(spark):
    inv = call_inventory(corpus(spark, ["f(1)\nf(1)\n", "f(1)\n"]), targets_frame(spark, ["f"]))
    plan = dedup_calls(inv.calls).select(F.col("occurrences"))._jdf.queryExecution().executedPlan().toString()
    partial = next(line for line in plan.split("\n") if "partial_min" in line)
    assert "HashAggregate" in partial and "SortAggregate" not in plan


def bind(name, values, indent=""):
    return "".join(f"{indent}{name} = {v!r}\n" for v in values)


B = [f"b{i}" for i in range(40)]
ARMS = "".join(f"if c{i}:\n    p = 'b{i}'\n" for i in range(40))
# What load() may get where more than a few bindings may hold.
MANY = {
    "arms": ("p = 'a'\n" + ARMS + "load(p)\n", {"a", *B}),
    "arms, nothing before": (ARMS + "load(p)\n", {*B}),
    "own attribute": ("class K:\n" + "".join(f"    def m{i}(self):\n        self.p = 'b{i}'\n" for i in range(40)) + "    def go(self):\n        load(self.p)\nK().go()\n",
                      {*B}),
    "entry": ("c = {'k': 'a'}\n" + "".join(f"if o({i}):\n    c['k'] = 'b{i}'\n" for i in range(40)) + "load(c['k'])\n", {"a", *B}),
    "each may be the last": ("p = 'a'\nfor i in o():\n" + "".join(f"    p = 'b{i}'\n    if i == {i}:\n        break\n" for i in range(40)) + "load(p)\n", {"a", *B}),
    "one arm": ("p = 'a'\nif c:\n" + bind("p", B, "    ") + "load(p)\n", {"a", "b39"}),
    "between two runs": ("p = 'a'\nfor i in o():\n    if c:\n" + bind("p", B[:20], "        ") + "        if d:\n            load(p)\n" + bind("p", B[20:], "        "), {"b19"}),
    "before a run": ("p = 'a'\nfor i in o():\n    load(p)\n" + bind("p", B, "    "), {"a", "b39"}),
    "two variables": ("p = q = ''\n" + "".join(f"if c{i}:\n    p = 'b{i}'\nif d{i}:\n    q = 'e{i}'\n" for i in range(18)) + "load(p + q)\n",
                      {x + y for x in ["", *B[:18]] for y in ["", *(f"e{i}" for i in range(18))]}),
}


def test_any_number_of_bindings(spark):
    got = loads(spark, [s for s, _ in MANY.values()])
    assert {k: got[i] for i, k in enumerate(MANY)} == {k: sorted(f'["{x}"]' for x in v) for k, (_, v) in MANY.items()}


def test_more_choices_than_are_made_from_one_row(spark, monkeypatch):
    monkeypatch.setattr("quarry.operators.values.CHOICES", 7)
    got = loads(spark, ["".join(f"{x} = ''\n" + "".join(f"if c{x}{i}:\n    {x} = '{x}{i}'\n" for i in range(3)) for x in "pqr") + "load(p + q + r)\n"])
    assert got[0] == sorted(f'["{a}{b}{c}"]' for a in ("", "p0", "p1", "p2") for b in ("", "q0", "q1", "q2") for c in ("", "r0", "r1", "r2"))
