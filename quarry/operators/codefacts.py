"""One read-only parse per script, emitted as flat fact rows.

The only Python step of the script inventory.  Each source (already
tab-expanded and dedented by native expressions) is parsed with the standard
``ast`` module on the executors -- never compiled, never run -- and walked
once.  Everything after this (target matching, argument resolution, callers,
reachability, de-duplication) is DataFrame work on these rows.

Fact kinds (column ``fact``):

``call``   every call whose callee is a name or an attribute chain
``arg``    one row per *part* of each call argument (an f-string or ``+``
           concatenation has several parts)
``bind``   one row per part of an assigned value; dict literals also bind
           each constant key (``key``); ``self.x = ...`` binds in the class
``param``  function parameters with their position (``slot_kind``: ``pos``, ``only`` for positional-only, ``kw``, ``rest``)
``default`` one row per part of a parameter's default value; its references belong to the scope of the definition
``def``    functions (``detail``: ``static``, ``class`` or ``property`` by decorator), classes (``detail`` is ``bases`` if a
           class has any) and simple-name assignment targets
``use``    a name or attribute that is read other than by a direct call, if the script defines a function or class of
           that name or gives the name one (``kind``: ``name``, ``attr``, ``text`` for ``getattr`` with a constant, ``any``
           where names are looked up at run time); plain aliases ``a = b`` are ``bind`` rows only
``import`` one row per imported alias
``error``  the source could not be parsed (no other rows for it)

A part is ``lit`` (a literal; ``value`` is the raw text of a string or the
JSON of any other literal, ``text`` is what ``str()`` would give), ``ref`` (a
plain name), ``sub`` (``name[<constant>]``), ``attr`` (``self.x``) or ``expr``
(anything else; ``value`` is its source text).  Every other way to bind a name
(loops, ``with``, ``except``, imports, definitions, unpacking, ``del``, ``global``)
is a ``bind`` of kind ``expr``: what refers to it stays a symbol.  ``home`` is the
scope whose variable a reference names, by Python's rules.  ``blocks`` are the arms and loops
of its scope that a row lies in, from the outermost: ``split`` numbers the statement whose
arms exclude each other (negative for ``match``), ``end`` is where a loop ends.  ``in_orelse`` tells that a row lies in
an ``else`` of its scope or of the scopes around it.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import dedent_text, expand_tabs
from quarry.session import ship_package

MODULE = "<module>"

FACT_SCHEMA = T.StructType([
    T.StructField("script_id", T.LongType(), False),
    T.StructField("script_ord", T.LongType(), False),
    T.StructField("fact", T.StringType(), False),
    T.StructField("scope", T.StringType(), True),
    T.StructField("cls", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("qual", T.StringType(), True),
    T.StructField("line", T.IntegerType(), True),
    T.StructField("pos", T.LongType(), True),
    T.StructField("end_pos", T.LongType(), True),
    T.StructField("call_ord", T.IntegerType(), True),
    T.StructField("receiver", T.StringType(), True),
    T.StructField("receiver_root", T.StringType(), True),
    T.StructField("receiver_is_call", T.BooleanType(), True),
    T.StructField("chain_depth", T.IntegerType(), True),
    T.StructField("call_form", T.StringType(), True),
    T.StructField("branch_depth", T.IntegerType(), True),
    T.StructField("branch_arm", T.StringType(), True),
    T.StructField("in_orelse", T.BooleanType(), True),
    T.StructField("slot", T.StringType(), True),
    T.StructField("slot_kind", T.StringType(), True),
    T.StructField("part", T.IntegerType(), True),
    T.StructField("fmt", T.StringType(), True),
    T.StructField("kind", T.StringType(), True),
    T.StructField("lit_kind", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("key", T.StringType(), True),
    T.StructField("src", T.StringType(), True),
    T.StructField("module", T.StringType(), True),
    T.StructField("detail", T.StringType(), True),
    T.StructField("home", T.StringType(), True),
    T.StructField("root_home", T.StringType(), True),
    T.StructField("loose", T.BooleanType(), True),
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("split", T.IntegerType()), T.StructField("end", T.LongType())])), True),
])

# Calls that look names up at run time, and decorators that do not call what they wrap.
DYNAMIC = {"globals", "locals", "vars", "eval", "exec"}
BY_NAME = {"getattr": 1, "attrgetter": 0, "methodcaller": 0}
QUIET = {"staticmethod": "static", "classmethod": "class", "property": "property", "cached_property": "property", "setter": "property",
         "getter": "property", "deleter": "property"}
_COLS = [f.name for f in FACT_SCHEMA.fields]
#: Fact rows that are handed on at a time.
BATCH_ROWS = 50_000
#: Scripts and their characters that a task parses, if they are dealt out by size.
TASK_SCRIPTS, TASK_CHARS = 5_000, 4 << 20


def _at(line: int, col: int) -> int:
    """A position that orders like (line, column) for lines of any length."""
    return (line << 32) | col


def _canonical(v):
    """A literal as JSON that keeps types apart: dict entries sorted, tuples, sets and other keys than text tagged."""
    if isinstance(v, dict):
        items = [(_canonical(k), _canonical(x)) for k, x in v.items()]
        if all(isinstance(k, str) for k in v):
            return dict(sorted(items))
        return {"!dict": sorted(items, key=lambda e: json.dumps(e[0]))}
    if isinstance(v, (tuple, set, frozenset)):
        items = [_canonical(x) for x in v]
        return {"!tuple": items} if isinstance(v, tuple) else {"!set": sorted(items, key=json.dumps)}
    return [_canonical(x) for x in v] if isinstance(v, list) else v


def _lit_kind(v) -> str | None:
    if v is None:
        return "none"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, str):
        return "str"
    if isinstance(v, (list, tuple)):
        return "list"
    if isinstance(v, dict):
        return "dict"
    return None


def _literal(node: ast.AST):
    """(kind, value, text) of a literal node, or None."""
    try:
        v = ast.literal_eval(node)
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return None
    kind = _lit_kind(v)
    if kind is None:
        return None
    if kind == "str":
        return kind, v, v
    try:
        return kind, json.dumps(_canonical(v), ensure_ascii=False), str(v)
    except (TypeError, ValueError, RecursionError):
        return None


class _Parts:
    """Splits an expression into parts; shared by arguments and bound values."""

    def __init__(self, source: str):
        # the parser's columns are UTF-8 bytes of lines that end with \n, \r\n or \r
        self.lines = [x.encode() for x in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", source)]

    def text_of(self, node: ast.AST) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first][node.col_offset:node.end_col_offset].decode()
        return b"".join([self.lines[first][node.col_offset:], *self.lines[first + 1:last],
                         self.lines[last][:node.end_col_offset]]).decode()

    def leaf(self, node: ast.AST) -> dict:
        lit = _literal(node)
        if lit is not None:
            return {"kind": "lit", "lit_kind": lit[0], "value": lit[1], "text": lit[2]}
        if isinstance(node, ast.Name):
            return {"kind": "ref", "value": node.id}
        if isinstance(node, ast.Subscript) and _literal(node.slice) is not None:
            base = node.value
            name = None
            if isinstance(base, ast.Name):
                name = base.id
            elif isinstance(base, ast.Attribute) and isinstance(base.value, ast.Name) and base.value.id == "self":
                name = f"self.{base.attr}"
            if name is not None:
                k = _literal(node.slice)
                key = json.dumps(k[1]) if k[0] == "str" else k[1]
                return {"kind": "sub", "value": name, "key": key}
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self":
            return {"kind": "attr", "value": f"self.{node.attr}"}
        return {"kind": "expr", "value": self.text_of(node)}

    def split(self, node: ast.AST) -> tuple[str, list[dict]]:
        if isinstance(node, ast.JoinedStr):
            parts = []
            for v in node.values:
                if isinstance(v, ast.Constant) and isinstance(v.value, str):
                    parts.append({"kind": "lit", "lit_kind": "str", "value": v.value, "text": v.value})
                elif isinstance(v, ast.FormattedValue) and v.format_spec is None and v.conversion == -1:
                    parts.append(self.leaf(v.value))
                else:
                    parts.append({"kind": "expr", "value": self.text_of(v)})
            return "fstring", parts
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add) and _literal(node) is None:
            items, todo = [], [node]
            while todo:
                n = todo.pop()
                if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
                    todo += [n.right, n.left]
                else:
                    items.append(n)
            parts = []
            for it in items:
                if isinstance(it, ast.JoinedStr):
                    parts.extend(self.split(it)[1])
                else:
                    parts.append(self.leaf(it))
            return "concat", parts
        return "plain", [self.leaf(node)]


def _receiver(func: ast.Attribute) -> tuple[str, str, bool, int]:
    """Text, root name, whether a call result is on the way, and depth of a receiver chain."""
    segs: list[str] = []
    is_call = False
    node = func.value
    while True:
        if isinstance(node, ast.Attribute):
            segs.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            is_call = True
            segs.append("()")
            node = node.func
        elif isinstance(node, ast.Subscript):
            segs.append("[]")
            node = node.value
        elif isinstance(node, ast.Name):
            segs.append(node.id)
            root = node.id
            break
        else:
            segs.append("<expr>")
            root = "<expr>"
            break
    segs.reverse()
    text = ""
    for s in segs:
        if s in ("()", "[]"):
            text += s
        else:
            text = f"{text}.{s}" if text else s
    depth = sum(1 for s in segs if s not in ("()", "[]"))
    return text, root, is_call, depth


class _Walker:
    """Walks a tree in order with a stack of its own, so nesting of any depth that parses is walked.

    A ``visit_*`` method is a generator of the nodes to walk below its node.
    """

    def __init__(self, source: str, sid: int, sord: int):
        self.sid, self.sord = sid, sord
        self.parts = _Parts(source)
        self.rows: list[dict] = []
        self.scopes = [MODULE]
        self.classes: list[str | None] = [None]
        self.arms: list[str] = []
        self.class_scopes: set[str] = set()
        self.calls = 0
        self.bound: dict[str, set[str]] = {}          # names that a scope binds
        self.globals: set[str] = set()                # names that functions rebind at module level
        self.declared: list[set[str]] = [set()]       # global and nonlocal names of the scopes being walked
        self.blocks: list[dict] = []                  # arms and loops of the scope being walked
        self.n_blocks = 0
        self.hidden = [False]                         # whether a scope being walked is defined in an else
        self.jumps: set[str] = set()                  # scopes with break, continue or try
        self.plain: set[int] = set()                  # names that are aliased or called: no uses
        self.used: set[tuple] = set()

    def steps(self, node: ast.AST):
        visit = getattr(self, f"visit_{type(node).__name__}", None)
        return visit(node) if visit else ast.iter_child_nodes(node)

    def walk(self, tree: ast.AST) -> None:
        stack = [iter([tree])]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            else:
                stack.append(iter(self.steps(node)))
        self.settle()

    def home(self, scope: str, name: str) -> str:
        """The function scope whose variable a name is (MODULE if none): class bodies are not seen from inside."""
        at = scope
        while at != MODULE:
            if name in self.bound.get(at, ()) and (at == scope or at not in self.class_scopes):
                return at
            at = at.rpartition(".")[0] or MODULE
        return MODULE

    def settle(self) -> None:
        """Names of each reference's own scope, and bindings that no position can order made unknown."""
        callable_names = {r["name"] for r in self.rows if r["fact"] == "def" and r["kind"] != "assign"}
        callable_names |= {r["name"].removeprefix("self.") for r in self.rows
                           if r["fact"] == "bind" and r["kind"] in ("ref", "attr") and r["fmt"] == "plain"}
        self.rows = [r for r in self.rows if r["fact"] != "use" or r["kind"] == "any" or r["value"] in callable_names]
        for row in self.rows:
            fact, kind = row["fact"], row.get("kind")
            inside = row.get("qual") or row["scope"] if fact in ("bind", "default") else row["scope"]
            if fact in ("arg", "bind", "default") and kind in ("ref", "sub") and not str(row["value"]).startswith("self."):
                row["home"] = self.home(inside, row["value"])
            elif fact == "use" and kind == "name":
                row["home"] = self.home(inside, row["value"])
            elif fact == "call" and row["call_form"] == "name":
                row["home"] = self.home(inside, row["name"])
            if row.get("receiver_root") and row["receiver_root"] != "<expr>":
                row["root_home"] = self.home(inside, row["receiver_root"])
            if fact == "bind":
                row["loose"] = row["scope"] in self.jumps
            if row["fact"] == "bind" and row["scope"] == MODULE and row["name"] in self.globals:
                row.update(kind="expr", value="<global>", home=None, lit_kind=None, text=None, key=None)

    # ---------------------------------------------------------------- emit
    def emit(self, fact: str, node: ast.AST | None = None, **kw) -> None:
        row = {"script_id": self.sid, "script_ord": self.sord, "fact": fact, "scope": self.scopes[-1],
               "cls": self.classes[-1], "in_orelse": self.hidden[-1] or "orelse" in self.arms}
        if fact in ("arg", "bind", "default"):
            row["blocks"] = list(self.blocks)
        if node is not None and hasattr(node, "lineno"):
            row["line"] = node.lineno
            row["pos"] = _at(node.lineno, node.col_offset)
            if fact == "bind" and getattr(node, "end_lineno", None) is not None:
                # a binding takes effect when its statement ends: `x = f(x)` reads the previous x
                row["end_pos"] = _at(node.end_lineno, node.end_col_offset)
        row.update(kw)
        self.rows.append(row)

    def emit_value(self, fact: str, node: ast.AST, value: ast.AST, **kw) -> None:
        fmt, parts = self.parts.split(value)
        src = self.parts.text_of(value)
        for i, p in enumerate(parts):
            row = dict(kw)
            row.update(p)
            row.update(part=i, fmt=fmt, src=src)
            self.emit(fact, node, **row)

    def branch_info(self) -> dict:
        return {"branch_depth": len(self.arms), "branch_arm": self.arms[-1] if self.arms else None}

    def use(self, kind: str, value: str) -> None:
        """A read of a name or attribute other than by a direct call; once per scope."""
        key = (self.scopes[-1], kind, value, self.hidden[-1] or "orelse" in self.arms)
        if key not in self.used:
            self.used.add(key)
            self.emit("use", kind=kind, value=value)

    def in_block(self, body: list[ast.AST], split: int | None = None, end: int | None = None):
        """The nodes of an arm (of statement ``split``) or of a loop that ends at ``end``."""
        self.n_blocks += 1
        self.blocks.append({"id": self.n_blocks, "split": split, "end": end})
        yield from body
        self.blocks.pop()

    # ---------------------------------------------------------------- scopes
    def _inside(self, qual: str, cls: str | None, body: list[ast.stmt]):
        self.scopes.append(qual)
        self.classes.append(cls)
        self.declared.append(set())
        self.hidden.append(self.hidden[-1] or "orelse" in self.arms)
        saved, self.arms = self.arms, []
        around, self.blocks = self.blocks, []
        yield from body
        self.arms, self.blocks = saved, around
        self.hidden.pop()
        self.declared.pop()
        self.classes.pop()
        self.scopes.pop()

    def _named(self, node, kind: str, detail: str | None = None) -> str:
        parent = self.scopes[-1]
        qual = node.name if parent == MODULE else f"{parent}.{node.name}"
        self.emit("def", node, name=node.name, qual=qual, kind=kind, detail=detail)
        self.unknown(node, node.name, "<def>")
        return qual

    def _function(self, node):
        yield from node.decorator_list
        parent = self.scopes[-1]
        marks = [d.attr if isinstance(d, ast.Attribute) else getattr(d, "id", None) for d in node.decorator_list]
        detail = next((QUIET[m] for m in marks if m in QUIET), None)
        if any(m not in QUIET for m in marks):
            self.use("name", node.name)              # the decorator gets the function
        qual = self._named(node, "function", detail)
        a = node.args
        positional = list(a.posonlyargs) + list(a.args)
        names = self.bound.setdefault(qual, set())
        for i, arg in enumerate(positional):
            self.emit("param", node, scope=qual, name=arg.arg, slot=str(i), slot_kind="only" if i < len(a.posonlyargs) else "pos")
        for arg in a.kwonlyargs:
            self.emit("param", node, scope=qual, name=arg.arg, slot=None, slot_kind="kw")
        for arg in filter(None, (a.vararg, a.kwarg)):
            self.emit("param", node, scope=qual, name=arg.arg, slot=None, slot_kind="rest")
        given = [*zip(positional[len(positional) - len(a.defaults):], a.defaults, strict=True),
                 *((p, d) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None)]
        for arg, value in given:
            self.emit_value("default", node, value, scope=qual, name=arg.arg, qual=parent)
        names.update(x.arg for x in [*positional, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))])
        yield from [*a.defaults, *[d for d in a.kw_defaults if d is not None]]
        yield from self._inside(qual, self.classes[-1] if parent != MODULE and self.classes[-1] == parent else None, node.body)

    visit_FunctionDef = _function
    visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef):
        yield from [*node.decorator_list, *node.bases, *node.keywords]
        if node.decorator_list:
            self.use("name", node.name)
        qual = self._named(node, "class", "bases" if node.bases else None)
        self.class_scopes.add(qual)
        yield from self._inside(qual, qual, node.body)

    def visit_If(self, node: ast.If):
        yield node.test
        self.n_blocks += 1
        split = self.n_blocks
        for arm, body in (("body", node.body), ("orelse", node.orelse)):
            self.arms.append(arm)
            yield from self.in_block(body, split)
            self.arms.pop()

    def visit_Try(self, node):
        self.jumps.add(self.scopes[-1])
        yield from self.in_block(node.body)
        for handler in node.handlers:
            yield from self.in_block([handler])
        yield from self.in_block(node.orelse)
        yield from node.finalbody

    visit_TryStar = visit_Try

    def _jump(self, node):
        self.jumps.add(self.scopes[-1])
        yield from ()

    visit_Break = _jump
    visit_Continue = _jump

    # ---------------------------------------------------------------- uses
    def visit_Name(self, node: ast.Name):
        if isinstance(node.ctx, ast.Load) and id(node) not in self.plain:
            self.use("name", node.id)
        yield from ()

    def visit_Attribute(self, node: ast.Attribute):
        if isinstance(node.ctx, ast.Load) and id(node) not in self.plain:
            self.use("attr", node.attr)
        if isinstance(node.value, ast.Name):
            self.plain.add(id(node.value))           # reading an attribute calls nothing that the name holds
        yield node.value

    # ---------------------------------------------------------------- bindings
    def unknown(self, node: ast.AST, name: str, why: str, slot: str | None = None) -> None:
        """A binding whose value is not known: references after it stay symbols."""
        if name in self.declared[-1]:
            self.globals.add(name)
        else:
            self.bound.setdefault(self.scopes[-1], set()).add(name)
        self.emit("bind", node, name=name, slot=slot, part=0, fmt="plain", kind="expr", value=why, src=why)

    def targets(self, node: ast.AST, target: ast.AST, why: str) -> None:
        """Unknown bindings of every name in a target, nested ones included."""
        for x in ast.walk(target):
            if isinstance(x, ast.Name) and isinstance(x.ctx, (ast.Store, ast.Del)):
                self.unknown(node, x.id, why)

    def _bind_target(self, node: ast.AST, target: ast.AST, value: ast.AST | None, simple_def: bool) -> None:
        if isinstance(target, ast.Name):
            if simple_def:
                self.emit("def", node, name=target.id, qual=None, kind="assign")
            if value is None or target.id in self.declared[-1]:
                self.unknown(node, target.id, "<augmented>" if value is None else "<global>")
                return
            self.bound.setdefault(self.scopes[-1], set()).add(target.id)
            self.emit_value("bind", node, value, name=target.id, **self.chain_of(value))
            if isinstance(value, ast.Dict):
                for k, v in zip(value.keys, value.values):
                    lit = _literal(k) if k is not None else None
                    if lit is None:
                        continue
                    key = json.dumps(lit[1]) if lit[0] == "str" else lit[1]
                    self.emit_value("bind", node, v, name=target.id, slot=key)
        elif (isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name)
              and target.value.id == "self" and self.classes[-1] is not None):
            if value is None:
                self.emit("bind", node, name=f"self.{target.attr}", scope=self.classes[-1], qual=self.scopes[-1], part=0,
                          fmt="plain", kind="expr", value="<augmented>", src="<augmented>")
            else:
                self.emit_value("bind", node, value, name=f"self.{target.attr}", scope=self.classes[-1], qual=self.scopes[-1],
                                **self.chain_of(value))
        elif isinstance(target, ast.Subscript) and isinstance(target.value, ast.Name):
            lit = _literal(target.slice)
            if lit is None or value is None:          # any entry may have changed
                self.unknown(node, target.value.id, "<entry>")
            else:
                key = json.dumps(lit[1]) if lit[0] == "str" else lit[1]
                self.emit_value("bind", node, value, name=target.value.id, slot=key)
        else:
            self.targets(node, target, "<unpacked>")

    @staticmethod
    def chain_of(value: ast.AST) -> dict:
        """Root and text of a value that is a chain of attributes, calls and entries on a name."""
        if isinstance(value, ast.Call):
            text, root, _, _ = _receiver(value.func) if isinstance(value.func, ast.Attribute) else ("", "<expr>", True, 0)
            if root != "<expr>":
                return {"receiver": f"{text}.{value.func.attr}()", "receiver_root": root, "receiver_is_call": True}
        elif isinstance(value, ast.Attribute):
            text, root, is_call, _ = _receiver(value)
            if root != "<expr>":
                return {"receiver": f"{text}.{value.attr}", "receiver_root": root, "receiver_is_call": is_call}
        elif isinstance(value, ast.Name):
            return {"receiver": value.id, "receiver_root": value.id, "receiver_is_call": False}
        return {}

    def is_alias(self, node: ast.Assign) -> bool:
        """``a = b`` or ``self.a = b``: what b holds goes on to a, so it is no use of its own."""
        def simple(t):
            if isinstance(t, ast.Name):
                return t.id not in self.declared[-1]
            return isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and self.classes[-1] is not None
        return all(map(simple, node.targets))

    def visit_Assign(self, node: ast.Assign):
        if isinstance(node.value, ast.Name) and self.is_alias(node):
            self.plain.add(id(node.value))
        yield node.value
        for t in node.targets:
            self._bind_target(node, t, node.value, simple_def=True)
            if not isinstance(t, ast.Name):
                yield t

    def visit_AnnAssign(self, node: ast.AnnAssign):
        if node.value is not None:
            yield node.value
            self._bind_target(node, node.target, node.value, simple_def=False)

    def visit_AugAssign(self, node: ast.AugAssign):
        yield node.value
        self._bind_target(node, node.target, None, simple_def=False)

    def visit_NamedExpr(self, node: ast.NamedExpr):
        yield node.value
        self.targets(node, node.target, "<walrus>")

    def _loop(self, node):
        yield node.iter
        yield from self.in_block(self.loop_body(node), end=_at(node.body[-1].end_lineno, node.body[-1].end_col_offset))
        yield from node.orelse

    def loop_body(self, node):
        if not isinstance(node, ast.While):
            self.targets(node.target, node.target, "<loop>")
            yield node.target
        else:
            yield node.test
        yield from node.body

    visit_For = _loop
    visit_AsyncFor = _loop

    def visit_While(self, node: ast.While):
        yield from self.in_block(self.loop_body(node), end=_at(node.body[-1].end_lineno, node.body[-1].end_col_offset))
        yield from node.orelse

    def visit_withitem(self, node: ast.withitem):
        yield node.context_expr
        if node.optional_vars is not None:
            self.targets(node.optional_vars, node.optional_vars, "<with>")

    def visit_ExceptHandler(self, node: ast.ExceptHandler):
        if node.type is not None:
            yield node.type
        if node.name:
            start = node.body[0]
            self.unknown(start, node.name, "<except>")
            self.rows[-1]["end_pos"] = self.rows[-1]["pos"]
        yield from node.body

    def visit_Delete(self, node: ast.Delete):
        for t in node.targets:
            self.targets(node, t, "<deleted>")
            yield t

    def _declare(self, node):
        self.declared[-1].update(node.names)
        if isinstance(node, ast.Nonlocal):
            self.globals.update(node.names)
        yield from ()

    visit_Global = _declare
    visit_Nonlocal = _declare

    def visit_Match(self, node):
        yield node.subject
        self.n_blocks += 1
        split = self.n_blocks
        for case in node.cases:
            yield from self.in_block(self.case_body(case), -split)

    def case_body(self, case):
        for x in ast.walk(case.pattern):
            name = getattr(x, "name", None) or getattr(x, "rest", None)
            if isinstance(name, str):
                self.unknown(case.body[0], name, "<match>")
        if case.guard is not None:
            yield case.guard
        yield from case.body

    def _import(self, node) -> None:
        base = getattr(node, "module", None)
        for alias in node.names:
            if isinstance(node, ast.Import):
                bound = alias.asname or alias.name.split(".")[0]
                module = alias.name
                target = alias.name if alias.asname else alias.name.split(".")[0]
            else:
                bound = alias.asname or alias.name
                module = f"{'.' * node.level}{base or ''}"
                target = f"{module}.{alias.name}" if module else alias.name
            self.emit("import", node, name=bound, qual=target, module=module)
            self.unknown(node, bound, "<import>")
        yield from ()

    visit_Import = _import
    visit_ImportFrom = _import

    # ---------------------------------------------------------------- calls
    def visit_Call(self, node: ast.Call):
        func = node.func
        info = None
        if isinstance(func, ast.Name):
            self.plain.add(id(func))
            info = {"name": func.id, "call_form": "name", "receiver": None, "receiver_root": None,
                    "receiver_is_call": False, "chain_depth": 0}
        elif isinstance(func, ast.Attribute):
            self.plain.add(id(func))
            text, root, is_call, depth = _receiver(func)
            info = {"name": func.attr, "call_form": "attr", "receiver": text, "receiver_root": root,
                    "receiver_is_call": is_call, "chain_depth": depth}
        if info is not None:
            if info["name"] in DYNAMIC:
                self.use("any", "*")
            elif info["name"] in BY_NAME:
                at = BY_NAME[info["name"]]
                name = node.args[at] if len(node.args) > at else None
                if isinstance(name, ast.Constant) and isinstance(name.value, str):
                    self.use("text", name.value)
                else:
                    self.use("any", "*")
            self.calls += 1
            ordinal = self.calls
            self.emit("call", node, call_ord=ordinal, **info, **self.branch_info())
            for i, a in enumerate(node.args):
                if isinstance(a, ast.Starred):
                    self.emit("arg", node, call_ord=ordinal, slot=str(i), slot_kind="star", part=0, fmt="plain",
                              kind="expr", value=self.parts.text_of(a), src=self.parts.text_of(a))
                else:
                    self.emit_value("arg", node, a, call_ord=ordinal, slot=str(i), slot_kind="pos")
            for kw in node.keywords:
                if kw.arg is None:
                    self.emit("arg", node, call_ord=ordinal, slot="**", slot_kind="star", part=0, fmt="plain",
                              kind="expr", value=self.parts.text_of(kw.value), src=self.parts.text_of(kw.value))
                else:
                    self.emit_value("arg", node, kw.value, call_ord=ordinal, slot=kw.arg, slot_kind="kw")
        yield from ast.iter_child_nodes(node)


def parse_source(source: str, script_id: int, script_ord: int) -> list[dict]:
    """Fact rows of one script; a script that does not parse gives one error row."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as exc:
        return [{"script_id": script_id, "script_ord": script_ord, "fact": "error", "scope": MODULE,
                 "detail": f"{type(exc).__name__}: {exc}"}]
    walker = _Walker(source, script_id, script_ord)
    walker.walk(tree)
    return walker.rows


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in FACT_SCHEMA.fields]
    for batch in batches:
        ids, places, sources = (batch.column(i).to_pylist() for i in range(3))
        rows: list[dict] = []
        for i, (sid, sord, src) in enumerate(zip(ids, places, sources, strict=True)):
            rows.extend(parse_source(src if src is not None else "", sid, sord))
            if len(rows) >= BATCH_ROWS or i + 1 == len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_COLS, types, strict=True)], names=_COLS)
                rows = []


def normalize_sources(scripts: DataFrame) -> DataFrame:
    """X4 + X5: tabs to four spaces, then the common indent removed (native)."""
    return scripts.withColumn("normalized", dedent_text(expand_tabs("source")))


def parse_tasks(scripts: DataFrame) -> int:
    """How many tasks parse ``scripts``: of ``TASK_SCRIPTS`` scripts or ``TASK_CHARS`` characters each, whichever are more."""
    rows, chars = scripts.agg(F.count(F.lit(1)), F.sum(F.length("source"))).head()
    return max(1, -(-rows // TASK_SCRIPTS), -(-(chars or 0) // TASK_CHARS))


def extract_facts(scripts: DataFrame, tasks: int | None = None) -> DataFrame:
    """``scripts(script_id, script_ord, source)`` -> fact rows (see module doc).

    The scripts are dealt out to ``tasks`` first, by default as many as their number and length ask for:
    the facts are many times as large as the scripts, and a columnar file of many scripts is one split.
    """
    ship_package(scripts.sparkSession)
    scripts = scripts.select("script_id", "script_ord", "source")
    # by the rows' own values: no task sorts its input, and a repeated task deals alike
    scripts = scripts.repartition(tasks or parse_tasks(scripts), *scripts.columns)
    norm = normalize_sources(scripts).select("script_id", "script_ord", "normalized")
    return norm.mapInArrow(_parse_batches, FACT_SCHEMA)


def quarantine(facts: DataFrame) -> DataFrame:
    """scripts that could not be parsed."""
    return facts.filter(F.col("fact") == "error").select("script_id", "script_ord", F.col("detail").alias("error"))
