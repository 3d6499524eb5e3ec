"""Registered queries on values, signatures, branches and roots, and their DuckDB twins.

The corpus is ``quarry.sources.corpus.flow_scripts`` (one program per ``customer``
row, ten shapes); the oracle lists for each shape the rows the extractor must
give, in plain SQL over ``customer``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import calls as C
from quarry.operators.callgraph import reachable_scopes
from quarry.operators.codefacts import extract_facts
from quarry.plans.calls import apply_policies, call_inventory
from quarry.session import materialize
from quarry.sources.corpus import flow_scripts
from quarry.sources.scripts import targets_frame

TARGETS = ["load", "saveAsTable"]


def _inventory(spark, sf, **more):
    return call_inventory(flow_scripts(spark, sf), targets_frame(spark, TARGETS), **more)


def q_resolved_args(spark, sf):
    """Every target call with what its arguments may be, one row per possibility."""
    return _inventory(spark, sf).calls.select("script_id", "line", "function", C.render_args().alias("args"),
                                              C.render_kwargs().alias("kwargs"), "reachable")


def q_first_arm_calls(spark, sf):
    """what runs, and with what, if the first arm of every ``if`` is taken."""
    rows = apply_policies(_inventory(spark, sf, branches="taken").calls)
    return rows.select("script_id", "line", "function", C.render_args().alias("args"))


def q_root_paths(spark, sf):
    """The import that a receiver stems from, through aliases, and what the filter of chained loads keeps."""
    rows = _inventory(spark, sf).calls
    kept = apply_policies(rows, reachable_only=False, drop_chained_load=True).select("script_id", "call_ord", "alt", F.lit(True).alias("kept"))
    return rows.filter("caller <> 'direct_call'").join(kept.hint("merge"), ["script_id", "call_ord", "alt"], "left").select(
        "script_id", "line", "caller", "root_path", F.coalesce("kept", F.lit(False)).alias("kept"))


def q_chain_depths(spark, sf):
    """Names on the way to each call."""
    return _inventory(spark, sf).calls.select("script_id", "line", "caller", "chain_depth").distinct()


def q_running_scopes(spark, sf):
    """Scopes that may run, by any way of handing a function on."""
    facts = materialize(extract_facts(flow_scripts(spark, sf)), "facts", partition_by=["fact"])
    return reachable_scopes(facts).select("script_id", "scope")


QUERIES = {
    "resolved_args": q_resolved_args,
    "first_arm_calls": q_first_arm_calls,
    "root_paths": q_root_paths,
    "chain_depths": q_chain_depths,
    "running_scopes": q_running_scopes,
}

# --------------------------------------------------------------------------- oracle
_C = ("c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS ks, lower(c_mktsegment) AS s, "
      "CAST(c_nationkey AS VARCHAR) AS n, c_custkey % 10 AS t FROM customer)")
#: (shape, line, function, first argument as SQL, keywords, runs, runs with first arms, caller, depth, root path as SQL)
_PLAIN = ("direct_call", 0, "NULL")
_EXPECTED = [
    (0, 4, "load", "'\"s3a://' || s || '/c' || ks || '\"'", "{}", True, True, *_PLAIN),
    (0, 4, "load", "'\"s3a://' || s || '/n' || n || '\"'", "{}", True, True, *_PLAIN),
    (1, 6, "saveAsTable", "'\"db_' || s || '.t' || ks || '\"'", '{"mode": "overwrite"}', True, True, "self.frame.write", 3, "NULL"),
    (2, 4, "load", "'\"s3a://' || s || '/a\"'", "{}", True, False, *_PLAIN),
    (2, 4, "load", "'\"s3a://' || s || '/b' || ks || '\"'", "{}", True, True, *_PLAIN),
    (3, 3, "load", "'\"s3a://' || s || '/p0\"'", "{}", True, True, *_PLAIN),
    (3, 3, "load", "'\"s3a://' || s || '/p' || n || 'x\"'", "{}", True, True, *_PLAIN),
    (4, 2, "load", "'<b>'", "{}", True, True, *_PLAIN),
    (4, 2, "load", "'\"s3a://' || s || '/b' || ks || '\"'", "{}", True, True, *_PLAIN),
    (4, 3, "load", "'<c>'", "{}", True, True, *_PLAIN),
    (4, 3, "load", "'\"x\"'", "{}", True, True, *_PLAIN),
    (5, 2, "load", "'\"s3a://' || s || '/first' || ks || '\"'", "{}", True, True, *_PLAIN),
    (5, 5, "load", "'\"s3a://' || s || '/second' || ks || '\"'", "{}", True, True, *_PLAIN),
    (5, 7, "load", "'\"s3a://' || s || '/third' || ks || '\"'", "{}", False, False, *_PLAIN),
    (6, 3, "load", "'\"s3a://' || s || '/enter' || ks || '\"'", "{}", True, True, *_PLAIN),
    (6, 8, "load", "'\"s3a://' || s || '/frame' || ks || '\"'", "{}", True, True, *_PLAIN),
    (6, 10, "load", "'\"s3a://' || s || '/never' || ks || '\"'", "{}", False, False, *_PLAIN),
    (7, 4, "load", "'\"s3a://' || s || '/r' || ks || '\"'", "{}", True, True, "reader.option()", 2, "'pyspark.sql.get().read.option()'"),
    (7, 5, "load", "'\"s3a://' || s || '/o' || ks || '\"'", "{}", True, True, "other.read()", 2, "NULL"),
    (8, 2, "load", "'\"s3a://' || s || '/old' || ks || '\"'", "{}", True, False, *_PLAIN),
    (8, 4, "load", "'\"s3a://' || s || '/new' || ks || '\"'", "{}", True, True, *_PLAIN),
    (9, 2, "load", "'\"s3a://' || s || '/c' || ks || '\"'", '{"format": "parquet"}', True, True, *_PLAIN),
    (9, 2, "load", "'\"s3a://' || s || '/d' || ks || '\"'", '{"format": "csv"}', True, True, *_PLAIN),
]
_E = " UNION ALL ".join(
    f"SELECT k AS script_id, {line} AS line, '{fn}' AS function, '[' || {arg} || ']' AS args, '{kw}' AS kwargs, {runs} AS reachable, "
    f"{first} AS first_arm, '{caller}' AS caller, {depth} AS chain_depth, CAST({root} AS VARCHAR) AS root_path FROM c WHERE t = {t}"
    for t, line, fn, arg, kw, runs, first, caller, depth, root in _EXPECTED)
_WITH = f"WITH {_C}, e AS ({_E}) "
#: Scopes that may run besides the module, by shape.
_SCOPES = {0: ["Paths", "Paths.read"], 1: ["Job", "Job.__init__", "Job.run"], 4: ["copy"], 5: ["first", "second"],
           6: ["Lake", "Lake.__enter__", "Lake.__exit__", "Lake.frame"], 8: ["old", "new"], 9: ["read"]}
_RUNNING = " UNION ALL ".join(f"SELECT k, '{scope}' FROM c WHERE t = {t}" for t, scopes in _SCOPES.items() for scope in scopes)

ORACLE = {
    "resolved_args": _WITH + "SELECT script_id, line, function, args, kwargs, reachable FROM e",
    "first_arm_calls": _WITH + "SELECT script_id, line, function, args FROM e WHERE first_arm",
    "root_paths": _WITH + "SELECT script_id, line, caller, root_path, NOT (function = 'load' AND caller LIKE '%()%' AND root_path IS NULL) AS kept "
                          "FROM e WHERE caller <> 'direct_call'",
    "chain_depths": _WITH + "SELECT DISTINCT script_id, line, caller, chain_depth FROM e",
    "running_scopes": f"WITH {_C} SELECT k AS script_id, '<module>' AS scope FROM c UNION ALL {_RUNNING}",
}
