"""Registered script-inventory queries and their DuckDB twins.

The corpus is ``quarry.sources.corpus.templated_scripts`` (one program per
``customer`` row), so the oracle is plain SQL over ``customer``: for each
program shape it lists the rows the extractor must give.  Arguments are shown
as text: strings quoted, other literals as JSON, kwargs sorted by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.inline import inline_calls
from quarry.operators import calls as C
from quarry.operators.callgraph import reachable_scopes
from quarry.operators.codefacts import extract_facts, normalize_sources, quarantine
from quarry.plans.calls import apply_policies, call_inventory, io_inventory
from quarry.session import materialize
from quarry.sources.corpus import templated_scripts
from quarry.sources.fixtures import table
from quarry.sources.scripts import targets_frame

TARGETS = ["load", "saveAsTable"]
INLINE_TARGET = "track"
SCRIPT_TAG = r"(?s)<script[^>]*>(.*?)</script>"
# for the oracle only: the calls of the given pages nest at most two levels deep
CALL_RE = r"\b(" + INLINE_TARGET + r")\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)"


def _inventory(spark: SparkSession, sf: str):
    return call_inventory(templated_scripts(spark, sf), targets_frame(spark, TARGETS))


def _shown(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select("script_id", "line", "function", "caller", C.render_args().alias("args"),
                       C.render_kwargs().alias("kwargs"), *extra)


def q_call_sites(spark, sf):
    return _shown(_inventory(spark, sf).calls, "reachable", "branch_arm")


def q_reachable_calls(spark, sf):
    return _shown(apply_policies(_inventory(spark, sf).calls), "branch_arm")


def q_branch_calls(spark, sf):
    inv = call_inventory(templated_scripts(spark, sf), targets_frame(spark, TARGETS), branches="taken")
    return _shown(apply_policies(inv.calls))


def q_calls_dedup(spark, sf):
    rows = C.dedup_calls(apply_policies(_inventory(spark, sf).calls))
    return _shown(rows, "occurrences")


def q_call_args_long(spark, sf):
    rows = _inventory(spark, sf).calls
    pos = rows.select("script_id", "line", "function", F.posexplode("args").alias("i", "v")).select(
        "script_id", "line", "function", F.col("i").cast("string").alias("slot"), "v")
    kw = rows.select("script_id", "line", "function", F.explode("kwargs").alias("slot", "v"))
    return pos.unionByName(kw).select("script_id", "line", "function", "slot",
                                      F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return extract_facts(templated_scripts(spark, sf))


def q_defined_names(spark, sf):
    d = C.defined_names(_facts(spark, sf))
    return d.select("script_id", F.array_join("names", ",").alias("names"))


def q_import_bindings(spark, sf):
    return C.import_bindings(_facts(spark, sf)).select(
        "script_id", "bound_name", "module", "target", "is_allowed")


def q_normalized_source(spark, sf):
    n = normalize_sources(templated_scripts(spark, sf))
    return n.select(
        "script_id",
        (F.length("normalized") - F.length(F.replace(F.col("normalized"), F.lit("\n"), F.lit("")))).alias("n_lines"),
        F.split(F.col("normalized"), "\n", -1)[0].alias("first_line"),
        (F.length("source") - F.length("normalized")).alias("chars_removed"),
    )


def q_script_quarantine(spark, sf):
    return quarantine(_facts(spark, sf)).select("script_id")


def q_partial_args(spark, sf):
    rows = _inventory(spark, sf).calls
    return rows.select("script_id", "line", F.explode("args").alias("v")).filter(
        F.col("v.kind") == "partial").select("script_id", "line", F.col("v.value").alias("value"))


def q_caller_path(spark, sf):
    rows = _inventory(spark, sf).calls.filter(F.col("caller") != "direct_call")
    return rows.select("script_id", "line", "function", "caller", "caller_qualified", "caller_kind")


def q_chained_loads(spark, sf):
    rows = apply_policies(_inventory(spark, sf).calls)
    kept = apply_policies(rows, drop_chained_load=True)
    return rows.join(kept.hint("merge"), ["script_id", "call_ord", "alt"], "left_anti").select("script_id", "line", "caller")


def q_invoked_scopes(spark, sf):
    facts = materialize(_facts(spark, sf), "facts", partition_by=["fact"])
    return reachable_scopes(facts).select("script_id", "scope", "depth")


def q_io_inventory(spark, sf):
    return io_inventory(templated_scripts(spark, sf))


def q_inline_call_sites(spark, sf):
    pages = table(spark, sf, "pages")
    bodies = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(SCRIPT_TAG), 1)).alias("body"))
    return inline_calls(bodies, "body", INLINE_TARGET).select("page_id", F.lit(INLINE_TARGET).alias("function"), "args")


QUERIES = {
    "call_sites": q_call_sites,
    "reachable_calls": q_reachable_calls,
    "branch_calls": q_branch_calls,
    "calls_dedup": q_calls_dedup,
    "call_args_long": q_call_args_long,
    "defined_names": q_defined_names,
    "import_bindings": q_import_bindings,
    "normalized_source": q_normalized_source,
    "script_quarantine": q_script_quarantine,
    "partial_args": q_partial_args,
    "caller_path": q_caller_path,
    "chained_loads": q_chained_loads,
    "invoked_scopes": q_invoked_scopes,
    "io_inventory": q_io_inventory,
    "inline_call_sites": q_inline_call_sites,
}

# --------------------------------------------------------------------------- oracle
_C = ("c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS ks, lower(c_mktsegment) AS s, "
      "CAST(c_nationkey AS VARCHAR) AS n, c_custkey % 8 AS t FROM customer)")


def _row(t: int, line: int, fn: str, caller: str, qualified: str, ckind: str, value: str, vkind: str,
         kwargs: str = "'{}'", reachable: str = "true", arm: str = "NULL", chained: str = "false") -> str:
    shown = f"'\"' || {value} || '\"'"
    return (f"SELECT k AS script_id, {line} AS line, '{fn}' AS function, {caller} AS caller, "
            f"{qualified} AS caller_qualified, '{ckind}' AS caller_kind, '[' || {shown} || ']' AS args, "
            f"{kwargs} AS kwargs, {reachable} AS reachable, CAST({arm} AS VARCHAR) AS branch_arm, "
            f"{chained} AS chained, {value} AS value0, '{vkind}' AS kind0 FROM c WHERE t = {t}")


_D = "'direct_call'"
_ROWS = [
    _row(0, 2, "load", _D, _D, "direct", "'s3a://lake/' || s || '/c' || ks || '.parquet'", "str"),
    _row(0, 3, "saveAsTable", "'df.write'", "'df.write'", "local", "'analytics.c' || ks", "str"),
    _row(0, 4, "load", "'spark.read.format()'", "'spark.read.format()'", "unbound",
         "'s3a://lake/' || s || '/raw' || ks || '.csv'", "str", chained="true"),
    _row(1, 4, "load", "'ps.session.read'", "'pyspark.sql.session.read'", "import",
         "'s3a://lake/' || s || '/n' || n || '/c' || ks", "str"),
    _row(1, 5, "saveAsTable", "'frame.write.mode()'", "'frame.write.mode()'", "local",
         "'lake_' || s || '.t' || ks", "str"),
    _row(2, 3, "load", _D, _D, "direct", "'s3a://lake/' || s || '/cfg' || ks", "str",
         kwargs="'{\"format\": \"parquet\"}'"),
    _row(3, 3, "load", _D, _D, "direct", "'s3a://lake/' || s || '/a'", "str", arm="'body'"),
    _row(3, 5, "load", _D, _D, "direct", "'s3a://lake/' || s || '/b'", "str", arm="'orelse'"),
    _row(4, 2, "load", _D, _D, "direct", "'s3a://lake//c' || ks", "partial"),
    _row(6, 1, "load", _D, _D, "direct", "'s3a://lake/' || s || '/d' || ks", "str",
         kwargs="'{\"header\": true, \"sep\": \",\"}'"),
    _row(6, 2, "load", _D, _D, "direct", "'s3a://lake/' || s || '/d' || ks", "str",
         kwargs="'{\"header\": true, \"sep\": \",\"}'"),
    _row(7, 2, "load", _D, _D, "direct", "'s3a://lake/' || s || '/u' || ks", "str", reachable="false"),
]
_EXP = f"WITH {_C}, e AS ({' UNION ALL '.join(_ROWS)}) "
_SHOWN = "script_id, line, function, caller, args, kwargs"

ORACLE = {
    "call_sites": _EXP + f"SELECT {_SHOWN}, reachable, branch_arm FROM e",
    "reachable_calls": _EXP + f"SELECT {_SHOWN}, branch_arm FROM e WHERE reachable",
    "branch_calls": _EXP + f"SELECT {_SHOWN} FROM e WHERE reachable AND coalesce(branch_arm, '') <> 'orelse'",
    "calls_dedup": _EXP + (
        "SELECT function, caller, args, kwargs, arg_min(script_id, script_id * 100000 + line) AS script_id, "
        "arg_min(line, script_id * 100000 + line) AS line, count(*) AS occurrences "
        "FROM e WHERE reachable GROUP BY function, caller, args, kwargs"),
    "call_args_long": _EXP + (
        "SELECT script_id, line, function, '0' AS slot, kind0 AS kind, value0 AS value FROM e "
        "UNION ALL SELECT script_id, line, function, 'format', 'str', 'parquet' FROM e "
        "WHERE kwargs LIKE '%format%' "
        "UNION ALL SELECT script_id, line, function, 'header', 'bool', 'true' FROM e WHERE kwargs LIKE '%header%' "
        "UNION ALL SELECT script_id, line, function, 'sep', 'str', ',' FROM e WHERE kwargs LIKE '%sep%'"),
    "defined_names": f"WITH {_C} SELECT k AS script_id, CASE t WHEN 0 THEN 'df,raw' WHEN 1 THEN 'db,frame,src' "
                     "WHEN 2 THEN 'cfg,run' WHEN 4 THEN 'path' WHEN 7 THEN 'unused' END AS names "
                     "FROM c WHERE t IN (0, 1, 2, 4, 7)",
    "import_bindings": f"WITH {_C} "
                       "SELECT k AS script_id, 'F' AS bound_name, 'pyspark.sql.functions' AS module, "
                       "'pyspark.sql.functions' AS target, false AS is_allowed FROM c WHERE t = 0 "
                       "UNION ALL SELECT k, 'ps', 'pyspark.sql', 'pyspark.sql', false FROM c WHERE t = 1 "
                       "UNION ALL SELECT k, 'sys', 'sys', 'sys', true FROM c WHERE t = 3",
    "normalized_source": f"WITH {_C} SELECT k AS script_id, "
                         "CAST(CASE t WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 2 END AS INTEGER) "
                         "AS n_lines, CASE t WHEN 0 THEN 'import pyspark.sql.functions as F' "
                         "WHEN 1 THEN 'import pyspark.sql as ps' "
                         "WHEN 2 THEN 'cfg = {\"src\": \"s3a://lake/' || s || '/cfg' || ks || '\", \"fmt\": \"parquet\"}' "
                         "WHEN 3 THEN 'import sys' WHEN 4 THEN 'path = f\"s3a://lake/{region}/c' || ks || '\"' "
                         "WHEN 5 THEN 'def broken(:' "
                         "WHEN 6 THEN 'load(\"s3a://lake/' || s || '/d' || ks || '\", header=True, sep=\",\")' "
                         "ELSE 'def unused():' END AS first_line, "
                         "CAST(CASE WHEN t = 6 THEN 5 ELSE 0 END AS INTEGER) AS chars_removed FROM c",
    "script_quarantine": f"WITH {_C} SELECT k AS script_id FROM c WHERE t = 5",
    "partial_args": _EXP + "SELECT script_id, line, value0 AS value FROM e WHERE kind0 = 'partial'",
    "caller_path": _EXP + "SELECT script_id, line, function, caller, caller_qualified, caller_kind FROM e "
                          "WHERE caller <> 'direct_call'",
    "chained_loads": _EXP + "SELECT script_id, line, caller FROM e WHERE chained AND reachable",
    "invoked_scopes": f"WITH {_C} SELECT k AS script_id, '<module>' AS scope, 0 AS depth FROM c WHERE t <> 5 "
                      "UNION ALL SELECT k, 'run', 1 FROM c WHERE t = 2",
    "io_inventory": _EXP + "SELECT script_id, line, function, CASE function WHEN 'load' THEN 'source' "
                           "ELSE 'sink' END AS direction, caller, kind0 AS kind, value0 AS target "
                           "FROM (SELECT function, caller, args, kwargs, any_value(kind0) AS kind0, any_value(value0) AS value0, "
                           "arg_min(script_id, script_id * 100000 + line) AS script_id, "
                           "arg_min(line, script_id * 100000 + line) AS line "
                           "FROM e WHERE reachable GROUP BY function, caller, args, kwargs)",
    "inline_call_sites": (
        "SELECT page_id, '" + INLINE_TARGET + "' AS function, a AS args FROM ("
        "SELECT page_id, unnest(regexp_extract_all(body, '" + CALL_RE + "', 2)) AS a FROM ("
        "SELECT page_id, unnest(regexp_extract_all(html, '" + SCRIPT_TAG + "', 1)) AS body FROM pages))"),
}
