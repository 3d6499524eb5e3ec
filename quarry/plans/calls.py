"""Call inventory of a script corpus, and its I/O view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import calls as C
from quarry.operators.callgraph import reachable_scopes
from quarry.operators.codefacts import extract_facts, quarantine
from quarry.operators.values import resolve_arguments
from quarry.session import materialize


@dataclass
class CallInventory:
    facts: DataFrame
    calls: DataFrame       # one row per target call and choice of bindings and call sites, before any row filter
    quarantine: DataFrame  # sources that could not be parsed


def arms_taken(facts: DataFrame, branches: str) -> DataFrame:
    """the facts that a branch policy lets happen.

    ``all`` keeps both arms of every ``if``; either may run.  ``taken`` keeps the
    first arm only, which then always runs: calls, bindings, definitions and
    functions of an ``else`` are no facts any more, and what an ``if`` binds is certain.
    """
    if branches == "all":
        return facts
    if branches != "taken":
        raise ValueError(f"unknown branch policy {branches!r}")
    return facts.filter(~F.coalesce("in_orelse", F.lit(False))).withColumn(
        "blocks", F.filter("blocks", lambda b: ~F.coalesce(b["split"] > 0, F.lit(False))))


def call_inventory(scripts: DataFrame, targets: DataFrame, branches: str = "all") -> CallInventory:
    """Parse once (written as Parquet partitioned by fact kind, so each later step reads only its
    rows and columns), find reachable scopes, resolve arguments, attribute callers; the branch policy
    holds from the facts on."""
    parsed = materialize(extract_facts(scripts), "facts", partition_by=["fact"])
    facts = arms_taken(parsed, branches)
    reach = reachable_scopes(facts)
    inst = materialize(C.call_instances(facts, reach, targets), "call-instances")
    argv = C.assemble_arguments(resolve_arguments(facts, inst, reach))
    rows = materialize(C.call_rows(facts, inst, argv), "call-rows")
    return CallInventory(facts=facts, calls=rows, quarantine=quarantine(parsed))


def apply_policies(rows: DataFrame, reachable_only: bool = True, branches: str = "all",
                   drop_chained_load: bool = False) -> DataFrame:
    """F6 reachability, F4 chained loads, and of F5 the rows of an inventory of all arms that lie in a taken one."""
    out = rows
    if reachable_only:
        out = out.filter(F.col("reachable"))
    if branches == "taken":
        out = out.filter(~F.col("in_orelse"))
    elif branches != "all":
        raise ValueError(f"unknown branch policy {branches!r}")
    if drop_chained_load:
        out = out.filter(~((F.col("function") == "load") & F.col("receiver_is_call") & F.col("root_path").isNull()))
    return out


def extract_calls(scripts: DataFrame, targets: DataFrame, reachable_only: bool = True, branches: str = "all",
                  drop_chained_load: bool = False, dedup: bool = True) -> DataFrame:
    """The call rows the reference's extractor returns, de-duplicated, in script then call order."""
    inv = call_inventory(scripts, targets, branches)
    rows = apply_policies(inv.calls, reachable_only, drop_chained_load=drop_chained_load)
    return (C.dedup_calls(rows) if dedup else rows).orderBy("script_ord", "call_ord", "alt")


# The keyword that names what a sink or source call works on.
TARGET_KEYWORDS = {"source": "path", "sink": "name"}


def io_inventory(scripts: DataFrame, sources=("load",), sinks=("saveAsTable",)) -> DataFrame:
    """Which paths are read and which tables are written; equal calls count once (A5).

    The target is the first positional argument or the keyword of ``TARGET_KEYWORDS``; a call with
    neither is listed with a null target.
    """
    spark = scripts.sparkSession
    names = [(n, "source", TARGET_KEYWORDS["source"]) for n in sources] + [(n, "sink", TARGET_KEYWORDS["sink"]) for n in sinks]
    targets = spark.createDataFrame(names, "function string, direction string, keyword string")
    rows = C.dedup_calls(apply_policies(call_inventory(scripts, targets.select("function")).calls))
    first = F.coalesce(F.get("args", F.lit(0)), F.try_element_at("kwargs", F.col("keyword")))
    return rows.join(F.broadcast(targets), "function").select(
        "script_id", "line", "function", "direction", "caller",
        first["kind"].alias("kind"), first["value"].alias("target"))
