"""Script-inventory operators on fact rows: target calls, their callers and arguments, de-duplication.

* ``call_instances`` (F2/J3): target calls, and whether they may run.
* ``assemble_arguments`` (X7-X9): args / kwargs as ``struct<kind, value>`` from resolved parts.
* ``root_paths`` (F4, J6): names and attributes followed through aliases to the import they stem from.
* ``call_rows`` (J6, X6): caller text, the caller's import-qualified path, the import at its root.
* ``dedup_calls`` (A5, W2, O1): first occurrence of each structurally equal row, kwargs compared without regard to order.

Which functions run is in ``callgraph``, what arguments stand for in ``values``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.callgraph import facts_of, variable
from quarry.operators.values import ALT_TYPE
from quarry.session import materialize

VALUE_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

# Modules whose imports the tolerant extractor keeps real.
ALLOWED_MODULES = ["sys", "math"]


def call_instances(facts: DataFrame, reach: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Calls (optionally only target calls) with ``reachable`` (F6): its scope is entered from module level."""
    calls = facts_of(facts, "call")
    if targets is not None:
        names = targets.select(F.col("function").alias("name")).distinct()
        calls = calls.join(names, "name", "left_semi")
    entered = reach.select("script_id", "scope", F.lit(True).alias("reachable"))
    return calls.join(entered.hint("merge"), ["script_id", "scope"], "left").withColumn(
        "reachable", F.coalesce("reachable", F.lit(False)))


def assemble_arguments(parts: DataFrame) -> DataFrame:
    """(script_id, call_ord, alt, args, kwargs) from resolved parts.

    One literal part keeps its literal kind; several literal parts (an
    f-string or ``+``) give ``str``; an f-string with unresolved parts gives
    ``partial`` with those parts empty; anything else is a ``symbol`` holding
    the argument's source text.
    """
    per_arg = parts.groupBy("script_id", "call_ord", "alt", "slot", "slot_kind").agg(
        F.sort_array(F.collect_list(F.struct("path", "kind", "lit_kind", "value", "text", "fmt"))).alias("p"),
        F.first("arg_src").alias("arg_src"))
    p = F.col("p")
    all_lit = F.forall(p, lambda x: x["kind"] == "lit")
    composite = (F.size(p) > 1) | F.exists(p, lambda x: x["fmt"] != "plain")
    is_f = F.exists(p, lambda x: x["fmt"] == "fstring")
    kind = (F.when(~composite & all_lit, p[0]["lit_kind"]).when(composite & all_lit, F.lit("str"))
            .when(composite & is_f, F.lit("partial")).otherwise(F.lit("symbol")))
    value = (F.when(~composite & all_lit, p[0]["value"])
             .when(composite & all_lit, F.array_join(F.transform(p, lambda x: x["text"]), ""))
             .when(composite & is_f, F.array_join(F.transform(
                 p, lambda x: F.when(x["kind"] == "lit", x["text"]).otherwise(F.lit(""))), ""))
             .otherwise(F.col("arg_src")))
    v = per_arg.select("script_id", "call_ord", "alt", "slot", "slot_kind",
                       F.struct(kind.alias("kind"), value.alias("value")).alias("v"))
    positional = (F.col("slot_kind") != "kw") & (F.col("slot") != "**")
    return v.groupBy("script_id", "call_ord", "alt").agg(
        F.transform(F.sort_array(F.collect_list(F.when(positional, F.struct(F.col("slot").cast("int").alias("i"),
                                                                             F.col("v"))))),
                    lambda x: x["v"]).alias("args"),
        F.map_from_entries(F.collect_list(F.when(~positional, F.struct(F.col("slot"), F.col("v"))))).alias("kwargs"),
    )


# --------------------------------------------------------------------------- J6, rows
def import_bindings(facts: DataFrame) -> DataFrame:
    """U3 + X14: one row per imported alias; the latest import of a name wins."""
    imp = facts_of(facts, "import")
    return imp.groupBy("script_id", F.col("name").alias("bound_name")).agg(
        F.max_by("module", "pos").alias("module"), F.max_by("qual", "pos").alias("target"),
        F.max("line").alias("line"),
    ).withColumn("is_allowed", F.col("module").isin(ALLOWED_MODULES))


def defined_names(facts: DataFrame) -> DataFrame:
    """Sorted set of function, class and simple assignment names per script."""
    return facts_of(facts, "def").groupBy("script_id").agg(F.sort_array(F.collect_set("name")).alias("names"))


def root_hops(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(script_id, place, up, suffix) of names and ``self.x`` that are bound once, to a chain on ``up``; and (script_id, place, target) of imports.

    A name that only imports bind stands for the latest of them.
    """
    def place(scope: str) -> Column:
        own = F.col("name").startswith("self.")
        return F.when(own, F.concat(F.lit("s:"), F.col(scope), F.lit(":"), F.expr("substring(name, 6)"))).otherwise(variable(scope, "name"))

    binds = facts_of(facts, "bind").filter("part = 0 AND slot IS NULL").withColumn("place", place("scope"))
    counts = binds.groupBy("script_id", "place").agg(F.countDistinct("pos").alias("n"))
    imports = facts_of(facts, "import").withColumn("place", place("scope")).groupBy("script_id", "place").agg(
        F.max_by("qual", "pos").alias("target"), F.countDistinct("pos").alias("n_imports"))
    known = counts.join(imports.hint("merge"), ["script_id", "place"], "left")
    once = binds.join(known.filter("n = 1 AND target IS NULL").hint("merge"), ["script_id", "place"], "left_semi").filter("receiver_root IS NOT NULL")
    hops = once.select("script_id", "place", *root_of()).filter("up IS NOT NULL AND up <> place")
    return hops, known.filter("n = n_imports").select("script_id", "place", "target")


def root_of() -> list[Column]:
    """``up``, the place at the root of a row's receiver (``self.x`` is one), and ``suffix``, the receiver behind it."""
    own = (F.col("receiver_root") == "self") & F.col("cls").isNotNull()
    attr = F.regexp_extract("receiver", r"^self\.(\w+)", 1)
    up = F.when(own, F.when(attr != "", F.concat(F.lit("s:"), F.col("cls"), F.lit(":"), attr))) \
        .when(F.col("root_home").isNotNull(), variable("root_home", "receiver_root"))
    skip = F.when(own, F.length(attr) + 6).otherwise(F.length("receiver_root") + 1)
    return [up.alias("up"), F.substring("receiver", skip, F.length("receiver")).alias("suffix")]


def root_paths(facts: DataFrame) -> DataFrame:
    """(script_id, place, root_path): names and ``self.x`` that stem from an import, with the path from it.

    Pointer jumping: every round a place takes the root of its root, so a chain
    of n aliases takes log(n) rounds.  Places whose aliases run in a circle never
    end; when a round ends no place, only such are left.
    """
    hops, imports = root_hops(facts)
    at, left = materialize(hops.withColumn("moves", F.lit(True)), "alias-hops"), None
    while True:
        n = at.filter("moves").count()
        if n == 0 or n == left:
            break
        left = n
        further = at.select("script_id", F.col("place").alias("up"), F.col("up").alias("next"), F.col("suffix").alias("before"))
        at = materialize(at.join(further.hint("merge"), ["script_id", "up"], "left").select(
            "script_id", "place", F.coalesce("next", "up").alias("up"), F.concat(F.coalesce("before", F.lit("")), "suffix").alias("suffix"),
            F.col("next").isNotNull().alias("moves")), "alias-hops")
    stops = imports.select("script_id", F.col("place").alias("up"), "target")
    through = at.join(stops.hint("merge"), ["script_id", "up"]).select("script_id", "place", F.concat("target", "suffix").alias("root_path"))
    return imports.withColumnRenamed("target", "root_path").unionByName(through)


def call_rows(facts: DataFrame, inst: DataFrame, argv: DataFrame) -> DataFrame:
    """Target-call rows with caller attribution (J6, X6) and the import that the receiver stems from."""
    imported = F.when(F.col("fact") == "import", F.struct("pos", "qual"))
    names = facts_of(facts, "import", "bind").groupBy("script_id", F.col("name").alias("receiver_root")).agg(
        F.max(imported)["qual"].alias("import_target"), F.max(F.when(F.col("fact") == "bind", True)).alias("is_local"))
    param_names = facts_of(facts, "param").select("script_id", "scope", F.col("name").alias("receiver_root")) \
        .distinct().withColumn("is_param", F.lit(True))
    rows = (inst.join(argv.hint("merge"), ["script_id", "call_ord"], "left")
            .join(names.hint("merge"), ["script_id", "receiver_root"], "left")
            .join(param_names.hint("merge"), ["script_id", "scope", "receiver_root"], "left"))
    attr = F.col("call_form") == "attr"
    caller = F.when(attr, F.col("receiver")).otherwise(F.lit("direct_call"))
    qualified = F.when(attr & F.col("import_target").isNotNull(), F.concat(
        F.col("import_target"), F.expr("substring(receiver, length(receiver_root) + 1)"))).otherwise(caller)
    caller_kind = (F.when(~attr, F.lit("direct")).when(F.col("import_target").isNotNull(), F.lit("import"))
                   .when(F.col("receiver_root") == "self", F.lit("self"))
                   .when(F.col("is_param").isNotNull(), F.lit("param"))
                   .when(F.col("is_local").isNotNull(), F.lit("local")).otherwise(F.lit("unbound")))
    roots = root_paths(facts).withColumnsRenamed({"place": "up"})
    rows = rows.select("*", *root_of()).join(roots.hint("merge"), ["script_id", "up"], "left")
    empty_args = F.array().cast(T.ArrayType(VALUE_TYPE))
    empty_kwargs = F.create_map().cast(T.MapType(T.StringType(), VALUE_TYPE))
    return rows.select(
        "script_id", "script_ord", "call_ord", F.coalesce("alt", F.array().cast(ALT_TYPE)).alias("alt"), "line", "scope", F.col("name").alias("function"),
        caller.alias("caller"), qualified.alias("caller_qualified"), caller_kind.alias("caller_kind"),
        F.coalesce("args", empty_args).alias("args"), F.coalesce("kwargs", empty_kwargs).alias("kwargs"),
        "reachable", "branch_depth", "branch_arm", "in_orelse", "receiver_is_call", "chain_depth",
        F.when(attr, F.concat("root_path", "suffix")).alias("root_path"),
    )


def dedup_calls(rows: DataFrame) -> DataFrame:
    """A5: keep the first (script_ord, call_ord, call-site choice) of each equal
    (function, caller, args, kwargs); kwargs compared as sorted entries.

    Equal rows are found by a digest and their first place by a number, so the
    partial step is a hash aggregate over two narrow columns and a row repeated
    across a third of the corpus is combined before the shuffle; the winners'
    columns come from a join back.
    """
    equal = F.to_json(F.struct("function", "caller", "args", F.array_sort(F.map_entries("kwargs")).alias("kwargs")))
    keyed = rows.withColumn("_key", F.unhex(F.sha2(equal, 256))).withColumn(
        "_at", F.col("script_ord").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("call_ord"))
    first = keyed.groupBy("_key").agg(F.min("_at").alias("_at"), F.count(F.lit(1)).alias("occurrences"))
    # one call may have the same row by several choices of call sites
    choice = Window.partitionBy("_key").orderBy("alt")
    return keyed.join(first.hint("merge"), ["_key", "_at"]).withColumn("_n", F.row_number().over(choice)).filter("_n = 1") \
        .select(*rows.columns, "occurrences")


# --------------------------------------------------------------------------- rendering
def render_value(v: Column) -> Column:
    """Display text of one ``struct<kind, value>``: strings quoted, symbols in angle brackets."""
    return (F.when(v["kind"].isin("str", "partial"), F.concat(F.lit('"'), v["value"], F.lit('"')))
            .when(v["kind"] == "symbol", F.concat(F.lit("<"), v["value"], F.lit(">")))
            .otherwise(v["value"]))


def render_args(c: Column | str = "args") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("["), F.array_join(F.transform(col, render_value), ", "), F.lit("]"))


def render_kwargs(c: Column | str = "kwargs") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    entries = F.array_sort(F.map_entries(col))
    return F.concat(F.lit("{"), F.array_join(F.transform(
        entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), render_value(e["value"]))), ", "), F.lit("}"))
