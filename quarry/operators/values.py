"""What an argument stands for (J4, X9): reaching bindings, call signatures, and the rounds that follow both.

A value (an argument, an assigned value, a parameter's default) has an *owner*
and one row per part; a part is a literal, a reference or unknown.  Three
relations say what a reference may stand for:

* ``reaching_bindings``: the bindings that may hold at a reference, by the arms
  and loops of its scope.  The latest binding that every way to the reference
  passes holds unless a later one in an arm, or one further down in a loop
  around the reference, may have replaced it; then each of them may hold.
* ``signature_bindings``: per call site and parameter, which argument the
  parameter gets by Python's rules, its default, or that it cannot be known.
* ``entry_sites``: the call sites that may enter a function.

``resolve_arguments`` replaces references round by round.  Where several bindings
or call sites are possible a call instance forks, once per possibility; the
choice is kept in ``alt``, so all arguments of an instance agree on it.  Parts
that are final are written once and never again; a round works on the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.callgraph import call_places, facts_of, place_edges
from quarry.operators.codefacts import MODULE
from quarry.session import materialize

REF_KINDS = ["ref", "sub", "attr"]
ALT_TYPE = "array<struct<scope:string,site:int>>"
WAYS_TYPE = "array<struct<owner:string,entry:boolean>>"
ASK = ["script_id", "owner", "part", "akey"]
INSTANCE = ["script_id", "call_ord", "alt"]
FAR = 1 << 62
#: Choices of an instance that are made from one row.
CHOICES = 4096


# --------------------------------------------------------------------------- values and their parts

def bind_owner() -> Column:
    return F.concat_ws(":", F.lit("b"), "scope", "name", F.coalesce("slot", F.lit("")), F.col("pos").cast("string"))


def value_parts(facts: DataFrame) -> DataFrame:
    """Every part of every value: owner, part, n_parts, what it is, and where its reference stands (scope, pos, blocks)."""
    owner = F.when(F.col("fact") == "arg", F.concat_ws(":", F.lit("a"), F.col("call_ord").cast("string"), "slot_kind", "slot")) \
        .when(F.col("fact") == "bind", bind_owner()).otherwise(F.concat_ws(":", F.lit("d"), "scope", "name", F.col("pos").cast("string")))
    rows = facts_of(facts, "arg", "bind", "default").withColumn("owner", owner)
    inside = F.when(F.col("fact") == "arg", F.col("scope")).otherwise(F.coalesce("qual", "scope"))
    rows = rows.select("script_id", "owner", "part", "kind", "lit_kind", "value", "text", "key", "fmt", "src", "home", "cls", "pos",
                       "blocks", inside.alias("scope")).dropDuplicates(["script_id", "owner", "part"])
    sizes = rows.groupBy("script_id", "owner").agg(F.count(F.lit(1)).alias("n_parts"))
    return rows.join(sizes.hint("merge"), ["script_id", "owner"])


def binding_heads(facts: DataFrame) -> DataFrame:
    """Bindings and parameters by variable: (script_id, scope, name, akey, pos, block, blocks, loose, owner, n).

    ``akey`` is the entry that is bound ('' for the whole value), ``pos`` where
    the binding takes effect, ``n`` its number among those of its variable and entry.
    ``ends``: it is loose or the next one is in another block; ``m`` counts these up to here.
    """
    last = F.try_element_at("blocks", F.lit(-1))["id"]
    binds = facts_of(facts, "bind").filter("part = 0").select(
        "script_id", "scope", "name", F.coalesce("slot", F.lit("")).alias("akey"), F.coalesce("end_pos", "pos").alias("pos"),
        F.when(F.size("blocks") > 0, last).otherwise(0).alias("block"), "blocks", F.coalesce("loose", F.lit(False)).alias("loose"),
        bind_owner().alias("owner"))
    params = facts_of(facts, "param").select(
        "script_id", "scope", "name", F.lit("").alias("akey"), F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("block"),
        F.array().cast(binds.schema["blocks"].dataType).alias("blocks"), F.lit(False).alias("loose"),
        F.concat_ws(":", F.lit("p"), "scope", "name").alias("owner"))
    every = binds.unionByName(params).dropDuplicates(["script_id", "owner"])
    order = Window.partitionBy("script_id", "scope", "name", "akey").orderBy("pos", "owner")
    last_there = F.col("loose") | ~F.col("block").eqNullSafe(F.lead("block").over(order))
    return every.withColumn("n", F.row_number().over(order)).withColumn("ends", last_there) \
        .withColumn("m", F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


# --------------------------------------------------------------------------- reaching bindings

def asks_of(parts: DataFrame) -> DataFrame:
    """What each reference asks for: a variable or ``self.x`` (scope, name), perhaps an entry, where, and by which rule.

    Rules: ``flow`` for a variable of the reference's own scope; ``all`` for
    ``self.x``, whose methods run in any order; ``once`` for a module's variable
    that a function reads, which may run before or after any statement.  Other
    references ask for nothing.
    """
    own_object = (F.col("kind") == "attr") | ((F.col("kind") == "sub") & F.col("value").startswith("self."))
    rule = F.when(own_object, F.when(F.col("cls").isNotNull(), F.lit("all"))) \
        .when(F.col("home") == F.col("scope"), F.lit("flow")).when(F.col("home") == MODULE, F.lit("once"))
    return parts.filter(F.col("kind").isin(REF_KINDS)).select(
        "script_id", "owner", "part", F.when(F.col("kind") == "sub", F.col("key")).otherwise("").alias("akey"), rule.alias("rule"),
        F.when(own_object, F.col("cls")).when(rule == "once", F.lit(MODULE)).otherwise(F.col("scope")).alias("a_scope"),
        F.col("value").alias("a_name"), F.col("pos").alias("at"), "blocks").filter("rule IS NOT NULL")


def as_of(heads: DataFrame, asks: DataFrame, by: list[str], take: Column) -> DataFrame:
    """``asks`` with ``last``: ``take`` of the latest head with equal ``by`` at or before ``upto``; one sort, no pairs."""
    asked = asks.withColumn("side", F.lit(1)).withColumn("got", F.lit(None).cast(heads.select(take.alias("t")).schema["t"].dataType))
    known = heads.select(*by, F.col("pos").alias("upto"), F.lit(0).alias("side"), take.alias("got"))
    window = Window.partitionBy(*by).orderBy("upto", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.unionByName(asked, allowMissingColumns=True).withColumn("last", F.last("got", ignorenulls=True).over(window)) \
        .filter("side = 1").drop("side", "got")


def reaching_bindings(asks: DataFrame, heads: DataFrame) -> DataFrame:
    """(script_id, owner, part, akey, var, ways): the bindings that may hold at each ask; none where it is unknown."""
    variable = ["script_id", "scope", "name", "akey"]
    version = F.explode(F.when(F.col("akey") == "", F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.col("akey"))))
    each = asks.select(*ASK, "rule", "at", "blocks", F.col("a_scope").alias("scope"), F.col("a_name").alias("name"),
                       version.alias("v")).withColumnsRenamed({"akey": "ask_key", "v": "akey"})
    asked = ["script_id", "owner", "part", "ask_key"]
    # the latest binding in each block around the reference: every way passes it
    around = each.filter("rule = 'flow'").withColumn(
        "block", F.explode(F.concat(F.array(F.lit(0)), F.transform("blocks", lambda b: b["id"])))).withColumn("upto", F.col("at"))
    found = as_of(heads.select(*variable, "block", "pos", F.col("owner").alias("h_owner")), around, [*variable, "block"],
                  F.struct("pos", F.col("h_owner").alias("owner"), "block"))
    passed = found.filter("last IS NOT NULL").groupBy(*asked).agg(
        F.max(F.struct(F.col("last.pos").alias("pos"), (F.col("akey") != "").alias("entry"), F.col("last.owner").alias("owner"),
                       F.col("last.block").alias("block"))).alias("d"))
    each = each.join(passed.hint("merge"), asked, "left")
    # loops around the reference that do not hold that binding: what is bound further down in them may hold as well
    inner = F.when(F.coalesce(F.col("d.block"), F.lit(0)) == 0, F.col("blocks")).otherwise(F.slice(
        "blocks", F.array_position(F.transform("blocks", lambda b: b["id"]), F.col("d.block")).cast("int") + 1, F.size("blocks")))
    loops = F.filter(inner, lambda b: b["end"].isNotNull())
    upto = F.when(F.col("rule") != "flow", F.lit(FAR)).otherwise(
        F.when(F.size(loops) > 0, F.greatest("at", F.get(loops, 0)["end"])).otherwise(F.col("at")))
    each = each.withColumn("limit", upto).withColumn("loops", F.transform(loops, lambda b: b["id"]))
    ends = each.select(*asked, "scope", "name", "akey", F.explode(F.array(
        F.struct(F.col("limit").alias("upto"), F.lit("hi").alias("which")),
        F.struct(F.least("limit", "at").alias("upto"), F.lit("mid").alias("which")),
        F.struct(F.coalesce("d.pos", F.lit(-2).cast("long")).alias("upto"), F.lit("lo").alias("which")))).alias("e")).select("*", "e.*").drop("e")
    numbered = as_of(heads.select(*variable, "pos", "n", "m"), ends, variable, F.struct("n", "m"))
    number = [F.coalesce(F.max(F.when(F.col("which") == w, F.col("last")[c])), F.lit(0)).cast("int").alias(f"{w}{x}")
              for w in ("lo", "mid", "hi") for c, x in (("n", ""), ("m", "_m"))]
    spans = numbered.groupBy(*asked, "akey").agg(*number)
    per_ask = each.join(spans.hint("merge"), [*asked, "akey"]).groupBy(*asked).agg(
        F.first("rule").alias("rule"), F.first("scope").alias("scope"), F.first("name").alias("name"), F.first("at").alias("at"),
        F.first("blocks").alias("blocks"), F.first("loops").alias("loops"), F.first("d").alias("d"),
        F.collect_list(F.struct("akey", "lo", "lo_m", "mid", "hi", "hi_m")).alias("spans"), F.sum(F.col("hi") - F.col("lo")).alias("more"),
        F.max(F.col("hi") - F.col("lo")).alias("most"))
    var = F.concat_ws(":", "scope", "name", "ask_key")
    sure = F.col("d").isNotNull() & (F.col("more") == 0)
    per_ask = materialize(per_ask.withColumn("var", var).withColumn("sure", sure), "asked")
    plain = per_ask.filter("sure").select(*asked, "var", F.array(F.struct(F.col("d.owner").alias("owner"), F.col("d.entry").alias("entry"))).alias("ways"))
    # a module's variable must be bound once; of a literal and its entry the later one counts
    listed = per_ask.filter(~F.col("sure") & (F.col("more") > 0) & ((F.col("rule") != "once") | (F.col("most") == 1)))
    if listed.isEmpty():
        return plain.withColumnRenamed("ask_key", "akey")
    # of bindings that follow each other in a block, on the same side of the reference, the last one is enough: it ends
    # them, or it is the last before the reference or the limit
    numbers = F.when(F.col("rule") != "flow", F.transform(F.sequence(F.col("s.lo") + 1, F.col("s.hi")), lambda i: F.struct(F.lit("any").alias("by"), i.alias("no")))) \
        .otherwise(F.concat(
            F.when(F.col("s.hi_m") > F.col("s.lo_m"), F.transform(F.sequence(F.col("s.lo_m") + 1, F.col("s.hi_m")), lambda i: F.struct(F.lit("end").alias("by"), i.alias("no"))))
            .otherwise(F.array().cast("array<struct<by:string,no:int>>")),
            F.transform(F.filter(F.array_distinct(F.array("s.mid", "s.hi")), lambda i: i > F.col("s.lo")), lambda i: F.struct(F.lit("open").alias("by"), i.alias("no")))))
    ones = listed.select(*asked, "var", "rule", "at", F.col("blocks").alias("r_blocks"), "loops", "d", "scope", "name", F.explode("spans").alias("s")) \
        .filter("s.hi > s.lo").withColumn("akey", F.col("s.akey")).withColumn("i", F.explode(numbers)).select("*", "i.*").drop("i", "s")
    numbered_heads = heads.select(*variable, "pos", "block", "blocks", "loose", F.col("owner").alias("h_owner"), F.explode(F.array(
        F.struct(F.lit("any").alias("by"), F.col("n").cast("int").alias("no")),
        F.when(F.col("ends"), F.struct(F.lit("end").alias("by"), F.col("m").cast("int").alias("no")))
        .otherwise(F.struct(F.lit("open").alias("by"), F.col("n").cast("int").alias("no"))))).alias("i")).select("*", "i.*").drop("i")
    ones = ones.join(numbered_heads.hint("merge"), [*variable, "by", "no"])
    other_arm = F.exists("blocks", lambda x: x["split"].isNotNull() & F.exists("r_blocks", lambda y: (y["split"] == x["split"]) & (y["id"] != x["id"])))
    comes_back = F.arrays_overlap(F.transform("blocks", lambda x: x["id"]), F.col("loops"))
    ones = ones.filter((F.col("rule") != "flow") | (F.col("pos") > F.col("at")) | ~other_arm | comes_back)
    same_place = Window.partitionBy(*asked, "pos").orderBy(F.desc("akey"))
    ones = ones.withColumn("k", F.row_number().over(same_place)).filter("k = 1")
    # a later binding of the same block replaces an earlier one, unless a jump may skip it
    replaced = Window.partitionBy(*asked, "block", F.col("pos") > F.col("at")).orderBy(F.desc("pos"))
    latest = Window.partitionBy(*asked).orderBy(F.desc("pos"))
    ones = ones.withColumn("k", F.row_number().over(replaced)).filter((F.col("rule") != "flow") | F.col("loose") | (F.col("k") == 1)) \
        .withColumn("k", F.row_number().over(latest)).filter((F.col("rule") != "once") | (F.col("k") == 1))
    others = ones.groupBy(*asked).agg(F.transform(F.sort_array(F.collect_list(F.struct(
        "pos", F.struct(F.col("h_owner").alias("owner"), (F.col("akey") != "").alias("entry")).alias("w")))), lambda o: o["w"]).alias("others"))
    none = F.array().cast(WAYS_TYPE)
    first = F.when(F.col("d").isNotNull(), F.array(F.struct(F.col("d.owner").alias("owner"), F.col("d.entry").alias("entry")))).otherwise(none)
    several = listed.select(*asked, "var", "d").join(others.hint("merge"), asked, "left").select(
        *asked, "var", F.concat(first, F.coalesce("others", none)).alias("ways")).filter(F.size("ways") > 0)
    return plain.unionByName(several).withColumnRenamed("ask_key", "akey")


# --------------------------------------------------------------------------- call signatures

def site_shapes(facts: DataFrame) -> DataFrame:
    """(script_id, site, ...): how a call passes its arguments and what it is called on."""
    args = facts_of(facts, "arg").filter("part = 0")
    starred = F.min(F.when((F.col("slot_kind") == "star") & (F.col("slot") != "**"), F.col("slot").cast("int")))
    shape = args.groupBy("script_id", "call_ord").agg(
        F.count(F.when(F.col("slot_kind") == "pos", 1)).alias("n_pos"), starred.alias("star"),
        F.max((F.col("slot") == "**").cast("int")).alias("rest"), F.collect_set(F.when(F.col("slot_kind") == "kw", F.col("slot"))).alias("kws"))
    classes = facts_of(facts, "def").filter("kind = 'class'").groupBy("script_id", F.col("name").alias("last_name")).agg(
        F.max("scope").alias("class_home"), F.count(F.lit(1)).alias("n_classes"))
    bound = facts_of(facts, "bind").filter("part = 0").groupBy("script_id", F.col("scope").alias("root_home"), F.col("name").alias("receiver_root")).agg(
        F.count(F.lit(1)).alias("n_bound"), F.max((F.col("kind") == "ref").cast("int")).alias("aliased"))
    makers = facts_of(facts, "def").filter("kind = 'function' AND detail = 'class'").select("script_id", F.col("qual").alias("scope"), F.lit(True).alias("in_classmethod")).distinct()
    calls = facts_of(facts, "call").withColumn("last_name", F.element_at(F.split("receiver", r"\."), -1)) \
        .join(classes.hint("merge"), ["script_id", "last_name"], "left").join(bound.hint("merge"), ["script_id", "root_home", "receiver_root"], "left") \
        .join(makers.hint("merge"), ["script_id", "scope"], "left")
    single = F.col("receiver") == F.col("receiver_root")
    the_class = single & (F.col("n_classes") == 1) & (F.col("class_home") == F.col("root_home")) & (F.col("n_bound") == 1)
    on = F.when(F.col("call_form") != "attr", F.lit(None)).when(the_class, F.lit("class")) \
        .when(single & (F.col("receiver") == "cls") & F.col("in_classmethod"), F.lit("class")) \
        .when(F.col("n_classes").isNotNull() | (single & (F.col("aliased") == 1)), F.lit("unknown")).otherwise(F.lit("object"))
    return calls.select("script_id", "call_ord", F.col("name").alias("callee"), "call_form", F.col("scope").alias("site_scope"), on.alias("on")) \
        .join(shape.hint("merge"), ["script_id", "call_ord"], "left").select(
            "script_id", F.col("call_ord").alias("site"), "callee", "call_form", "site_scope", "on", F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
            "star", (F.coalesce("rest", F.lit(0)) == 1).alias("rest"), F.coalesce("kws", F.array().cast("array<string>")).alias("kws"))


def function_shapes(facts: DataFrame) -> DataFrame:
    """(script_id, scope, f_name, f_cls, detail, is_method, n_defs) of every function."""
    defs = facts_of(facts, "def").filter("kind = 'function'")
    in_class = F.col("cls").isNotNull() & (F.col("scope") == F.col("cls"))
    return defs.groupBy("script_id", F.col("qual").alias("scope")).agg(
        F.max("name").alias("f_name"), F.max("cls").alias("f_cls"), F.max("detail").alias("detail"), F.max(in_class).alias("is_method"),
        F.countDistinct("pos").alias("n_defs"))


def leading() -> Column:
    """How many parameters come before those that the arguments fill; null where that cannot be known."""
    named = F.col("callee") == F.col("f_name")
    makes = (F.col("f_name") == "__init__") & ~named
    method = F.when(makes, 1).when(F.col("detail") == "static", 0).when(~named, F.lit(None).cast("int")) \
        .when((F.col("call_form") == "name") & (F.col("site_scope") == F.col("f_cls")), 0).when(F.col("call_form") == "name", F.lit(None).cast("int")) \
        .when(F.col("detail") == "class", 1).when(F.col("detail") == "property", F.lit(None).cast("int")) \
        .when(F.col("on") == "object", 1).when(F.col("on") == "class", 0)
    return F.when(F.col("is_method"), method).otherwise(0)


def signatures(facts: DataFrame) -> DataFrame:
    """(script_id, scope, name, ...): each parameter's place and kind, its default's owner, and its function's shape."""
    params = facts_of(facts, "param").groupBy("script_id", "scope", "name").agg(
        F.min(F.col("slot").cast("int")).alias("p_at"), F.min("slot_kind").alias("p_kind"), F.max("pos").alias("p_pos"))
    defaults = facts_of(facts, "default").filter("part = 0").select(
        "script_id", "scope", "name", F.col("pos").alias("p_pos"),
        F.concat_ws(":", F.lit("d"), "scope", "name", F.col("pos").cast("string")).alias("default_owner")) \
        .dropDuplicates(["script_id", "scope", "name", "p_pos"])
    return params.join(defaults.hint("merge"), ["script_id", "scope", "name", "p_pos"], "left").join(function_shapes(facts).hint("merge"), ["script_id", "scope"], "left")


def signature_bindings(wanted: DataFrame, params: DataFrame, sites: DataFrame) -> DataFrame:
    """``wanted`` (script_id, scope, name, site, ...) with ``bound``: the owner of the value that the parameter gets there.

    ``params`` is a table as by ``signatures``, ``sites`` as by ``site_shapes``.
    Null where nothing is passed or it cannot be known: behind a starred argument,
    in ``*args`` and ``**kwargs``, behind ``**``, if a function is defined more
    than once, or if it is not known whether a call passes the object itself.
    """
    rows = wanted.join(params.hint("merge"), ["script_id", "scope", "name"], "left").join(sites.hint("merge"), ["script_id", "site"], "left").withColumn("lead", leading())
    i = F.col("p_at") - F.col("lead")
    by_place = (F.col("p_kind") != "kw") & (i >= 0) & (i < F.coalesce("star", "n_pos"))
    by_name = F.array_contains("kws", F.col("name")) & (F.col("p_kind") != "only")
    behind_star = F.col("star").isNotNull() & (F.col("p_kind") != "kw") & (i >= F.col("star"))
    # the object itself is passed by no argument that can be seen
    unknown = F.col("lead").isNull() | (F.col("p_kind") == "rest") | (F.col("n_defs") != 1) | ((F.col("p_kind") != "kw") & (i < 0)) | F.col("call_form").isNull()
    site = F.col("site").cast("string")
    bound = F.when(unknown, F.lit(None)) \
        .when(by_name, F.concat_ws(":", F.lit("a"), site, F.lit("kw"), "name")) \
        .when(by_place, F.concat_ws(":", F.lit("a"), site, F.lit("pos"), i.cast("string"))) \
        .when(behind_star | F.col("rest"), F.lit(None)).otherwise(F.col("default_owner"))
    return rows.withColumn("bound", bound).select(*wanted.columns, "bound")


def entry_sites(facts: DataFrame, reach: DataFrame, scopes: DataFrame) -> DataFrame:
    """(script_id, scope, sites): the calls that run and may enter each asked function, not counting direct self-calls."""
    edges = place_edges(facts).filter("src <> '*'").select("script_id", F.col("dst").alias("place"), "src").distinct()
    edges = materialize(edges, "entry-edges")

    def back(places: DataFrame) -> DataFrame:
        return places.join(edges.hint("merge"), ["script_id", "place"]).select("script_id", "scope", F.col("src").alias("place")).distinct()

    # a function's names, and the names of the class that it makes objects of
    asked = scopes.select("script_id", "scope", F.concat(F.lit("f:"), "scope").alias("place")).distinct()
    named = back(asked)
    new = seen = materialize(named.unionByName(back(named.filter(F.col("place").startswith("c:")))).distinct(), "entered")
    # names that are aliases of those
    while True:
        new = materialize(back(new).join(seen.hint("merge"), ["script_id", "scope", "place"], "left_anti"), "entered")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    live = call_places(facts).join(reach.select("script_id", "scope").hint("merge"), ["script_id", "scope"], "left_semi")
    return live.select("script_id", "place", F.col("scope").alias("from_scope"), F.col("call_ord").alias("site")) \
        .join(seen.hint("merge"), ["script_id", "place"]).filter("from_scope <> scope") \
        .groupBy("script_id", "scope").agg(F.sort_array(F.collect_set("site")).alias("site_options"))


# --------------------------------------------------------------------------- rounds

_TODO = ["script_id", "call_ord", "alt", "slot", "slot_kind", "path", "owner", "part", "akey", "kind", "lit_kind", "value", "text", "fmt",
         "arg_src", "seen"]


def _fmt_merge(outer: Column, inner: Column) -> Column:
    return (F.when((outer == "fstring") | (inner == "fstring"), F.lit("fstring"))
            .when((outer == "concat") | (inner == "concat"), F.lit("concat")).otherwise(F.lit("plain")))


def alt_id() -> Column:
    return F.xxhash64(F.to_json("alt"))


def chosen_site(scope: Column) -> Column:
    """The instance's choice for a fork, null if it has none."""
    return F.get(F.filter("alt", lambda a: a["scope"] == scope), 0)["site"]


def forks(needs: DataFrame) -> DataFrame:
    """(instance, new_alt): every combination of the possibilities that an instance has to choose from in this round.

    Combinations are counted through, in rows of ``CHOICES`` numbers: an instance's are never together in a row.
    """
    def times(keys: Column) -> Column:
        return F.aggregate(keys, F.lit(1).cast("long"), lambda n, k: n * F.size(k["options"]))

    per = needs.groupBy(*INSTANCE).agg(F.sort_array(F.collect_set(F.struct("fork", "options"))).alias("keys")).withColumn("many", times(F.col("keys")))
    rows = per.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1, F.lit(CHOICES).cast("long")))) \
        .withColumn("c", F.explode(F.sequence("c", F.least(F.col("c") + CHOICES, "many") - 1)))
    made = F.transform("keys", lambda k, i: F.struct(k["fork"].alias("scope"), F.get(k["options"], F.pmod(F.call_function(
        "div", F.col("c"), times(F.slice("keys", F.lit(1), i))), F.size(k["options"])).cast("int")).alias("site")))
    return rows.select(*INSTANCE, F.array_sort(F.concat("alt", made)).alias("new_alt"))


def resolve_arguments(facts: DataFrame, inst: DataFrame, reach: DataFrame) -> DataFrame:
    """The final parts of every argument of ``inst``: script_id, call_ord, alt, slot, slot_kind, path, kind, ..., arg_src."""
    parts = materialize(value_parts(facts), "value-parts")
    heads = materialize(binding_heads(facts), "binding-heads")
    ways = materialize(reaching_bindings(asks_of(parts), heads), "ways")
    sites, known = materialize(site_shapes(facts), "site-shapes"), materialize(signatures(facts), "signatures")
    # call sites are looked up for functions whose parameters some reference may stand for
    asked = ways.select("script_id", F.explode("ways.owner").alias("o")).filter(F.col("o").startswith("p:")).distinct()
    params = facts_of(facts, "param").select("script_id", "scope", F.concat_ws(":", F.lit("p"), "scope", "name").alias("o"))
    options = materialize(entry_sites(facts, reach, params.join(asked.hint("merge"), ["script_id", "o"], "left_semi")), "entry-sites")

    calls = inst.select("script_id", "call_ord").distinct()
    mine = facts_of(facts, "arg").filter("part = 0").join(calls.hint("merge"), ["script_id", "call_ord"], "left_semi").select(
        "script_id", "call_ord", "slot", "slot_kind",
        F.concat_ws(":", F.lit("a"), F.col("call_ord").cast("string"), "slot_kind", "slot").alias("owner")).distinct()
    no_alt = F.array().cast(ALT_TYPE)
    every = mine.join(parts.hint("merge"), ["script_id", "owner"]).select(
        "script_id", "call_ord", no_alt.alias("alt"), "slot", "slot_kind", F.array("part").alias("path"), "owner", "part",
        F.when(F.col("kind") == "sub", F.col("key")).otherwise("").alias("akey"), "kind", "lit_kind", "value", "text", "fmt",
        F.col("src").alias("arg_src"), F.array().cast("array<string>").alias("seen"), F.col("kind").isin(REF_KINDS).alias("open"))
    every = materialize(every, "parts-0")
    done = [every.filter(~F.col("open"))]
    todo = every.filter("open").select(*_TODO)
    instances = calls.select("script_id", "call_ord", no_alt.alias("alt")).withColumn("line", F.array(alt_id()))
    rounds = 0
    n_open = todo.limit(1).count()
    while n_open:
        rounds += 1
        t = todo.join(ways.hint("merge"), ASK, "left").withColumn("n_ways", F.coalesce(F.size("ways"), F.lit(0)))
        t = t.withColumn("way_fork", F.concat(F.lit("v:"), "var", F.lit(":"), F.xxhash64("ways").cast("string")))
        t = t.withColumn("way_no", F.when(F.col("n_ways") == 1, F.lit(0)).otherwise(chosen_site(F.col("way_fork"))))
        t = t.withColumn("way", F.get("ways", F.col("way_no"))).withColumn("is_param", F.coalesce(F.col("way.owner").startswith("p:"), F.lit(False)))
        t = t.withColumn("f_scope", F.when(F.col("is_param"), F.expr("substring(way.owner, 3, length(way.owner) - 3 - length(value))")))
        t = t.join(options.withColumnRenamed("scope", "f_scope").hint("merge"), ["script_id", "f_scope"], "left")
        # what has to be chosen first: one of several bindings, or the call site that entered the function
        several = (F.col("n_ways") > 1) & F.col("way_no").isNull()
        unsited = F.col("is_param") & (F.size(F.filter("alt", lambda a: a["scope"] == F.col("f_scope"))) == 0)
        seen_before = F.array_contains("seen", F.coalesce("way.owner", F.lit("")))
        t = materialize(t.withColumn("several", several).withColumn("unsited", unsited & ~seen_before), "asked-parts")
        needs = t.filter("several OR unsited").select(*INSTANCE, F.when(F.col("several"), F.col("way_fork")).otherwise(F.col("f_scope")).alias("fork"),
                                                      F.when(F.col("several"), F.sequence(F.lit(0), F.col("n_ways") - 1))
                                                      .otherwise(F.coalesce("site_options", F.array(F.lit(-1)))).alias("options"))
        if not needs.isEmpty():
            split = materialize(forks(needs), "forks")
            t = t.join(split.hint("merge"), INSTANCE, "left").withColumn("alt", F.coalesce("new_alt", "alt")).drop("new_alt")
            t = t.withColumn("way_no", F.when(F.col("several"), chosen_site(F.col("way_fork"))).otherwise(F.col("way_no"))) \
                .withColumn("way", F.get("ways", F.col("way_no"))).withColumn("waits", F.coalesce(F.col("several") & F.col("way.owner").startswith("p:"), F.lit(False)))
            instances = materialize(instances.join(split.hint("merge"), INSTANCE, "left").withColumn("alt", F.coalesce("new_alt", "alt")).withColumn(
                "line", F.when(F.col("new_alt").isNotNull(), F.concat("line", F.array(alt_id()))).otherwise(F.col("line"))).drop("new_alt"), "instances")
        else:
            t = t.withColumn("waits", F.lit(False))
        t = t.drop("ways", "n_ways", "site_options")
        used = F.col("way.owner")
        usable = used.isNotNull() & ~F.array_contains("seen", used) & ~F.col("waits")
        t = t.withColumn("usable", usable).withColumn("site", F.when(F.col("is_param"), chosen_site(F.col("f_scope"))))
        by_param = t.filter("usable AND is_param").withColumn("scope", F.col("f_scope")).withColumn("name", F.col("value"))
        bound = signature_bindings(by_param, known, sites).withColumn("next", F.col("bound")).drop("scope", "name", "bound")
        by_bind = t.filter("usable AND NOT is_param").withColumn("next", used)
        step = bound.unionByName(by_bind)
        value = parts.select("script_id", F.col("owner").alias("next"), F.col("part").alias("r_part"), "n_parts", F.col("kind").alias("r_kind"),
                             F.col("lit_kind").alias("r_lit_kind"), F.col("value").alias("r_value"), F.col("text").alias("r_text"),
                             F.col("key").alias("r_key"), F.col("fmt").alias("r_fmt"))
        step = step.join(value.hint("merge"), ["script_id", "next"], "left")
        # an entry of a value that is itself a name or self.x: the entry of what that stands for
        entry = (F.col("akey") != "") & ~F.coalesce(F.col("way.entry"), F.lit(False))
        through = entry & (F.col("n_parts") == 1) & F.col("r_kind").isin("ref", "attr")
        stuck = F.col("r_part").isNull() | (entry & ~through)
        step = step.withColumn("through", through).withColumn("stuck", stuck).filter(~F.col("stuck") | F.coalesce(F.col("r_part"), F.lit(0)).isin(0))
        kind = F.when(F.col("stuck"), F.lit("expr")).when(F.col("through"), F.lit("sub")).otherwise(F.col("r_kind"))
        moved = step.select(
            "script_id", "call_ord", "alt", "slot", "slot_kind",
            F.when(F.col("stuck"), F.col("path")).otherwise(F.concat("path", F.array("r_part"))).alias("path"),
            F.col("next").alias("owner"), F.col("r_part").alias("part"),
            F.when(F.col("through"), F.col("akey")).when(F.col("r_kind") == "sub", F.col("r_key")).otherwise("").alias("akey"), kind.alias("kind"),
            F.when(~F.col("stuck") & ~F.col("through"), F.col("r_lit_kind")).alias("lit_kind"),
            F.when(F.col("stuck"), F.col("value")).otherwise(F.col("r_value")).alias("value"),
            F.when(~F.col("stuck") & ~F.col("through"), F.col("r_text")).alias("text"),
            F.when(F.col("stuck") | F.col("through"), F.col("fmt")).otherwise(_fmt_merge(F.col("fmt"), F.col("r_fmt"))).alias("fmt"), "arg_src",
            F.concat("seen", F.array(used)).alias("seen"), kind.isin(REF_KINDS).alias("open"), F.col("through").alias("asks"))
        rest = t.filter("NOT usable").withColumn("open", F.col("waits")).withColumn("asks", F.lit(False)).withColumn(
            "kind", F.when(F.col("waits"), F.col("kind")).otherwise(F.lit("expr")))
        now = materialize(moved.unionByName(rest.select(moved.columns)), f"parts-{rounds}")
        done.append(now.filter(~F.col("open")))
        todo = now.filter("open").select(*_TODO)
        n_open, n_asks = now.agg(F.count(F.when(F.col("open"), 1)), F.count(F.when(F.col("asks"), 1))).head()
        if n_asks:
            new = now.filter("asks").select(*ASK).distinct().join(ways.hint("merge"), ASK, "left_anti")
            where = parts.select("script_id", "owner", "part", "kind", "value", "key", "home", "cls", "pos", "blocks", "scope")
            more = new.withColumnRenamed("akey", "want").join(where.hint("merge"), ["script_id", "owner", "part"])
            own = asks_of(more.withColumn("kind", F.when(F.col("kind") == "attr", F.lit("attr")).otherwise(F.lit("ref"))))
            keyed = own.drop("akey").join(new.hint("merge"), ["script_id", "owner", "part"])
            ways = materialize(ways.unionByName(reaching_bindings(keyed, heads)), "ways")
    # an instance's final parts are those of each stage of its choices
    cols = ["slot", "slot_kind", "path", "kind", "lit_kind", "value", "text", "fmt", "arg_src"]
    final = reduce(DataFrame.unionByName, [d.select("script_id", "call_ord", alt_id().alias("stage"), *cols) for d in done])
    return instances.select("script_id", "call_ord", "alt", F.explode("line").alias("stage")).join(final.hint("merge"), ["script_id", "call_ord", "stage"]) \
        .select("script_id", "call_ord", "alt", *cols)
