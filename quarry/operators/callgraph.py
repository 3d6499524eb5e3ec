"""Which functions may run, and which a call may enter.

Two relations grow together, each from the other: *scope runs* and *place is
called*.  A place is what a value is read from: a variable ``n:home:name``, an
attribute of any object ``a:name``, an attribute of ``self`` in a class without
bases ``s:class:name``, a class that is called ``c:class``, or ``*`` for names
looked up at run time.  Their edges are facts of the scripts:

* a scope that runs calls the places it calls, and those it reads in any other
  way (a function in a list, returned, passed on, stored or decorated may be
  called by whoever gets it);
* a called place runs the functions it is defined by, and calls the places it is
  an alias of (``a = b``, ``self.a = b``); a called class runs its ``__init__``
  and every other special method;
* a definition or alias counts once the scope that makes it runs.

Calls and definitions of one name meet at its place and never one by one, so a
script with many of both has as many edges as facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.codefacts import MODULE
from quarry.session import materialize

#: Rounds whose finds are kept as tables of their own before they are written as one.
FEW_TABLES = 8


def facts_of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.filter(F.col("fact").isin(*kinds))


def scope_node(scope: Column | str) -> Column:
    return F.concat(F.lit("f:"), F.col(scope) if isinstance(scope, str) else scope)


def variable(home: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("n:"), F.col(home) if isinstance(home, str) else home, F.lit(":"),
                    F.col(name) if isinstance(name, str) else name)


def attribute(name: Column | str) -> Column:
    return F.concat(F.lit("a:"), F.col(name) if isinstance(name, str) else name)


def own_attribute(cls: str, name: Column | str) -> Column:
    return F.concat(F.lit("s:"), F.col(cls), F.lit(":"), F.col(name) if isinstance(name, str) else name)


def with_heirs(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with ``inherits``: whether the class of their scope has bases."""
    heirs = facts_of(facts, "def").filter("kind = 'class' AND detail = 'bases'") \
        .select("script_id", F.col("qual").alias("cls"), F.lit(True).alias("inherits")).distinct()
    return rows.join(heirs.hint("merge"), ["script_id", "cls"], "left").withColumn("inherits", F.coalesce("inherits", F.lit(False)))


def call_places(facts: DataFrame) -> DataFrame:
    """(script_id, call_ord, scope, place): the place each call calls; one call, one place."""
    calls = with_heirs(facts_of(facts, "call"), facts)
    own = (F.col("receiver") == "self") & F.col("cls").isNotNull() & ~F.col("inherits")
    place = F.when(F.col("call_form") == "name", variable("home", "name")) \
        .when(own, own_attribute("cls", "name")).otherwise(attribute("name"))
    return calls.select("script_id", "call_ord", "scope", place.alias("place"))


def place_edges(facts: DataFrame) -> DataFrame:
    """(script_id, src, dst, guard): what a called place is defined by (a scope ``f:``, a class ``c:``) or is an alias of."""
    defs = facts_of(facts, "def").filter("kind IN ('function', 'class')")
    in_class = F.col("cls").isNotNull() & (F.col("scope") == F.col("cls"))
    entity = F.when(F.col("kind") == "class", F.concat(F.lit("c:"), "qual")).otherwise(scope_node("qual"))
    # a class body's names are its attributes too
    named = defs.select("script_id", F.explode(F.filter(F.array(
        variable("scope", "name"), F.when(in_class, attribute("name")), F.when(in_class, own_attribute("cls", "name")), F.lit("*")),
        lambda p: p.isNotNull())).alias("src"), entity.alias("dst"), scope_node("scope").alias("guard"))
    special = defs.filter(in_class & (F.col("kind") == "function") & F.col("name").rlike("^__.*__$")).select(
        "script_id", F.concat(F.lit("c:"), "cls").alias("src"), scope_node("qual").alias("dst"), scope_node("cls").alias("guard"))
    binds = facts_of(facts, "bind").filter("kind IN ('ref', 'attr') AND fmt = 'plain' AND slot IS NULL")
    binds = with_heirs(binds, facts)
    stored = F.col("name").startswith("self.")
    attr = F.expr("substring(name, 6)")
    of_attr = F.expr("substring(value, 6)")
    held = F.when(F.col("kind") == "ref", variable("home", "value")) \
        .when(F.col("cls").isNotNull() & ~F.col("inherits"), own_attribute("cls", of_attr)).otherwise(attribute(of_attr))
    aliases = binds.select("script_id", F.explode(F.when(stored, F.array(attribute(attr), own_attribute("cls", attr)))
                                                  .otherwise(F.array(variable("scope", "name")))).alias("src"),
                           held.alias("dst"), scope_node(F.coalesce("qual", "scope")).alias("guard"))
    # what a run-time lookup or an attribute read of a constant name finds
    return named.unionByName(special).unionByName(aliases).distinct()


def calling_edges(facts: DataFrame) -> DataFrame:
    """(script_id, scope, place): the places that a scope calls or reads, and the bodies of its classes, once each."""
    calls = call_places(facts).select("script_id", "scope", "place")
    uses = facts_of(facts, "use")
    reads = uses.select("script_id", "scope", F.explode(
        F.when(F.col("kind") == "name", F.array(variable("home", "value")))
        .when(F.col("kind") == "attr", F.array(attribute("value")))
        .when(F.col("kind") == "text", F.array(attribute("value"), variable(F.lit(MODULE), "value")))
        .otherwise(F.array(F.lit("*")))).alias("place"))
    bodies = facts_of(facts, "def").filter("kind = 'class'").select("script_id", "scope", scope_node("qual").alias("place"))
    return calls.unionByName(reads).unionByName(bodies).distinct()


def reachable_scopes(facts: DataFrame) -> DataFrame:
    """(script_id, scope, depth): scopes that may run, from module level on.

    Semi-naive: a place's edge fires in the round after the later one of its two
    ends, the place and the scope that guards it, was found; a node is found
    once.  A round goes from scopes to the places they call and on to what these
    stand for.  ``depth`` is the fewest functions entered on the ways of the round
    in which a scope was found.  A script that does not parse runs nothing.
    """
    calling = materialize(calling_edges(facts), "calling-edges").select("script_id", scope_node("scope").alias("node"), "place")
    standing = materialize(place_edges(facts), "place-edges")
    inner = standing.filter(F.col("guard") != f"f:{MODULE}")
    found = facts.filter(F.col("fact") != "error").select("script_id").distinct() \
        .select("script_id", F.lit(f"f:{MODULE}").alias("node"), F.lit(0).alias("depth"))
    new = found = materialize(found, "found")
    nodes = ["script_id", "node"]
    rounds = 0
    while True:
        called = new.join(calling.hint("merge"), nodes).groupBy("script_id", F.col("place").alias("node")).agg(F.min("depth").alias("depth")) \
            .join(found.select(*nodes).hint("merge"), nodes, "left_anti")
        places = called.unionByName(new.filter(~F.col("node").startswith("f:")))
        guards = found.select("script_id", F.col("node").alias("guard"))
        by_place = standing.join(places.select("script_id", F.col("node").alias("src"), "depth").hint("merge"), ["script_id", "src"]) \
            .join(guards.hint("merge"), ["script_id", "guard"], "left_semi")
        by_guard = inner.join(new.select("script_id", F.col("node").alias("guard")).hint("merge"), ["script_id", "guard"], "left_semi") \
            .join(found.select("script_id", F.col("node").alias("src"), "depth").hint("merge"), ["script_id", "src"])
        step = ["script_id", F.col("dst").alias("node"), (F.col("depth") + F.col("dst").startswith("f:").cast("int")).alias("depth")]
        fired = by_place.select(*step).unionByName(by_guard.select(*step)).unionByName(called).groupBy(*nodes).agg(F.min("depth").alias("depth"))
        new = materialize(fired.join(found.select(*nodes).hint("merge"), nodes, "left_anti"), "found")
        if new.isEmpty():
            return found.filter(F.col("node").startswith("f:")).select("script_id", F.expr("substring(node, 3)").alias("scope"), "depth")
        rounds += 1
        found = found.unionByName(new) if rounds % FEW_TABLES else materialize(found.unionByName(new), "found")
