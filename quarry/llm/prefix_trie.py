"""Conversation prefix trie: shared beginnings as nodes, rolled up by centroid decomposition.

Every distinct sequence of a conversation's first turns is a node.  The node
table comes from grouping turns by a prefix key: per-turn digests of (place,
role, text) are 128 bits in four pieces, and a prefix has their running sums, so
a conversation of any length is cut into blocks of places and never gathered.

Sums over subtrees come from a centroid decomposition of the parent-edge forest.
A node's ``mass`` is the number of turns of its members from its depth on; that
is the sum over its subtree of the members of each node, so one group-by gives
it.  In a component of mass W the nodes with at least W / 2 are the path from its
top to its centroid.  Each round, for every component:

* the centroid's total is its own value plus the totals of the components that
  hang below it; it is added to every node on the path;
* the component falls apart into those below the centroid, each topped by one of
  its children, and the rest above, where the path's masses shrink by the centroid's.

Masses halve, so the rounds are logarithmic in the number of turns, however deep
the trie.  Components of more than ``SMALL`` nodes are split by joins, all of
them in one round; smaller ones finish the same recursion inside a task.

Defined cases: a null role or text is an empty one; rows without a conversation
id belong to no conversation; turns with equal numbers are ordered by the digest
of role and text; repeated rows are repeated turns; a conversation with no turns
left is a member of the root; an empty table has no node; columns besides
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import cut, prepared, table

#: Components of at most so many nodes are decomposed inside a task.
SMALL = 4096
#: Places of a conversation that are summed at a time.
BLOCK = 1024
#: Conversation ids whose texts are joined at a time.
ID_BLOCK = 4096
PIECES = ["p0", "p1", "p2", "p3"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, digest, chars): turns numbered from 1 by turn (null first), then by the digest of role and text.

    The rows are sorted over range partitions, so a conversation of any length
    is spread; a turn's number is its place in its partition plus the rows of its
    conversation in the partitions before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    placed = cut(turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .select("conv_id", "digest", "chars", F.spark_partition_id().alias("part"),
                         F.monotonically_increasing_id().alias("at")), "trie-turns")
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # one row per conversation and range partition that it touches
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(runs, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("i"), "digest", "chars")


def rebuilt(turns: DataFrame, base: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, digest, chars) and (conv_id, length): the first ``shared`` turns of conversation ``base``, then the own later ones.

    ``base`` and ``shared`` are computed from conv_id; shared turns are few, so
    what is copied from a base is bounded by them.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = lengths.select("conv_id", base.alias("base"), shared.alias("h"), "own")
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_len"))
    convs = convs.join(of_base, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_len", F.lit(0))).alias("taken"),
        F.greatest(F.lit(0), F.col("own") - F.col("h")).alias("kept"))
    convs = cut(convs.withColumn("length", F.col("taken") + F.col("kept")), "trie-conversations")
    most = convs.agg(F.max("h")).head()[0] or 0
    beginnings = turns.filter(F.col("i") <= most).withColumnRenamed("conv_id", "base")
    taken = convs.filter("taken > 0").select("conv_id", "base", "taken").join(beginnings, "base").filter("i <= taken") \
        .select("conv_id", F.col("i").alias("place"), "digest", "chars")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("i > h") \
        .select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("place"), "digest", "chars")
    return taken.unionByName(own), convs.select("conv_id", "length")


def prefix_key(depth: Column, pieces: list[Column]) -> Column:
    """The 16 bytes that name a prefix."""
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[c.cast("string") for c in pieces])))


def root_key() -> Column:
    return prefix_key(F.lit(0), [F.lit(0)] * len(PIECES))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, length, key, parent, chars): one row per conversation and depth, from depth 0; key names the prefix."""
    mixed = F.md5(F.concat_ws(":", F.col("place").cast("string"), "digest"))
    pieces = [F.conv(F.substring(mixed, 8 * k + 1, 8), 16, 10).cast("long").alias(p) for k, p in enumerate(PIECES)]
    rows = turns.select("conv_id", "place", "chars", F.floor((F.col("place") - 1) / BLOCK).alias("block"), *pieces)
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("conv_id", "place", "chars", "block", *[F.col(p).alias(f"x{p}") for p in PIECES],
                       *[F.sum(p).over(inside).alias(p) for p in PIECES])
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(p).alias(p) for p in PIECES])
    # one row per conversation and block of places
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"b{p}") for p in PIECES])

    full = [F.col(p) + F.col(f"b{p}") for p in PIECES]
    less = [F.col(p) + F.col(f"b{p}") - F.col(f"x{p}") for p in PIECES]
    deep = sums.join(blocks, ["conv_id", "block"]).select(
        "conv_id", F.col("place").alias("depth"), prefix_key(F.col("place"), full).alias("key"),
        prefix_key(F.col("place") - 1, less).alias("parent"), "chars")
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root_key().alias("key"),
                        F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))
    return deep.unionByName(tops).join(convs, "conv_id").select("conv_id", "depth", "length", "key", "parent", "chars")


def node_table(paths: DataFrame) -> DataFrame:
    """(key, parent, conv_id, depth, n_convs, chars, mass, n_children): one row per distinct prefix."""
    nodes = cut(paths.groupBy("key", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("mass")), "trie-prefixes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    return cut(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")


# --------------------------------------------------------------------------- rollup

def split_small(parent: list[int], mass: list[int], values: list[list[int]]) -> list[list[int]]:
    """Sums over subtrees of one component by its centroid decomposition.

    Nodes come in ascending order of depth; ``parent`` has places in this order,
    -1 at the top.  Returns one list per list of ``values``.
    """
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for v in range(1, n):
        kids[parent[v]].append(v)
    sums = [[0] * n for _ in values]
    mass, gone = list(mass), [False] * n
    tops = [0]
    while tops:
        top = tops.pop()
        path, at = [top], top
        while True:  # down the one child that holds half of the component
            at = next((c for c in kids[at] if not gone[c] and 2 * mass[c] >= mass[top]), -1)
            if at < 0:
                break
            path.append(at)
        centroid = path[-1]
        below = [c for c in kids[centroid] if not gone[c]]
        totals, todo = [v[centroid] for v in values], list(below)
        while todo:
            v = todo.pop()
            for k, own in enumerate(values):
                totals[k] += own[v]
            todo += [c for c in kids[v] if not gone[c]]
        for k, total in enumerate(totals):
            for v in path:
                sums[k][v] += total
        gone[centroid] = True
        tops += below
        if centroid != top:
            less = mass[centroid]
            for v in path[:-1]:
                mass[v] -= less
            tops.append(top)
    return sums


def small_rollup(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(key, values): sums over subtrees within each component, which a task holds one at a time."""
    schema = T.StructType([nodes.schema["key"], *[T.StructField(v, T.LongType()) for v in values]])
    names = ["comp", "key", "parent", "mass", *values]

    def done(rows: dict[str, list]) -> pa.RecordBatch:
        where = {k: i for i, k in enumerate(rows["key"])}
        sums = split_small([where.get(p, -1) for p in rows["parent"]], rows["mass"], [rows[v] for v in values])
        return pa.RecordBatch.from_arrays([pa.array(rows["key"], pa.binary()), *(pa.array(s, pa.int64()) for s in sums)],
                                          names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            comp = rows["comp"]
            ends = [i for i in range(1, len(comp)) if comp[i] != comp[i - 1]]
            for a, b in zip([0, *ends], [*ends, len(comp)], strict=True):
                part = {n: rows[n][a:b] for n in names}
                if held and part["comp"] and held["comp"][0] == part["comp"][0]:
                    held = {n: held[n] + part[n] for n in names}
                    continue
                if held:
                    yield done(held)
                held = part if part["comp"] else held
        if held:
            yield done(held)

    dealt = nodes.select(*names, "depth").repartition("comp").sortWithinPartitions("comp", "depth")
    return dealt.select(*names).mapInArrow(run, schema)


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], small: int = SMALL) -> DataFrame:
    """(key, values): for every node the sums of ``values`` over its subtree, itself included.

    ``nodes`` is a table as by ``node_table`` with the columns ``values``;
    ``paths`` (conv_id, depth, key) tells which prefixes each conversation has.  A
    node belongs to a subtree if its ``conv_id`` is a member of the subtree's top.
    """
    state = cut(nodes.select("key", "parent", "conv_id", "depth", "mass", *values, root_key().alias("comp")), "trie-state")
    children = paths.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("key").alias("child"))
    adds: list[DataFrame] = []
    while True:
        sizes = state.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max("mass").alias("whole"))
        large = cut(sizes.filter(F.col("n") > small), "trie-large")
        if large.isEmpty():
            break
        rest = state.join(large.select("comp"), "comp", "left_anti")
        of_large = state.join(large.select("comp", "whole"), "comp")
        path = cut(of_large.filter(2 * F.col("mass") >= F.col("whole")).select("comp", "key", "depth", "mass", *values), "trie-path")
        centroid = path.groupBy("comp").agg(F.max_by(F.struct("key", "depth", "mass"), "depth").alias("c"))
        centroid = cut(centroid.select("comp", F.col("c.key").alias("c_key"), F.col("c.depth").alias("c_depth"),
                                       F.col("c.mass").alias("c_mass")), "trie-centroids")
        # the members of each centroid, with the child that each goes on to
        members = paths.join(centroid.select("comp", F.col("c_key").alias("key")), "key").select("comp", "conv_id", "depth")
        members = members.join(children, ["conv_id", "depth"], "left").select("comp", "conv_id", F.lit(True).alias("member"), "child")
        sided = of_large.drop("whole").join(centroid, "comp").join(members, ["comp", "conv_id"], "left")
        under = F.coalesce("member", F.lit(False)) & (F.col("depth") > F.col("c_depth"))
        sided = cut(sided.withColumn("under", under), "trie-sided")
        totals = sided.filter(F.col("under") | (F.col("key") == F.col("c_key"))) \
            .groupBy("comp").agg(*[F.sum(v).alias(v) for v in values])
        adds.append(path.select("comp", "key").join(totals, "comp").select("key", *values))
        shrunk = path.select("comp", "key", F.lit(True).alias("on_path"))
        left = sided.filter(F.col("key") != F.col("c_key")).join(shrunk, ["comp", "key"], "left").select(
            "key", "parent", "conv_id", "depth",
            (F.col("mass") - F.when(F.col("on_path"), F.col("c_mass")).otherwise(F.lit(0))).alias("mass"),
            *values, F.when(F.col("under"), F.col("child")).otherwise(F.col("comp")).alias("comp"))
        state = cut(rest.select(left.columns).unionByName(left), "trie-state")
    whole = small_rollup(state, values)
    for add in adds:
        whole = whole.unionByName(add)
    return whole.groupBy("key").agg(*[F.sum(v).alias(v) for v in values])


# --------------------------------------------------------------------------- members that end at a node

def end_digests(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the comma-joined ids, ascending, of the conversations that end at a node.

    Ids are joined in blocks before they are shuffled.  A node with one block is
    hashed where it is grouped; one with more is hashed block by block in sorted
    order, as a digest has to be, without gathering its ids.
    """
    ends = paths.filter("depth = length").select("key", "conv_id", F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
    joined = cut(ends.groupBy("key", "block").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")),
                 "trie-ends")
    many = joined.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    one = joined.join(many.filter("n = 1"), "key", "left_semi").select("key", F.sha2("ids", 256).alias("ends_sha256"))
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if sha:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())],
                                             names=schema.names)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=schema.names)

    rest = joined.join(many.filter("n > 1"), "key", "left_semi").repartition("key").sortWithinPartitions("key", "block")
    return one.unionByName(rest.select("key", "ids").mapInArrow(run, schema))


# --------------------------------------------------------------------------- the whole trie

def prefix_trie(conversations: DataFrame, base: Column, shared: Column, small: int = SMALL) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  ``base`` and ``shared`` are
    columns over conv_id: whose first turns a conversation begins with, and how many.
    """
    turns, convs = rebuilt(cut(ordered_turns(conversations), "trie-ordered"), base, shared)
    paths = cut(prefixes(turns, convs), "trie-paths")
    nodes = node_table(paths)
    valued = nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")) \
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    sums = rollup(valued, paths, ["n_leaves", "saved_tokens"], small)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(sums, "key").join(parents, "parent", "left").join(end_digests(paths), "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(prepared(spark), sf_dir, "conversations")
    conv = F.col("conv_id")
    return prefix_trie(conversations, conv - conv % 100, (F.crc32(conv.cast("string").cast("binary")) % 6).cast("long"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}

ORACLE = {"op11_prefix_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
-- unsigned crc32 by its bit rule, byte by byte, as there is no such function
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(conv_id::VARCHAR)), lambda k: ord(substr(conv_id::VARCHAR, k::INT + 1, 1))::BIGINT)),
           lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)::BIGINT[]),
             lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
seq AS (
  SELECT c.conv_id,
         list_concat(coalesce((SELECT list({'role': role, 'text': text} ORDER BY i) FROM t WHERE t.conv_id = c.base AND t.i <= c.h), []),
                     coalesce((SELECT list({'role': role, 'text': text} ORDER BY i) FROM t WHERE t.conv_id = c.conv_id AND t.i > c.h), [])) AS turns
  FROM c),
r AS (SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) AS size FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM seq)),
n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM r GROUP BY prefix, depth),
k AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix, depth)),
s AS (
  SELECT a.conv_id, a.depth, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
         sum(CASE WHEN b.depth = 0 THEN 0 ELSE (b.n_convs - 1) * length(b.prefix[b.depth].text) END)::BIGINT AS saved_tokens
  FROM m a JOIN r ON r.prefix = a.prefix AND r.depth = a.depth
           JOIN m b ON b.conv_id = r.conv_id AND b.depth >= a.depth
  GROUP BY a.conv_id, a.depth)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s ON s.conv_id = m.conv_id AND s.depth = m.depth
LEFT JOIN m p ON p.depth = m.depth - 1 AND p.prefix = m.prefix[1:m.depth - 1]
"""}
