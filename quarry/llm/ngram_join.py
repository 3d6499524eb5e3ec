"""Exact n-gram Jaccard self-join of texts under several global token orders.

A text's set holds its distinct 5-word shingles as 64-bit hashes (a shorter text
is one shingle).  Texts whose sets are equal are one node.

1. A table of fixed size counts all shingles by a hash of theirs.  It makes the
   first global order: shingles from small counts first, so that passages which
   many texts share come last.
2. A text is posted under the prefix of its set in that order, the part that two
   similar sets must share a token of.  Nodes that meet under a token of at most
   ``SMALL`` nodes are paired and counted: a pair with fewer common prefix tokens
   than its similarity needs is no candidate.  Under a more frequent token every
   node is tied to one pivot instead, so no token lists all its pairs.
3. Components of these ties are candidate groups; a similar pair is always inside
   one.  Groups are dealt out in blocks of about ``BLOCK`` nodes.  In a task, a
   pair must share prefix tokens under each of ``ORDERS`` global orders; those
   in the intersection are verified on their whole sets.
4. A group of several blocks is taken apart first, up to ``TURNS`` times: its texts
   get a count table of their own, and with that order prefixes, ties and components
   inside the group as in 1 to 3.  Similar pairs stay together under any order.
5. What still has several blocks meets its first block before the others; what is
   connected by then is not compared again.  The rest is compared block by block.

Defined cases: a null, empty or blank text has an empty set and is linked with
nothing (its component is its own id); repeated rows and equal ids are rows of
their own, texts with equal sets are linked; a component of null ids only has a
null id; an empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_ROWS, cut, documents, free_name, in_buckets, prepared, same_row, without_rows
from quarry.llm.graph import components

WORDS = 5                 # words of a shingle
SIMILAR = (3, 4)          # least Jaccard similarity as a fraction
ORDERS = 3                # global token orders
SMALL = 64                # nodes of a token that are paired with each other
BLOCK = 128               # nodes of a block, on average
SKETCH_BITS = 21          # the count table has 2**SKETCH_BITS entries
SKETCH_ROW = 12           # a task sends its counts in rows of 2**SKETCH_ROW entries
TURNS = 3                 # count tables by which groups of several blocks are taken apart
WANTED = 300_000          # rows to fetch that are broadcast (id, hash and group: about 100 bytes each)
MEMO = 1 << 16            # word hashes, and nodes already posted, that a task remembers

_ODD = np.array([xxhash.xxh64_intdigest(b"place", i) | 1 for i in range(64)], dtype=np.uint64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer; each seed gives another order of the same tokens."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, words: WordHash, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower() and split() are ASCII, as the words are defined."""
    found = (text or b"").lower().split()
    n = len(found)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(size, n)
    k = n - size + 1
    total = np.full(k, size, np.uint64)
    for j in range(size):
        total = total + h[j:j + k] * _ODD[j]
    return np.unique(mix(total))


def node_of(tokens: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def prefix(tokens: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tokens that come first by ``key``: as many as a similar set cannot all lack (ties included)."""
    n = len(tokens)
    keep = n - (SIMILAR[0] * n + SIMILAR[1] - 1) // SIMILAR[1] + 1
    return tokens[key <= np.partition(key, keep - 1)[keep - 1]] if n else tokens


def spots(tokens: np.ndarray, size: int, turn: int = 0) -> np.ndarray:
    """Places of tokens in a count table whose size is a power of two: their first bits; each turn has others."""
    return ((mix(tokens, -turn) if turn else tokens) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def order_key(tokens: np.ndarray, order: int, counts: np.ndarray | None = None, turn: int = 0) -> np.ndarray:
    """Sort key of the tokens in a global order; the first puts small counts first."""
    if counts is None:
        return mix(tokens, order)
    frequency = counts[spots(tokens, len(counts), turn)].astype(np.uint64)
    return (np.minimum(frequency, np.uint64((1 << 31) - 1)) << np.uint64(32)) | (mix(tokens, order) >> np.uint64(32))


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, compressed."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes(), 1)


def unpacked(data: bytes, many: int) -> np.ndarray:
    plain = zlib.decompress(data)
    return np.frombuffer(plain, f"u{len(plain) // many}").astype(np.int64)


def token_counts(docs: DataFrame, text: str, turn: int = 0) -> np.ndarray:
    """Shingle counts of all texts by hash, an array of fixed size: summed in each task, then row by row of the table."""
    size, row = 1 << SKETCH_BITS, 1 << min(SKETCH_ROW, SKETCH_BITS)

    def table(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([packed(x) for x in sums.values()], pa.binary())],
                                          names=["row", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = WordHash(), np.zeros(size, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                sets = [shingle_set(t, words) for t in batch.column(0).slice(at, SLICE_ROWS).to_pylist()]
                np.add.at(counts, spots(np.concatenate(sets), size, turn), np.uint32(1))
        yield table({i: x for i, x in enumerate(counts.reshape(-1, row)) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[i] = sums.get(i, 0) + unpacked(data, row)
        yield table(sums)

    kind = "row int, counts binary"
    counts = np.zeros((size // row, row), np.uint32)
    for i, data in docs.select(F.col(text).cast("binary")).mapInArrow(count, kind).repartition("row").mapInArrow(add, kind).collect():
        counts[i] = np.minimum(unpacked(data, row), (1 << 32) - 1)
    return counts.reshape(-1)


def arrays(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))


def frequent_from(counts: np.ndarray) -> int:
    """A count above this is far above the mean."""
    return 8 * int(counts.mean()) + 1000


def signatures(docs: DataFrame, counts: np.ndarray, text: str, ident: str) -> DataFrame:
    """Per row its id, text hash, node, set size and, once per node and task, its prefix tokens.

    Tokens whose count is far above the mean come in a column of their own, ``hot``.
    """
    hot_from = frequent_from(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, posted = WordHash(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sets = [shingle_set(t, words) for t in part.column(2).to_pylist()]
                nodes, rare, hot = [node_of(s) for s in sets], [], []
                for node, s in zip(nodes, sets, strict=True):
                    if node in posted:
                        s = s[:0]
                    elif len(posted) >= MEMO:
                        posted.clear()
                    posted.add(node)
                    first = prefix(s, order_key(s, 0, counts))
                    often = counts[spots(first, len(counts))] > hot_from
                    rare.append(first[~often])
                    hot.append(first[often])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(nodes, pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()), arrays(rare), arrays(hot)],
                    names=["id", "text_hash", "node", "n", "rare", "hot"])

    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, text_hash long, node long, n long, rare array<long>, hot array<long>")


def postings(nodes: DataFrame, counts: np.ndarray, turn: int) -> DataFrame:
    """Per row of (node, grp, body) its node, set size and prefix tokens as by ``signatures``; tokens of two groups differ."""
    hot_from = frequent_from(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sizes, rare, hot = [], [], []
                for node, grp, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s = shingle_set(text, words)
                    s = s if node_of(s) == node else s[:0]
                    first = prefix(s, order_key(s, 0, counts, turn))
                    often = counts[spots(first, len(counts), turn)] > hot_from
                    first = mix(first + np.uint64(grp + (1 << 63)))
                    sizes.append(len(s))
                    rare.append(first[~often])
                    hot.append(first[often])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), arrays(rare), arrays(hot)],
                                                 names=["node", "n", "rare", "hot"])

    return nodes.select("node", "grp", "body").mapInArrow(run, "node long, n long, rare array<long>, hot array<long>")


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def candidate_ties(signed: DataFrame) -> DataFrame:
    """Ties (a, b) between nodes: every similar pair of different nodes is connected by them."""
    from pyspark.sql import Window

    num, den = SIMILAR
    token = Window.partitionBy("token")
    # Most tokens are in one node only.  The others leave one row with their members, or one per member if they
    # are frequent; both are grouped where the window has dealt them already.
    frequent = F.col("many") > SMALL
    shared_tokens = cut(
        signed.select("node", F.col("n").cast("int").alias("n"), F.explode("rare").alias("token"))
        .withColumn("low", F.min("node").over(token)).withColumn("high", F.max("node").over(token))
        .withColumn("many", F.count("*").over(token)).filter("low < high")
        .groupBy("token", F.when(frequent, F.col("low")).alias("pivot"), F.when(frequent, F.col("node")).alias("node"))
        .agg(F.sort_array(F.collect_set(F.struct("node", "n"))).alias("members"))
        .select("pivot", "node", F.when(F.col("pivot").isNull(), F.col("members")).alias("members")), "ngram-tokens")
    later = F.transform("members", lambda x, i: F.transform(
        F.slice("members", i + 2, F.size("members")),
        lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("na"), y["n"].alias("nb"))))
    met = shared_tokens.filter("pivot IS NULL").select(F.explode(F.flatten(later)).alias("p")).select("p.*")
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    needed = ceil_div((F.col("na") + F.col("nb")) * num, num + den)
    # ceil(t n) - 1 tokens are behind a prefix, so a similar pair has at least this many common prefix tokens.
    # Pairs that also share a frequent token are tied by its pivot, whatever their count here.
    pairs = (met.filter(low * den >= high * num)
             .groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
             .filter(F.col("common") + ceil_div(high * num, den) - 1 >= needed).select("a", "b"))
    stars = shared_tokens.filter("pivot IS NOT NULL").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    hot = signed.select("node", F.explode("hot").alias("token"))
    pivots = hot.groupBy("token").agg(F.min("node").alias("a"))
    return pairs.union(stars).union(hot.join(pivots, "token").select("a", F.col("node").alias("b"))).filter("a != b")


def shared(parts: list[np.ndarray], left: int, step: int = 4096) -> np.ndarray:
    """Common tokens of each of the first ``left`` sets with every set, as a matrix."""
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, token, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    number = np.cumsum(many > 1) - 1
    keep = many[token] > 1
    owner, token = owner[keep], number[token[keep]]
    by = np.argsort(token, kind="stable")
    owner, token = owner[by], token[by]
    out = np.zeros((left, len(parts)), np.float64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(token, [start, start + step])
        grid = np.zeros((len(parts), step), np.float32)
        grid[owner[a:b], token[a:b] - start] = 1
        out += grid[:left] @ grid.T
    return out


def links(sets: list[np.ndarray], left: int, inside: bool, orders: int = ORDERS) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs between the first ``left`` sets and the others.

    ``inside`` pairs all sets with each other.  A pair is verified if it shares
    a prefix token in every order.
    """
    left = len(sets) if inside else left
    sizes = np.array([len(s) for s in sets], np.float64)
    candidate = np.ones((left, len(sets)), bool)
    candidate[:, :left] = np.tri(left, k=-1, dtype=bool) if inside else False
    for k in range(1, orders + 1):
        candidate &= shared([prefix(s, order_key(s, k)) for s in sets], left) > 0
    if not candidate.any():
        return []
    common = shared(sets, left)
    either = sizes[:left, None] + sizes[None, :] - common
    parent = list(range(len(sets)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in np.argwhere(candidate & (SIMILAR[1] * common >= SIMILAR[0] * either)).tolist():
        p, q = top(x), top(y)
        if p != q:
            parent[p] = q
            out.append((x, y))
    return out


def verified(rows: DataFrame) -> DataFrame:
    """Links (a, b) found in tasks of (grp, task, side, node, text): side 0 with side 1, or all of one side."""
    def run(table: pa.Table) -> pa.Table:
        words, seen = WordHash(), {}
        for n, side, text in zip(*(table.column(c).to_pylist() for c in ("node", "side", "body")), strict=True):
            if n not in seen and node_of(s := shingle_set(text, words)) == n:
                seen[n] = (side, s)
        order = sorted(seen, key=lambda n: (seen[n][0], n))
        left = sum(seen[n][0] == 0 for n in order)
        found = links([seen[n][1] for n in order], left, left in (0, len(order))) if len(order) > 1 else []
        return pa.table({"a": pa.array([order[x] for x, _ in found], pa.int64()),
                         "b": pa.array([order[y] for _, y in found], pa.int64())})

    # dealt by both, else a join by group before it leaves all tasks of a group together
    dealt = rows.select("grp", "task", "side", "node", "body").repartition("grp", "task")
    return dealt.groupBy("grp", "task").applyInArrow(run, "a long, b long")


def in_blocks(groups: DataFrame) -> DataFrame:
    """(node, grp, blocks, block) of (node, root): each group in blocks of about ``BLOCK`` nodes."""
    sizes = groups.groupBy(F.col("root").alias("grp")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return groups.withColumnRenamed("root", "grp").join(sizes, "grp").select(
        "node", "grp", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))


def verify_groups(docs: DataFrame, signed: DataFrame, groups: DataFrame, text: str, ident: str) -> DataFrame:
    """Links between nodes of the same group, enough to connect what is similar.

    ``groups`` has (node, root).  One row of each node is fetched by id and text hash.
    """
    one = (signed.filter("n > 0").select("node", "id", "text_hash").join(in_blocks(groups), "node")
           .groupBy("node", "grp", "blocks", "block")
           .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("row")))
    wanted = cut(one.select("node", "grp", "blocks", "row.id", "row.text_hash", "block"), "ngram-wanted")
    small = wanted.count() <= WANTED

    def fetched(rows: DataFrame) -> DataFrame:
        body = docs if small else in_buckets(docs, rows, text)
        rows = F.broadcast(rows) if small else rows
        return rows.join(body, same_row(body, rows, text, ident)).select(
            "node", "grp", "blocks", "block", F.col(text).cast("binary").alias("body"))

    def inside(rows: DataFrame) -> DataFrame:
        one = rows.filter("blocks = 1").withColumn("task", F.lit(0)).withColumn("side", F.lit(0))
        return cut(verified(one), "ngram-links")

    found = inside(fetched(wanted.filter("blocks = 1")))
    many = wanted.filter("blocks > 1")
    if many.isEmpty():
        return found
    nodes = cut(fetched(many), "ngram-nodes")
    left = nodes.count()
    # Groups are taken apart as long as that leaves less: in an order by the counts of their own texts, what only
    # looked rare among all texts comes last.  A node without a tie is similar to no other.
    for turn in range(1, TURNS + 1):
        again = cut(postings(nodes, token_counts(nodes, "body", turn), turn), "ngram-postings")
        parts = cut(in_blocks(components(candidate_ties(again), "ngram-parts")), "ngram-placed")
        nodes = cut(nodes.select("node", "body").join(parts, "node"), "ngram-nodes")
        found = found.union(inside(nodes))
        nodes, before = nodes.filter("blocks > 1"), left
        left = nodes.count()
        if not left:
            return found
        if 4 * left > 3 * before:
            break
    # The first block with itself and with every other one.
    first = cut(verified(nodes.select(
        "grp", "node", "body", (F.col("block") > 0).cast("int").alias("side"),
        F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1))
                  .otherwise(F.array("block"))).alias("task"))), "ngram-links")
    # What is not connected with its group's main part: with that part and with each other, in blocks.
    placed = nodes.join(components(first, "ngram-first"), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    parts = placed.groupBy("grp", "part").agg(F.count("*").alias("many"))
    main = parts.groupBy("grp").agg(F.max(F.struct("many", "part"))["part"].alias("main"), F.sum("many").alias("all"),
                                    F.max("many").alias("most"))
    split = main.filter(F.col("all") > F.col("most")).select(
        "grp", "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("rest_blocks"))
    dealt = placed.join(split, "grp").withColumn("is_main", F.col("part") == F.col("main"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)),
                                            F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    rest, mains = F.col("rest_blocks"), F.col("main_blocks")
    # Tasks: (i, j) of two rest blocks with i <= j, then (i, j) of rest block i and main block j.
    width = rest + mains
    as_main = F.transform(F.sequence(F.lit(0), rest - 1), lambda i: F.struct((i * width + rest + F.col("mine")).alias("task"), F.lit(1).alias("side")))
    as_left = F.transform(F.sequence(F.col("mine"), width - 1), lambda j: F.struct((F.col("mine") * width + j).alias("task"), F.lit(0).alias("side")))
    as_right = F.filter(F.transform(F.sequence(F.lit(0), F.col("mine")), lambda i: F.struct((i * width + F.col("mine")).alias("task"), F.lit(1).alias("side"))),
                        lambda t: t["task"] != F.col("mine") * width + F.col("mine"))
    rows = dealt.select("grp", "node", "body", F.explode(F.when(F.col("is_main"), as_main).otherwise(F.concat(as_left, as_right))).alias("t"))
    return found.union(first).union(cut(verified(rows.select("grp", "node", "body", "t.task", "t.side")), "ngram-links"))


def link_documents(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: id, text_hash, n (set size), root (of its class, null without a set) and component (smallest id linked)."""
    docs = docs.select(ident, text)
    signed = cut(signatures(docs, token_counts(docs, text), text, ident), "ngram-signatures")
    groups = components(candidate_ties(signed), "ngram-groups")
    roots = components(verify_groups(docs, signed, groups, text, ident), "ngram")
    some, none = signed.filter("n > 0").select("id", "text_hash", "node", "n"), signed.filter("n = 0")
    classes = some.groupBy("node").agg(F.min("id").alias("low")).join(roots, "node", "left") \
        .select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component"))
    named = classes.join(lowest, "root").select("node", "root", "component")
    return some.join(named, "node").select("id", "text_hash", "n", "root", "component").union(
        none.select("id", "text_hash", "n", F.col("node").alias("root"), F.col("id").alias("component")))


def keep_one(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of similar texts: the one with the smallest id.

    Of rows that are equal in id and text one stays; texts without a set all stay.
    """
    linked = cut(link_documents(docs, text, ident), "ngram-linked").filter("root IS NOT NULL")
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    first = linked.groupBy("root").agg(F.min(own).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    judged = cut(linked.join(first, "root").select("id", "text_hash", (own == F.col("first")).alias("__stays")).distinct(), "ngram-judged")
    single = without_rows(docs, judged.select("id", "text_hash"), text, ident)
    kept = judged.filter("__stays")
    maybe = in_buckets(docs, kept, text)
    mark = free_name(docs, "text_hash")
    return single.unionByName(maybe.join(kept, same_row(maybe, kept, text, ident), "left_semi")
                              .withColumn(mark, F.xxhash64(text)).dropDuplicates([ident, mark]).drop(mark))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(prepared(spark), sf_dir)).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


_ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
    GROUP BY ALL) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
r AS (
  SELECT a AS doc_id, b AS other FROM e
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
ORACLE = {"op8_ngram_jaccard": _ORACLE}
