"""Ranked lexical search over K2-treaps of the term-document grid.

The index is a table of blocks of documents.  A block is a grid of its terms
(rows) and its documents (columns, ascending ids) whose cells hold impacts, the
integer part of a score that a term's weight multiplies.  The grid is a quadtree
in level order: four bits a node tell which quadrants have cells, and every node
keeps the largest impact below it, stored as the difference to its parent's.

A search walks the row paths of an item's terms down the quadtree together.  One
range of documents is bounded by the sum over terms of weight times the largest
impact of the node where the term's path meets the range.  Ranges are taken best
first, some at a time, until no bound reaches the score of the item's last kept
document; at a single document the bound is its score.  The kept documents go
along from block to block within a task, and the tasks' lists are merged by SQL.

Everything is exact: all documents and whole texts are indexed, and a range is
left out only if its bound is below a score that is kept.

Defined cases: null and empty texts have no terms, are in no block and are never
found; equal scores are ordered by id, null ids last; repeated documents are
ranked each; a repeated item is ranked each time; items without terms or matches
have no row; empty tables give an empty result; columns besides id and text are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import cut, documents, prepared, table

#: A block ends with the document that reaches one of these: documents, term occurrences.
BLOCK_DOCS = 2048
BLOCK_TERMS = 1 << 21
#: Ranges of documents that are taken from the queue at a time.
BEST = 256
#: Items that are searched for in one pass over the index, and the characters that they may have together.
ITEMS = 1024
ITEM_CHARS = 4 << 20

#: ASCII bytes outside words become spaces, A-Z lower case; bytes of other characters stay.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


# --------------------------------------------------------------------------- the quadtree of a block

def interleaved(rows: np.ndarray, cols: np.ndarray, height: int) -> np.ndarray:
    """Places in the order of the quadtree's leaves: a row bit, then a column bit, from the highest on."""
    out = np.zeros(len(rows), dtype=np.int64)
    for i in range(height):
        out |= (((rows >> i) & 1) << (2 * i + 1)) | (((cols >> i) & 1) << (2 * i))
    return out


class Treap:
    """Level-order quadtree: child bits of inner nodes with ranks, and the largest value below each node."""

    def __init__(self, bits: np.ndarray, most: np.ndarray, height: int):
        self.words = bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])
        self.most, self.height = most, height

    @staticmethod
    def packed(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, height: int) -> dict:
        """The stored form of the cells (each once): child bits, level sizes, differences of maxima."""
        at = interleaved(rows, cols, height)
        order = np.argsort(at)
        at, most = at[order], values[order].astype(np.int64)
        bits, sizes, less = [], [], []
        for _ in range(height):
            first = np.flatnonzero(np.concatenate([[True], (at[1:] >> 2) != (at[:-1] >> 2)]))
            above = np.maximum.reduceat(most, first)
            parent = np.zeros(len(at), dtype=np.int64)
            parent[first[1:]] = 1
            parent = np.cumsum(parent)
            own = np.zeros(4 * len(first), dtype=np.uint8)
            own[4 * parent + (at & 3)] = 1
            bits.append(own)
            sizes.append(len(at))
            less.append(above[parent] - most)
            at, most = at[first] >> 2, above
        every = np.concatenate(bits[::-1])
        every = np.concatenate([every, np.zeros(-len(every) % 64, dtype=np.uint8)])
        diffs = np.concatenate([most, *less[::-1]]).astype("<u4").tobytes()
        return {"height": height, "sizes": sizes[::-1], "n_most": len(diffs),
                "bits": np.packbits(every, bitorder="little").tobytes(), "most": pa.compress(diffs, "zstd", asbytes=True)}

    @classmethod
    def unpacked(cls, stored: dict) -> Treap:
        packed = np.frombuffer(stored["bits"], np.uint8)
        parents = np.flatnonzero(np.unpackbits(packed, bitorder="little")) >> 2
        most = np.frombuffer(pa.decompress(stored["most"], stored["n_most"], "zstd", asbytes=True), "<u4").astype(np.int64)
        at = 1
        for size in stored["sizes"]:
            most[at:at + size] = most[parents[at - 1:at - 1 + size]] - most[at:at + size]
            at += size
        return cls(packed.view("<u8"), most, stored["height"])

    def children(self, nodes: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The nodes in a quadrant of each node; -1 where it is empty or the node is -1."""
        place = 4 * nodes + quadrant
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        bits = self.words[word]
        found = ((bits >> shift) & np.uint64(1)).astype(bool) & (nodes >= 0)
        rank = self.before[word] + np.bitwise_count(bits & ((np.uint64(1) << shift) - np.uint64(1)))
        return np.where(found, rank + 1, -1)

    def search(self, rows: np.ndarray, weights: np.ndarray, n_cols: int, keep: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of what may be among the ``keep`` best: scores above 0, none below ``floor``.

        ``rows`` are the paths to descend; a column's score is the sum of weight
        times value over them.
        """
        height = self.height
        level, start = np.zeros(1, np.int64), np.zeros(1, np.int64)
        nodes = np.zeros((1, len(rows)), np.int64)
        bound = np.array([int(self.most[0]) * int(weights.sum())])
        cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            best = np.lexsort((start, -bound))
            now, later = best[:BEST], best[BEST:]
            lev = level[now][:, None]
            row_bit = (rows[None, :] >> (height - 1 - lev)) & 1
            halves, firsts = [], []
            for side in (0, 1):
                halves.append(self.children(nodes[now], 2 * row_bit + side))
                firsts.append(start[now] + (side << (height - 1 - level[now])))
            new_nodes, new_start = np.concatenate(halves), np.concatenate(firsts)
            new_level = np.concatenate([level[now], level[now]]) + 1
            new_bound = (np.where(new_nodes >= 0, self.most[new_nodes], 0) * weights).sum(axis=1)
            live = (new_bound > 0) & (new_bound >= floor) & (new_start < n_cols)
            leaf = live & (new_level == height)
            if leaf.any():
                cols, scores = np.concatenate([cols, new_start[leaf]]), np.concatenate([scores, new_bound[leaf]])
                if len(scores) >= keep:
                    floor = max(floor, int(np.partition(scores, len(scores) - keep)[len(scores) - keep]))
                    cols, scores = cols[scores >= floor], scores[scores >= floor]
            live &= ~leaf
            bound = np.concatenate([bound[later], new_bound[live]])
            level, start = np.concatenate([level[later], new_level[live]]), np.concatenate([start[later], new_start[live]])
            nodes = np.concatenate([nodes[later], new_nodes[live]])
            good = bound >= floor
            bound, level, start, nodes = bound[good], level[good], start[good], nodes[good]
        return cols, scores


# --------------------------------------------------------------------------- the index

def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with at least one term, all their terms)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(terms_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, counts))], pa.int64()), pa.array([sum(counts)], pa.int64())],
                                             names=["docs", "terms"])

    counted = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "docs long, terms long")
    row = counted.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).head()
    return row["docs"] or 0, row["terms"] or 0


def build_index(docs: DataFrame, n_docs: int, n_terms: int, text: str = "text", ident: str = "doc_id",
                block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A table of blocks; every document with a term is in one.  Nothing is shuffled, blocks follow the input splits."""
    kind = docs.schema[ident].dataType
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(kind)), T.StructField("terms", T.BinaryType()), T.StructField("df", T.BinaryType()),
        T.StructField("height", T.IntegerType()), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("n_most", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("most", T.BinaryType())])

    def block(held: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        held.sort(key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0))
        places: dict[bytes, int] = {}
        rows, cols, freq = [], [], []
        for col, (_, counts, _) in enumerate(held):
            rows += [places.setdefault(t, len(places)) for t in counts]
            freq += counts.values()
            cols.append(len(counts))
        row = np.array(rows, np.int64)
        col = np.repeat(np.arange(len(held)), cols)
        tf = np.array(freq, np.int64)
        norm = np.array([75 + 25 * n * n_docs // n_terms for _, _, n in held], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * norm[col])
        stored = Treap.packed(row, col, impact, max(1, (max(len(places), len(held)) - 1).bit_length()))
        values = {"ids": [d[0] for d in held], "terms": b"\n".join(places), "df": np.bincount(row).astype("<u4").tobytes(), **stored}
        return pa.RecordBatch.from_arrays([pa.array([values[f.name]], to_arrow_type(f.dataType)) for f in schema.fields], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(value.as_py())
                if not words:
                    continue
                held.append((key, Counter(words), len(words)))
                size += len(words)
                if len(held) >= block_docs or size >= BLOCK_TERMS:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return cut(docs.select(F.col(ident).alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema), "treap-index")


def document_frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """term -> documents that hold it, for the wanted terms; reads the blocks' term lists only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for terms, df in zip(batch.column(0), batch.column(1)):
                for t, n in zip(terms.as_py().split(b"\n"), np.frombuffer(df.as_py(), "<u4").tolist(), strict=True):
                    if t in wanted:
                        found[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                                         names=["term", "df"])

    counted = index.select("terms", "df").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in counted.toLocalIterator()}


def item_blocks(items: DataFrame, text: str, ident: str) -> Iterator[list[tuple]]:
    """The items (id, terms with counts) in blocks of bounded size; one block is on the driver at a time."""
    held, size = [], 0
    for row in items.select(F.col(ident).alias("id"), F.col(text).cast("binary").alias("t")).toLocalIterator():
        held.append((row["id"], Counter(terms_of(bytes(row["t"]) if row["t"] is not None else None))))
        size += len(row["t"] or b"")
        if len(held) >= ITEMS or size >= ITEM_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def search_block(index: DataFrame, queries: list[list[tuple[bytes, int]]], keep: int) -> DataFrame:
    """(item, id, score): each task's ``keep`` best documents per item, given as (term, weight) lists."""
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    wanted = {t for q in queries for t, _ in q}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                stored = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                place = {t: r for r, t in enumerate(stored["terms"].split(b"\n")) if t in wanted}
                ids, treap = stored["ids"], Treap.unpacked(stored)
                for q, query in enumerate(queries):
                    paths = [(place[t], w) for t, w in query if t in place]
                    if not paths:
                        continue
                    floor = best[q][-1][0] if len(best[q]) == keep else 1
                    rows, weights = np.array(paths, np.int64).T
                    cols, scores = treap.search(rows, weights, len(ids), keep, floor)
                    if len(cols):
                        found = best[q] + [(s, ids[c]) for c, s in zip(cols.tolist(), scores.tolist(), strict=True)]
                        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                        best[q] = found[:keep]
        flat = [(q, d, s) for q, found in enumerate(best) for s, d in found]
        columns = list(zip(*flat, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)],
                                         names=schema.names)

    return index.select("terms", "ids", "height", "sizes", "n_most", "bits", "most").mapInArrow(run, schema)


def ranked(docs: DataFrame, items: DataFrame, keep: int = 20, text: str = "text", ident: str = "doc_id",
           item_text: str = "text", item_ident: str = "item_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item, rank, id, score): each item's ``keep`` best documents with a score above 0, equal scores by ascending id."""
    n_docs, n_terms = totals(docs, text)
    schema = T.StructType([T.StructField("item", items.schema[item_ident].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("id", docs.schema[ident].dataType), T.StructField("score", T.LongType())])
    out = docs.sparkSession.createDataFrame([], schema)
    if not n_docs:
        return out
    index = build_index(docs, n_docs, n_terms, text, ident, block_docs)
    for block in item_blocks(items, item_text, item_ident):
        df = document_frequencies(index, {t for _, counts in block for t in counts})
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        queries = [[(t, n * weight[t]) for t, n in counts.items() if weight.get(t, 0) > 0] for _, counts in block]
        found = search_block(index, queries, keep)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
        names = docs.sparkSession.createDataFrame(
            [(i, item) for i, (item, _) in enumerate(block)],
            T.StructType([T.StructField("n", T.IntegerType()), schema["item"]]))
        out = out.unionByName(cut(top.withColumnRenamed("item", "n").join(F.broadcast(names), "n").select(schema.names), "ranked"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(documents(prepared(spark), sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES = {"op13_lexical_search": op13_lexical_search}

ORACLE = {"op13_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
t AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
p AS (SELECT k, w, count(*)::BIGINT AS tf FROM (SELECT k, unnest(ws) AS w FROM d) GROUP BY k, w),
f AS (SELECT w, count(*)::BIGINT AS df FROM p GROUP BY w),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
iw AS (SELECT q, item_id, unnest(ws) AS w FROM i),
s AS (
  SELECT iw.q, iw.item_id, d.k, d.doc_id,
         sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * f.df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * len(d.ws)::BIGINT * n_docs) // n_terms))))::BIGINT AS score
  FROM iw JOIN p USING (w) JOIN f USING (w) JOIN d ON d.k = p.k CROSS JOIN t
  GROUP BY iw.q, iw.item_id, d.k, d.doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""}
