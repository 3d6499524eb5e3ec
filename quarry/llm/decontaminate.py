"""Benchmark decontamination with DataFrame functions only.

Item texts are cut into windows of 13 normalised words (an item of fewer words
is one window).  Every document's word windows of the lengths that items have
are hashed and met with the hash set of item windows; texts that meet it are
scanned again and the windows that met are verified word by word.  The set of
hashes is broadcast where its measured size is within ``BROADCAST_BYTES``, else
Spark joins by shuffle; no row with a text or its words goes through that join.
Only hits, the words of windows that met, texts with such windows and one row
per document are shuffled.

Words are runs of ASCII letters (A-Z lower-cased), digits and all characters
beyond ASCII.  Defined cases: null and blank texts have no words, are never hit
and no window; repeated document rows each get their row; repeated items count
once; items without an id make hits and are left out of the items; with an empty benchmark nothing is
contaminated; extra columns are not carried by ``find_hits`` and kept by
``remove_contaminated`` and ``remove_spans``.
"""

from __future__ import annotations

import string
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, documents, free_name, in_buckets, prepared, same_row, table, without_rows
from quarry.llm.native import bind, covered

WINDOW = 13
#: A document is contaminated if hit words are at least one in SHARE of its words.
SHARE = 20
BROADCAST_BYTES = 64 << 20
#: What a broadcast key takes with its place in the hash map.
KEY_BYTES = 24

# The characters that are no part of a word.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP + "+"), "")


def exact(list_of_words: Column) -> Column:
    return F.transform(list_of_words, lambda w: F.translate(w, string.ascii_uppercase, string.ascii_lowercase))


def hashes(list_of_words: Column) -> Column:
    """Hashes of words in lower case: equal words have equal hashes; hits are verified exactly."""
    return F.transform(list_of_words, lambda w: F.xxhash64(F.lower(w)))


def window_key(word_hashes: Column, at: Column, length: int | Column) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.xxhash64(length, F.slice(word_hashes, at + 1, length))


def item_windows(benchmark: DataFrame, text: str = "text", ident: str = "item_id") -> DataFrame:
    """One row per distinct window: key, length, words and the sorted ids of the items that have it (null ids left out)."""
    items = (benchmark.select(F.col(ident).cast("string").alias("item"), exact(words(F.col(text))).alias("ws"))
             .filter("size(ws) > 0")
             .withColumn("length", F.least(F.lit(WINDOW), F.size("ws"))))
    each = items.select("item", "length", F.explode(bind(F.col("ws"), lambda ws: F.transform(
        F.sequence(F.lit(1), F.size("ws") - F.col("length") + 1), lambda i: F.slice(ws, i, F.col("length"))))).alias("window"))
    return (each.groupBy("length", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .withColumn("key", bind(hashes(F.col("window")), lambda h: window_key(h, F.lit(0), F.col("length")))))


def window_keys(h: Column, n: int) -> Column:
    """The key of every window of ``n`` words."""
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: window_key(h, i, n))) \
        .otherwise(F.array().cast("array<bigint>"))


def scan_rows(docs: DataFrame, windows: DataFrame, lengths: list[int], text: str, ident: str) -> DataFrame:
    """Per id and text hash: copies (equal rows), n_words and whether a window's hash is an item window's.

    Key 0 stands for the row itself, so every row leaves one.  Only keys go through the join, not the words.
    """
    known = windows.select("key").union(windows.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"))).distinct()
    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("ws"))
    keyed = rows.select("id", "text_hash", F.size("ws").cast("long").alias("n_words"), F.explode(bind(
        hashes(F.col("ws")), lambda h: F.concat(F.array(F.lit(0).cast("long")), *[window_keys(h, n) for n in lengths]))).alias("key"))
    own = F.col("key") == 0
    return keyed.join(bounded(known, F.lit(KEY_BYTES)), "key").groupBy("id", "text_hash").agg(
        F.count(F.when(own, 1)).cast("int").alias("copies"), F.max("n_words").alias("n_words"), F.max(~own).alias("met"))


def bounded(side: DataFrame, row_bytes: Column) -> DataFrame:
    """``side`` marked for broadcast if its size, measured by ``row_bytes``, allows it."""
    size = side.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def verified_hits(docs: DataFrame, windows: DataFrame, lengths: list[int], text: str, ident: str) -> DataFrame:
    """Per id and text hash with a hit: the hit windows (pos, length) and the items, compared word by word.

    Places meet the windows by key alone; then each text with such places gives
    their words once, and only these meet the windows' words.
    """
    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("ws"))
    probed = rows.select("id", "text_hash", F.explode(bind(hashes(F.col("ws")), lambda h: F.concat(
        F.array().cast(PLACES), *[positions(h, n) for n in lengths]))).alias("p")).select("id", "text_hash", "p.pos", "p.key")
    known = bounded(windows.select("key", "length").distinct(), F.lit(KEY_BYTES))
    places = cut(probed.join(known, "key").groupBy("id", "text_hash").agg(
        F.collect_set(F.struct("pos", "length", "key")).alias("places")), "window-places") \
        .withColumnsRenamed({"id": "p_id", "text_hash": "p_hash"})
    met = in_buckets(docs, places.withColumnRenamed("p_hash", "text_hash"), text) \
        .select(F.col(ident).alias("id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("ws")) \
        .join(places, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")))
    taken = met.select("id", "text_hash", F.explode(bind(F.col("ws"), lambda ws: F.transform("places", lambda p: F.struct(
        p["pos"].alias("pos"), p["length"].alias("length"), p["key"].alias("key"),
        exact(F.slice(ws, p["pos"] + 1, p["length"])).alias("found"))))).alias("p")).select("id", "text_hash", "p.*")

    def letters(column: str) -> Column:
        return F.aggregate(column, F.lit(0).cast("long"), lambda n, w: n + 16 + F.octet_length(w))

    full = bounded(windows, 64 + letters("window") + letters("items")).withColumnsRenamed({"length": "w_length", "key": "w_key"})
    same = (F.col("key") == F.col("w_key")) & (F.col("length") == F.col("w_length")) & (F.col("found") == F.col("window"))
    return taken.join(full, same).groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("pos", "length"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


PLACES = "array<struct<pos:int,key:bigint>>"


def positions(h: Column, n: int) -> Column:
    """(pos, key) of every window of ``n`` words."""
    return F.when(F.size(h) >= n, F.transform(
        F.sequence(F.lit(0), F.size(h) - n),
        lambda i: F.struct(i.alias("pos"), window_key(h, i, n).alias("key")))).otherwise(F.array().cast(PLACES))


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id, text_hash, n_words, hits (array of pos, length), n_hit and sorted items.

    All texts are scanned for keys; those with a key of an item window are scanned again and verified.
    """
    windows = cut(item_windows(benchmark), "item-windows")
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most WINDOW numbers
    scanned = cut(scan_rows(docs, windows, lengths, text, ident), "scanned-texts")
    maybe = in_buckets(docs, scanned.filter("met"), text)
    hits = verified_hits(maybe, windows, lengths, text, ident).withColumnsRenamed({"id": "h_id", "text_hash": "h_hash"})
    joined = scanned.join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    none = F.array().cast("array<struct<pos:int,length:int>>")
    return joined.select(
        "id", "text_hash", "n_words", F.coalesce("hits", none).alias("hits"),
        F.coalesce(covered(F.col("hits")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` without its contaminated documents."""
    found = find_hits(docs, benchmark, text, ident).filter(contaminated(F.col("n_hit"), F.col("n_words")))
    return without_rows(docs, cut(found.select("id", "text_hash").distinct(), "contaminated"), text, ident)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` with the hit words of every text taken out; what is between words stays."""
    found = find_hits(docs, benchmark, text, ident).filter("n_hit > 0").distinct()
    spans = free_name(docs, "hits")
    hits = found.select("id", "text_hash", F.col("hits").alias(spans))
    joined = docs.join(hits, same_row(docs, hits, text, ident), "left")

    def without(pieces: Column) -> Column:
        first = F.when(pieces[0].rlike("^" + WORD), 0).otherwise(1)
        gone = F.flatten(F.transform(spans, lambda x: F.sequence(x["pos"], x["pos"] + x["length"] - 1)))
        numbers = F.transform(F.array_distinct(gone), lambda k: 2 * k + first)
        kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), numbers)
        return F.array_join(F.transform(kept, lambda k: F.get(pieces, k)), "")

    pieces = F.regexp_extract_all(docs[text], F.lit(f"{WORD}+|{GAP}+"), F.lit(0))
    cleaned = F.when(F.col(spans).isNotNull(), bind(pieces, without)).otherwise(docs[text])
    return joined.select(*[cleaned.alias(c) if c == text else docs[c] for c in docs.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(documents(prepared(spark), sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
        FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
o AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.k = dw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
  coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE = {"op7_decontaminate": _ORACLE}
