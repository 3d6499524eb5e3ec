"""Token-id files with keyed access: raw id payloads and a minimal perfect hash index.

``write_ids`` sorts documents by id over range partitions, encodes each whole
text in the task that owns its range and writes shards, in ascending order of
ids.  A shard file is::

    magic | payload: the ids, 2 or 4 bytes each | end of each row | hash bits, fingerprints, first rows | head | size of head

Its index is a minimal perfect hash of the document keys (levels of bit arrays:
a key takes the first level where it alone has its place, its slot is the number
of set bits before).  A slot holds the key's fingerprint, its first row and its
number of rows, and the row table the offsets of the payload, so one key costs a
few reads, whatever the shard's size.  ``ShardReader.find`` does that;
``read_ids`` does it for whole tables in tasks.

Shards are written under names of their own by each attempt of a task; the
catalogue (key, copy, shard), which Spark commits, names the one that counts, so
a lost executor leaves an unnamed file behind at worst.  Files are opened through
Arrow's file systems (local and shared folders, HDFS, object stores), in the
folder the caller names.

Defined cases: a null text is an empty one (the end id alone); a null id is a key
of its own and comes first; rows with the same id are copies of one key, ordered
by the hash of their text; an empty table gives an empty catalogue and no shard;
columns besides id and text are ignored.  Texts are encoded whole; a text that is
longer than a shard's usual size has a shard of its own.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import documents, prepared, ranks_bytes
from quarry.session import scratch_path

MAGIC = b"QRYIDS01"
#: A shard ends with the row that reaches one of these: bytes of payload, rows.
SHARD_BYTES = 32 << 20
SHARD_ROWS = 1 << 16
#: Pieces in a task's memory; when it is full it becomes the older half, which is asked before encoding anew.
MEMO = 1 << 17
#: The same for lower-case pre-tokens, whose encoding is what costs.
WORD_MEMO = 1 << 17
#: Pieces from this length on are not remembered.
LONG = 64

# --------------------------------------------------------------------------- encoding

# The normalizer and pre-tokenizer under which texts may be cut at ASCII spaces and newlines,
# as both drop white space and none of their rules looks across it.
CUT_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
CUT_PRETOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": CUT_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Pieces of letters of the first two Unicode blocks, digits and ASCII signs without quotes and bars: their pre-tokens are
#: runs of letters, single digits and runs of signs, lower-cased letter by letter.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\\[-`{}~]+").fullmatch
PRE_TOKENS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible bytes of Latin-1 stand for themselves, the others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + n) for n, b in enumerate(hidden)}


class Pieces(dict):
    """piece of a text -> its packed ids, filled on demand."""

    def __init__(self, tokenizer, dtype: str):
        self.tokenizer, self.dtype = tokenizer, dtype
        self.model = tokenizer.model
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.older_words: dict[str, bytes] = {}
        self.packers = [struct.Struct(f"<{n}{'H' if dtype == '<u2' else 'I'}").pack for n in range(33)]

    def pack(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else np.array(ids, dtype=self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """Ids of one lower-case pre-token."""
        packed = self.words.get(word)
        if packed is None:
            packed = self.older_words.get(word)
            if packed is None:
                shown = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
                packed = self.pack([t.id for t in self.model.tokenize(shown)])
            if len(self.words) >= WORD_MEMO:
                self.words, self.older_words = {"": b""}, self.words
            self.words[word] = packed
        return packed

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            if len(piece) >= LONG:
                return self.whole(piece)
            packed = b"".join(map(self.word, PRE_TOKENS(piece.lower()))) if PLAIN(piece) else self.whole(piece) if piece else b""
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


@lru_cache(maxsize=1)
def encoder(spec: str, dtype: str) -> Callable[[str], bytes]:
    """Text -> packed ids as the tokenizers library gives them without special tokens.

    ``spec`` is the tokenizer's JSON.  Where its rules let texts be cut at
    spaces each distinct piece is encoded once; otherwise texts are encoded whole.
    A worker process keeps its encoder, with the pieces it knows, for its next task.
    """
    from tokenizers import Tokenizer

    tokenizer, conf = Tokenizer.from_str(spec), json.loads(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    pieces = Pieces(tokenizer, dtype)
    cuts = (conf["normalizer"] == CUT_NORMALIZER and conf["pre_tokenizer"] == CUT_PRETOKENIZER and conf["model"]["type"] == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"]
                        for t in conf["added_tokens"]))
    if not cuts:
        return pieces.whole
    return lambda text: b"".join(map(pieces.__getitem__, text.replace("\n", " ").split(" ")))


def id_type(spec: str, end_id: int | None) -> str:
    """Two bytes an id where all ids of the vocabulary fit, else four."""
    conf = json.loads(spec)
    top = max([*conf["model"]["vocab"].values(), *(t["id"] for t in conf["added_tokens"]), end_id or 0])
    return "<u2" if top < 1 << 16 else "<u4"


# --------------------------------------------------------------------------- minimal perfect hash

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def key_bytes(key) -> bytes:
    return b"\0" if key is None else b"\1" + str(key).encode()


def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where 64-bit hashes fall in a level of ``size`` bits."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(31))) + np.uint64(level + 1) * _MIX1
        x = (x ^ (x >> np.uint64(29))) * _MIX2
    return (x ^ (x >> np.uint64(32))) % np.uint64(size)


class PerfectIndex:
    """Minimal perfect hash of distinct keys: n keys have the slots 0 to n-1, other keys any slot or -1."""

    def __init__(self, words: np.ndarray, sizes: list[int], seed: int):
        self.words, self.sizes, self.seed = words, sizes, seed
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectIndex:
        seed = 0
        while True:
            hashes = np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], dtype=np.uint64)
            if len(np.unique(hashes)) == len(keys):
                break
            seed += 1
        levels, sizes = [], []
        while len(hashes):
            size = -(-2 * len(hashes) // 64) * 64
            at = place(hashes, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            hashes = hashes[~alone[at]]
        return cls(np.concatenate(levels) if levels else np.zeros(0, "<u8"), sizes, seed)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        hashes = np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = self.starts[level] + place(hashes[left], level, size).astype(np.int64)
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.words[word] >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << shift) - np.uint64(1)))
            out[left[hit]] = (self.before[word] + below)[hit]
            left = left[~hit]
        return out


def fingerprint(key: bytes) -> int:
    return xxhash.xxh32_intdigest(key, 0x51)


# --------------------------------------------------------------------------- shard files

def file_system(path: str):
    """(Arrow file system, path in it) of a folder or file name as Spark has it."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard: rows of ids in key order, then the index."""

    def __init__(self, path: str, dtype: str, base: int):
        self.path, self.dtype, self.base = path, dtype, base
        system, name = file_system(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(name)
        self.out.write(MAGIC)
        self.ends: list[int] = []
        self.keys: list[bytes] = []
        self.first: list[int] = []
        self.n = 0

    def add(self, key: bytes, packed: bytes) -> int:
        """Appends a row; returns how many rows of this shard have its key already."""
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
            self.first.append(len(self.ends))
        self.out.write(packed)
        self.n += len(packed) // np.dtype(self.dtype).itemsize
        self.ends.append(self.n)
        return len(self.ends) - 1 - self.first[-1]

    def full(self, rows: int) -> bool:
        return len(self.ends) >= rows or self.n * np.dtype(self.dtype).itemsize >= SHARD_BYTES

    def close(self) -> None:
        index = PerfectIndex.build(self.keys)
        slots = index.slots(self.keys)
        prints, first = np.empty(len(slots), "<u4"), np.empty((len(slots), 2), "<u4")
        prints[slots] = [fingerprint(k) for k in self.keys]
        first[slots, 0] = self.first
        first[slots, 1] = np.diff([*self.first, len(self.ends)])
        parts = [np.array(self.ends, "<u8"), index.words.astype("<u8"), prints, first]
        for part in parts:
            self.out.write(part.tobytes())
        head = json.dumps({"ids": self.n, "rows": len(self.ends), "keys": len(self.keys), "dtype": self.dtype, "base": self.base,
                           "sizes": index.sizes, "seed": index.seed, "words": len(index.words)}).encode()
        self.out.write(head + struct.pack("<Q", len(head)))
        self.out.close()


class ShardReader:
    """Keyed access to one shard file; holds its index, reads payloads as they are asked for."""

    def __init__(self, path: str):
        system, name = file_system(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        long, = struct.unpack("<Q", self.file.read_at(8, size - 8))
        head = json.loads(self.file.read_at(long, size - 8 - long))
        self.dtype, self.base, rows, keys = np.dtype(head["dtype"]), head["base"], head["rows"], head["keys"]
        at = len(MAGIC) + head["ids"] * self.dtype.itemsize
        index = self.file.read_at(size - 8 - long - at, at)
        if self.file.read_at(len(MAGIC), 0) != MAGIC or len(index) != 8 * (rows + head["words"]) + 12 * keys:
            raise ValueError(f"{path} is no whole shard")
        self.ends = np.frombuffer(index, "<u8", rows).astype(np.int64)
        self.hash = PerfectIndex(np.frombuffer(index, "<u8", head["words"], 8 * rows), head["sizes"], head["seed"])
        at = 8 * (rows + head["words"])
        self.prints = np.frombuffer(index, "<u4", keys, at)
        self.first = np.frombuffer(index, "<u4", 2 * keys, at + 4 * keys).reshape(-1, 2)

    def rows(self, keys: list[bytes]) -> list[tuple[int, int]]:
        """(first row, number of rows) of each key; (-1, 0) where the fingerprint says that it is not here."""
        slots = self.hash.slots(keys)
        return [tuple(self.first[s].tolist()) if s >= 0 and self.prints[s] == fingerprint(k) else (-1, 0)
                for s, k in zip(slots.tolist(), keys, strict=True)]

    def row(self, number: int) -> tuple[int, np.ndarray]:
        """(ids of the shard before the row, the row's ids)."""
        start = int(self.ends[number - 1]) if number else 0
        wide = self.dtype.itemsize
        data = self.file.read_at((int(self.ends[number]) - start) * wide, len(MAGIC) + start * wide)
        return start, np.frombuffer(data, self.dtype)

    def find(self, key) -> list[np.ndarray]:
        """The ids of every row with this document id."""
        first, copies = self.rows([key_bytes(key)])[0]
        return [self.row(first + i)[1] for i in range(copies)]


# --------------------------------------------------------------------------- operators

def write_ids(docs: DataFrame, spec: str, path: str, end_id: int | None = None, text: str = "text",
              ident: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes the ids of every text to shards under ``path``; returns the catalogue (part, id, copy, n_ids, shard).

    ``spec`` is the tokenizer's JSON; ``end_id`` ends every document.  ``part``
    numbers the range partitions in ascending order of ids, ``copy`` counts a
    shard's rows with the same id.
    """
    spark, dtype = docs.sparkSession, id_type(spec, end_id)
    ended = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    wide, folder = np.dtype(dtype).itemsize, path.rstrip("/")
    kind = docs.schema[ident].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("id", kind), T.StructField("copy", T.IntegerType()),
                           T.StructField("n_ids", T.LongType()), T.StructField("shard", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, base = encoder(spec, dtype), None, 0
        for batch in batches:
            parts, keys = batch.column(0), batch.column(1).to_pylist()
            copies, counts, names = [], [], []
            for key, value in zip(keys, batch.column(2)):
                if shard is None:
                    shard = ShardWriter(f"{folder}/ids-{parts[0].as_py():06d}-{uuid.uuid4().hex}.bin", dtype, base)
                data = value.as_buffer()
                packed = (encode(data.to_pybytes().decode("utf-8", "replace")) if data else b"") + ended
                copies.append(shard.add(key_bytes(key), packed))
                counts.append(len(packed) // wide)
                names.append(shard.path)
                if shard.full(shard_rows):
                    shard.close()
                    base, shard = base + shard.n, None
            yield pa.RecordBatch.from_arrays([parts, batch.column(1), pa.array(copies, pa.int32()), pa.array(counts, pa.int64()),
                                              pa.array(names, pa.string())], names=schema.names)
        if shard is not None:
            shard.close()

    rows = docs.select(F.col(ident).alias("id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange(F.col("id"), F.col("tie")).sortWithinPartitions("id", "tie")
    ordered.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(run, schema).write.parquet(f"{folder}/catalogue")
    return spark.read.schema(schema).parquet(f"{folder}/catalogue")


def read_ids(catalogue: DataFrame, make: Callable[[], Callable[[np.ndarray], list]], fields: list[T.StructField]) -> DataFrame:
    """(id, start, n_ids, fields): every document of the catalogue, looked up in its shard's index and read from its file.

    ``start`` counts the ids of all documents before it.  ``make()`` runs once a
    task and gives a function from a document's ids to the values of ``fields``.
    The catalogue lists a shard's documents together, so a task opens few shards.
    """
    totals = catalogue.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # one row per range partition, whatever the number of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), catalogue.schema["id"], T.StructField("at", T.LongType()),
                           T.StructField("n_ids", T.LongType()), *fields])
    types = [f.dataType for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        use, shard, name = make(), None, None
        for batch in batches:
            ids, copies, names = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            at, n, values, i = [], [], [], 0
            while i < len(ids):
                j = i
                while j < len(ids) and names[j] == names[i]:
                    j += 1
                if name != names[i]:
                    shard, name = ShardReader(names[i]), names[i]
                keys = [key_bytes(k) for k in ids[i:j]]
                for key, (first, held), copy in zip(keys, shard.rows(keys), copies[i:j], strict=True):
                    if copy >= held:
                        raise ValueError(f"key {key!r} has no row {copy} in {name}")
                    start, row = shard.row(first + copy)
                    at.append(shard.base + start)
                    n.append(len(row))
                    values.append(use(row))
                i = j
            columns = list(zip(*values, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.int64()), pa.array(n, pa.int64()),
                 *(pa.array(c, to_arrow_type(t)) for c, t in zip(columns, types, strict=True))], names=schema.names)

    found = catalogue.select("part", "id", "copy", "shard").mapInArrow(run, schema)
    return found.join(F.broadcast(starts), "part").select(
        "id", (F.col("at") + F.col("part_start")).alias("start"), "n_ids", *[f.name for f in fields])


def crc_of_ids() -> Callable[[np.ndarray], list]:
    """A document's ids -> the crc32 of them as little-endian unsigned 32-bit integers."""
    return lambda row: [zlib.crc32(row.astype("<u4").tobytes())]


def vocabulary() -> str:
    import public_tokenizers

    return ranks_bytes(public_tokenizers.path("word_bpe_49k.json")).decode()


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepared(spark), sf_dir)
    catalogue = write_ids(docs, vocabulary(), scratch_path(spark, "token-ids"), end_id=1)
    rows = read_ids(catalogue, crc_of_ids, [T.StructField("ids_crc32", T.LongType())])
    return rows.select(F.col("id").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


QUERIES = {"op12_token_files": op12_token_files}
