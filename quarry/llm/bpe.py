"""Byte-level BPE: encoding and decoding with a given rank file.

Two tiers resolve each pre-token.  A minimal perfect hash over the vocabulary
answers pre-tokens that are whole entries; the others are merged by a heap of
ranked pairs over a linked list of bytes.  Both tiers run in tasks; the rank
file (a fixed vocabulary, about 1 MB) is the only thing every task gets.

Defined cases: a null or empty text gives no ids and empty decoded bytes;
repeated rows are encoded alike, each on its own row; an empty table gives an
empty table; extra columns are carried, a column named like an output is
replaced.  Texts are encoded whole; a pre-token of n bytes costs O(n log n).
"""

from __future__ import annotations

import base64
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import documents, prepared, ranks_bytes, with_text_columns

#: Pre-tokens in a task's memory; when it is full it becomes the older half, which is asked before encoding anew.
MEMO = 1 << 17


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank from a rank file's lines ``base64 rank``."""
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in data.splitlines() if line)}


class PerfectHash:
    """Minimal perfect hash of a fixed key set: n keys, n slots, one displacement per bucket.

    Buckets are placed largest first: a bucket of several keys takes the first
    seed that sends them all to free slots, a bucket of one key is pointed at
    a free slot directly (a negative displacement).
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = max(len(keys), 1)
        buckets: list[list[int]] = [[] for _ in range(n)]
        for k, key in enumerate(keys):
            buckets[xxhash.xxh64_intdigest(key) % n].append(k)
        self.displace = [0] * n
        self.slots = [-1] * n
        free = None
        for b in sorted(range(n), key=lambda b: -len(buckets[b])):
            members = buckets[b]
            if len(members) > 1:
                seed = 1
                while True:
                    spots = [xxhash.xxh64_intdigest(keys[k], seed) % n for k in members]
                    if len(set(spots)) == len(spots) and all(self.slots[s] < 0 for s in spots):
                        break
                    seed += 1
                self.displace[b] = seed
            elif members:
                free = free if free is not None else iter([s for s in range(n) if self.slots[s] < 0])
                spots = [next(free)]
                self.displace[b] = -spots[0] - 1
            else:
                break
            for k, s in zip(members, spots, strict=True):
                self.slots[s] = k
        self.keys = [keys[k] if k >= 0 else None for k in self.slots]

    def find(self, key: bytes) -> int:
        """The key's index in the list it was built from, or -1."""
        d = self.displace[xxhash.xxh64_intdigest(key) % self.n]
        s = -d - 1 if d < 0 else xxhash.xxh64_intdigest(key, d) % self.n
        return self.slots[s] if self.keys[s] == key else -1


#: Packers of 1, 2, ... little-endian unsigned 32-bit integers.
PACK = [struct.Struct(f"<{n}I").pack for n in range(65)]


def pack(ids: list[int]) -> bytes:
    return PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, dtype="<u4").tobytes()


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no vocabulary entry: lowest rank first, leftmost on ties."""
    n, rank = len(word), ranks.get
    after = list(range(1, n + 1))      # start of the next piece
    before = list(range(-1, n - 1))    # start of the piece before
    best = [rank(word[i:i + 2], -1) for i in range(n - 1)] + [-1]  # rank of the pair that begins at a live piece
    heap = [(r << 32) | i for i, r in enumerate(best) if r >= 0]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, r = top & 0xFFFFFFFF, top >> 32
        if best[i] != r:
            continue
        j = after[i]
        end = after[i] = after[j]
        best[j] = -1
        if end < n:
            before[end] = i
            best[i] = r = rank(word[i:after[end]], -1)
            if r >= 0:
                heappush(heap, (r << 32) | i)
        else:
            best[i] = -1
        p = before[i]
        if p >= 0:
            best[p] = r = rank(word[p:end], -1)
            if r >= 0:
                heappush(heap, (r << 32) | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """pre-token -> packed little-endian ids, filled on demand."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.whole = PerfectHash(list(self.ranks))
        self.ids = list(self.ranks.values())
        self.split = regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        packed = self.older.get(token)
        if packed is None:
            word = token.encode("utf-8", "replace")
            k = self.whole.find(word)
            packed = PACK[1](self.ids[k]) if k >= 0 else pack(merge_bytes(word, self.ranks))
        self[token] = packed
        return packed

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split((text or b"").decode("utf-8", "replace"))))


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids",
           drop_text: bool = False) -> DataFrame:
    """``docs`` with ``out``: the text's ids, packed as little-endian unsigned 32-bit integers."""
    def make():
        enc = Encoder(ranks, pattern)
        return lambda texts: [[enc.encode(t) for t in texts]]

    return with_text_columns(docs, [T.StructField(out, T.BinaryType())], make, text, drop_text)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that the packed ids stand for."""
    def make():
        by_rank = {r: tok for tok, r in read_ranks(ranks).items()}
        return lambda packed: [[b"".join(map(by_rank.__getitem__, np.frombuffer(p or b"", "<u4").tolist()))
                                for p in packed]]

    return with_text_columns(df, [T.StructField(out, T.BinaryType())], make, ids)


def encode_and_decode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with ids and decoded as by ``encode`` and ``decode``, in one pass over the texts."""
    def make():
        enc = Encoder(ranks, pattern)
        by_rank = {r: tok for tok, r in enc.ranks.items()}

        def both(texts):
            ids = [enc.encode(t) for t in texts]
            return [ids, [b"".join(map(by_rank.__getitem__, np.frombuffer(p, "<u4").tolist())) for p in ids]]
        return both

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return with_text_columns(docs, fields, make, text, drop_text)


def vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    return ranks_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the decoded bytes."""
    ranks, pattern = vocabulary()
    coded = encode_and_decode(docs.select("doc_id", "text"), ranks, pattern, drop_text=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(prepared(spark), sf_dir))


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
