"""Token counts of whole texts with a tokenizer library, in bounded memory.

Short texts are cut at spaces between two other characters: there the pattern
always begins a pre-token, so the pieces' counts add up, and each distinct piece
is encoded once while a task remembers it.  A huge text is encoded in overlapping
chunks with offsets, spliced at stable common boundaries: a position where both
chunks begin a pre-token.  From such a position on the pre-tokenizer sees the
same characters in both, so both go on alike; a margin to either chunk edge
keeps cut pre-tokens and cut added tokens out of it.  Where an overlap has no
common boundary it is widened, and at last the left chunk is lengthened, so the
count is always the one of the whole text.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted each; an empty table gives an empty table; extra columns are carried, a
column named like an output is replaced.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import documents, prepared, ranks_bytes, with_text_columns

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 65_536, 1_024
#: Pieces that a task remembers; beyond it the memory starts afresh.
MEMO = 1 << 20
#: A space that neither follows nor precedes white space.
STABLE = re.compile(r"(?<=\S) (?=\S)")


def edge_margin(config: str) -> int:
    """Characters to keep from a chunk's edge: a whole added token and the pattern's lookahead.

    The splice proof holds for byte-level pre-tokenizers without a normalizer whose
    added tokens take no neighbours and hold no white space, at which texts are
    cut; other configurations are refused.
    """
    spec = json.loads(config)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
            or not pre.get("use_regex", True) \
            or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")) \
            or any(c.isspace() for a in added for c in a["content"]):
        raise ValueError("chunks can be spliced for plain byte-level tokenizers only")
    return 4 + max([len(a["content"]) for a in added], default=0)


class Chunk:
    """A piece's encoding: absolute start of each pre-token -> tokens before it, and its size."""

    def __init__(self, encode, text: str, begin: int, end: int):
        enc = encode(text[begin:end])
        words, offsets = enc.word_ids, enc.offsets
        self.before, last = {}, None
        for i, w in enumerate(words):
            if w != last:
                self.before[begin + offsets[i][0]] = i
                last = w
        self.size, self.begin, self.end = len(words), begin, end


def count_spliced(encode, text: str, margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``encode`` gives an encoding with word ids and offsets."""
    total, begin, size = 0, 0, chunk          # begin: a proven boundary; all before it is counted
    left = Chunk(encode, text, 0, size)
    while left.end < len(text):
        widened, common, right = overlap, [], None
        while not common and widened < left.end - begin:
            right = Chunk(encode, text, left.end - widened, left.end - widened + max(size, 2 * widened))
            low, high = max(right.begin + margin, begin), left.end - margin
            common = [p for p in right.before if low <= p <= high and p in left.before]
            widened *= 2
        if common:
            splice = common[len(common) // 2]
            total += left.before[splice] - left.before.get(begin, 0)
            begin, left, size = splice, right, chunk
        else:                                 # no boundary anywhere: a longer left chunk, from the last proven one
            size = 2 * max(size, left.end - begin)
            left = Chunk(encode, text, begin, begin + size)
    return total + left.size - left.before.get(begin, 0)


def count_tokens(docs: DataFrame, config: str, text: str = "text", out: str = "n_tokens",
                 chunk: int = CHUNK, overlap: int = OVERLAP, drop_text: bool = False) -> DataFrame:
    """``docs`` with ``out``: tokens of each whole text by the tokenizer whose JSON is ``config``."""
    margin = edge_margin(config)

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(config)

        def one(piece: str):
            return tok.encode(piece, add_special_tokens=False)

        known: dict[str, int] = {}      # piece -> tokens of a space and the piece

        def sizes(pieces: list[str]) -> list[int]:
            return [len(e) for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]

        def counts(texts):
            whole = [(t or b"").decode("utf-8", "replace") for t in texts]
            cut = [STABLE.split(t) if len(t) <= chunk else [""] for t in whole]
            new = list({p for pieces in cut for p in pieces[1:]} - known.keys())
            if len(known) + len(new) > MEMO:
                known.clear()
                new = list({p for pieces in cut for p in pieces[1:]})
            known.update(zip(new, sizes([" " + p for p in new]), strict=True))
            first = sizes([pieces[0] for pieces in cut])
            return [[count_spliced(one, t, margin, chunk, overlap) if len(t) > chunk
                     else n + sum(map(known.__getitem__, pieces[1:]))
                     for t, n, pieces in zip(whole, first, cut, strict=True)]]
        return counts

    return with_text_columns(docs, [T.StructField(out, T.LongType())], make, text, drop_text)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    config = ranks_bytes(public_tokenizers.path("byte_bpe_50k.json")).decode("utf-8")
    docs = documents(prepared(spark), sf_dir).select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(docs, config, drop_text=True).withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op10_token_counts": op10_token_counts}
