"""Language identification: known words first, then ever shorter character n-grams.

A word that the model knows adds its log frequency per language.  Another word
is padded and cut into n-grams of length ``MAX_N``; if the model knows any, the
mean of their log frequencies counts, else the next shorter length is tried.

The model is fitted on a bounded sample: about ``SAMPLE_PER_LANG`` labelled rows
per language, chosen by a hash of id and text, so that copies of a text are
chosen each on its own.  Words and n-grams of their whole
texts are counted by Spark; the ``MAX_WORDS`` most frequent words and the
``MAX_GRAMS`` most frequent n-grams make the model, whose size these numbers and
the number of languages bound (4 bytes times both).  What is pruned backs off.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties
go to the language that comes first by name; repeated rows are predicted each;
rows with a null language teach nothing; more than ``MAX_LANGS`` languages are
refused; without any labelled row every text is ``und``; an empty table gives an empty table; extra columns are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import SLICE_ROWS, cut, documents, fold, prepared, with_text_columns

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
MAX_N = 4
SAMPLE_PER_LANG = 6_000
MAX_WORDS, MAX_GRAMS = 100_000, 60_000
MAX_LANGS = 1_000
#: Numbers that the model has at most: with many languages it keeps fewer words and n-grams.
MAX_CELLS = 1 << 24
SMOOTH = 0.5
#: Unseen words that a task remembers, and distinct keys it counts before it hands them on.
MEMO = FLUSH = 1 << 17


def grams(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def has_letter(word: str) -> bool:
    """Whether a word is one: signs such as a raised two count as word characters without being letters."""
    return any(map(str.isalpha, word))


@dataclass
class Model:
    langs: list[str]
    words: list[str]
    word_rows: np.ndarray          # (words, langs) log frequencies
    grams: list[str]
    gram_rows: np.ndarray


class Scorer(dict):
    """word -> row of ``table``; row 0 is for words without a letter."""

    def __init__(self, model: Model):
        super().__init__()
        self.known = {w: i + 1 if has_letter(w) else 0 for i, w in enumerate(model.words)}
        self.grams = dict(zip(model.grams, model.gram_rows, strict=True))
        self.memo = max(1024, min(MEMO, MAX_CELLS // max(1, len(model.langs))))
        self.table = np.zeros((len(model.words) + 1 + self.memo, len(model.langs)), np.float32)
        self.table[1:len(model.words) + 1] = model.word_rows
        self.langs = model.langs
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.update(self.known)
        self.free = len(self.known) + 1

    def __missing__(self, word: str) -> int:
        if not has_letter(word):
            return 0
        at = self[word] = self.free
        self.free += 1
        self.table[at] = 0
        for n in range(MAX_N, 0, -1):
            rows = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if rows:
                self.table[at] = np.mean(rows, axis=0)
                break
        return at

    def predict(self, text: bytes | None) -> tuple[str, float]:
        words = WORD.findall((text or b"").decode("utf-8", "replace").lower())
        total, letters = np.zeros(len(self.langs)), False
        for i in range(0, len(words), self.memo // 2):
            some = words[i:i + self.memo // 2]
            if self.free + len(some) > len(self.table):
                self.restart()
            rows = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
            letters = letters or bool(rows.any())
            total += self.table[rows].sum(axis=0, dtype=np.float64)
        if not letters or not self.langs:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def sample(docs: DataFrame, per_lang: int, text: str, lang: str, ident: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """About ``per_lang`` rows of each language (all if it has fewer), and the languages by name."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(ident, text, F.lit(17)).alias("draw"))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect())
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: rarer ones could never be predicted")
    share = F.broadcast(docs.sparkSession.createDataFrame(
        [(name, min(1.0, per_lang / n)) for name, n in sizes], "lang string, share double"))
    chosen = rows.join(share, "lang").filter(F.pmod("draw", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    return chosen.drop("share", "draw"), [name for name, _ in sizes]


def key_counts(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(key, n0, n1, ...): counts per language of words (keys ``w...``) and n-grams (keys ``1...`` to ``4...``)."""
    number = {name: i for i, name in enumerate(langs)}

    def handed(counts: list[Counter]) -> Iterator[pa.RecordBatch]:
        for i, words in enumerate(counts):
            out: Counter = Counter()
            for w, c in words.items():
                if not has_letter(w):
                    continue
                out["w" + w] += c
                for n in range(1, MAX_N + 1):
                    for g in grams(w, n):
                        out[f"{n}{g}"] += c
            words.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([i] * len(out), pa.int32()),
                                              pa.array(list(out.values()), pa.int64())], names=["key", "lang", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in langs]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts[number[name]].update(WORD.findall(text.decode("utf-8", "replace").lower()))
                if sum(map(len, counts)) > FLUSH:
                    yield from handed(counts)
        yield from handed(counts)

    each = rows.select("lang", F.col("text").cast("binary")).mapInArrow(run, "key string, lang int, n long")
    return each.groupBy("key").agg(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}")
                                     for i in range(len(langs))])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG,
        ident: str = "doc_id") -> Model:
    """The model from the labelled rows of ``docs``."""
    rows, langs = sample(docs, per_lang, text, lang, ident)
    if not langs:
        return Model([], [], np.zeros((0, 0)), [], np.zeros((0, 0)))
    names = [f"n{i}" for i in range(len(langs))]
    counted = cut(key_counts(rows, langs), "language-counts").withColumn("all", sum(map(F.col, names), F.lit(0)))
    kind = F.substring("key", 1, 1)
    totals = {r["kind"]: r for r in counted.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("keys"), *[F.sum(n).alias(n) for n in names]).collect()}

    def top(is_word: bool, limit: int) -> tuple[list[str], np.ndarray]:
        found = counted.filter((kind == "w") == is_word).orderBy(F.desc("all"), "key").limit(limit).drop("all").toPandas()
        keys = found.pop("key").tolist()
        n = found[names].to_numpy(np.float64)
        seen = np.array([[totals[k[0]][m] for m in names] for k in keys], np.float64).reshape(n.shape)
        size = np.array([totals[k[0]]["keys"] for k in keys], np.float64)[:, None]
        return [k[1:] for k in keys], np.log((n + SMOOTH) / (seen + SMOOTH * size)).astype(np.float32)

    share = min(1.0, MAX_CELLS / (len(langs) * (MAX_WORDS + MAX_GRAMS)))
    return Model(langs, *top(True, int(share * MAX_WORDS)), *top(False, int(share * MAX_GRAMS)))


def predict(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (the posterior of the predicted language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: list(zip(*map(scorer.predict, texts), strict=True))

    return with_text_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())],
                             make, text, drop_text)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepared(spark), sf_dir).withColumn("held_out", fold("doc_id", 4) == 2)
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model, drop_text=True)


QUERIES = {"op1_language_id": op1_language_id}
