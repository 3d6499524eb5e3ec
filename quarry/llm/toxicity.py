"""Toxicity classifier by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts of any kind the unlabelled ones.
A linear classifier is trained in numpy on the class-prior-corrected risk
``prior * R(positive as toxic) + max(0, R(unlabelled as clean) - prior * R(positive
as clean))``; where the second part falls below zero it gives no gradient.

Features say which of the selected words and character n-grams occur in the
whole text.  They are selected, and the classifier is fitted, on a bounded
sample (``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows at most in expectation,
chosen by a hash); the prior is the share of toxic rows among all labelled ones.

Defined cases: a null or blank text has no feature and the score of the bias;
repeated rows are scored each; repeated labels count once, toxic if any says so;
without positives or texts the score is 0; an empty table gives an empty table;
extra columns are carried, columns named like an output are replaced.
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

from quarry.llm.common import SLICE_ROWS, cut, documents, fold, free_name, prepared, table, with_text_columns

WORD = re.compile(r"[^\W\d_]+")
MAX_POSITIVE, MAX_UNLABELLED = 5_000, 15_000
FEATURES = 1_500
GRAM_LENGTHS = (4, 5, 6)
MIN_POSITIVE, MIN_Z = 3, 2.0
EPOCHS, BATCH, RATE, DECAY = 80, 500, 0.02, 3e-4
SEED = 5
#: Words that a task remembers, and parts it counts before it hands them on.
MEMO = FLUSH = 1 << 17


def parts(word: str) -> set[str]:
    """The padded word and its character n-grams."""
    padded = f"<{word}>"
    out = {padded}
    for n in GRAM_LENGTHS:
        out.update(padded[i:i + n] for i in range(len(padded) - n + 1))
    return out


def distinct_words(text: bytes | None) -> set[str]:
    return set(WORD.findall((text or b"").decode("utf-8", "replace").lower()))


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float


class Finder(dict):
    """word -> numbers of the selected features in it."""

    def __init__(self, features: list[str]):
        super().__init__()
        self.number = {f: i for i, f in enumerate(features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = tuple(self.number[p] for p in parts(word) if p in self.number)
        return found

    def find(self, text: bytes | None) -> list[int]:
        return sorted({i for w in distinct_words(text) for i in self[w]})


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(positive, text) of the sample, written to the shared folder, and the prior. Both tables: training rows only."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*"), F.sum("toxic")).first()
    n, toxic = counts[0], counts[1] or 0
    total = docs.count()

    def share(cap: int, of: int) -> int:
        return min(1_000_000, cap * 1_000_000 // max(of, 1))

    # About MAX_POSITIVE ids: a bounded table.
    ids = known.filter("toxic = 1").filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < share(MAX_POSITIVE, toxic))
    text = docs.filter("text IS NOT NULL").select("doc_id", "text")
    positive = text.join(F.broadcast(ids.select("doc_id")), "doc_id").distinct().select(F.lit(1).alias("positive"), "text")
    free = text.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share(MAX_UNLABELLED, total)) \
        .select(F.lit(0).alias("positive"), "text")
    return cut(positive.union(free), "toxic-sample"), toxic / max(n, 1)


def select_features(rows: DataFrame, n_positive: int, n_free: int) -> list[str]:
    """The ``FEATURES`` parts that are most over-represented in positives, by a z-score of document shares."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def handed():
            for y, c in enumerate(counts):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()),
                                                  pa.array(list(c.values()), pa.int64())], names=["part", "positive", "n"])
                c.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                for y, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    counts[y].update({p for w in distinct_words(text) for p in parts(w)})
                if sum(map(len, counts)) > FLUSH:
                    yield from handed()
        yield from handed()

    each = rows.select("positive", F.col("text").cast("binary")).mapInArrow(run, "part string, positive int, n long")
    pos = F.sum(F.when(F.col("positive") == 1, F.col("n")).otherwise(0)).alias("pos")
    free = F.sum(F.when(F.col("positive") == 0, F.col("n")).otherwise(0)).alias("free")
    p, u = F.col("pos") / max(n_positive, 1), F.col("free") / max(n_free, 1)
    z = (p - u) / F.sqrt(p / max(n_positive, 1) + u / max(n_free, 1))
    best = each.groupBy("part").agg(pos, free).filter(F.col("pos") >= MIN_POSITIVE).select("part", z.alias("z")) \
        .filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "part").limit(FEATURES)
    return [r[0] for r in best.collect()]


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on 0/1 rows, by the non-negative risk with Adam."""
    rng = np.random.default_rng(SEED)
    xp, xu = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    steps = max(1, -(-len(xu) // BATCH))
    for _ in range(max(EPOCHS, 2000 // steps)):
        order = rng.permutation(len(xu))
        for s in range(steps):
            u = xu[order[s * BATCH:(s + 1) * BATCH]].astype(np.float64)
            p = xp[rng.integers(0, len(xp), min(BATCH, max(len(xp), 32)))].astype(np.float64)
            sp, su = 1 / (1 + np.exp(-(p @ w + b))), 1 / (1 + np.exp(-(u @ w + b)))
            as_clean = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            gu = np.append(su @ u, su.sum()) / len(u) - prior * np.append(sp @ p, sp.sum()) / len(p)
            gp = prior * np.append((sp - 1) @ p, (sp - 1).sum()) / len(p)
            g = gp + gu if as_clean >= 0 else gp
            g[:-1] += DECAY * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier from training rows of documents and labels."""
    rows, prior = training_rows(docs, labels)
    sizes = dict(rows.groupBy("positive").count().collect())
    if not sizes.get(1) or not sizes.get(0):
        return Model([], np.zeros(0), -50.0)
    features = select_features(rows, sizes[1], sizes[0])

    def make():
        finder = Finder(features)
        return lambda texts: [[np.array(finder.find(t), "<u2").tobytes() for t in texts]]

    found = with_text_columns(rows, [T.StructField("found", T.BinaryType())], make, "text", drop=True).toPandas()
    x = np.zeros((len(found), len(features)), np.uint8)
    for i, f in enumerate(found["found"]):
        x[i, np.frombuffer(f, "<u2")] = 1
    w, b = fit_nnpu(x, found["positive"].to_numpy() == 1, min(max(prior, 1e-3), 0.9))
    return Model(features, w, b)


def score(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the estimated probability that the text is toxic."""
    def make():
        finder = Finder(model.features)

        def one(t):
            return float(1 / (1 + np.exp(-(model.bias + sum(model.weights[i] for i in finder.find(t))))))
        return lambda texts: [[one(t) for t in texts]]

    return with_text_columns(docs, [T.StructField(out, T.DoubleType())], make, text, drop_text)


def training_part(df: DataFrame) -> DataFrame:
    return df.filter(fold("doc_id", 5) != 0)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    model = fit(training_part(docs), training_part(labels))
    name = free_name(docs, "score")
    return score(docs, model, out=name).filter(F.col(name) < threshold).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(prepared(spark), sf_dir), table(spark, sf_dir, "labels")
    model = fit(training_part(docs), training_part(labels))
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return score(rows, model, drop_text=True).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op6_toxicity": op6_toxicity}
