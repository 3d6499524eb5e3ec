"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in statistics of its whole text.  It is learned
from preference pairs (a good text before a bad one) by the logistic loss on the
difference of their features, by Newton's method.  The threshold is a quantile of
the training strengths: near the one that the share of bad rows gives, in the
widest gap between neighbours there.  The score maps strength to 0..1 so that
``ACCEPT`` lies at this quantile.

Every labelled training row counts, in the features' moments, in the pairs and in
the threshold.  Each row of the larger class is paired with rows of the smaller
one, dealt by a hash: all of them or as many as give ``PAIRS`` pairs, at least
one, so that no row is in no pair.  Pairs and strengths stay on the executors;
one sum of each task reaches the driver.

Defined cases: a null or empty text has the features of an empty text; repeated
rows are scored each; repeated labels count once, bad if any says so; if the
labels have one class only every text scores ``ACCEPT`` (or 0 if all are bad);
an empty table gives an empty table; extra columns are carried, columns named
like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import cut, documents, fold, prepared, table, with_text_columns
from quarry.operators.ordinals import with_ordinals

PAIRS = 60_000
#: Pairs of a row of the smaller class that meet in one task.
PAIRS_OF_ROW = 1_000
ACCEPT = 0.7
STEPS, DONE, DECAY = 50, 1e-9, 1e-3
SEED = 9
SHINGLE = 4

# Groups of bytes whose shares are features.
BYTE_GROUPS = (b"#*$%&<>", b"|", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
               b"abcdefghijklmnopqrstuvwxyz", b"\n", b"(){}[]=/\\_@+~^")
FEATURES = 2 * len(BYTE_GROUPS) + 8


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte groups, words, repetition and length, with square roots that tell small shares apart."""
    data = text or b""
    n = max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.array([counts[list(g)].sum() / n for g in BYTE_GROUPS])
    words = data.split()
    k = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    runs = list(zip(*(words[j:] for j in range(SHINGLE)), strict=False))
    repeated = 1 - len(set(runs)) / max(len(runs), 1) if runs else 0.0
    more = [repeated, np.sqrt(repeated), 1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
            len(set(words)) / k, np.log1p(len(words)) / 10, len(data) / k / 10, float(len(words) < 10),
            np.log1p(max(map(len, words), default=0)) / 10]
    return np.concatenate([share, np.sqrt(share), more])


@dataclass
class Model:
    mean: np.ndarray
    weights: np.ndarray           # already divided by the features' deviations
    cut: float
    scale: float


def summed(rows: DataFrame, columns: list[str], sums) -> np.ndarray | None:
    """The sum of ``sums(*matrices)`` over the rows' features: each task adds up its own and hands on one row."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = sums(*(np.frombuffer(b"".join(c.to_pylist()), np.float64).reshape(-1, FEATURES) for c in batch.columns))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    found = [np.frombuffer(r[0]) for r in rows.select(*columns).mapInArrow(run, "total binary").collect()]
    return np.sum(found, axis=0) if found else None


def pairs_of(rows: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """(good, bad): features of pairs; every row of ``rows`` (good, features, n: numbered, bad ones first) is in at least one."""
    large, small = max(n_bad, n_good), min(n_bad, n_good)
    each = min(small, max(1, -(-PAIRS // large)))
    # rows of a very small class are copied, so that no task gets all pairs of one
    parts = max(1, large * each // small // PAIRS_OF_ROW)
    good = rows.filter("good").select((F.col("n") - n_bad).alias("i"), F.col("features").alias("good"))
    bad = rows.filter("NOT good").select(F.col("n").alias("i"), F.col("features").alias("bad"))
    many, few = (good, bad) if n_good >= n_bad else (bad, good)
    steps = F.explode(F.sequence(F.lit(0), F.lit((each - 1) * (small // each)), F.lit(small // each)))
    many = many.withColumn("step", steps).withColumn("part", F.expr(f"i div {small}") % parts).withColumn("i", (F.col("i") + F.col("step")) % small)
    few = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    return many.join(few.hint("merge"), ["i", "part"]).select("good", "bad")


def bradley_terry(pairs: DataFrame, spread: np.ndarray) -> np.ndarray:
    """Weights that put good rows before bad ones: the minimum of the logistic loss of feature differences in units of ``spread``."""
    def sums_at(w):
        def sums(good, bad):
            d = (good - bad) / spread
            z = np.clip(d @ w, -500, 500)
            p = 1 / (1 + np.exp(z))
            return np.concatenate([[len(d), np.logaddexp(0, -z).sum()], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
        return sums

    w, best, step = np.zeros(FEATURES), np.inf, np.zeros(FEATURES)
    for _ in range(STEPS):
        total = summed(pairs, ["good", "bad"], sums_at(w + step))
        n, loss = total[0], total[1] / total[0] + DECAY * (w + step) @ (w + step) / 2
        if loss > best:
            step = step / 2                       # too far
            continue
        w, best = w + step, loss
        g = -total[2:2 + FEATURES] / n + DECAY * w
        step = -np.linalg.solve(total[2 + FEATURES:].reshape(FEATURES, FEATURES) / n + DECAY * np.eye(FEATURES), g)
        if -(g @ step) < DONE:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The ranking from training rows of documents and labels."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    # features are narrow: no text is shuffled
    seen = with_features(docs.select("doc_id", F.xxhash64("text", F.lit(SEED)).alias("hash"), "text"))
    rows = cut(seen.join(known, "doc_id").dropDuplicates(["doc_id", "hash"]), "quality-features")
    n_good, n_bad = (int(x or 0) for x in rows.agg(F.count(F.when(F.col("good"), 1)), F.count(F.when(~F.col("good"), 1))).head())
    if not n_good or not n_bad:
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), np.inf if n_bad else 0.0, 1.0)
    sums = summed(rows, ["features"], lambda x: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)])) / (n_good + n_bad)
    mean = sums[:FEATURES]
    spread = np.sqrt(np.maximum(sums[FEATURES:] - mean * mean, 0)) + 1e-3
    numbered = with_ordinals(rows.select("good", F.xxhash64("doc_id", "hash").alias("at"), "features"), F.col("good"), F.col("at"), out="n")
    w = bradley_terry(cut(pairs_of(numbered, n_bad, n_good), "quality-pairs"), spread) / spread
    return Model(mean, w, widest_gap(strengths(rows, mean, w), n_good + n_bad, n_bad), 1.0)


def strengths(rows: DataFrame, mean: np.ndarray, weights: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array((x - mean) @ weights, pa.float64())], names=["strength"])

    return rows.select("features").mapInArrow(run, "strength double")


def near_quantile(n: int, bad: int) -> tuple[int, int]:
    """First and last rank within a fifth of ``bad``, of ``n``."""
    return max(int(0.8 * bad) - 1, 0), min(int(1.2 * bad) + 1, n - 1)


def widest_gap(rows: DataFrame, n: int, bad: int) -> float:
    """``quantile_cut`` of the ``n`` rows' strengths: neighbours meet by their ranks."""
    low, high = near_quantile(n, bad)
    near = with_ordinals(rows, F.col("strength"), out="n").filter(F.col("n").between(low, high))
    after = near.select((F.col("n") - 1).alias("n"), F.col("strength").alias("next"))
    gap = F.struct((F.col("next") - F.col("strength")).alias("gap"), (-F.col("n")).alias("first"), ((F.col("next") + F.col("strength")) / 2).alias("cut"))
    return float(near.join(after.hint("merge"), "n").agg(F.max(gap)["cut"]).head()[0])


def quantile_cut(strength: np.ndarray, bad: int) -> float:
    """The middle of the widest gap among the strengths whose rank is within a fifth of ``bad``."""
    order = np.sort(strength)
    low, high = near_quantile(len(order), bad)
    at = low + int(np.argmax(np.diff(order[low:high + 1])))
    return float(order[at] + order[at + 1]) / 2


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    def make():
        return lambda texts: [[features(t).tobytes() for t in texts]]

    return with_text_columns(docs, [T.StructField("features", T.BinaryType())], make, text, drop=True)


def score(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with score; ``ACCEPT`` is the threshold."""
    shift = np.log(ACCEPT / (1 - ACCEPT))

    def make():
        def scores(texts):
            strength = (np.array([features(t) for t in texts]) - model.mean) @ model.weights - model.cut
            return [(1 / (1 + np.exp(-np.clip(strength / model.scale + shift, -500, 500)))).tolist()]
        return scores

    return with_text_columns(docs, [T.StructField("score", T.DoubleType())], make, text, drop_text)


def op9_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(prepared(spark), sf_dir), table(spark, sf_dir, "labels")
    model = fit(docs.filter(fold("doc_id", 4) != 2), labels.filter(fold("doc_id", 4) != 2))
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return score(rows, model, drop_text=True).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


QUERIES = {"op9_quality_ranker": op9_quality_ranker}
