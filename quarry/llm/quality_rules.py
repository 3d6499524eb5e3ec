"""Quality rules with robust multivariate outliers, by DataFrame functions only.

Five statistics of each whole text are transformed to a vector.  Per language
and source a minimum-covariance-determinant estimate of location and scatter is
found by concentration steps: the share ``CORE`` of rows nearest to the estimate
gives the next one, and the start with the smaller determinant wins.  A text is
rejected by a base rule, or if its squared Mahalanobis distance exceeds ``CUTOFF``.

Only the statistics (one narrow row per text) are written and grouped; a group's
sums and quantile sketches are combined before the shuffle, so a source with a
third of all rows is no single task.  Groups under ``MIN_GROUP`` rows take their
language's estimate, or that of all rows.

Defined cases: a null or blank text has no words and fails the base rule; a null
language or source is a value of its own; repeated rows count each; a group
without spread has the scatter ``FLOOR`` and rejects nothing equal; an
empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, documents, prepared
from quarry.llm.native import bind, covered

# Characters between words, and symbols.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
DIMS = 5
CORE = 0.75
STEPS = 4
#: Groups times starts whose one number each is broadcast.
FEW_GROUPS = 100_000
MIN_GROUP = 100
#: Added to the variance of each transformed statistic, so that none is next to zero.
FLOOR = (0.25, 0.02, 0.5, 1.0, 1.0)
#: Variances of a core of 0.75 of a 5-variate normal sample are this factor too small.
CONSISTENT = 1.42
#: Squared distance of the 0.9999 quantile of chi-square with 5 degrees.
CUTOFF = 25.74


def repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that the text has twice or more."""
    def from_keys(keys: Column) -> Column:
        ranked = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def again(s: Column) -> Column:
            def place(x: Column, j: Column) -> Column:
                same = F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)) | \
                    F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
                return F.when(same, F.struct(x["i"].alias("pos"), F.lit(WINDOW).alias("length")))
            return covered(F.array_sort(F.filter(F.transform(s, place), lambda x: x.isNotNull())))

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(bind(ranked, again))

    def from_hashes(h: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        return F.when(F.size(h) >= WINDOW, bind(keys, from_keys)).otherwise(F.lit(0).cast("long"))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)


def statistics(docs: DataFrame, text: str = "text", ident: str = "doc_id", lang: str = "lang",
               source: str = "source") -> DataFrame:
    """Per row: id, lang, source and the base statistics of the whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE))
    rows = docs.select(
        F.col(ident).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
        F.array_remove(F.split(body, SPACE), "").alias("ws"), lines.alias("lines"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    return rows.select(
        "id", "lang", "source", F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("ws")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """The statistics on scales on which ordinary texts are about normal."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("n_words"), F.log1p(F.col("word_chars") / words),
            F.log1p(1000 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            F.log1p(1000 * F.col("n_dup_lines") / words), F.log1p(100 * F.col("n_repeat_words") / words)]


def distance() -> Column:
    """Squared distance of x from the estimate in m and w (the inverse of the scatter's Cholesky factor)."""
    total = F.lit(0.0)
    for i in range(DIMS):
        z = sum((F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + z * z
    return total


def factored(est: DataFrame) -> DataFrame:
    """From means m and covariances c (i >= j) to m, w and the log determinant."""
    for j in range(DIMS):
        rest = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        est = est.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - rest, F.lit(FLOOR[j] / 100))))
        for i in range(j + 1, DIMS):
            rest = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            est = est.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - rest) / F.col(f"l{j}{j}"))
    for j in range(DIMS):
        est = est.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, DIMS):
            rest = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            est = est.withColumn(f"w{i}{j}", -rest / F.col(f"l{i}{i}"))
    det = sum((F.log(F.col(f"l{j}{j}")) for j in range(DIMS)), F.lit(0.0)).alias("log_det")
    return est.select("grp", "start", *[f"m{j}" for j in range(DIMS)],
                      *[f"w{i}{j}" for i in range(DIMS) for j in range(i + 1)], det)


def moments(scale: float) -> list[Column]:
    """Means and scaled covariances of x, with the least variances added."""
    means = [F.avg(f"x{j}").alias(f"m{j}") for j in range(DIMS)]
    covs = [(F.covar_pop(f"x{i}", f"x{j}") * scale + (FLOOR[i] if i == j else 0.0)).alias(f"c{i}{j}")
            for i in range(DIMS) for j in range(i + 1)]
    return means + covs


def starts(rows: DataFrame) -> DataFrame:
    """Two first estimates per group around the medians: absolute deviations, and signs of the scaled vectors."""
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(f"x{j}", 0.5).alias(f"m{j}") for j in range(DIMS)])
    off = rows.join(middle, "grp")
    spread = off.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(f"x{j}") - F.col(f"m{j}")), 0.5).alias(f"s{j}")
                                      for j in range(DIMS)])
    scaled = [F.sqrt(F.pow(F.col(f"s{j}") * 1.4826, F.lit(2.0)) + FLOOR[j]) for j in range(DIMS)]
    both = cut(middle.join(spread, "grp").select("grp", *[f"m{j}" for j in range(DIMS)],
                                                 *[c.alias(f"s{j}") for j, c in enumerate(scaled)]), "mcd-start")
    diagonal = both.select("grp", F.lit(0).alias("start"), *[f"m{j}" for j in range(DIMS)],
                           *[(F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}")
                             for i in range(DIMS) for j in range(i + 1)])
    z = rows.join(both, "grp").select("grp", *[((F.col(f"x{j}") - F.col(f"m{j}")) / F.col(f"s{j}")).alias(f"z{j}")
                                               for j in range(DIMS)])
    size = F.greatest(sum((F.col(f"z{j}") * F.col(f"z{j}") for j in range(DIMS)), F.lit(0.0)), F.lit(1e-9))
    signs = z.withColumn("size", size).groupBy("grp").agg(
        *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("size")).alias(f"r{i}{j}") for i in range(DIMS) for j in range(i + 1)])
    signed = both.join(signs, "grp").select(
        "grp", F.lit(1).alias("start"), *[f"m{j}" for j in range(DIMS)],
        *[(F.col(f"r{i}{j}") * DIMS * F.col(f"s{i}") * F.col(f"s{j}") + (FLOOR[i] if i == j else 0.0)).alias(f"c{i}{j}")
          for i in range(DIMS) for j in range(i + 1)])
    return factored(diagonal.union(signed))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Per group the estimate with the smaller determinant; ``rows`` has grp and x0, x1, ..."""
    est = cut(starts(rows), "mcd-0")
    for step in range(1, STEPS + 1):
        near = rows.join(est, "grp").select("grp", "start", *[f"x{j}" for j in range(DIMS)], distance().alias("d"))
        reach = cut(near.groupBy("grp", "start").agg(F.percentile_approx("d", CORE, 10000).alias("reach")), f"mcd-reach-{step}")
        # one narrow row per group: no row moves to a hot group's task while they are few
        core = near.join(F.broadcast(reach) if reach.count() <= FEW_GROUPS else reach, ["grp", "start"]).filter("d <= reach")
        est = cut(factored(core.groupBy("grp", "start").agg(*moments(CONSISTENT))), f"mcd-{step}")
    best = est.groupBy("grp").agg(F.min(F.struct("log_det", "start"))["start"].alias("start"))
    return est.join(best, ["grp", "start"])


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """Per row of ``docs``: id, the base statistics, base_failed, distance (null if it failed) and kept."""
    stats = cut(statistics(docs, **columns).withColumn("base_failed", base_failed()), "quality-stats")

    def name(*parts: str) -> Column:
        """A group of rows with equal ``parts``; the number of parts tells the levels apart."""
        return F.concat_ws("\x01", F.lit(str(len(parts))), *[F.coalesce(F.col(p), F.lit("\x02")) for p in parts])

    passed = stats.filter("NOT base_failed")
    cells = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = passed.groupBy("lang").agg(F.count("*").alias("n_lang"))
    levels = cut(cells.withColumnRenamed("lang", "l").join(langs, F.col("l").eqNullSafe(langs["lang"])).select(
        F.col("l").alias("g_lang"), F.col("source").alias("g_source"),
        F.when(F.col("n") >= MIN_GROUP, name("l", "source")).when(F.col("n_lang") >= MIN_GROUP, name("l"))
        .otherwise(name()).alias("grp")), "quality-groups")
    # A pooled estimate is one of all rows of its language, or of all rows.
    pooled = levels.select("grp").distinct()
    whole = passed.select("lang", "source", *[x.alias(f"x{j}") for j, x in enumerate(vector())])
    members = whole.withColumn("grp", F.explode(F.array(name("lang", "source"), name("lang"), name()))) \
        .join(pooled, "grp", "left_semi")
    est = cut(robust_estimates(members), "mcd")
    rated = stats.join(levels, F.col("lang").eqNullSafe(levels["g_lang"]) & F.col("source").eqNullSafe(levels["g_source"]), "left") \
        .select(stats["*"], "grp", *[x.alias(f"x{j}") for j, x in enumerate(vector())]).join(est, "grp", "left")
    far = F.when(~F.col("base_failed"), distance())
    return rated.select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        far.alias("distance"), (~F.col("base_failed") & (far <= CUTOFF)).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(prepared(spark), sf_dir)).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.coalesce("kept", F.lit(False)).alias("kept"), "distance")


QUERIES = {"op3_quality_rules": op3_quality_rules}
