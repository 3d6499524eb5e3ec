"""Held-out accuracy, what may be learned from, and defined cases of the three classifiers."""
import binascii

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id, quality_ranker, toxicity
from quarry.llm.common import documents, table

SF = "/root/testdata/sf0.01"


def crc(i):
    return binascii.crc32(str(i).encode())


def test_language_held_out(spark):
    got = language_id.op1_language_id(spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_language_cases(spark, docs):
    train = docs([(i, "the cat and the dog", "en", "s") for i in range(5)] + [(9, "der hund und die katze", "de", "s"), (10, None, "de", "s"),
                 (11, "nothing to learn", None, "s")])
    model = language_id.fit(train)
    assert model.langs == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "12 ½ -- _"), (4, "the"), (4, "the"), (5, "katzen hunde"), (6, "und the " * 100_000)]
    df = docs(rows).withColumn("score", F.lit("x")).withColumn("Lang_Pred", F.lit(1))
    got = sorted((r["doc_id"], r["lang_pred"], 0 <= r["score"] <= 1) for r in language_id.predict(df, model).collect())
    assert [g[:2] for g in got[:6]] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")] and all(g[2] for g in got)
    none = language_id.fit(docs([]))
    assert [r["lang_pred"] for r in language_id.predict(docs([(1, "word")]), none).collect()] == ["und"]
    assert language_id.predict(docs([]), model).count() == 0


def test_signs_are_no_letters(spark, docs):
    train = docs([(i, "² the ² ½", "en", "s") for i in range(40)] + [(100 + i, "der ¾ Ⅷ", "de", "s") for i in range(40)])
    model = language_id.fit(train)
    assert not any(map(str.isdigit, model.words))
    rows = docs([(1, "² ²"), (2, "² ½ ¾"), (3, "² the"), (4, "der ²")])
    assert {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language_id.predict(rows, model).collect()} == \
        {1: ("und", False), 2: ("und", False), 3: ("en", True), 4: ("de", True)}
    signs = language_id.Scorer(language_id.Model(["a", "b"], ["²"], np.array([[-1, -9]], np.float32), [], np.zeros((0, 2), np.float32)))
    assert signs.predict("² ²".encode()) == ("und", 0.0)


def test_language_score_equals_plain_sums(spark, docs):
    """The score against the method said plainly: words by their log frequency, unseen ones by their longest known n-grams."""
    train = docs([(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat the dog", "en"), ("der hund der tag", "de"), ("le chat", "fr")] * 3)])
    m = language_id.fit(train)
    words, grams = dict(zip(m.words, m.word_rows)), dict(zip(m.grams, m.gram_rows))

    def row(w):
        if w in words:
            return words[w]
        for n in range(4, 0, -1):
            have = [grams[g] for g in language_id.grams(w, n) if g in grams]
            if have:
                return np.mean(have, axis=0)
        return np.zeros(len(m.langs))

    texts = ["the hund", "cats und dogs", "xq", "tage chats lehr", "ß"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs(list(enumerate(texts))), m).collect()}
    for i, t in enumerate(texts):
        total = sum(row(w) for w in t.split())
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[i][0] == m.langs[int(p.argmax())] and abs(got[i][1] - p.max()) < 1e-5


def test_many_languages_keep_the_model_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_CELLS", 40)
    model = language_id.fit(docs([(i, f"word{i} common", f"l{i}", "s") for i in range(4)]))
    assert (len(model.words) + len(model.grams)) * 4 <= 40


def test_language_sample_of_copies(spark, docs, monkeypatch):
    rows = docs([(i, "one text in many copies", "en", "s") for i in range(20_000)] + [(30_000, "ein text", "de", "s")])
    chosen, langs = language_id.sample(rows, 1000, "text", "lang")
    n = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    assert langs == ["de", "en"] and n["de"] == 1 and 800 < n["en"] < 1200
    monkeypatch.setattr(language_id, "MAX_LANGS", 1)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(rows)


def test_words_come_before_grams(spark):
    langs, none = ["a", "b"], np.zeros((0, 2), np.float32)
    s = language_id.Scorer(language_id.Model(langs, ["xy"], np.array([[-1, -9]], np.float32), ["xy", "x", "z"],
                                             np.array([[-9, -1], [-8, -2], [-1, -5]], np.float32)))
    assert s.predict(b"xy")[0] == "a"            # the word itself
    assert s.predict(b"xyq")[0] == "b"           # its longest known n-gram
    assert s.predict(b"qz")[0] == "a"            # down to one letter
    assert language_id.Scorer(language_id.Model([], [], none[:, :0], [], none[:, :0])).predict(b"x") == ("und", 0.0)


def measured(spark, query, truth, parts, held):
    labels = table(spark, SF, "labels").groupBy("doc_id").agg(F.max(truth).alias("truth"))
    rows = query(spark, SF).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % parts == held) and 0 <= r["score"] <= 1 for r in rows)
    rows = [r for r in rows if r["held_out"]]
    pos, neg = ([r["score"] for r in rows if r["truth"] == y] for y in (1, 0))
    return np.mean([[a > b for b in neg] for a in pos]), rows


def test_toxicity_held_out(spark):
    auc, rows = measured(spark, toxicity.op6_toxicity, "toxic", 5, 0)
    assert auc > 0.8 and sum(r["predicted"] and not r["truth"] for r in rows) <= 3
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_held_out(spark):
    auc, rows = measured(spark, quality_ranker.op9_quality_ranker, "quality", 4, 2)
    assert auc > 0.95 and np.mean([r["predicted"] == r["truth"] for r in rows]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_cases(spark, docs, labels):
    bad = [(i, f"you idiot number w{i} scum x{i}") for i in range(40)]
    good = [(i, f"a fine day number w{i} sun x{i}") for i in range(40, 200)]
    some = labels([(i, 1, 1) for i in range(30)] + [(i, 1, 0) for i in range(40, 160)] + [(3, 1, 0), (None, 1, 1), (5, None, None)])
    model = toxicity.fit(docs(bad + good + [(900, None), (901, "")]), some)
    rows = [(1, "idiot scum you"), (2, "fine sun"), (3, None), (4, ""), (4, ""), (5, "IDIOT Scum you " + "day " * 50_000)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(rows).withColumn("score", F.lit("x")), model).collect()}
    assert got[1] > 0.5 and got[5] > 0.5 and max(got[2], got[3], got[4]) < 0.5
    kept = toxicity.remove_toxic(docs(bad + good).withColumn("score", F.lit("x")), some)
    assert kept.columns[-1] == "score" and {r[0] for r in kept.collect()} == set(range(40, 200))
    none = toxicity.fit(docs(good), labels([]))
    assert [r["score"] < 0.01 for r in toxicity.score(docs(rows), none).collect()] == [True] * 6
    assert toxicity.score(docs([]), model).count() == 0 and toxicity.fit(docs([]), labels([])).features == []


def test_risk_is_non_negative():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 6)) < 0.2).astype(np.uint8)
    x[:100, 0] = 1                                 # positives, and a third of the unlabelled like them
    x[100:200, 0], x[200:, 0] = 1, 0
    w, b = toxicity.fit_nnpu(x, np.arange(400) < 100, 1 / 3)
    assert w[0] + b > 0 > b


def test_quality_cases(spark, docs, labels):
    good = [(i, f"plain words of text number w{i} and more of them") for i in range(60)]
    bad = [(i, f"SPAM!!! {i} $$$ WIN### now*** SPAM!!! $$$") for i in range(60, 90)]
    some = labels([(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(60, 90)] + [(1, 1, 0), (None, 0, 0), (2, None, 0)])
    model = quality_ranker.fit(docs(good + bad), some)
    rows = [(1, "other plain words of text and so on with w7"), (2, "SPAM!!! $$$ BUY### 9***"), (3, None), (4, ""), (4, "")]
    got = {r["doc_id"]: r["score"] for r in quality_ranker.score(docs(rows).withColumn("Score", F.lit(1)), model).collect()}
    assert got[1] >= 0.7 > got[2] and got[3] == got[4]
    one = quality_ranker.fit(docs(good), labels([(i, 1, 0) for i in range(9)]))
    assert {round(r["score"], 6) for r in quality_ranker.score(docs(rows), one).collect()} == {0.7}
    assert quality_ranker.score(docs([]), model).count() == 0
    assert quality_ranker.fit(docs([]), labels([])).cut == 0.0


def test_cut_lies_in_the_gap():
    s = np.array([-5, -4.5, -4, 2, 2.1, 2.2, 2.3, 2.4, 2.5, 2.6])
    assert all(-4 < quality_ranker.quantile_cut(s, bad) < 2 for bad in (3, 4)) and quality_ranker.quantile_cut(s[:2], 1) == -4.75


def test_cut_over_all_rows_is_the_one_in_memory(spark):
    s = np.random.default_rng(1).normal(size=500)
    rows = spark.createDataFrame([(float(x),) for x in s], "strength double").repartition(7)
    assert all(abs(quality_ranker.widest_gap(rows, 500, bad) - quality_ranker.quantile_cut(s, bad)) < 1e-12 for bad in (1, 100, 499))


@pytest.mark.parametrize("n_bad, n_good", [(3, 50), (50, 3), (1, 1), (20, 20)])
def test_every_labelled_row_is_in_a_pair(spark, monkeypatch, n_bad, n_good):
    monkeypatch.setattr(quality_ranker, "PAIRS", 60)
    monkeypatch.setattr(quality_ranker, "PAIRS_OF_ROW", 5)
    rows = spark.createDataFrame([(i >= n_bad, bytes([i]), i) for i in range(n_bad + n_good)], "good boolean, features binary, n long")
    found = [(r["good"][0], r["bad"][0]) for r in quality_ranker.pairs_of(rows, n_bad, n_good).collect()]
    assert {b for _, b in found} == set(range(n_bad)) and {g for g, _ in found} == set(range(n_bad, n_bad + n_good))
    assert len(set(found)) == len(found) >= min(60, n_bad * n_good)


def test_quality_is_learned_from_all_labels(spark, docs, labels, monkeypatch):
    """No bound on a sample leaves rows out of the features' mean."""
    monkeypatch.setattr(quality_ranker, "MAX_SAMPLE", 50, raising=False)
    rows = [(i, f"{i} !!! $$$") for i in range(300)]
    some = labels([(i, int(i == 7), 0) for i in range(300)])
    model = quality_ranker.fit(docs(rows), some)
    x = np.array([quality_ranker.features(t.encode()) for _, t in rows])
    assert np.allclose(model.mean, x.mean(axis=0))


def test_removal_with_clashing_names(spark):
    docs = documents(spark, SF).withColumn("score", F.lit("own")).withColumn("__score", F.lit(3)).withColumn("score_", F.lit(4))
    left = toxicity.remove_toxic(docs, table(spark, SF, "labels"))
    assert left.columns == docs.columns
    assert left.select("score", "__score", "score_").distinct().collect() == [("own", 3, 4)]
    assert left.count() == toxicity.remove_toxic(documents(spark, SF), table(spark, SF, "labels")).count()
