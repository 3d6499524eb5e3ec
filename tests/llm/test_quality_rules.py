"""Base statistics against a plain version; the estimate against numpy; planted outliers."""
import random
import re

import numpy as np

from quarry.llm import quality_rules as qr
from quarry.llm.common import documents

SPACE = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    wins = {}
    for i in range(len(ws) - 7):
        wins.setdefault(tuple(ws[i:i + 8]), []).append(i)
    again = {p for at in wins.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    n = len(ws)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
            n < 20 or 100 * len(again) > 30 * n)


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in qr.op3_quality_rules(spark, sf).collect()}
    assert got == {r["doc_id"]: base(r["text"]) for r in documents(spark, sf).collect()}


def test_base_cases(spark, docs):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a", "x " * 9, "x " * 8, "a b\n \na b\na b ", "é ñ 🙂 # <|>", "\x0b\x0c\r", "w " * 30_000,
             "a b c d e f g h 1 a b c d e f g h 2 a b c d e f g h"]
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 40))) + rng.choice(["", "\n"]) for _ in range(60)]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s") for i, t in enumerate(texts)]
    got = qr.judge(docs(rows + rows[:1])).collect()
    assert len(got) == len(rows) + 1
    assert {r["id"]: tuple(r[c] for c in COLS) for r in got} == {i: base(t) for i, t, *_ in rows}
    assert all(not r["kept"] for r in got if r["base_failed"]) and qr.judge(docs([])).count() == 0


def numpy_mcd(x):
    """The same estimate in numpy, from both starts."""
    floor, best = np.diag(qr.FLOOR), None
    med = np.array([np.sort(c)[int(np.ceil(len(c) / 2)) - 1] for c in x.T])
    mad = np.array([np.sort(c)[int(np.ceil(len(c) / 2)) - 1] for c in np.abs(x - med).T]) * 1.4826
    s = np.sqrt(mad ** 2 + qr.FLOOR)
    z = (x - med) / s
    for cov in (np.diag(s ** 2), (z.T @ (z / np.maximum((z ** 2).sum(1), 1e-9)[:, None])) / len(x) * 5 * np.outer(s, s) + floor):
        m = med
        for _ in range(qr.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
            core = x[d <= np.sort(d)[int(np.ceil(0.75 * len(d))) - 1]]
            m, cov = core.mean(0), np.cov(core.T, bias=True) * qr.CONSISTENT + floor
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), m, cov
    return np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])


def planted(rng, n):
    texts = [" ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(int(rng.lognormvariate(5, 0.5)) + 25))
             for _ in range(n)]
    return texts, [" ".join(w + "###" for w in t.split()) for t in texts[:n // 10]]


def test_estimate_and_outliers(spark, docs):
    good, bad = planted(random.Random(1), 300)
    rows = [(i, t, "en", "s") for i, t in enumerate(good + bad)]
    got = sorted(qr.judge(docs(rows)).collect())
    x = np.array([[np.log1p(n), np.log1p(c / n), np.log1p(1000 * s / c), np.log1p(1000 * d / n), np.log1p(100 * r / n)]
                  for n, c, s, d, r, _ in (base(t) for t in good + bad)])
    assert np.allclose([r["distance"] for r in got], numpy_mcd(x), rtol=1e-6)
    assert all(r["kept"] for r in got[:300]) and not any(r["kept"] for r in got[300:])


def test_groups_have_their_own_estimates(spark, docs):
    good, bad = planted(random.Random(2), 150)
    rows = [(i, t, "en", "clean") for i, t in enumerate(good)]
    rows += [(1000 + i, " ".join(w + "###" for w in t.split()), "en", "marked") for i, t in enumerate(good)]
    rows += [(2000 + i, t, "fr", f"s{i}") for i, t in enumerate(good[:20])]       # pooled over all rows
    rows += [(3000 + i, "same words again and " * 1 + " ".join(f"v{j}" for j in range(30)), "es", "flat") for i in range(120)]
    assert all(r["kept"] for r in qr.judge(docs(rows)).collect())


def test_main_path_is_native(spark):
    plan = qr.op3_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_language_is_no_pool(spark, docs):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["alpha", "be", "gamma7", "delta"]) + str(rng.randrange(99)) for _ in range(rng.randint(20, 60)))
    rows = [(i, text(), "", f"s{i % 3}") for i in range(260)] + [(1000 + i, text(), "xx", "t") for i in range(130)]
    same = [(i, t, "en" if lang == "" else lang, s) for i, t, lang, s in rows]
    got, want = ({r["id"]: (r["distance"], r["kept"]) for r in qr.judge(docs(x)).collect()} for x in (rows, same))
    assert got == want
