"""Against a plain reading of the rules, and small cases of linking."""
import hashlib
import random
import re

from quarry.llm import secret_scan as ss
from quarry.llm.common import documents

KEY = "AKIA" + "ABCDEFGH12345678"
OPAQUE = "aB3dE6gH9jK2mN5pQ8sT1vW4"


def base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for n, (kind, least, p) in enumerate((("access", 20, "AKIA[A-Z0-9]+"), ("hex", 24, "[0-9a-f]+")), 1):
        found += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[0]) >= least]
    spans = [s for _, _, s in sorted(found)]
    return (*(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")),
            hashlib.sha256(",".join(spans).encode()).hexdigest())


def kinds(text):
    return [k for _, _, k in ss.find_spans(text.encode())]


def test_base_spans_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: tuple(r[1:5]) for r in ss.op2_secret_spans(spark, sf).collect()}
    rows = documents(spark, sf).select("doc_id", "text").collect()
    assert got == {i: base(t) for i, t in rows} and any(v[0] for v in got.values())


def test_base_edge_cases(spark, on_disk):
    rows = [(1, None), (2, ""), (3, f'é Token: "abcdef" {KEY} ' + "a1" * 12), (3, "token=abcde"), (4, "token=abcdef"),
            (4, "token=abcdef"), (5, "API_KEY = 'x.y-z/1' apikey:longvalue secret\n=abcdefg"), (6, "0" * 30 + "z" + "f" * 23),
            (7, "AKIA" * 40), (8, "tokentoken=token=abcdef"), (9, "ſecret=abcdefgh")]
    got = sorted(tuple(r[:5]) for r in ss.op2_secret_spans(spark, on_disk(rows)).collect())
    assert got == sorted((i, *base(t or "")) for i, t in rows)


def test_weak_parts_need_a_partner():
    assert kinds("client_id = acme-17 and words") == []
    assert kinds(f"see https://db.example.com/x {OPAQUE}") == ["endpoint", "opaque"]
    assert kinds("see https://db.example.com/x") == []
    assert kinds(f"just {OPAQUE}") == []
    assert kinds(f"client_id = acme-17\nhost {OPAQUE}") == ["ident", "opaque"]
    assert kinds(f"client_id = acme-17\n\nhost {OPAQUE}") == []          # another scope
    assert kinds(f"client_id = acme-17 {'x ' * 300}{OPAQUE}") == ["ident", "opaque"]      # however far
    assert kinds(f"{KEY} and {OPAQUE}") == ["access", "opaque"]
    assert kinds("user=bob password=hunter22 https://h/") == ["ident", "assign", "endpoint"]
    assert kinds("user=bob https://h/") == []                            # two places, no secret
    assert kinds(f"{OPAQUE}\nuser=bob") == ["opaque", "ident"]           # partner behind


def test_many_parts_are_linear():
    text = "user=bob " * 20000 + OPAQUE
    assert kinds(text).count("ident") == 20000


def test_redact(spark, docs):
    rows = [(1, f"é token = abcdef12 end {KEY}"), (2, None), (3, "clean")]
    out = ss.redact_secrets(docs(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r[0]: r[1] for r in out.collect()} == {1: "é [SECRET] end [SECRET]", 2: None, 3: "clean"}
    assert ss.redact_secrets(docs([])).count() == 0


def test_links_across_the_whole_scope(spark, on_disk):
    def block(n, sep):
        line = "word_word " * 4 + "words"
        return f"client_id = acme-17\nendpoint https://db.example.com/x\n{(line + sep) * (n // 46 + 1)}{OPAQUE}\nend"

    rows = [(1, block(1000, "\n")), (2, block(10000, "\n")), (3, block(10000, " ")), (4, block(1000, "\n").replace(OPAQUE, "\n" + OPAQUE))]
    got = {r["doc_id"]: [p.split(":")[0] for p in r["spans"].split(",") if p] for r in ss.op2_secret_spans(spark, on_disk(rows)).collect()}
    assert got == {1: ["ident", "endpoint", "opaque"], 2: ["ident", "endpoint", "opaque"], 3: ["ident", "endpoint", "opaque"], 4: []}
    for i, text in rows:
        masked = ss.redact(text.encode())
        assert (OPAQUE in masked, masked.count("[SECRET]")) == ((True, 0) if i == 4 else (False, 1))
        assert "acme-17" in masked and "https://db.example.com/x" in masked      # no secrets


def test_linking_equals_all_pairs():
    rng = random.Random(2)
    pieces = ["user=bob", "client_id: acme", OPAQUE, "https://h/x", "password=hunter22", KEY, "a1" * 12, "word", "\n", "\n\n", "\n \t\n"]
    roles = {"access": "id", "ident": "id", "assign": "secret", "hex": "secret", "opaque": "secret", "endpoint": "place"}
    needs = {"ident": {"secret"}, "endpoint": {"secret"}, "opaque": {"id", "place"}}
    for _ in range(300):
        text = " ".join(rng.choices(pieces, k=rng.randint(1, 14)))
        strong = ss.strong_parts(text.encode(), text)
        weak = ss.weak_parts(text.encode(), text, strong)
        breaks = [m.start() for m in ss.BLANK.finditer(text)]
        scope = lambda p: sum(b <= p[0] for b in breaks)
        want = [w for w in weak if any(p != w and scope(p) == scope(w) and roles[p[2]] in needs[w[2]] for p in strong + weak)]
        assert sorted(set(ss.find_spans(text.encode())) - set(strong)) == sorted(want), repr(text)


def test_masks_what_is_asked_for(spark, docs):
    text = f"user=bob {OPAQUE}"
    assert ss.redact(text.encode()) == "user=bob [SECRET]" and ss.redact(text.encode(), ss.KINDS) == "[SECRET] [SECRET]"
