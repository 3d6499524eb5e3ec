import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, base, shared):
    """Every node of the trie by following each rebuilt conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    built = {c: own.get(base(c), [])[:shared(c)] + own[c][shared(c):] for c in own}
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def under(p):
        todo = [p]
        while todo:
            q = todo.pop()
            yield q
            todo += kids.get(q, [])

    out = set()
    for p, members in nodes.items():
        below = list(under(p))
        ends = ",".join(map(str, sorted(c for c in members if built[c] == list(p))))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])),
                 sum(q not in kids for q in below), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q),
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def shared_of(c):
    return zlib.crc32(str(c).encode()) % 6


def trie(spark, rows, small, schema=SCHEMA):
    c = F.col("conv_id")
    df = pt.prefix_trie(spark.createDataFrame(rows, schema), c - c % 100,
                        (F.crc32(c.cast("string").cast("binary")) % 6).cast("long"), small)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def case():
    rng = random.Random(5)
    rows = []
    for c in range(95, 215):                       # 95 to 99 have no base conversation
        for t in range(rng.choice([0, 1, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é€"])))
    rows += [(300, t, "user", f"turn {t}") for t in range(40)]
    rows += [(c, t, "user", f"turn {t}") for c in (301, 302, 303) for t in range(40)]         # copies
    rows += [(400, None, None, None), (400, 1, None, "x"), (400, 1, "user", "x"), (400, 1, "user", "x"), (None, 0, "user", "lost")]
    rows += [(-7, 0, "user", "negative id"), (-7, 1, "user", "again")]
    return rows


@pytest.mark.parametrize("small", [3, 64, pt.SMALL])
def test_equals_brute_force(spark, small):
    rows = case()
    want = brute(rows, lambda c: c - int(c - 100 * int(c / 100)), shared_of)
    assert trie(spark, rows, small) == want


def test_long_conversation_is_summed_in_blocks(spark):
    rows = [(c, t, "user", str(t % 7)) for c in (500, 600) for t in range(2 * pt.BLOCK + 5)]
    want = brute(rows, lambda c: c - c % 100, shared_of) if shared_of(500) == shared_of(600) else None
    got = trie(spark, rows, 300)
    deepest = max(got, key=lambda r: r[1])
    assert deepest[1] == 2 * pt.BLOCK + 5 and deepest[3] == 2      # equal turns: one path whatever is shared
    root = next(r for r in got if r[1] == 0)
    assert root[5:7] == (1, 2 * pt.BLOCK + 5) and (want is None or got == want)


def test_empty_table_and_other_columns(spark):
    assert trie(spark, [], 10) == set()
    rows = [(1, 0, "user", "hi", 5, "x"), (2, 0, "user", "hi", 6, "y")]
    got = trie(spark, rows, 10, SCHEMA + ", key int, depth string")
    assert got == brute([r[:4] for r in rows], lambda c: c - c % 100, shared_of)


def test_split_small_equals_sums_over_subtrees():
    rng = random.Random(1)
    for n in (1, 2, 9, 200):
        parent = [-1] + [rng.randrange(max(0, v - rng.choice([1, 3, n])), v) for v in range(1, n)]
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        order = sorted(range(n), key=lambda v: depth[v])
        at = {v: i for i, v in enumerate(order)}
        parent = [at[parent[v]] if parent[v] >= 0 else -1 for v in order]
        weight, value = [rng.randint(1, 5) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        mass, want = list(weight), list(value)
        for v in range(n - 1, 0, -1):
            mass[parent[v]] += mass[v]
            want[parent[v]] += want[v]
        assert pt.split_small(parent, mass, [value]) == [want]
