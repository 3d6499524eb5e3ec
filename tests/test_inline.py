"""Calls in script text end at their own parenthesis."""

from quarry.functions.inline import inline_calls

CASES = {
    "track(1)": ["1"],
    "track(a(b(c(1))))": ["a(b(c(1)))"],
    'track(")")': ['")"'],
    "track(')', \"(\", `)`)": ["')', \"(\", `)`"],
    'track("a\\")b")': ['"a\\")b"'],
    "track (1); track\n(2)": ["1", "2"],
    "track(track(2), track(track(3)))": ["2", "3", "track(2), track(track(3))", "track(3)"],
    "f(track(1), 2)": ["1"],
    "mytrack(1); track2(2); $track(3); o.track(4)": ["4"],
    "track(1": [],
    "track(1 // )\n, 2)": ["1 // )\n, 2"],
    "track(/* ) */ 1)": ["/* ) */ 1"],
    "// don't\ntrack(5)": ["5"],
    ") track(6) (": ["6"],
    "track()": [""],
    "track": [],
    "": [],
    "var s = 'it'; track(s / 2)": ["s / 2"],
    "x" * 100_000 + "(" * 3000 + "track('é 🙂')" + ")" * 3000: ["'é 🙂'"],
}


def test_calls_and_their_arguments(spark):
    rows = [(i, s, 7) for i, s in enumerate(CASES)] + [(-1, None, 7)]
    got = {i: [] for i, _, _ in rows}
    for r in inline_calls(spark.createDataFrame(rows, "page_id long, body string, args int"), "body", "track").collect():
        got[r.page_id].append(r.args)
    assert {s: sorted(got[i]) for i, s in enumerate(CASES)} == {s: sorted(v) for s, v in CASES.items()} and got[-1] == []


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "track(1)"), (1, "track(1)")], "page_id long, body string")
    assert [r.args for r in inline_calls(df, "body", "track").collect()] == ["1", "1"]
    assert inline_calls(df.limit(0), "body", "track").count() == 0
