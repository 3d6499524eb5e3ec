"""Spellings that are one licence, and defined cases."""
import re
import textwrap

from quarry.llm import license_scan as ls

MIT = dict((k, v) for k, v in ls.KNOWN if v.startswith("MIT License"))["MIT"]


def run(docs, rows):
    out = ls.scan_licenses(docs(rows)).collect()
    return sorted(((r["id"], r["whole"], r["n_lines"], ",".join(r["licenses"])) for r in out), key=repr)


def test_forms(docs):
    rows = [(1, "RELEASED under the M.I.T license"), (2, "released UNDER the mit Licence!!"), (3, "text\n* Licensed under CC BY-NC 4.0. *\nmore"),
            (4, "Licensed under the Apache Licence, v2.0"), (5, "Copyright (c) 2020 Someone\n\n" + MIT.upper().replace("\n", "  \n")),
            (6, "see: Released under the MIT License."), (7, None), (8, ""), (9, " \n"), (10, "Released under the MIT License.\n" * 3),
            (11, "x\nReleased under the MIT License."), (11, "x\nReleased under the MIT License."), (None, "(C) me\nLicensed under CC BY 4.0"),
            (12, "copyrighted words\nLicensed under CC BY 4.0")]
    got = run(docs, rows)
    assert got == sorted([
        (1, None, 0, ""), (2, "MIT", 1, "MIT"), (3, None, 1, "CC-BY-NC-4.0"), (4, "Apache-2.0", 1, "Apache-2.0"), (5, "MIT", 0, "MIT"),
        (6, None, 0, ""), (7, None, 0, ""), (8, None, 0, ""), (9, None, 0, ""), (10, None, 3, "MIT"), (11, None, 1, "MIT"),
        (11, None, 1, "MIT"), (None, "CC-BY-4.0", 1, "CC-BY-4.0"), (12, None, 1, "CC-BY-4.0")], key=repr)
    assert run(docs, []) == []


def test_own_table_of_licences(docs):
    out = ls.scan_licenses(docs([(1, "be NICE.")]), [("NICE", "Be nice!")]).collect()
    assert [(r["whole"], r["n_lines"]) for r in out] == [("NICE", 1)]


def test_full_texts(docs):
    texts = {f.name[:-4]: f.read_text("utf-8") for f in ls.files("quarry.llm").joinpath("licenses").iterdir()}
    assert {"BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "Apache-2.0"} <= set(texts)
    names = sorted(texts)
    rows = [(i, texts[n]) for i, n in enumerate(names)]
    rows += [(100, "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + texts["BSD-3-Clause"]),
             (101, "The MIT License (MIT)\n\nCopyright (c) 2020 X\n" + MIT.split("\n", 1)[1]),
             (102, texts["BSD-2-Clause"] + "\nand more words")]
    got = {r[0]: r[1] for r in run(docs, rows)}
    assert got == dict(enumerate(names)) | {100: "BSD-3-Clause", 101: "MIT", 102: None}


def refilled(text, width):
    """Paragraphs wrapped anew; lines that state a holder stay lines of their own."""
    out = []
    for part in text.split("\n\n"):
        held = []
        for line in [*part.split("\n"), None]:
            holder = line is not None and re.match(r"\s*copyright\s*(\(c\)|©|\d{4}|\[yyyy\]|<year>)", line, re.I)
            if line is None or holder:
                if held:
                    out.append(textwrap.fill(" ".join(" ".join(held).split()), width))
                    held = []
                if holder:
                    out.append(line)
            else:
                held.append(line)
        out.append("")
    return "\n".join(out)


def test_full_texts_wrapped_at_other_widths(docs):
    texts = {f.name[:-4]: f.read_text("utf-8") for f in ls.files("quarry.llm").joinpath("licenses").iterdir()}
    rows, want = [], {}
    for name, body in sorted(texts.items()):
        for width in (60, 67, 72, 79, 85, 100):
            want[len(rows)] = name
            rows.append((len(rows), refilled(body, width)))
    got = {r[0]: r[1] for r in run(docs, rows)}
    assert {i: (want[i], got[i]) for i in want if got[i] != want[i]} == {}


def test_very_long_text(docs):
    long = "x y z " * 60_000
    assert run(docs, [(1, long + "\nReleased under the MIT License.\n" + long)]) == [(1, None, 1, "MIT")]
