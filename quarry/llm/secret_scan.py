"""Secret scan with multipart credential linking.

Strong spans (assignments, access identifiers, long hexadecimal runs) are always
reported.  Weak parts (identifiers, opaque tokens, endpoints) are reported only
where a complementary part lies in the same scope, however far apart: an
identifier or endpoint needs a secret, an opaque token needs an identifier or an
endpoint.  A scope is a block of lines without a blank line.  The parts are
intervals sorted by start; one sweep in each direction joins each with the
nearest complementary one, so no pairs are listed.

Spans are ``kind:start:end`` in code points, end exclusive.  Defined cases: a
null text is empty and has no spans; repeated rows are scanned each; an empty
table gives an empty table; extra columns are carried, a column named like an
output is replaced.  Letters of keywords match in either (ASCII) case only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import documents, prepared, with_text_columns

# The strong kinds in their order, with pattern and least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
#: What is masked unless told otherwise.
SECRET_KINDS = ("assign", "access", "hex", "opaque")

# Weak parts.
IDENT = re.compile(r"""(?<![A-Za-z])(?:client_?id|user_?(?:name|id)?|login|account_?(?:id|name)?|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,30}://[^\s"'<>]+""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")
MIN_ENTROPY = 3.5

# Which bytes a text must have for a pattern to be tried.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_BYTES = re.compile(rb"[0-9a-f]{24}")
IDENT_BYTES = re.compile(rb"""(?:id|user|name|login|account)["']?\x20*[:=]""", re.I)

ROLE = {"access": "id", "ident": "id", "assign": "secret", "hex": "secret", "opaque": "secret", "endpoint": "place"}
PARTNERS = {"ident": {"secret"}, "endpoint": {"secret"}, "opaque": {"id", "place"}}


def opaque_enough(value: str) -> bool:
    """Three character classes and an entropy that words and numbers do not have."""
    if sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value)))) < 3:
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= MIN_ENTROPY


def strong_parts(data: bytes, text: str) -> list[tuple[int, int, str]]:
    out = []
    low = data.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    if HEX_BYTES.search(data):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda p: (p[0], KINDS.index(p[2])))


def weak_parts(data: bytes, text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that do not overlap a strong one, an earlier kind or each other."""
    found = [(m.start(), m.end(), "ident") for m in IDENT.finditer(text)] if IDENT_BYTES.search(data) else []
    found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if b"://" in data else []
    if found or any(k == "access" for _, _, k in strong):
        found += [(m.start(), m.end(), "opaque") for m in OPAQUE.finditer(text) if opaque_enough(m[0])]
    out, end, rest = [], -1, iter(strong + [(1 << 62, 1 << 62, "")])
    ahead = next(rest)
    taken = -1                                    # end of the strong parts that begin at or before here
    for s, e, kind in sorted(found):
        while ahead[0] <= s:
            taken = max(taken, ahead[1])
            ahead = next(rest)
        if s >= max(end, taken) and e <= ahead[0]:
            out.append((s, e, kind))
            end = e
    return out


def linked(parts: list[tuple[int, int, str]], breaks: list[int]) -> list[tuple[int, int, str]]:
    """The weak ones among ``parts`` (sorted) that have a complementary part anywhere in their scope."""
    kept = set()
    for forward in (True, False):
        seen: set[str] = set()
        cuts = iter(breaks if forward else reversed(breaks))
        cut = next(cuts, None)
        for s, e, kind in parts if forward else reversed(parts):
            while cut is not None and (cut <= s if forward else cut >= e):
                seen, cut = set(), next(cuts, None)
            if seen & PARTNERS.get(kind, set()):
                kept.add((s, e, kind))
            seen.add(ROLE[kind])
    return [p for p in parts if p in kept]


def find_spans(data: bytes | None) -> list[tuple[int, int, str]]:
    """All reported spans (start, end, kind) of a text, by start, then by kind in order."""
    data = data or b""
    text = data.decode("utf-8", "replace")
    strong = strong_parts(data, text)
    weak = weak_parts(data, text, strong)
    if weak:
        breaks = [m.start() for m in BLANK.finditer(text)]
        weak = linked(sorted(strong + weak), breaks)
    return sorted(strong + weak, key=lambda p: (p[0], KINDS.index(p[2])))


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "spans", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end), by start, then kind."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])

    def make():
        return lambda texts: [[[{"kind": k, "start": s, "end": e} for s, e, k in find_spans(t)] for t in texts]]

    return with_text_columns(docs, [T.StructField(out, T.ArrayType(span))], make, text, drop_text)


def redact(data: bytes | None, kinds: tuple[str, ...] = SECRET_KINDS, mark: str = "[SECRET]") -> str | None:
    """The text with each maximal run of overlapping spans of ``kinds`` replaced by ``mark``."""
    spans = [p for p in find_spans(data) if p[2] in kinds]
    if data is None or not spans:
        return None if data is None else data.decode("utf-8", "replace")
    text, out, at = data.decode("utf-8", "replace"), [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = SECRET_KINDS) -> DataFrame:
    """``docs`` with the reported spans of ``kinds`` masked; texts without one stay as they are.

    Identifiers and endpoints are no secrets: they are masked only if ``kinds`` has them.
    """
    def make():
        return lambda texts: [[redact(t, kinds) for t in texts]]

    order = docs.columns
    return with_text_columns(docs, [T.StructField(text, T.StringType())], make, text).select(*order)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def op2_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepared(spark), sf_dir).select("doc_id", "text")
    strong = F.filter("spans", lambda p: p["kind"].isin("assign", "access", "hex"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan_secrets(docs, drop_text=True).select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(joined(strong).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


QUERIES = {"op2_secret_spans": op2_secret_spans}
