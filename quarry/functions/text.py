"""Source-text normalisation as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = " \t"


def expand_tabs(source: Column | str = "source") -> Column:
    """Every tab becomes four spaces (the extractor's cleaning step)."""
    c = F.col(source) if isinstance(source, str) else source
    return F.replace(c, F.lit("\t"), F.lit("    "))


def dedent_text(source: Column | str = "source") -> Column:
    """Remove the common leading whitespace of all non-blank lines.

    Equals ``textwrap.dedent`` on tab-free text (apply ``expand_tabs`` first):
    whitespace-only lines become empty and the smallest indent of the other
    lines is cut from each of them.  Works on whole texts of any length.
    """
    c = F.col(source) if isinstance(source, str) else source
    ws = F.lit(_WS)
    lines = F.split(c, "\n", -1)
    emptied = F.transform(lines, lambda l: F.when(F.trim(l, ws) == "", F.lit("")).otherwise(l))
    indents = F.filter(
        F.transform(emptied, lambda l: F.when(l == "", F.lit(None)).otherwise(
            F.length(l) - F.length(F.ltrim(l, ws)))),
        lambda n: n.isNotNull(),
    )
    cut = F.coalesce(F.array_min(indents), F.lit(0))
    # The cut is handed to the lambda as a second array (evaluated once per text); referring to it
    # inside the lambda would recompute it for every line and make long texts quadratic.
    cuts = F.array_repeat(cut, F.size(emptied))
    dedented = F.zip_with(emptied, cuts, lambda l, c: F.when(l == "", l).otherwise(F.substring(l, c + 1, F.length(l))))
    return F.array_join(dedented, "\n")
