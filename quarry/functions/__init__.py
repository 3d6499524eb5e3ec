"""Column-expression helpers (all JVM-side, codegen-friendly)."""

from quarry.functions.numeric import transformed_reading_expr, round_double
from quarry.functions.text import expand_tabs, dedent_text

__all__ = ["transformed_reading_expr", "round_double", "expand_tabs", "dedent_text"]
