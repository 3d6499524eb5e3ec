"""Calls in script text, each to its own closing parenthesis, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What may hold a parenthesis that closes nothing (comments, strings of the three quotes), a parenthesis, or other text.
TOKEN = (r"""//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\])*+`"""
         r"""|[()]|[A-Za-z_$][A-Za-z0-9_$]*+|[^()"'`/A-Za-z_$]++|["'`/]""")


def inline_calls(texts: DataFrame, text: str, function: str) -> DataFrame:
    """``texts`` with one row per call of ``function`` in ``text``: ``args``, the text between its parentheses.

    A text is cut into tokens; a call's closing parenthesis is the next
    parenthesis at its own depth, whatever depth its arguments have and whatever
    strings and comments hold.  So nested calls are each found, and a call that is
    never closed is none.  Each step is linear: tokens are rows, depths a running
    sum per text, partners neighbours within one depth.  Texts without the name
    are left out before they are cut; a null text has no call.
    """
    kept = texts.filter(F.col(text).contains(function)).withColumn("_id", F.monotonically_increasing_id())
    tokens = kept.select("_id", F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s){TOKEN}"), F.lit(0))).alias("i", "token"))
    in_text = Window.partitionBy("_id").orderBy("i")
    opens, closes = F.col("token") == "(", F.col("token") == ")"
    before = in_text.rowsBetween(Window.unboundedPreceding, -1)
    tokens = tokens.withColumn("at", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0))) \
        .withColumn("up", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(in_text)) \
        .withColumn("prev", F.lag("token").over(in_text)).withColumn("prev2", F.lag("token", 2).over(in_text))
    # blanks between the name and its parenthesis are a token of their own; a name behind a letter or $ is another name
    named = opens & ((F.col("prev") == function) | ((F.trim(F.translate("prev", "\n\t\r", "   ")) == "") & (F.col("prev2") == function)))
    level = F.when(opens, F.col("up")).otherwise(F.col("up") + 1)
    partner = Window.partitionBy("_id", "level").orderBy("i")
    pairs = tokens.filter(opens | closes).withColumn("named", F.coalesce(named, F.lit(False))).withColumn("level", level) \
        .withColumn("end", F.lead(F.when(closes, F.col("at"))).over(partner)).filter("named AND end IS NOT NULL")
    calls = pairs.select("_id", F.col("at").alias("_from"), F.col("end").alias("_to"))
    found = F.substring(F.col(text), F.col("_from") + 2, F.col("_to") - F.col("_from") - 1)
    return kept.join(calls, "_id").select(*[c for c in texts.columns if c != "args"], found.alias("args"))
