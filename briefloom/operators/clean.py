"""Cleaning and noise filtering of source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def cleaned(df: DataFrame, col: str) -> DataFrame:
    """``df`` with the column cleaned: line ends and blanks, HTML, mail quotations, signatures, blank lines.  Null stays null."""
    c = F.col(col)
    # A column for each step: a look at what it changes costs less than its pattern.
    for cue, step in [
        (c.contains("\r"), T.line_feeds),
        ((F.octet_length(c) > F.char_length(c)) & c.rlike(T.EXOTIC), T.plain_blanks),
        (c.contains("<") & T.looks_like_html(c), T.html_to_text),
        (T.quotes_mail(c), T.cut_mail_quote),
        (c.contains(">"), T.drop_quoted_lines),
        (c.contains("--"), T.cut_signature),
        (T.blank_line_ends(c) | c.contains("\n\n\n"), T.squeeze),
    ]:
        df = df.withColumn(col, F.when(cue, step(c)).otherwise(c))
    return df.withColumn(col, T.strip(c))


def raw_sources(heads: DataFrame, comments: DataFrame) -> DataFrame:
    """``doc, no, origin, author, bot, text, reason``: descriptions (no 0) and comments (from 1) as they are, without a reason
    to leave any out.  Null texts, authors and flags count as empty and false."""
    none = F.lit("")
    rows = heads.select("doc", F.lit(0).cast("long").alias("no"), none.alias("author"), F.lit(False).alias("bot"), F.coalesce("description", none).alias("text")).union(
        comments.select("doc", F.col("no").cast("long"), F.coalesce("author", none), F.coalesce("bot", F.lit(False)), F.coalesce("body", none))
    )
    origin = F.when(F.col("no") == 0, "description").otherwise(F.concat(F.lit("comment:"), F.col("no").cast("string")))
    return rows.select("doc", "no", origin.alias("origin"), "author", "bot", "text", F.lit(None).cast("string").alias("reason"))


def with_reason(rows: DataFrame) -> DataFrame:
    """Sources with the reason why a comment is left out, if there is one."""
    return rows.withColumn("reason", F.when(F.col("no") > 0, T.noise_reason(F.col("text"), F.col("author"), F.col("bot"))))


def noise_report(rows: DataFrame) -> DataFrame:
    """``doc, n, text``: what the filter says it left out, by its place in the brief."""
    logs = rows.filter("reason = 'log dump'").select("doc", F.array(F.lit(1).cast("long"), "no").alias("n"), F.concat(F.lit("Log/stack-trace dump removed from "), "origin", F.lit(" ("), T.utf16_length(F.col("text")).cast("string"), F.lit(" chars)")).alias("text"))
    said = {"bot message": (2, " bot message(s) removed"), "greeting/acknowledgement": (3, " greeting/acknowledgement comment(s) removed"), "emoji/symbol spam": (4, " emoji-only comment(s) removed")}
    counts = rows.groupBy("doc", "reason").count()
    parts = [counts.filter(F.col("reason") == r).select("doc", F.array(F.lit(k).cast("long")).alias("n"), F.concat(F.col("count").cast("string"), F.lit(s)).alias("text")) for r, (k, s) in said.items()]
    for p in parts:
        logs = logs.union(p)
    return logs
