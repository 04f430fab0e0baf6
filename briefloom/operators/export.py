"""Records as JSON and Markdown, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["issue", "summary", "businessGoal", "architecture", "decisions", "constraints", "acceptanceCriteria", "risks", "todos", "dependencies", "relatedIssues", "ignoredContent", "confidence", "compressionRatio"]
#: Headings of the Markdown brief in order.
SECTIONS = [("Architecture", "architecture"), ("Decisions", "decisions"), ("Constraints", "constraints"), ("Acceptance Criteria", "acceptanceCriteria"), ("Risks", "risks"), ("TODOs", "todos"), ("Dependencies", "dependencies"), ("Related Issues", "relatedIssues")]


def to_json(pretty: bool = True) -> Column:
    return F.to_json(F.struct(*FIELDS), {"pretty": str(pretty).lower()})


def to_markdown() -> Column:
    """Heading, summary, goal, the lists that hold something, and the figures; what was ignored isn't repeated."""
    def section(title: str, field: str) -> Column:
        bullets = F.array_join(F.transform(field, lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.when(F.size(field) > 0, F.concat(F.lit(f"## {title}\n"), bullets, F.lit("\n\n"))).otherwise("")

    filled = lambda c, text: F.when(F.coalesce(F.col(c), F.lit("")).rlike(r"\S"), text).otherwise("")
    percent = F.floor(F.col("compressionRatio") * 100 + 0.5).cast("int").cast("string")
    return F.concat(
        F.lit("# "), "issue", F.lit("\n\n"),
        filled("summary", F.concat("summary", F.lit("\n\n"))),
        filled("businessGoal", F.concat(F.lit("**Business goal:** "), "businessGoal", F.lit("\n\n"))),
        *[section(t, f) for t, f in SECTIONS],
        F.lit("---\nconfidence: "), F.col("confidence").cast("string"), F.lit(" | compression: "), percent, F.lit("%\n"),
    )


def rendered(records: DataFrame, form: str) -> DataFrame:
    """``doc, level, text`` in ``markdown``, ``md`` or ``json``, in any case."""
    kind = form.lower()
    if kind not in ("markdown", "md", "json"):
        raise ValueError(f"unknown format: {form}")
    return records.select("doc", "level", (to_json() if kind == "json" else to_markdown()).alias("text"))


def write(records: DataFrame, path: str, form: str, mode: str = "errorifexists") -> None:
    """The records as JSON lines, or as a table of Markdown texts."""
    if form.lower() == "json":
        records.select(F.to_json(F.struct(*FIELDS)).alias("value")).write.mode(mode).text(path)
    else:
        rendered(records, form).write.mode(mode).parquet(path)
