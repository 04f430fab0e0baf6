"""Command line: tickets in, briefs out.

    python -m briefloom -i ticket.json -s jira -l tiny -f markdown -o brief.md
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import vocab
from .operators.export import rendered, write
from .operators.store import scratch, stored
from .plans.briefs import Briefs
from .sources.tickets import read_tickets


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="briefloom", description="Turns ticket exports into compact briefs.")
    p.add_argument("-i", "--input", required=True, help="a ticket export as JSON, or a text with --source text; a folder or pattern for many")
    p.add_argument("-s", "--source", default="jira", help="jira or text (default: jira)")
    p.add_argument("-l", "--level", default="full", help="tiny, small, medium or full (default: full)")
    p.add_argument("-f", "--format", default="json", help="json or markdown (default: json)")
    p.add_argument("-o", "--output", help="file for one brief, folder for many (default: standard output, one brief only)")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if a brief was made, 1 if the input holds no ticket, 2 for wrong arguments."""
    parser = _arguments()
    args = parser.parse_args(arguments)
    level = args.level.upper()
    if level not in vocab.LEVELS:
        parser.error(f"unknown level: {args.level}")
    if args.format.lower() not in ("json", "markdown", "md"):
        parser.error(f"unknown format: {args.format}")
    spark = spark or SparkSession.builder.getOrCreate()
    with scratch(spark):
        return _run(args, level, spark, parser)


def _run(args: argparse.Namespace, level: str, spark: SparkSession, parser: argparse.ArgumentParser) -> int:
    began = time.perf_counter()
    tickets = read_tickets(spark, args.input, args.source)
    records = stored(Briefs(tickets.heads, tickets.comments, [level]).records)
    rows = rendered(records, args.format).join(records.select("doc", "compressionRatio"), "doc").limit(2).collect()
    took = int((time.perf_counter() - began) * 1000)
    if not rows:
        print("no ticket in the input", file=sys.stderr)
        return 1
    if len(rows) == 1:
        text = rows[0]["text"]
        if not args.output:
            print(text)
            return 0
        Path(args.output).write_text(text, encoding="utf-8")
        print(f"Wrote {args.output} ({len(text)} chars, {rows[0]['compressionRatio'] * 100:.0f}% reduction, {took} ms)", file=sys.stderr)
        return 0
    if not args.output:
        parser.error("several tickets: name a folder with --output")
    write(records, args.output, args.format)
    done = records.agg(F.count("*").alias("n"), F.sum("rawChars").alias("raw"), F.sum("emittedChars").alias("out")).first()
    saved = max(0.0, 1 - done["out"] / done["raw"]) if done["raw"] else 0.0
    print(f"Wrote {done['n']} briefs to {args.output} ({done['out']} chars, {saved * 100:.0f}% reduction, {int((time.perf_counter() - began) * 1000)} ms)", file=sys.stderr)
    return 0
