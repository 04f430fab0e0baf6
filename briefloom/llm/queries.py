"""The corpus queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leak, mail, neardup, normalize, packing, pii, spans, sql
from ._common import read


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments that p5 speaks of."""
    return read(spark, sf_dir, "ticket_comments").filter("channel <> 'email'")


def _both(f: Callable[..., DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    """``f(table, id, text column)`` of the comments and of the tickets, with ``src`` in front."""
    parts = [("comment", "ticket_comments", "comment_id", "body"), ("ticket", "tickets", "ticket_id", "description")]
    got = [(src, f(read(spark, sf_dir, table), id_col, text)) for src, table, id_col, text in parts]
    return got[0][1].select(F.lit(got[0][0]).alias("src"), "*").union(got[1][1].select(F.lit(got[1][0]).alias("src"), "*"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the authors of all comments and of the assignees of all tickets."""
    authors = read(spark, sf_dir, "ticket_comments").select(F.col("author").alias("person"))
    return pii.name_gazetteer(authors.union(read(spark, sf_dir, "tickets").select(F.col("metadata")["assignee"])), "person")


#: Documents that a container takes; these, and the share of its squared capacity, where attention is to bind too.
_DOCS = 64
_BOUND = {"most_docs": 32, "cost_factor": 0.5}


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    rows = read(spark, sf_dir, "pack_sizes").filter("pack_id is not null and capacity_tokens > 0").distinct().orderBy("pack_id").limit(packing.MOST_CAPACITIES + 1).collect()
    return [(r["pack_id"], r["capacity_tokens"]) for r in rows]  # packed() refuses more than the limit


def _packed(spark: SparkSession, sf_dir: str, counts: Callable[[DataFrame], DataFrame] = packing.token_counts, **limits) -> DataFrame:
    return packing.packed(counts(read(spark, sf_dir, "documents")), _capacities(spark, sf_dir), **limits)


def _placed(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    """How often and with how many tokens each document is placed, by the estimate of its tokens."""
    got = _packed(spark, sf_dir, packing.estimated_counts, rule=rule, **_BOUND)
    return got.groupBy("pack_id", "doc_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))


def _limits(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return packing.limits(_packed(spark, sf_dir, packing.estimated_counts, rule=rule, **_BOUND), _capacities(spark, sf_dir), **_BOUND)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": lambda s, d: _both(lambda df, i, t: normalize.look_alike_pairs(df, i, "ticket_key", t), s, d),
        "p2_consistent_text": lambda s, d: _both(lambda df, i, t: normalize.consistent(df, [i], t).select(F.col(i).alias("id"), "text", "form"), s, d),
        "p3_found": lambda s, d: _both(lambda df, i, t: pii.mentions(df, i, t, _people(s, d)).select("rec_id", "kind", "start_pos"), s, d).distinct(),
        "p3_masked": lambda s, d: _both(lambda df, i, t: pii.masked(df, i, t, _people(s, d)), s, d),
        "p4_found": lambda s, d: mail.old_lines(read(s, d, "ticket_comments")),
        "p4_inherited": lambda s, d: mail.line_reasons(read(s, d, "ticket_comments")).filter(F.col("why") == mail.INHERITED).select(F.col("id").alias("comment_id"), "line_no"),
        "p4_reasons": lambda s, d: mail.line_reasons(read(s, d, "ticket_comments")).groupBy("why").agg(F.count("*").alias("n_lines"), F.countDistinct("id").alias("n_mails")),
        "p4_new_text": lambda s, d: mail.newly_written(read(s, d, "ticket_comments")).select("id", "new_text"),
        "p5_found": lambda s, d: neardup.near_duplicates(_comments(s, d), "comment_id", neardup.Runs(F.col("body")), 0.75, 30),
        "p5_groups": lambda s, d: neardup.near_groups(_comments(s, d), "comment_id", neardup.Runs(F.col("body")), 0.75, 30),
        "p6_packed": lambda s, d: _packed(s, d, most_docs=_DOCS),
        "p6_packed_bound": lambda s, d: _packed(s, d, **_BOUND),
        "p6_packed_bound_dot": lambda s, d: _packed(s, d, rule="dot", **_BOUND),
        "p6_fill": lambda s, d: packing.fill(_packed(s, d, most_docs=_DOCS), _capacities(s, d)),
        "p6_fill_bound": lambda s, d: packing.fill(_packed(s, d, **_BOUND), _capacities(s, d)),
        "p6_fill_bound_dot": lambda s, d: packing.fill(_packed(s, d, rule="dot", **_BOUND), _capacities(s, d)),
        "p6_placed": lambda s, d: _placed(s, d, "norm"),
        "p6_placed_dot": lambda s, d: _placed(s, d, "dot"),
        "p6_limits": lambda s, d: _limits(s, d, "norm"),
        "p6_limits_dot": lambda s, d: _limits(s, d, "dot"),
        "p7_found": lambda s, d: leak.leaked_documents(read(s, d, "documents"), read(s, d, "eval_items")),
        "p7_passages": lambda s, d: leak.leaked_passages(read(s, d, "documents"), read(s, d, "eval_items"), least_words=20, max_edits=1),
        "p8_found": lambda s, d: spans.shared_spans(read(s, d, "documents")),
        "p8_shared_share": lambda s, d: spans.shared_share(read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
