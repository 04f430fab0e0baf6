"""Sources: each gives ``heads`` (doc, key, title, description, linked, metadata) and ``comments`` (doc, no, author, created,
body, bot)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators.nested import is_array, is_object, parse_json_strict
from ..operators.order import RANGE, in_ranges, numbered


class Tickets(NamedTuple):
    heads: DataFrame
    comments: DataFrame


def _no_comments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc string, no long, author string, created string, body string, bot boolean")


def is_app(author: Column, account: Column) -> Column:
    return (F.lower(F.coalesce(account, F.lit(""))) == "app") | F.coalesce(author, F.lit("")).rlike(vocab.words(vocab.CONNECTOR_BOTS))


def from_json(df: DataFrame, id_col: str, json_col: str) -> Tickets:
    """Tickets of JSON exports: one a payload, a page of them under ``issues``, or a list of either.  ``doc`` is id and place.  Missing and
    non-text values are empty; invalid payloads give nothing."""
    v = F.col("v")
    pages = df.select(F.col(id_col).cast("string").alias("id"), parse_json_strict(F.col(json_col)).alias("v")).filter("v is not null")
    whole = F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    each = F.flatten(F.transform(whole, lambda x: F.when(is_array(F.try_variant_get(x, "$.issues", "variant")), F.try_variant_get(x, "$.issues", "array<variant>")).otherwise(F.array(x))))
    tickets = pages.select("id", F.posexplode(each).alias("k", "v")).filter(is_object(F.col("v"))).select(F.concat("id", F.lit("/"), F.col("k").cast("string")).alias("doc"), "v")

    def text(path: str, of: Column = v) -> Column:
        got = F.try_variant_get(of, path, "variant")
        return F.coalesce(F.when(~is_array(got) & ~is_object(got), F.try_variant_get(of, path, "string")), F.lit(""))

    array = lambda path: F.when(is_array(F.try_variant_get(v, path, "variant")), F.try_variant_get(v, path, "array<variant>"))
    none = F.array().cast("array<string>")
    labels = F.coalesce(F.filter(F.transform(array("$.fields.labels"), lambda x: F.when(is_object(x), text("$.name", x)).otherwise(text("$", x))), lambda x: x != ""), none)
    link = lambda x: F.when(~T.is_blank(text("$.outwardIssue.key", x)), text("$.outwardIssue.key", x)).otherwise(text("$.inwardIssue.key", x))
    links = F.coalesce(F.filter(F.transform(array("$.fields.issuelinks"), link), lambda x: ~T.is_blank(x)), none)
    fields = {"status": text("$.fields.status.name"), "issueType": text("$.fields.issuetype.name"), "priority": text("$.fields.priority.name"), "assignee": text("$.fields.assignee.displayName"), "labels": F.array_join(labels, ","), "linkedIssues": F.array_join(links, ",")}
    metadata = F.map_filter(F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c)]), lambda _, x: ~T.is_blank(x))
    described = F.when(~T.is_blank(text("$.fields.description")), text("$.fields.description")).otherwise(text("$.renderedFields.description"))
    heads = tickets.select("doc", F.lit("jira").alias("source"), text("$.key").alias("key"), text("$.fields.summary").alias("title"), described.alias("description"), metadata.alias("metadata")).withColumn("linked", F.coalesce(F.col("metadata")["linkedIssues"], F.lit("")))
    said = F.coalesce(array("$.fields.comment.comments"), array("$.comment.comments"))
    c = F.col("c")
    author = F.when(text("$.author.displayName", c) != "", text("$.author.displayName", c)).otherwise(text("$.author.name", c))
    rows = tickets.select("doc", F.posexplode(said).alias("k", "c")).select("doc", (F.col("k") + 1).cast("long").alias("no"), author.alias("author"), text("$.created", c).alias("created"), text("$.body", c).alias("body"), text("$.author.accountType", c).alias("account"))
    return Tickets(heads, rows.withColumn("bot", is_app(F.col("author"), F.col("account"))).drop("account"))


def latest(tickets: Tickets, received: DataFrame, id_col: str = "raw_id", at_col: str = "received_at") -> Tickets:
    """Tickets of JSON exports without redeliveries: of those with one non-empty key the one of the record received last (of
    equal times the greatest ``doc``).  ``received`` has the record's id and time; a null time comes first."""
    at = received.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(at_col).alias("at"))
    dated = tickets.heads.select("doc", "key", F.substring_index("doc", "/", 1).alias("id")).join(at, "id", "left")
    last = dated.groupBy(F.when(F.col("key") == "", F.concat(F.lit("/"), "doc")).otherwise(F.col("key")).alias("key")).agg(F.max_by("doc", F.struct("at", "doc")).alias("doc")).select("doc")
    return Tickets(tickets.heads.join(last, "doc", "left_semi"), tickets.comments.join(last, "doc", "left_semi"))


def from_tables(tickets: DataFrame, comments: DataFrame, known: bool = False) -> Tickets:
    """Normalised tables: of a ticket exported several times the latest row, of a comment delivered several times one; with
    ``known`` only comments whose ticket is there."""
    ranked = tickets.filter("ticket_key is not null").groupBy(F.col("ticket_key").alias("doc")).agg(F.max_by(F.struct("src_system", "title", "description", "metadata"), F.struct("exported_at", "ticket_id")).alias("t"))
    heads = ranked.select("doc", F.coalesce("t.src_system", F.lit("unknown")).alias("source"), F.col("doc").alias("key"), "t.title", "t.description", "t.metadata", F.coalesce(F.col("t.metadata")["linkedIssues"], F.lit("")).alias("linked"))
    # Copies of a comment lie in the range that it is numbered in: texts are shuffled once.
    named = comments.filter("ticket_key is not null and comment_id is not null").withColumnRenamed("ticket_key", "doc")
    once = in_ranges(named, "doc", "comment_id").groupBy("doc", RANGE, "comment_id").agg(F.min_by(F.struct("author", "created", "body", "bot"), F.struct(F.col("ingested_at").isNull(), "ingested_at", "author", "created", "body", "bot")).alias("c"))
    rows = numbered(once, "doc", "comment_id", "no", heads.select("doc") if known else None).select("doc", "no", "c.author", "c.created", "c.body", F.coalesce("c.bot", F.lit(False)).alias("bot"))
    return Tickets(heads, rows)


def from_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tickets:
    """Each text as the description of a ticket without comments."""
    one = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("description"))
    heads = one.select("doc", F.lit("text").alias("source"), F.lit("").alias("key"), F.col("doc").alias("title"), "description", F.create_map().cast("map<string,string>").alias("metadata"), F.lit("").alias("linked"))
    return Tickets(heads, _no_comments(df.sparkSession))


def from_text_files(spark: SparkSession, path: str) -> Tickets:
    """Each file as a ticket: its name is the title, its whole text the description."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_name").alias("title"), F.col("value").alias("description"))
    return Tickets(files.select("doc", F.lit("text").alias("source"), F.lit("").alias("key"), "title", "description", F.create_map().cast("map<string,string>").alias("metadata"), F.lit("").alias("linked")), _no_comments(spark))


def from_pasted(spark: SparkSession, text: str) -> Tickets:
    """One pasted text; blank text is an error."""
    if not text.strip():
        raise ValueError("nothing to compress")
    one = spark.createDataFrame([("pasted", text.strip())], "doc string, description string")
    tickets = from_documents(one, "doc", "description")
    return Tickets(tickets.heads.withColumn("title", F.lit("Pasted text")), tickets.comments)


def from_json_files(spark: SparkSession, path: str) -> Tickets:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("payload"))
    return from_json(files, "id", "payload")


def read_tickets(spark: SparkSession, path: str, source: str = "jira") -> Tickets:
    """The connector by name: ``text``, anything else is ticket JSON."""
    return from_text_files(spark, path) if source.lower() == "text" else from_json_files(spark, path)


def raw_context(tickets: Tickets) -> DataFrame:
    """``doc, text``: title, description and comments that aren't blank, in order, between blank lines."""
    parts = tickets.heads.select("doc", F.posexplode(F.array("title", "description")).alias("k", "t")).select("doc", (F.col("k") - 2).cast("long").alias("n"), "t").union(tickets.comments.select("doc", "no", "body"))
    parts = parts.filter(~T.is_blank(F.col("t"))).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("p"))
    return tickets.heads.select("doc").join(parts, "doc", "left").select("doc", F.coalesce(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.lit("")).alias("text"))


def raw_context_length(tickets: Tickets) -> DataFrame:
    """``doc, length`` of ``raw_context``, without bringing its texts together."""
    parts = tickets.heads.select("doc", F.explode(F.array("title", "description")).alias("t")).union(tickets.comments.select("doc", "body"))
    sums = parts.filter(~T.is_blank(F.col("t"))).groupBy("doc").agg((F.sum(F.length("t")) + 2 * (F.count("*") - 1)).alias("length"))
    return tickets.heads.select("doc").join(sums, "doc", "left").select("doc", F.coalesce("length", F.lit(0).cast("long")).alias("length"))
