"""The queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..functions.tokens import exact_tokens
from ..operators import clean, dedup, export, nested
from ..sources import tickets as src
from . import oracles as O
from .briefs import Briefs

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct comments with a text."""
    return _read(spark, sf, "ticket_comments").filter("body is not null").select("comment_id", F.col("body").alias("t")).distinct()


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts of both tables: ``src`` (ticket or comment), ``id``, ``t``."""
    tickets = _read(spark, sf, "tickets").filter("description is not null").select(F.lit("ticket").alias("src"), F.col("ticket_id").alias("id"), F.col("description").alias("t")).distinct()
    return tickets.union(_bodies(spark, sf).select(F.lit("comment"), "comment_id", "t"))


def _tickets(spark: SparkSession, sf: str, known: bool = False) -> src.Tickets:
    return src.from_tables(_read(spark, sf, "tickets"), _read(spark, sf, "ticket_comments"), known)


def _briefs(spark: SparkSession, sf: str, levels: list[str] | None = None) -> Briefs:
    t = _tickets(spark, sf, known=True)
    return Briefs(t.heads, t.comments, levels, known=True)


def _on_bodies(name: str, f: Callable[[Column], Column]) -> Query:
    return lambda s, d: _bodies(s, d).select("comment_id", f(F.col("t")).alias(name))


def _on_texts(name: str, f: Callable[[Column], Column]) -> Query:
    return lambda s, d: _texts(s, d).select("src", "id", f(F.col("t")).alias(name))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("src", "id", F.posexplode(T.sentences(F.col("t"))).alias("pos", "sentence"))


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean.cleaned(_texts(spark, sf), "t")


def _said(pattern: str) -> Query:
    return lambda s, d: _sentences(s, d).filter(F.col("sentence").rlike(pattern))


def _flat(records: DataFrame) -> DataFrame:
    """Records with their lists as text, so that any engine can compare them."""
    lists = ["architecture", "decisions", "constraints", "acceptanceCriteria", "risks", "todos", "dependencies", "relatedIssues", "ignoredContent"]
    return records.withColumns({x: F.array_join(x, "\n") for x in lists})


def _block_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of descriptions and comments as items of one group a ticket key, descriptions first."""
    tickets = _read(spark, sf, "tickets").select("ticket_key", F.lit(0).alias("src"), F.col("ticket_id").alias("id"), F.col("description").alias("t"))
    comments = _read(spark, sf, "ticket_comments").select("ticket_key", F.lit(1), "comment_id", "body").distinct()
    rows = tickets.union(comments).filter("ticket_key is not null and t is not null").select(F.col("ticket_key").alias("g"), "src", "id", F.posexplode(T.blocks(T.normal_spaces(F.col("t")))).alias("k", "text"))
    return rows.select("g", F.array(*[F.col(x).cast("long") for x in ("src", "id", "k")]).alias("n"), T.normal_form(F.col("text")).alias("form"))


def _placed(df: DataFrame, **places: str) -> DataFrame:
    """Places of three numbers as columns of their own: ``a="n"`` gives ``a_src``, ``a_id`` and ``a_k``."""
    return df.select(*[c for c in df.columns if c not in places.values()], *[F.col(c)[i].alias(f"{name}_{part}") for name, c in places.items() for i, part in enumerate(("src", "id", "k"))])


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "p1_found": lambda s, d: nested.ticket_children(_read(s, d, "raw_tickets")),
        "p1_nodes": lambda s, d: nested.NestedRecords(_read(s, d, "raw_tickets"), "raw_id", "payload").nodes().select("record_id", "node_key", "parent_key", "path", "ord"),
        # sources
        "jira_heads": lambda s, d: src.from_json(_read(s, d, "raw_tickets"), "raw_id", "payload").heads.withColumn("metadata", F.to_json("metadata")),
        "jira_comments": lambda s, d: src.from_json(_read(s, d, "raw_tickets"), "raw_id", "payload").comments,
        "jira_latest": lambda s, d: src.latest(src.from_json(_read(s, d, "raw_tickets"), "raw_id", "payload"), _read(s, d, "raw_tickets")).heads.select("doc", "key"),
        "comment_order": lambda s, d: _tickets(s, d).comments.select("doc", "no", "author", "body"),
        "raw_context": lambda s, d: src.raw_context(_tickets(s, d)),
        # cleaning and splitting
        "normal_spaces": _on_bodies("text", T.normal_spaces),
        "html_hint": _on_texts("is_html", T.looks_like_html),
        "html_to_text": _on_texts("text", T.html_to_text),
        "mail_quote_cut": _on_bodies("text", lambda c: T.cut_mail_quote(T.normal_spaces(c))),
        "quoted_lines": _on_bodies("text", lambda c: T.drop_quoted_lines(T.normal_spaces(c))),
        "signature_cut": _on_bodies("text", lambda c: T.cut_signature(T.normal_spaces(c))),
        "squeeze": _on_bodies("text", lambda c: T.squeeze(T.normal_spaces(c))),
        "cleaned": lambda s, d: _cleaned(s, d).select("src", "id", F.col("t").alias("text")),
        "block_split": lambda s, d: _bodies(s, d).select("comment_id", F.posexplode(T.blocks(T.normal_spaces(F.col("t")))).alias("pos", "block")),
        "sentence_split": _sentences,
        "normal_form": _on_bodies("form", T.normal_form),
        "word_set_size": _on_bodies("n_words", lambda c: F.size(T.word_set(T.normal_form(c)))),
        # filters
        "log_dump_detect": _on_bodies("is_log", T.is_log_dump),
        "noise_reason": lambda s, d: _read(s, d, "ticket_comments").filter("body is not null").select("comment_id", T.noise_reason(F.col("body"), F.col("author"), F.col("bot")).alias("reason")).distinct(),
        "noise_counts": lambda s, d: clean.noise_report(_briefs(s, d).sources).select("doc", "text"),
        # extractors
        "decisions": _said(vocab.words(vocab.DECISION)),
        "rejections": _said(vocab.words(vocab.REJECTION)),
        "architecture_hints": _said(vocab.words(vocab.ARCHITECTURE)),
        "requirements": _said(vocab.words(vocab.REQUIREMENT)),
        "todos": _said(vocab.words(vocab.TODO)),
        "risks": lambda s, d: _sentences(s, d).filter(~F.col("sentence").rlike(vocab.DEPENDENCY_PATTERN) & F.col("sentence").rlike(vocab.words(vocab.RISK))),
        "dependencies": _said(vocab.DEPENDENCY_PATTERN),
        "goal_sentences": _said(vocab.words(vocab.GOAL_SENTENCE)),
        "section_items": lambda s, d: _cleaned(s, d).select("src", "id", F.posexplode(T.section_items(F.col("t"))).alias("pos", "item")),
        "scenarios": lambda s, d: _cleaned(s, d).select("src", "id", F.posexplode(T.scenarios(F.col("t"))).alias("pos", "scenario")),
        "issue_keys": lambda s, d: _bodies(s, d).select("comment_id", F.posexplode(T.issue_keys(F.col("t"))).alias("pos", "key")),
        # near-duplicates
        "near_dup_pairs": lambda s, d: _placed(dedup.near_pairs(_block_rows(s, d).groupBy("g", "form").agg(F.min("n").alias("n"))), a="a", b="b"),
        "duplicate_collapse": lambda s, d: _placed(dedup.collapse(_block_rows(s, d)).select("g", "n", "kept_by"), own="n", kept="kept_by"),
        # the plan's steps and records
        "plan_blocks": lambda s, d: _briefs(s, d).blocks.select("doc", "no", "k", F.col("kept_by")[0].alias("kept_no"), F.col("kept_by")[1].cast("int").alias("kept_k"), "text"),
        "plan_extracts": lambda s, d: _briefs(s, d).extracts.select("doc", F.col("n")[0].alias("no"), F.col("n")[1].cast("int").alias("k"), "j", "list", "category", "text"),
        "block_score": lambda s, d: _briefs(s, d).scored.withColumn("categories", F.array_join("categories", ",")).select("doc", "no", "k", "times", "categories", "score"),
        "section_gate": lambda s, d: _briefs(s, d).lists.select("doc", "field", F.col("n")[0].alias("no"), F.col("n")[1].cast("int").alias("k"), F.col("n")[2].cast("int").alias("j"), "text"),
        "cir_full": lambda s, d: _flat(_briefs(s, d, ["FULL"]).records),
        "cir_levels": lambda s, d: _flat(_briefs(s, d).records),
        "cir_by_level": lambda s, d: _briefs(s, d).records.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("compressionRatio"), 6).alias("ratio"), F.round(F.avg("confidence"), 6).alias("confidence")),
        "markdown_brief": lambda s, d: export.rendered(_briefs(s, d, ["FULL"]).records, "markdown"),
        "json_brief": lambda s, d: export.rendered(_briefs(s, d, ["FULL"]).records, "json"),
        "document_briefs": lambda s, d: _flat(Briefs(src.from_documents(_read(s, d, "documents")).heads, src.from_documents(_read(s, d, "documents")).comments, ["FULL"]).records),
        # metrics
        "token_estimate": _on_bodies("tokens", T.estimated_tokens),
        "token_exact": lambda s, d: _bodies(s, d).select("comment_id", exact_tokens()(F.col("t")).alias("tokens")),
        "context_reduction": _context_reduction,
    }
    return out


def _context_reduction(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the raw context and of its brief, and the part saved."""
    t = _tickets(spark, sf, known=True)
    before = src.raw_context_length(t).select("doc", F.ceil(F.col("length") / 4.0).alias("tokens_before"))
    after = export.rendered(Briefs(t.heads, t.comments, ["FULL"], known=True).records, "md").select("doc", T.estimated_tokens(F.col("text")).alias("tokens_after"))
    saved = F.when(F.col("tokens_before") > 0, F.greatest(F.lit(0.0), 1.0 - F.col("tokens_after") / F.col("tokens_before"))).otherwise(0.0)
    return before.join(after, "doc").select("*", saved.alias("reduction"))


# ---- SQL ----------------------------------------------------------------------------------------------------------
_BODIES = "SELECT DISTINCT comment_id, body AS t FROM ticket_comments WHERE body IS NOT NULL"
_TEXTS = "SELECT DISTINCT 'ticket' AS src, ticket_id AS id, description AS t FROM tickets WHERE description IS NOT NULL UNION ALL SELECT DISTINCT 'comment', comment_id, body FROM ticket_comments WHERE body IS NOT NULL"


def _sql_sentences() -> str:
    return f"SELECT src, id, pos, sentence FROM ({O.pieces(f'({_TEXTS})', 'src, id, t', 'sentence', O.sentence_list('t'), 'pos')})"


def _sql_said(where: str) -> str:
    return f"SELECT * FROM ({_sql_sentences()}) WHERE {where}"


def _sql_cleaned(select: str, more: str = "") -> str:
    return f"WITH tx AS ({_TEXTS}), tn AS (SELECT *, t AS o FROM tx), {O.cleaned('tn', 'src, id, o', 'cl')}, ct AS (SELECT src, id, o, t AS text FROM cl){more} {select}"


def _sql_block_items() -> str:
    rows = "SELECT ticket_key AS g, 0 AS src, ticket_id AS id, description AS t FROM tickets UNION ALL SELECT DISTINCT ticket_key, 1, comment_id, body FROM ticket_comments"
    return f"""br AS (SELECT * FROM ({O.pieces(f"(SELECT * FROM ({rows}) WHERE g IS NOT NULL AND t IS NOT NULL)", "g, src, id, t", "text", O.paragraphs(O.spaces("t")), "k")})),
    bi AS MATERIALIZED (SELECT g, src, id, k, {O.form("text")} AS form, row_number() OVER (PARTITION BY g ORDER BY src, id, k) AS pos FROM br)"""


def _sql_pairs() -> str:
    place = lambda t, n: f"{t}.src::BIGINT AS {n}_src, {t}.id AS {n}_id, {t}.k::BIGINT AS {n}_k"
    return f"""WITH RECURSIVE {_sql_block_items()}, {O.collapse("bi", "cb")}
        SELECT e.g, {place("x", "a")}, {place("y", "b")} FROM cb_edge e JOIN bi x ON x.g = e.g AND x.pos = e.a JOIN bi y ON y.g = e.g AND y.pos = e.b"""


def _sql_collapse() -> str:
    return f"""WITH RECURSIVE {_sql_block_items()}, {O.collapse("bi", "cb")}
        SELECT x.g, x.src::BIGINT AS own_src, x.id AS own_id, x.k::BIGINT AS own_k, y.src::BIGINT AS kept_src, y.id AS kept_id, y.k::BIGINT AS kept_k FROM bi x JOIN cb_by c ON c.g = x.g AND c.form = x.form JOIN bi y ON y.g = x.g AND y.pos = c.top"""


_SQL_VAL = r"nullif(regexp_replace({}, '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g'), '')"
_SQL_CHILDREN = rf"""WITH r AS (SELECT raw_id, payload::JSON AS j FROM (SELECT DISTINCT raw_id, payload FROM raw_tickets WHERE payload IS NOT NULL AND json_valid(payload))),
    t AS (SELECT raw_id, unnest(CASE WHEN json_type(j, '$.issues') = 'ARRAY' THEN json_extract(j, '$.issues[*]') ELSE [j] END) AS t FROM r),
    k AS (SELECT raw_id, json_extract_string(t, '$.key') AS ticket_key, t, CASE WHEN json_type(t, '$.fields.comment.comments') = 'ARRAY' THEN json_extract(t, '$.fields.comment.comments[*]') ELSE json_extract(t, '$.comment.comments[*]') END AS c,
        json_extract(t, '$.fields.labels[*]') AS l, json_extract(t, '$.fields.issuelinks[*]') AS i FROM t),
    e AS (SELECT raw_id, ticket_key, 'assignee' AS entity, 0 AS pos, {_SQL_VAL.format("json_extract_string(t, '$.fields.assignee.displayName')")} AS val FROM k
        UNION ALL SELECT raw_id, ticket_key, 'label', pos, CASE WHEN json_type(x) = 'OBJECT' THEN {_SQL_VAL.format("json_extract_string(x, '$.name')")} ELSE {_SQL_VAL.format("json_extract_string(x, '$')")} END FROM (SELECT raw_id, ticket_key, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM k)
        UNION ALL SELECT raw_id, ticket_key, 'link', pos, coalesce({_SQL_VAL.format("json_extract_string(x, '$.outwardIssue.key')")}, {_SQL_VAL.format("json_extract_string(x, '$.inwardIssue.key')")}) FROM (SELECT raw_id, ticket_key, unnest(i) AS x, generate_subscripts(i, 1) - 1 AS pos FROM k)
        UNION ALL SELECT raw_id, ticket_key, 'comment', pos, CASE WHEN json_type(x) = 'OBJECT' THEN coalesce({_SQL_VAL.format("json_extract_string(x, '$.author.displayName')")}, {_SQL_VAL.format("json_extract_string(x, '$.author.name')")}, '') END FROM (SELECT raw_id, ticket_key, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM k))
    SELECT DISTINCT raw_id, ticket_key, entity, pos::INT AS pos, val FROM e WHERE val IS NOT NULL"""


_STEP = r"CASE WHEN regexp_matches(key, '^[A-Za-z_][A-Za-z0-9_]*$') THEN '.' || key ELSE '[\"' || replace(key, '\"', '\\\"') || '\"]' END"
#: Every array element by recursion over the JSON itself: a row that is no node is an object on the way to the next array.
_SQL_NODES = rf"""WITH RECURSIVE w AS (SELECT raw_id AS record_id, raw_id::VARCHAR AS node_key, NULL::VARCHAR AS parent_key, '$' AS path, 0 AS ord, '' AS label, payload::JSON AS v, true AS node FROM raw_tickets WHERE payload IS NOT NULL AND json_valid(payload)
    UNION ALL SELECT record_id, CASE WHEN list_ THEN node_key || '/' || ltrim(label, '.') || '[' || i || ']' ELSE node_key END, CASE WHEN list_ THEN node_key ELSE parent_key END, CASE WHEN list_ THEN path || '[*]' ELSE path || {_STEP} END,
        CASE WHEN list_ THEN i ELSE ord END, CASE WHEN list_ THEN '' ELSE label || {_STEP} END, x, list_ FROM (
        SELECT w.*, true AS list_, NULL AS key, unnest(json_extract(v, '$[*]')) AS x, generate_subscripts(json_extract(v, '$[*]'), 1)::INT - 1 AS i FROM w WHERE json_type(v) = 'ARRAY'
        UNION ALL SELECT record_id, node_key, parent_key, path, ord, label, v, node, false, key, json_extract(v, '/' || replace(replace(key, '~', '~0'), '/', '~1')), 0 FROM (SELECT *, unnest(json_keys(v)) AS key FROM w WHERE json_type(v) = 'OBJECT')))
    SELECT record_id, node_key, parent_key, path, ord FROM w WHERE node"""


def _at_path(v: str, path: str) -> str:
    return f"coalesce(CASE WHEN json_type({v}, '{path}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string({v}, '{path}') END, '')"


def _sql_tickets() -> str:
    """CTE ``jt``: doc and the JSON of each ticket, single, on a page or in a list of either."""
    return """jr AS (SELECT raw_id, payload::JSON AS j FROM raw_tickets WHERE payload IS NOT NULL AND json_valid(payload)),
    je AS (SELECT raw_id, a, CASE WHEN json_type(x, '$.issues') = 'ARRAY' THEN json_extract(x, '$.issues[*]') ELSE [x] END AS t FROM (SELECT raw_id, unnest(l) AS x, generate_subscripts(l, 1) AS a FROM (SELECT raw_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS l FROM jr))),
    jt AS MATERIALIZED (SELECT raw_id || '/' || (row_number() OVER (PARTITION BY raw_id ORDER BY a, b) - 1) AS doc, t FROM (SELECT raw_id, a, unnest(t) AS t, generate_subscripts(t, 1) AS b FROM je)),
    jo AS MATERIALIZED (SELECT * FROM jt WHERE json_type(t) = 'OBJECT')"""


def _sql_jira_heads() -> str:
    full = "'[^ \t\n\x0b\f\r]'"
    label = f"CASE WHEN json_type(x) = 'OBJECT' THEN {_at_path('x', '$.name')} ELSE {_at_path('x', '$')} END"
    link = f"CASE WHEN regexp_matches({_at_path('x', '$.outwardIssue.key')}, {full}) THEN {_at_path('x', '$.outwardIssue.key')} ELSE {_at_path('x', '$.inwardIssue.key')} END"
    listed = lambda path, one, where: f"array_to_string(list_filter(list_transform(CASE WHEN json_type(t, '{path}') = 'ARRAY' THEN json_extract(t, '{path}[*]') ELSE [] END, lambda x: {one}), lambda x: {where}), ',')"
    fields = {"status": _at_path("t", "$.fields.status.name"), "issueType": _at_path("t", "$.fields.issuetype.name"), "priority": _at_path("t", "$.fields.priority.name"), "assignee": _at_path("t", "$.fields.assignee.displayName"), "labels": "labels", "linkedIssues": "linked"}
    pairs = ", ".join(f"""CASE WHEN regexp_matches({v}, {full}) THEN '"{k}":' || to_json({v})::VARCHAR END""" for k, v in fields.items())
    return f"""WITH {_sql_tickets()}, jl AS (SELECT *, {listed("$.fields.labels", label, "x <> ''")} AS labels, {listed("$.fields.issuelinks", link, f"regexp_matches(x, {full})")} AS linked FROM jo)
        SELECT doc, 'jira' AS source, {_at_path("t", "$.key")} AS key, {_at_path("t", "$.fields.summary")} AS title,
            CASE WHEN regexp_matches({_at_path("t", "$.fields.description")}, {full}) THEN {_at_path("t", "$.fields.description")} ELSE {_at_path("t", "$.renderedFields.description")} END AS description,
            '{{' || array_to_string(list_filter([{pairs}], lambda x: x IS NOT NULL), ',') || '}}' AS metadata, linked FROM jl"""


def _sql_jira_comments() -> str:
    author = f"CASE WHEN {_at_path('c', '$.author.displayName')} <> '' THEN {_at_path('c', '$.author.displayName')} ELSE {_at_path('c', '$.author.name')} END"
    return f"""WITH {_sql_tickets()}, jc AS (SELECT doc, unnest(l) AS c, generate_subscripts(l, 1) AS no FROM (SELECT doc, CASE WHEN json_type(t, '$.fields.comment.comments') = 'ARRAY' THEN json_extract(t, '$.fields.comment.comments[*]') WHEN json_type(t, '$.comment.comments') = 'ARRAY' THEN json_extract(t, '$.comment.comments[*]') ELSE [] END AS l FROM jo))
        SELECT doc, no::BIGINT AS no, {author} AS author, {_at_path("c", "$.created")} AS created, {_at_path("c", "$.body")} AS body,
            lower({_at_path("c", "$.author.accountType")}) = 'app' OR {O.has(author, vocab.CONNECTOR_BOTS)} AS bot FROM jc"""


def oracle_sql() -> dict[str, str]:
    on_bodies = lambda name, sql: f"SELECT comment_id, {sql} AS {name} FROM ({_BODIES})"
    on_spaced = lambda name, sql: f"SELECT comment_id, {sql} AS {name} FROM (SELECT comment_id, {O.spaces('t')} AS t FROM ({_BODIES}))"
    on_texts = lambda name, sql: f"SELECT src, id, {sql} AS {name} FROM ({_TEXTS})"
    said = lambda phrases: _sql_said(O.has("sentence", phrases))
    keys = r"'\b[A-Z][A-Z0-9]{1,9}-\d+\b-?'"
    rules = ", " + O.line_rules("ct", "src, id, o", "lr")
    ordered = lambda t, name: f"SELECT src, id, (row_number() OVER (PARTITION BY src, id, o ORDER BY i) - 1)::INT AS pos, text AS {name} FROM {t}"
    return {
        "p1_found": _SQL_CHILDREN,
        "p1_nodes": _SQL_NODES,
        "jira_heads": _sql_jira_heads(),
        "jira_comments": _sql_jira_comments(),
        "jira_latest": f"""WITH {_sql_tickets()}, jk AS (SELECT doc, {_at_path("t", "$.key")} AS key, split_part(doc, '/', 1)::BIGINT AS raw_id FROM jo)
            SELECT doc, key FROM (SELECT k.doc, k.key, row_number() OVER (PARTITION BY CASE WHEN k.key = '' THEN '/' || k.doc ELSE k.key END ORDER BY r.received_at DESC NULLS LAST, k.doc DESC) AS n FROM jk k LEFT JOIN (SELECT raw_id, max(received_at) AS received_at FROM raw_tickets GROUP BY 1) r USING (raw_id)) WHERE n = 1""",
        "normal_spaces": on_bodies("text", O.spaces("t")),
        "html_hint": on_texts("is_html", f"regexp_matches(t, {O.HTML_HINT})"),
        "html_to_text": on_texts("text", O.html("t")),
        "mail_quote_cut": on_spaced("text", O.mail_cut("t")),
        "quoted_lines": on_spaced("text", O.quoted_out("t")),
        "signature_cut": on_spaced("text", O.signature_cut("t")),
        "squeeze": on_bodies("text", O.squeeze(O.spaces("t"))),
        "cleaned": _sql_cleaned("SELECT src, id, text FROM ct"),
        "block_split": f"SELECT comment_id, pos, block FROM ({O.pieces(f'({_BODIES})', 'comment_id, t', 'block', O.paragraphs(O.spaces('t')), 'pos')})",
        "sentence_split": _sql_sentences(),
        "normal_form": on_bodies("form", O.form("t")),
        "word_set_size": on_bodies("n_words", f"CASE WHEN {O.form('t')} = '' THEN 0 ELSE len(list_distinct(string_split({O.form('t')}, ' '))) END::INT"),
        "log_dump_detect": on_bodies("is_log", O.log_dump("t")),
        "noise_reason": f"SELECT DISTINCT comment_id, {O.reason('body')} AS reason FROM ticket_comments WHERE body IS NOT NULL",
        "decisions": said(vocab.DECISION),
        "rejections": said(vocab.REJECTION),
        "architecture_hints": said(vocab.ARCHITECTURE),
        "requirements": said(vocab.REQUIREMENT),
        "todos": said(vocab.TODO),
        "risks": _sql_said(f"NOT {O.needs('sentence')} AND {O.has('sentence', vocab.RISK)}"),
        "dependencies": _sql_said(O.needs("sentence")),
        "goal_sentences": said(vocab.GOAL_SENTENCE),
        "section_items": _sql_cleaned(ordered("lr_items", "item"), rules),
        "scenarios": _sql_cleaned(ordered("lr_runs", "scenario"), rules),
        "issue_keys": f"""SELECT comment_id, (row_number() OVER (PARTITION BY comment_id, t ORDER BY i) - 1)::INT AS pos, key FROM (
            SELECT comment_id, t, unnest(regexp_extract_all(t, {keys})) AS key, generate_subscripts(regexp_extract_all(t, {keys}), 1) AS i FROM ({_BODIES})) WHERE key NOT LIKE '%-'""",
        "comment_order": """SELECT ticket_key AS doc, row_number() OVER (PARTITION BY ticket_key ORDER BY comment_id) AS no, author, body FROM (
            SELECT ticket_key, comment_id, arg_min(struct_pack(author := author, body := body), ingested_at) AS c FROM ticket_comments WHERE ticket_key IS NOT NULL AND comment_id IS NOT NULL GROUP BY 1, 2) s, LATERAL (SELECT s.c.author AS author, s.c.body AS body)""",
        "near_dup_pairs": _sql_pairs(),
        "duplicate_collapse": _sql_collapse(),
        "token_estimate": on_bodies("tokens", "ceil(length(t) / 4.0)::BIGINT"),
        **O.oracle_sql(),
    }
