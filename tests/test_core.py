"""Nested records, SQL of the catalogue, text functions, sources and the stream."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from briefloom.functions import text as T
from briefloom.functions import tokens
from briefloom.operators import dedup, graph, nested
from briefloom.operators.order import numbered
from briefloom.plans import catalogue
from briefloom.sources import tickets as src
from briefloom.streaming import briefs as stream

SF = "/root/testdata/sf0.001"
PAYLOADS = [
    {"key": "A-1", "fields": {"assignee": {"displayName": " Ann "}, "labels": ["x", None, " ", {"name": "y"}, {"name": None}, 5], "issuelinks": [{"outwardIssue": {"key": ""}, "inwardIssue": {"key": "B-1"}}, None, {}], "comment": {"comments": [{"author": {"name": "bo"}, "body": "hi"}, None, {}, {"author": None}]}}},
    {"issues": [{"key": "A-2", "fields": {"labels": "no list", "comment": {"comments": {"not": "a list"}}}, "comment": {"comments": [{"author": {"displayName": "Cy"}}]}}, {"key": None, "fields": None}, {"fields": {"labels": ["z"], "assignee": "text"}}]},
    {"key": "A-3", "fields": {"description": {"content": [{"deep": [{"a b": 1}]}]}, "labels": []}},
]
ROWS = [*((k, json.dumps(p)) for k, p in enumerate(PAYLOADS)), (0, json.dumps(PAYLOADS[0])), (10, None), (11, ""), (12, '{"key": '), (13, '{"key": 1} x'), (14, "7"), (15, "null")]


def test_nested_children(spark):
    df = spark.createDataFrame(ROWS, "raw_id long, payload string").withColumn("v", F.lit(1)).withColumn("record_id", F.lit("clash"))
    got = {tuple(r) for r in nested.ticket_children(df).collect()}
    assert got == {
        (0, "A-1", "assignee", 0, "Ann"), (0, "A-1", "label", 0, "x"), (0, "A-1", "label", 3, "y"), (0, "A-1", "label", 5, "5"), (0, "A-1", "link", 0, "B-1"),
        (0, "A-1", "comment", 0, "bo"), (0, "A-1", "comment", 2, ""), (0, "A-1", "comment", 3, ""), (1, "A-2", "comment", 0, "Cy"), (1, None, "label", 0, "z"),
    }
    records = nested.NestedRecords(df, "raw_id", "payload")
    assert "$.fields.description.content[*].deep[*]" in records.array_paths()
    tables = records.tables()
    labels = {(r["node_key"], r["parent_key"], r["ord"], r["value"], r["name"]) for r in tables["$.fields.labels[*]"].collect()}
    assert ("0/fields.labels[3]", "0", 3, None, "y") in labels and ("0/fields.labels[1]", "0", 1, None, None) in labels
    assert nested.ticket_children(df.limit(0)).count() == 0


def test_arrays_of_any_depth(spark):
    """Twelve levels, and a place that is an array, an object or a scalar from level to level."""
    deep = "x"
    for k in range(12):
        deep = [deep] if k % 2 else [{"a": deep}, {"a": {"b": [k]}}, k]
    df = spark.createDataFrame([(1, json.dumps({"r": deep}))], "raw_id long, payload string")
    records = nested.NestedRecords(df, "raw_id", "payload")
    want = []

    def walk(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}")
        elif isinstance(v, list):
            for x in v:
                want.append(f"{path}[*]")
                walk(x, f"{path}[*]")

    walk({"r": deep}, "$")
    assert max(p.count("[*]") for p in want) >= 12
    got = [r["path"] for r in records.nodes().collect() if r["path"] != "$"]
    assert sorted(got) == sorted(want) and set(records.array_paths()) == set(want)
    assert sum(t.count() for t in records.tables().values()) == len(want) + 1


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    r = con.execute(catalogue.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    want = sorted(str([dict(zip(cols, row))[c] for c in sorted(cols)]) for row in r.fetchall())
    got = sorted(str([row[c] for c in sorted(cols)]) for row in catalogue.queries()[name](spark, SF).collect())
    assert got == want


def test_texts(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(T.html_to_text, "<p>A &amp; B&#33;&#x41;</p><script>x</script><ul><li>one<li>two</li></ul>") == "\nA & B!A\n- one- two\n"
    assert one(T.cut_mail_quote, "a\nOn Monday, Bo X wrote:\nb") == "a\n"
    assert one(T.cut_signature, "a\n-- \nb") == "a\n" and one(T.cut_signature, "a --\nb") == "a --\nb"
    assert one(T.sentences, "One. Two! (three) four? five\n\nsix") == ["One.", "Two!", "(three) four? five", "six"]
    assert one(T.issue_keys, "AB-1, CVE-2019-12399 utf-8 UTF-8") == ["AB-1", "UTF-8"]
    assert one(T.scenarios, "Given a\n- when b\n\nthen c") == ["Given a when b"]
    assert one(T.section_items, "h3. Definition of done\n1. a\n* [x] b\ntext\n- c") == ["a", "b"]
    assert one(T.utf16_length, "a😀") == 3 and one(T.is_symbols, "❤️") is False and one(T.is_symbols, "🎉 :)") is True
    assert one(T.is_decision, "Decision: use it") is False and one(T.is_decision, "decision:use it") is True
    for f in (T.html_to_text, T.squeeze, T.normal_form, T.blocks, T.sentences):
        assert one(f, None) is None and one(f, "") in ("", [])


def test_collapse_order(spark):
    texts = ["pick one thing now", "lets use kafka for order events today", "Lets use kafka for order events today!", "so lets use kafka for order events today and on", "", "漢字", "pick one thing", "pick one thing now please"]
    items = spark.createDataFrame([(g, n, t) for g in ("a", "b") for n, t in enumerate(texts)], "g string, n long, t string").select("g", "n", T.normal_form(F.col("t")).alias("form"))
    got = {(r["g"], r["n"]): r["kept_by"] for r in dedup.collapse(items).collect()}
    want, kept = {}, []
    forms = [r["form"] for r in items.filter("g = 'a'").orderBy("n").collect()]
    from . import brute

    for n, f in enumerate(forms):
        want[n] = next((k for k in kept if brute.near(forms[k], f)), n)
        kept += [n] if want[n] == n else []
    assert got == {(g, n): k for g in ("a", "b") for n, k in want.items()}


def test_collapse_in_batches(spark):
    """A family of variants and other texts, decided in batches of any size as one after another."""
    import random

    from . import brute

    rng = random.Random(7)
    base = [f"w{k}" for k in range(12)]
    forms = []
    while len(forms) < 60:
        x = list(base) if rng.random() < 0.6 else [f"v{rng.randrange(20)}" for _ in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = f"z{rng.randrange(9)}"
        t = " ".join(x[rng.randrange(2) :])
        forms += [t] if t not in forms else []
    forms[20:20] = ["supercalifragilistic12", "one xsupercalifragilistic12 more"]
    want, kept = {}, []
    for n, f in enumerate(forms):
        want[n] = next((k for k in kept if brute.near(forms[k], f)), n)
        kept += [n] if want[n] == n else []
    items = spark.createDataFrame(list(enumerate(forms)), "n long, form string").withColumn("g", F.lit("g"))
    for width in (100, 25, 7):
        got = {r["n"]: r["kept_by"] for r in dedup.collapse(items.withColumn("batch", F.floor(F.col("n") / width))).collect()}
        assert got == want and 3 < len(kept) < 50
    assert dedup.collapse(items.limit(0).withColumn("batch", F.lit(0))).count() == 0


def test_components_and_order(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 40), (40, 45), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), 40: 40, 45: 40, 50: 40}
    df = spark.createDataFrame([("x", 7 * k) for k in range(1000)] + [("y", 5)], "g string, i long")
    assert sorted(r["p"] for r in numbered(df, "g", "i", "p").filter("g = 'x'").collect()) == list(range(1, 1001))


def test_sources(spark, tmp_path):
    (tmp_path / "note.txt").write_text("We decided to go.\n\nMust hold.")
    t = src.read_tickets(spark, str(tmp_path / "note.txt"), "text")
    assert t.heads.first()["title"] == "note.txt" and t.comments.count() == 0
    (tmp_path / "t.json").write_text(json.dumps({"key": "K-1", "fields": {"summary": "S", "description": {"rich": 1}, "labels": ["a", "b"], "comment": {"comments": [{"author": {"displayName": "x", "accountType": "APP"}, "body": "b"}]}}, "renderedFields": {"description": "<p>d</p>"}}))
    t = src.read_tickets(spark, str(tmp_path / "t.json"))
    head = t.heads.first()
    assert (head["key"], head["description"], head["metadata"]) == ("K-1", "<p>d</p>", {"labels": "a,b"}) and t.comments.first()["bot"] is True
    assert src.raw_context(t).first()["text"] == "S\n\n<p>d</p>\n\nb"
    with pytest.raises(ValueError):
        src.from_pasted(spark, " \n")


def test_exact_tokens(spark):
    path, pattern = tokens.default_vocabulary()
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 30_000), (5, "漢字 é 🎉")]
    got = {r["id"]: r["n"] for r in spark.createDataFrame(rows, "id long, t string").select("id", tokens.exact_tokens()(F.col("t")).alias("n")).collect()}
    assert got == {k: None if x is None else len(tokens.encoder(path, pattern).encode_ordinary(x)) for k, x in rows} and got[1] == 2


def test_latest_delivery(spark):
    t = {k: {"key": k, "fields": {"summary": f"{k}", "comment": {"comments": [{"body": "x"}]}}} for k in ("A", "B", "")}
    rows = [(1, json.dumps([t["A"], t[""]]), 5), (2, json.dumps(t["A"]), 7), (3, json.dumps({"issues": [t["B"], t["A"], t[""]]}), None)]
    df = spark.createDataFrame(rows, "raw_id long, payload string, received_at long")
    got = src.latest(src.from_json(df, "raw_id", "payload"), df)
    assert sorted(r["doc"] for r in got.heads.collect()) == ["1/1", "2/0", "3/0", "3/2"] == sorted(r["doc"] for r in got.comments.collect())


def test_contained_forms(spark):
    rows = [("g", k, x) for k, x in enumerate(["supercalifragilistic12", "xsupercalifragilistic12 yes", "longword12345 longword6789", "a longword12345 longword67890 b", "one two three four five six", "zone two three four five sixty", "one two four five six seven x"])]
    items = spark.createDataFrame(rows, "g string, n long, form string")
    forms = [x for _, _, x in rows]
    want = {(a, b) for a, x in enumerate(forms) for b, y in enumerate(forms) if a != b and len(x) > 20 and x in y}
    got = dedup.contained(items.filter("length(form) > 20").withColumnRenamed("n", "x"), items.withColumnRenamed("n", "y")).filter("x <> y")
    assert {(r["x"], r["y"]) for r in got.collect()} == want and len(want) == 3
    from . import brute

    pairs = {(a, b) for a, x in enumerate(forms) for b, y in enumerate(forms) if a < b and brute.near(x, y)}
    assert {(r["a"], r["b"]) for r in dedup.near_edges(items).collect()} == pairs


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, json.dumps({"key": "K-1", "fields": {"summary": "S", "description": "We decided to go."}}))], "raw_id long, payload string").write.json(str(tmp_path / "in/a"))
    rows = spark.readStream.schema("raw_id long, payload string").json(str(tmp_path / "in/*"))
    stream.start(rows, "raw_id", "payload", str(tmp_path / "out"), str(tmp_path / "state"), ["FULL"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["decisions"] == ["We decided to go."]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "cir_full" in entry.queries()
