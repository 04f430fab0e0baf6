"""Normal form, personal information, mails and leaks, on small texts of our own."""

import random
import re
import textwrap
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from briefloom.llm import leak, mail, normalize, pii


def plain_form(text):
    text = re.sub("\r\n?", "\n", text)
    parts = unicodedata.normalize("NFD", "".join(normalize._one(x) if x > "~" or x == "\t" else x for x in text))
    return unicodedata.normalize("NFC", parts)


TEXTS = ["plain", "plаin", "plain​", "ｐlain", "Plain", "", None, "été", "été", "ete", "ạ̇", "ạ̇", "line\r\nend", "line\nend", "a b", "a b", "a\tb", "x" * 5000 + "а", "x" * 5000 + "a", "й́́", "​́x"]


def test_consistent_form(spark):
    df = spark.createDataFrame([(k, "t", x, 0) for k, x in enumerate(TEXTS)] + [(0, "t", "plain", 1)], "id long, grp string, text string, form int")
    got = {r["id"]: r["form"] for r in normalize.consistent(df, ["id"]).collect()}
    assert len(got) == len(TEXTS)
    for k, x in enumerate(TEXTS):
        assert got[k] == (None if x is None else plain_form(x)), x
    pairs = {tuple(r) for r in normalize.look_alike_pairs(df, "id", "grp", "text").collect()}
    want = {(a, b) for a, x in enumerate(TEXTS) for b, y in enumerate(TEXTS) if a < b and x is not None and y is not None and x != y and plain_form(x) == plain_form(y)}
    assert pairs == want and (0, 1) in want and (0, 4) not in want
    assert normalize.look_alike_pairs(df.limit(0), "id", "grp", "text").count() == 0


def test_korean_and_long_runs(spark):
    """Syllables and their parts are one; runs without blanks are cut only between code points that do not combine."""
    whole = "한글 각 가 힣 테스트"
    parts = unicodedata.normalize("NFD", whole)
    thai, marks = "กำลังทดสอบระบบ" * 400, "а" + "\u0301\u0323" * 50
    texts = [whole, parts, parts.replace("\u1161", "\u200b\u1161", 1), unicodedata.normalize("NFC", parts[:2]) + parts[2:], thai, thai + "\u200d", marks, unicodedata.normalize("NFD", "й" * 500), "й" * 500, "ᄀ", "ᅡ", "Ａ\u0301" * 99, "Á" * 99]
    df = spark.createDataFrame([(k, "t", x) for k, x in enumerate(texts)], "id long, grp string, text string")
    got = {r["id"]: r["form"] for r in normalize.consistent(df, ["id"]).collect()}
    for k, x in enumerate(texts):
        assert got[k] == plain_form(x), (k, got[k][:20], plain_form(x)[:20])
    pairs = {tuple(r) for r in normalize.look_alike_pairs(df, "id", "grp", "text").collect()}
    assert pairs == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 5), (7, 8), (11, 12)}


def test_plain_range_is_stable():
    assert all(plain_form(chr(n)) == chr(n) for n in range(0xA1, 0x250) if n != 0xAD)


DETECTOR = pii.Detector(["anna", "josé"], ["weber", "ruiz"])
CASES = [
    ("Ask Anna Weber.", [("name", "Anna Weber")]),
    ("Dr. WEBER, Anna and A. Ruiz, José B. Ruiz", [("name", "WEBER, Anna"), ("name", "A. Ruiz"), ("name", "José B. Ruiz")]),
    ("Anna wrote to weber@home, Weber GmbH", []),
    ("mailto:a.b+c@mail.host.example, (x (at) host (dot) test) x@y", [("email", "a.b+c@mail.host.example"), ("email", "x (at) host (dot) test")]),
    ("аnna Wеbеr", [("name", "аnna Wеbеr")]),
    ("call +44 7700 900123 or (212) 555-0100, tel:01 99 00 11 22; build 925-123-885", [("phone", "+44 7700 900123"), ("phone", "(212) 555-0100"), ("phone", "01 99 00 11 22")]),
    ("> call +49 30\n> 23125 098 now", [("phone", "+49 30\n> 23125 098")]),
    ("zero three zero five five five one two three four", [("phone", "zero three zero five five five one two three four")]),
    ("SSN 900-11-2222, card 4000 0000 0000 0002, no card 4000 0000 0000 0003", [("id", "900-11-2222"), ("id", "4000 0000 0000 0002")]),
    ("IBAN DE89 3704 0044 0532 0130 00 not DE88 3704 0044 0532 0130 00", [("id", "DE89 3704 0044 0532 0130 00")]),
    ("passport no. K12L34M56, voucher K12L34M56", [("id", "K12L34M56")]),
    ("at 12 Green Hill Road, Flat 2, Oxtown; Lindenweg 5a, 12345 Ort; 3 bis rue de Lune, 75001 Ville; Calle Sol 7", [("address", "12 Green Hill Road, Flat 2, Oxtown"), ("address", "Lindenweg 5a, 12345 Ort"), ("address", "3 bis rue de Lune, 75001 Ville"), ("address", "Calle Sol 7")]),
    ("", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_mentions(text, want):
    assert [(k, text[a:b]) for k, a, b in DETECTOR.spans(text)] == want


@pytest.mark.parametrize("text, want", [
    ("pay GB82 WEST 1234 5698 7654 32 now", [("id", "GB82 WEST 1234 5698 7654 32")]),
    ("NL91ABNA0417164300 and NL91 ABNA 0417 1643 00", [("id", "NL91ABNA0417164300"), ("id", "NL91 ABNA 0417 1643 00")]),
    ("IT60 X054 2811 1010 0000 0123 456.", [("id", "IT60 X054 2811 1010 0000 0123 456")]),
    ("FR14 2004 1010 0505 0001 3M02 606", [("id", "FR14 2004 1010 0505 0001 3M02 606")]),
    ("MT84 MALT 0110 0001 2345 MTLC AST0 01S", [("id", "MT84 MALT 0110 0001 2345 MTLC AST0 01S")]),
    ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", [("id", "DE89 3704 0044 0532 0130 00"), ("id", "GB82 WEST 1234 5698 7654 32")]),
    ("not GB83 WEST 1234 5698 7654 32", []),
    ("US12 ABCD 4000 0000 0000 0002", [("id", "4000 0000 0000 0002")]),
    ("ring +352 27 12 34 or (030) 123456 or 030 123456, tel: 0221 1234", [("phone", "+352 27 12 34"), ("phone", "(030) 123456"), ("phone", "030 123456"), ("phone", "0221 1234")]),
    ("open 0930-1045, build 0012 3456, order 00123456", []),
    ("> call +49 30 1234\n> 5678 now", [("phone", "+49 30 1234\n> 5678")]),
])
def test_ibans_with_letters_and_short_phones(text, want):
    assert [(k, text[a:b]) for k, a, b in DETECTOR.spans(text)] == want


def test_mentions_in_tables(spark):
    people = spark.createDataFrame([("Anna Weber",), ("Ruiz, Anna",), (None,), ("build bot",), ("José Ruiz",), ("José Weber",)], "author string")
    names = pii.name_gazetteer(people, "author")
    assert {tuple(r) for r in names.collect()} == {("anna", True), ("josé", True), ("weber", False), ("ruiz", False)}
    df = spark.createDataFrame([(1, "I met Anna Ruiz, a@b.example", 0)] * 2 + [(2, None, 0), (3, "", 0), (None, "Anna Ruiz", 0), (4, "x " * 50_000 + "Anna Ruiz", 0)], "id long, body string, kind int")
    assert {tuple(r) for r in pii.mentions(df, "id", "body", names).collect()} == {(1, "name", 6, 15), (1, "email", 17, 28), (4, "name", 100_000, 100_009)}
    out = {r["rec_id"]: r["masked"] for r in pii.masked(df, "id", "body", names).collect()}
    assert out[1] == "I met [NAME], [EMAIL]" and out[3] == "" and len(out) == 3
    assert pii.mentions(df.limit(0), "id", "body", names).count() == 0


def test_blocks_of_names_change_nothing(spark, monkeypatch):
    people = spark.createDataFrame([(f"{g} {f}",) for g in ("Anna", "José", "Kim") for f in ("Weber", "Ruiz", "Kim")], "author string")
    texts = ["at 12 Anna Weber Road", "Weber, Anna; KIM RUIZ and Anna Kim", "J. Ruiz, Ruiz J., kim kim@x.example", "no one", "", "Anna\u200b Weber " * 3]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id long, body string")
    gazetteer = pii.name_gazetteer(people, "author")
    one = {tuple(r) for r in pii.mentions(df, "id", "body", gazetteer).collect()}
    shown = {tuple(r) for r in pii.masked(df, "id", "body", gazetteer).collect()}
    monkeypatch.setattr(pii, "BLOCK", 1)
    assert {tuple(r) for r in pii.mentions(df, "id", "body", gazetteer).collect()} == one and {tuple(r) for r in pii.masked(df, "id", "body", gazetteer).collect()} == shown
    assert (0, "address", 3, 21) in one and sum(x[0] == 5 for x in one) == 3


def test_many_mentions_in_linear_time():
    import time

    def took(n):
        text = "Write a.b@c.example or Anna Weber, +44 7700 900123. " * n
        began = time.perf_counter()
        assert len(DETECTOR.spans(text)) == 3 * n
        return time.perf_counter() - began

    took(100)
    assert took(4000) < 12 * took(1000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4), st.lists(st.sampled_from("abcd"), max_size=16), st.integers(1, 4))
def test_suffix_automaton(sources, words, least):
    machine = mail.SuffixAutomaton()
    for s in sources:
        machine.add(s)
    want = [False] * len(words)
    for a in range(len(words)):
        for b in range(a + least, len(words) + 1):
            if any(words[a:b] == s[k : k + b - a] for s in sources for k in range(len(s))):
                want[a:b] = [True] * (b - a)
    assert list(machine.inherited(words, least)) == want


MAIL = """Hi Bo,

From: the desk there is no objection.
On Monday the team wrote: keep it.
---
After that we go on.

> an old line
>
my answer

Best regards,
Anna
-- 
Anna Weber
Tel: 030/1234567

This message and its attachments are meant only for the addressee.
Do not keep it.

On Tue, 5 May 2026 at 10:11,
Bo Ruiz <bo@ruiz.example> wrote:
> older

Sent from my phone
-----Original Message-----
From: Cy
Sent: now
whatever follows"""


def test_mail_forms():
    old = [k + 1 for k, x in enumerate(mail.classify(MAIL, "Weber, Anna")) if x]
    assert old == [8, 9, 12, 13, 14, 15, 16, 18, 19, 21, 22, 23, 25, 26, 27, 28, 29]
    assert mail.classify("", None) == [False] and mail.classify("a\n\nb", None) == [False] * 3


def test_mail_threads(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choice(["river", "stone", "cloud", "maple", "ember", "quartz", "harbor"]) + str(rng.randrange(99)) for _ in range(40))
    wrapped = "\n".join(textwrap.wrap(passage, 50))
    rows = [(1, "t", "Bo", f"Look: {passage} and more of my own words about it", "web"), (2, "t", "Anna", f"my own line\n{wrapped}\nanother one of mine that nobody wrote before\nand yet one more line here with words\n" + "so it goes on and on with fresh text number\n" * 1, "email"), (3, "u", "Cy", wrapped, "email"), (4, None, None, "x", "email"), (5, "t", "D", None, "email"), (6, "t", "D", "", "email")]
    df = spark.createDataFrame(rows + rows[1:2], "comment_id long, ticket_key string, author string, body string, channel string").withColumn("id", F.lit("clash"))
    out = {r["id"]: r for r in mail.newly_written(df).collect()}
    assert set(out) == {2, 3, 4, 6}
    lines = len(wrapped.split("\n"))
    assert set(range(3, lines + 1)) <= set(out[2]["old_lines"]) and 1 not in out[2]["old_lines"] and out[2]["new_text"].startswith("my own line")
    assert out[3]["old_lines"] == [] and out[6]["old_lines"] == []
    assert mail.old_lines(df.limit(0)).count() == 0


def test_short_answers_to_long_quotations():
    one, two = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    old = lambda body, *sources: mail.classify(body, "Anna", list(sources))
    assert old(f"Thanks, agreed.\n{one}", one, two) == [False, True]
    assert old(f"{one}\n{two}\nThanks, agreed.", one, two) == [True, True, False]
    assert old(f"{one}\n{two}", one, two) == [True, True]
    assert old(one, f"before {one} after", two) == [False]


def test_reasons(spark):
    """Inherited runs without any form, runs of several first messages, own earlier words, and endings that recur."""
    word = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    sign = "Anna W\nDesk 7 in the long hall"
    rows = [
        (1, "t", "Bo", f"first {word('a')} end", "web"), (2, "t", "Bo", f"{word('a')} {word('b')}", "web"), (3, "t", "Anna", f"short answer\n{word('a')} {word('b')}", "email"), (4, "t", "Anna", f"mine again\n{word('a')}\nnew words below", "email"),
        *((10 + k, f"u{k}", name, f"Text number {k} is new.\nMore of it {k}.\n\n{sign}\n> quoted", "email") for k, name in enumerate(["Anna W", "W, Anna", "anna w"])),
        (20, "v", "Anna W", sign, "email"), (21, "v", "Cy", f"Other text.\n\n{sign}", "email"),
    ]
    df = spark.createDataFrame(rows, "comment_id long, ticket_key string, author string, body string, channel string").withColumn("why", F.lit(1)).withColumn("line_no", F.lit("x"))
    got = {(r["id"], r["line_no"]): r["why"] for r in mail.line_reasons(df).collect()}
    assert got == {(3, 2): "inherited", (4, 2): "inherited"} | {(10 + k, j): "ending" for k in range(3) for j in (4, 5)} | {(10 + k, 6): "form" for k in range(3)} | {(20, 2): "ending"}


def test_short_inherited_runs(spark):
    """Runs of 14 words, of short words or in short mails."""
    rng = random.Random(8)
    rows, want = [], set()
    for k in range(200):
        run = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 4, 5]))) for _ in range(14))
        pad = " ".join(f"p{rng.randrange(10**6)}" for _ in range(rng.choice([0, 40])))
        own = "\n".join(f"own{rng.randrange(10**6)} word{rng.randrange(10**6)} of mine" for _ in range(8))
        rows += [(2 * k, f"t{k % 9}", "Bo", f"{pad} {run} {pad}", "web"), (2 * k + 1, f"t{k % 9}", "Anna", f"{own}\n{run}", "email")]
        want.add((2 * k + 1, 9))
    df = spark.createDataFrame(rows, "comment_id long, ticket_key string, author string, body string, channel string")
    assert {tuple(r) for r in mail.old_lines(df).collect()} == want


def test_leaks(spark):
    rng = random.Random(3)
    words = lambda n: [f"{rng.choice('abcdefg')}{rng.randrange(400)}" for _ in range(n)]
    items = [words(30) for _ in range(20)] + [words(5)]
    docs = []
    for k in range(60):
        w = words(80)
        i = items[rng.randrange(len(items))]
        n = rng.choice([10, 12, 13, 14, 25])
        a = rng.randrange(max(1, len(i) - n + 1))
        w[20:20] = i[a : a + n]
        docs.append(w)
    same = [(k, "; ".join(x).upper()) for k, x in enumerate(docs)]
    d = spark.createDataFrame([*same, *same[:3], (1000, None), (1001, ""), (None, same[0][1])], "doc_id long, text string").withColumn("item_id", F.lit(7))
    i = spark.createDataFrame([*((k, " ".join(x)) for k, x in enumerate(items)), (500, None), (501, "")], "item_id long, text string")
    grams = lambda w: {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    want = {(a, b) for a, x in enumerate(docs) for b, y in enumerate(items) if grams(x) & grams(y)}
    assert want and {tuple(r) for r in leak.leaked_documents(d, i).collect()} == want
    assert leak.leaked_documents(d.limit(0), i).count() == 0 and leak.leaked_documents(d, i.limit(0)).count() == 0


def test_leaks_with_edits_and_blocks(spark, monkeypatch):
    item = "the quick keeper of the northern archive counted every copper lantern before the winter fair began again"
    edited = item.replace("copper", "coper")
    d = spark.createDataFrame([(1, "noise before " + edited + " noise after"), (2, "nothing of it at all " * 9)], "doc_id long, text string")
    i = spark.createDataFrame([(1, item), (2, "one more item that is nowhere " * 4)], "item_id long, text string")
    monkeypatch.setattr(leak, "BLOCK", 10)
    assert {(r["doc_id"], r["item_id"]) for r in leak.leaked_passages(d, i, least_words=15, max_edits=1).collect()} == {(1, 1)}
    assert leak.banded_alignment("abcdefgh", "abcdxefgh", 2)[0] == 8


def test_leaks_at_the_start_and_in_parts(spark):
    rng = random.Random(6)
    words = lambda n: [f"{rng.choice('abcdefg')}{rng.randrange(1000)}" for _ in range(n)]
    head, body, left, middle, right = words(30), words(24), words(19), words(4), words(19)
    late = " ".join(body[:12] + ["x" + body[12]] + body[13:])
    parts = " ".join(left + words(4) + right)
    d = spark.createDataFrame([(1, late), (2, f"noise {parts} noise")], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(head + body)), (2, " ".join(left + middle + right))], "item_id long, text string")
    got = leak.leaked_passages(d, i, least_words=20, max_edits=1).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2)}
    assert len({r["start_word"] for r in got if r["doc_id"] == 2}) >= 2
    assert leak.stretches("abcdefghij", "abcdxefghij", 2, 8, 1) == [(0, 10)] and leak.least_edits("abcdefghij", "abcdxefghij", 2) == 1
