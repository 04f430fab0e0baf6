"""One consistent form for texts that look the same but differ in their characters.

Texts of plain Latin letters are in that form already.  Of the others, the runs that hold anything else are exploded to
positioned code points; a broadcast join gives each code point its decomposition, its look-alike in Latin script,
the common blank, or nothing (invisible characters); combining marks are ordered by class, composed again, and the
runs put back between the plain ones.  Every exploded row of a text stays in one partition, by one exchange of the
texts that need it; no text is ever held by more than its own task.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored

#: Letters of Cyrillic, Greek, Armenian and Cherokee script, and Roman numerals, that look like a Latin letter.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}

#: Compatibility decompositions that change how a letter is encoded, not what it shows.
FOLDED_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Invisible characters outside the category of format characters.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"

#: Plain code points: ASCII, line feed, and the Latin letters and signs that stay as they are unless a mark follows.
_PLAIN = r" -~\n\u00a1-\u00ac\u00ae-\u024f"
_ODD = rf"[^{_PLAIN}]"
#: What may belong to the code point before it: marks, invisible characters, Korean vowels and finals.
_JOINS = rf"\p{{M}}\p{{Cf}}\u1160-\u11ff{INVISIBLE}\uff9e\uff9f"
#: Code points of their own in a run that is handled at once; a longer run is cut between two of them.
_RUN = 32
_SEGMENT = rf"([{_PLAIN}]*[{_PLAIN}](?!{_ODD})|[{_PLAIN}]?[{_JOINS}]*(?:[^{_PLAIN}{_JOINS}][{_JOINS}]*){{1,{_RUN}}}|[{_PLAIN}]?[{_JOINS}]+)"


def _one(ch: str) -> str:
    """What a code point becomes, fully decomposed."""
    if ch in INVISIBLE or (unicodedata.category(ch) == "Cf" and not 0x600 <= ord(ch) <= 0x605):
        return ""
    if unicodedata.category(ch) == "Zs" or ch == "\t":
        return " "
    if ch in "\u0085  ":
        return "\n"
    if 0xAC00 <= ord(ch) <= 0xD7A3:  # syllables decompose by rule, not by the table
        return unicodedata.normalize("NFD", ch)
    tag, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    if rest and (not tag or tag + ">" in FOLDED_TAGS):
        return "".join(_one(chr(int(x, 16))) for x in rest.split())
    return LOOK_ALIKES.get(ch, ch)


@cache
def _tables() -> tuple[list[tuple[str, list[tuple[str, int]]]], list[tuple[str, str]]]:
    """Code points that change or combine, with their parts and combining classes; and pairs that compose."""
    parts, pairs = [], []
    for n in range(0x80, 0x110000):
        ch = chr(n)
        if 0xD800 <= n < 0xE000 or unicodedata.category(ch) == "Cn":
            continue
        to = _one(ch)
        if to != ch or unicodedata.combining(ch):
            parts.append((ch, [(x, unicodedata.combining(x)) for x in to]))
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            pairs.append(("".join(chr(int(x, 16)) for x in d.split()), ch))
    return [("\t", [(" ", 0)]), *parts], pairs


def mapping(spark: SparkSession) -> DataFrame:
    """``ch, parts``: a few thousand rows, fixed by the Unicode tables."""
    return spark.createDataFrame(_tables()[0], "ch string, parts array<struct<c string, ccc int>>")


def _composed(points: Column) -> Column:
    """The string of code points in order ``(p, i, c, ccc)``: marks sorted by class behind their base, then composed."""
    table = F.from_json(F.lit(json.dumps(dict(_tables()[1]))), "map<string,string>")  # folded to one literal
    # Canonical order: marks sort by class within the run of marks behind a base.
    starts = F.filter(F.transform(points, lambda x, i: F.when(x["ccc"] == 0, i)), lambda i: i.isNotNull())  # few: a run is short
    based = F.array_sort(F.transform(points, lambda x, i: F.struct(F.size(F.filter(starts, lambda k: k <= i)).alias("base"), x["ccc"].alias("ccc"), i.alias("at"), x["c"].alias("c"))))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.when((x["ccc"] > 0) & (acc["base"] != "") & (acc["last"] < x["ccc"]), F.element_at(table, F.concat(acc["base"], x["c"])))
        fresh = F.struct(F.concat(acc["done"], acc["base"], acc["marks"]).alias("done"), x["c"].alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))
        more = F.struct(acc["done"].alias("done"), acc["base"].alias("base"), F.concat(acc["marks"], x["c"]).alias("marks"), x["ccc"].alias("last"))
        taken = F.struct(acc["done"].alias("done"), joined.alias("base"), acc["marks"].alias("marks"), acc["last"].alias("last"))
        return F.when(x["ccc"] == 0, fresh).when(joined.isNotNull(), taken).otherwise(more)

    return F.aggregate(based, start, step, lambda acc: F.concat(acc["done"], acc["base"], acc["marks"]))


_KOREAN = "[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?"


def _syllables(run: Column) -> Column:
    """Korean initials, vowels and finals to syllables, by their numbers."""
    number = lambda x, k, first: F.ascii(F.substring(x, k, 1)) - first

    def one(x: Column) -> Column:
        final = F.when(F.length(x) == 3, number(x, 3, 0x11A7)).otherwise(0)
        code = (number(x, 1, 0x1100) * 21 + number(x, 2, 0x1161)) * 28 + final + 0xAC00
        return F.when(x.rlike(f"^{_KOREAN}$"), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(x)

    parts = F.regexp_extract_all(run, F.lit(f"({_KOREAN}|(?s:.))"), 1)
    return F.when(run.rlike(_KOREAN), F.array_join(F.transform(parts, one), "")).otherwise(run)


def with_line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def consistent(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys..., text, form`` for each distinct row: the consistent form of its text.

    Null texts have a null form, empty ones an empty form; keys may be null and may repeat with different texts.
    """
    named = [f"k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col(text_col).alias("text")).distinct()
    base = base.withColumn("lf", with_line_feeds("text"))
    odd = F.coalesce(F.col("lf").rlike(_ODD), F.lit(False))
    plain = base.filter(~odd).select(*named, "text", F.col("lf").alias("form"))

    one = [*named, "h"]
    texts = base.filter(odd).withColumn("h", F.md5(F.concat_ws("\u0000", *[F.coalesce(F.col(n).cast("string"), F.lit("\u0001")) for n in named], "text"))).repartition("h")
    segments = texts.select("h", F.posexplode(F.regexp_extract_all("lf", F.lit(_SEGMENT), 1)).alias("k", "segment"))
    points = segments.select("h", "k", F.when(F.col("segment").rlike(_ODD), F.split("segment", "")).otherwise(F.array("segment")).alias("chars"))
    points = points.select("h", "k", F.posexplode("chars").alias("p", "ch"))
    mapped = points.join(F.broadcast(mapping(df.sparkSession)), "ch", "left").withColumn("parts", F.coalesce("parts", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc")))))
    placed = mapped.groupBy("h", "k").agg(F.array_sort(F.collect_list(F.struct("p", "parts"))).alias("points"))
    # One run at a time: the parts of its code points in order, as one list.
    flat = F.flatten(F.transform("points", lambda x: x["parts"]))
    runs = placed.select("h", "k", _syllables(F.when(F.exists(flat, lambda x: x["ccc"] > 0), _composed(flat)).otherwise(F.array_join(F.transform(flat, lambda x: x["c"]), ""))).alias("run"))
    forms = runs.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("k", "run"))).alias("runs")).select("h", F.array_join(F.transform("runs", lambda x: x["run"]), "").alias("form"))
    changed = texts.join(forms, "h").select(*named, "text", "form")
    out = plain.union(changed)
    return out.select(*[F.col(n).alias(k) for n, k in zip(named, keys)], "text", "form")


def look_alike_pairs(df: DataFrame, id_col: str, group_col: str, text_col: str) -> DataFrame:
    """``id_a < id_b`` with the same non-null group whose texts have one consistent form but differ, distinct.

    Equal texts are grouped first, so that copies meet only in pairs that are in the result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.col(text_col).alias("text")).filter("id is not null and grp is not null and text is not null")
    digest = lambda c: F.unhex(F.md5(F.concat_ws("\u0000", F.col("grp").cast("string"), c)))
    forms = stored(consistent(rows, ["id", "grp"]).select("id", digest("form").alias("form"), digest("text").alias("exact")))
    several = forms.groupBy("form").agg(F.min("exact").alias("a"), F.max("exact").alias("b")).filter("a <> b").select("form")
    some = forms.join(several, "form", "left_semi")
    kinds = some.select("form", "exact").distinct()
    pairs = kinds.select("form", F.col("exact").alias("ea")).join(kinds.select("form", F.col("exact").alias("eb")), "form").filter("ea <> eb").select("ea", "eb")
    ids = some.select("id", "exact")
    return pairs.join(ids.select(F.col("id").alias("id_a"), F.col("exact").alias("ea")), "ea").join(ids.select(F.col("id").alias("id_b"), F.col("exact").alias("eb")), "eb").filter("id_a < id_b").select("id_a", "id_b").distinct()
