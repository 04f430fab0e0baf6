"""Ticket briefs: from heads and comments to one fixed record for each ticket and level.

Everything is a plan over rows (sources, blocks, extracts): a ticket with a third of all comments is spread like any
other.  Only the record itself, which is one row by definition, is gathered at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import clean, dedup, graph, intask, marks
from ..operators.store import drop, drop_since, mark, seen, stored

#: Sources in the first batch of a ticket that is searched for near-duplicates; each batch after it is twice as large.
_BATCH = 4096
#: Parts of a ticket that its short criteria or constraints are compared with one by one.
_SHARES = 16
#: Constraints times criteria of a ticket that are compared one by one in a task.
_PAIRS = 100_000_000
LISTS = ["architecture", "decisions", "constraints", "acceptanceCriteria", "risks", "todos", "dependencies"]
_CATEGORY = {"decisions": "DECISION", "constraints": "CONSTRAINT", "acceptanceCriteria": "ACCEPTANCE_CRITERIA", "risks": "RISK", "todos": "TODO", "dependencies": "DEPENDENCY"}


def _at(*parts) -> Column:
    """A place in order: numbers compared one after another."""
    return F.array(*[F.col(x).cast("long") if isinstance(x, str) else F.lit(x).cast("long") for x in parts])


def _is_ascii(text: str) -> Column:
    return F.octet_length(text) == F.length(text)


def _weights() -> Column:
    return F.create_map(*[x for k, v in vocab.WEIGHTS.items() for x in (F.lit(k), F.lit(v))])


def _levels(names: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(vocab.LEVELS[k]).alias("threshold")) for k in names]))


def unique_texts(items: DataFrame) -> DataFrame:
    """``g, n, text`` of items (``n`` a place) that say something new in their group, longer wordings in place of shorter near-duplicates.

    Texts meet in a slot only if near-duplicates link them, so that each linked set of a group folds on its own.
    """
    keys = items.select("g.*").columns
    items = stored(items.withColumn("form", T.normal_form(F.col("text"))).select("g.*", "n", "text", "form"))
    small, large = intask.split_by_size(items, keys, "text")
    nested = lambda d: d.select(F.struct(*keys).alias("g"), "n", "text")
    out = nested(intask.unique_texts(small, keys))
    return out if large is None else out.unionByName(_unique_by_joins(stored(large.select(F.struct(*keys).alias("g"), "n", "text", "form"))))


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf.assign(n=pdf["n"].map(tuple)).sort_values(["n", "text"])
    texts = rows["text"].tolist()
    forms = rows["form"].tolist()
    slots = intask.fold(list(range(len(texts))), texts, forms, intask.linked(list(dict.fromkeys(forms))))
    return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(slots), "n": [list(rows["n"].iloc[i]) for i, _ in slots], "text": [texts[j] for _, j in slots]})


def _unique_by_joins(items: DataFrame) -> DataFrame:
    """``unique_texts`` for groups of any size."""
    reps = stored(items.groupBy("g", "form").agg(F.min("n").alias("n")))
    edges = stored(dedup.near_edges(reps.select("g", "n", "form")))
    node = lambda c: F.struct("g", F.col(c).alias("n"))
    roots = graph.components(edges.select(node("a").alias("a"), node("b").alias("b")), "a", "b").select(F.col("node.g").alias("g"), F.col("node.n").alias("n"), F.col("root.n").alias("root"))
    marked = stored(reps.join(roots, ["g", "n"], "left").select("g", "form", F.col("root")))
    rows = items.join(marked, ["g", "form"])
    fields = rows.select("g", "n", "text").schema
    # A form that no other is linked to keeps the first of its longest wordings, however often it is repeated.
    alone = rows.filter("root is null").groupBy("g", "form").agg(F.min("n").alias("n"), F.min_by("text", F.struct(-T.utf16_length(F.col("text")), "n")).alias("text"))
    folded = rows.filter("root is not null").select("g", "root", "n", "text", "form").groupBy("g", "root").applyInPandas(_fold, fields)
    return alone.select("g", "n", "text").union(folded)


#: The stages of the standard plan in order.
STAGES = ["html_cleaning", "noise_filter", "block_splitting", "duplicate_detection", "decision_extraction", "acceptance_criteria_extraction", "todo_extraction", "risk_extraction", "ranking", "assembly"]
#: The lists that an extraction stage fills.
_FILLS = {"decision_extraction": ["decisions"], "acceptance_criteria_extraction": ["acceptanceCriteria", "constraints"], "todo_extraction": ["todos"], "risk_extraction": ["risks", "dependencies"]}


def no_compressor(records: DataFrame) -> DataFrame:
    """The records as they are."""
    return records


@dataclass
class Stage:
    """A step of one's own over a table of the plan: ``sources``, ``blocks``, ``kept``, ``extracts``, ``tags`` or ``records``."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    table: str = "kept"


class Briefs:
    """The plan over ``heads`` (doc, key, title, description, linked; doc unique) and ``comments`` (doc, no from 1, author,
    body, bot), step by step.

    Nulls count as empty; tickets without comments or text get a brief too; comments without a ticket are ignored;
    empty tables give an empty result.  ``stages`` is the plan as a list of names (``STAGES`` by default) and stages of
    one's own: what is left out isn't done, cleaning and filtering go in the order given, extraction that comes before
    the duplicates are detected sees them too, and ranking counts what was extracted before it.  ``block_stages`` are
    further ones, ``compressor`` is applied to the finished records.  ``known`` says that all comments have a ticket.
    """

    def __init__(
        self, heads: DataFrame, comments: DataFrame, levels: list[str] | None = None, block_stages: list[Stage] | None = None,
        compressor: Callable[[DataFrame], DataFrame] = no_compressor, stages: list[str | Stage] | None = None, known: bool = False,
    ):
        empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        self.heads = heads.select("doc", empty("key"), empty("title"), empty("description"), empty("linked")).filter("doc is not null")
        said = comments.filter("doc is not null")
        self.comments = (said if known else said.join(self.heads.select("doc"), "doc", "left_semi")).select("doc", "no", "author", "body", "bot")
        self.levels, self.compressor = levels or list(vocab.LEVELS), compressor
        every = [*(STAGES if stages is None else stages), *(block_stages or [])]
        self.stages, self.own = [x for x in every if isinstance(x, str)], [x for x in every if isinstance(x, Stage)]
        if (wrong := [x for x in self.stages if x not in STAGES] + [x.table for x in self.own if x.table not in ("sources", "blocks", "kept", "extracts", "tags", "records")]) or len(set(self.stages)) < len(self.stages):
            raise ValueError(f"unknown or repeated stages: {wrong or self.stages}")
        at = {x: k for k, x in enumerate(self.stages)}
        for first, then in [("html_cleaning", "block_splitting"), ("noise_filter", "block_splitting"), *[("block_splitting", x) for x in STAGES[3:9]], *[(x, "assembly") for x in STAGES[:9]]]:
            if first in at and then in at and at[first] > at[then]:
                raise ValueError(f"{first} must come before {then}")

    def _before(self, first: str, then: str) -> bool:
        return first in self.stages and (then not in self.stages or self.stages.index(first) < self.stages.index(then))

    def _with_own(self, table: str, df: DataFrame) -> DataFrame:
        for stage in self.own:
            if stage.table == table:
                df = stage.apply(df)
        return stored(df)

    @property
    def _counts(self) -> bool:
        """Whether sources have the lengths of the raw texts; those that a stage of one's own makes don't."""
        return not any(x.table == "sources" for x in self.own)

    @cached_property
    def sources(self) -> DataFrame:
        rows = clean.raw_sources(self.heads, self.comments)
        if self._counts:
            rows = rows.withColumn("chars", T.utf16_length(F.col("text")).cast("long"))
        for x in self.stages:
            rows = clean.cleaned(rows, "text") if x == "html_cleaning" else clean.with_reason(rows) if x == "noise_filter" else rows
        return self._with_own("sources", rows)

    @property
    def _other_texts(self) -> bool:
        """Whether stages of one's own may change the paragraphs."""
        return any(x.table in ("blocks", "kept") for x in self.own)

    def _marked(self, rows: DataFrame) -> DataFrame:
        """``blocks`` or ``kept`` with their marks."""
        if self._other_texts:
            return marks.marked(rows)
        return self._collapsed if rows is self.blocks else self._collapsed.filter("n = kept_by")

    @cached_property
    def _collapsed(self) -> DataFrame:
        """``blocks`` with ``times``, how often a kept paragraph was said, and their marks."""
        live = self.sources.filter("reason is null").select("doc", "no", F.posexplode(T.blocks(F.col("text"))).alias("k", "text"))
        rows = live.select(F.col("doc").alias("g"), _at("no", "k").alias("n"), "no", "k", "text", T.normal_form(F.col("text")).alias("form"), F.floor(F.log2(F.col("no") / _BATCH + 1)).cast("int").alias("batch"))
        before = mark()
        rows = stored(rows if "block_splitting" in self.stages else rows.filter(F.lit(False)))
        rows = dedup.collapse(rows) if "duplicate_detection" in self.stages else rows.drop("batch", "form").withColumns({"kept_by": F.col("n"), "times": F.lit(1).cast("long")})
        rows = rows.withColumnRenamed("g", "doc")
        out = stored(rows if self._other_texts else marks.marked(rows))
        drop_since(before, out)  # the same paragraphs without what keeps them
        return out

    @cached_property
    def blocks(self) -> DataFrame:
        """``doc, n, no, k, text, kept_by``: paragraphs by their places ``n`` (source and paragraph), and the first kept
        near-duplicate of each."""
        out = seen(self._collapsed.select("doc", "n", "no", "k", "text", "kept_by"), self._collapsed)
        return self._with_own("blocks", out) if any(x.table == "blocks" for x in self.own) else out

    @cached_property
    def kept(self) -> DataFrame:
        """``doc, n, no, k, text, times``: kept paragraphs with the number of times they were said."""
        columns = ["doc", "n", "no", "k", "text", "times"]
        if not self._other_texts:
            return seen(self._collapsed.filter("n = kept_by").select(columns), self._collapsed)
        times = self.blocks.groupBy("doc", F.col("kept_by").alias("n")).agg(F.count("*").alias("times"))
        return self._with_own("kept", self.blocks.filter("n = kept_by").join(times, ["doc", "n"]).select(columns))

    @cached_property
    def _read(self) -> DataFrame:
        """The paragraphs that extraction looks at: all of them if some extraction comes before duplicates are detected."""
        return self.blocks if any(self._before(x, "duplicate_detection") for x in _FILLS) and "duplicate_detection" in self.stages else self.kept

    def _seen(self, rows: DataFrame, stage: str) -> DataFrame:
        """Of rows from ``_read`` those that a stage sees."""
        if stage not in self.stages:
            return rows.filter(F.lit(False))
        return rows if self._read is self.kept or self._before(stage, "duplicate_detection") else rows.join(self.kept.select("doc", "n"), ["doc", "n"], "left_semi")

    @cached_property
    def sentences(self) -> DataFrame:
        """``doc, n, j, text`` of kept paragraphs' sentences that say something, with a column for each thing that they may say."""
        rows = self._marked(self._read).select("doc", "n", F.explode("said").alias("x")).select("doc", "n", "x.*")
        again = T.cues(F.col("text"))
        rows = rows.select("doc", "n", "j", "text", *[(F.col(k) & (_is_ascii("text") | again[k])).alias(k) for k in T.CUES]).filter(" or ".join(T.CUES))
        return stored(rows.select("doc", "n", "j", "text", *[c.alias(k) for k, c in T.said(F.col("text"), {k: F.col(k) for k in T.CUES}).items()]))

    @cached_property
    def extracts(self) -> DataFrame:
        """``doc, n, j, list, category, text``, j being the sentence of the paragraph, or the place among its criteria;
        constraints that an earlier or own criterion covers are out."""
        names = list(_CATEGORY)
        each = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in names if f != "acceptanceCriteria"]), lambda x: x.isNotNull())
        rows = self.sentences.select("doc", "n", "j", F.explode(each).alias("list"), "text").withColumn("text", F.when(F.col("list") == "todos", T.without_label(F.col("text"))).otherwise(F.col("text")))
        held = self._marked(self._read).filter(F.col("listed") & T.may_hold_criteria(F.col("text"))).select("doc", "n", F.posexplode(F.concat(T.section_items(F.col("text")), T.scenarios(F.col("text")))).alias("j", "text"))
        rows = rows.union(held.select("doc", "n", "j", F.lit("acceptanceCriteria").alias("list"), "text"))
        category = F.create_map(*[F.lit(x) for pair in _CATEGORY.items() for x in pair])
        rows = rows.select("doc", "n", "j", "list", category[F.col("list")].alias("category"), "text")
        if self._read is not self.kept or not all(x in self.stages for x in _FILLS):
            parts = [self._seen(rows.filter(F.col("list").isin(names)), x) for x, names in _FILLS.items()]
            rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
        columns = rows.columns
        rows = stored(rows.withColumn("form", F.when(F.col("list").isin("acceptanceCriteria", "constraints"), T.normal_form(F.col("text")))))
        number = lambda f: F.count(F.when(F.col("list") == f, 1))
        many = rows.groupBy("doc").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"), (number("constraints") * number("acceptanceCriteria")).alias("pairs"))
        large = many.filter((F.col("rows") > intask.ROWS) | (F.col("chars") > intask.CHARS) | (F.col("pairs") > _PAIRS)).select("doc")
        if large.isEmpty():
            out = self._with_own("extracts", intask.uncovered(rows).select(columns))
            drop(rows)
            return out
        small, rows = rows.join(large, "doc", "left_anti"), stored(rows.join(large, "doc", "left_semi").select(rows.columns))
        criteria = stored(rows.filter("list = 'acceptanceCriteria'").groupBy("doc", "form").agg(F.min("n").alias("at")))
        limits = stored(rows.filter("list = 'constraints'"))
        rest = rows.filter("list <> 'constraints'").select(columns).union(limits.join(self._covered(limits, criteria), ["doc", "form", "n"], "left_anti").select(columns))
        return self._with_own("extracts", intask.uncovered(small).select(columns).union(rest))

    @cached_property
    def tags(self) -> DataFrame:
        """``doc, n, category`` of kept paragraphs: what was extracted from them, and parts of a system that a decision names."""
        counted = [x for x in _FILLS if "ranking" not in self.stages or self._before(x, "ranking")]
        lists = [f for x in counted for f in _FILLS[x]]
        built = self._seen(self.sentences.filter("architecture"), "decision_extraction" if "decision_extraction" in counted else "").select("doc", "n", F.lit("ARCHITECTURE").alias("category"))
        said = self.extracts.filter(F.col("list").isin(lists)).select("doc", "n", "category") if set(lists) != set(_CATEGORY) or any(x.table == "extracts" for x in self.own) else self.extracts.select("doc", "n", "category")
        return self._with_own("tags", said.union(built).distinct())

    @staticmethod
    def _covered(limits: DataFrame, criteria: DataFrame) -> DataFrame:
        """``doc, form, n`` of the constraints that contain, or are contained in, a criterion that stands at or before them.

        Forms of over ``T.CONTAINED`` characters meet by a word within the shorter one.  A ticket has few different forms
        shorter than that; they go to each of ``_SHARES`` shares of its other side.
        """
        forms = limits.groupBy("doc", "form").agg(F.max("n").alias("last"))
        each = forms.join(criteria.groupBy("doc").agg(F.min("at").alias("at")), "doc").filter("at <= last").select("doc", "form")
        size = lambda d, short: d.filter(F.length("form") <= T.CONTAINED if short else F.length("form") > T.CONTAINED)
        node = lambda d, c: d.select(F.col("doc").alias("g"), F.col("form").alias(c), "form")
        long_a, long_b = size(each, False), size(criteria, False)
        pairs = dedup.contained(node(long_a, "x"), node(long_b, "y")).select("g", F.col("x").alias("form"), F.col("y").alias("ac"))
        pairs = pairs.union(dedup.contained(node(long_b, "x"), node(long_a, "y")).select("g", F.col("y").alias("form"), F.col("x").alias("ac")))
        share = lambda c: F.pmod(F.xxhash64(c), F.lit(_SHARES))
        shares = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SHARES - 1).cast("long"))).alias("share")
        some = size(criteria, True).select(F.col("doc").alias("g"), F.col("form").alias("ac"), shares)
        pairs = pairs.union(each.select(F.col("doc").alias("g"), "form", share("form").alias("share")).join(some, ["g", "share"]).filter("contains(form, ac) or contains(ac, form)").select("g", "form", "ac"))
        some = size(each, True).select(F.col("doc").alias("g"), "form", shares)
        pairs = pairs.union(long_b.select(F.col("doc").alias("g"), F.col("form").alias("ac"), share("form").alias("share")).join(some, ["g", "share"]).filter("contains(ac, form)").select("g", "form", "ac"))
        first = pairs.join(criteria.select(F.col("doc").alias("g"), F.col("form").alias("ac"), "at"), ["g", "ac"]).groupBy(F.col("g").alias("doc"), "form").agg(F.min("at").alias("at"))
        return limits.select("doc", "form", "n").join(first, ["doc", "form"]).filter("at <= n").select("doc", "form", "n").distinct()

    @cached_property
    def scored(self) -> DataFrame:
        """``doc, n, no, k, times, categories, score`` of kept paragraphs, with what a record needs of their texts: the issue
        ``keys`` in each, and the ``lead``, the first two sentences, of those of descriptions."""
        said = self.tags.groupBy("doc", "n").agg(F.collect_set("category").alias("said"))
        t = F.col("text")
        lead = F.when(F.col("no") == 0, F.array_join(F.slice(T.sentences(t), 1, 2), " "))
        goal = F.col("goal") & (_is_ascii("text") | T.is_goal_block(t))
        kept = self._marked(self.kept).select("doc", "n", "no", "k", "times", goal.alias("goal"), (F.col("log") & T.is_log_dump(t)).alias("log"), F.when(F.col("keyed"), T.issue_keys(t)).alias("keys"), lead.alias("lead"))
        tags = F.array_compact(F.array(F.when(F.col("goal"), "BUSINESS_GOAL"), F.when(F.col("log"), "NOISE")))
        cats = F.concat(F.coalesce("said", F.array().cast("array<string>")), tags)
        rows = kept.join(said, ["doc", "n"], "left").withColumn("categories", F.array_sort(F.when(F.size(cats) == 0, F.array(F.lit("DISCUSSION"))).otherwise(cats))).drop("said", "goal", "log")
        weights = _weights()
        best = F.array_max(F.transform("categories", lambda c: F.element_at(weights, c)))
        score = F.when(F.array_contains("categories", "NOISE"), F.lit(vocab.WEIGHTS["NOISE"])).otherwise(F.least(F.lit(0.99), best + F.least(F.lit(0.10), (F.col("times") - 1) * 0.05)))
        return stored(rows.withColumn("score", score))

    @cached_property
    def lists(self) -> DataFrame:
        """``doc, field, n, text``: the entries of the record's lists before levels, without near-duplicates."""
        items = self.extracts.select(F.struct("doc", F.col("list").alias("field")).alias("g"), F.array(F.col("n")[0], F.col("n")[1], F.col("j").cast("long")).alias("n"), "text")
        before = mark()
        out = stored(unique_texts(items).select("g.doc", "g.field", "n", "text"))
        drop_since(before, out)
        return out

    @cached_property
    def live(self) -> DataFrame:
        """Paragraphs by level, those above its threshold."""
        rows = self.scored.select("*", _levels(self.levels).alias("l")).select("*", "l.level", "l.threshold").drop("l")
        return rows.filter("score >= threshold") if "ranking" in self.stages else rows

    def _architecture(self) -> DataFrame:
        """``doc, level, field, n, text``: sentences of live paragraphs that name parts of a system but decide nothing, without
        those that the decisions of the level say already.  The standard stages tag no such paragraph."""
        allowed = [k for k in self.levels if vocab.LEVELS[k] <= vocab.WEIGHTS["ARCHITECTURE"]]
        noted = self.live.filter(F.array_contains("categories", "ARCHITECTURE") & ~F.array_contains("categories", "DECISION") & F.col("level").isin(allowed))
        noted = noted.join(self.kept.select("doc", "n", "text"), ["doc", "n"])
        said = stored(noted.select("doc", "level", "n", F.posexplode(T.sentences(F.col("text"))).alias("j", "text")).withColumn("form", T.normal_form(F.col("text"))))
        decided = self.lists.filter("field = 'decisions'").select("doc", "n", T.normal_form(F.col("text")).alias("form"))
        both = said.select("doc", F.lit(0).alias("k"), "form").union(decided.select("doc", F.lit(1), "form")).distinct()
        edges = dedup.near_edges(both.groupBy("doc", "form").agg(F.min("k").alias("k"), F.max("k").alias("last")).select(F.col("doc").alias("g"), F.array(F.xxhash64("form"), "k").alias("n"), "form"))
        forms = both.select("doc", "form", F.xxhash64("form").alias("h"), "k")
        decisions = forms.filter("k = 1").select("doc", F.col("h").alias("d"))
        ends = edges.select(F.col("g").alias("doc"), F.col("a")[0].alias("h"), F.col("b")[0].alias("d")).union(edges.select("g", F.col("b")[0], F.col("a")[0]))
        close = ends.join(decisions, ["doc", "d"], "left_semi").select("doc", "h").union(decisions.select("doc", F.col("d"))).distinct()
        fresh = said.withColumn("h", F.xxhash64("form")).join(close, ["doc", "h"], "left_anti")
        out = unique_texts(fresh.select(F.struct("doc", "level").alias("g"), F.array(F.col("n")[0], F.col("n")[1], F.col("j").cast("long")).alias("n"), "text"))
        return out.select("g.doc", "g.level", F.lit("architecture").alias("field"), "n", "text")

    def _pieces(self) -> DataFrame:
        """``doc, levels, field, n, text``: everything that a record is made of, a row for all levels that have it."""
        at, names = ["doc", "level"], list(dict.fromkeys(self.levels))
        weight = F.create_map(*[x for f, c in _CATEGORY.items() for x in (F.lit(f), F.lit(vocab.WEIGHTS[c]))])
        allowed = F.array_compact(F.array(*[F.when(F.element_at(weight, F.col("field")) >= vocab.LEVELS[k], k) for k in names]))
        listed = self.lists.select("doc", allowed.alias("levels"), "field", "n", "text").filter(F.size("levels") > 0)
        summary = self.live.filter("no = 0").groupBy(*at).agg(F.min("n").alias("n"), F.min_by("lead", "n").alias("text")).select(*at, F.lit("summary").alias("field"), "n", "text")
        aims = self.sentences.filter("goal").select("doc", "n", "j", F.col("text").alias("aim"))
        goal = self.live.join(aims, ["doc", "n"]).groupBy(*at).agg(F.min("n").alias("n"), F.min_by("aim", F.struct("n", "j")).alias("text")).select(*at, F.lit("goal").alias("field"), "n", "text")
        keys = self.scored.select("doc", "score", "no", "k", F.posexplode("keys").alias("j", "text")).select("doc", "score", _at(1, "no", "k", "j").alias("n"), "text")
        always = F.lit(float("inf")).alias("score")
        in_title = self.heads.select("doc", F.posexplode(T.issue_keys(F.col("title"))).alias("k", "text")).select("doc", always, _at(0, "k").alias("n"), "text")
        linked = self.heads.filter(~T.is_blank(F.col("linked"))).select("doc", F.posexplode(F.split("linked", ",")).alias("k", "text")).select("doc", always, _at(2, "k").alias("n"), T.strip(F.col("text")).alias("text"))
        # A row a key for all levels: the first place that each level has.
        least = vocab.LEVELS if "ranking" in self.stages else dict.fromkeys(self.levels, float("-inf"))
        places = keys.union(in_title).union(linked).groupBy("doc", "text").agg(*[F.min(F.when(F.col("score") >= least[k], F.col("n"))).alias(k) for k in names])
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("n")) for k in names]))
        related = places.select("doc", "text", each.alias("l")).filter("l.n is not null").select("doc", "l.level", F.lit("related").alias("field"), "l.n", "text")
        noise = clean.noise_report(self.sources)
        twice = self.blocks.filter("n <> kept_by").groupBy("doc").count().select("doc", _at(5).alias("n"), F.concat(F.col("count").cast("string"), F.lit(" duplicate/near-duplicate paragraph(s) collapsed")).alias("text"))
        said = noise.union(twice).select("doc", F.array(*[F.lit(k) for k in names]).alias("levels"), F.lit("ignored").alias("field"), "n", "text")
        low = self.scored.select("doc", "score", _levels(self.levels).alias("l")).filter(F.col("score") < F.col("l.threshold")).groupBy("doc", "l.level").count()
        low = low.select(*at, F.lit("ignored").alias("field"), _at(6).alias("n"), F.concat(F.col("count").cast("string"), F.lit(" low-value paragraph(s) dropped below the "), F.lower("level"), F.lit(" threshold")).alias("text"))
        one = [summary, goal, related, *([low] if "ranking" in self.stages else []), *([self._architecture()] if self.own or "decision_extraction" not in self.stages else [])]
        out = listed.union(said)
        for x in one:
            out = out.union(x.select("doc", F.array("level"), "field", "n", "text"))
        return out

    @cached_property
    def records(self) -> DataFrame:
        """``doc, level`` and the fields of the record; architecture notes stay with the decisions and are empty."""
        made = self._pieces().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("field", "n", "text", "levels"))).alias("p"))
        texts = self.sources.filter("no > 0") if self._counts else self.comments.select("doc", T.utf16_length(F.coalesce("body", F.lit(""))).alias("chars"))
        raw = texts.groupBy("doc").agg(F.sum("chars").alias("chars"))
        heads = self.heads.select("doc", "key", "title", (T.utf16_length(F.col("title")) + T.utf16_length(F.col("description"))).alias("headChars"))
        rows = heads.join(made, "doc", "left").join(raw, "doc", "left").select("*", _levels(self.levels).alias("l")).select("*", "l.level").drop("l")
        of = lambda f: F.coalesce(F.transform(F.filter("p", lambda x: (x["field"] == f) & F.array_contains(x["levels"], F.col("level"))), lambda x: x["text"]), F.array().cast("array<string>"))
        first = lambda f: F.get(of(f), F.lit(0))
        rows = rows.withColumns({"issue": T.strip(F.concat("key", F.lit(" "), "title")), "summary": F.coalesce(first("summary"), "title"), "said": first("goal")})
        close = F.col("summary").contains(F.col("said")) | T.near_duplicate(T.normal_form(F.col("summary")), T.normal_form(F.col("said")))
        rows = rows.withColumn("businessGoal", F.when(F.col("said").isNull() | close, "").otherwise(F.col("said")))
        rows = rows.withColumns({f: of(f) for f in LISTS} | {"relatedIssues": F.array_remove(of("related"), F.col("key")), "ignoredContent": of("ignored")})
        points = F.lit(0.50) + F.when(~T.is_blank(F.col("summary")), 0.10).otherwise(0.0) + F.when(F.size("decisions") > 0, 0.15).otherwise(0.0) + F.when(F.size("acceptanceCriteria") > 0, 0.15).otherwise(0.0)
        points = points + F.when(~T.is_blank(F.col("businessGoal")) | ~T.is_blank(F.col("summary")), 0.05).otherwise(0.0)
        out_chars = F.aggregate(F.concat(F.array("issue", "summary", "businessGoal"), *LISTS, "relatedIssues"), F.lit(0).cast("long"), lambda acc, x: acc + T.utf16_length(x))
        in_chars = F.col("headChars") + F.coalesce("chars", F.lit(0))
        ratio = F.when(in_chars == 0, 0.0).otherwise(T.round2(F.greatest(F.lit(0.0), 1.0 - out_chars / in_chars)))
        rows = rows.withColumns({"confidence": F.least(F.lit(0.95), T.round2(points)), "compressionRatio": ratio, "rawChars": in_chars.cast("long"), "emittedChars": out_chars})
        if "assembly" not in self.stages:
            rows = rows.filter(F.lit(False))
        rows = rows.select("doc", "level", "issue", "summary", "businessGoal", *LISTS, "relatedIssues", "ignoredContent", "confidence", "compressionRatio", "rawChars", "emittedChars")
        for stage in self.own:
            rows = stage.apply(rows) if stage.table == "records" else rows
        return self.compressor(rows)
