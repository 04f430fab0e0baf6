"""Near-duplicate texts within groups, in the order in which they stand.

A text that is a near-duplicate of an earlier kept one is dropped.  That order decides, so components or a plain
distinct would give other results.  Equal normal forms fold first; what links the others is found by two exact
filters (rare words that sets so alike must share, and a rare word from within a contained text that the one around it
must hold too), verified, and resolved in rounds: a text is kept once all earlier texts linked to it are dropped.
Groups that fit in a task are resolved there (``intask``); larger ones go through these joins and are never brought
together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import intask
from .store import drop, stored

#: Characters of a long word that stand for a contained text of one or two words; such a text has a word of that length.
_GRAM = (T.CONTAINED + 1) // 2


def _words(form: Column) -> Column:
    return F.split(form, " ")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``g, x, y`` where the form of ``inner`` (g, x, form, over ``T.CONTAINED`` characters) lies within that of ``outer``
    (g, y, form; y unique in g): the words within a contained text, but for the first and last, are words of the other."""
    outer = outer.join(inner.select("g").distinct(), "g", "left_semi")
    words = outer.select("g", "y", F.explode(F.array_distinct(_words(F.col("form")))).alias("w"))
    counts = words.groupBy("g", "w").agg(F.count("*").alias("df"))
    long_ = inner.filter(F.size(_words(F.col("form"))) >= 3)
    within = long_.select("g", "x", F.explode(F.array_distinct(F.slice(_words(F.col("form")), F.lit(2), F.size(_words(F.col("form"))) - 2))).alias("w"))
    rarest = within.join(counts, ["g", "w"], "left").groupBy("g", "x").agg(F.min(F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), "w")).alias("r")).filter("r.df > 0").select("g", "x", F.col("r.w").alias("w"))
    found = rarest.join(words, ["g", "w"]).select("g", "x", "y")
    # One or two words: the longer one begins with characters that some word of the other must hold.
    short = inner.filter(F.size(_words(F.col("form"))) < 3)
    lead = short.select("g", "x", F.substring(F.array_max(F.transform(_words(F.col("form")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], 1, _GRAM).alias("gram"))
    grams = words.filter(F.length("w") >= _GRAM).join(short.select("g").distinct(), "g", "left_semi")
    grams = grams.select("g", "y", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - _GRAM + 1), lambda k: F.substring(F.col("w"), k, F.lit(_GRAM)))).alias("gram"))
    pairs = found.union(lead.join(grams, ["g", "gram"]).select("g", "x", "y")).distinct()
    forms = pairs.join(inner.select("g", "x", F.col("form").alias("fx")), ["g", "x"]).join(outer.select("g", "y", F.col("form").alias("fy")), ["g", "y"])
    return forms.filter(F.col("fy").contains(F.col("fx"))).select("g", "x", "y")


def near_edges(items: DataFrame, across: bool = False) -> DataFrame:
    """``g, a, b`` (a < b) of near-duplicates among ``items`` (``g`` group, ``n`` unique order in it, ``form``
    distinct normal forms in it); with ``across`` only of those one of which is ``kept``, a further column.

    Words and texts go by hashes up to the candidates; what these join is compared as it is.
    """
    ws = _words(F.col("form"))
    side = F.col("kept") if across else F.lit(False)
    rows = items.filter("form <> ''").select("g", F.xxhash64("g", "n").alias("i"), side.alias("side"), "form", F.array_distinct(F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 2, F.lit(0)))).alias("inner"), F.array(ws[0], F.element_at(ws, -1)).alias("ends"))
    rows = rows.withColumn("ends", F.array_except("ends", "inner"))
    word = lambda inside: lambda x: F.struct(F.xxhash64(F.col("g"), x).alias("w"), F.lit(inside).alias("inside"))
    held = F.when(F.length("form") > T.CONTAINED, F.size("inner")).otherwise(-1)
    # Only numbers go along with the exploded words: a list that did would be copied for each of them.
    rows = rows.select("i", "side", (F.size("inner") + F.size("ends")).alias("m"), held.alias("held"), F.concat(F.transform("inner", word(True)), F.transform("ends", word(False))).alias("all"))
    words = rows.select("i", "side", "m", "held", F.explode("all").alias("x")).select("i", "side", "m", "held", "x.w", "x.inside")
    # What stands in one text alone joins nothing: it comes first in the order of rarity and is only counted.
    counts = words.groupBy("w").agg(F.count("*").alias("df")).filter("df > 1")
    shared = stored(words.join(counts, "w"))
    per = stored(shared.groupBy("i", "side", "m", "held").agg(F.array_sort(F.collect_list(F.struct("df", "w", "inside"))).alias("ws")))  # of one text
    # Sets with a Jaccard of 3/4 share one of their rarest ceil(n / 4) words (and one more when n divides).  A word further
    # back leaves too few behind it for a pair that meets there first.
    alone = F.col("m") - F.size("ws")
    lead = (F.col("m") - F.ceil(F.col("m") * T.NEAR) + 1 - alone).cast("int")
    prefix = per.filter(lead > 0).select("i", "side", "m", alone.alias("alone"), F.slice("ws", F.lit(1), lead).alias("some"))
    prefix = prefix.select("i", "side", "m", "alone", F.posexplode("some").alias("at", "x")).select("i", "side", "m", (F.col("at") + F.col("alone")).alias("at"), "x.w")
    a, b = (prefix.select(F.col("i").alias(c), F.col("side").alias(f"s{c}"), F.col("m").alias(f"m{c}"), F.col("at").alias(f"at{c}"), "w") for c in ("a", "b"))
    common = F.ceil((F.col("ma") + F.col("mb")) * T.NEAR / (1 + T.NEAR) - 1e-9)
    meet = F.col("sa") & ~F.col("sb") if across else F.col("a") < F.col("b")
    fits = meet & (F.least("ma", "mb") >= T.NEAR * F.greatest("ma", "mb")) & (F.least(F.col("ma") - F.col("ata"), F.col("mb") - F.col("atb")) >= common)
    alike = a.join(b, "w").filter(fits).select("a", "b")
    # All words within a contained text stand in the other one too, the rarest in few.
    inside = F.filter("ws", lambda x: x["inside"])
    rarest = per.filter((F.col("held") > 0) & (F.size(inside) == F.col("held"))).select(F.col("i").alias("a"), F.col("side").alias("sa"), F.get(inside, F.lit(0))["w"].alias("w"))
    others = shared.filter("held >= 0").select(F.col("i").alias("b"), F.col("side").alias("sb"), "w")
    within = rarest.join(others, "w").filter("sa <> sb" if across else "a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(alike.union(within).distinct())  # few numbers: the texts that they name are joined where they lie
    one = lambda g, i, n, f: items.select(F.col("g").alias(g), F.xxhash64("g", "n").alias(i), F.col("n").alias(n), F.col("form").alias(f))
    both = pairs.join(one("g", "a", "na", "fa"), "a").join(one("gb", "b", "nb", "fb"), "b").filter(F.col("g") == F.col("gb"))
    found = both.filter(T.near_duplicate(F.col("fa"), F.col("fb"))).select("g", F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    long_ = items.filter(F.length("form") > T.CONTAINED).select("g", "n", "form")
    short = contained(long_.filter(F.size(ws) < 3).withColumnRenamed("n", "x"), long_.withColumnRenamed("n", "y")).filter("x <> y")
    if across:
        sides = lambda c, k: items.select("g", F.col("n").alias(c), F.col("kept").alias(k))
        short = short.join(sides("x", "kx"), ["g", "x"]).join(sides("y", "ky"), ["g", "y"]).filter("kx <> ky")
    return found.union(short.select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def near_pairs(items: DataFrame) -> DataFrame:
    """``near_edges`` of all ``items``, by groups that fit in a task and by joins for the others."""
    small, large = intask.split_by_size(stored(items.select("g", "n", "form")), ["g"], "form")
    found = intask.pairs(small)
    return found if large is None else found.unionByName(near_edges(stored(large)))


def first_kept(edges: DataFrame) -> DataFrame:
    """``g, n, kept_by`` of the texts that are dropped: the first kept text linked to each, in order.

    Each round decides the texts whose earlier linked texts are all decided; rounds grow with the longest chain.
    """
    edges = stored(edges.select("g", "a", "b"))
    open_ = edges
    dropped_parts = []
    while True:
        ends = open_.select("g", F.col("b").alias("n")).distinct()
        firsts = open_.select("g", F.col("a").alias("n")).distinct().join(ends, ["g", "n"], "left_anti")
        sure = stored(firsts)  # no undecided earlier text is linked to these: kept
        if sure.isEmpty():
            drop(sure)
            break
        gone = stored(open_.join(sure.select("g", F.col("n").alias("a")), ["g", "a"]).select("g", F.col("b").alias("n")).distinct())
        dropped_parts.append(gone)
        # What is dropped no longer drops others; what is decided is no longer open.
        was = open_
        open_ = stored(open_.join(gone.select("g", F.col("n").alias("b")), ["g", "b"], "left_anti").join(gone.select("g", F.col("n").alias("a")), ["g", "a"], "left_anti").join(sure.select("g", F.col("n").alias("a")), ["g", "a"], "left_anti"))
        drop(sure, was if was is not edges else None)
    if not dropped_parts:
        return edges.select("g", F.col("b").alias("n"), F.col("a").alias("kept_by"))
    gone = dropped_parts[0]
    for x in dropped_parts[1:]:
        gone = gone.union(x)
    # A text that never was an end of an open edge is kept too: of a dropped text, any linked text not dropped itself.
    return edges.join(gone.select("g", F.col("n").alias("a")), ["g", "a"], "left_anti").join(gone.select("g", F.col("n").alias("b")).distinct(), ["g", "b"]).groupBy("g", F.col("b").alias("n")).agg(F.min("a").alias("kept_by"))


def collapse(items: DataFrame) -> DataFrame:
    """``items`` (``g, n, form``; n unique in g) without forms, with ``kept_by``: its own n for a kept text, else that of the
    first kept near-duplicate before it; and ``times``: how often a kept text was said, 0 for the others.

    Where ``items`` has a column ``batch``, a number that grows with n, batches are decided one after another: what the
    kept texts of one drop takes no part in the next, so that many variants of one text cost a row each and not a pair.
    """
    items = items if hasattr(items, "_stored_at") else stored(items)
    small, large = intask.split_by_size(items, ["g"], "form")
    found = intask.collapse(small.drop("batch"))
    if large is None:
        return found
    rest = stored(by_joins(stored(large)).drop("form"))
    times = rest.groupBy("g", F.col("kept_by").alias("n")).agg(F.count("*").alias("times"))
    return found.unionByName(rest.join(times, ["g", "n"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long"))))


def by_joins(items: DataFrame) -> DataFrame:
    """``collapse`` for groups of any size, with forms and without ``times``."""
    batch = F.min("batch") if "batch" in items.columns else F.min(F.lit(0))
    reps = stored(items.groupBy("g", "form").agg(F.min("n").alias("n"), batch.alias("batch")))
    batches = sorted(r[0] for r in reps.select("batch").distinct().collect()) or [0]  # a few numbers
    rest, parts = reps, []
    for k, b in enumerate(batches):
        now = rest.filter(F.col("batch") == b)
        gone = first_kept(near_edges(now.select("g", "n", "form")))
        if k == len(batches) - 1:
            parts.append(gone)
            break
        gone = stored(gone)
        later = rest.filter(F.col("batch") > b)
        kept = now.join(gone, ["g", "n"], "left_anti")
        both = stored(kept.select("g", "n", "form", F.lit(True).alias("kept")).union(later.select("g", "n", "form", F.lit(False))))
        hit = stored(near_edges(both, across=True).groupBy("g", F.col("b").alias("n")).agg(F.min("a").alias("kept_by")))
        parts += [gone, hit]
        rest = stored(later.join(hit, ["g", "n"], "left_anti"))
    gone = parts[0]
    for x in parts[1:]:
        gone = gone.union(x)
    roots = reps.join(gone, ["g", "n"], "left").select("g", "form", F.coalesce("kept_by", "n").alias("kept_by"))
    return items.drop("batch").join(roots, ["g", "form"])
