"""What a run leaves on disk and in the driver, and what it looks at."""

import random

from pyspark.sql import functions as F

from briefloom.functions import text as T
from briefloom.operators import intask, marks, store
from briefloom.operators.store import stored
from briefloom.plans.briefs import Briefs
from briefloom.sources import tickets as src

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SF = "/root/testdata/sf0.001"


def _tables(spark):
    return spark.read.parquet(f"{SF}/tickets.parquet"), spark.read.parquet(f"{SF}/ticket_comments.parquet")


def _tickets(spark):
    return src.from_tables(*_tables(spark), known=True)[:2]


def _shuffle_files(spark) -> int:
    return sum("shuffle_" in x for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))


def test_stored_tables_leave_no_shuffle_files(spark):
    before, was = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    made = stored(spark.range(10_000).repartition(4).groupBy((F.col("id") % 100).alias("k")).count())
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP, None) == was and made.count() == 100


def test_plan_drops_what_nothing_reads(spark):
    before = store.mark()
    b = Briefs(*_tickets(spark), known=True)
    assert b.lists.count() and b.scored.count()
    made = [t._stored_at for t in (b.sources, b.blocks, b.kept, b.sentences, b.extracts, b.lists, b.tags, b.scored)]
    assert store.mark() - before == set(made)


def test_comments_of_tickets_that_are_not_there(spark):
    tickets, comments = _tables(spark)
    some = tickets.filter("ticket_id % 3 > 0")
    every, known = src.from_tables(some, comments), src.from_tables(some, comments, known=True)
    rows = lambda d: sorted(map(str, d.collect()))
    want = rows(every.comments.join(every.heads.select("doc"), "doc", "left_semi"))
    assert want == rows(known.comments) and len(want) < every.comments.count()
    assert rows(Briefs(*every[:2], ["FULL"]).records) == rows(Briefs(*known[:2], ["FULL"], known=True).records)


def test_few_candidates_are_compared_word_by_word(monkeypatch):
    r, seen = random.Random(1), []
    # Three rare words in common, the others not: sets meet, and are far from alike.
    forms = [" ".join([f"r{k % 20}a", f"r{k % 20}b", f"r{k % 20}c", *r.sample([f"w{x}" for x in range(60)], 14)]) for k in range(400)]
    forms += [f + " more" for f in forms[:5]]
    monkeypatch.setattr(intask, "_alike", lambda c, m, f=intask._alike: seen.append(1) or f(c, m))
    found = list(intask.links(forms))
    monkeypatch.setattr(intask, "_FEW", 10**9)
    assert len(seen) < 100 and found == sorted(intask.links(forms), key=lambda x: (x[1], x[0]))


def test_levels_share_a_row_a_key_and_blocks_hold_no_forms(spark):
    plan = Briefs(*_tickets(spark), known=True)
    assert plan.blocks.columns == ["doc", "n", "no", "k", "text", "kept_by"]
    rows = lambda names: sorted(map(str, Briefs(*_tickets(spark), names, known=True).records.filter("level = 'SMALL'").select("doc", "relatedIssues").collect()))
    assert rows(["TINY", "SMALL", "FULL"]) == rows(["SMALL"])


def test_marks_are_what_expressions_find(spark):
    texts = ["We decided to go. It must work! (The team) so that\nTODO: risky é", "Ünder must. émust x", "  a\r\nb. \x0b C will not use it", "ſlow K. It is SLOW", "x.  \n\n(we need to add)", "no", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").union(_tables(spark)[1].select(F.explode(T.blocks(F.coalesce("body", F.lit(""))))))
    each = F.transform(T.sentences(F.col("text")), lambda x, i: F.struct(i.alias("j"), x.alias("text"), *[c.alias(k) for k, c in T.cues(x).items()]))
    told = lambda d: sorted(map(str, d.collect()))
    want = rows.select("text", F.explode(each).alias("x")).select("text", "x.j", F.col("x.text").alias("s"), *[f"x.{k}" for k in T.CUES]).filter(" or ".join(T.CUES))
    found = marks.marked(rows).select("text", F.explode("said").alias("x")).select("text", "x.j", F.col("x.text").alias("s"), *[f"x.{k}" for k in T.CUES])
    plain = "octet_length(s) = length(s)"
    assert told(want.filter(plain)) == told(found.filter(plain)) and not want.join(found, ["text", "j", "s"], "left_anti").count()
    may = marks.marked(rows).filter((T.is_goal_block(F.col("text")) & ~F.col("goal")) | (T.is_log_dump(F.col("text")) & ~F.col("log")) | ((F.size(T.issue_keys(F.col("text"))) > 0) & ~F.col("keyed")) | ((F.size(T.section_items(F.col("text"))) + F.size(T.scenarios(F.col("text"))) > 0) & ~F.col("listed")))
    assert not may.count()


def test_scores_move_no_texts(spark):
    plan = Briefs(*_tickets(spark), known=True)
    assert "text" not in plan.scored.columns and plan.kept._stored_at == plan.blocks._stored_at


def test_records_gather_a_row_for_all_levels(spark):
    b = Briefs(*_tickets(spark), known=True)
    listed = b._pieces().filter("field in ('decisions', 'acceptanceCriteria', 'constraints', 'risks', 'todos', 'dependencies')")
    assert 0 < listed.count() == b.lists.count()  # the FULL level has them all


def test_length_of_the_raw_context_gathers_no_text(spark):
    t = src.from_tables(*_tables(spark), known=True)
    sizes, told = src.raw_context_length(t), lambda d: sorted(map(tuple, d.collect()))
    assert told(sizes) == told(src.raw_context(t).select("doc", F.length("text").cast("long")))
    assert "collect_list" not in sizes._jdf.queryExecution().optimizedPlan().toString()
