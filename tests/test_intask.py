import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from briefloom.operators import dedup, intask
from briefloom.operators.store import stored
from briefloom.plans import briefs
from briefloom.plans.catalogue import queries

VOCAB = ["a", "bb", "c1", "longwordlong", "internationalisation", "xinternationalisationx", "word", "deed", "of", "the"]


def _forms(seed: int, n: int, words: int) -> list[str]:
    r = random.Random(seed)
    return list(dict.fromkeys(" ".join(r.choice(VOCAB + [f"w{k}" for k in range(40)]) for _ in range(r.randint(0, words))) for _ in range(n)))


@pytest.mark.parametrize("words", [4, 12, 45, 200])
def test_links_by_keys_are_all_links(monkeypatch, words):
    for seed in range(8):
        forms = _forms(seed, 60, words)
        forms += [" ".join(f.split()[1:]) + " tail" for f in forms[::3]]
        forms = list(dict.fromkeys(forms))
        by_keys = [sorted(intask.links(forms, keeping)) for keeping in (False, True)]
        monkeypatch.setattr(intask, "_FEW", 10**9)
        assert by_keys == [sorted(intask.links(forms, keeping)) for keeping in (False, True)]
        monkeypatch.undo()


def _items(spark):
    rows = [(f"g{g}", [0, k], f) for g in range(4) for k, f in enumerate(_forms(g, 40, 9) * 2)]
    return spark.createDataFrame(rows, "g string, n array<bigint>, form string")


def test_collapse_is_the_same_in_tasks_and_by_joins(spark, monkeypatch):
    items, told = stored(_items(spark)), lambda d: sorted(map(str, d.select("g", "n", "kept_by").collect()))
    small = told(dedup.collapse(items))
    monkeypatch.setattr(intask, "ROWS", 70)  # some groups are larger
    assert told(dedup.collapse(items)) == small == told(dedup.by_joins(items))


def test_collapse_of_small_groups_takes_few_jobs(spark):
    sc = spark.sparkContext
    items = stored(_items(spark))
    sc.setJobGroup("few jobs", "")
    try:
        dedup.collapse(items).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("few jobs")) <= 8  # the joins take a job or more for each round


@pytest.mark.parametrize("name", ["near_dup_pairs", "plan_extracts", "section_gate"])
def test_queries_are_the_same_for_groups_of_any_size(spark, monkeypatch, name):
    rows = lambda: sorted(map(str, queries()[name](spark, "/root/testdata/sf0.001").collect()))
    small = rows()
    monkeypatch.setattr(intask, "ROWS", 12)
    monkeypatch.setattr(briefs, "_PAIRS", 2)
    assert small and rows() == small


def test_linked_texts_fold_without_a_look_at_every_slot(monkeypatch):
    r, seen = random.Random(3), []
    # Each text nearly repeats the two before and after it alone, so that one linked set folds to many slots.
    texts = [" ".join(f"w{x}" for x in range(k, k + 20)) + r.choice(["", "!", "..."]) for k in range(600)]
    texts += r.sample(texts, 60)
    forms = [t.rstrip("!.") for t in texts]
    sets, slots = [set(f.split()) for f in forms], []
    for i, t in enumerate(texts):
        s = next((s for s in slots if len(sets[s[1]] & sets[i]) >= 0.75 * len(sets[s[1]] | sets[i])), None)
        if s is None:
            slots.append([i, i])
        elif len(t) > len(texts[s[1]]):
            s[1] = i
    monkeypatch.setattr(intask, "_alike", lambda c, m, f=intask._alike: seen.append(1) or f(c, m))
    got = briefs._fold(pd.DataFrame({"g": ["g"] * len(texts), "n": [[0, k] for k in range(len(texts))], "text": texts, "form": forms}))
    assert [(n[1], t) for n, t in zip(got["n"], got["text"])] == [(i, texts[j]) for i, j in slots] and len(slots) > 100
    assert len(seen) < 5000
