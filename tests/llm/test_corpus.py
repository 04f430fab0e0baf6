"""Near-duplicates, containers and shared spans against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefloom.llm import neardup, packing, spans


def _sets(rng, n):
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n // 4):
        base = rng.sample(vocabulary, 40)
        out.append(base)
        for _ in range(3):
            x = list(base)
            for _ in range(rng.randrange(8)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            out.append(x)
    return out


@pytest.mark.parametrize("node, depth", [(1024, 12), (8, 12), (8, 1)])
def test_near_duplicates(spark, monkeypatch, node, depth):
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "DEPTH", depth)
    rng = random.Random(1)
    sets = _sets(rng, 160)
    rows = [(k, " ".join(x)) for k, x in enumerate(sets)] + [(900, " ".join(sets[0])), (901, " ".join(reversed(sets[0]))), (902, None), (903, ""), (None, "a b"), (904, "x")]
    df = spark.createDataFrame(rows + rows[:2], "id long, body string").withColumn("key", F.lit(1)).withColumn("tokens", F.lit("clash"))
    held = {k: frozenset(t.split()) for k, t in rows if k is not None and t and len(set(t.split())) >= 5}
    want = {(a, b) for a, x in held.items() for b, y in held.items() if a < b and len(x & y) / len(x | y) >= 0.75}
    got = {tuple(r) for r in neardup.near_duplicates(df, "id", neardup.words(F.col("body")), 0.75, 5).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    if depth == 1:
        groups = {r["id"]: r for r in neardup.near_groups(df, "id", neardup.words(F.col("body")), 0.75, 5).collect()}
        assert set(groups) == set(held) and groups[900]["group_id"] == 0 and groups[901]["n_copies"] == sum(x == held[0] for x in held.values())


def test_near_duplicates_in_a_hot_family(spark, monkeypatch):
    """Variants of one text, 0.75 to 0.8 alike, in nodes that stay large for many levels."""
    monkeypatch.setattr(neardup, "NODE", 16)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    sets = [[w if rng.random() > 0.115 else f"v{k}x{j}" for j, w in enumerate(base)] for k in range(700)]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(sets)], "id long, body string")
    bits = np.array([[w == x for w, x in zip(base, s)] for s in sets], np.int64)
    common = bits @ bits.T
    alike = common / (120 - common)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero((alike >= 0.75) & (alike <= 0.8))) if a < b}
    got = {tuple(r) for r in neardup.near_duplicates(df, "id", neardup.words(F.col("body")), 0.75, 5).collect()}
    assert len(want) > 10_000
    assert len(want - got) <= 0.002 * len(want), f"{len(want - got)} of {len(want)} missed"


@pytest.mark.parametrize("big", [40, 10**6])
def test_runs_of_texts_and_great_nodes(spark, monkeypatch, big):
    """The same pairs from texts as from arrays, also if nodes are too great for a task."""
    monkeypatch.setattr(neardup, "NODE", 8)
    monkeypatch.setattr(neardup, "BIG", big)
    sets = _sets(random.Random(3), 160)
    rows = [(k, " ".join(x).upper() + "'") for k, x in enumerate(sets)] + [(900, " ".join(sets[0])), (901, None), (902, ""), (903, "İstanbul K x"), (None, "a b")]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("key", F.lit(1)).withColumn("node", F.lit("clash"))
    held = {k: frozenset(t.lower().replace("'", "").split()) for k, t in rows[: len(sets) + 1]}
    want = {(a, b) for a, x in held.items() for b, y in held.items() if a < b and len(x & y) / len(x | y) >= 0.75}
    got = {tuple(r) for r in neardup.near_duplicates(df, "id", neardup.Runs(F.col("body")), 0.75, 5).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    five = lambda t: frozenset(" ".join(t[k : k + 5]) for k in range(len(t) - 4))
    held = {k: five(t.lower().replace("'", "").split()) for k, t in rows[: len(sets) + 1]}
    want = {(a, b) for a, x in held.items() for b, y in held.items() if a < b and len(x & y) / len(x | y) >= 0.8}
    got = {tuple(r) for r in neardup.near_duplicates(df, "id", neardup.Runs(F.col("body"), 5)).collect()}
    assert got == want


def test_short_texts_as_one_shingle(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "One, two"), (3, "two one"), (4, ""), (5, "one")], "id long, body string")
    assert {tuple(r) for r in neardup.near_duplicates(df, "id", neardup.Runs(F.col("body"), 5)).collect()} == {(1, 2)}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, body string")
    assert neardup.near_duplicates(df, "id", neardup.shingles(F.col("body"))).count() == 0
    assert neardup.near_groups(df, "id", neardup.shingles(F.col("body"))).count() == 0


def test_shingles(spark):
    df = spark.createDataFrame([("It's a B c d e f",), ("one two",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(neardup.shingles(F.col("t"))).collect()][:3] == [["its a b c d", "a b c d e", "b c d e f"], ["one two"], []]


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 300)
    rng = random.Random(2)
    rows = [(k, int(rng.lognormvariate(4, 1.2))) for k in range(1000)] + [(5000, 0), (5001, 100), (5002, 300), (5003, 100_000)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    caps = [(1, 100), (2, 1000)]
    for kw in ({}, {"rule": "dot"}, {"most_docs": 4, "cost_factor": 0.5}):
        got = packing.packed(sizes, caps, **kw).toPandas()
        for pack, cap in caps:
            own = got[got.pack_id == pack]
            assert own.groupby("doc_id").n_tokens.sum().to_dict() == dict(rows)
            per = own.groupby("container")
            assert per.n_tokens.sum().max() <= cap and per.size().max() <= kw.get("most_docs", cap // 8)
            cost = (own.n_tokens.astype(float) ** 2).groupby(own.container).sum()
            assert ((cost <= kw.get("cost_factor", 1.0) * cap**2) | (per.size() == 1)).all()
            pieces = own.groupby("doc_id").size()
            assert all(pieces[d] == max(1, -(-n // cap)) for d, n in rows)
            if not kw:
                assert per.ngroups <= 1.08 * -(-sum(n for _, n in rows) // cap)
    assert packing.packed(sizes.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        packing.packed(sizes, [(1, 0)])


def test_limits_that_bind(spark):
    """Documents and attention limit the containers, by both rules; few containers more than the limits ask for."""
    rng = random.Random(5)
    rows = [(k, rng.choice([3, 8, 20, 40, 90, 200, 400, 700, 950])) for k in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    for rule in ("norm", "dot"):
        got = packing.packed(sizes, [(1, 1000)], most_docs=6, cost_factor=0.5, rule=rule)
        kept = packing.limits(got, [(1, 1000)], 6, 0.5).first()
        assert (kept["n_documents"], kept["n_tokens"], kept["n_over_tokens"], kept["n_over_docs"], kept["n_over_cost"]) == (3000, sum(n for _, n in rows), 0, 0, 0)
        pdf = got.toPandas()
        per = pdf.groupby("container")
        assert (per.size() == 6).sum() > 100  # the number of documents binds
        cost = (pdf.n_tokens.astype(float) ** 2).groupby(pdf.container).sum()
        assert ((per.n_tokens.sum() < 940) & (cost > 0.45 * 1000**2)).sum() > 20  # attention binds
        alone = sum(n**2 > 0.5 * 1000**2 for _, n in rows)
        assert per.ngroups <= 1.25 * (alone + sum(n**2 for _, n in rows if n**2 <= 0.5 * 1000**2) / (0.5 * 1000**2))


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello"), (None, "x"), (4, "word " * 20_000)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == pytest.approx(20_000, abs=2) and len(got) == 4
    assert {r["doc_id"]: r["n_tokens"] for r in packing.estimated_counts(df).collect()} == {1: 3, 2: 0, 3: 0, 4: 25_000}


def brute_spans(docs, span):
    where = {}
    for d, t in docs.items():
        for k in range(len(t) - span + 1):
            where.setdefault(t[k : k + span], set()).add(d)
    out = set()
    for d, t in docs.items():
        hit = [k for k in range(len(t) - span + 1) if len(where[t[k : k + span]]) > 1]
        while hit:
            a = b = hit.pop(0)
            while hit and hit[0] <= b + span:
                b = hit.pop(0)
            out.add((d, a, b + span - a))
    return out


def test_shared_spans(spark):
    rng = random.Random(4)
    text = lambda n, letters="abcdefgh \n": "".join(rng.choice(letters) for _ in range(n))
    pool = [text(n) for n in (199, 200, 201, 230, 400, 900)] + ["=" * 300, "ab" * 200, "AbC0" * 80 + text(90)]
    docs = {}
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(pool)
            a = rng.randrange(40) if rng.random() < 0.5 else 0
            parts += [text(rng.randrange(120)), p[a:], text(rng.randrange(3))]
        docs[k] = "".join(parts)
    docs[100], docs[101] = docs[0] or pool[4], docs[0] or pool[4]
    docs[102] = pool[5] + "é漢😀" + pool[5]
    docs[103] = "q" + pool[5] + text(2000) * 30
    rows = [*docs.items(), (0, docs[0]), (200, None), (201, ""), (None, docs[102])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("q", F.lit(2))
    want = brute_spans(docs, 200)
    assert want and {tuple(r) for r in spans.shared_spans(df, span=200).collect()} == want
    share = {r["doc_id"]: r for r in spans.shared_share(df, span=200).collect()}
    assert set(share) == set(docs) | {201} and all(share[d]["shared_chars"] == sum(n for x, _, n in want if x == d) for d in share)
    assert spans.shared_spans(df.limit(0)).count() == 0
