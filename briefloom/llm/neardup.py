"""Near-duplicate texts: a chosen-path similarity join of word sets, and the groups it links.

Equal sets are joined first and stand for all their records.  Each set then descends a number of independent
trees.  A node chooses, by its own hash, one or more of the set's minwise tokens (1 / threshold on average) and
sends the set to the child that each chosen token names, so sets meet in a child with the probability of their
similarity.  A node with ``NODE`` sets or fewer, or one whose sets are about as alike as the threshold, is compared
exhaustively by one-bit minwise sketches; a larger one branches again.  Nodes that stay large to the end hold sets
that agree nearly everywhere; they are compared too, nothing is dropped.  What the sketches leave is verified on the
words' hashes.

Nodes of ``BIG`` sets or fewer go down the rest of their tree within one task, as arrays; greater ones branch level by
level over the cluster first, so that no task holds more than ``BIG`` sets at once, whatever the skew.

Of a pair at the threshold the copies in a tree are a critical branching process: it survives d levels with a
probability of roughly 5 / d, so the trees that are needed grow with the depth.  Each tree has minwise functions of its
own, so that misses are independent between trees.  ``TREES`` are grown first, enough for a share of ``MISSED`` down to
some depth; sets in nodes that branch below that depth descend further trees, until there are enough for the depth that
is reached.  More similar pairs are missed far less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop, drop_since, mark, stored
from ..operators.graph import components
from ._hashing import chunks, latin_and_digits, mix, runs_of, word_hashes

#: Least number of independent trees, and the share of the pairs at the threshold that all trees together may miss.
TREES, MISSED = 12, 0.001
#: Sets that a node may hold to be compared exhaustively, and to go down its tree within a task.
NODE, BIG = 512, 200_000
#: Levels after which a node that is still large is compared in blocks.
DEPTH = 12
#: Minwise tokens that give a bit of the sketch, and those that choose the paths of a tree, of which a byte is kept.
MINWISE, PATH = 256, 16
#: Standard deviations that a pair's sketch may fall short of the threshold.
SLACK = 4.0
#: Characters or tokens that are hashed at once.
CHUNK = 1_000_000

_rng = np.random.default_rng(20240607)
_SEEDS = _rng.integers(0, 2**63, (1 << 14, 2), dtype=np.int64).astype(np.uint64)
_MUL, _ADD = ((_SEEDS[:, 0] >> np.uint64(31)).astype(np.uint32) | np.uint32(1)), (_SEEDS[:, 1] >> np.uint64(31)).astype(np.uint32)
_LONGS = [f"s{k}" for k in range(MINWISE // 64)]
_ROW = "node long, key long, n int, " + ", ".join(f"{x} long" for x in _LONGS) + ", path binary"


class Runs(NamedTuple):
    """Tokens of a text: its distinct words, or runs of ``width`` words (of a shorter text its whole)."""

    text: Column
    width: int = 1


def _runs(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), "'’", ""), "[^a-z0-9]+"), "")


def words(text: Column) -> Column:
    """Distinct words: lower case, apostrophes deleted, maximal runs of a-z and 0-9."""
    return F.array_distinct(_runs(text))


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct runs of ``width`` words; of a shorter text its whole."""
    w = _runs(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _needed(threshold: float, depth: int) -> int:
    """Trees of which a pair at the threshold leaves every one within ``depth`` levels with a probability of MISSED at most."""
    least, more = int(1 / threshold), 1 / threshold - int(1 / threshold)
    lost = 0.0
    for _ in range(depth):
        one = 1 - threshold + threshold * lost  # a child is not reached, or is and is lost below
        lost = (1 - more) * one**least + more * one ** (least + 1)
    return max(TREES, math.ceil(math.log(MISSED) / math.log(lost))) if lost > 0 else TREES


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each set in order, and their number."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])][: len(h)]
    return h[fresh], np.bincount(o[fresh], minlength=len(counts))


def _of_texts(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    words_, counts = word_hashes(texts, latin_and_digits(), (ord("'"), ord("’")))
    if width == 1:
        return _distinct(words_, counts)
    runs, owner, _ = runs_of(words_, counts, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    starts = np.cumsum(counts) - counts
    whole = np.array([mix(np.bitwise_xor.reduce(mix(words_[starts[k] : starts[k] + counts[k]] + np.arange(1, counts[k] + 1).astype(np.uint64)), keepdims=True))[0] for k in short], np.uint64)
    owner = np.r_[owner, short]
    order = np.argsort(owner, kind="stable")
    return _distinct(np.r_[runs, whole][order], np.bincount(owner, minlength=len(counts)).astype(np.int64))


def _records(width: int, least: int, full: bool):
    """(id, text) or (id, hashes) to (id, key) or (key, hashes) of the records whose set has ``least`` tokens or more."""

    def made(ids: np.ndarray, h: np.ndarray, counts: np.ndarray) -> pa.RecordBatch | None:
        keep = counts >= max(least, 1)
        h, counts, ids = h[np.repeat(keep, counts)], counts[keep], ids[keep]
        if not len(ids):
            return None
        starts = np.cumsum(counts) - counts
        with np.errstate(over="ignore"):
            key = pa.array(mix(np.add.reduceat(mix(h), starts) + counts.astype(np.uint64)).view(np.int64))
        if not full:
            return pa.RecordBatch.from_arrays([pa.array(ids), key], names=["id", "key"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(h.view(np.int64)))
        return pa.RecordBatch.from_arrays([key, lists], names=["key", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            if width:
                texts = batch.column("tokens").to_pylist()
                sizes = [len(x) for x in texts]
            else:
                lists = batch.column("tokens")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes, CHUNK):
                if width:
                    got = made(ids[a:b], *_of_texts(texts[a:b], width))
                else:
                    got = made(ids[a:b], *_distinct(lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(sizes[a:b], np.int64)))
                if got is not None:
                    yield got

    return run


def _needed(threshold: float, depth: int) -> int:
    """Trees of which a pair at the threshold leaves every one within ``depth`` levels with a probability of MISSED at most."""
    least, more = int(1 / threshold), 1 / threshold - int(1 / threshold)
    lost = 0.0
    for _ in range(depth):
        one = 1 - threshold + threshold * lost  # a child is not reached, or is and is lost below
        lost = (1 - more) * one**least + more * one ** (least + 1)
    return max(TREES, math.ceil(math.log(MISSED) / math.log(lost))) if lost > 0 else TREES


class _Rows:
    """Sets in nodes of trees as arrays: ``node, key, n``, the longs of the sketch and the bytes of the path."""

    def __init__(self, node: np.ndarray, key: np.ndarray, n: np.ndarray, bits: np.ndarray, path: np.ndarray):
        self.node, self.key, self.n, self.bits, self.path = node, key, n, bits, path

    @cached_property
    def lead(self) -> np.ndarray:
        return np.ascontiguousarray(self.bits[:, 0])

    def __len__(self) -> int:
        return len(self.key)

    def take(self, at: np.ndarray) -> "_Rows":
        return _Rows(self.node[at], self.key[at], self.n[at], self.bits[at], self.path[at])

    @staticmethod
    def of(batch: pa.RecordBatch) -> "_Rows":
        one = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        bits = np.stack([one(c).view(np.uint64) for c in _LONGS], axis=1)
        path = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).reshape(-1, PATH)
        return _Rows(one("node").view(np.uint64), one("key"), one("n"), bits, path)

    @staticmethod
    def joined(parts: list["_Rows"]) -> "_Rows":
        return parts[0] if len(parts) == 1 else _Rows(*[np.concatenate([getattr(x, c) for x in parts]) for c in ("node", "key", "n", "bits", "path")])

    def batches(self, most: int = 20_000) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self), most):
            b = min(a + most, len(self))
            path = pa.Array.from_buffers(pa.binary(PATH), b - a, [None, pa.py_buffer(np.ascontiguousarray(self.path[a:b]))]).cast(pa.binary())
            bits = [pa.array(np.ascontiguousarray(self.bits[a:b, k]).view(np.int64)) for k in range(len(_LONGS))]
            yield pa.RecordBatch.from_arrays([pa.array(self.node[a:b].view(np.int64)), pa.array(self.key[a:b]), pa.array(self.n[a:b].astype(np.int32)), *bits, path], names=["node", "key", "n", *_LONGS, "path"])

    def branched(self, threshold: float) -> "_Rows":
        """One level down: every row goes to the children of its node that its chosen minwise tokens name."""
        least, more = int(1 / threshold), 1 / threshold - int(1 / threshold)
        every = np.arange(len(self))
        out, at = [], []
        with np.errstate(over="ignore"):
            for k in range(least + (more > 0)):
                seed = mix(self.node + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
                place = (seed % np.uint64(PATH)).astype(np.int64)
                rows = every if k < least else np.flatnonzero((mix(self.node ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)) < int(more * (1 << 20)))
                out.append(mix(self.node[rows] * np.uint64(0xD1342543DE82EF95) + (place[rows] * 256 + self.path[rows, place[rows]] + 1).astype(np.uint64)))
                at.append(rows)
        rows = self.take(np.concatenate(at))
        rows.node = np.concatenate(out)
        return rows


def _rooted(trees: range, levels: int, threshold: float):
    """(key, hashes) to the rows of ``_ROW``: each set in its nodes at a level of the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column("key").to_numpy(zero_copy_only=False), batch.column("hashes")
            for a, b in chunks(lists.value_lengths().to_numpy(zero_copy_only=False), CHUNK):
                part = lists.slice(a, b - a)
                flat = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sizes = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                short = (flat >> np.uint64(32)).astype(np.uint32)

                def least(k: int) -> np.ndarray:
                    return np.minimum.reduceat(short * _MUL[k] + _ADD[k], starts) * np.uint32(0x9E3779B1)

                with np.errstate(over="ignore"):
                    bits = np.packbits(np.stack([least(k) >> np.uint32(31) for k in range(MINWISE)], axis=1).astype(bool), axis=1).view(np.uint64)
                    for t in trees:
                        path = np.stack([least(MINWISE + t * PATH + j) >> np.uint32(24) for j in range(PATH)], axis=1).astype(np.uint8)
                        rows = _Rows(np.full(b - a, mix(np.array([t + 1], np.uint64))[0]), keys[a:b], sizes, bits, path)
                        for _ in range(levels):
                            rows = rows.branched(threshold)
                        yield from rows.batches()

    return run


def _one_down(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _Rows.of(batch).branched(threshold).batches()

    return run


def _close(a: _Rows, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of rows may reach the threshold, by sizes and sketches."""
    p = (1 + threshold) / 2
    need = math.floor(MINWISE * p - SLACK * math.sqrt(MINWISE * p * (1 - p)))
    # A first look at 64 of the bits, which leaves few pairs of other sets.
    ok = np.bitwise_count(a.lead[i] ^ a.lead[j]) <= 64 * (1 - p) + (SLACK + 0.5) * math.sqrt(64 * p * (1 - p))
    i, j = i[ok], j[ok]
    ni, nj = a.n[i], a.n[j]
    fit = np.minimum(ni, nj) >= threshold * np.maximum(ni, nj)
    ok[ok] = fit
    i, j = i[fit], j[fit]
    ok[ok] = np.bitwise_count(a.bits[i] ^ a.bits[j]).sum(axis=1, dtype=np.int32) <= MINWISE - need
    return ok


def _compared(a: _Rows, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of keys within the nodes of rows sorted by node; of a node that has two sides, only across them."""
    i = np.arange(len(a))
    out_a, out_b = [], []
    d = 0
    while True:  # all nodes at once: each row with the one d rows on, as long as that is in its node
        d += 1
        i = i[i + d < len(a)]
        i = i[a.node[i] == a.node[i + d]]
        if not len(i):
            break
        j = i + d
        x, y = (i, j) if side is None else (i[(k := (side[i] == 0) | (side[i] != side[j]))], j[k])
        ok = _close(a, x, y, threshold)
        x, y = a.key[x[ok]], a.key[y[ok]]
        out_a.append(np.minimum(x, y)[x != y])
        out_b.append(np.maximum(x, y)[x != y])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _alike(a: _Rows, first: int, size: int, threshold: float) -> bool:
    """Whether the sets of a node are about as alike as the threshold, by pairs spread over it."""
    i = first + np.arange(0, size, max(1, size // 256))
    j = first + (i - first + size // 2 + 1) % size
    agree = 1 - np.bitwise_count(a.bits[i] ^ a.bits[j]).sum(axis=1).mean() / MINWISE
    return 2 * agree - 1 >= threshold - 0.05


def _batch(a: np.ndarray, b: np.ndarray, d: int) -> pa.RecordBatch:
    if len(a) and not d:
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), d, np.int32))], names=["a", "b", "d"])


def _grown(threshold: float, depth: int, enough: int, most: int, node: int):
    """Rows sorted by node, at one depth of their trees, to (a, b, 0) of the pairs below, (key, 0, depth) of the rows that
    branch below the depth ``enough``, and (0, 0, depth) of the depths reached."""

    def grow(rows: _Rows) -> Iterator[pa.RecordBatch]:
        todo = [(rows, depth)]
        while todo:
            a, at = todo.pop()
            a = a.take(np.argsort(a.node, kind="stable"))
            starts = np.flatnonzero(np.r_[True, a.node[1:] != a.node[:-1]])
            sizes = np.diff(np.r_[starts, len(a)])
            wide = sizes > node
            for k in np.flatnonzero(wide):
                if at >= most or (sizes[k] <= 32 * node and _alike(a, int(starts[k]), int(sizes[k]), threshold)):
                    wide[k] = False
            done = np.repeat(~wide, sizes)
            yield _batch(*_compared(a.take(np.flatnonzero(done)), threshold), 0)
            rest = a.take(np.flatnonzero(~done))
            yield _batch(np.zeros(1, np.int64), np.zeros(1, np.int64), at + bool(len(rest)))
            if len(rest):
                if at == enough:
                    yield _batch(keys := np.unique(rest.key), np.zeros(len(keys), np.int64), at + 1)
                for x, y in chunks(sizes[wide], 100_000):  # some nodes at a time, so that the copies below stay few
                    edge = np.cumsum(np.r_[0, sizes[wide]])
                    todo.append((rest.take(np.arange(edge[x], edge[y])).branched(threshold), at + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Rows] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_Rows.of(batch))
            size += batch.num_rows
            if size > 50_000 and held[-1].node[-1] != held[0].node[0]:
                rows = _Rows.joined(held)
                cut = int(np.argmax(rows.node == rows.node[-1]))  # the last node may go on in the next batch
                if cut:
                    yield from grow(rows.take(np.arange(cut)))
                    held = [rows.take(np.arange(cut, len(rows)))]
                    size = len(rows) - cut
        if held:
            yield from grow(_Rows.joined(held))

    return run


def _by_node(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node", *more)


def _descend(sets: DataFrame, many: int, trees: range, enough: int, threshold: float) -> DataFrame:
    """``a, b, d`` of ``_grown`` for some trees, stored."""
    start = 0 if many <= 4 * NODE else min(DEPTH, 1 + max(0, int(math.log(many / BIG, 6))))
    rows = sets.mapInArrow(_rooted(trees, start, threshold), _ROW)
    found = []
    for depth in range(start, DEPTH + 1):
        last = many <= BIG  # no node can be greater
        if not last:
            rows = stored(rows)
            large = stored(rows.groupBy("node").count().filter(F.col("count") > BIG))
            last = large.isEmpty()
        light = rows if last else rows.join(large, "node", "left_anti")
        found.append(stored(_by_node(light).mapInArrow(_grown(threshold, depth, enough, DEPTH, NODE), "a long, b long, d int").distinct()))
        if last:
            break
        heavy = rows.join(large, "node", "left_semi")
        if depth >= enough:
            found.append(stored(heavy.select(F.col("key").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(depth).alias("d")).distinct()))
        if depth == DEPTH:
            found.append(stored(_in_blocks(rows.join(large, "node"), threshold)))
        else:
            rows = heavy.mapInArrow(_one_down(threshold), _ROW)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _in_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """Nodes of any size: split into blocks of about NODE rows, each pair of blocks a task group of its own."""
    blocks = F.ceil(F.col("count") / NODE).cast("int")
    mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
    with_block = rows.withColumn("blocks", blocks).withColumn("mine", mine)
    spread = with_block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    node = F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    rows = _by_node(spread.select(node.alias("node"), "key", "n", *_LONGS, "path", side.alias("side")), "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[_Rows, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, side = _Rows.of(batch), batch.column("side").to_numpy(zero_copy_only=False)
            if rest is not None:
                a, side = _Rows.joined([rest[0], a]), np.r_[rest[1], side]
            cut = int(np.argmax(a.node == a.node[-1]))
            yield _batch(*_compared(a.take(np.arange(cut)), threshold, side[:cut]), 0)
            rest = (a.take(np.arange(cut, len(a))), side[cut:])
        if rest is not None:
            yield _batch(*_compared(rest[0], threshold, rest[1]), 0)

    return rows.mapInArrow(run, "a long, b long, d int")


def set_pairs(sets: DataFrame, threshold: float, trees: int = TREES) -> DataFrame:
    """Pairs ``a < b`` of keys whose sets may have a Jaccard similarity of ``threshold`` or more, distinct.

    ``sets`` has ``key`` (long, unique) and ``hashes`` (array<long>, distinct) and is read several times; ``trees`` is
    the least number of trees.
    """
    done, need, parts = 0, trees, []
    mine, many = sets, sets.count()
    if many <= NODE:  # one node holds all: a single look compares every pair
        return sets.mapInArrow(_rooted(range(1), 0, threshold), _ROW).transform(_by_node).mapInArrow(_grown(threshold, 0, DEPTH, DEPTH, NODE), "a long, b long, d int").filter("d = 0").select("a", "b").distinct()
    while done < need:
        enough = max([d for d in range(DEPTH + 1) if _needed(threshold, d) <= need])
        got = _descend(mine, many, range(done, need), enough, threshold)
        parts.append(got.filter("d = 0").select("a", "b"))
        deepest = got.agg(F.max("d")).first()[0] or 0
        done, need = need, max(need, _needed(threshold, min(deepest, DEPTH)))
        if done < need:  # pairs that these trees may have left too early have both their sets in a node that branches further
            mine = stored(mine.join(got.filter("d > 0 and not (a = 0 and b = 0)").select(F.col("a").alias("key")).distinct(), "key", "left_semi"))
            many = mine.count()
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.distinct()


def near_pairs(df: DataFrame, id_col: str, tokens: Column | Runs, threshold: float = 0.8, least: int = 1, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Linked sets and the records that hold them: ``(a, b)`` of set keys with a Jaccard similarity of
    ``threshold`` or more, and ``(id, key)`` of all records, each distinct.

    ``tokens`` is an array of strings, or ``Runs`` of a text.  Rows with a null id or null or fewer than ``least`` tokens
    have no links and no key.  Repeated ids may hold different sets.  Other columns are ignored, whatever their names.
    """
    width = tokens.width if isinstance(tokens, Runs) else 0
    held = tokens.text if width else F.transform(F.filter(tokens, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))
    rows = df.select(F.col(id_col).cast("long").alias("id"), held.alias("tokens")).filter("id is not null and tokens is not null")
    members = stored(rows.mapInArrow(_records(width, least, False), "id long, key long").distinct())
    sets = stored(rows.mapInArrow(_records(width, least, True), "key long, hashes array<long>").groupBy("key").agg(F.first("hashes").alias("hashes")))
    before = mark()
    may = stored(set_pairs(sets, threshold, trees))
    drop_since(before, may)
    one = lambda c: sets.select(F.col("key").alias(c), F.col("hashes").alias(f"h{c}"))
    common = F.size(F.array_intersect("ha", "hb"))
    links = may.join(one("a"), "a").join(one("b"), "b").filter(common >= threshold * (F.size("ha") + F.size("hb") - common)).select("a", "b")
    links = stored(links)
    drop(sets, may)
    return links, members


def near_duplicates(df: DataFrame, id_col: str, tokens: Column | Runs, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """All pairs ``id_a < id_b`` of records whose token sets are at least ``threshold`` alike, distinct: copies of
    linked sets expanded.  Use ``near_groups`` where copies are many."""
    links, members = near_pairs(df, id_col, tokens, threshold, least)
    # A set that one record alone holds and that links to no other takes part in nothing.
    linked = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    copies = members.groupBy("key").count().filter("count > 1").select(F.col("key").alias("x"), F.col("key").alias("y"))
    left, right = members.select(F.col("id").alias("id_a"), F.col("key").alias("x")), members.select(F.col("id").alias("id_b"), F.col("key").alias("y"))
    return linked.union(copies).join(left, "x").join(right, "y").filter("id_a < id_b").select("id_a", "id_b").distinct()


def near_groups(df: DataFrame, id_col: str, tokens: Column | Runs, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """One row for each record that has a set: ``id, group_id`` (the least id that it is linked to over any number
    of links), ``n_links`` (other sets at least ``threshold`` alike) and ``n_copies`` (records with the same set)."""
    links, members = near_pairs(df, id_col, tokens, threshold, least)
    heads = members.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n_copies"))
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    roots = components(links, "a", "b")
    per_set = heads.join(degree, "key", "left").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_of = per_set.groupBy("root").agg(F.min("head").alias("group_id"))
    joined = per_set.join(least_of, "root").select("key", "group_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies")
    return members.join(joined, "key").select("id", "group_id", "n_links", "n_copies")
