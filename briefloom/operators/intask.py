"""Near-duplicates of groups that fit in a task, by the rules of ``text.near_duplicate``.

Rows come sorted by group, so that a task holds one group at a time.  What is larger than ``ROWS`` or ``CHARS`` goes
through the joins of ``dedup`` instead; the result is the same.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

#: Rows and characters of the largest group that one task takes.
ROWS, CHARS = 1 << 19, 1 << 26
#: Forms up to which a group is compared pair by pair.
_FEW = 48
#: Characters of a long word that stand for a contained text of one or two words; such a text has a word of that length.
_GRAM = (T.CONTAINED + 1) // 2
#: Candidates that are looked at together, and forms for which they are counted ahead.
_BLOCK, _AHEAD = 1 << 21, 1 << 13


def _alike(common: int, sizes: int) -> bool:
    """A Jaccard of 3/4 (``T.NEAR``) or more, in whole numbers."""
    return 7 * common >= 3 * sizes


def _few(forms: list[str], keeping: bool) -> Iterator[tuple[int, int]]:
    sets = [set(f.split()) for f in forms]
    held: list[tuple[int, int, set[str], str]] = []
    for i, f in enumerate(forms):
        s, m, n, gone = sets[i], len(sets[i]), len(f), False
        least, most = max(1, (3 * m + 3) // 4), 4 * m // 3
        for j, k, other, g in held:
            if (least <= k <= most and _alike(len(s & other), m + k)) or (n > T.CONTAINED < len(g) and (g in f if n > len(g) else f in g)):
                yield j, i
                if keeping:
                    gone = True
                    break
        if not gone:
            held.append((i, m, s, f))


def _level(size: np.ndarray) -> np.ndarray:
    """Words by which sets meet at once, the larger one having so many: the more, the fewer candidates, and the more keys."""
    return np.where((size < 2) | (size > 160), 1, np.where((size < 3) | (size > 32), 2, 3))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of them, one range after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Different numbers in order; for so many that ``np.unique`` takes long."""
    x = np.sort(x)
    return x[np.append(True, np.diff(x) != 0)[: len(x)]]


def _bits(owner: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """256 bits a form, one or more for each word."""
    bit = ((rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
    out = np.empty((n, 4), np.uint64)
    for at in range(0, n, 1 << 16):
        some = slice(*np.searchsorted(owner, [at, at + (1 << 16)]))
        table = np.zeros((min(n - at, 1 << 16), 256), bool)
        table[owner[some] - at, bit[some]] = True
        out[at : at + len(table)] = np.packbits(table, axis=1).view(np.uint64)
    return out


def _meeting(tok: np.ndarray, starts: np.ndarray, sizes: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of keys that two forms or more have, and the forms: sets that share c of their words, the larger one holding m,
    share k words at least among the m - c + k rarest of either.  ``alone`` words, the rarest, are in one form only."""
    first = starts + np.add.reduceat(np.append(tok < alone, False), starts) * (sizes > 0)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in (1, 2, 3):
        has = (sizes > 0) & ((_level(sizes) == k) | (_level(4 * sizes // 3) == k))
        count = np.where(has, starts + sizes - (3 * sizes + 3) // 4 + k - first, 0)
        count = np.minimum(count, starts + sizes - first)
        for length in np.unique(count[count >= k]).tolist():
            forms = np.flatnonzero(count == length)
            picks = np.array(list(combinations(range(length), k)))
            for at in range(0, len(forms), step := max(1, _BLOCK // len(picks))):
                some = forms[at : at + step]
                h = np.full((len(some), len(picks)), k, np.uint64)
                for c in range(k):
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + tok[first[some][:, None] + picks[None, :, c]].astype(np.uint64)
                h *= np.uint64(0x94D049BB133111EB)
                keys.append((h ^ (h >> np.uint64(32))).ravel())
                owners.append(np.repeat(some, len(picks)))
    every, owner = np.concatenate(keys), np.concatenate(owners).astype(np.int32)
    found, forms, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for part in range(8):  # an eighth of them sorted at a time
        at = np.flatnonzero((every & np.uint64(7)) == part)
        order = at[np.argsort(every[at])]
        fresh = np.append(True, np.diff(every[order]) != 0)[: len(order)]
        group = np.cumsum(fresh) - 1
        shared = np.bincount(group)[group] > 1 if len(order) else fresh
        found.append(group[shared] + number)
        forms.append(owner[order[shared]].astype(np.int64))
        number += len(order)
    return np.concatenate(found), np.concatenate(forms)


class _Meet:
    """Which forms that hold something come before those that look for it."""

    def __init__(self, held: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray], n: int):
        self.n, self.rows = n, _distinct(held[0] * n + held[1])
        order = np.argsort(asked[1], kind="stable")
        self.keys, self.forms = asked[0][order] * n, asked[1][order]

    def ahead(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of what the forms from a to b look for: the form, where the rows before it begin, and how many they are."""
        some = slice(*np.searchsorted(self.forms, [a, b]))
        low = np.searchsorted(self.rows, self.keys[some])
        return self.forms[some], low, np.searchsorted(self.rows, self.keys[some] + self.forms[some]) - low

    def drop(self, kept: np.ndarray) -> None:
        self.rows = self.rows[kept[self.rows % self.n]]


def links(forms: list[str], keeping: bool = False) -> Iterator[tuple[int, int]]:
    """``a, b`` (a < b) of near-duplicates among different normal forms in order; with ``keeping`` for each dropped form b the
    first kept one a, a form being dropped if it nearly repeats a kept one."""
    n = len(forms)
    if n <= _FEW:
        yield from _few(forms, keeping)
        return
    lists = pc.split_pattern(pa.array(forms, pa.large_string()), " ")
    ends = lists.offsets.to_numpy().astype(np.int64)
    named = lists.values.dictionary_encode()
    code, number = named.indices.to_numpy().astype(np.int64), np.diff(ends)
    owner, total = np.repeat(np.arange(n), number), len(named.dictionary)
    inner = np.ones(len(code), bool)
    inner[ends[:-1]] = inner[ends[1:] - 1] = False
    empty = named.dictionary.index("").as_py()  # the word of an empty form
    filled = code != empty
    df = np.bincount(_distinct((owner * total + code)[filled]) % total, minlength=total)
    rank = np.empty(total, np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(total)
    alone = int((df <= 1).sum())  # ranks below it stand in one form only
    word = rank[code]
    both = _distinct((owner * total + word)[filled])
    of, tok = both // total, both % total
    sizes = np.bincount(of, minlength=n)
    starts = np.cumsum(sizes) - sizes
    chars = np.array([len(f) for f in forms])
    bits, within = _bits(of, tok, n), _bits(owner[inner], word[inner], n)
    # The rarest word within a form stands in all that contain it.
    rarest = np.full(n, total)
    np.minimum.at(rarest, owner[inner], word[inner])
    asks = np.flatnonzero((chars > T.CONTAINED) & (number >= 3) & (rarest >= alone) & (rarest < total))
    held = np.isin(tok, rarest[asks]) & (chars[of] > T.CONTAINED)
    asking, holding = (rarest[asks], asks), (tok[held], of[held])
    keyed = _meeting(tok, starts, sizes, alone)
    meets = [_Meet(keyed, keyed, n), _Meet(asking, holding, n), _Meet(holding, asking, n)]
    kept = np.ones(n, bool)
    short = np.flatnonzero((chars > T.CONTAINED) & (number < 3)).tolist()
    gram = lambda i: max(forms[i].split(), key=lambda w: (len(w), w))[:_GRAM]
    shorts = {i: gram(i) for i in short}
    grams = set(shorts.values())
    short_in: dict[str, list[int]] = defaultdict(list)
    short_of: dict[str, list[int]] = defaultdict(list)

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        m, k = sizes[i], sizes[j]
        # Bits in which sets differ are words in which they do.
        some = np.flatnonzero((4 * np.minimum(m, k) >= 3 * np.maximum(m, k)) & kept[j])
        some = some[7 * np.bitwise_count(bits[i[some]] ^ bits[j[some]]).sum(axis=1, dtype=np.int64) <= m[some] + k[some]]
        pairs = _distinct(i[some] * n + j[some])
        words = lambda x: tok[starts[x] : starts[x] + sizes[x]]
        sets: dict[int, set[int]] = {}
        ok = np.zeros(len(pairs), bool)
        for at, (x, y) in enumerate(zip((pairs // n).tolist(), (pairs % n).tolist())):
            a = sets[x] if x in sets else sets.setdefault(x, set(words(x).tolist()))
            b = sets[y] if y in sets else sets.setdefault(y, set(words(y).tolist()))
            ok[at] = _alike(len(a & b), len(a) + len(b))
        return pairs[ok]

    def around(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs i, j of which a holds b."""
        some = np.flatnonzero((chars[a] > chars[b]) & kept[j])
        some = some[~(within[b[some]] & ~bits[a[some]]).any(axis=1)]
        ok = [forms[y] in forms[x] for x, y in zip(a[some].tolist(), b[some].tolist())]
        return (i[some] * n + j[some])[np.array(ok, bool)]

    checks = [alike, lambda i, j: around(i, j, i, j), lambda i, j: around(i, j, j, i)]
    begin, block, ahead = 0, _BLOCK, _AHEAD
    while begin < n:
        limit = min(n, begin + ahead)
        parts = [x.ahead(begin, limit) for x in meets]
        cost = sum(np.bincount(f - begin, c, minlength=limit - begin) for f, _, c in parts)
        end = begin + max(1, int(np.searchsorted(np.cumsum(cost), block, "right")))
        found = [np.zeros(0, np.int64)]
        for meet, check, (f, low, count) in zip(meets, checks, parts):
            stop = int(np.searchsorted(f, end))
            sums, at = np.cumsum(count[:stop]), 0
            while at < stop:
                to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _BLOCK, "right")))
                if (c := count[at:to]).any():
                    found.append(check(np.repeat(f[at:to], c), meet.rows[_ranges(low[at:to], c)] % n))
                at = to
        near: dict[int, list[int]] = defaultdict(list)
        pairs = _distinct(np.concatenate(found))
        for i, j in zip((pairs // n).tolist(), (pairs % n).tolist()):
            near[i].append(j)
        gone = 0
        for i in range(begin, end) if grams else sorted(near):
            some = [j for j in near.get(i, ()) if kept[j]]
            mine: set[str] = set()
            if grams and chars[i] > T.CONTAINED:
                f = forms[i]
                mine = {w[x : x + _GRAM] for w in f.split() if len(w) >= _GRAM for x in range(len(w) - _GRAM + 1)} & grams
                more = [j for g in mine for j in short_of.get(g, ()) if forms[j] in f]
                more += [j for j in (short_in.get(shorts[i], ()) if i in shorts else ()) if f in forms[j]]
                some = sorted({*some, *more}) if more else some
            if some and keeping:
                yield some[0], i
                kept[i], gone = False, gone + 1
                continue
            for j in some:
                yield j, i
            for g in mine:
                short_in[g].append(i)
            if i in shorts:
                short_of[shorts[i]].append(i)
        if gone:
            for x in meets:
                x.drop(kept)
        # Where most are dropped, few at a time are compared with each other.
        block = max(_BLOCK >> 6, block >> 2) if 2 * gone > end - begin else min(_BLOCK, block << 1)
        begin, ahead = end, min(_AHEAD, 4 * (end - begin) + 64)


def _runs(table: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Where each group begins and ends."""
    rows = list(zip(*(table[k].to_pylist() for k in keys)))
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[at]:
            yield at, i
            at = i


def by_group(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """``step`` over tables of whole groups, their rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            now, start = pa.Table.from_batches([batch]), batch.num_rows - 1
            columns = [now[k].to_pylist() for k in keys]
            last = tuple(c[-1] for c in columns)
            while start and tuple(c[start - 1] for c in columns) == last:
                start -= 1
            if held and (start or tuple(held[0][k][0].as_py() for k in keys) != last):
                held, whole = [], [*held, now.slice(0, start)]
            elif not held and start:
                whole = [now.slice(0, start)]
            else:
                whole = []
            if whole:
                yield from step(pa.concat_tables(whole)).to_batches(max_chunksize=10_000)
            held.append(now.slice(start))
        if held:
            yield from step(pa.concat_tables(held)).to_batches(max_chunksize=10_000)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def split_by_size(rows: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows``, stored before, of groups that fit in a task, and of those that don't if there are any."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.length(text)).alias("chars")).filter((F.col("rows") > ROWS) | (F.col("chars") > CHARS)).select(*keys)
    if large.isEmpty():
        return rows, None
    return rows.join(large, keys, "left_anti"), rows.join(large, keys, "left_semi")


def collapse(items: DataFrame) -> DataFrame:
    """``items`` (``g, n, form``) without forms, with ``kept_by`` as ``dedup.collapse`` gives it and the ``times`` of what is kept."""

    def step(t: pa.Table) -> pa.Table:
        forms, kept = t["form"].to_pylist(), np.arange(t.num_rows)
        for a, b in _runs(t, ["g"]):
            first: dict[str, int] = {}
            for i in range(a, b):
                first.setdefault(forms[i], i)
            if b - a > 1:
                at = list(first.values())
                top = {at[y]: at[x] for x, y in links(list(first), True)}
                kept[a:b] = [top.get(r, r) for r in (first[forms[i]] for i in range(a, b))]
        out = t.drop_columns(["form"]).append_column("kept_by", t["n"].take(pa.array(kept)))
        return out.append_column("times", pa.array(np.bincount(kept, minlength=t.num_rows).astype(np.int64)))

    fields = [x for x in items.schema.fields if x.name != "form"]
    return by_group(items, ["g"], ["n"], step, StructType(fields).add("kept_by", items.schema["n"].dataType).add("times", "long"))


def pairs(items: DataFrame) -> DataFrame:
    """``g, a, b`` (a < b) of near-duplicates among ``items`` (``g, n, form``; forms distinct in a group)."""

    def step(t: pa.Table) -> pa.Table:
        forms, x, y = t["form"].to_pylist(), array("q"), array("q")
        for a, b in _runs(t, ["g"]):
            for i, j in links(forms[a:b]):
                x.append(a + i)
                y.append(a + j)
        x, y = pa.array(np.array(x, np.int64)), pa.array(np.array(y, np.int64))
        return pa.table({"g": t["g"].take(x), "a": t["n"].take(x), "b": t["n"].take(y)})

    kind = items.schema["n"].dataType
    return by_group(items.select("g", "n", "form"), ["g"], ["n"], step, StructType([items.schema["g"]]).add("a", kind).add("b", kind))


def linked(forms: list[str]) -> dict[str, list[str]]:
    """By form the others of ``forms`` (all different) that nearly repeat it, if any does."""
    near: dict[str, list[str]] = defaultdict(list)
    for a, b in links(forms):
        near[forms[a]].append(forms[b])
        near[forms[b]].append(forms[a])
    return near


def fold(rows: list[int], texts: list[str], forms: list[str], near: dict[str, list[str]]) -> list[tuple[int, int]]:
    """Texts in order into slots: each goes to the first slot whose text it nearly repeats and replaces that if longer.  The
    slots' first row and the row of their text.  ``near`` (``linked``) says where a text looks: not at every slot."""
    slots: list[tuple[int, int]] = []
    size_of: list[int] = []
    by_form: dict[str, list[int]] = {}  # slots that hold a form, or held it: the least first
    for i in rows:
        form, size, best = forms[i], len(texts[i].encode("utf-16-le")), -1
        for f in (form, *near.get(form, ())):
            some = by_form.get(f)
            while some and forms[slots[some[0]][1]] != f:
                heappop(some)
            if some and (best < 0 or some[0] < best):
                best = some[0]
        if best < 0:
            best = len(slots)
            slots.append((i, i))
            size_of.append(size)
        elif size > size_of[best]:
            was = forms[slots[best][1]]
            slots[best], size_of[best] = (slots[best][0], i), size
            if was == form:
                continue
        else:
            continue
        heappush(by_form.setdefault(form, []), best)
    return slots


def unique_texts(items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, text`` of items (``keys, n, text, form``) that say something new in their group, longer wordings in place of
    shorter near-duplicates: texts that links join fold together."""

    def step(t: pa.Table) -> pa.Table:
        texts, forms = t["text"].to_pylist(), t["form"].to_pylist()
        places, worded = array("q"), array("q")
        for a, b in _runs(t, keys):
            first: dict[str, list[int]] = {}
            for i in range(a, b):
                first.setdefault(forms[i], []).append(i)
            near, number, root = linked(list(first)), {f: k for k, f in enumerate(first)}, list(range(len(first)))

            def top(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for f, others in near.items():
                for g in others:
                    if (u := top(number[f])) != (v := top(number[g])):
                        root[max(u, v)] = min(u, v)
            sets: dict[int, list[list[int]]] = defaultdict(list)
            for k, own in enumerate(first.values()):
                sets[top(k)].append(own)
            for own in sets.values():
                for i, j in fold(sorted(i for x in own for i in x), texts, forms, near) if len(own) > 1 else [(own[0][0], own[0][0] if len(own[0]) == 1 else max(own[0], key=lambda i: (len(texts[i].encode("utf-16-le")), -i)))]:
                    places.append(i)
                    worded.append(j)
        at = pa.array(np.array(places, np.int64))
        return pa.table({k: t[k].take(at) for k in [*keys, "n"]} | {"text": t["text"].take(pa.array(np.array(worded, np.int64)))})

    return by_group(items.select(*keys, "n", "text", "form"), keys, ["n", "text"], step, items.select(*keys, "n", "text").schema)


def uncovered(rows: DataFrame) -> DataFrame:
    """Extracts (``doc, n, list, form, ..``) without the constraints that contain, or are contained in, a criterion that stands
    at or before them.  What is neither stays where it is."""
    may = F.col("list").isin("constraints", "acceptanceCriteria")

    def step(t: pa.Table) -> pa.Table:
        lists, forms, no, k = (t[x].to_pylist() for x in ("list", "form", "_no", "_k"))
        out = np.ones(t.num_rows, bool)
        for a, b in _runs(t, ["doc"]):
            limits = [i for i in range(a, b) if lists[i] == "constraints"]
            criteria: dict[str, tuple[int, int]] = {}
            for i in range(a, b) if limits else ():
                if lists[i] == "acceptanceCriteria":
                    criteria[forms[i]] = min((no[i], k[i]), criteria.get(forms[i], (no[i], k[i])))
            if limits and criteria:
                each = list(criteria.items())
                first: dict[str, tuple[int, int] | None] = {}
                for i in limits:
                    f = forms[i]
                    if f not in first:
                        first[f] = min((at for c, at in each if c in f or f in c), default=None)
                    out[i] = first[f] is None or first[f] > (no[i], k[i])
        return t.drop_columns(["_no", "_k"]).filter(pa.array(out))

    return by_group(rows.filter(may).withColumns({"_no": F.col("n")[0], "_k": F.col("n")[1]}), ["doc"], [], step, rows.schema).union(rows.filter(~may))
