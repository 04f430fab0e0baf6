"""Held-out passages inside a large corpus.

Items and documents are compared as streams of words (lower case, joined by single blanks).  Every character q-gram
of a document is looked up among those of the items; the hits of an item are counted in overlapping bands of
diagonals (place in the document minus place in the item).  By the q-gram lemma a passage of n characters with at
most e edits keeps n - q + 1 - e * q of its q-grams in one band of width 2e + 1, so that bands with fewer hits in
every stretch are dropped.  What is left is verified by banded alignment, and the longest run of equal words in it is
reported too.

The items are the small side: they go to all tasks in blocks of ``BLOCK`` characters, one pass over the corpus each,
whatever their number, and are indexed there, once a process; a corpus document is read once a block, whole, and never
meets other documents.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from ._hashing import Prefix, chunks, codepoints

#: Characters in a q-gram.
Q = 12
#: Item characters that one pass carries to the tasks.
BLOCK = 4_000_000
#: Document characters that are looked up at once.
CHUNK = 1_000_000

_WORD = re.compile(r"[a-z0-9]+")


def stream(text: str) -> str:
    """The words of a text between single blanks, one at each end."""
    return " " + " ".join(_WORD.findall(text.lower())) + " "


class Items:
    """The q-grams of a block of items, sorted by hash.

    ``shortest`` is the least number of characters of a passage that counts: of ``least_words`` words of the item itself
    (``own``), or of that many words of one character each.
    """

    def __init__(self, ids: list[int], texts: list[str], least_words: int, max_edits: int, own: bool):
        self.ids, self.streams = ids, [stream(x) for x in texts]
        self.least, self.edits = least_words, max_edits
        hashes, items, places, shortest = [], [], [], []
        for k, s in enumerate(self.streams):
            blanks = np.flatnonzero(np.frombuffer(s.encode("ascii"), np.uint8) == 32)
            fits = len(blanks) > least_words
            shortest.append(int((blanks[least_words:] - blanks[:-least_words]).min()) + 1 if own and fits else 2 * least_words + 1)
            if fits:
                h = Prefix(codepoints(s)).every(Q)
                hashes.append(h)
                items.append(np.full(len(h), k, np.int32))
                places.append(np.arange(len(h), dtype=np.int32))
        self.shortest = np.array(shortest, np.int64)
        self.h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(self.h, kind="stable")
        self.h = self.h[order]
        self.item = np.concatenate([np.zeros(0, np.int32), *items])[order]
        self.place = np.concatenate([np.zeros(0, np.int32), *places])[order]
        # A bit table before the search: most q-grams of a corpus are in no item.
        self.bits = max(16, int(np.ceil(np.log2(len(self.h) * 32 + 1))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.h >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the document, item and place in the item of every q-gram in common."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        first, last = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        n = last - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        each = np.repeat(np.arange(len(at)), n)
        entry = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        return at[each], self.item[entry], self.place[entry]


#: The index of the last block in this process, by the block's name.
_indexed: dict[str, Items] = {}


def _index(name: str, *block) -> Items:
    if name not in _indexed:
        _indexed.clear()
        _indexed[name] = Items(*block)
    return _indexed[name]


def banded_alignment(a: str, b: str, band: int) -> tuple[int, int]:
    """Of a local alignment that stays within ``band`` of the main diagonal: the most characters of ``a`` that match
    ``b`` with score 1 a match and -1 an edit, and the edits among them."""
    best = (0, 0, 0)
    width = 2 * band + 1
    old: list[tuple[int, int, int]] = [(0, 0, 0)] * width
    for i in range(1, len(a) + 1):
        new = [(0, 0, 0)] * width
        for d in range(width):
            j = i + d - band
            if not 1 <= j <= len(b):
                continue
            s, n, e = old[d]
            match = a[i - 1] == b[j - 1]
            got = [(0, 0, 0), (s + 1, n + 1, e) if match else (s - 1, n + 1, e + 1)]
            if d + 1 < width:
                s, n, e = old[d + 1]
                got.append((s - 1, n + 1, e + 1))
            if d:
                s, n, e = new[d - 1]
                got.append((s - 1, n, e + 1))
            new[d] = max(got)
            best = max(best, new[d])
        old = new
    return best[1], best[2]


def _back(eq: np.ndarray) -> np.ndarray:
    """For each number of leading places the length of the run of true ones that ends there."""
    n = np.arange(len(eq) + 1)
    return n - np.maximum.accumulate(np.r_[0, np.where(eq, 0, n[1:])])


def _matches(a: str, b: str, band: int) -> np.ndarray:
    """For each diagonal within ``band`` of the main one and each place of ``a`` the length of the equal run that ends there;
    the main diagonal begins at the place ``band`` of ``b``."""
    x, y = np.frombuffer(a.encode("ascii"), np.uint8), np.frombuffer(b.encode("ascii"), np.uint8)
    n = len(x)
    padded = np.zeros(n + 2 * band, np.uint8)  # no character of a stream
    padded[: min(len(y), len(padded))] = y[: len(padded)]
    return np.array([_back(x == padded[d : d + n]) for d in range(2 * band + 1)])


def longest_run(a: str, runs: np.ndarray) -> int:
    """Whole words in the longest equal run: those between two of its blanks."""
    blanks = np.flatnonzero(np.frombuffer(a.encode("ascii"), np.uint8) == 32)
    if not len(blanks):
        return 0
    held = runs[:, blanks + 1]  # runs that end with a blank
    first = np.searchsorted(blanks, blanks[None, :] + 1 - held)
    return int(np.where(held > 0, np.arange(len(blanks))[None, :] - first, 0).max())


def stretches(a: str, b: str, band: int, shortest: int, most: int, runs: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Parts of ``a`` of which every place lies in a stretch of ``shortest`` characters or more that matches ``b``, within
    ``band`` of the main diagonal, with ``most`` edits or fewer.

    From each end the matches are followed back as far as they go, then one edit is spent, and so on.
    """
    runs = _matches(a, "\0" * band + b, band) if runs is None else runs
    width = len(runs)
    i = np.arange(len(a) + 1)
    reach = runs
    for _ in range(most):
        new = np.empty_like(reach)
        for d in range(width):
            at = i - runs[d]  # where the matches begin
            prior, skip = np.maximum(at - 1, 0), (at > 0).astype(np.int64)
            best = reach[d][prior] * skip + skip  # a character changed
            if d + 1 < width:
                best = np.maximum(best, reach[d + 1][prior] * skip + skip)  # one of a left out
            if d:
                best = np.maximum(best, reach[d - 1][at])  # one of b left out
            new[d] = runs[d] + best
        reach = new
    longest = reach.max(axis=0)
    out: list[tuple[int, int]] = []
    for end in np.flatnonzero(longest >= shortest):
        start = int(end - longest[end])
        while out and out[-1][1] >= start:
            start = min(start, out.pop()[0])
        out.append((start, int(end)))
    return out


def least_edits(a: str, b: str, band: int) -> int:
    """The fewest edits of ``a`` against a part of ``b``, which holds no more than ``band`` characters besides.

    A column of the distance table is two bit vectors, of where it goes up and where down.
    """
    if not a:
        return 0
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    best = score
    for ch in b:
        eq = where.get(ch, 0)
        flat = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (mask & ~(flat | up)), up & flat
        score += bool(rise & top) - bool(fall & top)
        best = min(best, score)
        rise, fall = rise << 1 & mask, fall << 1 & mask  # a passage may begin anywhere in b
        up, down = fall | (mask & ~(eq | down | rise)), rise & (eq | down)
    return best


def _bands(name: str, *block):
    """(doc_id, text) to (doc_id, item_id, start_word, run_words, matched_chars, edits): verified regions of a block of items."""

    def regions(items: Items, doc: np.ndarray, place: np.ndarray, item: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, least and greatest diagonal) of the bands that hold enough q-grams, overlapping ones as one."""
        e = items.edits
        width, least = 2 * e + 1, np.maximum(1, items.shortest - Q + 1 - e * Q)
        out: dict[tuple[int, int], list[int]] = {}
        diagonal = place.astype(np.int64) - at
        base = int(diagonal.min()) - width
        for shift in range(width):
            band = (diagonal - base + shift) // width
            order = np.lexsort((band, item, doc))
            d, i, b = doc[order], item[order], band[order]
            start = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
            count = np.diff(np.r_[start, len(d)])
            for k in start[count >= least[i[start]]]:
                out.setdefault((int(d[k]), int(i[k])), []).append(int(b[k]) * width - shift + base)
        merged = []
        for (d, i), lows in out.items():
            lows.sort()
            lo = hi = lows[0]
            for x in lows[1:]:
                if x > hi + width or x > lo + 8 * width:
                    merged.append((d, i, lo, hi + width - 1))
                    lo = x
                hi = x
            merged.append((d, i, lo, hi + width - 1))
        return merged

    def verify(items: Items, doc_stream: str, item: int, lo: int, hi: int) -> list[tuple[int, int, int, int]]:
        """Start word, longest run of equal words, matched characters and edits of the passages between two diagonals."""
        e, own = items.edits, items.streams[item]
        skip = max(0, -hi)  # an item may begin before the document
        own = own[skip:]
        middle, band = (lo + hi) // 2 + skip, (hi - lo + 1) // 2 + 2 * e
        start = max(0, middle - band)
        near = "\0" * (start - middle + band) + doc_stream[start : middle + len(own) + band]
        runs = _matches(own, near, band)
        run = longest_run(own, runs)
        if e == 0:
            words = doc_stream.count(" ", 0, max(0, middle))
            return [(words, run, len(own), 0)] if run >= items.least else []
        out = []
        for x, y in stretches(own, near, band, int(items.shortest[item]), e, runs):
            out.append((doc_stream.count(" ", 0, max(0, middle + x)), run, y - x, least_edits(own[x:y], near[x : y + 2 * band], band)))
        if not out and run >= items.least:
            out.append((doc_stream.count(" ", 0, max(0, middle)), run, *banded_alignment(own, near[band:], band)))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = _index(name, *block)
        for pdf in batches:
            ids, streams = pdf["doc_id"].to_numpy(), [stream(x) for x in pdf["text"]]
            rows = []
            for a, b in chunks([len(x) for x in streams], CHUNK):
                part = streams[a:b]
                ends = np.cumsum([len(x) for x in part])
                place, item, at = items.hits(Prefix(np.frombuffer("".join(part).encode("ascii"), np.uint8)).every(Q))
                if not len(place):
                    continue
                doc = np.searchsorted(ends, place, "right")
                inside = place + Q <= ends[doc]
                doc, place, item, at = doc[inside], place[inside], item[inside], at[inside]
                if not len(place):
                    continue
                starts = np.concatenate([[0], ends[:-1]])
                for d, i, lo, hi in regions(items, doc, place - starts[doc], item, at):
                    rows += [(int(ids[a + d]), items.ids[i], *got) for got in verify(items, part[d], i, lo, hi)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_word", "run_words", "matched_chars", "edits"])

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = 13, max_edits: int = 0, own: bool = False) -> DataFrame:
    """Passages of items in documents: ``doc_id, item_id, start_word, run_words, matched_chars, edits``, a row for each
    region found.

    With ``max_edits`` 0 a region is a run of ``least_words`` or more equal words; otherwise also a stretch of at least
    ``2 * least_words + 1`` characters with that many edits for each such length; with ``own`` the length is that of the
    item's shortest run of ``least_words`` words instead.  Rows without id or text are ignored, as are items shorter than
    ``least_words``; repeated rows give repeated regions.  Other columns are ignored, whatever their names.
    """
    if max_edits and 2 * least_words + 1 - Q + 1 - max_edits * Q < 1:
        raise ValueError("so many edits leave no q-gram of the shortest passage; ask for more words or fewer edits")
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).filter("doc_id is not null and text is not null")
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null")
    out, ids, texts, size = [], [], [], 0
    schema = "doc_id long, item_id long, start_word int, run_words int, matched_chars int, edits int"

    def one_pass() -> DataFrame:
        return corpus.mapInPandas(_bands(uuid.uuid4().hex, list(ids), list(texts), least_words, max_edits, own), schema)

    for row in held.toLocalIterator():  # a partition at a time, a block at a time
        if ids and size + len(row["text"]) > BLOCK:
            out.append(stored(one_pass()))  # done at once, so that the driver holds one block
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    out.append(one_pass() if ids else spark.createDataFrame([], schema))
    result = out[0]
    for x in out[1:]:
        result = result.union(x)
    return result


def leaked_documents(docs: DataFrame, items: DataFrame, least_words: int = 13, max_edits: int = 1) -> DataFrame:
    """``doc_id, item_id`` for each document that holds ``least_words`` consecutive words of an item, distinct.

    Candidates are the regions within the edit budget that are as long as such words of the item; an exact run of words
    in one is what counts.
    """
    found = leaked_passages(docs, items, least_words=least_words, max_edits=max_edits, own=True)
    return found.filter(F.col("run_words") >= least_words).select("doc_id", "item_id").distinct()
