"""Long exact spans that stand in more than one record.

Every text is cut into tokens of 1 to ``TOKEN`` characters at places that the characters around them decide, so
that equal passages are cut alike wherever they stand, long runs without blanks (base64, ruled lines) included.
The window of fixed length at every token start gets a Rabin-Karp hash; Spark counts in how many records each
hash occurs (least and greatest record id, combined on the map side, so that a passage in a third of all records
costs one row a task).  Windows that repeat are looked at character by character: full-length windows at their
token starts, then at all places of those gaps between token starts at which a span begins or ends.  Repeated
full-length windows merge into maximal intervals.

No pair of records is ever formed, nothing is collected, and every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop, stored
from ._hashing import Prefix, chunks, codepoints, minimisers

#: Longest token, in characters.  A span of n characters holds the window of n - TOKEN + 1 at one of its first TOKEN places.
TOKEN = 64
#: Characters that decide where a token starts.
GRAM = 8
#: Characters that are hashed at once; a longer text is hashed alone.
CHUNK = 1_000_000
#: Seed of the second hash of full-length windows: with it they have 128 bits, as many as leave no false span at any size.
SECOND = 0x8A5CD789635D2DFF


def _windows(span: int):
    """Rows of (doc_id, pos, q, s, z): each token start and the hash of the window of ``span - TOKEN + 1`` characters there
    and both hashes of the one of ``span`` (null at the end of a text)."""
    short = span - TOKEN + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [codepoints(x) for x in pdf["text"]]
            ids = pdf["doc_id"].to_numpy()
            for a, b in chunks([len(x) for x in texts], CHUNK):
                lens = np.array([len(x) for x in texts[a:b]])
                ends = np.cumsum(lens)
                symbols = np.concatenate(texts[a:b])
                whole = Prefix(symbols)
                grams = whole.every(GRAM)
                out = []
                for k in range(b - a):
                    start, end = int(ends[k] - lens[k]), int(ends[k])
                    if end - start < span:
                        continue
                    cuts = minimisers(grams[start : end - GRAM + 1], TOKEN)
                    cuts = cuts[cuts + short <= end - start]
                    out.append((np.full(len(cuts), ids[a + k]), cuts, start, end))
                if not out:
                    continue
                pos = np.concatenate([x[1] for x in out])
                at = np.concatenate([x[1] + x[2] for x in out])
                fits = np.concatenate([x[1] + x[2] + span <= x[3] for x in out])
                s, z = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                s[fits] = whole.at(at[fits], span).view(np.int64)
                z[fits] = Prefix(symbols, SECOND).at(at[fits], span).view(np.int64)
                yield pd.DataFrame({"doc_id": np.concatenate([x[0] for x in out]), "pos": pos.astype(np.int32), "q": whole.at(at, short).view(np.int64), "s": pd.arrays.IntegerArray(s, ~fits), "z": pd.arrays.IntegerArray(z, ~fits)})

    return run


def _places(span: int):
    """Rows of (doc_id, pos, s, z): the full-length windows at each token start given and the TOKEN - 1 places before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text, cuts in zip(pdf["doc_id"], pdf["text"], pdf["cuts"]):
                symbols = codepoints(text)
                whole = Prefix(symbols)
                at = np.unique(np.asarray(cuts, np.int64)[:, None] - np.arange(TOKEN)[None, :])
                at = at[(at >= 0) & (at + span <= whole.n)]
                if len(at):
                    yield pd.DataFrame({"doc_id": doc, "pos": at.astype(np.int32), "s": whole.at(at, span).view(np.int64), "z": Prefix(symbols, SECOND).at(at, span).view(np.int64)})

    return run


def _repeated(df: DataFrame, *key: str) -> DataFrame:
    """The values of ``key`` that stand in two or more records, one row each: what joins them is split by adaptive execution if
    one value holds a large part of all rows."""
    return df.groupBy(*key).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select(*key)


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400) -> DataFrame:
    """Maximal stretches of each text in which every character lies in some substring of at least ``span``
    characters that also stands in the text of another id: ``doc_id, start_pos, n_chars`` (code points from 0).

    Rows without id or text are ignored, as are texts shorter than ``span``; rows that repeat an id count as one
    record; a span that repeats only inside one record is not shared.  Other columns are ignored, whatever their names.
    """
    if span < 2 * TOKEN:
        raise ValueError(f"span must be {2 * TOKEN} characters at least")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(f"doc_id is not null and length(text) >= {span}")
    windows = docs.mapInPandas(_windows(span), "doc_id long, pos int, q long, s long, z long")
    cuts = stored(windows.join(_repeated(windows.select("doc_id", "q"), "q"), "q", "left_semi"))

    # Full-length windows at token starts.  A token start is settled if a window that repeats starts at it and another one
    # TOKEN - 1 or more and ``span`` or less before it: any window that starts between them is covered.  Elsewhere a stretch may begin or end
    # at any of the places before the token start.
    whole = cuts.filter("s is not null")
    hits = whole.join(_repeated(whole, "s", "z"), ["s", "z"], "left_semi").select("doc_id", "pos", "q", F.lit(True).alias("hit"))
    full = cuts.select("doc_id", "pos", "q", F.lit(False).alias("hit")).union(hits).groupBy("doc_id", "pos", "q").agg(F.max("hit").alias("hit"))
    before = Window.partitionBy("doc_id").orderBy("pos")  # one record's token starts: bounded by its text
    last = F.last(F.when(F.col("hit"), F.col("pos")), ignorenulls=True).over(before.rangeBetween(Window.unboundedPreceding, 1 - TOKEN))
    full = stored(full.withColumn("open", ~(F.col("hit") & F.coalesce(F.col("pos") - last <= span, F.lit(False)))))
    drop(cuts)
    # The same token starts of the other records are needed too, as that is where an open one's windows have their partners.
    gaps = full.join(full.filter("open").select("q").distinct(), "q", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("cuts"))
    # Only the texts that hold such a place are moved: their ids are a table of their own, broadcast while it is small.
    ids = stored(full.select("doc_id").distinct())
    places = stored(docs.join(ids, "doc_id", "left_semi").join(gaps, "doc_id").mapInPandas(_places(span), "doc_id long, pos int, s long, z long"))
    drop(ids)
    found = places.join(_repeated(places, "s", "z"), ["s", "z"], "left_semi")

    starts = found.select("doc_id", "pos").union(full.filter("hit").select("doc_id", "pos")).distinct()
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(before) > span, F.lit(True)).cast("int")
    return (
        starts.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(before))
        .groupBy("doc_id", "island")
        .agg(F.min("pos").alias("start_pos"), (F.max("pos") - F.min("pos") + span).cast("int").alias("n_chars"))
        .select("doc_id", "start_pos", "n_chars")
    )


def shared_share(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400) -> DataFrame:
    """How much of each record also stands elsewhere: ``doc_id, n_chars, n_spans, shared_chars, shared_part``, a row
    for each id with a text (0 where nothing is shared, also for empty texts)."""
    spans = shared_spans(df, id_col, text_col, span).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum("n_chars").alias("shared_chars"))
    docs = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.length(text_col)).cast("long").alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return docs.join(spans, "doc_id", "left").select("doc_id", "n_chars", zero(F.col("n_spans")).alias("n_spans"), zero(F.col("shared_chars")).alias("shared_chars"), F.when(F.col("n_chars") > 0, zero(F.col("shared_chars")) / F.col("n_chars")).otherwise(0.0).alias("shared_part"))
