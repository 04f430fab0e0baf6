"""Filling containers of fixed capacity with documents.

Sizes are tokens of a public tokenizer (or the estimate of four characters a token).  A document longer than a
container is cut into full containers and a rest; everything else stays whole.  Items are spread by a hash over parts
of a bounded number of items, and each part is packed by vector best fit, largest first with the small ones among them: a container has residual
capacities of tokens, documents and attention cost (the sum of squared lengths), and an item goes to the open container
that fits it under all three and scores best, by the weighted dot product of its demand with the residuals or by the
weighted norm of what would be left.  A part's last containers are all that can stay partly empty, so that the loss
does not grow with the data.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Documents in a part, on average; one task packs a part for one capacity.
PART = 8192
#: Capacities that one call takes; they are passed as literals.
MOST_CAPACITIES = 1000


@cache
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the installed public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of each id: tokens of its text by a vocabulary file of tiktoken (path and split pattern, at
    the same place on all executors); null and empty texts have 0; of repeated ids the longest counts."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(str(path), pattern).encode_ordinary
        for pdf in batches:
            counts = [len(encode(x)) if x else 0 for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.array(counts, np.int64)})

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    return texts.mapInPandas(run, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def estimated_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` by the estimate: four characters a token, rounded up."""
    n = F.coalesce(F.ceil(F.length(text_col) / 4), F.lit(0)).cast("long")
    return df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(n).alias("n_tokens"))


def best_fit(sizes: np.ndarray, capacity: int, most_docs: int, most_cost: float, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> np.ndarray:
    """The container of each item, from 0, by vector best fit in the order given.

    An item that alone exceeds the attention capacity gets a container of its own; ``sizes`` must not exceed ``capacity``.
    """
    caps = np.array([capacity, most_docs, most_cost], float)
    w = np.array(weights, float)
    out = np.full(len(sizes), -1, np.int64)
    left, names, used, made = np.empty((64, 3)), np.empty(64, np.int64), 0, 0
    smallest = np.minimum.accumulate(sizes[::-1])[::-1] if len(sizes) else sizes
    for k, n in enumerate(sizes):
        need = np.array([n, 1.0, float(n) * float(n)])
        if used and k % 256 == 0:  # what no later item fits is closed
            keep = (left[:used, 0] >= smallest[k]) & (left[:used, 1] >= 1)
            m = int(keep.sum())
            left[:m], names[:m] = left[:used][keep], names[:used][keep]
            used = m
        open_ = left[:used]
        fits = np.flatnonzero((open_[:, 0] >= need[0]) & (open_[:, 1] >= need[1]) & (open_[:, 2] >= need[2]))
        if len(fits):
            rest = open_[fits] / caps
            if rule == "dot":
                best = fits[int(np.argmax((rest * (need / caps) * w).sum(axis=1)))]
            else:
                best = fits[int(np.argmin((((rest - need / caps) ** 2) * w).sum(axis=1)))]
        else:
            if used == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            best = used
            left[best], names[best] = caps, made
            used, made = used + 1, made + 1
        left[best] -= need
        out[k] = names[best]
    return out


def mixed(sizes: np.ndarray, ids: np.ndarray, some: np.ndarray, small: float) -> np.ndarray:
    """Some items in the order of packing: largest first, but those below the size that would fill a container with as many
    documents as it takes spread evenly among the others, smallest first, so that every container gets its share of them."""
    order = some[np.lexsort((ids[some], -sizes[some]))]
    large, little = order[sizes[order] >= small], order[sizes[order] < small][::-1]
    place = np.r_[np.arange(len(large)), np.ceil((np.arange(len(little)) + 1) * (len(large) / max(1, len(little)))) - 0.5]
    return np.r_[large, little][np.argsort(place, kind="stable")]


def packed(sizes: DataFrame, capacities: list[tuple[int, int]], most_docs: int | None = None, cost_factor: float = 1.0, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> DataFrame:
    """An assignment of all documents for each capacity: ``pack_id, container, doc_id, piece, start_token, n_tokens``.

    ``sizes`` is ``doc_id, n_tokens``; ``capacities`` is (pack_id, tokens), positive and distinct.  A container takes
    ``most_docs`` pieces (capacity / 8 by default) and an attention cost, the sum of squared lengths, of ``cost_factor * capacity ** 2``: from 1 on
    that leaves the tokens to decide, below it long pieces get fewer others beside them, and one that exceeds it alone has a
    container of its own.  Documents without tokens are placed too; an empty table gives no rows.  The result depends on ids and sizes alone.
    """
    if len(capacities) > MOST_CAPACITIES or any(c <= 0 for _, c in capacities):
        raise ValueError(f"capacities must be positive, {MOST_CAPACITIES} at most")
    if not 0 < cost_factor or (most_docs is not None and most_docs < 1):
        raise ValueError("cost_factor must be positive, most_docs 1 at least")
    sizes = stored(sizes.select("doc_id", "n_tokens"))
    parts = max(1, math.ceil(sizes.count() / PART))
    packs = F.array(*[F.struct(F.lit(int(p)).alias("pack_id"), F.lit(int(c)).cast("long").alias("capacity")) for p, c in capacities])
    items = sizes.withColumn("p", F.explode(packs)).select("p.pack_id", "p.capacity", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "n_tokens")

    def one_part(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, pack, part = int(pdf["capacity"].iloc[0]), int(pdf["pack_id"].iloc[0]), int(pdf["part"].iloc[0])
        docs = most_docs or max(1, capacity // 8)
        ids, n = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy()
        full = np.where(n > capacity, n // capacity, 0)
        rest = n - full * capacity
        some = np.flatnonzero((rest > 0) | (n == 0))
        order = mixed(rest, ids, some, capacity / docs)
        bins = best_fit(rest[order], capacity, docs, cost_factor * capacity**2, weights, rule)
        whole = np.repeat(np.arange(len(ids)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        made = int(bins.max()) + 1 if len(bins) else 0
        number = np.concatenate([bins, made + np.arange(len(whole))])
        row = np.concatenate([order, whole])
        pieces = np.concatenate([full[order], piece])
        return pd.DataFrame({
            "pack_id": np.full(len(row), pack, np.int32), "container": [f"{pack}-{part}-{k}" for k in number], "doc_id": ids[row],
            "piece": pieces.astype(np.int32), "start_token": pieces * capacity, "n_tokens": np.concatenate([rest[order], np.full(len(whole), capacity, np.int64)]),
        })

    return items.groupBy("pack_id", "part").applyInPandas(one_part, "pack_id int, container string, doc_id long, piece int, start_token long, n_tokens long")


def fill(assignment: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """``pack_id, capacity_tokens, n_containers, n_pieces, used_tokens, fill`` for each capacity."""
    per = assignment.groupBy("pack_id", "container").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).groupBy("pack_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("used_tokens"))
    table = F.create_map(*[x for p, c in capacities for x in (F.lit(int(p)), F.lit(int(c)).cast("long"))])
    return per.withColumn("capacity_tokens", table[F.col("pack_id")]).select("pack_id", "capacity_tokens", "n_containers", "n_pieces", "used_tokens", (F.col("used_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))


def limits(assignment: DataFrame, capacities: list[tuple[int, int]], most_docs: int, cost_factor: float) -> DataFrame:
    """How an assignment keeps its limits: ``pack_id, n_documents, n_tokens, n_over_tokens, n_over_docs, n_over_cost`` for each
    capacity, the last three counting containers beyond a limit."""
    table = F.create_map(*[x for p, c in capacities for x in (F.lit(int(p)), F.lit(int(c)).cast("long"))])
    n = F.col("n_tokens").cast("double")
    per = assignment.groupBy("pack_id", "container").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.sum(n * n).alias("cost")).withColumn("c", table[F.col("pack_id")])
    over = lambda what: F.count(F.when(what, True))
    kept = per.groupBy("pack_id").agg(F.sum("t").alias("n_tokens"), over(F.col("t") > F.col("c")).alias("n_over_tokens"), over(F.col("n") > most_docs).alias("n_over_docs"), over((F.col("n") > 1) & (F.col("cost") > cost_factor * F.col("c") * F.col("c"))).alias("n_over_cost"))
    docs = assignment.select("pack_id", "doc_id").distinct().groupBy("pack_id").agg(F.count("*").alias("n_documents"))
    return docs.join(kept, "pack_id")
