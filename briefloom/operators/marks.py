"""What texts hold, looked for by RE2 in Arrow's batches, which passes over a text many times faster than Java's expressions.

For plain ASCII, RE2 and Java agree about words and case.  Of other texts all that may hold something are marked, for Java
to look at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import vocab

_BLANKS = " \t\n\x0b\f\r"
#: Patterns by what a sentence is searched for (``T.CUES``).
_CUES = {
    "decisions": vocab.words([*vocab.DECISION, *vocab.REJECTION]), "constraints": vocab.words(vocab.REQUIREMENT), "todos": vocab.words(vocab.TODO),
    "dependencies": vocab.DEPENDENCY_PATTERN, "risky": vocab.words(vocab.RISK), "goal": vocab.words(vocab.GOAL_SENTENCE),
}
#: Patterns by what a paragraph may hold: all that do hold it match, others may too.
_MAY = {
    "log": T.LOG_CUE, "keyed": "[A-Z0-9]-[0-9]",
    "listed": rf"(?i)(?:{vocab.alternation(vocab.SECTION)}|(?:^|\n)[{_BLANKS}]*(?:[-*][{_BLANKS}]*)?{vocab.alternation(vocab.GHERKIN)})",
}


def _loose(pattern: str) -> str:
    """The pattern wherever it stands, word or not."""
    return pattern.replace(r"\b", "")


_ANY = "|".join(f"(?:{_loose(p)})" for p in _CUES.values())
FIELDS = f"goal boolean, log boolean, keyed boolean, listed boolean, said array<struct<j:int,text:string,{','.join(f'{k}:boolean' for k in _CUES)}>>"


def _is_ascii(texts: pa.Array) -> pa.Array:
    return pc.equal(pc.binary_length(texts), pc.utf8_length(texts))


def _found(texts: pa.Array, plain: pa.Array, pattern: str) -> pa.Array:
    exact = pc.match_substring_regex(texts, pattern)
    return exact if pc.all(plain).as_py() in (True, None) else pc.if_else(plain, exact, pc.match_substring_regex(texts, _loose(pattern)))


def _said(texts: pa.Array) -> pa.Array:
    """By paragraph its sentences (``T.sentences``) that hold a cue."""
    cut = pc.replace_substring_regex(texts, rf"([.!?])[{_BLANKS}]+([A-Z\"'(\[])", "\\1\n\\2")
    lists = pc.split_pattern(cut, "\n")
    owner, each = pc.list_parent_indices(lists).to_numpy(), pc.ascii_trim(pc.list_flatten(lists), characters=_BLANKS)
    full = pc.not_equal(each, "")
    owner, each = owner[full.to_numpy(zero_copy_only=False)], each.filter(full)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    some = pc.match_substring_regex(each, _ANY)
    each, at = each.filter(some), some.to_numpy(zero_copy_only=False)
    owner, place, plain = owner[at], place[at], _is_ascii(each)
    held = [_found(each, plain, p) for p in _CUES.values()]
    hit = np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in held])
    rows = pa.StructArray.from_arrays([pa.array(place, pa.int32()), each, *held], ["j", "text", *_CUES]).filter(pa.array(hit))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[hit], np.arange(len(texts) + 1)), pa.int32()), rows)


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with what their ``text`` holds: whether it states a ``goal``, and may hold a ``log``, keys (``keyed``) and criteria
    (``listed``), and what its sentences say (``said``), with a flag for each of ``T.CUES``.  Of a text that isn't ASCII, a goal
    or cue says that it may be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            more = [_found(texts, _is_ascii(texts), vocab.words(vocab.GOAL_BLOCK)), *(pc.match_substring_regex(texts, p) for p in _MAY.values()), _said(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "goal", *_MAY, "said"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(FIELDS).fields]))
