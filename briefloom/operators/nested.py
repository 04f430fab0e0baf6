"""Deeply nested JSON records into flat child tables.

``NestedRecords`` parses each record once into a variant, infers one merged schema over all records
(drifting shapes included) and turns every array level into child rows that carry the surrogate key of
their parent and their place in the array.  All nodes of a record come from one ``explode``; there is
no join and no shuffle, so a hot source or a huge batch changes nothing in the plan.

Keys are paths with ordinals, e.g. ``17/issues[2]/fields.labels[0]``: unique, stable over re-runs and
readable, and a prefix of every descendant's key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored


@dataclass
class Shape:
    """Merged schema of one place: the scalar type seen, the fields of objects and the elements of arrays."""

    scalar: str | None = None
    fields: dict[str, "Shape"] = field(default_factory=dict)
    items: "Shape | None" = None
    mixed: bool = False


def _parse_type(text: str) -> Shape:
    """Shape of a variant type string such as ``OBJECT<a: ARRAY<STRING>>``."""
    pos = 0

    def name() -> str:
        nonlocal pos
        if text[pos] == "`":
            end = pos + 1
            while text[end] != "`" or text[end : end + 2] == "``":
                end += 2 if text[end : end + 2] == "``" else 1
            out = text[pos + 1 : end].replace("``", "`")
            pos = end + 1
        else:
            end = text.index(":", pos)
            out, pos = text[pos:end], end
        return out

    def one() -> Shape:
        nonlocal pos
        if text.startswith("OBJECT<", pos):
            pos += 7
            shape = Shape()
            while text[pos] != ">":
                key = name()
                pos += 2
                shape.fields[key] = one()
                if text.startswith(", ", pos):
                    pos += 2
            pos += 1
            return shape
        if text.startswith("ARRAY<", pos):
            pos += 6
            shape = Shape(items=one())
            pos += 1
            return shape
        word = re.compile(r"[A-Z_]+(\(\d+, *\d+\))?").match(text, pos)
        pos = word.end()
        kind = word.group()
        return Shape(mixed=kind == "VARIANT", scalar=None if kind in ("VARIANT", "VOID") else kind)

    return one()


def _step(name: str) -> str:
    """A field as a step of a variant path."""
    return f".{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else '["' + name.replace('"', '\\"') + '"]'


def parse_json_strict(text: Column) -> Column:
    """The variant of a text that is exactly one JSON value; null for null, blank, broken or trailing text."""
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    parts = F.try_variant_get(whole, "$", "array<variant>")
    return F.when(F.size(parts) == 1, parts[0])


def _getter(path: str) -> Callable[[Column], Column]:
    return lambda x: F.try_variant_get(x, path, "variant")


def is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null if it is absent, null, an object or an array."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(~is_array(got) & ~is_object(got), F.try_variant_get(v, path, "string"))


class NestedRecords:
    """Nodes and child tables of JSON records.

    ``df`` has the record's key in ``id_col`` and its JSON text in ``json_col``.  Other columns are
    ignored, whatever their names.  Null or invalid payloads give no rows; an empty table gives empty
    tables; repeated keys give repeated rows; null elements keep their ordinal and have a null value.
    """

    def __init__(self, df: DataFrame, id_col: str, json_col: str):
        self.records = stored(df.select(F.col(id_col).alias("record_id"), parse_json_strict(F.col(json_col)).alias("v")).filter("v is not null"))  # parsed once
        self._shape: Shape | None = None

    # ---- merged schema -------------------------------------------------------------------------------
    def _values(self, steps: tuple[str, ...]) -> Column:
        """All values at a place as an array; ``[]`` is the step into an array."""
        out = F.array(F.col("v"))
        for s in steps:
            if s == "[]":
                out = F.flatten(F.transform(out, lambda x: F.when(is_array(x), F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))))
            else:
                out = F.transform(out, _getter("$" + _step(s)))
        return out

    @property
    def shape(self) -> Shape:
        """The merged schema.  Places whose type drifts are looked into again, as arrays and as objects."""
        if self._shape is None:
            got = self.records.agg(F.schema_of_variant_agg("v").alias("s")).first()[0]
            root = _parse_type(got) if got else Shape()
            while mixed := self._mixed(root, ()):  # each round looks one level deeper at least
                aggs = []
                for k, (steps, _) in enumerate(mixed):
                    arrays = F.filter(self._values(steps), is_array)
                    objects = F.filter(self._values(steps), is_object)
                    # One variant array of all that a record holds at this place merges its own elements first.
                    aggs += [F.transform(arrays, lambda x: x).alias(f"a{k}"), F.transform(objects, lambda x: x).alias(f"o{k}")]
                wide = self.records.select(*aggs)
                parts = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("x")) for n in wide.columns])
                found = wide.select(F.explode(parts).alias("p")).select("p.n", F.explode("p.x").alias("x")).groupBy("n").agg(F.schema_of_variant_agg("x").alias("s")).collect()  # two short rows a drifting place
                by = {r["n"]: _parse_type(r["s"]) for r in found}
                for k, (_, shape) in enumerate(mixed):
                    shape.mixed, shape.scalar = False, "STRING"
                    shape.items = by.get(f"a{k}", Shape()).items
                    shape.fields = by.get(f"o{k}", Shape()).fields
            self._shape = root
        return self._shape

    def _mixed(self, shape: Shape, steps: tuple[str, ...]) -> list[tuple[tuple[str, ...], Shape]]:
        out = [(steps, shape)] if shape.mixed else []
        for k, x in shape.fields.items():
            out += self._mixed(x, (*steps, k))
        return out + (self._mixed(shape.items, (*steps, "[]")) if shape.items else [])

    def _arrays_below(self, shape: Shape, steps: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Shape]]:
        """Arrays reached from a place through objects only."""
        out = [(steps, shape.items)] if shape.items else []
        for k, x in shape.fields.items():
            out += self._arrays_below(x, (*steps, k))
        return out

    def array_paths(self) -> list[str]:
        """Paths of all array levels, e.g. ``$.issues[*].fields.labels[*]``."""
        out: list[str] = []

        def walk(shape: Shape, at: str) -> None:
            for steps, items in self._arrays_below(shape):
                path = at + "".join(map(_step, steps)) + "[*]"
                out.append(path)
                walk(items, path)

        walk(self.shape, "$")
        return out

    # ---- nodes ---------------------------------------------------------------------------------------
    def nodes(self, carry: Mapping[str, Callable[[Column, str], Column | None]] | None = None) -> DataFrame:
        """One row for the record (path ``$``) and one for each array element at any depth.

        Columns ``record_id, node_key, parent_key, path, ord, value`` and one string for each entry of
        ``carry``: its function gets a node's variant and path and returns a value for that node and all
        below it, or None to keep the parent's.
        """
        carry = carry or {}
        none = F.lit(None).cast("string")

        def inherit(v: Column, path: str, above: dict[str, Column]) -> dict[str, Column]:
            out = {}
            for k, f in carry.items():
                own = f(v, path)
                out[k] = above[k] if own is None else own.cast("string")
            return out

        def node(key, parent, path, ordinal, v, own):
            return F.struct(key.alias("node_key"), parent.alias("parent_key"), F.lit(path).alias("path"), ordinal.cast("int").alias("ord"), v.alias("value"), *[own[k].alias(k) for k in carry])

        def element(items: Shape, at: str, label: str, key: Column, own: dict[str, Column]):
            def each(x, i):
                k = F.concat(key, F.lit(label), i.cast("string"), F.lit("]"))
                mine = inherit(x, at, own)
                return F.concat(F.array(node(k, key, at, i, x, mine)), *below(items, x, at, k, mine))

            return each

        def below(shape: Shape, v: Column, path: str, key: Column, own: dict[str, Column]) -> list[Column]:
            out = []
            for steps, items in self._arrays_below(shape):
                step = "".join(map(_step, steps))
                at, label = f"{path}{step}[*]", "/" + step.lstrip(".") + "["
                got = F.try_variant_get(v, "$" + step, "array<variant>") if steps else F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>"))

                rows = F.flatten(F.transform(got, element(items, at, label, key, own)))
                out.append(F.coalesce(rows, F.filter(F.array(node(key, key, at, F.lit(0), v, own)), lambda _: F.lit(False))))
            return out

        key = F.col("record_id").cast("string")
        own = inherit(F.col("v"), "$", dict.fromkeys(carry, none))
        parts = [F.array(node(key, none, "$", F.lit(0), F.col("v"), own)), *below(self.shape, F.col("v"), "$", key, own)]
        return self.records.select("record_id", F.explode(F.concat(*parts)).alias("n")).select("record_id", "n.*")

    def tables(self) -> dict[str, DataFrame]:
        """The related flat tables by path: the records and each array level, with the scalar fields of their
        objects as columns (``assignee.displayName`` becomes ``assignee_displayName``), bare elements as
        ``value`` and, on every row, ``record_id, node_key, parent_key, ord``."""
        nodes, out = stored(self.nodes()), {}  # one pass over the records for all tables

        def scalars(shape: Shape, steps: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str | None]]:
            own = [(steps, shape.scalar)] if shape.scalar or not (shape.fields or shape.items) else []
            return own + [x for k, s in shape.fields.items() for x in scalars(s, (*steps, k))]

        def walk(shape: Shape, at: str) -> None:
            names: dict[str, Column] = {}
            for steps, kind in scalars(shape):
                name = base = "_".join(steps) or "value"
                k = 1
                while name.lower() in {"record_id", "node_key", "parent_key", "ord", *(x.lower() for x in names)}:
                    k += 1
                    name = f"{base}_{k}"
                at_step = "$" + "".join(map(_step, steps))
                names[name] = text_at(F.col("value"), at_step) if kind in (None, "STRING") else F.try_variant_get("value", at_step, kind)
            out[at] = nodes.filter(F.col("path") == at).select("record_id", "node_key", "parent_key", "ord", *[c.alias(n) for n, c in names.items()])
            for steps, items in self._arrays_below(shape):
                walk(items, at + "".join(map(_step, steps)) + "[*]")

        walk(self.shape, "$")
        return out


#: Blank characters at the ends of a value: white space, and what Unicode counts to it.
_BLANK = r"[\s\u001c-\u001f\u0085   -     　]+"


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_BLANK}|{_BLANK}$", "")


def ticket_children(df: DataFrame, id_col: str = "raw_id", json_col: str = "payload") -> DataFrame:
    """Assignees, labels, links and comments of the tickets in JSON exports.

    Columns ``raw_id, ticket_key, entity, pos, val``, distinct.  A record is one ticket, a page of tickets
    under ``issues`` or an array of tickets.  Null elements keep their position and give no row.
    """

    def at_ticket(path: str) -> bool:
        return path in ("$", "$.issues[*]", "$[*]", "$[*].issues[*]")

    records = NestedRecords(df, id_col, json_col)
    nodes = records.nodes({
        "ticket_key": lambda v, p: text_at(v, "$.key") if at_ticket(p) else None,
        "main": lambda v, p: is_array(F.try_variant_get(v, "$.fields.comment.comments", "variant")) if at_ticket(p) else None,
    })
    v, path = F.col("value"), F.col("path")
    under = lambda tail: path.isin(*[p + tail for p in ("$", "$.issues[*]", "$[*]", "$[*].issues[*]")])
    val = lambda *paths: F.coalesce(*[F.when(strip_blanks(text_at(v, p)) != "", strip_blanks(text_at(v, p))) for p in paths])
    comment = F.when(is_object(v), F.coalesce(val("$.author.displayName", "$.author.name"), F.lit("")))
    kinds = [
        ("assignee", under(""), val("$.fields.assignee.displayName")),
        ("label", under(".fields.labels[*]"), F.when(is_object(v), val("$.name")).otherwise(val("$"))),
        ("link", under(".fields.issuelinks[*]"), val("$.outwardIssue.key", "$.inwardIssue.key")),
        ("comment", under(".fields.comment.comments[*]") | (under(".comment.comments[*]") & (F.col("main") == "false")), comment),
    ]
    entity, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, where, got in reversed(kinds):
        entity, value = F.when(where, F.lit(name)).otherwise(entity), F.when(where, got).otherwise(value)
    return (
        nodes.select(F.col("record_id").alias("raw_id"), "ticket_key", entity.alias("entity"), F.when(under(""), 0).otherwise(F.col("ord")).alias("pos"), value.alias("val"))
        .filter("entity is not null and val is not null")
        .distinct()
    )
