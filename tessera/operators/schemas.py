"""Answers against a schema that each row has for itself: typed violations with their paths.

A schema is a small tree of :class:`Text`, :class:`Number`, :class:`Items` and :class:`Fields`; the
values that a text may have can be a column, as each article has its own ids.  The
answer is a VARIANT and is walked inside its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOUND = "array<struct<path:string,kind:string,found:string>>"


@dataclass(frozen=True)
class Text:
    """A string; ``among``: an array column of the allowed ones; ``nullable``: null will do."""

    among: Column | None = None
    nullable: bool = False


@dataclass(frozen=True)
class Number:
    """A whole number."""

    nullable: bool = False


@dataclass(frozen=True)
class Items:
    """A list, of at most ``most`` items."""

    of: Text | Number | Items | Fields
    most: int | None = None


@dataclass(frozen=True)
class Fields:
    """An object; all fields are needed but those in ``optional``, and no others are allowed."""

    fields: dict[str, Text | Number | Items | Fields]
    optional: tuple[str, ...] = ()


def _one(path: Column, kind: str, found: Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(kind).alias("kind"), found.cast("string").alias("found"))).cast(_FOUND)


def _none() -> Column:
    return F.array().cast(_FOUND)


def _walk(value: Column, schema: Text | Number | Items | Fields, path: Column) -> Column:
    kind = F.schema_of_variant(value)
    shown = F.to_json(value)
    wrong = _one(path, "wrong_type", kind)
    if isinstance(schema, Text):
        text = F.try_variant_get(value, "$", "string")
        fits = _none() if schema.among is None else F.when(F.array_contains(schema.among, text), _none()).otherwise(_one(path, "not_allowed", text))
        out = F.when(kind == "STRING", fits)
    elif isinstance(schema, Number):
        out = F.when(kind == "BIGINT", _none())
    elif isinstance(schema, Items):
        items = F.try_variant_get(value, "$", "array<variant>")
        inside = F.flatten(F.transform(items, lambda x, i: _walk(x, schema.of, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        many = _none() if schema.most is None else F.when(F.size(items) > schema.most, _one(path, "too_many", F.size(items))).otherwise(_none())
        out = F.when(kind.startswith("ARRAY"), F.concat(many, inside))
    else:
        parts = []
        for name, of in schema.fields.items():
            own, at = F.try_variant_get(value, f"$.{name}", "variant"), F.concat(path, F.lit(f".{name}"))
            gone = _none() if name in schema.optional else _one(at, "missing", F.lit(None))
            parts.append(F.when(own.isNull(), gone).otherwise(_walk(own, of, at)))
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        more = F.array_sort(F.filter(keys, lambda k: ~k.isin(list(schema.fields))))
        parts.append(F.transform(more, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown_field").alias("kind"), F.lit(None).cast("string").alias("found"))))
        out = F.when(kind.startswith("OBJECT"), F.concat(*parts))
        return out.otherwise(wrong)
    if isinstance(schema, Items):
        return out.otherwise(wrong)
    return F.when((kind == "VOID") & F.lit(schema.nullable), _none()).otherwise(F.coalesce(out, _one(path, "wrong_type", F.coalesce(kind, shown))))


def violations(answers: DataFrame, keys: list[str], answer: str, schema: Fields) -> DataFrame:
    """``keys, path, kind, found``: what is wrong with each JSON answer; an answer that fits has no rows.

    Kinds: ``not_json``, ``wrong_type`` (found: the type that is there), ``missing``, ``unknown_field``,
    ``too_many``, ``not_allowed``.  Null answers are not JSON.  Columns of the schema are
    those of the answer's own row.
    """
    v = F.try_parse_json(F.col(answer))
    parsed = answers.withColumn("_v", v)
    found = F.when(F.col("_v").isNull(), _one(F.lit("$"), "not_json", F.lit(None))).otherwise(_walk(F.col("_v"), schema, F.lit("$")))
    return parsed.select(*keys, F.explode(found).alias("x")).select(*keys, "x.path", "x.kind", "x.found")


def selection(ids: Column, verbs: Column, most_goals: int = 3, most_actions: int = 12) -> Fields:
    """The schema of an answer that picks sentences of one article by their ``ids``."""
    action = Fields({"ids": Items(Text(ids)), "name": Text(), "desc": Text(), "path": Text(nullable=True), "verb": Text(verbs, nullable=True)})
    return Fields({"goals": Items(Fields({"intent_index": Number(), "topic": Text(), "actions": Items(action, most_actions)}), most_goals)})
