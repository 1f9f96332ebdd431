"""JSON of unknown shape as VARIANT: parsed once, asked by paths, merged, and shredded into columns when it is written.

A text that isn't JSON is null. Asking an array for a name, or a value for a type that it hasn't, gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def at(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path ($.a.b[0]) as a type; null where there is none, or it isn't of that type."""
    return F.try_variant_get(v, path, kind)


def has(v: Column, path: str) -> Column:
    """Whether there is something at a path, a JSON null included."""
    return F.coalesce(F.try_variant_get(v, path, "variant").isNotNull(), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def entries(v: Column) -> Column:
    """The entries of an object as a map; of anything else an empty one."""
    none = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.when(is_object(v), v.try_cast("map<string,variant>")), none)


def merged(old: Column, new: Column) -> Column:
    """An object with the entries of both, the new one's values where both have a name; what is no object counts as an empty one."""
    a, b = entries(old), entries(new)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_variant_object(F.map_concat(kept, b))


def without(v: Column, names: list[str]) -> Column:
    """An object without some names."""
    return F.to_variant_object(F.map_filter(entries(v), lambda k, _: ~k.isin(names)))


def shredded(df: DataFrame, v: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a typed column for each path (name: path, type), so that filters on them reach the files' statistics."""
    return df.withColumns({name: at(F.col(v), path, kind) for name, (path, kind) in paths.items()})
