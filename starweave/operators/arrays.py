"""Array features of a row (entities of a note, readings of a day) as rows of their own, to be joined to facts.

A feature column is a JSON text, a VARIANT, or an array of structs. Text and VARIANT are opened by a lateral table function over
the parsed value; arrays of structs by inline. Elements stay beside their row's columns, nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(element: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(element, f"$.{path}", kind)


def elements(df: DataFrame, column: str, fields: dict[str, str], keep: list[str], outer: bool = False, place: str | None = None) -> DataFrame:
    """One row an element of the array in column: the columns in keep, and each field of the element under its own name.

    fields: name to type; a field that an element lacks, or that is of another type, is null. place names a column for the
    element's place, from 0. A null, an empty array, and text that is no JSON have no elements; with outer such a row stays
    once, with nulls (place too), and without it goes. Null elements are rows of null fields.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        source = df.select(*keep, F.col(column).alias("_array"))
        opened = source.select(*keep, (F.posexplode_outer if outer else F.posexplode)("_array").alias("_pos", "_element"))
        return opened.select(*keep, *([F.col("_pos").alias(place)] if place else []), *(F.col("_element")[n].cast(t).alias(n) for n, t in fields.items()))
    value = F.col(column) if isinstance(kind, T.VariantType) else F.try_parse_json(column)
    source = df.select(*keep, value.alias("_variant"))
    tvf = df.sparkSession.tvf
    function = tvf.variant_explode_outer if outer else tvf.variant_explode
    opened = source.lateralJoin(function(F.col("_variant").outer()))
    return opened.select(*keep, *([F.col("pos").alias(place)] if place else []), *(_field(F.col("value"), n, t).alias(n) for n, t in fields.items()))


def as_json(df: DataFrame, by: list[str], fields: list[str], order: list[str], out: str) -> DataFrame:
    """The rows of a key as a JSON array of objects, in order; the way back from `elements`."""
    item = F.struct(*order, F.struct(*fields).alias("_item"))
    return df.groupBy(*by).agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_item"])).alias(out))


def element_counts(df: DataFrame, column: str, fields: dict[str, str], key: str, facts: DataFrame, fact_key: str, by: list[str], where: Column | None = None) -> DataFrame:
    """How often each combination of by (columns of facts, fields of the elements) occurs among the elements that pass where.
    Elements are filtered, and summed by key and fields, before they meet the facts."""
    own = [n for n in fields if n in by]
    items = elements(df, column, fields, [key])
    items = items if where is None else items.where(where)
    items = items.groupBy(key, *own).agg(F.count("*").alias("_n"))
    wanted = facts.select(F.col(fact_key).alias("_key"), *(c for c in by if c not in fields))
    return items.join(wanted, F.col(key) == F.col("_key")).groupBy(*by).agg(F.sum("_n").alias("n"))
