"""Expressions that walk a schema: apply a function to every string, flatten, fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from contentflow.functions.binding import let


def _has_strings(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_strings(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_strings(f.dataType) for f in dtype)
    return isinstance(dtype, T.StringType)


def map_strings(c: Column, dtype: T.DataType, fn: Callable[[Column], Column]) -> Column:
    """``fn`` on every string inside a value of type ``dtype``."""
    if not _has_strings(dtype):
        return c
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: map_strings(x, dtype.elementType, fn))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), _map_fields(c, dtype, fn))
    return fn(c)


def _map_fields(c: Column, dtype: T.StructType, fn: Callable[[Column], Column]) -> Column:
    """A struct with ``fn`` on its strings.

    Its text fields are mapped as one array, its list fields as another: the plan then holds ``fn``
    twice per struct and not once per field.
    """
    texts = [f.name for f in dtype if isinstance(f.dataType, T.StringType)]
    lists = [f.name for f in dtype if f.dataType == T.ArrayType(T.StringType())]

    def packed(names: list[str], element: T.DataType, kind: str) -> Column:
        together = F.array(*[c[n] for n in names]).cast(T.ArrayType(element))
        return F.transform(together, lambda x: map_strings(x, element, fn)).alias(kind)

    def unpacked(p: Column) -> Column:
        def field(f: T.StructField) -> Column:
            if f.name in texts:
                return F.get(p["texts"], F.lit(texts.index(f.name)))
            if f.name in lists:
                return F.get(p["lists"], F.lit(lists.index(f.name)))
            return map_strings(c[f.name], f.dataType, fn)

        return F.struct(*[field(f).alias(f.name) for f in dtype])

    kinds = [packed(texts, T.StringType(), "texts")] if texts else []
    kinds += [packed(lists, T.ArrayType(T.StringType()), "lists")] if lists else []
    return let(F.struct(*kinds), unpacked) if kinds else unpacked(c)


def map_string_leaves(
    df: DataFrame, fn: Callable[[Column], Column], skip: tuple[str, ...] = ()
) -> DataFrame:
    """``fn`` on every string leaf of every column, nested ones included."""
    return df.select(
        [
            F.col(f"`{f.name}`")
            if f.name in skip
            else map_strings(F.col(f"`{f.name}`"), f.dataType, fn).alias(f.name)
            for f in df.schema
        ]
    )


def flatten_record(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to top-level columns named by their path; arrays stay whole."""

    def leaves(c: Column, dtype: T.DataType, path: str) -> list[Column]:
        if isinstance(dtype, T.StructType):
            return [x for f in dtype for x in leaves(c[f.name], f.dataType, f"{path}{sep}{f.name}")]
        return [c.alias(path)]

    return df.select([x for f in df.schema for x in leaves(F.col(f"`{f.name}`"), f.dataType, f.name)])


def fill_missing(df: DataFrame) -> DataFrame:
    """NULL text becomes '' and NULL lists become empty; other types keep their NULLs."""

    def filled(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(c, F.lit("")).alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.coalesce(c, F.array().cast(f.dataType)).alias(f.name)
        return c

    return df.select([filled(f) for f in df.schema])
