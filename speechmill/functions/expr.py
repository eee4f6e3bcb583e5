"""Small building blocks for nested column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    The optimizer folds a projection into the lambda that uses it, which would evaluate an
    expensive input once per array element. A lambda variable cannot be folded away.
    """
    return F.transform(F.array(value), body)[0]


def text_array(values) -> Column:
    """ARRAY<STRING> literal, also for no values."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def lookup(key: Column, table: Mapping[str, int], default: int) -> Column:
    """Value of ``key`` in a small fixed table, else ``default``."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(key, F.lit(""))), F.lit(default))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def join_lines(*parts: Column, sep: str = "\n") -> Column:
    """Join the parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), sep)


def unnest(df: DataFrame, keep, elements: Column, name: str = "") -> DataFrame:
    """``keep`` columns and one row per array element; a struct element becomes its fields.

    An inner generator makes the optimizer infer a size filter on its input, which computes an
    expensive array twice. The outer form does not, and the row it adds for an empty array is
    dropped again. Elements must not be null.
    """
    rows = df.select(*keep, F.explode_outer(elements).alias("_element")).filter(F.col("_element").isNotNull())
    if name:
        return rows.withColumnRenamed("_element", name)
    return rows.select("*", "_element.*").drop("_element")


def computed_if(df: DataFrame, out: str, value: Column, condition: Callable[[Column], Column]) -> DataFrame:
    """Add a computed column and keep the rows where it meets the condition.

    A plain filter on a computed column is pushed below the projection and computes it twice.
    ``value`` must not be null.
    """
    return df.withColumn(out, F.explode_outer(F.filter(F.array(value), condition))).filter(F.col(out).isNotNull())


def unnest_map(df: DataFrame, keep, entries: Column, key: str, value: str) -> DataFrame:
    """``keep`` columns and one row per map entry; see :func:`unnest`."""
    return df.select(*keep, F.explode_outer(entries).alias(key, value)).filter(F.col(key).isNotNull())


def unnest_numbered(df: DataFrame, keep, elements: Column, position: str, name: str) -> DataFrame:
    """``keep`` columns and one row per array element with its position from 0; see :func:`unnest`."""
    rows = df.select(*keep, F.posexplode_outer(elements).alias(position, name))
    return rows.filter(F.col(position).isNotNull())
