"""Joins, top-k, pages and nested documents in the shapes the catalogue uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows up to which the smaller side of a join is broadcast.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if a count finds few rows, so that many rows of few keys are not dealt out by these; else the join shuffles."""
    return F.broadcast(df) if df.count() <= FEW else df


def mark(df: DataFrame, other: DataFrame, on: str, name: str) -> DataFrame:
    """df with a boolean: does other have the key. One join on distinct keys."""
    keys = other.select(F.col(on)).distinct().withColumn(name, F.lit(True))
    return df.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def marks(df: DataFrame, other: DataFrame, on: str, rules: dict[str, str]) -> DataFrame:
    """df with a boolean a rule: has other a row of the key that fits. One pass over other and one join."""
    found = other.groupBy(on).agg(*(F.bool_or(F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items()))
    return df.join(found, on, "left").select(*df.columns, *(F.coalesce(name, F.lit(False)).alias(name) for name in rules))


def child_count(df: DataFrame, children: DataFrame, on: str, name: str) -> DataFrame:
    """df with the number of its children, 0 where there are none; children are counted before the join."""
    counts = children.groupBy(on).agg(F.count("*").alias(name))
    return df.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in an order."""
    return top_k(df, keys, order, 1).drop("position")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows a key, with their position (long); rows beyond k go before the shuffle."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= k)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Every row with its place in the whole order, from 1: each range of the order is numbered by itself, after the sizes of those before."""
    rows = df.orderBy(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    sizes, before = sorted((r[0], r[1]) for r in rows.groupBy("__range").count().collect()), 0
    starts = []
    for at, n in sizes:
        starts.append((at, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before")
    return rows.join(F.broadcast(starts), "__range").withColumn(name, place).drop("__range", "__before")


def fair_limit(groups: int, each: int = 25, total: int = 5000) -> int:
    """Rows a group so that all groups together stay within a total."""
    return min(each, max(1, total // max(1, groups)))


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page of an ordered result, numbers from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def truncated(df: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, bool]:
    """At most so many rows, and whether there were more."""
    return df.orderBy(*order).limit(most), len(df.limit(most + 1).take(most + 1)) > most


def children_of(df: DataFrame, children: DataFrame, on: str, fields: list[str], name: str) -> DataFrame:
    """df with its children as a sorted list of structs, empty where there are none."""
    lists = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return df.join(lists, on, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def concat_tagged(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Ordered union of results of several kinds, each row with its kind and the place of that."""
    tagged = [df.withColumns({"kind": F.lit(kind), "branch": F.lit(i)}) for i, (kind, df) in enumerate(parts)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def near_join(left: DataFrame, right: DataFrame, on: str, radius: float) -> DataFrame:
    """Pairs with equal key whose points (x, y) lie within a radius. A grid of cells keeps it an equi-join."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = left.withColumns({"cx": cell("x"), "cy": cell("y")})
    around = F.sequence(F.lit(-1), F.lit(1))
    right = right.select(F.col(on), F.col("id").alias("near_id"), F.col("x").alias("near_x"), F.col("y").alias("near_y"))
    right = right.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    right = right.withColumns({"cx": F.floor(F.col("near_x") / radius).cast("long") + F.col("dx"), "cy": F.floor(F.col("near_y") / radius).cast("long") + F.col("dy")}).drop("dx", "dy")
    return left.join(right, [on, "cx", "cy"]).filter(F.hypot(F.col("x") - F.col("near_x"), F.col("y") - F.col("near_y")) <= radius).drop("cx", "cy")
