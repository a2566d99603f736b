"""Timelines of walked paths: when a walker moves and rests, in the order of a path's waypoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of one rest, speeds, seconds of a whole walk, milliseconds of the shortest move.
MOST_REST, SLOWEST, FASTEST, WALK, SHORTEST = 120.0, 20.0, 250.0, 18.0, 180.0
#: Wander types that walk the waypoints in order: back and forth, and twice once through.
BACK_AND_FORTH, ONCE = 3, (4, 6)


def timelines(waypoints: DataFrame, paths: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """One row a path that can be walked: its events, its length in milliseconds, and if it loops.

    waypoints: key, number, x, y, z, pause. paths: key, wander_type, pause_type. Waypoints with a missing or infinite
    place are left out. There is no row for other wander types, for fewer than two waypoints, or for more than
    most where a limit is asked for. Rests of pause type 1 are as stored; of type 0 half to all of that and of type 2 any part, the share
    being a hash of the path and the place in the route, so that it is the same in every run.
    """
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")) for c in "xyz"]
    rows = waypoints.filter(known[0] & known[1] & known[2])
    if most is not None:
        rows = rows.join(waypoints.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") <= most).select(key), key, "left_semi")
    point = F.struct("number", *(F.col(c).cast("double").alias(c) for c in "xyz"), F.greatest(F.lit(0.0), F.coalesce(F.col("pause").cast("double"), F.lit(0.0))).alias("pause"))
    routes = rows.groupBy(key).agg(F.array_sort(F.collect_list(point)).alias("route")).filter(F.size("route") >= 2)
    routes = routes.join(paths.filter(F.col("wander_type").isin(BACK_AND_FORTH, *ONCE)), key)
    routes = routes.withColumn("approximate", (F.col("pause_type") != 1) | F.exists("route", lambda p: p["pause"] > MOST_REST))
    back = F.concat("route", F.reverse(F.slice("route", F.lit(1), F.size("route") - 1)))
    routes = routes.withColumn("route", F.when(F.col("wander_type") == BACK_AND_FORTH, back).otherwise(F.col("route")))
    routes = routes.withColumn("moves", F.transform(F.sequence(F.lit(1), F.size("route") - 1), lambda i: _distance(F.get("route", i - 1), F.get("route", i))))
    total = F.aggregate("moves", F.lit(0.0), lambda acc, d: acc + d)
    routes = routes.withColumn("speed", F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), total / WALK)))

    def step(d: Column, i: Column) -> Column:
        rest = F.least(F.lit(MOST_REST), F.get("route", i + 1)["pause"])
        share = F.pmod(F.xxhash64(F.col(key), i), F.lit(1 << 20)) / float(1 << 20)
        rest = F.when(F.col("pause_type") == 0, rest * (0.5 + 0.5 * share)).when(F.col("pause_type") == 2, rest * share).otherwise(rest)
        return F.struct(F.greatest(F.lit(SHORTEST), d / F.col("speed") * 1000).alias("move"), F.when(rest > 0.01, rest * 1000).otherwise(F.lit(0.0)).alias("rest"))

    routes = routes.withColumn("steps", F.transform("moves", step))
    events = F.flatten(F.transform("steps", lambda s, i: F.filter(F.array(_event("move", s["move"], i, i + 1), _event("pause", s["rest"], i + 1, i + 1)), lambda e: e["length_ms"] > 0)))
    routes = routes.withColumn("events", events)
    length = F.aggregate("events", F.lit(0.0), lambda acc, e: acc + e["length_ms"])
    return routes.select(key, "wander_type", "pause_type", "events", length.alias("duration_ms"), (F.col("wander_type") == BACK_AND_FORTH).alias("loop"), "approximate")


def _distance(a: Column, b: Column) -> Column:
    """Length of a move, in which height counts a quarter."""
    return F.sqrt(sum((w * w * (a[c] - b[c]) * (a[c] - b[c]) for c, w in (("x", 1.0), ("y", 1.0), ("z", 0.25))), F.lit(0.0)))


def _event(kind: str, length: Column, first: Column, last: Column) -> Column:
    place = lambda i: F.struct(*(F.get("route", i)[c].alias(c) for c in "xyz"))
    return F.struct(F.lit(kind).alias("kind"), length.alias("length_ms"), place(first).alias("from"), place(last).alias("to"))
