"""Descriptions of spell effects from a table of effects: each code has a kind, a name or template, and a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import effect_value, fill_slots

#: Level up to which growth is followed; formulas that change with each tick, and by how much.
TOP_LEVEL, BY_TICK = 100, {107: 1, 108: 2, 120: 5, 122: 12}


def max_out_level(formula: Column, base: Column, most: Column, level: Column) -> Column:
    """The first level from a given one at which the value reaches its maximum; TOP_LEVEL where none does."""
    levels = F.when(level <= TOP_LEVEL, F.sequence(level.cast("int"), F.lit(TOP_LEVEL)))
    return F.coalesce(F.array_min(F.filter(levels, lambda v: F.abs(effect_value(formula, base, most, F.lit(1), v)) >= most)), F.lit(TOP_LEVEL))


def change_text(name: Column, unit: Column, low: Column, high: Column, low_level: Column, high_level: Column) -> Column:
    """Increase or decrease of something by a value, or from one at a level to another at a higher level."""
    amount = lambda v: F.concat(F.abs(v).cast("string"), unit)
    at = lambda v, level: F.concat(amount(v), F.lit(" (L"), level.cast("string"), F.lit(")"))
    by = F.when(low != high, F.concat(at(low, low_level), F.lit(" to "), at(high, high_level))).otherwise(amount(high))
    return F.concat(F.when(high < 0, "Decrease ").otherwise("Increase "), name, F.lit(" by "), by)


def focus_text(name: Column, low: Column, high: Column, negate: Column | bool = False) -> Column:
    """A percentage or a range of them; ends that stand the wrong way round are put right first."""
    first = F.when((low < 0) & (low < high), high).otherwise(low)
    last = F.when(low < 0, F.least(low, high)).otherwise(F.greatest(low, high))
    sign = F.when(F.lit(negate) if isinstance(negate, bool) else negate, -1).otherwise(1)
    one = F.concat(F.abs(first).cast("string"), F.lit("%"))
    span = F.when((first == last) | (last == 0), one).otherwise(F.concat(one, F.lit(" to "), F.abs(last).cast("string"), F.lit("%")))
    return F.concat(F.when(last * sign < 0, "Decrease ").otherwise("Increase "), name, F.lit(" by "), span)


def up_to_level(most: Column) -> Column:
    return F.when(most > 0, F.concat(F.lit(" up to level "), most.cast("string"))).otherwise(F.lit(""))


def range_text(formula: Column, base: Column, most: Column, effect: Column, ticks: Column, level: int) -> Column:
    """How a value changes from tick to tick, its random span, or the level at which it scales; else empty."""
    start, finish = (effect_value(formula, base, most, t, F.lit(level)) for t in (F.lit(1), ticks))
    rate = F.when(formula.between(1001, 1999), formula - 1000).when(formula.between(4001, 4999), formula - 4000)
    for code, by in BY_TICK.items():
        rate = rate.when(formula == code, by)
    way = F.when(F.abs(start) < F.abs(finish), " (Growing to ").otherwise(" (Decaying to ")
    ticking = F.concat(way, F.abs(finish).cast("string"), F.lit(" @ "), rate.cast("string"), F.lit("/tick)"))
    chance = F.concat(F.lit(" (Random: "), F.abs(base).cast("string"), F.lit(" to "), F.abs(most).cast("string"), F.lit(")"))
    scales = formula.between(3000, 3999)
    out = F.when(formula == 123, chance).when(rate.isNotNull(), ticking)
    return out.when(scales & (formula - 3500 == effect), " (Scales, Base Level: 105)").when(scales & (formula - 3000 == effect), " (Scales, Base Level: 100)").otherwise(F.lit(""))


def describe(slots: DataFrame, effects: DataFrame, server_level: int, name: str = "description") -> DataFrame:
    """slots with the description of each.

    slots: effect, formula, base, limit, most, ticks, level (the least at which a class can use it, 255 for none).
    effects: effect (unique), kind (standard, focus or text), label, unit, per_tick. Labels of kind text are templates
    in which #1, $1 and @1 stand for base, limit and most. Effects without a row have no description (null).
    """
    c = F.col
    rows = slots.join(effects.select("effect", *(c(x).alias(f"__{x}") for x in ("kind", "label", "unit", "per_tick"))), "effect", "left")
    value = lambda level: effect_value(c("formula"), c("base"), c("most"), F.lit(1), level)
    rows = rows.withColumns({"__a": value(c("level")), "__b": value(F.lit(server_level))})
    crossed = (c("__a") < c("__b")) & (c("__b") < 0)
    rows = rows.withColumns({"__low": F.when(crossed, c("__b")).otherwise(c("__a")), "__high": F.when(crossed, c("__a")).otherwise(c("__b"))})
    top = F.when((c("formula") != 100) & (c("level") < 255), max_out_level(c("formula"), c("base"), c("most"), c("level"))).otherwise(F.lit(server_level))
    tick = F.when(F.coalesce("__per_tick", F.lit(False)), F.concat(F.when(c("ticks") != 0, " per tick ").otherwise(F.lit("")), range_text(c("formula"), c("base"), c("most"), c("effect"), c("ticks"), server_level))).otherwise(F.lit(""))
    standard = F.concat(change_text(c("__label"), F.coalesce("__unit", F.lit("")), c("__low"), c("__high"), c("level"), top), tick)
    text = fill_slots(c("__label"), c("ticks"), F.array("base"), F.array("limit"), F.array("most"))
    out = F.when(c("__kind") == "standard", standard).when(c("__kind") == "focus", focus_text(c("__label"), c("base"), c("limit"))).when(c("__kind") == "text", text)
    return rows.withColumn(name, out).select(*slots.columns, name)
