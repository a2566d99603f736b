"""Search predicates and their dispatch: only filled parameters filter."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[str], Column]


def apply_filters(df: DataFrame, filters: Mapping[str, Predicate], params: Mapping[str, object]) -> DataFrame:
    """AND of the predicates whose parameter is filled (not None, not blank); unknown parameters are ignored."""
    filled = {k: v for k, v in params.items() if k in filters and v is not None and str(v).strip() != ""}
    return df.filter(reduce(lambda a, b: a & b, [filters[k](str(v).strip()) for k, v in filled.items()], F.lit(True)))


def substring(column: str) -> Predicate:
    """Case-insensitive substring; % and _ in the value stay wildcards."""
    return lambda v: F.col(column).ilike(f"%{v}%")


def entity_name(column: str) -> Predicate:
    """Substring of a stored name, in which spaces are underscores and backticks dashes."""
    return lambda v: F.col(column).ilike(f"%{v.replace(' ', '_').replace('`', '-')}%")


def key_or_name(key: str, name: str) -> Predicate:
    """A number is looked up as the key, anything else as a part of the name."""
    return lambda v: F.col(key) == int(v) if v.isdigit() else F.col(name).ilike(f"%{v}%")


def number_like(column: str) -> Predicate:
    return lambda v: F.col(column).cast("string").like(f"%{v}%")


def at_least(column: str) -> Predicate:
    return lambda v: F.col(column) >= float(v)


def at_most(column: str) -> Predicate:
    return lambda v: F.col(column) <= float(v)


def equals(column: str) -> Predicate:
    return lambda v: F.col(column) == v


def one_of(column: str, synonyms: Mapping[str, list[str]] | None = None) -> Predicate:
    """Equality, with values that stand for several."""
    return lambda v: F.col(column).isin((synonyms or {}).get(v, [v]))


def any_bit(column: str) -> Predicate:
    return lambda v: F.col(column).bitwiseAND(int(v)) != 0


def all_masks(column: str) -> Predicate:
    """Every mask of a comma list has a bit in common with the column."""
    return lambda v: reduce(lambda a, b: a & b, [F.col(column).bitwiseAND(int(m)) != 0 for m in v.split(",")])


def within(low: Column, high: Column, value: Column | int, none: int = -1) -> Column:
    """value lies between two bounds, each of which is open where it is the sentinel."""
    value = F.lit(value) if isinstance(value, int) else value
    return ((low == none) | (low <= value)) & ((high == none) | (high >= value))


def flags_allow(required: Column, disabled: Column, active: list[str]) -> Column:
    """Comma lists with spaces: a required flag is active (or none is required), no disabling flag is."""
    on = F.array(*[F.lit(a) for a in active]).cast("array<string>")
    parts = lambda c: F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(" ")), ",")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (blank(required) | F.arrays_overlap(parts(required), on)) & (blank(disabled) | ~F.arrays_overlap(parts(disabled), on))


def flag_in_set(flags: Column, flag: str) -> Column:
    """A flag stands in a comma list as it is, spaces included."""
    return F.find_in_set(F.lit(flag), flags) > 0


def not_ignored(column: str, ignored: list[str]) -> Column:
    """NOT IN a constant list; a null is not in it."""
    return F.coalesce(~F.col(column).isin(ignored), F.lit(True)) if ignored else F.lit(True)


def day_range(ts: Column, first: str, last: str) -> Column:
    """From the start of the first day to the end of the last."""
    return (ts >= F.lit(first).cast("timestamp")) & (ts < F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY"))


def matches(df: DataFrame, entries: str, key: str, name: str, match: str) -> DataFrame:
    """df once for each entry of a list (a number, or a part of a name, between bars) that a row fits, with the entry: one pass over df."""
    rules = [(e, F.col(key) == int(e) if e.isdigit() else F.col(name).ilike(f"%{e}%")) for e in dict.fromkeys(x.strip() for x in entries.split("|")) if e]
    return df.withColumn(match, F.explode(F.array_compact(F.array(*(F.when(rule, F.lit(e)) for e, rule in rules)))))
