"""Scalar functions of the catalogue as Column expressions; all stay inside generated code or JVM lambdas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# ---- text

def clean_name(name: Column) -> Column:
    """Display form of an entity name: marks and digits go, underscore is a space, dash a backtick."""
    return F.regexp_replace(F.translate(name, "_-#!~", " `"), "[0-9]", "")


def default_label(label: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit(default))


def natural_key(text: Column) -> Column:
    """Sort key under which digit runs of any length compare as numbers: each is led by the length of its number, and that by its own length."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def key(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+(?=.)", "")
        size = F.length(number).cast("string")
        return F.when(part.rlike("^[0-9]"), F.concat(F.chr(F.length(size) + 47), size, F.lit(":"), number)).otherwise(part)

    return F.array_join(F.transform(parts, key), "")


def signed(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def strip_prefix(text: Column, word: str) -> Column:
    return F.regexp_replace(text, rf"(?i)^{word}\s+", "")


def level_label(low: Column, high: Column) -> Column:
    return F.when(high > low, F.concat(F.lit("Levels "), low.cast("string"), F.lit("-"), high.cast("string"))).otherwise(F.concat(F.lit("Level "), low.cast("string")))


def expand_template(text: Column, values: list[Column]) -> Column:
    """Replace #n by the n-th value; higher numbers first, so that #1 does not take a part of #12."""
    return reduce(lambda t, n: F.replace(t, F.lit(f"#{n}"), values[n - 1].cast("string")), range(len(values), 0, -1), text)


def bracketed(text: Column) -> Column:
    """The segments in square brackets."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), 1)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def label_confidence(a: Column, b: Column) -> Column:
    """Of two label keys: 2 for equal ones, 1 if both have several words, share one of four letters or more and are one edit apart, else 0."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    long_words = lambda c: F.filter(words(c), lambda w: F.length(w) >= 4)
    close = (F.size(words(a)) > 1) & (F.size(words(b)) > 1) & F.arrays_overlap(long_words(a), long_words(b)) & within_one_edit(a, b)
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0).when(a == b, 2).when(close, 1).otherwise(0)


# ---- lists and masks

def parsed_list(text: Column, separator: str = ",") -> Column:
    """Trimmed, distinct, sorted non-empty parts of a delimited list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), f"[{separator}]"), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def mask_labels(mask: Column, labels: dict[int, str], everything: int | None = None) -> Column:
    """Labels of the bits all of which a mask has, in the dictionary's order, joined by spaces."""
    joined = F.array_join(F.array_compact(F.array(*[F.when(mask.bitwiseAND(bit) == bit, F.lit(label)) for bit, label in labels.items()])), " ")
    return joined if everything is None else F.when(mask == everything, F.lit("ALL")).otherwise(joined)


def mask_positions(mask: Column, bits: int = 24) -> Column:
    return F.filter(F.sequence(F.lit(1), F.lit(bits)), lambda i: F.getbit(mask, i - 1) == 1)


def has_any_bit(mask: Column, wanted: int) -> Column:
    return mask.bitwiseAND(wanted) != 0


def class_mask(position: int) -> int:
    return 1 << (position - 1)


# ---- money, time, levels

def money_parts(copper: Column) -> Column:
    whole = copper.cast("long")
    return F.struct(F.floor(whole / 1000).alias("platinum"), F.floor(whole % 1000 / 100).alias("gold"), F.floor(whole % 100 / 10).alias("silver"), (whole % 10).alias("copper"))


def money_text(copper: Column) -> Column:
    """Four units, zero ones left out."""
    p = money_parts(copper)
    part = lambda c, unit: F.when(c > 0, F.concat(c.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(p["platinum"], " pp"), part(p["gold"], " gp"), part(p["silver"], " sp"), part(p["copper"], " cp"))
    return F.when(copper <= 0, F.lit("0 cp")).otherwise(text)


def duration_text(seconds: Column) -> Column:
    """Days, hours, minutes, seconds; smaller units stay once a larger one shows, seconds only if not 0."""
    s = seconds.cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    unit = lambda keep, n, u: F.when(keep, F.concat(n.cast("string"), F.lit(u)))
    return F.concat_ws(" ", unit(d > 0, d, "d"), unit((h > 0) | (d > 0), h, "h"), unit((m > 0) | (h > 0) | (d > 0), m, "m"), unit((r > 0) | ((d == 0) & (h == 0) & (m == 0)), r, "s"))


def min_usable_level(levels: Column) -> Column:
    """The least level of an array, 0 and 255 meaning that a class cannot use it."""
    return F.coalesce(F.array_min(F.filter(levels, lambda x: (x > 0) & (x < 255))), F.lit(255))


def buff_duration(code: Column, stored: Column, level: Column) -> Column:
    """Duration by formula code from the stored duration and the least usable level."""
    clamp = lambda i: F.when(i < stored, F.greatest(i, F.lit(1))).otherwise(stored)
    # fixed values: codes whose result is a line through the level, as (factor, offset)
    linear = {3: (30, 0), 7: (1, 0), 8: (1, 10), 9: (2, 10), 10: (3, 10)}
    out = F.when(code.isin(1, 6), clamp(F.ceil(level / 2))).when(code == 2, clamp(F.ceil(stored * 3 / 5))).when(code.isin(4, 11, 12), stored)
    for c, (factor, offset) in linear.items():
        out = out.when(code == c, clamp(level * factor + offset))
    out = out.when(code == 5, F.least(F.greatest(stored, F.lit(1)), F.lit(3))).when(code == 50, F.lit(72000)).when(code == 3600, F.when(stored == 0, F.lit(3600)).otherwise(stored))
    return out.otherwise(F.lit(0)).cast("long")


def effect_value(code: Column, base: Column, most: Column, tick: Column, level: Column) -> Column:
    """Value of a spell effect by formula code; divisions are real, the end truncates."""
    v, t, b = level.cast("double"), tick.cast("double"), base.cast("double")
    # fixed values: code -> (factor, from level, divisor): factor * (level - from) / divisor above that level
    above = {111: (6, 16, 1), 112: (8, 24, 1), 113: (10, 34, 1), 114: (15, 44, 1), 115: (7, 15, 1), 116: (10, 24, 1), 117: (13, 34, 1), 118: (20, 44, 1),
             124: (1, 50, 1), 125: (2, 50, 1), 126: (3, 50, 1), 127: (4, 50, 1), 128: (5, 50, 1), 129: (10, 50, 1), 130: (15, 50, 1), 131: (20, 50, 1), 132: (25, 50, 1),
             139: (1, 30, 2), 140: (1, 30, 1), 141: (3, 30, 2)}
    # fixed values: code -> (factor, divisor) of the level, and of the tick
    of_level = {101: (1, 2), 102: (1, 1), 103: (2, 1), 104: (3, 1), 105: (4, 1), 109: (1, 4), 110: (1, 6), 119: (1, 8), 121: (1, 3), 143: (3, 4)}
    of_tick = {107: 1, 108: 2, 120: 5, 122: 12}
    # the tables as literals, so that generated code does not grow with them
    table = lambda d: F.try_element_at(F.create_map(*(x for c, row in d.items() for x in (F.lit(c), F.array(*(F.lit(float(y)) for y in row))))), code.cast("int"))
    at = lambda row, i: F.get(row, F.lit(i))
    high, by_level, by_tick = table(above), table(of_level), table({c: (f,) for c, f in of_tick.items()})
    change = F.when(code.isin(60, 70), b / 100).when(by_level.isNotNull(), v * at(by_level, 0) / at(by_level, 1)).when(by_tick.isNotNull(), -t * at(by_tick, 0))
    change = change.when(high.isNotNull(), F.when(v > at(high, 1), (v - at(high, 1)) * at(high, 0) / at(high, 2)).otherwise(F.lit(0.0)))
    change = change.when(code == 123, (F.abs(most) - F.abs(base)) / 2).when(code == 142, F.when(v > 30, 2 * (v - 60)).otherwise(F.lit(0.0))).when(code == 144, 10 * v + 20 * (v - 40))
    change = change.when(code.between(1, 999), code * v).when(code.between(1000, 1999), -t * (code - 1000)).when(code.between(2000, 2999), v * (code - 2000)).when(code.between(4000, 4999), -t * (code - 4000)).otherwise(F.lit(0.0))
    value = F.abs(b) + change
    value = F.when((most != 0) & (value > F.abs(most)), F.abs(most).cast("double")).otherwise(value)
    value = F.when(base < 0, -value).otherwise(value)
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return F.when(code.isin(0, 3000), base.cast("long")).when(code == 100, F.when((most > 0) & (base > most), most).otherwise(base).cast("long")).otherwise(whole.cast("long"))


def food_bucket(units: Column) -> Column:
    """0 to 6 by thresholds; null below 1."""
    return F.when(units <= 0, F.lit(None).cast("int")).when(units <= 5, 0).when(units <= 20, 1).when(units <= 30, 2).when(units <= 40, 3).when(units <= 50, 4).when(units <= 60, 5).otherwise(6)


# ---- numbers and space

def finite(text: Column) -> Column:
    """The number a text holds, or null where it is none, not a number or infinite."""
    n = text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def midpoint(a: Column, b: Column) -> Column:
    return (F.least(a, b) + F.greatest(a, b)) / 2


def negate_axis(x: Column) -> Column:
    """Map coordinate of a database one; never minus zero."""
    return F.when(x == 0, F.lit(0.0)).otherwise(-x)


def roam_box(x1: Column, x2: Column, y1: Column, y2: Column) -> Column:
    """A rectangle, or null where it is all zero or inverted."""
    zero = (x1 == 0) & (x2 == 0) & (y1 == 0) & (y2 == 0)
    return F.when(~zero & (x1 <= x2) & (y1 <= y2), F.struct(x1.alias("min_x"), x2.alias("max_x"), y1.alias("min_y"), y2.alias("max_y")))


def padded_bounds_contain(x: Column, low: Column, high: Column, share: float = 0.15, least: float = 100.0, limit: float = 1e6) -> Column:
    pad = F.greatest((high - low) * share, F.lit(least))
    return x.between(low - pad, high + pad) & x.between(-limit, limit)


# ---- words and templates

def roman_upper(text: Column) -> Column:
    """Words that are well-formed roman numerals in capitals; other words, and numeral letters in no valid order, stay."""
    # fixed value: the form of a numeral up to 4999
    form = "^(M{0,4})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.when(F.upper(w).rlike(form), F.upper(w)).otherwise(w)), "")


def fill_slots(text: Column, ticks: Column, base: Column, limit: Column, most: Column) -> Column:
    """A description with its marks filled: %z the ticks; #n, $n and @n the size of the n-th base, limit and most (arrays).

    A slot that the arrays do not have counts as 0.
    """
    marked = F.replace(F.coalesce(text, F.lit("")), F.lit("%z"), F.concat(F.lit("("), ticks.cast("string"), F.lit(" ticks)")))
    parts = F.regexp_extract_all(marked, F.lit(r"([#$@][0-9]+|[#$@]|[^#$@]+)"), 1)

    def filled(part: Column) -> Column:
        at = F.substr(part, F.lit(2)).try_cast("int") - 1
        value = lambda slots: F.abs(F.coalesce(F.get(slots, at), F.lit(0))).cast("string")
        numbered = lambda mark: part.rlike(f"^[{mark}][0-9]+$")
        return F.when(numbered("#"), value(base)).when(numbered("$"), value(limit)).when(numbered("@"), value(most)).otherwise(part)

    return F.array_join(F.transform(parts, filled), "")


def annotation_kind(label: Column) -> Column:
    """zone-line, portal or null, by the first pattern that the label begins with."""
    # fixed values: what labels of each kind begin with, in order; a portal that asks for a key is none
    line = r"(?i)^(?:to|zone[\s-]*(?:in|out|line)|(?:exit|return)\s+to)\b"
    known = r"(?i)^(?:knowledge|(?:the\s+)?plane\s+of\s+knowledge|p\.?\s*o\.?\s*k\.?)\s+(?:portal|book)\b"
    portal = r"(?i)^(?:(?:an?\s+)?portals?|teleport(?:s|er|ers|ation)?|translocators?)\b"
    keyed = portal + r".*\b(?:attun(?:e|er|ement)?|keys?)\b"
    return F.when(label.rlike(line), "zone-line").when(label.rlike(known), "portal").when(label.rlike(keyed), F.lit(None).cast("string")).when(label.rlike(portal), "portal")


# ---- viewport

def fit_scale(width: Column, height: Column, view_width: float, view_height: float, padding: float = 0.0) -> Column:
    """Units of screen a unit of world, so that a box fits; 1 for a box without extent."""
    if min(view_width, view_height) <= 2 * padding or padding < 0:
        raise ValueError("padding must leave a positive viewport area")
    along = lambda extent, view: F.when(extent != 0, (view - 2 * padding) / extent)
    return F.coalesce(F.least(along(width, view_width), along(height, view_height)), F.lit(1.0))


def to_screen(x: Column, centre: Column, scale: Column, view: float) -> Column:
    """Place on one axis of the screen of a place in the world."""
    return (x - centre) * scale + view / 2


def to_world(place: Column, centre: Column, scale: Column, view: float) -> Column:
    """Place in the world of a place on one axis of the screen; undoes to_screen."""
    return (place - view / 2) / scale + centre


def clamp_zoom(zoom: Column, least: float = 0.25, most: float = 16.0) -> Column:
    if not 0 < least <= most:
        raise ValueError("zoom limits must be positive and in order")
    return F.least(F.lit(most), F.greatest(F.lit(least), zoom))


# ---- labels of places and things

def area_label(low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> Column:
    """A point, or a rectangle by its sides, to two decimals."""
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    span = lambda axis, a, b: F.concat(F.lit(f"{axis} "), two(a), F.lit("\u2013"), two(b))
    return F.when((low_x == high_x) & (low_y == high_y), F.concat_ws(", ", two(high_x), two(high_y))).otherwise(F.concat_ws("; ", span("X", low_x, high_x), span("Y", low_y, high_y)))


def non_zero_origin(x: Column, y: Column) -> Column:
    return (x != 0) | (y != 0)


def count_label(label: Column, more: Column) -> Column:
    return F.when(more > 0, F.concat(label, F.lit(" + "), more.cast("string"), F.lit(" possible"))).otherwise(label)


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def trimmed_decimals(x: Column) -> Column:
    """Two decimals at most, without closing zeros."""
    return F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"\.?0+$", "")


def coordinate_text(x: Column, y: Column, z: Column, order: str = "xyz") -> Column:
    """Coordinates in the order that a game shows them: xyz or yxz."""
    at = {"x": x, "y": y, "z": z}
    return F.concat_ws(", ", *(trimmed_decimals(at[c]) for c in order))


def weapon_ratio(damage: Column, delay: Column) -> Column:
    return F.when((damage > 0) & (delay > 0), F.format_string("%.2f", F.try_divide(delay.cast("double"), damage))).otherwise(F.lit("-"))


def markup_text(text: Column) -> Column:
    """Colour marks and line breaks of a description as plain markup."""
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)<c\s+\"(#[0-9a-f]+)\">", '<span style="color:$1">')
    return F.regexp_replace(text, r"(?i)</c>", "</span>")


def clean_text(text: Column, most: int = 160) -> Column:
    """Without control characters, trimmed, cut."""
    return F.substring(F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")), 1, most)


def task_steps(text: Column) -> Column:
    """Bracketed segments of a task's description: the steps that lead each, and its text."""
    part = lambda p: F.struct(F.transform(F.split(F.regexp_extract(p, r"^([0-9]+(?:,[0-9]+)*)", 1), ","), lambda n: n.try_cast("int")).alias("steps"), F.trim(F.regexp_replace(p, r"^[0-9]+(?:,[0-9]+)*,?", "")).alias("text"))
    return F.transform(bracketed(text), part)


def rebased(value: Column) -> Column:
    """Haste and slow count from 100."""
    return F.when(value < 100, 100 - value).otherwise(value - 100)


def damage_bonus(kind: Column, delay: Column, table: list[int]) -> Column:
    """Bonus of a weapon: one for hands, a table by delay for two-handed kinds, else none."""
    return F.when(kind.isin(0, 2, 4, 42), F.lit(13)).when(kind.isin(1, 35), F.get(F.array(*map(F.lit, table)), delay.cast("int")))


def price_of(alternate: Column, ldon: Column, points: Column, coin: Column) -> Column:
    """Price of a merchant's item: the first kind of currency that it has."""
    paid = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    return F.coalesce(paid(alternate, " alt"), paid(ldon, " ldon"), paid(points, " points"), money_text(coin))


def leveled_classes(levels: Column, names: list[str]) -> Column:
    """Wide level columns as a list of class and level, those that can use it only."""
    kept = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.struct(F.get(F.array(*map(F.lit, names)), i).alias("n"), F.get(levels, i).alias("l"))), lambda e: (e["l"] > 0) & (e["l"] < 255))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["n"], F.lit(" ("), e["l"].cast("string"), F.lit(")"))), ", ")


def found_at(epoch: Column) -> Column:
    """Seconds as a date and time."""
    return F.date_format(F.timestamp_seconds(epoch), "MMM dd, yyyy HH:mm")
