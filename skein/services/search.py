"""Searches of the catalogue: items, NPCs, spells, recipes, tasks, abilities, finds, and one over all names."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import Settings
from skein.functions.scalar import clean_name
from skein.operators import filters as P
from skein.operators import relational as R

#: Item types that are searched as one; and, as kinds of bag, rules on bagtype.
SAME_TYPES = ((7, 19), (56, 64), (33, 39))
BAGS = {555: lambda t: t.between(0, 7), 556: lambda t: t == 13, 557: lambda t: (t >= 9) & (t != 13)}
#: A mask that stands for every class; races that are not searched.
EVERY_CLASS, NO_RACES = 65535, (127, 240)
EFFECTS = ("proceffect", "worneffect", "focuseffect", "clickeffect", "scrolleffect")
STATS = ("ac", "hp", "mana", "damage", "delay", "price")
SORTS = {"name": "Name", "ac": "ac", "hp": "hp", "damage": "damage", "delay": "delay"}


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _number(value: object) -> int:
    """A parameter as a number, 0 if it is none."""
    text = str(value or "").strip()
    return int(float(text)) if text.lstrip("-").replace(".", "", 1).isdigit() else 0


def compared(column: Column, code: int, value: float) -> Column:
    """1 at least, 2 at most, 5 equal; other codes are at least."""
    return {2: column <= value, 5: column == value}.get(code, column >= value)


def stat(name: str, code: int, value: float) -> Column:
    """A condition on an item's figure; at most asks for one at all. The ratio is of delay to damage."""
    if name == "ratio":
        return (F.col("damage") > 0) & F.coalesce(compared(F.try_divide(F.col("delay").cast("double"), F.col("damage")), code, value), F.lit(False))
    if name not in STATS:
        raise ValueError(f"not a figure to search by: {name}")
    return compared(F.col(name), code, value) & ((F.col(name) >= 1) if code == 2 else F.lit(True))


def item_type(value: int, bag_slots: int = 0) -> Column:
    if value in BAGS:
        return (F.col("bagslots") >= max(1, bag_slots)) & BAGS[value](F.col("bagtype"))
    return F.col("itemtype").isin(next((list(s) for s in SAME_TYPES if value in s), [value]))


def class_mask(mask: int) -> Column:
    """A bit in common; every class also takes items of no class."""
    common = F.col("classes").bitwiseAND(mask) != 0
    return common | (F.col("classes") == 0) if mask == EVERY_CLASS else common


def level_window(column: Column, low: int, high: int, top: int) -> Column:
    """Between two levels, cut at the top; without any, up to the top."""
    high = top if low > 0 and high == 0 else high
    high = min(high, top)
    return column.between(low, high) if low > 0 or high > 0 else column <= top


def items(table: DataFrame, spells: DataFrame, params: Mapping[str, object], settings: Settings = Settings(), discovered: DataFrame | None = None) -> DataFrame:
    """Items that fit all filled parameters: name, type, bagslots, slot, augslot, class, effect, evo, stat1 to stat3, min_lvl, max_lvl."""
    p = {k: v for k, v in params.items() if v is not None and str(v).strip() != ""}
    rules = []
    if "name" in p:
        rules.append(P.substring("Name")(str(p["name"])))
    if "type" in p:
        rules.append(item_type(_number(p["type"]), _number(p.get("bagslots"))))
    if "bagslots" in p and _number(p.get("type")) not in BAGS:
        rules.append(F.col("bagslots") >= _number(p["bagslots"]))
    if _number(p.get("slot")):
        rules.append(F.col("slots").bitwiseAND(_number(p["slot"])) != 0)
    if _number(p.get("augslot")):
        rules.append(F.col("augtype").bitwiseAND(1 << (_number(p["augslot"]) - 1)) != 0)
    if _number(p.get("class")):
        rules.append(class_mask(_number(p["class"])))
    if _number(p.get("evo")) == 1:
        rules.append((F.col("evolvinglevel") >= 1) & (F.col("evoid") != 0))
    for k in ("stat1", "stat2", "stat3"):
        if k in p and f"{k}val" in p:
            rules.append(stat(str(p[k]), _number(p.get(f"{k}comp")) or 1, float(str(p[f"{k}val"]))))
    rules.append(level_window(F.col("reqlevel"), _number(p.get("min_lvl")), _number(p.get("max_lvl")), settings.top_level))
    found = table.filter(reduce(lambda a, b: a & b, rules))
    if "effect" in p:
        # one pass: an item's effects against the spells of that name, 0 and 65535 being none
        named = spells.filter(P.substring("name")(str(p["effect"]))).select(F.col("id").alias("effect"))
        own = found.select("id", F.explode(F.array_distinct(F.array(*EFFECTS))).alias("effect")).filter("effect > 0 and effect < 65535")
        found = found.join(own.join(named, "effect", "left_semi").select("id"), "id", "left_semi")
    if settings.only_discovered and discovered is not None:
        found = found.join(discovered.select(F.col("item_id").alias("id")), "id", "left_semi")
    return found


def sorted_by(rows: DataFrame, sort: str, direction: str = "asc", key: str = "id") -> list[Column]:
    """An order that the user chose from those allowed; anything else is by name. Items without damage have the worst ratio."""
    down = direction == "desc"
    by = F.when(F.col("damage") == 0, F.lit(1e9)).otherwise(F.try_divide(F.col("delay").cast("double"), F.col("damage"))) if sort == "ratio" else F.col(SORTS.get(sort, "Name"))
    return [by.desc() if down else by.asc(), F.col(key)]


def paged(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows, each with the number of all rows."""
    return R.page(rows, order, number, size).withColumn("total", F.lit(rows.count()))


def zone_numbers(zones: DataFrame, text: str) -> DataFrame:
    """Numbers of the zones that a number or a part of a name stands for."""
    text = text.strip()
    rule = F.col("zoneidnumber") == int(text) if text.isdigit() else F.col("short_name").ilike(f"%{text}%") | F.col("long_name").ilike(f"%{text}%")
    return zones.filter(rule).select("zoneidnumber").distinct()


def npcs(table: DataFrame, entries: DataFrame, spawns: DataFrame, zones: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """NPCs by name, level and zone. A zone that nothing matches is ignored; else an NPC has a spawn there, or its number begins with the zone's."""
    p = {k: str(v).strip() for k, v in params.items() if v is not None and str(v).strip() != ""}
    found = table.filter(F.col("name").isNotNull() & (F.col("name") != "") & ~F.col("race").isin(*NO_RACES))
    found = P.apply_filters(found, {"name": P.entity_name("name"), "min_lvl": P.at_least("level"), "max_lvl": P.at_most("level")}, p)
    if "zone" in p:
        numbers = zone_numbers(zones, p["zone"])
        if not numbers.isEmpty():
            there = spawns.join(zones.join(numbers, "zoneidnumber", "left_semi").select(F.col("short_name").alias("zone")), "zone", "left_semi").select("spawngroupID")
            by_spawn = entries.join(there, "spawngroupID", "left_semi").select(F.col("npcID").alias("id"))
            prefixed = found.withColumn("zoneidnumber", F.expr("id div 1000")).join(numbers, "zoneidnumber", "left_semi").select("id")
            found = found.join(by_spawn.union(prefixed).distinct(), "id", "left_semi")
    return found


def first_zone(table: DataFrame, entries: DataFrame, spawns: DataFrame) -> DataFrame:
    """NPCs with the zone of their first spawn, that of least id; null for those without one."""
    own = entries.join(spawns.select("spawngroupID", F.col("id").alias("spawn_id"), "zone"), "spawngroupID").groupBy(F.col("npcID").alias("id")).agg(F.min_by("zone", "spawn_id").alias("zone"))
    return table.join(own, "id", "left")


def levels(width: int = 16) -> Column:
    """The wide columns of a spell's levels as one list."""
    return F.array(*(F.col(f"classes{i}") for i in range(1, width + 1)))


def by_level(mode: int, level: int, top: int) -> Mapping[int, object]:
    return {1: lambda x: x == level, 2: lambda x: (x >= level) & (x <= top), 3: lambda x: x <= level}


def spells(table: DataFrame, params: Mapping[str, object], settings: Settings = Settings()) -> DataFrame:
    """Spells by name, class and level: only that level, it and higher, it and lower (opt 1 to 3). A level needs a name or a class."""
    name, level, opt, top = str(params.get("name") or "").strip(), _number(params.get("level")), _number(params.get("opt")) or 3, settings.top_level
    own = _number(params.get("class"))
    if level and not name and not own:
        raise ValueError("a level alone is no search: give a name or a class")
    if own and not 1 <= own <= 16:
        raise ValueError("classes are numbered 1 to 16")
    found = table.filter(P.substring("name")(name)) if name else table
    if own:
        column = F.col(f"classes{own}")
        found = found.filter(column > 0)
        if not level:
            return found.filter(column <= top)
        return found.filter(by_level(opt, min(level, top), top).get(opt, lambda x: F.lit(True))(column) & ((column <= top) if opt != 1 else F.lit(True)))
    if level:
        rule = by_level(opt, min(level, top), top).get(opt)
        return found.filter(F.exists(levels(), rule)) if rule else found
    if name:
        start = 70 if opt == 3 else 1
        rule = {1: lambda x: x == 1, 2: lambda x: (x >= 1) & (x <= top), 3: lambda x: (x <= start) & (x > 0)}[opt]
        return found.filter(F.exists(levels(), rule))
    return found


def other_spells(table: DataFrame, params: Mapping[str, object], shown: DataFrame, settings: Settings = Settings(), most: int = 25) -> tuple[DataFrame, DataFrame]:
    """Spells of a name that are not shown already, at most so many, and how many there are. Without a name, none."""
    name, opt = str(params.get("name") or "").strip(), _number(params.get("opt")) or 2
    opt = opt if opt in (1, 2, 3) else 2
    own = _number(params.get("class"))
    level = _number(params.get("level")) or settings.top_level
    if not name:
        found = table.filter(F.lit(False))
    else:
        rule = lambda x: (x > 0) & {1: x == level, 2: x >= level, 3: x <= level}[opt]
        held = rule(F.col(f"classes{own}")) if 1 <= own <= 16 else F.exists(levels(), rule)
        found = table.filter(F.lower("name").like(f"%{name.lower()}%") & held).join(shown.select("id"), "id", "left_anti")
    return found.orderBy("name", "id").limit(most), found.agg(F.count("*").alias("n"))


def usable_level(found: DataFrame, own: int = 0) -> DataFrame:
    """Spells with the level they are grouped by: a class's, or the least of all that can use them; none drops out."""
    valid = F.col(f"classes{own}") if own else F.array_min(F.filter(levels(), lambda x: (x > 0) & (x < 255)))
    return found.withColumn("level", valid).filter(F.col("level").isNotNull())


def recipes(table: DataFrame, params: Mapping[str, object], settings: Settings = Settings()) -> DataFrame:
    kept = {"name": P.substring("name"), "tradeskill": P.equals("tradeskill"), "min_trivial": P.at_least("trivial"), "max_trivial": P.at_most("trivial")}
    found = P.apply_filters(table.filter("enabled = 1"), kept, params)
    return found.filter(P.within(F.col("min_expansion"), F.col("max_expansion"), settings.expansion))


def tasks(table: DataFrame, activities: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """Enabled tasks by name and level, with the number of their activities; 0 is no bound."""
    found = P.apply_filters(table.filter("enabled = 1"), {"name": P.substring("title")}, params)
    if _number(params.get("level")):
        found = found.filter(P.within(F.col("min_level"), F.col("max_level"), _number(params["level"]), none=0))
    return R.child_count(found, activities.withColumnRenamed("taskid", "id"), "id", "activities")


def finds(discovered: DataFrame, characters: DataFrame, items: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """Finds of characters that are no game masters, latest first: by character (part of a name, or a number), item (number or part of a name), days."""
    p = {k: str(v).strip() for k, v in params.items() if v is not None and str(v).strip() != ""}
    who = characters.filter("gm = 0").select(F.col("name").alias("char_name"), F.col("id").alias("char_id"))
    found = discovered.join(who, F.lower(discovered["char_name"]) == F.lower(who["char_name"])).drop(who["char_name"])
    if "character" in p:
        rule = F.col("char_name").ilike(f"%{p['character']}%")
        found = found.filter(rule | (F.col("char_id") == int(p["character"])) if p["character"].isdigit() else rule)
    if "item" in p:
        found = found.filter(F.col("item_id") == int(p["item"])) if p["item"].isdigit() else found.join(items.filter(P.substring("Name")(p["item"])).select(F.col("id").alias("item_id")), "item_id", "left_semi")
    seconds = lambda day: F.unix_timestamp(F.lit(day).cast("timestamp"))
    if "from" in p:
        found = found.filter(F.col("discovered_date") >= seconds(p["from"]))
    if "to" in p:
        found = found.filter(F.col("discovered_date") < F.unix_timestamp(F.lit(p["to"]).cast("timestamp") + F.expr("INTERVAL 1 DAY")))
    return found


def leaders(found: DataFrame, most: int = 25) -> DataFrame:
    """Characters by their number of finds, with the latest of each; equal numbers by name."""
    counts = found.groupBy("char_name").agg(F.count("*").alias("finds"), F.max("discovered_date").alias("latest"), F.max_by("item_id", F.struct("discovered_date", "item_id")).alias("last_item"))
    top = counts.orderBy(F.col("finds").desc(), "char_name").limit(most)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.col("finds").desc(), "char_name")))  # of as many rows as are asked for


def suggest(tables: Mapping[str, tuple[DataFrame, str, str]], text: str, each: int = 10, most: int = 40) -> DataFrame:
    """Names of all kinds that hold a text, or whose number does: kind, id, name, kinds in their order. NPCs are searched by their stored form.

    tables: kind to (rows, id, name). One row a kind and name, that of least id. Texts of one character find nothing.
    """
    text = text.strip()
    parts = []
    for kind, (rows, key, name) in tables.items():
        held = P.entity_name(name)(text) if kind == "npc" else P.substring(name)(text)
        hits = rows.filter((held | P.number_like(key)(text)) if len(text) > 1 else F.lit(False))
        once = hits.groupBy(F.col(name).alias("name")).agg(F.min(key).alias("id")).select("id", clean_name(F.col("name")).alias("name") if kind == "npc" else F.col("name"))
        parts.append((kind, once.orderBy("name", "id").limit(each)))
    return R.concat_tagged(parts).orderBy("branch", "name", "id").limit(most).select("kind", "branch", "id", "name")
