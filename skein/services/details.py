"""What belongs to one thing, for all things at once: drops, sellers, spells, factions, ranks, rewards, pets, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import Settings
from skein.functions import scalar as S
from skein.operators import relational as R
from skein.services import places


def npc_zones(t, settings: Settings) -> DataFrame:
    """(npcID, short_name, version, long_name, zone_id) of NPCs that spawn in open zones."""
    z = places.open_zones(t("zone"), settings).select("short_name", "version", "long_name", F.col("zoneidnumber").alias("zone_id"))
    s2 = t("spawn2").select("spawngroupID", F.col("zone").alias("short_name"), "version")
    return t("spawnentry").select("spawngroupID", "npcID").join(s2, "spawngroupID").join(z, ["short_name", "version"]).drop("spawngroupID").distinct()


def _drop_entries(t) -> DataFrame:
    """(item_id, lootdrop_id, base) of every drop table, an item's rows together."""
    return t("lootdrop_entries").select("item_id", "lootdrop_id", F.col("chance").alias("base")).repartition("item_id")


def _carriers(t) -> DataFrame:
    """(lootdrop_id, probability, npc_id, npc): NPCs by the drop tables that they have."""
    npcs = t("npc_types").select(F.col("id").alias("npc_id"), S.clean_name(F.col("name")).alias("npc"), "loottable_id")
    return t("loottable_entries").join(npcs, "loottable_id").select("lootdrop_id", "probability", "npc_id", "npc").distinct()


def drops_by_zone(t, settings: Settings = Settings()) -> DataFrame:
    """One row an item and zone: NPCs by name, each once, with the best chance in percent over both tables.

    Drop tables are joined to the numbered names in zones, not to each NPC, and an item's rows are dealt out once and stay together.
    """
    place = ["short_name", "version", "long_name"]
    spots = _carriers(t).join(npc_zones(t, settings).withColumnRenamed("npcID", "npc_id"), "npc_id").select("lootdrop_id", "probability", F.struct("npc", *place).alias("name")).distinct()
    names = R.ranked(spots.select("name").distinct(), [F.col("name")], "spot")
    names = names.withColumn("zone", F.min("spot").over(Window.partitionBy(*(f"name.{c}" for c in place))))
    sold = spots.join(names, "name").select("lootdrop_id", "probability", "spot")
    rows = _drop_entries(t).sortWithinPartitions("item_id").join(R.few(sold), "lootdrop_id")
    once = rows.groupBy("item_id", "spot").agg(F.max(F.col("base") * F.col("probability") / 100).alias("chance"))
    once = once.join(R.few(names.select("spot", "zone", "name.npc")), "spot")
    lists = once.groupBy("item_id", "zone").agg(F.array_sort(F.collect_list(F.struct("npc", "chance"))).alias("npcs"))
    return lists.join(R.few(names.filter("spot = zone").select("zone", *(f"name.{c}" for c in place))), "zone").select("item_id", *place, "npcs")


def top_droppers(t, settings: Settings = Settings(), most: int = 10) -> DataFrame:
    """(item_id, npc_id, npc, chance, position): the NPCs of best chance of every item, each NPC once, of those that spawn in open zones.

    NPCs that have a drop table with one probability drop its items with one chance, so the first of them stand for all;
    and an item's tables of less chance than one with enough NPCs have no say.
    """
    spawned = npc_zones(t, settings).select(F.col("npcID").alias("npc_id")).distinct()
    carriers = _carriers(t).join(spawned, "npc_id", "left_semi").groupBy("lootdrop_id", "probability", "npc_id").agg(F.min("npc").alias("npc"))
    firsts = R.top_k(carriers, ["lootdrop_id", "probability"], [F.col("npc_id")], most)
    firsts = firsts.groupBy("lootdrop_id", "probability").agg(F.collect_list(F.struct("npc_id", "npc")).alias("npcs"))
    firsts = R.few(firsts)
    tables = firsts.select("lootdrop_id", "probability", (F.size("npcs") >= most).alias("enough"))
    rows = _drop_entries(t).join(tables, "lootdrop_id").select("item_id", "lootdrop_id", "probability", (F.col("base") * F.col("probability") / 100).alias("chance"), "enough")
    bar = F.max(F.when(F.col("enough"), F.col("chance"))).over(Window.partitionBy("item_id"))
    rows = rows.withColumn("bar", bar).filter("bar is null or chance >= bar").drop("bar", "enough")
    lists = firsts.select(F.col("lootdrop_id").alias("of"), F.col("probability").alias("with"), "npcs")
    rows = rows.join(lists, (F.col("lootdrop_id") == F.col("of")) & F.col("probability").eqNullSafe(F.col("with"))).select("item_id", "chance", F.inline("npcs"))
    return R.top_k(rows.groupBy("item_id", "npc_id").agg(F.max("chance").alias("chance"), F.min("npc").alias("npc")), ["item_id"], [F.col("chance").desc(), F.col("npc_id")], most)


def sellers(t, settings: Settings = Settings()) -> DataFrame:
    """One row an item and zone, with its sellers in order."""
    m = t("merchantlist").select(F.col("merchantid").alias("merchant_id"), F.col("item").alias("item_id")).distinct()
    npcs = t("npc_types").filter("merchant_id > 0").select("merchant_id", F.col("id").alias("npcID"), S.clean_name(F.col("name")).alias("npc"))
    rows = m.join(npcs, "merchant_id").join(npc_zones(t, settings), "npcID").select("item_id", "short_name", "long_name", "npc", "npcID").distinct()
    return rows.groupBy("item_id", "short_name", "long_name").agg(F.array_sort(F.collect_list("npc")).alias("npcs"))


def gathered(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """(item_id, zone_id, long_name, chance) of what is foraged or fished; a zone by its row of version 0, else the first."""
    first = R.top_k(zones.select(F.col("zoneidnumber").alias("zone_id"), "long_name", "version", "id"), ["zone_id"], [(F.col("version") != 0), F.col("version"), F.col("id")], 1)
    return rows.select(F.col("itemid").alias("item_id"), F.col("zoneid").alias("zone_id"), "chance").distinct().join(first.select("zone_id", "long_name"), "zone_id")


def recipes_of(t) -> DataFrame:
    """(item_id, recipe_id, makes, uses): recipes that give an item, and those that take it."""
    marks = t("tradeskill_recipe_entries").groupBy("item_id", "recipe_id").agg(F.bool_or(F.col("successcount") > 0).alias("makes"), F.bool_or(F.col("componentcount") > 0).alias("uses"))
    return marks.join(t("tradeskill_recipe").filter("enabled = 1").select(F.col("id").alias("recipe_id")), "recipe_id", "left_semi").filter("makes or uses")


def recipe_roles(t) -> DataFrame:
    """One row a recipe: items by role, each as a sorted list."""
    e = t("tradeskill_recipe_entries")
    role = lambda rule: F.array_sort(F.collect_set(F.when(rule, F.col("item_id"))))
    return e.groupBy("recipe_id").agg(
        role(F.col("iscontainer") > 0).alias("containers"), role(F.col("successcount") > 0).alias("made"),
        role(F.col("failcount") > 0).alias("kept"), role((F.col("componentcount") > 0) & (F.col("iscontainer") == 0)).alias("components"),
    )


def sources(t) -> DataFrame:
    """Of every item, how it can be had: one pass over each table and one join, each mark false where a table has no row."""
    marks = [("bought", t("merchantlist").select("item")), ("dropped", t("lootdrop_entries").select("item_id")), ("foraged", t("forage").select("itemid")), ("fished", t("fishing").select("itemid"))]
    every = None
    for i, (_, rows) in enumerate(marks):
        rows = rows.toDF("id").distinct().withColumn("mark", F.lit(i))
        every = rows if every is None else every.unionByName(rows)
    found = every.groupBy("id").agg(*(F.bool_or(F.col("mark") == i).alias(name) for i, (name, _) in enumerate(marks)))
    out = t("items").select("id").join(found, "id", "left").select("id", *(F.coalesce(name, F.lit(False)).alias(name) for name, _ in marks))
    return out.withColumn("tags", F.array_join(F.array_compact(F.array(*(F.when(F.col(name), F.lit(name.capitalize())) for name, _ in marks))), ", "))


def npc_spells(t) -> DataFrame:
    """(npc_id, spellid) that an NPC can cast at its level; a list with a parent has the parent's spells instead of its own.

    NPCs of equal lists and levels have equal spells: these are made distinct once for all of them, so the pairs need not be.
    """
    lists = t("npc_spells").select(F.col("id").alias("npc_spells_id"), F.coalesce(F.nullif("parent_list", F.lit(0)), F.col("id")).alias("list"))
    npcs = t("npc_types").select(F.col("id").alias("npc_id"), "npc_spells_id", "level").filter("level is not null").join(lists, "npc_spells_id")
    npcs = npcs.groupBy("npc_id").agg(F.sort_array(F.collect_set(F.struct("list", "level"))).alias("has"))
    kinds = npcs.select("has").distinct().select("has", F.inline("has"))
    spells = t("npc_spells_entries").select(F.col("npc_spells_id").alias("list"), "spellid", "minlevel", "maxlevel")
    known = spells.join(R.few(kinds), "list").filter("level between minlevel and maxlevel").select("has", "spellid").distinct()
    return known.join(R.few(npcs), "has").select("npc_id", "spellid")


def factions(t) -> DataFrame:
    """(npc_id, raised, lowered): names of factions that killing an NPC raises and lowers; 0 counts for neither."""
    hits = t("npc_faction_entries").filter("value <> 0").join(t("faction_list").select(F.col("id").alias("faction_id"), "name"), "faction_id")
    by_sign = hits.groupBy("npc_faction_id").agg(*(F.array_sort(F.collect_list(F.when(rule, F.col("name")))).alias(side) for side, rule in (("raised", F.col("value") > 0), ("lowered", F.col("value") < 0))))
    return t("npc_types").select(F.col("id").alias("npc_id"), "npc_faction_id").join(by_sign, "npc_faction_id")


def faction_zones(t, settings: Settings = Settings()) -> DataFrame:
    """(faction_id, sign, zone, npcs): in which zones a faction is raised and lowered, and by how many NPCs; those without a zone last."""
    npcs = t("npc_types").select(F.col("id").alias("npcID"), "npc_faction_id")
    hits = t("npc_faction_entries").filter("value <> 0").join(npcs, "npc_faction_id").select("faction_id", F.signum("value").cast("int").alias("sign"), "npcID")
    where = hits.join(npc_zones(t, settings).select("npcID", "long_name").distinct(), "npcID", "left")
    return where.groupBy("faction_id", "sign", F.coalesce("long_name", F.lit("")).alias("zone")).agg(F.count_distinct("npcID").alias("npcs"))


def rewards(t) -> DataFrame:
    """(task_id, items): names of a task's rewards in the order of its list; ids that no item has drop out, and a list without one is empty."""
    ids = t("tasks").select(F.col("id").alias("task_id"), F.posexplode(F.split("reward_id_list", "[|]")).alias("place", "part"))
    ids = ids.select("task_id", "place", F.trim("part").try_cast("long").alias("id")).filter("id > 0")
    named = ids.join(t("items").select("id", F.col("Name").alias("name")), "id")
    lists = named.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("l")).select("task_id", F.array_join(F.transform("l", lambda x: x["name"]), "; ").alias("items"))
    return t("tasks").select(F.col("id").alias("task_id")).join(lists, "task_id", "left").select("task_id", F.coalesce("items", F.lit("")).alias("items"))


def pets(t, own: int, settings: Settings = Settings()) -> DataFrame:
    """Spells of a class that call a pet, each type by its row of least id; pets without an NPC drop out."""
    if not 1 <= own <= 16:
        raise ValueError("classes are numbered 1 to 16")
    first = t("pets").groupBy("type").agg(F.min_by(F.struct("id", "npc_key"), "id").alias("p")).select("type", "p.*")
    npcs = t("npc_types").select(F.col("s_suppkey").alias("npc_key"), F.col("id").alias("npc_id"), "level")
    spells = t("spells_new").select(F.col("id").alias("spell_id"), F.concat(F.lit("pet_"), (F.col("id") % 40).cast("string")).alias("type"), F.col(f"classes{own}").alias("spell_level")).filter(F.col("spell_level").between(1, settings.top_level))
    return spells.join(first, "type").join(npcs, "npc_key").select("spell_id", "spell_level", "type", F.col("id").alias("pet_id"), "npc_id", "level")


def by_key_or(rows: DataFrame, key: str, other: str, value: str) -> DataFrame:
    """The row of a key, or of another column's value where the text is no number that a key has; the least key of several."""
    number = F.lit(value).try_cast("long")
    return rows.filter((F.col(key) == number) | (F.col(other) == value)).orderBy(F.coalesce((F.col(key) != number), F.lit(True)), key).limit(1)


def rank_effects(t) -> DataFrame:
    """Effects of ranks with what their base stands for: a spell or an item by name where the kind says so, else the number; raw for unknown kinds."""
    rows = t("aa_rank_effects").join(t("effect_kinds").withColumnRenamed("base", "kind"), "effect_id", "left")
    says = lambda word: F.coalesce(F.lower("kind").contains(word), F.lit(False))
    spells = t("spells_new").select(F.col("id").alias("base1"), F.col("name").alias("spell"))
    items = t("items").select(F.col("id").alias("base1"), F.col("Name").alias("item"))
    rows = rows.join(spells, "base1", "left").join(items, "base1", "left")
    shown = F.when(says("spellid"), F.col("spell")).when(says("itemid"), F.col("item"))
    return rows.select("rank_id", "effect_id", "kind", F.coalesce(shown, F.col("base1").cast("string")).alias("base"))


def zone_npcs(t) -> DataFrame:
    """NPCs of every zone, those that spawn there before those whose number begins with the zone's; of one name the first stays."""
    z = t("zone").filter("version = 0").select(F.col("zoneidnumber").alias("zone_id"), "short_name")
    npcs = t("npc_types").select("id", "name")
    spawned = t("spawn2").select(F.col("zone").alias("short_name"), "spawngroupID").join(z, "short_name").join(t("spawnentry").select("spawngroupID", F.col("npcID").alias("id")), "spawngroupID").join(npcs, "id").select("zone_id", "id", "name", F.lit(0).alias("branch")).distinct()
    numbered = npcs.withColumn("zone_id", F.expr("id div 1000")).join(z.select("zone_id"), "zone_id", "left_semi").select("zone_id", "id", "name", F.lit(1).alias("branch"))
    both = spawned.unionByName(numbered).withColumn("clean", S.clean_name(F.col("name")))
    return R.first_by(both, ["zone_id", "clean"], [F.col("branch"), F.col("id")]).select("zone_id", "id", "clean")


def zone_summary(t) -> DataFrame:
    """Every zone with the sizes of its parts, in one job for all zones, also those without any."""
    z = t("zone").filter("version = 0").select(F.col("zoneidnumber").alias("zone_id"), "short_name", "expansion")
    parts = {
        "npcs": zone_npcs(t).groupBy("zone_id").agg(F.count("*").alias("n")), "foraged": t("forage").groupBy(F.col("zoneid").alias("zone_id")).agg(F.count_distinct("itemid").alias("n")),
        "fished": t("fishing").groupBy(F.col("zoneid").alias("zone_id")).agg(F.count_distinct("itemid").alias("n")), "tasks": t("task_activities").groupBy(F.col("zones").alias("zone_id")).agg(F.count_distinct("taskid").alias("n")),
    }
    for name, counts in parts.items():
        z = z.join(counts.withColumnRenamed("n", name), "zone_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return z


def zones_by_expansion(t, settings: Settings = Settings()) -> DataFrame:
    """Zones that are shown, by expansion, in natural order of their long names; a zone once, by its first version."""
    rows = t("zone").filter((F.col("expansion") <= settings.expansion) & places.P.not_ignored("short_name", settings.zones_left_out()))
    once = R.first_by(rows, ["zoneidnumber"], [F.col("version"), F.col("id")])
    listed = F.array_sort(F.collect_list(F.struct(S.natural_key(F.col("long_name")).alias("k"), "long_name")))
    return once.groupBy("expansion").agg(F.array_join(F.transform(listed, lambda x: x["long_name"]), "; ").alias("zones"), F.count("*").alias("n"))


def first_listed(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with a mark at the first of each group in an order, where its details are shown."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)
