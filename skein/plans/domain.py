"""Queries of the catalogue's services over tables made from the star schema (world.py), each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.config import Settings
from skein.functions import scalar as S
from skein.operators import relational as R
from skein.plans.catalogue import QUERIES, ORACLE_SQL
from skein.plans.world import SQL, Tables, oracle
from skein.services import details as D
from skein.services import places as L
from skein.services import search as Q

CONFIG = Settings(active_flags=("feast", "frost", " ", "a,b"), ignored_zones=("china", " ", "china"))
_ON = "['feast', 'frost']"


def query(body: str | None, *names: str):
    def add(f):
        def run(spark, sf_dir):
            return f(Tables(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))

        QUERIES[f.__name__] = run
        if body:
            ORACLE_SQL[f.__name__] = oracle(body, *names) if names else body if not body.startswith(" e AS") else "WITH" + body
        return f

    return add


def _flags(a: str) -> str:
    split = lambda c: f"list_has_any(string_split(replace(coalesce({a}.{c}, ''), ' ', ''), ','), {_ON})"
    blank = lambda c: f"trim(coalesce({a}.{c}, '')) = ''"
    return f"({blank('content_flags')} OR {split('content_flags')}) AND ({blank('content_flags_disabled')} OR NOT {split('content_flags_disabled')})"


def _open(a: str) -> str:
    return f"({a}.min_expansion = -1 OR {a}.min_expansion <= 9) AND ({a}.max_expansion = -1 OR {a}.max_expansion >= 9) AND {_flags(a)}"


def _zone(a: str) -> str:
    return f"{a}.expansion <= 9 AND {a}.min_status = 0 AND {a}.short_name NOT IN ('china') AND {_flags(a)}"


_CLEAN = "regexp_replace(replace(replace(replace(replace(replace({}, '#', ''), '!', ''), '~', ''), '_', ' '), '-', '`'), '[0-9]', '', 'g')"
_NPC_ZONES = f"npc_zones AS (SELECT DISTINCT se.npcID, z.short_name, z.version, z.long_name, z.zoneidnumber AS zone_id FROM spawnentry se JOIN spawn2 s2 USING (spawngroupID) JOIN zone z ON z.short_name = s2.zone AND z.version = s2.version WHERE {_zone('z')})"
_PLACES = ("zone", "spawnentry", "spawn2", "npc_types")


# ---- searches

@query("SELECT id FROM items WHERE bagslots >= 3 AND bagtype BETWEEN 0 AND 7 AND Name ILIKE '%a%' AND reqlevel <= 70", "items")
def search_items_bags(t):
    return Q.items(t("items"), t("spells_new"), {"type": "555", "bagslots": "3", "name": "a", "slot": "", "class": None}).select("id")


@query("SELECT id FROM items WHERE bagslots >= 2 AND bagtype >= 9 AND bagtype <> 13 AND reqlevel <= 70 UNION ALL SELECT id + 1000000000 FROM items WHERE itemtype IN (33, 39) AND bagslots >= 4 AND reqlevel <= 70", "items")
def search_items_types(t):
    a, b = (Q.items(t("items"), t("spells_new"), p).select("id") for p in ({"type": 557, "bagslots": 2}, {"type": 39, "bagslots": 4}))
    return a.union(b.select(F.col("id") + 1000000000))


@query("SELECT id FROM items WHERE ((classes & 65535) <> 0 OR classes = 0) AND (slots & 6) <> 0 AND (augtype & 4) <> 0 AND evolvinglevel >= 1 AND evoid <> 0 AND (damage > 0 AND delay * 1.0 / CASE WHEN damage = 0 THEN 1 ELSE damage END >= 1.5) AND ac >= 1 AND ac <= 9 AND hp = 3 AND reqlevel BETWEEN 10 AND 70", "items")
def search_items_stats(t):
    p = {"class": 65535, "slot": 6, "augslot": 3, "evo": 1, "stat1": "ratio", "stat1val": 1.5, "stat2": "ac", "stat2comp": 2, "stat2val": 9, "stat3": "hp", "stat3comp": 5, "stat3val": 3, "min_lvl": 10}
    return Q.items(t("items"), t("spells_new"), p).select("id")


@query("""SELECT i.id FROM items i WHERE reqlevel BETWEEN 0 AND 70 AND EXISTS (SELECT 1 FROM spells_new s WHERE s.name ILIKE '%promo%' AND ((s.id = i.proceffect AND i.proceffect BETWEEN 1 AND 65534) OR (s.id = i.worneffect AND i.worneffect BETWEEN 1 AND 65534) OR (s.id = i.scrolleffect AND i.scrolleffect BETWEEN 1 AND 65534)))
 AND i.id IN (SELECT item_id FROM discovered_items)""", "items", "spells_new", "discovered_items")
def search_items_effect(t):
    return Q.items(t("items"), t("spells_new"), {"effect": "promo", "max_lvl": 90}, Settings(only_discovered=True), t("discovered_items")).select("id")


@query("SELECT id, (SELECT count(*) FROM items WHERE Name ILIKE '%e%' AND reqlevel <= 70) AS total FROM items WHERE Name ILIKE '%e%' AND reqlevel <= 70 ORDER BY CASE WHEN damage = 0 THEN 1e9 ELSE delay * 1.0 / damage END DESC, id LIMIT 50 OFFSET 50", "items")
def search_items_page(t):
    found = Q.items(t("items"), t("spells_new"), {"name": "e"})
    return Q.paged(found, Q.sorted_by(found, "ratio", "desc"), 2, 50).select("id", "total")


@query(f"""SELECT n.id, {_CLEAN.format('n.name')} AS name FROM npc_types n WHERE n.name <> '' AND race NOT IN (127, 240) AND level >= 5 AND level <= 60
 AND (n.id IN (SELECT se.npcID FROM spawnentry se JOIN spawn2 s2 USING (spawngroupID) JOIN zone z ON z.short_name = s2.zone WHERE z.short_name ILIKE '%ion_1%' OR z.long_name ILIKE '%ion_1%') OR n.id // 1000 IN (SELECT zoneidnumber FROM zone WHERE short_name ILIKE '%ion_1%' OR long_name ILIKE '%ion_1%'))""", *_PLACES)
def search_npcs(t):
    found = Q.npcs(t("npc_types"), t("spawnentry"), t("spawn2"), t("zone"), {"name": "supplier", "min_lvl": 5, "max_lvl": 60, "zone": "ion_1"})
    return found.select("id", S.clean_name(F.col("name")).alias("name"))


@query("SELECT n.id, (SELECT arg_min(s2.zone, s2.id) FROM spawnentry se JOIN spawn2 s2 USING (spawngroupID) WHERE se.npcID = n.id) AS zone FROM npc_types n WHERE n.name ILIKE '%the-old%' AND race NOT IN (127, 240)", *_PLACES)
def search_npcs_unknown_zone(t):
    found = Q.npcs(t("npc_types"), t("spawnentry"), t("spawn2"), t("zone"), {"name": "the`old", "zone": "no such zone"})
    return Q.first_zone(found, t("spawnentry"), t("spawn2")).select("id", "zone")


_WIDE = "[" + ", ".join(f"classes{i}" for i in range(1, 17)) + "]"


@query(f"""SELECT 1 AS search, id FROM spells_new WHERE classes3 > 0 AND classes3 = 30 UNION ALL SELECT 2, id FROM spells_new WHERE classes4 > 0 AND classes4 >= 60 AND classes4 <= 70
 UNION ALL SELECT 3, id FROM spells_new WHERE classes5 > 0 AND classes5 <= 20 UNION ALL SELECT 4, id FROM spells_new WHERE name ILIKE '%stand%' AND len(list_filter({_WIDE}, lambda x: x >= 65 AND x <= 70)) > 0
 UNION ALL SELECT 5, id FROM spells_new WHERE name ILIKE '%stand%' AND len(list_filter({_WIDE}, lambda x: x <= 70 AND x > 0)) > 0 UNION ALL SELECT 6, id FROM spells_new WHERE classes6 > 0 AND classes6 <= 70 UNION ALL SELECT 7, id FROM spells_new WHERE name ILIKE '%stand%' AND len(list_filter({_WIDE}, lambda x: x <= 5)) > 0""", "spells_new")
def search_spells(t):
    asked = [{"class": 3, "level": 30, "opt": 1}, {"class": 4, "level": 60, "opt": 2}, {"class": 5, "level": 20}, {"name": "stand", "level": 65, "opt": 2}, {"name": "stand"}, {"class": 6}, {"name": "stand", "level": 5}]
    out = None
    for i, p in enumerate(asked):
        rows = Q.spells(t("spells_new"), p).select(F.lit(i + 1).alias("search"), "id")
        out = rows if out is None else out.union(rows)
    return out


@query(f"SELECT level, count(*) AS n, min(id) AS first FROM (SELECT id, list_min(list_filter({_WIDE}, lambda x: x > 0 AND x < 255)) AS level FROM spells_new) WHERE level IS NOT NULL GROUP BY level", "spells_new")
def group_spells(t):
    return Q.usable_level(t("spells_new")).groupBy("level").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_OTHER = f"lower(name) LIKE '%small%' AND len(list_filter({_WIDE}, lambda x: x > 0 AND x >= 70)) > 0 AND id NOT IN (SELECT id FROM spells_new WHERE classes1 = 10)"


@query(f"SELECT id, (SELECT count(*) FROM spells_new WHERE {_OTHER}) AS n FROM spells_new WHERE {_OTHER} ORDER BY name, id LIMIT 25", "spells_new")
def search_other_spells(t):
    spells = t("spells_new")
    rows, count = Q.other_spells(spells, {"name": " Small "}, spells.filter("classes1 = 10"))
    return rows.select("id").withColumn("n", F.lit(count.first()["n"]))


@query("SELECT id FROM tradeskill_recipe WHERE enabled = 1 AND name ILIKE '%urgent%' AND trivial >= 50 AND trivial <= 200 AND (min_expansion = -1 OR min_expansion <= 9) AND (max_expansion = -1 OR max_expansion >= 9)", "tradeskill_recipe")
def search_recipes(t):
    return Q.recipes(t("tradeskill_recipe"), {"name": "urgent", "min_trivial": 50, "max_trivial": "200", "tradeskill": ""}).select("id")


@query("SELECT t.id, (SELECT count(*) FROM task_activities a WHERE a.taskid = t.id) AS activities FROM tasks t WHERE enabled = 1 AND title ILIKE '%7%' AND (min_level = 0 OR min_level <= 20) AND (max_level = 0 OR max_level >= 20)", "tasks", "task_activities")
def search_tasks(t):
    return Q.tasks(t("tasks"), t("task_activities"), {"name": "7", "level": "20"}).select("id", "activities")


_FINDS = "finds AS (SELECT d.* FROM discovered_items d JOIN character_data c ON lower(c.name) = lower(d.char_name) WHERE gm = 0)"


@query(f", {_FINDS} SELECT f.item_id, f.char_name FROM finds f WHERE f.char_name ILIKE '%2%' AND discovered_date >= epoch(TIMESTAMP '1996-01-01') AND discovered_date < epoch(TIMESTAMP '1997-01-01') AND item_id IN (SELECT id FROM items WHERE Name ILIKE '%a%')", "discovered_items", "character_data", "items")
def search_finds(t):
    found = Q.finds(t("discovered_items"), t("character_data"), t("items"), {"item": "a", "from": "1996-01-01", "to": "1996-12-31"})
    return found.filter(F.col("char_name").ilike("%2%")).select("item_id", "char_name")


@query(f", {_FINDS} SELECT char_name, count(*) AS finds, max(discovered_date) AS latest, arg_max(item_id, (discovered_date, item_id)) AS last_item, row_number() OVER (ORDER BY count(*) DESC, char_name) AS position FROM finds GROUP BY char_name ORDER BY finds DESC, char_name LIMIT 25", "discovered_items", "character_data")
def leaders_of_finds(t):
    return Q.leaders(Q.finds(t("discovered_items"), t("character_data"), t("items"), {}))


def _kind(i: int, kind: str, table: str, name: str, stored: str) -> str:
    shown = _CLEAN.format(name) if kind == "npc" else name
    return f"(SELECT '{kind}' AS kind, {i} AS branch, min(id) AS id, {shown} AS name FROM {table} WHERE {name} ILIKE '%{stored}%' OR CAST(id AS VARCHAR) LIKE '%er 1%' GROUP BY {name} ORDER BY {shown}, min(id) LIMIT 10)"


@query("SELECT * FROM (" + " UNION ALL ".join(_kind(i, *x) for i, x in enumerate((("item", "items", "Name", "er 1"), ("npc", "npc_types", "name", "er_1"), ("zone", "zone", "long_name", "er 1"), ("task", "tasks", "title", "er 1"), ("character", "character_data", "name", "er 1")))) + ") ORDER BY branch, name, id LIMIT 40", "items", "npc_types", "zone", "tasks", "character_data")
def suggest_names(t):
    names = {"item": (t("items"), "id", "Name"), "npc": (t("npc_types"), "id", "name"), "zone": (t("zone"), "id", "long_name"), "task": (t("tasks"), "id", "title"), "character": (t("character_data"), "id", "name")}
    return Q.suggest(names, " er 1 ")


@query("SELECT 'item' AS kind, 0 AS branch, id, Name AS name FROM items WHERE FALSE", "items")
def suggest_nothing(t):
    return Q.suggest({"item": (t("items"), "id", "Name")}, "e")


# ---- places

_SPAWNS = f"""spawns AS (SELECT DISTINCT se.npcID, s2.id AS spawn_id, s2.spawngroupID, z.short_name, z.version, z.zoneidnumber AS zone_id, se.chance, s2.pathgrid, sg.min_x, sg.max_x, sg.min_y, sg.max_y, s2.x
 FROM spawnentry se JOIN spawn2 s2 USING (spawngroupID) JOIN spawngroup sg ON sg.id = s2.spawngroupID JOIN zone z ON z.short_name = s2.zone AND z.version = s2.version
 WHERE se.npcID % 10 <> 3 AND se.chance > 0 AND {_open('se')} AND {_open('s2')} AND {_zone('z')} AND s2.x IS NOT NULL)"""
def _mine():
    return F.expr("npcID % 10 <> 3")



@query(f", {_SPAWNS} SELECT npcID, spawn_id, concat(short_name, ':', version) AS key, chance, x, NOT (min_x = 0 AND max_x = 0 AND min_y = 0 AND max_y = 0) AND min_x <= max_x AND min_y <= max_y AS roams FROM spawns", *_PLACES, "spawngroup")
def npc_locations(t):
    groups = L.location_groups(L.spawn_locations(_mine(), t, CONFIG), CONFIG)
    rows = groups.select("npcID", "key", F.explode("locations").alias("l"))
    return rows.select("npcID", F.col("l.spawn_id").alias("spawn_id"), "key", F.col("l.chance").alias("chance"), F.col("l.x").alias("x"), F.col("l.roam").isNotNull().alias("roams"))


@query(f""", {_SPAWNS}, g AS (SELECT DISTINCT spawngroupID, npcID AS own FROM spawns), k AS (SELECT least(25, greatest(1, 5000 // greatest(1, (SELECT count(*) FROM g)))) AS k),
 c AS (SELECT g.spawngroupID, g.own, se.npcID AS id, max(se.chance) AS chance FROM g JOIN spawnentry se USING (spawngroupID) WHERE se.npcID <> g.own AND se.chance > 0 AND {_open('se')} GROUP BY ALL),
 r AS (SELECT c.spawngroupID, c.id, c.chance, row_number() OVER (PARTITION BY c.spawngroupID ORDER BY c.chance DESC, c.id) AS position FROM (SELECT DISTINCT spawngroupID, id, chance FROM c) c) SELECT spawngroupID, id, chance, position FROM r, k WHERE position <= k.k""", *_PLACES, "spawngroup")
def npc_placeholders(t):
    return L.placeholders(L.spawn_locations(_mine(), t, CONFIG), t, CONFIG).select("spawngroupID", "id", "chance", F.col("position").cast("long").alias("position"))


@query(f""", {_SPAWNS}, p AS (SELECT DISTINCT pathgrid AS gridid, zone_id AS zoneid FROM spawns WHERE pathgrid > 0)
 SELECT e.zoneid, e.gridid, count(*) AS points, arg_min(e.x, e.number) AS first_x, arg_max(e.x, e.number) AS last_x, max(CASE WHEN g.type BETWEEN 0 AND 9 AND g.type2 BETWEEN 0 AND 2 THEN g.type END) AS type FROM grid_entries e JOIN p USING (gridid, zoneid) LEFT JOIN grid g ON g.id = e.gridid AND g.zoneid = e.zoneid GROUP BY e.zoneid, e.gridid""", *_PLACES, "spawngroup", "grid", "grid_entries")
def npc_paths(t):
    walks = L.paths_of(L.spawn_locations(_mine(), t, CONFIG), t)
    return walks.select("zoneid", "gridid", F.size("points").cast("long").alias("points"), F.get("points", F.lit(0))["x"].alias("first_x"), F.element_at("points", -1)["x"].alias("last_x"), "type")


_GROUND = f"""z AS (SELECT * FROM zone WHERE {_zone('zone')}), gs AS (SELECT g.*, i.Name AS item_name FROM ground_spawns g JOIN items i ON i.id = g.item WHERE (min_expansion = -1 OR min_expansion <= 9) AND (max_expansion = -1 OR max_expansion >= 9)
 AND (trim(coalesce(content_flags, '')) = '' OR list_has_any(string_split(content_flags, ','), {_ON})) AND NOT coalesce(list_has_any(string_split(content_flags_disabled, ','), {_ON}), FALSE) AND min_x IS NOT NULL),
 placed AS (SELECT gs.*, z.short_name, z.version AS zone_version FROM gs JOIN z ON z.zoneidnumber = gs.zoneid WHERE gs.version >= 0 AND z.version = gs.version
 UNION ALL SELECT gs.*, z.short_name, z.version FROM gs JOIN (SELECT *, row_number() OVER (PARTITION BY zoneidnumber ORDER BY CASE WHEN version = 0 THEN 0 ELSE 1 END, version, id) AS rn FROM z) z ON z.zoneidnumber = gs.zoneid AND z.rn = 1 WHERE gs.version < 0)"""


@query(f", {_GROUND} SELECT id, item, concat(short_name, ':', zone_version) AS key, item_name AS label, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y, least(min_x, max_x) AS low_x, greatest(min_y, max_y) AS high_y FROM placed", "zone", "ground_spawns", "items")
def item_ground_spawns(t):
    return L.ground_spawns(t, CONFIG).select("id", "item", "key", "label", "x", "y", "low_x", "high_y")


@query(f", {_GROUND}, d AS (SELECT DISTINCT item_id FROM discovered_items) SELECT item, count(*) AS places, count(DISTINCT short_name) AS zones FROM placed WHERE item IN (SELECT item_id FROM d) GROUP BY item", "zone", "ground_spawns", "items", "discovered_items")
def ground_spawn_summary(t):
    import dataclasses

    rows = L.ground_spawns(t, dataclasses.replace(CONFIG, only_discovered=True))
    return rows.groupBy("item").agg(F.count("*").alias("places"), F.count_distinct("short_name").alias("zones"))


def _own(t):
    return L.open_zones(t("zone"), CONFIG)


def _boxes(t):
    """Boxes of maps, in map coordinates: some zones have one."""
    return t("zone").filter("version = 0 and id % 20 = 0").select("short_name", F.col("short_name").alias("zone"), F.lit(-200.0).alias("min_x"), F.lit(0.0).alias("max_x"), F.lit(-5000.0).alias("min_y"), F.lit(5000.0).alias("max_y"))


@query(f"""SELECT s2.id AS spawn_id, n.named, n.merchant, CASE WHEN n.n > 1 THEN concat(n.head, ' + ', n.n - 1, ' possible') ELSE n.head END AS label, CASE WHEN high > low THEN concat('Levels ', low, '-', high) ELSE concat('Level ', low) END AS levels FROM spawn2 s2 JOIN (SELECT * FROM zone z WHERE {_zone('z')}) z ON z.short_name = s2.zone AND z.version = s2.version
 JOIN (SELECT spawngroupID, bool_or(nm) AS named, bool_or(mer) AS merchant, count(*) AS n, coalesce(arg_min(npc, position) FILTER (nm), arg_min(npc, position)) AS head, min(level) AS low, max(greatest(level, maxlevel)) AS high FROM
  (SELECT c.spawngroupID, c.position, {_CLEAN.format('n.name')} AS npc, n.rare_spawn OR n.raid_target AS nm, n.merchant_id > 0 AS mer, level, maxlevel FROM (SELECT spawngroupID, npcID, row_number() OVER (PARTITION BY spawngroupID ORDER BY max(chance) DESC, npcID) AS position FROM spawnentry se WHERE chance > 0 AND {_open('se')} GROUP BY spawngroupID, npcID) c JOIN npc_types n ON n.id = c.npcID WHERE position <= 8) WHERE npc <> '' GROUP BY spawngroupID) n ON n.spawngroupID = s2.spawngroupID
 WHERE {_open('s2')} AND s2.x IS NOT NULL""", *_PLACES)
def atlas_spawns(t):
    rows = L.atlas_spawns(t, _own(t), CONFIG)
    return rows.select("spawn_id", "named", "merchant", "label", "levels")


_EXITS = f"""targets AS (SELECT zoneidnumber AS target_zone_id, arg_min(long_name, (CASE WHEN version = 0 THEN 0 ELSE 1 END, version, id)) AS target FROM zone GROUP BY zoneidnumber), own AS (SELECT short_name, version AS zone_version FROM zone z WHERE {_zone('z')}),
 boxes AS (SELECT short_name FROM zone WHERE version = 0 AND id % 20 = 0),
 exits AS (SELECT p.*, o.zone_version, coalesce(t.target, 'Unknown destination') AS label, (p.x <> 0 OR p.y <> 0) AND (b.short_name IS NULL OR (CASE WHEN p.y = 0 THEN 0 ELSE -p.y END BETWEEN -300 AND 100 AND CASE WHEN p.x = 0 THEN 0 ELSE -p.x END BETWEEN -6500 AND 6500)) AS visible
  FROM zone_points p JOIN own o ON o.short_name = p.zone LEFT JOIN targets t USING (target_zone_id) LEFT JOIN boxes b ON b.short_name = p.zone WHERE {_open('p')} AND (p.version = -1 OR p.version = o.zone_version))"""


@query(f", {_EXITS} SELECT id, zone, zone_version, label, visible FROM exits", "zone", "zone_points")
def atlas_exits(t):
    return L.exits(t, _own(t), _boxes(t), CONFIG).select("id", "zone", "zone_version", "label", "visible")


@query(f""", {_EXITS}, d AS (SELECT d.*, o.zone_version, coalesce(nullif(upper(trim(dest_zone)), 'NONE'), '') AS goes FROM doors d JOIN own o ON o.short_name = d.zone WHERE {_open('d')} AND (d.version = -1 OR d.version = o.zone_version) AND (lockpick <> 0 OR keyitem > 0 OR coalesce(nullif(upper(trim(dest_zone)), 'NONE'), '') <> '' OR opentype = 57)),
 l AS (SELECT zone, zone_version, number, arg_min(id, id) AS point_id, arg_min(visible, id) AS vis, arg_min(x, id) AS px, arg_min(y, id) AS py FROM exits GROUP BY ALL)
 SELECT d.id, d.zone_version, l.point_id, (l.point_id IS NOT NULL OR d.goes <> '') AND NOT coalesce(l.vis AND sqrt((pos_x - px) * (pos_x - px) + (pos_y - py) * (pos_y - py)) <= 8, FALSE) AS also_exit FROM d LEFT JOIN l ON l.zone = d.zone AND l.zone_version = d.zone_version AND l.number = d.door_param AND d.opentype = 57 LEFT JOIN boxes b ON b.short_name = d.zone
 WHERE (pos_x <> 0 OR pos_y <> 0) AND (b.short_name IS NULL OR (CASE WHEN pos_y = 0 THEN 0 ELSE -pos_y END BETWEEN -300 AND 100 AND CASE WHEN pos_x = 0 THEN 0 ELSE -pos_x END BETWEEN -6500 AND 6500))""", "zone", "zone_points", "doors")
def atlas_doors(t):
    rows = L.doors(t, _own(t), _boxes(t), L.exits(t, _own(t), _boxes(t), CONFIG), CONFIG)
    return rows.select("id", "zone_version", "point_id", F.array_contains("layers", "zone-points").alias("also_exit"))


@query(f"SELECT o.id, z.version AS zone_version, coalesce(nullif(trim(o.display_name), ''), i.Name, 'Object') AS label FROM object o JOIN zone z ON z.zoneidnumber = o.zoneid LEFT JOIN items i ON i.id = o.itemid WHERE {_zone('z')} AND {_open('o')} AND (o.itemid = 0 OR o.itemid IN (SELECT item_id FROM discovered_items))", "object", "zone", "items", "discovered_items")
def atlas_objects(t):
    import dataclasses

    return L.objects(t, _own(t), dataclasses.replace(CONFIG, only_discovered=True)).select("id", "zone_version", "label")


@query(f""", x AS (SELECT zone, unnest(CASE WHEN c % 2 = 0 THEN ['doors', 'zone-points'] ELSE ['doors'] END) AS layer FROM (SELECT zone, id AS c FROM doors)), l AS (SELECT unnest(['npcs', 'named', 'merchants', 'spawns', 'ground-spawns', 'zone-points', 'doors', 'objects', 'safe-points']) AS layer)
 SELECT z.zone, l.layer, count(x.layer) AS n FROM (SELECT DISTINCT zone FROM doors) z CROSS JOIN l LEFT JOIN x ON x.zone = z.zone AND x.layer = l.layer GROUP BY z.zone, l.layer""", "doors")
def atlas_layers(t):
    rows = t("doors").select("zone", F.when(F.col("id") % 2 == 0, F.array(F.lit("doors"), F.lit("zone-points"), F.lit("doors"))).otherwise(F.array(F.lit("doors"))).alias("layers"))
    return L.layer_counts(rows, ["zone"]).select("zone", "layer", "n")


@query("SELECT id, zone, c > 3 AS more FROM (SELECT id, zone, row_number() OVER (PARTITION BY zone ORDER BY id) AS rn, count(*) OVER (PARTITION BY zone) AS c FROM doors) WHERE rn <= 3", "doors")
def atlas_truncated(t):
    return L.truncated_at(t("doors").select("id", "zone"), ["zone"], [F.col("id")], 3).select("id", "zone", "more")


@query("SELECT short_name, version AS zone_version, 'Safe point' AS label, safe_x AS x FROM zone WHERE safe_x <> 0 OR safe_y <> 0", "zone")
def atlas_safe_points(t):
    return L.safe_points(t("zone")).select("short_name", "zone_version", "label", "x")


# ---- details

_DROPS = f"{_NPC_ZONES}, drops AS (SELECT DISTINCT l.item_id, n.id AS npc_id, {_CLEAN.format('n.name')} AS npc, z.short_name, z.version, z.long_name, l.chance FROM (SELECT loottable_id, item_id, max(chance * probability / 100) AS chance FROM loottable_entries JOIN lootdrop_entries USING (lootdrop_id) GROUP BY ALL) l JOIN npc_types n USING (loottable_id) JOIN npc_zones z ON z.npcID = n.id)"
_LOOT = (*_PLACES, "loottable_entries", "lootdrop_entries")


@query(f", {_DROPS} SELECT item_id, npc_id, chance, position FROM (SELECT item_id, npc_id, max(chance) AS chance, row_number() OVER (PARTITION BY item_id ORDER BY max(chance) DESC, npc_id) AS position FROM drops GROUP BY item_id, npc_id) WHERE position <= 10", *_LOOT)
def item_top_droppers(t):
    return D.top_droppers(t, CONFIG).select("item_id", "npc_id", "chance", F.col("position").cast("long").alias("position"))


@query(f", {_DROPS} SELECT item_id, short_name, CAST(version AS INTEGER) AS version, string_agg(npc, '; ' ORDER BY npc) AS npcs, max(chance) AS best FROM (SELECT item_id, short_name, version, npc, max(chance) AS chance FROM drops GROUP BY ALL) GROUP BY item_id, short_name, version", *_LOOT)
def item_drops_by_zone(t):
    rows = D.drops_by_zone(t, CONFIG)
    return rows.select("item_id", "short_name", F.col("version").cast("int").alias("version"), F.array_join(F.transform("npcs", lambda x: x["npc"]), "; ").alias("npcs"), F.array_max(F.transform("npcs", lambda x: x["chance"])).alias("best"))


@query(f", {_NPC_ZONES} SELECT item_id, short_name, string_agg(npc, '; ' ORDER BY npc) AS npcs FROM (SELECT DISTINCT m.item AS item_id, z.short_name, {_CLEAN.format('n.name')} AS npc, n.id FROM merchantlist m JOIN npc_types n ON n.merchant_id = m.merchantid AND n.merchant_id > 0 JOIN npc_zones z ON z.npcID = n.id) GROUP BY item_id, short_name", *_PLACES, "merchantlist")
def item_sellers(t):
    return D.sellers(t, CONFIG).select("item_id", "short_name", F.array_join("npcs", "; ").alias("npcs"))


_FIRST_ZONE = "(SELECT zoneidnumber, arg_min(long_name, (CASE WHEN version = 0 THEN 0 ELSE 1 END, version, id)) AS long_name FROM zone GROUP BY zoneidnumber)"


@query(f"SELECT 'forage' AS how, itemid AS item_id, long_name, chance FROM forage JOIN {_FIRST_ZONE} z ON z.zoneidnumber = zoneid UNION ALL SELECT 'fishing', itemid, long_name, chance FROM fishing JOIN {_FIRST_ZONE} z ON z.zoneidnumber = zoneid", "forage", "fishing", "zone")
def item_gathered(t):
    parts = [D.gathered(t(how), t("zone")).select(F.lit(how).alias("how"), "item_id", "long_name", "chance") for how in ("forage", "fishing")]
    return parts[0].union(parts[1])


@query("SELECT item_id, recipe_id, bool_or(successcount > 0) AS makes, bool_or(componentcount > 0) AS uses FROM tradeskill_recipe_entries WHERE recipe_id IN (SELECT id FROM tradeskill_recipe WHERE enabled = 1) GROUP BY item_id, recipe_id HAVING bool_or(successcount > 0) OR bool_or(componentcount > 0)", "tradeskill_recipe_entries", "tradeskill_recipe")
def item_recipes(t):
    return D.recipes_of(t).select("item_id", "recipe_id", "makes", "uses")


@query("SELECT recipe_id, CAST(count(DISTINCT item_id) FILTER (iscontainer > 0) AS BIGINT) AS containers, min(item_id) FILTER (successcount > 0) AS first_made, count(DISTINCT item_id) FILTER (componentcount > 0 AND iscontainer = 0) AS components FROM tradeskill_recipe_entries GROUP BY recipe_id", "tradeskill_recipe_entries")
def recipe_roles(t):
    return D.recipe_roles(t).select("recipe_id", F.size("containers").cast("long").alias("containers"), F.get("made", F.lit(0)).alias("first_made"), F.size("components").cast("long").alias("components"))


@query("SELECT id, concat_ws(', ', CASE WHEN id IN (SELECT item FROM merchantlist) THEN 'Bought' END, CASE WHEN id IN (SELECT item_id FROM lootdrop_entries) THEN 'Dropped' END, CASE WHEN id IN (SELECT itemid FROM forage) THEN 'Foraged' END, CASE WHEN id IN (SELECT itemid FROM fishing) THEN 'Fished' END) AS tags FROM items", "items", "merchantlist", "lootdrop_entries", "forage", "fishing")
def item_sources(t):
    return D.sources(t).select("id", "tags")


@query("SELECT DISTINCT n.id AS npc_id, e.spellid FROM npc_types n JOIN npc_spells l ON l.id = n.npc_spells_id JOIN npc_spells_entries e ON e.npc_spells_id = CASE WHEN l.parent_list > 0 THEN l.parent_list ELSE l.id END WHERE n.level BETWEEN e.minlevel AND e.maxlevel", "npc_types", "npc_spells", "npc_spells_entries")
def npc_spell_lists(t):
    return D.npc_spells(t)


@query("SELECT n.id AS npc_id, coalesce(string_agg(f.name, ';' ORDER BY f.name) FILTER (e.value > 0), '') AS raised, coalesce(string_agg(f.name, ';' ORDER BY f.name) FILTER (e.value < 0), '') AS lowered FROM npc_types n JOIN npc_faction_entries e USING (npc_faction_id) JOIN faction_list f ON f.id = e.faction_id WHERE e.value <> 0 GROUP BY n.id", "npc_types", "npc_faction_entries", "faction_list")
def npc_factions(t):
    return D.factions(t).select("npc_id", F.array_join("raised", ";").alias("raised"), F.array_join("lowered", ";").alias("lowered"))


@query(f", {_NPC_ZONES} SELECT e.faction_id, CASE WHEN e.value > 0 THEN 1 ELSE -1 END AS sign, coalesce(z.long_name, '') AS zone, count(DISTINCT n.id) AS npcs FROM npc_faction_entries e JOIN npc_types n USING (npc_faction_id) LEFT JOIN (SELECT DISTINCT npcID, long_name FROM npc_zones) z ON z.npcID = n.id WHERE e.value <> 0 GROUP BY ALL", *_PLACES, "npc_faction_entries")
def faction_zones(t):
    return D.faction_zones(t, CONFIG)


@query("""SELECT t.id AS task_id, coalesce(string_agg(i.Name, '; ' ORDER BY r.place), '') AS items FROM tasks t LEFT JOIN (SELECT id, unnest(range(1, 5)) AS place, string_split(reward_id_list, '|') AS l FROM tasks) r ON r.id = t.id LEFT JOIN items i ON i.id = TRY_CAST(r.l[r.place] AS BIGINT) AND i.id > 0 GROUP BY t.id""", "tasks", "items")
def task_rewards(t):
    return D.rewards(t)


@query("SELECT s.id AS spell_id, s.classes2 AS spell_level, p.id AS pet_id, n.id AS npc_id FROM spells_new s JOIN (SELECT type, min(id) AS id, arg_min(npc_key, id) AS npc_key FROM pets GROUP BY type) p ON p.type = concat('pet_', s.id % 40) JOIN npc_types n ON n.s_suppkey = p.npc_key WHERE s.classes2 BETWEEN 1 AND 70", "spells_new", "pets", "npc_types")
def pets_of_class(t):
    return D.pets(t, 2).select("spell_id", "spell_level", "pet_id", "npc_id")


@query("SELECT id, type FROM pets WHERE type = 'pet_7' ORDER BY id LIMIT 1", "pets")
def pet_by_key_or_type(t):
    return D.by_key_or(t("pets"), "id", "type", "pet_7").select("id", "type")


@query("SELECT r.rank_id, r.effect_id, k.base AS kind, CASE WHEN lower(k.base) LIKE '%spellid%' THEN coalesce(s.name, CAST(base1 AS VARCHAR)) WHEN lower(k.base) LIKE '%itemid%' THEN coalesce(i.Name, CAST(base1 AS VARCHAR)) ELSE CAST(base1 AS VARCHAR) END AS base FROM aa_rank_effects r LEFT JOIN effect_kinds k USING (effect_id) LEFT JOIN spells_new s ON s.id = base1 LEFT JOIN items i ON i.id = base1", "aa_rank_effects", "effect_kinds", "spells_new", "items")
def ability_rank_effects(t):
    return D.rank_effects(t)


@query("SELECT a.id, a.name, (SELECT count(*) FROM aa_ranks r WHERE r.id >= a.first_rank_id AND r.id < a.first_rank_id + 5) AS ranks FROM aa_ability a WHERE a.enabled = 1 AND (a.classes & 1) <> 0 AND (a.classes & 12) <> 0", "aa_ability", "aa_ranks")
def abilities(t):
    from skein.operators import filters as P
    from skein.operators import graph
    from skein.plans.catalogue import _shared

    found = P.apply_filters(t("aa_ability").filter("enabled = 1"), {"masks": P.all_masks("classes")}, {"masks": "1,12"})
    nodes = t("aa_ranks").select(F.col("id").cast("long").alias("id"), F.col("next_id").cast("long").alias("next_id"))
    _shared(nodes)
    ranks = graph.chain_ranks(nodes, found.select(F.col("first_rank_id").cast("long").alias("id")))
    known = ranks.join(nodes.select("id"), "id", "left_semi").groupBy(F.col("start").alias("first_rank_id")).agg(F.count("*").alias("ranks"))
    return found.join(known, "first_rank_id", "left").select("id", "name", F.coalesce("ranks", F.lit(0).cast("long")).alias("ranks"))


_ZONE_NPCS = f"zone_npcs AS (SELECT zone_id, id, clean FROM (SELECT *, row_number() OVER (PARTITION BY zone_id, clean ORDER BY branch, id) AS rn FROM (SELECT z.zoneidnumber AS zone_id, n.id, {_CLEAN.format('n.name')} AS clean, 0 AS branch FROM spawn2 s JOIN zone z ON z.short_name = s.zone AND z.version = 0 JOIN spawnentry e USING (spawngroupID) JOIN npc_types n ON n.id = e.npcID UNION SELECT n.id // 1000, n.id, {_CLEAN.format('n.name')}, 1 FROM npc_types n WHERE n.id // 1000 IN (SELECT zoneidnumber FROM zone))) WHERE rn = 1)"


@query(f", {_ZONE_NPCS} SELECT zone_id, id, clean FROM zone_npcs", *_PLACES)
def zone_npcs(t):
    return D.zone_npcs(t)


@query(f", {_ZONE_NPCS} SELECT zoneidnumber AS zone_id, (SELECT count(*) FROM zone_npcs n WHERE n.zone_id = z.zoneidnumber) AS npcs, (SELECT count(DISTINCT itemid) FROM forage WHERE zoneid = z.zoneidnumber) AS foraged, (SELECT count(DISTINCT itemid) FROM fishing WHERE zoneid = z.zoneidnumber) AS fished, (SELECT count(DISTINCT taskid) FROM task_activities WHERE zones = z.zoneidnumber) AS tasks FROM zone z WHERE version = 0", *_PLACES, "forage", "fishing", "task_activities")
def zone_summaries(t):
    return D.zone_summary(t).select("zone_id", "npcs", "foraged", "fished", "tasks")


@query("SELECT expansion, string_agg(long_name, '; ' ORDER BY zoneidnumber) AS zones, count(*) AS n FROM zone WHERE version = 0 AND expansion <= 9 AND short_name <> 'china' GROUP BY expansion", "zone")
def zones_by_expansion(t):
    return D.zones_by_expansion(t, CONFIG)


@query(f", {_NPC_ZONES} SELECT npcID, short_name, row_number() OVER (PARTITION BY npcID ORDER BY short_name, version) = 1 AS shown FROM npc_zones", *_PLACES)
def first_in_listing(t):
    return D.first_listed(D.npc_zones(t, CONFIG), ["npcID"], [F.col("short_name"), F.col("version")], "shown").select("npcID", "short_name", "shown")


# ---- labels and formulas

@query("""SELECT id, format('{:,}', price) AS price, CASE WHEN damage > 0 AND delay > 0 THEN printf('%.2f', round(delay * 1.0 / damage, 2)) ELSE '-' END AS ratio, CASE WHEN hp < 100 THEN 100 - hp ELSE hp - 100 END AS slow,
 CASE WHEN itemtype IN (0, 2, 4, 42) THEN 13 WHEN itemtype IN (1, 35) THEN CASE WHEN delay < 20 THEN delay * 2 END END AS bonus, CASE WHEN hp > 0 THEN concat(Name, ' + ', hp, ' possible') ELSE Name END AS label FROM items""", "items")
def item_labels(t):
    c = F.col
    return t("items").select("id", S.thousands(c("price")).alias("price"), S.weapon_ratio(c("damage"), c("delay")).alias("ratio"), S.rebased(c("hp")).alias("slow"), S.damage_bonus(c("itemtype"), c("delay"), [2 * i for i in range(20)]).alias("bonus"), S.count_label(c("Name"), c("hp")).alias("label"))


@query("SELECT id, strftime(to_timestamp(id * 86461) AT TIME ZONE 'UTC', '%b %d, %Y %H:%M') AS found, concat('a', chr(10), '<span style=\"color:#a1b2c3\">', name, '</span>') AS text, array_to_string([i || ':' || (id % 9)::VARCHAR for i in ['1,2', '7']], '|') AS steps FROM (SELECT p_partkey AS id, p_name AS name FROM part) p")
def text_labels(t):
    rows = t("items").select("id", F.col("Name").alias("name"))
    text = F.concat(F.lit('a<BR /><c "#a1b2c3">'), F.col("name"), F.lit("</C>"))
    task = F.concat(F.lit("[1,2,x"), (F.col("id") % 9).cast("string"), F.lit("] or [7,x"), (F.col("id") % 9).cast("string"), F.lit("]"))
    steps = F.array_join(F.transform(S.task_steps(task), lambda s: F.concat(F.array_join(F.transform(s["steps"], lambda n: n.cast("string")), ","), F.lit(":"), F.substring(s["text"], 2, 9))), "|")
    return rows.select("id", S.found_at(F.col("id") * 86461).alias("found"), S.markup_text(text).alias("text"), steps.alias("steps"))


_ABOVE = {111: (6, 16, 1), 112: (8, 24, 1), 113: (10, 34, 1), 114: (15, 44, 1), 115: (7, 15, 1), 116: (10, 24, 1), 117: (13, 34, 1), 118: (20, 44, 1), 124: (1, 50, 1), 125: (2, 50, 1), 126: (3, 50, 1), 127: (4, 50, 1), 128: (5, 50, 1), 129: (10, 50, 1), 130: (15, 50, 1), 131: (20, 50, 1), 132: (25, 50, 1), 139: (1, 30, 2), 140: (1, 30, 1), 141: (3, 30, 2)}
_CODES = "[0, 60, 70, " + ", ".join(str(i) for i in [*range(100, 106), *range(107, 133), *range(139, 145)]) + ", 250, 1007, 2003, 3000, 3500, 4009, 5000]"
_DELTA = (
    "CASE WHEN code IN (60, 70) THEN b / 100.0 WHEN code = 101 THEN v / 2.0 WHEN code = 102 THEN v WHEN code = 103 THEN 2.0 * v WHEN code = 104 THEN 3.0 * v WHEN code = 105 THEN 4.0 * v WHEN code = 107 THEN -1.0 * t WHEN code = 108 THEN -2.0 * t WHEN code = 109 THEN v / 4.0 WHEN code = 110 THEN v / 6.0 WHEN code = 119 THEN v / 8.0 WHEN code = 120 THEN -5.0 * t WHEN code = 121 THEN v / 3.0 WHEN code = 122 THEN -12.0 * t WHEN code = 123 THEN (abs(m) - abs(b)) / 2.0 "
    + " ".join(f"WHEN code = {c} THEN CASE WHEN v > {low} THEN {f} * (v - {low}) / {d}.0 ELSE 0 END" for c, (f, low, d) in _ABOVE.items())
    + " WHEN code = 142 THEN CASE WHEN v > 30 THEN 2.0 * (v - 60) ELSE 0 END WHEN code = 143 THEN 3 * v / 4.0 WHEN code = 144 THEN 10.0 * v + 20 * (v - 40) WHEN code BETWEEN 1 AND 999 THEN 1.0 * code * v WHEN code BETWEEN 1000 AND 1999 THEN -1.0 * t * (code - 1000) WHEN code BETWEEN 2000 AND 2999 THEN 1.0 * v * (code - 2000) WHEN code BETWEEN 4000 AND 4999 THEN -1.0 * t * (code - 4000) ELSE 0.0 END"
)


@query(f""" e AS (SELECT p_partkey AS id, unnest({_CODES}) AS code, p_size - 25 AS b, (p_partkey % 5) * 40 AS m, p_partkey % 4 AS t, p_size + 20 AS v FROM part), x AS (SELECT *, abs(b) + CAST({_DELTA} AS DOUBLE) AS raw FROM e), y AS (SELECT *, CASE WHEN m <> 0 AND raw > abs(m) THEN abs(m) ELSE raw END AS capped FROM x)
 SELECT id, CAST(code AS INTEGER) AS code, CAST(CASE WHEN code IN (0, 3000) THEN b WHEN code = 100 THEN CASE WHEN m > 0 AND b > m THEN m ELSE b END ELSE trunc(CASE WHEN b < 0 THEN -capped ELSE capped END) END AS BIGINT) AS effect FROM y""")
def formula_effect_values(t):
    import json

    codes = F.explode(F.array(*map(F.lit, json.loads(_CODES)))).alias("code")
    rows = t("spells_new").select("id", F.col("id").alias("p"), codes).join(t("items").select("id", ((F.col("reqlevel") / 2).cast("int")).alias("size")), "id")
    value = S.effect_value(F.col("code"), F.col("size") - 25, (F.col("p") % 5) * 40, F.col("p") % 4, F.col("size") + 20)
    return rows.select("id", "code", value.alias("effect"))


@query(None)
def label_matches(t):
    rows = t("zone").filter("version = 0").select("id", F.concat(F.lit("gate of "), F.substring("short_name", 1, 1)).alias("k"), (F.col("id") % 4).alias("r"))
    other = rows.select(F.col("id").alias("near"), F.col("k").alias("l"), "r")
    return rows.join(other, "r").filter("id < near").select("id", "near", S.label_confidence(F.col("k"), F.col("l")).alias("confidence"))


ORACLE_SQL["label_matches"] = f"WITH zone AS ({SQL['zone']}), z AS (SELECT id, concat('gate of ', substring(short_name, 1, 1)) AS k, id % 4 AS r FROM zone WHERE version = 0) " + "SELECT a.id, b.id AS near, CASE WHEN a.k = b.k THEN 2 WHEN levenshtein(a.k, b.k) <= 1 THEN 1 ELSE 0 END AS confidence FROM z a JOIN z b ON a.r = b.r AND a.id < b.id"
