"""Tables of a catalogue made from the star schema, by SQL that several engines run alike, for queries and their oracles.

Parts are items and spells, suppliers NPCs and their spawns, nations zones, customers what lies about in these, orders
recipes, tasks and finds, line items the links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_GATES = "CASE WHEN {k} % 13 = 5 THEN 12 ELSE -1 END AS min_expansion, CASE WHEN {k} % 17 = 3 THEN 4 ELSE -1 END AS max_expansion, CASE WHEN {k} % 7 = 2 THEN 'fair, feast' WHEN {k} % 19 = 4 THEN 'frost' END AS content_flags, CASE WHEN {k} % 23 = 6 THEN 'x,feast' END AS content_flags_disabled"
_LEVELS = ", ".join(f"CAST(CASE WHEN (p_partkey * {i}) % 5 = 0 THEN 255 ELSE (p_partkey * {i}) % 80 END AS INT) AS classes{i}" for i in range(1, 17))

SQL: dict[str, str] = {
    "zone": "SELECT n_nationkey * 10 + v AS id, (n_nationkey + 1) * 1000 AS zoneidnumber, lower(n_name) AS short_name, concat('The ', n_name, ' Zone ', CAST(n_nationkey AS VARCHAR(9))) AS long_name, v AS version, n_nationkey % 12 AS expansion, CASE WHEN n_nationkey % 11 = 10 THEN 1 ELSE 0 END AS min_status, CASE WHEN n_nationkey % 8 = 3 THEN 'feast' END AS content_flags, CASE WHEN n_nationkey % 9 = 4 THEN 'fair' END AS content_flags_disabled, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE '' END AS map_file_name, CAST(n_nationkey % 3 AS DOUBLE) AS safe_x, CAST(0 AS DOUBLE) AS safe_y, CAST(1 AS DOUBLE) AS safe_z FROM nation, (SELECT 0 AS v UNION ALL SELECT 1 AS v) versions WHERE v = 0 OR n_nationkey % 3 = 0",
    "npc_types": "SELECT (s_nationkey + 1) * 1000000 + s_suppkey AS id, concat(replace(s_name, '#', '_'), CASE WHEN s_suppkey % 4 = 0 THEN '_the-Old' ELSE '' END) AS name, CAST(s_suppkey % 70 + 1 AS INT) AS level, CAST(s_suppkey % 75 AS INT) AS maxlevel, CAST(120 + s_suppkey % 9 AS INT) AS race, s_suppkey % 5 = 0 AS rare_spawn, s_suppkey % 6 = 0 AS raid_target, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE 0 END AS merchant_id, s_suppkey AS loottable_id, s_suppkey % 7 AS npc_spells_id, s_suppkey % 11 AS npc_faction_id, s_suppkey FROM supplier",
    "spawngroup": "SELECT s_suppkey AS id, concat('group_', CAST(s_suppkey AS VARCHAR(20))) AS name, CAST(s_suppkey % 3 AS DOUBLE) AS min_x, CAST(s_suppkey % 5 AS DOUBLE) AS max_x, CAST(0 AS DOUBLE) AS min_y, CAST(s_suppkey % 2 AS DOUBLE) AS max_y FROM supplier",
    "spawnentry": f"SELECT spawngroupID, npcID, chance, {_GATES.format(k='(spawngroupID + chance)')} FROM (SELECT s_suppkey AS spawngroupID, (s_nationkey + 1) * 1000000 + s_suppkey AS npcID, s_suppkey % 60 AS chance FROM supplier UNION ALL SELECT CAST(floor(s_suppkey / 4) AS BIGINT) * 4 + 1, (s_nationkey + 1) * 1000000 + s_suppkey, s_suppkey % 47 + 1 FROM supplier UNION ALL SELECT CAST(floor(s_suppkey / 4) AS BIGINT) * 4 + 1, (s_nationkey + 1) * 1000000 + s_suppkey, s_suppkey % 31 + 1 FROM supplier WHERE s_suppkey % 3 = 1) e",
    "spawn2": f"SELECT s_suppkey AS id, s_suppkey AS spawngroupID, lower(n_name) AS zone, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS version, CASE WHEN s_suppkey % 29 = 7 THEN NULL ELSE s_acctbal END AS x, CAST(s_suppkey % 400 AS DOUBLE) AS y, CAST(s_suppkey % 9 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS heading, CAST(600 AS INT) AS respawntime, CAST(s_suppkey % 60 AS INT) AS variance, s_suppkey % 6 AS pathgrid, {_GATES.format(k='(s_suppkey + 1)')} FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "items": "SELECT p_partkey AS id, p_name AS Name, CAST(p_size + p_partkey % 20 AS INT) AS itemtype, CAST(p_size % 20 AS INT) AS damage, CAST(p_partkey % 40 + 1 AS INT) AS delay, p_partkey % 4096 AS slots, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey % 65536 END AS classes, CAST(p_size % 12 AS INT) AS bagslots, CAST(p_partkey % 16 AS INT) AS bagtype, p_partkey % 64 AS augtype, CAST(p_size * 2 AS INT) AS reqlevel, CAST(p_size % 13 AS INT) AS ac, CAST(p_partkey % 11 AS INT) AS hp, p_partkey % 50 AS proceffect, CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 31 ELSE -1 END AS worneffect, 0 AS focuseffect, 65535 AS clickeffect, p_partkey % 90 AS scrolleffect, p_partkey % 3 AS evoid, CAST(p_size % 4 AS INT) AS evolvinglevel, CAST(p_retailprice * 100 AS BIGINT) AS price FROM part",
    "spells_new": f"SELECT p_partkey AS id, concat(p_type, ' ', CAST(p_partkey % 10 AS VARCHAR(9))) AS name, p_partkey % 15 AS spellgroup, {_LEVELS} FROM part",
    "discovered_items": "SELECT DISTINCT o_orderkey % 500 AS item_id, concat('Customer ', CAST(o_custkey % 97 AS VARCHAR(20))) AS char_name, 820000000 + (o_orderkey % 500) * 90000 + o_custkey % 97 AS discovered_date FROM orders",
    "character_data": "SELECT c_custkey AS id, concat('CUSTOMER ', CAST(c_custkey AS VARCHAR(20))) AS name, CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END AS gm FROM customer WHERE c_custkey < 97",
    "ground_spawns": f"SELECT c_custkey AS id, (c_nationkey + 1) * 1000 AS zoneid, CAST(c_custkey % 3 AS INT) - 1 AS version, CASE WHEN c_custkey % 37 = 1 THEN NULL ELSE c_acctbal END AS min_x, CAST(100 AS DOUBLE) AS max_x, CAST(c_custkey % 90 AS DOUBLE) AS min_y, CAST(c_custkey % 45 AS DOUBLE) AS max_y, CAST(c_custkey % 7 AS DOUBLE) AS max_z, c_custkey % 150 + 1 AS item, {_GATES.format(k='c_custkey')} FROM customer",
    "zone_points": f"SELECT c_custkey AS id, lower(n_name) AS zone, CAST(-1 AS INT) AS version, c_custkey % 40 AS number, CASE WHEN c_custkey % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS x, CASE WHEN c_custkey % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(c_custkey % 30 AS DOUBLE) END AS y, CAST(0 AS DOUBLE) AS z, (c_custkey % 30 + 1) * 1000 AS target_zone_id, {_GATES.format(k='(c_custkey + 4)')} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 1",
    "doors": f"SELECT c_custkey AS id, lower(n_name) AS zone, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE -1 END AS INT) AS version, c_acctbal + 1 AS pos_x, CAST(c_custkey % 30 AS DOUBLE) AS pos_y, CAST(0 AS DOUBLE) AS pos_z, CASE WHEN c_custkey % 2 = 1 THEN 57 ELSE 1 END AS opentype, CASE WHEN c_custkey % 9 = 0 THEN 5 ELSE 0 END AS lockpick, 0 AS keyitem, c_custkey % 40 AS door_param, CASE WHEN c_custkey % 5 = 0 THEN ' none ' WHEN c_custkey % 5 = 1 THEN 'far' END AS dest_zone, {_GATES.format(k='(c_custkey + 9)')} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 1",
    "object": f"SELECT c_custkey AS id, (c_nationkey + 1) * 1000 AS zoneid, CAST(-1 AS INT) AS version, c_acctbal AS xpos, CAST(1 AS DOUBLE) AS ypos, CAST(2 AS DOUBLE) AS zpos, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 300 END AS itemid, CASE WHEN c_custkey % 4 = 0 THEN ' Chest ' WHEN c_custkey % 4 = 1 THEN ' ' END AS display_name, {_GATES.format(k='(c_custkey + 2)')} FROM customer WHERE c_custkey % 5 = 2",
    "grid_entries": "SELECT p_partkey % 6 AS gridid, (p_partkey % 25 + 1) * 1000 AS zoneid, CAST(p_partkey AS INT) AS number, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 8 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z, CAST(p_size % 4 AS INT) AS pause FROM part",
    "grid": "SELECT k AS id, (n_nationkey + 1) * 1000 AS zoneid, CAST(n_nationkey % 12 AS INT) AS type, CAST(k % 4 AS INT) AS type2 FROM nation, (SELECT DISTINCT p_partkey % 6 AS k FROM part) ks",
    "loottable_entries": "SELECT s_suppkey AS loottable_id, s_suppkey % 40 AS lootdrop_id, CAST(s_suppkey % 4 * 25 + 25 AS DOUBLE) AS probability FROM supplier",
    "lootdrop_entries": "SELECT l_suppkey % 40 AS lootdrop_id, l_partkey AS item_id, max(l_quantity) AS chance FROM lineitem GROUP BY l_suppkey % 40, l_partkey",
    "merchantlist": "SELECT DISTINCT l_suppkey AS merchantid, l_partkey AS item, CAST(l_linenumber % 3 AS INT) AS alt_currency_cost FROM lineitem WHERE l_discount > 0.08",
    "forage": "SELECT (s_nationkey + 1) * 1000 AS zoneid, l_partkey AS itemid, CAST(min(l_linenumber) AS INT) AS chance FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity < 3 GROUP BY s_nationkey, l_partkey",
    "fishing": "SELECT (s_nationkey + 1) * 1000 AS zoneid, l_partkey AS itemid, CAST(min(l_linenumber) AS INT) AS chance FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 48 GROUP BY s_nationkey, l_partkey",
    "tradeskill_recipe": f"SELECT o_orderkey AS id, concat('Recipe ', CAST(o_orderkey AS VARCHAR(20)), ' ', o_orderpriority) AS name, CAST(o_custkey % 70 AS INT) AS tradeskill, CAST(o_orderkey % 300 AS INT) AS trivial, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END AS enabled, {_GATES.format(k='o_orderkey')} FROM orders",
    "tradeskill_recipe_entries": "SELECT l_orderkey AS recipe_id, l_partkey AS item_id, l_linenumber % 4 AS role, sum(CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END) AS iscontainer, sum(CASE WHEN l_linenumber % 4 = 1 THEN 1 ELSE 0 END) AS successcount, sum(CASE WHEN l_linenumber % 4 = 2 THEN 1 ELSE 0 END) AS failcount, sum(CASE WHEN l_linenumber % 4 = 3 THEN 1 ELSE 0 END) AS componentcount FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber % 4",
    "tasks": "SELECT o_orderkey AS id, concat('Task ', CAST(o_orderkey AS VARCHAR(20))) AS title, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END AS enabled, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 50 END AS INT) AS min_level, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 50 + 10 END AS INT) AS max_level, concat(CAST(o_custkey % 90 AS VARCHAR(20)), '|0|', CAST(999999999 AS VARCHAR(20)), '|', CAST(o_orderkey % 150 + 1 AS VARCHAR(20))) AS reward_id_list FROM orders",
    "task_activities": "SELECT DISTINCT l_orderkey AS taskid, l_linenumber AS activityid, CAST(l_linenumber % 3 AS INT) AS step, (l_suppkey % 25 + 1) * 1000 AS zones FROM lineitem",
    "npc_spells": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey + 1 ELSE 0 END AS parent_list FROM nation",
    "npc_spells_entries": "SELECT p_partkey % 25 AS npc_spells_id, p_partkey AS spellid, CAST(p_size AS INT) AS minlevel, CAST(p_size + 20 AS INT) AS maxlevel FROM part",
    "faction_list": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "npc_faction_entries": "SELECT s_suppkey % 11 AS npc_faction_id, s_nationkey AS faction_id, max(CAST(s_suppkey % 5 AS INT) - 2) AS value FROM supplier GROUP BY s_suppkey % 11, s_nationkey",
    "pets": "SELECT p_partkey AS id, concat('pet_', CAST(p_partkey % 40 AS VARCHAR(9))) AS type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 100 END AS npc_key FROM part WHERE p_size > 30",
    "aa_ranks": "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 < 5 THEN p_partkey + 1 ELSE 0 END AS next_id, CAST(p_size AS INT) AS cost FROM part",
    "aa_ability": "SELECT p_partkey AS id, p_name AS name, p_partkey AS first_rank_id, p_partkey % 65536 AS classes, CAST(p_size % 2 AS INT) AS enabled FROM part WHERE p_partkey % 6 = 1",
    "aa_rank_effects": "SELECT p_partkey AS rank_id, p_partkey % 9 AS effect_id, p_partkey % 400 AS base1 FROM part",
    "effect_kinds": "SELECT k AS effect_id, CASE WHEN k % 3 = 0 THEN 'SpellID to cast' WHEN k % 3 = 1 THEN 'itemid given' ELSE 'amount' END AS base FROM (SELECT DISTINCT p_partkey % 8 AS k FROM part) ks",
}


class Tables:
    """Catalogue tables by name: views over the star schema of a folder, made when asked for."""

    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame], without: tuple[str, ...] = ()):
        self.spark, self.read, self.without = spark, read, without

    def __call__(self, name: str) -> DataFrame:
        if name in self.without or name not in SQL:
            raise KeyError(name)
        text = SQL[name]
        used = {s: self.read(s) for s in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem") if f" {s}" in text}
        for s in used:
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {s} ", f"{word} {{{s}}} AS {s} ").replace(f"{word} {s},", f"{word} {{{s}}} AS {s},")
                text = text if not text.endswith(f"{word} {s}") else text[: -len(s)] + f"{{{s}}} AS {s}"
                text = text.replace(f"{word} {s})", f"{word} {{{s}}} AS {s})")
        return self.spark.sql(text, **used)


def oracle(body: str, *names: str) -> str:
    """SQL with the catalogue tables that it names before it."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body
