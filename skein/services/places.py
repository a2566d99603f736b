"""Where things are: spawns of an NPC, ground spawns of an item, the atlas of a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import Settings
from skein.functions import scalar as S
from skein.operators import filters as P
from skein.operators import relational as R

#: Door that is linked to a zone point by number, distance at which a door stands at an exit.
LINKED_DOOR, AT_EXIT = 57, 8.0
LAYERS = ("npcs", "named", "merchants", "spawns", "ground-spawns", "zone-points", "doors", "objects", "safe-points")


def open_now(alias: str, settings: Settings) -> Column:
    """Expansion window and content flags of a row."""
    c = lambda name: F.col(f"{alias}.{name}")
    return P.within(c("min_expansion"), c("max_expansion"), settings.expansion) & P.flags_allow(c("content_flags"), c("content_flags_disabled"), settings.flags())


def open_zones(zones: DataFrame, settings: Settings) -> DataFrame:
    """Zones that anyone may enter: expansion, status, not ignored, flags."""
    rule = (F.col("expansion") <= settings.expansion) & (F.col("min_status") == 0) & P.not_ignored("short_name", settings.zones_left_out())
    return zones.filter(rule & P.flags_allow(F.col("content_flags"), F.col("content_flags_disabled"), settings.flags()))


def finite(*names: str) -> Column:
    """All of these columns are finite numbers; a row with a bad axis goes."""
    rule = F.lit(True)
    for n in names:
        rule = rule & S.finite(F.col(n).cast("string")).isNotNull()
    return rule


def spawn_locations(npc: Column, t, settings: Settings = Settings()) -> DataFrame:
    """Spawns of the NPCs that a condition on npcID takes, in zones that are open: one row a spawn.

    t: a function from table name to rows. No locations are shown where the settings hide them.
    """
    z = open_zones(t("zone"), settings).select(F.col("id").alias("zone_row_id"), F.col("zoneidnumber").alias("zone_id"), "short_name", "long_name", "version")
    se = t("spawnentry").alias("se").filter(npc & (F.col("se.chance") > 0) & open_now("se", settings)).select("spawngroupID", "npcID", "chance")
    s2 = t("spawn2").alias("s2").filter(open_now("s2", settings))
    s2 = s2.select("spawngroupID", F.col("id").alias("spawn_id"), F.col("zone").alias("short_name"), "version", "x", "y", "z", "heading", "pathgrid", *(["respawntime", "variance"] if settings.show_respawn else []))
    sg = t("spawngroup").select(F.col("id").alias("spawngroupID"), F.col("name").alias("group_name"), S.roam_box(*(F.col(c) for c in ("min_x", "max_x", "min_y", "max_y"))).alias("roam"))
    found = se.join(s2, "spawngroupID").join(sg, "spawngroupID").join(z, ["short_name", "version"]).filter(finite("x", "y", "z")).distinct()
    return found if settings.show_locations else found.limit(0)


def placeholders(locations: DataFrame, t, settings: Settings = Settings()) -> DataFrame:
    """Other NPCs of the groups of an NPC's spawns, the likeliest first, a fair number of each group.

    Rows that repeat an NPC of a group are one, with its largest chance; that is done before ranking.
    """
    groups = locations.select("spawngroupID", F.col("npcID").alias("own")).distinct()
    each = R.fair_limit(groups.count(), settings.placeholders_each, settings.placeholders)
    se = t("spawnentry").alias("se").filter((F.col("se.chance") > 0) & open_now("se", settings)).select("spawngroupID", "npcID", "chance")
    others = groups.join(se, "spawngroupID").filter("npcID <> own").groupBy("spawngroupID", F.col("npcID").alias("id")).agg(F.max("chance").alias("chance"))
    named = others.join(t("npc_types").select("id", S.clean_name(F.col("name")).alias("name"), "level"), "id")
    return R.top_k(named, ["spawngroupID"], [F.col("chance").desc(), F.col("id")], each)


def paths_of(locations: DataFrame, t) -> DataFrame:
    """Waypoints of the walks of an NPC's spawns, by zone and grid, in order; the types where both are known.

    Tables that a catalogue does not have give no paths, or paths without types.
    """
    pairs = locations.filter("pathgrid > 0").select(F.col("pathgrid").alias("gridid"), F.col("zone_id").alias("zoneid")).distinct()
    try:
        points = t("grid_entries")
    except KeyError:
        return pairs.select("zoneid", "gridid", F.lit(None).cast("array<struct<number:int,x:double,y:double,z:double,pause:int>>").alias("points"), F.lit(None).cast("int").alias("type"), F.lit(None).cast("int").alias("type2")).limit(0)
    points = points.join(pairs, ["gridid", "zoneid"], "left_semi").filter(finite("x", "y", "z"))
    walks = points.groupBy("zoneid", "gridid").agg(F.array_sort(F.collect_list(F.struct("number", "x", "y", "z", "pause"))).alias("points"))
    try:
        kinds = t("grid").select(F.col("id").alias("gridid"), "zoneid", "type", "type2")
    except KeyError:
        return walks.withColumns({"type": F.lit(None).cast("int"), "type2": F.lit(None).cast("int")})
    both = F.col("type").between(0, 9) & F.col("type2").between(0, 2)
    return walks.join(kinds, ["zoneid", "gridid"], "left").withColumns({c: F.when(both, F.col(c)) for c in ("type", "type2")})


def location_groups(locations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Nested: one row an NPC, zone and version, with its spawns in order."""
    fields = ["spawn_id", "spawngroupID", "group_name", "chance", "x", "y", "z", "heading", "pathgrid", "roam", *(["respawntime", "variance"] if settings.show_respawn else [])]
    groups = locations.groupBy("npcID", "short_name", "long_name", "version", "zone_id", "zone_row_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("locations"))
    return groups.withColumn("key", F.concat_ws(":", "short_name", F.col("version").cast("string")))


def version_for(spawns: DataFrame, zones: DataFrame, number: str = "zoneid") -> DataFrame:
    """spawns with their zone row: the one of the same version; of version -1 that of version 0, else the first."""
    z = zones.select(F.col("zoneidnumber").alias(number), F.col("version").alias("zone_version"), F.col("id").alias("zone_row_id"), "short_name", "long_name", "map_file_name")
    exact = spawns.filter("version >= 0").join(z, number).filter("version = zone_version")
    order = [(F.col("zone_version") != 0), F.col("zone_version"), F.col("zone_row_id")]
    first = R.top_k(z, [number], order, 1).drop("position")
    return exact.unionByName(spawns.filter("version < 0").join(first, number))


def ground_spawns(t, settings: Settings = Settings(), item: Column | None = None) -> DataFrame:
    """Ground spawns of items in open zones, hidden ones left out before anything is cut: area, middle, label, zone.

    Flags of ground spawns are compared with their spaces. With only_discovered, items that nobody found show none.
    """
    zones = open_zones(t("zone"), settings)
    rows = t("ground_spawns").filter(item if item is not None else F.lit(True)).filter(P.within(F.col("min_expansion"), F.col("max_expansion"), settings.expansion))
    on = lambda c: F.coalesce(reduce_any([P.flag_in_set(F.col(c), f) for f in settings.flags()]), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rows = rows.filter((blank("content_flags") | on("content_flags")) & ~on("content_flags_disabled"))
    if settings.only_discovered:
        rows = rows.join(t("discovered_items").select(F.col("item_id").alias("item")), "item", "left_semi")
    rows = rows.join(t("items").select(F.col("id").alias("item"), F.col("Name").alias("item_name")), "item")
    rows = rows.join(zones.select(F.col("zoneidnumber").alias("zoneid")).distinct(), "zoneid", "left_semi").filter(finite("min_x", "max_x", "min_y", "max_y", "max_z"))
    rows = version_for(rows, zones)
    low, high = (lambda c: F.least(f"min_{c}", f"max_{c}")), (lambda c: F.greatest(f"min_{c}", f"max_{c}"))
    area = {f"{side}_{c}": f(c) for c in "xy" for side, f in (("low", low), ("high", high))}
    rows = rows.withColumns(area).withColumns({"x": S.midpoint(F.col("min_x"), F.col("max_x")), "y": S.midpoint(F.col("min_y"), F.col("max_y")), "z": F.col("max_z")})
    label = S.default_label(F.col("item_name"), "Ground spawn")
    return rows.withColumns({"label": label, "area_label": S.area_label(*(F.col(c) for c in ("low_x", "high_x", "low_y", "high_y"))), "key": F.concat_ws(":", "short_name", F.col("zone_version").cast("string"))})


def reduce_any(rules: list[Column]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | r
    return out


def bounded(rows: DataFrame, boxes: DataFrame, on: list[str]) -> DataFrame:
    """rows with visible: the place is no origin, within a million, and within the padded box of its map where one is known.

    Boxes are in map coordinates, whose first two axes are the negatives of those of the database.
    """
    rows = rows.join(boxes.select(*on, *(F.col(f"{s}_{c}").alias(f"box_{s}_{c}") for s in ("min", "max") for c in "xy")), on, "left")
    inside = reduce_all([F.coalesce(S.padded_bounds_contain(S.negate_axis(F.col(m)), F.col(f"box_min_{c}"), F.col(f"box_max_{c}")), F.lit(True)) for c, m in (("x", "y"), ("y", "x"))])
    visible = S.non_zero_origin(F.col("x"), F.col("y")) & F.col("x").between(-1e6, 1e6) & F.col("y").between(-1e6, 1e6) & inside
    return rows.withColumn("visible", visible).drop(*(f"box_{s}_{c}" for s in ("min", "max") for c in "xy"))


def reduce_all(rules: list[Column]) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & r
    return out


def for_version() -> Column:
    return (F.col("version") == -1) | (F.col("version") == F.col("zone_version"))


def atlas_spawns(t, zones: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Spawn points of zones with their NPCs: the first few names, the label, and the layers they belong to."""
    s2 = t("spawn2").alias("s2").filter(open_now("s2", settings)).select("spawngroupID", F.col("id").alias("spawn_id"), F.col("zone").alias("short_name"), "version", "x", "y", "z").filter(finite("x", "y", "z"))
    here = s2.join(zones.select("short_name", F.col("version")), ["short_name", "version"], "left_semi")
    se = t("spawnentry").alias("se").filter((F.col("se.chance") > 0) & open_now("se", settings)).groupBy("spawngroupID", "npcID").agg(F.max("chance").alias("chance"))
    npc = t("npc_types").select(F.col("id").alias("npcID"), S.clean_name(F.col("name")).alias("npc"), "level", "maxlevel", (F.col("rare_spawn") | F.col("raid_target")).alias("named"), (F.col("merchant_id") > 0).alias("merchant"))
    few = R.top_k(se, ["spawngroupID"], [F.col("chance").desc(), F.col("npcID")], settings.spawn_names).join(npc, "npcID").filter("npc <> ''")
    shown = few.groupBy("spawngroupID").agg(
        F.bool_or("named").alias("named"), F.bool_or("merchant").alias("merchant"), F.min("level").alias("low"), F.max(F.greatest("level", "maxlevel")).alias("high"),
        F.array_sort(F.collect_list(F.struct("position", "npc", "named"))).alias("npcs"),
    )
    head = F.coalesce(F.get(F.filter("npcs", lambda n: n["named"]), F.lit(0)), F.get("npcs", F.lit(0)))["npc"]
    layers = F.array_compact(F.array(F.when(F.col("named"), "named"), F.when(F.col("merchant"), "merchants")))
    shown = shown.withColumns({"layers": F.when(F.size(layers) > 0, layers).otherwise(F.array(F.lit("npcs"))), "label": S.count_label(head, F.size("npcs") - 1), "levels": S.level_label(F.col("low"), F.col("high"))})
    return here.join(shown, "spawngroupID").drop("npcs")


def exits(t, zones: DataFrame, boxes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All zone points with their destination's name, the row of version 0 first, and whether the map shows them."""
    z = t("zone").select(F.col("zoneidnumber").alias("target_zone_id"), F.col("long_name").alias("target"), "version", "id")
    first = R.top_k(z, ["target_zone_id"], [(F.col("version") != 0), F.col("version"), F.col("id")], 1).select("target_zone_id", "target")
    rows = t("zone_points").alias("p").filter(open_now("p", settings) & finite("x", "y", "z")).join(zones.select(F.col("short_name").alias("zone"), F.col("version").alias("zone_version")), "zone").filter(for_version())
    rows = rows.join(first, "target_zone_id", "left").withColumn("label", S.default_label(S.strip_prefix(F.col("target"), "to"), "Unknown destination"))
    return bounded(rows, boxes, ["zone"])


def doors(t, zones: DataFrame, boxes: DataFrame, points: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Doors that do something, and the zone point that a linked one stands for; such a door is in both layers if that point is hidden or not here."""
    goes = F.nullif(F.upper(F.trim("dest_zone")), F.lit("NONE"))
    rule = (F.col("lockpick") != 0) | (F.col("keyitem") > 0) | F.coalesce(F.length(goes) > 0, F.lit(False)) | (F.col("opentype") == LINKED_DOOR)
    rows = t("doors").alias("d").filter(rule & open_now("d", settings)).withColumns({"x": F.col("pos_x"), "y": F.col("pos_y"), "z": F.col("pos_z")}).filter(finite("x", "y", "z"))
    rows = rows.join(zones.select(F.col("short_name").alias("zone"), F.col("version").alias("zone_version")), "zone").filter(for_version())
    number = F.when(F.col("opentype") == LINKED_DOOR, F.col("door_param"))
    linked = points.select("zone", "zone_version", F.col("number").alias("link"), F.col("id").alias("point_id"), F.col("target_zone_id").alias("to_zone"), F.col("visible").alias("point_visible"), F.col("x").alias("px"), F.col("y").alias("py"))
    linked = R.top_k(linked, ["zone", "zone_version", "link"], [F.col("point_id")], 1).drop("position")
    rows = rows.withColumn("link", number).join(linked, ["zone", "zone_version", "link"], "left")
    near = F.coalesce(F.col("point_visible") & (F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= AT_EXIT), F.lit(False))
    leads = F.col("point_id").isNotNull() | F.coalesce(F.length(goes) > 0, F.lit(False))
    rows = rows.withColumn("layers", F.when(leads & ~near, F.array(F.lit("doors"), F.lit("zone-points"))).otherwise(F.array(F.lit("doors"))))
    return bounded(rows.drop("px", "py"), boxes, ["zone"]).filter("visible")


def objects(t, zones: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Objects of zones; those that hold an item that nobody found stay hidden with only_discovered, those without an item never."""
    rows = t("object").alias("o").filter(open_now("o", settings)).withColumns({"x": F.col("xpos"), "y": F.col("ypos"), "z": F.col("zpos")}).filter(finite("x", "y", "z"))
    rows = rows.join(zones.select(F.col("zoneidnumber").alias("zoneid"), F.col("version").alias("zone_version")), "zoneid").filter(for_version())
    items = t("items").select(F.col("id").alias("itemid"), F.col("Name").alias("item_name"))
    rows = rows.join(items, "itemid", "left")
    if settings.only_discovered:
        found = t("discovered_items").select(F.col("item_id").alias("itemid")).distinct().withColumn("found", F.lit(True))
        rows = rows.join(found, "itemid", "left").filter("itemid = 0 or found").drop("found")
    return rows.withColumn("label", S.default_label(F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.col("item_name")), "Object"))


def safe_points(zones: DataFrame) -> DataFrame:
    return zones.filter(S.non_zero_origin(F.col("safe_x"), F.col("safe_y"))).select("short_name", F.col("version").alias("zone_version"), F.lit("Safe point").alias("label"), F.col("safe_x").alias("x"), F.col("safe_y").alias("y"), F.col("safe_z").alias("z"))


def layer_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many rows each layer has, also those without any; a row counts once in each of its layers."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(i, name) for i, name in enumerate(LAYERS)], "place int, layer string")
    counts = rows.select(*by, F.explode(F.array_distinct("layers")).alias("layer")).groupBy(*by, "layer").agg(F.count("*").alias("n"))
    every = rows.select(*by).distinct().withColumn("layer", F.explode(F.array(*map(F.lit, LAYERS))))
    return every.join(counts, [*by, "layer"], "left").join(F.broadcast(known), "layer").select(*by, "layer", "place", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def truncated_at(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """At most so many rows a group, and whether there were more: one row beyond is looked at."""
    first = R.top_k(rows, by, order, most + 1)
    return first.withColumn("more", F.max("position").over(Window.partitionBy(*by)) > most).filter(F.col("position") <= most)
