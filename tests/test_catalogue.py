"""Every query against its SQL, run by another engine on the same files."""

import datetime
import glob
import os

import pytest

from skein.plans import catalogue, domain  # noqa: F401  domain adds its queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    order = [list(result.columns).index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_matching_is_one_to_one_and_largest(spark):
    from skein.operators.graph import match_pairs

    edges = spark.createDataFrame([(1, 1, 10, 0), (1, 1, 11, 1), (1, 2, 10, 0), (1, 3, 11, 0), (1, 3, 12, 1), (2, 5, 10, 0)], "zone int, left_id long, right_id long, rank int")
    got = [(r.zone, r.left_id, r.right_id) for r in match_pairs(edges, "zone").collect()]
    assert len(got) == 4 and len({(z, a) for z, a, _ in got}) == 4 and len({(z, b) for z, _, b in got}) == 4
    assert set(got) <= {(r.zone, r.left_id, r.right_id) for r in edges.collect()}


def test_chain_ends_at_a_cycle(spark):
    from skein.operators.graph import chain_ranks

    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, next_id long")
    got = sorted((r.start, r.id, r.ordinal) for r in chain_ranks(nodes, nodes.filter("id in (1, 4)")).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (4, 4, 1)]


def test_binary_maps_and_text_records(spark, tmp_path):
    from skein.sources import maps

    data = maps.encode([(12, 34, 56, 0, 1, 2, 3, 4, 5)], [(1, 2, 3, 9, 8, 7, 3, "Zön, a")])
    lines, points, error = maps.decode(data)
    assert lines == [(12, 34, 56, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0)] and points == [(1.0, 2.0, 3.0, 9, 8, 7, 3, "Zön, a")] and not error
    assert maps.decode(data[:-1])[2] and maps.decode(b"XXXX" + data[4:])[2] == "bad-magic" and maps.decode(b"")[2] == "truncated-header"
    (tmp_path / "a.txt").write_text("L 1,2,3,4,5,6,7,8,9\nL 1,2\nP 1,2,3,4,5,6,3,To B, there\n")
    records = maps.read_text(spark, str(tmp_path))
    assert [r.valid for r in maps.segments(records).orderBy("line").collect()] == [True, False]
    assert maps.points(records).first()["label"] == "To B, there"


def test_scalars(spark):
    from pyspark.sql import functions as F

    from skein.functions import scalar as S

    row = spark.range(1).select(
        S.expand_template(F.lit("#1 and #12"), [F.lit(i) for i in range(1, 13)]).alias("template"), S.finite(F.lit("x")).alias("bad"), S.finite(F.lit("1.5")).alias("good"),
        S.min_usable_level(F.array(F.lit(0), F.lit(255), F.lit(9))).alias("level"), S.label_confidence(F.lit("old gate"), F.lit("gate road")).alias("confidence"), S.label_confidence(F.lit("old gate"), F.lit("odd gate")).alias("close"), S.label_confidence(F.lit(""), F.lit("")).alias("blank"), S.mask_labels(F.lit(65536), {1: "A"}, 65535).alias("mask"), S.roam_box(*[F.lit(0.0)] * 4).alias("box"),
        S.strip_prefix(F.lit("TO Freeport"), "to").alias("label"), S.bracketed(F.lit("[1,2] go [x]")).alias("steps"),
    ).first()
    assert tuple(row) == ("1 and 12", None, 1.5, 9, 0, 1, 0, "", None, "Freeport", ["1,2", "x"])


def test_timelines_skip_what_cannot_be_walked(spark):
    from skein.operators.paths import timelines

    points = spark.createDataFrame([(1, 2, 30.0, 1.0), (1, 1, 0.0, 9.0), (2, 1, 0.0, 0.0), (3, 1, 0.0, 0.0), (3, 2, None, 0.0), (3, 3, 40.0, 500.0), (4, 1, 0.0, 0.0), (4, 2, 9.0, 0.0)], "path int, number int, x double, pause double")
    meta = spark.createDataFrame([(1, 3, 1), (2, 3, 1), (3, 4, 1), (4, 0, 1)], "path int, wander_type int, pause_type int")
    got = {r.path: r for r in timelines(points.selectExpr("*", "0.0D y", "0.0D z"), meta, "path").collect()}
    assert set(got) == {1, 3}
    # 30 units at the least speed, 20 a second, to and fro; a rest of 1 s at the far end and of 9 s at the near one
    assert [(e.kind, e.length_ms) for e in got[1].events] == [("move", 1500.0), ("pause", 1000.0), ("move", 1500.0), ("pause", 9000.0)]
    assert got[1].loop and got[1].duration_ms == 13000.0 and not got[1].approximate
    high = timelines(points.selectExpr("*", "0.0D y", "number * 80.0D z"), meta, "path").filter("path = 1").first()
    assert abs(high.events[0].length_ms - 1000 * (30**2 + 20**2) ** 0.5 / 20) < 1e-6
    assert got[3].approximate and got[3].duration_ms == 122000.0 and not got[3].loop


def test_label_keys_and_annotation_bounds(spark):
    from skein.sources import maps

    labels = ["To the Plane of Knowledge", "Zone Line", "Exit to Café`s Gate", None, "PoK Book"]
    got = maps.label_key(spark.createDataFrame(list(enumerate(labels)), "id int, label string"), "label", "key").orderBy("id").collect()
    assert [r["key"] for r in got] == ["knowledge", "", "cafes gate", "", "knowledge"]
    marks = spark.createDataFrame([("a", 1, 3, "To B", 1.0), ("a", 2, 3, "to b", 1.0), ("a", 3, 3, "To C", 900.0), ("a", 4, 2, "To D", 1.0), ("a", 5, 3, None, 1.0)], "file string, line int, size int, label string, x double").selectExpr("*", "0.0D y", "-0.0D z")
    boxes = spark.createDataFrame([("a", 0.0, 10.0, 0.0, 10.0)], "file string, min_x double, max_x double, min_y double, max_y double")
    assert [(r.kind, r.label, r.x, str(r.z)) for r in maps.annotations(marks, boxes).collect()] == [("zone-line", "To B", 1.0, "0.0")]
    crowd = spark.range(300).selectExpr("'a' file", "id line", "3 size", "concat('To ', id) label", "0.0D x", "0.0D y", "0.0D z")
    with pytest.raises(Exception, match="too many annotations"):
        maps.annotations(crowd).collect()


def test_effect_texts(spark):
    from skein.operators.effects import describe, focus_text, up_to_level
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(2, "standard", "Attack", "", True), (7, "standard", "Health", "", True)], "effect int, kind string, label string, unit string, per_tick boolean")
    slots = spark.createDataFrame([(1, 2, 102, 10, 0, 40, 0, 5), (2, 7, 107, -50, 0, 0, 6, 5), (3, 2, 123, 10, 0, 30, 0, 5), (4, 9, 100, 1, 0, 0, 0, 5)], "id int, effect int, formula int, base int, limit int, most int, ticks int, level int")
    got = {r.id: r.description for r in describe(slots, table, 70).collect()}
    assert got[1] == "Increase Attack by 15 (L5) to 40 (L30)"
    assert got[2] == "Decrease Health by 49 per tick  (Decaying to 44 @ 1/tick)"
    assert got[3].endswith("(Random: 10 to 30)") and got[4] is None
    a = spark.range(1).select(*(focus_text(F.lit("X"), F.lit(x), F.lit(y), n) for x, y, n in ((5, 9, False), (9, 5, False), (-9, -2, False), (-2, -9, True), (4, 0, True))), up_to_level(F.lit(0)), up_to_level(F.lit(9))).first()
    assert tuple(a) == ("Increase X by 5% to 9%", "Increase X by 9%", "Decrease X by 2% to 9%", "Increase X by 2% to 9%", "Decrease X by 4%", "", " up to level 9")


def test_screen_and_zoom(spark):
    from pyspark.sql import functions as F

    from skein.functions import scalar as S

    centre, scale = F.lit(7.0), S.fit_scale(F.lit(100.0), F.lit(0.0), 800.0, 600.0)
    screen = S.to_screen(F.lit(20.0), centre, scale, 800.0)
    got = spark.range(1).select(screen.alias("s"), S.to_world(screen, centre, scale, 800.0).alias("w"), S.fit_scale(F.lit(0.0), F.lit(0.0), 9.0, 9.0).alias("one"), *(S.clamp_zoom(F.lit(z)).alias(f"z{i}") for i, z in enumerate((0.1, 2.0, 99.0)))).first()
    assert tuple(got) == (504.0, 20.0, 1.0, 0.25, 2.0, 16.0)
    with pytest.raises(ValueError, match="padding"):
        S.fit_scale(F.lit(1.0), F.lit(1.0), 10.0, 10.0, 5.0)


def test_natural_order_of_all_suppliers(spark, tmp_path):
    """Suppliers in many ranges of the order."""
    spark.range(1, 2501, numPartitions=7).selectExpr("id as s_suppkey").orderBy("s_suppkey", ascending=False).write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.QUERIES["sort_natural_all"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.place) for r in got) == [(k, k) for k in range(1, 2501)]


def test_chain_of_any_length(spark):
    """1100 nodes in one list, and a list that runs into a cycle."""
    from skein.operators.graph import chain_ranks

    nodes = spark.range(1, 1101).selectExpr("id", "if(id < 1100, id + 1, 0) as next_id").union(spark.createDataFrame([(2000, 2001), (2001, 2002), (2002, 2003), (2003, 2001), (2004, 9999)], "id long, next_id long"))
    got = sorted((r.start, r.id, r.ordinal) for r in chain_ranks(nodes, nodes.filter("id in (1, 2000, 2004)")).collect())
    assert got == [(1, k, k) for k in range(1, 1101)] + [(2000, 2000 + k, k + 1) for k in range(4)] + [(2004, 2004, 1)]


def test_natural_keys_of_long_numbers(spark):
    from skein.functions import scalar as S

    labels = ["z 5", "z 05b", "z 9999999999999", "z 10000000000000", "a", "z 12"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    assert [r.label for r in rows.orderBy(S.natural_key(rows["label"])).collect()] == ["a", "z 5", "z 05b", "z 12", "z 9999999999999", "z 10000000000000"]


@pytest.fixture(scope="module")
def loot(spark):
    """Catalogue tables with repeated rows, tables of several probabilities and NPCs of several tables."""
    rows = {
        "npc_types": ([(i, f"#a_{'xyz'[i % 3]}{i}", 1 + i % 4, i % 9, None if i == 7 else 10 + i % 3) for i in range(60)] + [(5, "#a_q5", 2, 3, 20)], "id long, name string, loottable_id long, npc_spells_id long, level int"),
        "loottable_entries": ([(i, d, p) for i in range(1, 5) for d, p in ((i, 50.0), (9, 25.0 * i), (8, None))] + [(1, 1, 80.0)], "loottable_id long, lootdrop_id long, probability double"),
        "lootdrop_entries": ([(d, item, float(item * d % 5 * 10)) for d in (1, 2, 3, 4, 8, 9) for item in range(12) if (item + d) % 3], "lootdrop_id long, item_id long, chance double"),
        "spawnentry": ([(i, i) for i in range(60) if i % 5] + [(2, i) for i in range(60)] + [(61, 3)] * 2, "spawngroupID long, npcID long"),
        "spawn2": ([(i, "one" if i % 2 else "two", i % 3 % 2) for i in range(62)], "spawngroupID long, zone string, version int"),
        "zone": ([(1, 1, "one", "The One", 0), (2, 1, "one", "The One", 1), (3, 2, "two", "The Two", 0)], "id long, zoneidnumber long, short_name string, long_name string, version int"),
        "npc_spells": ([(i, 4 if i == 2 else 0) for i in range(6)], "id long, parent_list long"),
        "npc_spells_entries": ([(i % 6, s, 9 + s % 4, 11 + s % 3) for i in range(12) for s in range(20)], "npc_spells_id long, spellid long, minlevel int, maxlevel int"),
    }
    tables = {k: spark.createDataFrame(*v) for k, v in rows.items()}
    tables["zone"] = tables["zone"].selectExpr("*", "0 expansion", "0 min_status", "cast(null as string) content_flags", "cast(null as string) content_flags_disabled")
    return tables.__getitem__


@pytest.mark.parametrize("few", [200_000, 0])
def test_drops_without_all_pairs_of_items_and_npcs(spark, loot, few, monkeypatch):
    """Both forms, with a small side that is broadcast and one that is not, equal what the whole relation gives."""
    from pyspark.sql import functions as F

    from skein.operators import relational
    from skein.services import details as D

    monkeypatch.setattr(relational, "FEW", few)
    chances = loot("loottable_entries").join(loot("lootdrop_entries"), "lootdrop_id").withColumn("chance", F.expr("chance * probability / 100"))
    npcs = loot("npc_types").select(F.col("id").alias("npcID"), "loottable_id", F.expr("replace(regexp_replace(name, '[#0-9]', ''), '_', ' ')").alias("npc"))
    whole = [r.asDict() for r in chances.join(npcs, "loottable_id").join(D.npc_zones(loot, D.Settings()), "npcID").collect()]
    best, zones = {}, {}
    for r in whole:
        for into, key in ((best, (r["item_id"], r["npcID"])), (zones, (r["item_id"], r["short_name"], r["version"], r["npc"]))):
            into[key] = max((x for x in (into.get(key), r["chance"]) if x is not None), default=None)
    for most in (3, 200):
        want = []
        for item in {i for i, _ in best}:
            order = sorted(((c is None, -(c or 0.0), n) for (i, n), c in best.items() if i == item))[:most]
            want += [(item, n, None if void else -c, k + 1) for k, (void, c, n) in enumerate(order)]
        got = [(r.item_id, r.npc_id, r.chance, r.position) for r in D.top_droppers(loot, most=most).collect()]
        assert sorted(got) == sorted(want) and len(want) > most
    got = {(r.item_id, r.short_name, r.version, x.npc): x.chance for r in D.drops_by_zone(loot).collect() for x in r.npcs}
    assert got == zones
    lists = D.drops_by_zone(loot).collect()
    assert len({(r.item_id, r.short_name, r.version) for r in lists}) == len(lists) and all([x.npc for x in r.npcs] == sorted({x.npc for x in r.npcs}) for r in lists)


@pytest.mark.parametrize("few", [200_000, 0])
def test_spells_of_npcs_are_made_distinct_before_they_meet(spark, loot, few, monkeypatch):
    """Repeated entries and an NPC of two rows; what is shuffled follows the lists and levels."""
    from skein.operators import relational
    from skein.services import details as D

    monkeypatch.setattr(relational, "FEW", few)
    lists = {r.id: r.parent_list or r.id for r in loot("npc_spells").collect()}
    entries = loot("npc_spells_entries").collect()
    want = {(n.id, e.spellid) for n in loot("npc_types").collect() if n.npc_spells_id in lists and n.level for e in entries if e.npc_spells_id == lists[n.npc_spells_id] and e.minlevel <= n.level <= e.maxlevel}
    found = D.npc_spells(loot)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top  # nothing is made distinct after the last join
