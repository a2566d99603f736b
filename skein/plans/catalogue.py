"""Registry of the library's queries over the shared star-schema tables, each with SQL for the same rows.

Catalogue roles are played by the star schema: parts are items, suppliers vendors, customers and orders owners
and their finds, lineitem the link table, nation and region places, events the feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scalar as S
from skein.operators import filters as P
from skein.operators import effects, graph, paths, relational as R
from skein.sources import maps
from skein.streaming.events import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "join_chain_top_per_group"

#: Colours of a bit mask, as the class and race dictionaries are laid out: bit to label.
BITS = {1: "WAR", 2: "CLR", 4: "PAL", 8: "RNG", 16: "SHD", 32: "DRU"}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- filters

PART_FILTERS = {"name": P.substring("p_name"), "brand": P.equals("p_brand"), "min_size": P.at_least("p_size"), "max_size": P.at_most("p_size"), "type": P.one_of("p_type"), "slots": P.any_bit("p_size"), "masks": P.all_masks("p_size")}


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_name ILIKE '%A%' AND p_size >= 10 AND p_size <= 30 AND (p_size & 6) <> 0")
def filter_dispatch(t):
    params = {"name": "A", "min_size": 10, "max_size": "30", "brand": "", "type": None, "slots": 6, "unknown": 1}
    return P.apply_filters(t("part"), PART_FILTERS, params).select("p_partkey", "p_name", "p_size")


@query("SELECT p_partkey FROM part WHERE (p_size & 1) <> 0 AND (p_size & 12) <> 0")
def filter_all_masks(t):
    return P.apply_filters(t("part"), PART_FILTERS, {"masks": "1,12"}).select("p_partkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%r_0000%' OR s_suppkey = 7")
def filter_name_or_key(t):
    s = t("supplier")
    return s.filter(P.entity_name("s_name")("r 0000") | P.key_or_name("s_suppkey", "s_name")("7")).select("s_suppkey", "s_name")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '%77%'")
def filter_number_as_text(t):
    return t("orders").filter(P.number_like("o_orderkey")("77")).select("o_orderkey")


@query("""SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size END lo, CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size + 10 END hi FROM part)
 WHERE (lo = -1 OR lo <= 20) AND (hi = -1 OR hi >= 20)""")
def filter_sentinel_range(t):
    p = t("part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size")).alias("lo"), F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.col("p_size") + 10).alias("hi"))
    return p.filter(P.within(F.col("lo"), F.col("hi"), 20)).select("p_partkey")


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a, b' WHEN p_size % 3 = 1 THEN '' END AS req, CASE WHEN p_size % 4 = 0 THEN 'c ,d' END AS dis FROM part)
 SELECT p_partkey, list_contains(string_split(coalesce(req, ''), ','), 'b') AS exact FROM f
 WHERE (trim(coalesce(req, '')) = '' OR list_has_any(string_split(replace(req, ' ', ''), ','), ['b', 'c']))
   AND (trim(coalesce(dis, '')) = '' OR NOT list_has_any(string_split(replace(dis, ' ', ''), ','), ['b', 'c']))""")
def filter_content_flags(t):
    size = F.col("p_size")
    p = t("part").select("p_partkey", F.when(size % 3 == 0, "a, b").when(size % 3 == 1, "").alias("req"), F.when(size % 4 == 0, "c ,d").alias("dis"))
    return p.filter(P.flags_allow(F.col("req"), F.col("dis"), ["b", "c"])).select("p_partkey", P.flag_in_set(F.coalesce("req", F.lit("")), "b").alias("exact"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 3)")
def filter_ignored_places(t):
    ignored = t("nation").filter("n_nationkey < 3").select("n_name")
    return t("nation").join(ignored, "n_name", "left_anti").select("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-06-01'")
def filter_day_range(t):
    return t("orders").filter(P.day_range(F.col("o_orderdate"), "1996-03-01", "1996-05-31")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE FALSE")
def filter_nothing(t):
    return t("customer").filter(F.lit(False)).select("c_custkey")


@query("SELECT part.p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount >= 0.1)")
def filter_any_of_relations(t):
    l = t("lineitem").filter("l_quantity > 49 or l_discount >= 0.1").select(F.col("l_partkey").alias("p_partkey"))
    return t("part").join(l, "p_partkey", "left_semi").select("p_partkey")


# ---- joins

@query("""SELECT n_name, p_partkey, cnt, position FROM (SELECT n_name, l_partkey AS p_partkey, count(*) AS cnt, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, l_partkey) AS position
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, l_partkey) WHERE position <= 5""")
def join_chain_top_per_group(t):
    counts = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("c"))
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name")
    found = counts.join(places, counts["l_suppkey"] == places["s_suppkey"]).groupBy("n_name", F.col("l_partkey").alias("p_partkey")).agg(F.sum("c").alias("cnt"))
    return R.top_k(found, ["n_name"], [F.col("cnt").desc(), F.col("p_partkey")], 5).select("n_name", "p_partkey", "cnt", "position")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_quantity >= 50)")
def join_semi_nested(t):
    big = t("orders").join(t("lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return t("customer").join(big.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS returned, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2) AS small,
 p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0) AS full_price FROM part""")
def join_mark_columns(t):
    rules = {"returned": "l_returnflag = 'R'", "small": "l_quantity < 2", "full_price": "l_discount = 0"}
    return R.marks(t("part").select("p_partkey"), t("lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", rules)


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_filtered_relation(t):
    return t("orders").join(t("customer").filter("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT s_suppkey, n.n_name FROM supplier JOIN nation n ON lower(n.n_name) = lower((SELECT any_value(m.n_name) FROM nation m WHERE m.n_nationkey = s_nationkey))")
def join_on_name(t):
    own = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lower("n_name").alias("key"))
    named = t("nation").select("n_name", F.lower("n_name").alias("key"))
    return t("supplier").join(own, "s_nationkey").join(named, "key").select("s_suppkey", "n_name")


@query("""SELECT o_orderkey, l_partkey, l_quantity FROM (SELECT l_orderkey AS o_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) rn FROM lineitem) WHERE rn = 1""")
def join_one_child(t):
    first = F.min_by(F.struct("l_partkey", "l_quantity"), F.struct(-F.col("l_quantity"), "l_partkey", "l_linenumber")).alias("l")
    return t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(first).select("o_orderkey", "l.l_partkey", "l.l_quantity")


@query("""SELECT a.s_suppkey AS id, b.s_suppkey AS near_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey
 WHERE sqrt((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal) + (a.s_suppkey - b.s_suppkey) * (a.s_suppkey - b.s_suppkey)) <= 500""")
def join_distance(t):
    s = t("supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    return R.near_join(s, s, "s_nationkey", 500.0).filter("id <> near_id").select("id", "near_id")


@query("""SELECT DISTINCT p_partkey, m.e AS match FROM part, (VALUES ('7'), ('lace')) m(e) WHERE CASE WHEN m.e = '7' THEN p_partkey = 7 ELSE p_name ILIKE '%' || m.e || '%' END""")
def join_match_list(t):
    return P.matches(t("part"), "7|lace", "p_partkey", "p_name", "match").select("p_partkey", "match")


# ---- aggregates, windows, order

@query("SELECT o_custkey, count(*) AS finds, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS position FROM orders GROUP BY o_custkey ORDER BY finds DESC, o_custkey LIMIT 25")
def agg_leaderboard(t):
    counts = t("orders").groupBy("o_custkey").agg(F.count("*").alias("finds"), F.max("o_orderdate").alias("latest"), F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last_order"))
    top = counts.orderBy(F.col("finds").desc(), "o_custkey").limit(25)
    return R.top_k(top.withColumn("all", F.lit(1)), ["all"], [F.col("finds").desc(), F.col("o_custkey")], 25).drop("all")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def agg_child_count(t):
    return R.child_count(t("customer").select("c_custkey"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "n_orders")


@query("SELECT c_nationkey, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS raised, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS lowered FROM customer WHERE c_acctbal <> 0 GROUP BY c_nationkey")
def agg_sign_split(t):
    return t("customer").filter("c_acctbal <> 0").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("raised"), F.count_if(F.col("c_acctbal") < 0).alias("lowered"))


@query("""WITH l AS (SELECT unnest(['named','big','cheap']) AS layer), x AS (SELECT DISTINCT p_partkey, unnest(list_filter([CASE WHEN p_size > 40 THEN 'big' END, CASE WHEN p_retailprice < 950 THEN 'cheap' END], lambda v: v IS NOT NULL)) AS layer FROM part)
 SELECT l.layer, count(x.p_partkey) AS n FROM l LEFT JOIN x ON l.layer = x.layer GROUP BY l.layer""")
def agg_layer_counts(t):
    p = t("part").select(F.explode(F.array_distinct(F.array_compact(F.array(F.when(F.col("p_size") > 40, "big"), F.when(F.col("p_retailprice") < 950, "cheap"))))).alias("layer"))
    layers = p.sparkSession.createDataFrame([("named",), ("big",), ("cheap",)], "layer string")
    return layers.join(p.groupBy("layer").agg(F.count("*").alias("n")), "layer", "left").select("layer", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' WHEN bool_or(l_linestatus = 'O') THEN 'open' ELSE 'done' END AS class FROM lineitem GROUP BY l_orderkey")
def agg_priority_class(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_or(F.col("l_linestatus") == "O").alias("any_open"))
    return g.select("l_orderkey", "any_returned", F.when(F.col("any_returned"), "returned").when(F.col("any_open"), "open").otherwise("done").alias("class"))


@query("SELECT p_brand, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes FROM part GROUP BY p_brand")
def agg_joined_list(t):
    return t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",").alias("sizes"))


@query("SELECT o_custkey, o_orderkey, coalesce(sum(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cursor FROM orders")
def window_cursor(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return t("orders").select("o_custkey", "o_orderkey", F.coalesce(F.sum(F.round("o_totalprice").cast("long")).over(w), F.lit(0).cast("long")).alias("cursor"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 50")
def page_three(t):
    return R.page(t("part"), [F.col("p_size").desc(), F.col("p_partkey")], 3).select("p_partkey", "p_name")


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier")
def sort_natural_all(t):
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Zone "), F.col("s_suppkey").cast("string")).alias("label"))
    _shared(rows)
    return R.ranked(rows, [S.natural_key(F.col("label"))], "place").select("id", "place")


@query("""SELECT 'item' AS kind, 0 AS branch, p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE '%10%' UNION ALL SELECT 'vendor', 1, s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%10%' UNION ALL SELECT 'owner', 2, c_custkey, c_name FROM customer WHERE c_name ILIKE '%10%'""")
def set_tagged_search(t):
    named = lambda table, key, name: P.apply_filters(t(table), {"q": P.substring(name)}, {"q": "10"}).select(F.col(key).alias("id"), F.col(name).alias("name"))
    return R.concat_tagged([("item", named("part", "p_partkey", "p_name")), ("vendor", named("supplier", "s_suppkey", "s_name")), ("owner", named("customer", "c_custkey", "c_name"))]).select("kind", "branch", "id", "name")


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def set_union_ids(t):
    return t("lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("id")).union(t("supplier").filter("s_acctbal < 0").select("s_suppkey")).distinct()


# ---- scalar functions

@query("""SELECT p_partkey, trim(regexp_replace(replace(replace(p_name, '_', ' '), '-', '`'), '[#!~0-9]', '', 'g')) AS clean, CASE WHEN p_size > 20 THEN '+' || CAST(p_size - 20 AS VARCHAR) ELSE CAST(p_size - 20 AS VARCHAR) END AS signed,
 CASE WHEN p_size > 10 THEN 'Levels 10-' || p_size ELSE 'Level 10' END AS levels, sha256(p_name) AS digest FROM part""")
def scalar_text(t):
    return t("part").select("p_partkey", F.trim(S.clean_name(F.col("p_name"))).alias("clean"), S.signed(F.col("p_size") - 20).alias("signed"), S.level_label(F.lit(10), F.col("p_size")).alias("levels"), F.sha2("p_name", 256).alias("digest"))


@query("""WITH m AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS c FROM orders)
 SELECT o_orderkey, c // 1000 AS platinum, concat_ws(' ', CASE WHEN c // 1000 > 0 THEN (c // 1000) || ' pp' END, CASE WHEN c % 1000 // 100 > 0 THEN (c % 1000 // 100) || ' gp' END, CASE WHEN c % 100 // 10 > 0 THEN (c % 100 // 10) || ' sp' END, CASE WHEN c % 10 > 0 THEN (c % 10) || ' cp' END) AS price,
 concat_ws(' ', CASE WHEN c >= 86400 THEN (c // 86400) || 'd' END, CASE WHEN c >= 3600 THEN (c % 86400 // 3600) || 'h' END, CASE WHEN c >= 60 THEN (c % 3600 // 60) || 'm' END, CASE WHEN c % 60 > 0 OR c = 0 THEN (c % 60) || 's' END) AS lasting FROM m""")
def scalar_money_and_time(t):
    m = t("orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("c"))
    return m.select("o_orderkey", S.money_parts(F.col("c"))["platinum"].alias("platinum"), S.money_text(F.col("c")).alias("price"), S.duration_text(F.col("c")).alias("lasting"))


@query("""SELECT p_partkey, concat_ws(' ', CASE WHEN p_size & 1 = 1 THEN 'WAR' END, CASE WHEN p_size & 2 = 2 THEN 'CLR' END, CASE WHEN p_size & 4 = 4 THEN 'PAL' END, CASE WHEN p_size & 8 = 8 THEN 'RNG' END, CASE WHEN p_size & 16 = 16 THEN 'SHD' END, CASE WHEN p_size & 32 = 32 THEN 'DRU' END) AS labels,
 list_aggregate(list_transform(list_filter(range(1, 9), lambda i: (p_size >> (i - 1)::INTEGER) & 1 = 1), lambda i: i::VARCHAR), 'string_agg', ',') AS bits FROM part""")
def scalar_masks(t):
    bits = S.mask_positions(F.col("p_size").cast("long"), 8)
    return t("part").select("p_partkey", S.mask_labels(F.col("p_size"), BITS).alias("labels"), F.array_join(F.transform(bits, lambda i: i.cast("string")), ",").alias("bits"))


@query("""WITH d AS (SELECT p_partkey, p_partkey % 13 AS code, CAST(p_size AS BIGINT) AS d, CAST(p_size % 11 AS BIGINT) AS m FROM part), i AS (SELECT *, CASE WHEN code IN (1, 6) THEN CAST(ceil(m / 2.0) AS BIGINT) WHEN code = 2 THEN CAST(ceil(d * 3 / 5.0) AS BIGINT) WHEN code = 3 THEN 30 * m WHEN code = 7 THEN m WHEN code = 8 THEN m + 10 WHEN code = 9 THEN 2 * m + 10 WHEN code = 10 THEN 3 * m + 10 END AS i FROM d)
 SELECT p_partkey, CAST(CASE WHEN code = 0 THEN 0 WHEN code IN (4, 11, 12) THEN d WHEN code = 5 THEN least(greatest(d, 1), 3) WHEN i < d THEN greatest(i, 1) ELSE d END AS BIGINT) AS ticks FROM i""")
def scalar_buff_duration(t):
    return t("part").select("p_partkey", S.buff_duration(F.col("p_partkey") % 13, F.col("p_size").cast("long"), (F.col("p_size") % 11).cast("long")).alias("ticks"))


@query("""WITH e AS (SELECT p_partkey, 100 + p_partkey % 6 AS code, (p_size - 25) AS b, 60 AS m, p_size AS v FROM part), x AS (SELECT *, abs(b) + CASE code WHEN 101 THEN v / 2.0 WHEN 102 THEN v WHEN 103 THEN 2 * v WHEN 104 THEN 3 * v WHEN 105 THEN 4 * v ELSE 0 END AS r FROM e)
 SELECT p_partkey, CAST(CASE WHEN code = 100 THEN CASE WHEN b > m THEN m ELSE b END ELSE trunc((CASE WHEN b < 0 THEN -1 ELSE 1 END) * least(r, 60)) END AS BIGINT) AS effect FROM x""")
def scalar_effect_value(t):
    return t("part").select("p_partkey", S.effect_value(100 + F.col("p_partkey") % 6, F.col("p_size") - 25, F.lit(60), F.lit(0), F.col("p_size")).alias("effect"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN k <= 0 THEN NULL WHEN k <= 5 THEN 0 WHEN k <= 20 THEN 1 WHEN k <= 30 THEN 2 WHEN k <= 40 THEN 3 WHEN k <= 50 THEN 4 WHEN k <= 60 THEN 5 ELSE 6 END AS bucket FROM events")
def scalar_json_bucket(t):
    e = t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return e.select("event_id", "k", S.food_bucket(F.col("k")).alias("bucket"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split('b, a,,' || p_size || ',a', ','), lambda x: trim(x)), lambda x: x <> ''))), '|') AS parts, p_partkey // 1000 AS zone FROM part")
def scalar_parsed_list(t):
    text = F.concat(F.lit("b, a,,"), F.col("p_size").cast("string"), F.lit(",a"))
    return t("part").select("p_partkey", F.array_join(S.parsed_list(text), "|").alias("parts"), F.floor(F.col("p_partkey") / 1000).alias("zone"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey WHERE levenshtein(a.n_name, b.n_name) <= 1")
def scalar_one_edit(t):
    n = t("nation")
    other = n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("k"), "n_regionkey")
    return n.join(other, "n_regionkey").filter((F.col("n_nationkey") < F.col("k")) & S.within_one_edit(F.col("n_name"), F.col("b"))).select(F.col("n_name").alias("a"), "b")


# ---- words, templates, paths

@query("""WITH p AS (SELECT p_partkey, 'the Mix of xiv, iiii and did_i ' || ['mcmxc', 'vix', 'Iv', 'DC9'][p_size % 4 + 1] AS text FROM part)
 SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: CASE WHEN regexp_full_match(upper(w), '(M{0,4})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})') THEN upper(w) ELSE w END), 'string_agg', '') AS text FROM p""")
def scalar_roman(t):
    last = F.get(F.array(*map(F.lit, ("mcmxc", "vix", "Iv", "DC9"))), F.col("p_size") % 4)
    return t("part").select("p_partkey", S.roman_upper(F.concat(F.lit("the Mix of xiv, iiii and did_i "), last)).alias("text"))


@query("SELECT p_partkey, 'by ' || abs(p_size - 20) || ' to ' || p_size || ' at ' || (p_size * 2) || ' (5 ticks), 0 & # left' AS text FROM part")
def scalar_slots(t):
    n = F.col("p_size")
    return t("part").select("p_partkey", S.fill_slots(F.lit("by #2 to $1 at @1 %z, #9 & # left"), F.lit(5), F.array(F.lit(1), n - 20), F.array(n), F.array(n * 2)).alias("text"))


@query("""WITH b AS (SELECT s_nationkey, max(s_acctbal) - min(s_acctbal) AS w, max(s_suppkey) - min(s_suppkey) AS h, (max(s_acctbal) + min(s_acctbal)) / 2 AS centre, min(s_acctbal) AS low FROM supplier GROUP BY 1),
 s AS (SELECT *, coalesce(least(CASE WHEN w <> 0 THEN 760 / w END, CASE WHEN h <> 0 THEN 560.0 / h END), 1) AS scale FROM b) SELECT s_nationkey, CAST(round((low - centre) * scale + 400) AS BIGINT) AS screen_low FROM s""")
def spatial_viewport(t):
    x, y = F.col("s_acctbal"), F.col("s_suppkey")
    b = t("supplier").groupBy("s_nationkey").agg((F.max(x) - F.min(x)).alias("w"), (F.max(y) - F.min(y)).alias("h"), ((F.max(x) + F.min(x)) / 2).alias("centre"), F.min(x).alias("low"))
    return b.select("s_nationkey", F.round(S.to_screen(F.col("low"), F.col("centre"), S.fit_scale(F.col("w"), F.col("h"), 800.0, 600.0, 20.0), 800.0)).cast("long").alias("screen_low"))


@query("""SELECT 'zone' || (p_partkey % 100) AS file, kind, count(*) AS n FROM (SELECT DISTINCT p_partkey % 100 AS p_partkey, p_size, CASE p_size % 6 WHEN 0 THEN 'zone-line' WHEN 1 THEN 'portal' WHEN 2 THEN 'portal' WHEN 3 THEN 'zone-line' END AS kind FROM part)
 WHERE kind IS NOT NULL GROUP BY 1, 2""")
def spatial_annotations(t):
    labels = F.array(*map(F.lit, ("To_the Gate", "PoK Book", "a portal", "zone  line", "Portal: needs a key", "bank")))
    f = lambda c: c.cast("float")
    marks = t("part").select(F.concat(F.lit("zone"), (F.col("p_partkey") % 100).cast("string")).alias("file"), F.col("p_partkey").alias("line"), F.lit(3).alias("size"), F.get(labels, F.col("p_size") % 6).alias("label"), f(F.col("p_size")).alias("x"), f(F.lit(0)).alias("y"), f(F.lit(-0.0)).alias("z"))
    return maps.annotations(marks).groupBy("file", "kind").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS i, c_custkey % 97 AS x, c_custkey % 31 AS y FROM customer),
 g AS (SELECT c_nationkey, c_mktsegment FROM w GROUP BY 1, 2 HAVING count(*) >= 2), m AS (SELECT c_nationkey, c_mktsegment, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d, rest_to, rest_from FROM
  (SELECT c_nationkey, c_mktsegment, x, y, lag(x) OVER s AS px, lag(y) OVER s AS py, x % 3 AS rest_to, lag(x) OVER s % 3 AS rest_from FROM w WINDOW s AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY i)) WHERE px IS NOT NULL),
 v AS (SELECT c_nationkey, c_mktsegment, greatest(20, least(250, 2 * sum(d) / 18)) AS speed FROM m GROUP BY 1, 2)
 SELECT c_nationkey || '/' || c_mktsegment AS path, CAST(round(sum(2 * greatest(180, d / speed * 1000) + 1000 * (rest_to + rest_from))) AS BIGINT) AS duration, sum(2 + CASE WHEN rest_to > 0 THEN 1 ELSE 0 END + CASE WHEN rest_from > 0 THEN 1 ELSE 0 END)::BIGINT AS n_events
 FROM m JOIN g USING (c_nationkey, c_mktsegment) JOIN v USING (c_nationkey, c_mktsegment) GROUP BY 1""")
def path_timelines(t):
    path = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("path")
    points = t("customer").select(path, F.col("c_custkey").alias("number"), (F.col("c_custkey") % 97).alias("x"), (F.col("c_custkey") % 31).alias("y"), F.lit(0).alias("z"), (F.col("c_custkey") % 97 % 3).alias("pause"))
    meta = points.select("path", F.lit(3).alias("wander_type"), F.lit(1).alias("pause_type")).distinct()
    return paths.timelines(points, meta, "path").select("path", F.round("duration_ms").cast("long").alias("duration"), F.size("events").cast("long").alias("n_events"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size < 25 THEN 'Decrease' ELSE 'Increase' END || ' Armour by ' || abs(p_size - 25) || '%'
 WHEN 1 THEN 'Increase Haste by ' || p_size || '% to ' || (p_size + 5) || '%' WHEN 2 THEN 'Block ' || p_size || ' of ' || (p_size + 5) END AS description FROM part""")
def scalar_effect_text(t):
    table = [(0, "standard", "Armour", "%", False), (1, "focus", "Haste", None, None), (2, "text", "Block #1 of $1", None, None)]
    size = F.col("p_size").cast("long")
    known = t("part").sparkSession.createDataFrame(table, "effect long, kind string, label string, unit string, per_tick boolean")
    base = F.when(F.col("p_partkey") % 4 == 0, size - 25).otherwise(size)
    slots = t("part").select("p_partkey", (F.col("p_partkey") % 4).cast("long").alias("effect"), F.lit(100).alias("formula"), base.alias("base"), (size + 5).alias("limit"), F.lit(0).alias("most"), F.lit(6).alias("ticks"), F.lit(9).alias("level"))
    return effects.describe(slots, known, 70).select("p_partkey", "description")


# ---- nested documents

@query("SELECT r_name, to_json(list({'key': n_nationkey, 'name': n_name} ORDER BY n_nationkey)) AS doc FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def nested_document(t):
    children = t("nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return R.children_of(t("region"), children, "r_regionkey", ["key", "name"], "places").select("r_name", F.to_json("places").alias("doc"))


# ---- graph, space, files

@query("SELECT n_nationkey % 5 AS start, n_nationkey AS id, CAST(n_nationkey // 5 + 1 AS INTEGER) AS ordinal FROM nation")
def graph_chain(t):
    nodes = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") < 20, F.col("n_nationkey") + 5).cast("long").alias("next_id"))
    _shared(nodes)
    out = graph.chain_ranks(nodes, nodes.filter("id < 5"))
    return out.select(F.col("start").cast("int").alias("start"), F.col("id").cast("int").alias("id"), "ordinal")


@query(None)
def graph_matching(t):
    edges = t("supplier").select((F.col("s_nationkey")).alias("zone"), F.col("s_suppkey").alias("left_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank"))
    return graph.match_pairs(edges.withColumn("right_id", F.floor((F.col("left_id") + F.col("rank") * 7) / 2)), "zone")


@query("SELECT DISTINCT a.n_name AS name, b.n_name AS neighbour FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE l_quantity > 48")
def graph_neighbours(t):
    sold = t("lineitem").filter("l_quantity > 48").select("l_orderkey", "l_suppkey")
    owners = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    edges = sold.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("c_nationkey", "s_nationkey").distinct()
    a, b = (t("nation").select(F.col("n_nationkey").alias(k), F.col("n_name").alias(n)) for k, n in (("c_nationkey", "name"), ("s_nationkey", "neighbour")))
    return edges.join(a, "c_nationkey").join(b, "s_nationkey").select("name", "neighbour")


def _lines(t):
    p = t("part")
    f = lambda c: c.cast("float")
    return p.select(F.concat(F.lit("zone"), (F.col("p_size") % 3).cast("string")).alias("file"), F.col("p_partkey").alias("line"), (F.col("p_size") % 2 * 255).cast("int").alias("r"), F.lit(0).alias("g"), F.lit(7).alias("b"),
                    f(F.col("p_partkey")).alias("x1"), f(F.col("p_size")).alias("y1"), f(F.lit(0)).alias("z1"), f(-F.col("p_partkey")).alias("x2"), f(F.col("p_size") * 2).alias("y2"), f(F.lit(5)).alias("z2"))


@query("SELECT 'zone' || (p_size % 3) AS file, CAST(-max(p_partkey) AS DOUBLE) AS min_x, CAST(max(p_partkey) AS DOUBLE) AS max_x, CAST(min(p_size) AS DOUBLE) AS min_y, CAST(max(p_size) * 2 AS DOUBLE) AS max_y FROM part GROUP BY 1")
def spatial_bounds(t):
    return maps.bounds(_lines(t), ["file"]).select("file", *[F.col(c).cast("double").alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("SELECT 'zone' || (p_size % 3) AS file, CAST(p_size % 2 * 255 AS INTEGER) AS r, count(*) AS n, CAST(sum(p_partkey) AS DOUBLE) AS total_x FROM part GROUP BY 1, 2")
def binary_map_round_trip(t):
    back = maps.decode_maps(maps.encode_maps(_lines(t), "file"), "file")
    return back.filter("error = ''").groupBy("file", "r").agg(F.count("*").alias("n"), F.sum("x1").alias("total_x"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_acctbal = 0 THEN 0 ELSE -s_acctbal END AS DOUBLE) AS map_x, (least(s_acctbal, 100) + greatest(s_acctbal, 100)) / 2 AS mid, s_acctbal BETWEEN 0 - 150 AND 1000 + 150 AS inside FROM supplier")
def spatial_columns(t):
    x = F.col("s_acctbal")
    return t("supplier").select("s_suppkey", S.negate_axis(x).alias("map_x"), S.midpoint(x, F.lit(100.0)).alias("mid"), S.padded_bounds_contain(x, F.lit(0.0), F.lit(1000.0)).alias("inside"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(t):
    return windowed_counts(t("events"))


def _shared(df: DataFrame) -> None:
    """A folder for checkpoints where the session has none, as in tests; a cluster must name one that all executors share."""
    import tempfile

    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-checkpoint-"))
