"""Benchmark decontamination by SimHash of item-sized windows.

A document leaks an item if one of its windows of as many words as the item has a weighted Jaccard similarity
of 0.8 or more with it, over multisets of five-word shingles.

Search. An item of n words is looked for by windows of its own size, less the words that a leak may lose at its ends
(a leak at 0.8 loses at most a ninth of the n - 4 shingles) and HOP - 1 words (window_of). Documents give windows of
every such size at every HOP-th word, items at every word, so of a leak changed at its ends only, one window stands at
the same words in both. Windows are compared by SimHash: 64 bits, each the majority over the hashes of the window's
words, from running sums of stretches of a document. Stretches without any shingle of an item in reach are left out
before: a window there has similarity 0 with every item. Fingerprints are cut into blocks: any two
within Hamming distance RADIUS agree on all but RADIUS of them, so an index over every choice of that many blocks
finds all of these. Changed words inside a window cost a few bits each, which the radius covers in part (README has
the recall). Each hit lines the item up with a window, which is then compared exactly, also shifted by up to SHIFT words.

Defined cases: a null text is empty; texts and items without a word match nothing; an item with fewer than five words
is one shingle, its whole sequence; texts and items of any length are taken whole; items of equal text leak
separately; rows that repeat an id count as one document, which leaks an item if any of them does; rows of an item id
that repeats are one item each time, and a pair of ids is returned once, with its best window, the first of them in a
tie; rows without an id are in no pair, and decontaminate keeps them; with an empty table there are no pairs; other columns,
whatever their names, stay as they are.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import jit_sized_methods, let, saved

SHINGLE, SIMILARITY = 5, 0.8
HOP, RADIUS, SHIFT = 2, 3, 2
#: Words of items and rows of their index up to which they are broadcast, and so for leaking documents; beyond, joins shuffle.
BROADCAST_WORDS, BROADCAST_INDEX, BROADCAST_DOCS = 4_000_000, 2_000_000, 1_000_000
#: Fingerprints of a size up to which a fingerprint is cut into so many blocks; the more there are, the longer its keys.
PARTS = ((1 << 14, RADIUS + 1), (1 << 21, RADIUS + 2), (1 << 62, RADIUS + 3))


def words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


#: Words of a stretch of a document, at least; it is as long as the longest item if that is longer.
STRETCH = 256


def window_of(n: Column) -> Column:
    """Words of the windows by which an item of n words is looked for."""
    lost = F.floor(F.greatest(n - 4, F.lit(0)) / 9)
    return F.greatest(F.lit(1), n - lost - F.when(n < 7, 0).otherwise(HOP - 1)).cast("int")


def lane_width(words: int) -> int:
    """Bits of a lane that counts so many words, twice over."""
    return next(w for w in (8, 16, 32) if words < 1 << (w - 1))


def lane_mask(width: int) -> int:
    return sum(1 << i for i in range(0, 64, width))


def lanes(value: Column, bit: int, width: int) -> Column:
    """Of every lane's bits of a hash, one: 0 or 1 in each lane."""
    return F.shiftrightunsigned(value, bit).bitwiseAND(F.lit(lane_mask(width)))


def majority(sums: list[Column], words: Column, width: int) -> Column:
    """The SimHash of a window from its lane sums: adding a constant moves the majority into one bit of each lane, below the sign."""
    raised = F.lit(lane_mask(width)) * ((1 << (width - 2)) - 1 - F.floor(words / 2))
    bits = [F.shiftleft(F.shiftrightunsigned(x + raised, width - 2).bitwiseAND(F.lit(lane_mask(width))), b) for b, x in enumerate(sums)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def simhash(hashes: Column, words: Column, width: int) -> Column:
    """The SimHash of a few hashes."""
    total = lambda b: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + lanes(h, b, width))
    return majority([total(b) for b in range(width)], words, width)


def masks(parts: int, radius: int = RADIUS) -> list[int]:
    """Every choice of all but radius of the blocks of a fingerprint, as a mask of their bits."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    block = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(parts)]
    return [sum(block[i] for i in c) for c in combinations(range(parts), parts - radius)]


def shingles(hashes: Column, k: int = SHINGLE) -> Column:
    """The multiset of k-word shingles; a sequence of fewer words is one."""
    n = F.size(hashes)
    return F.when(n == 0, F.array().cast("array<long>")).when(n < k, F.array(F.xxhash64(hashes))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, k))))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two multisets: smaller counts over larger counts."""
    count = lambda x, e: F.size(F.filter(x, lambda v: v == e))
    both = lambda x: F.aggregate(F.array_intersect(a, x), F.lit(0), lambda s, e: s + F.least(count(a, e), count(x, e)))
    return let(b, lambda x: F.when(a == x, F.lit(1.0)).otherwise(let(both(x), lambda m: m / F.greatest(F.size(a) + F.size(x) - m, F.lit(1)))))


def index_of(items: DataFrame, width: int) -> tuple[DataFrame, dict[int, int]]:
    """Fingerprints of the items' windows (item_id, size, at, fp), and how many there are of every size."""
    n = F.size("hashes")
    rows = items.withColumn("size", window_of(n)).withColumn("at", F.explode(F.sequence(F.lit(0), n - F.col("size"))))
    counts = {r[0]: r[1] for r in rows.groupBy("size").count().collect()}  # as many as the items have distinct lengths
    return saved(rows.select("item_id", "size", "at", simhash(F.slice("hashes", F.col("at") + 1, F.col("size")), F.col("size"), width).alias("fp"))), counts


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def grams(docs: DataFrame, k: int) -> DataFrame:
    """Every k-word shingle of rows with as many words, and its place; in generated code, as all words of all documents pass here."""
    rows = docs.filter(F.size("hashes") >= k).select("*", F.explode(F.sequence(F.lit(0), F.size("hashes") - k)).alias("place"))
    return rows.select(rows.columns[0], "place", F.xxhash64(*(F.get("hashes", F.col("place") + i) for i in range(k))).alias("shingle"))


def places(docs: DataFrame, items: DataFrame, few: bool, stretch: int, reach: int) -> DataFrame:
    """Stretches (doc_id, stretch) within reach of a shingle that an item has; a leak shares one, so it lies in such stretches whole.

    docs: doc_id, hashes. items: hashes. few: whether to broadcast the items' shingles.
    """
    lengths = [r[0] for r in items.select(F.least(F.size("hashes"), F.lit(SHINGLE))).distinct().collect()]  # 1 to SHINGLE
    needles = [grams(items.filter(F.size("hashes") == k if k < SHINGLE else F.size("hashes") >= k), k) for k in lengths]
    needles = reduce(DataFrame.unionByName, needles).select("shingle").distinct()
    needles = F.broadcast(needles) if few else needles
    rows = [grams(docs, k) for k in lengths]
    near = reduce(DataFrame.unionByName, rows).join(needles, "shingle", "left_semi")
    of = lambda place: F.floor(F.greatest(place, F.lit(0)) / stretch).cast("int")
    return near.select("doc_id", of(F.col("place") - reach).alias("first"), of(F.col("place") + reach).alias("last")).distinct().select("doc_id", F.explode(F.sequence("first", "last")).alias("stretch")).distinct()


def running_sums(docs: DataFrame, near: DataFrame, stretch: int, most: int, width: int) -> DataFrame:
    """For every near stretch of every row: doc_id, own (words in which windows begin), sums (before each word and after the last).

    most: words of the largest window, by which a stretch reaches beyond its own words.
    """
    begin = F.col("stretch") * stretch + 1
    cut = docs.join(near, "doc_id").select("doc_id", "stretch", F.slice("hashes", begin, stretch + most).alias("part")).filter(F.size("part") > 0)
    cut = saved(cut.withColumn("row", F.monotonically_increasing_id()))
    words = cut.select("row", "doc_id", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), F.col("part"))).alias("at", "hash"))
    # as many tasks as the session has for shuffles: the rows are few, the windows made of them many
    words = words.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
    so_far = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = words.select("row", "doc_id", "at", *(F.sum(lanes(F.col("hash"), b, width)).over(so_far).alias(f"s{b}") for b in range(width)))
    lists = summed.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", *(f"s{b}" for b in range(width))))).alias("sums"))
    # what begins in the next stretch's words is that one's, or shares no shingle with an item
    return lists.join(cut.select("row", (F.col("stretch") * stretch).alias("before")), "row").select("doc_id", "before", F.least(F.size("sums") - 1, F.lit(stretch)).alias("own"), "sums")


def windows(sums: DataFrame, sizes: list[int], hop: int, choices: list[int], width: int) -> DataFrame:
    """The windows of stretches at every hop-th word, once a block choice: doc_id, place, size, number, bits, doc_fp."""
    # pairs of sums lie side by side before they become rows, so no row carries a whole stretch
    every = lambda x: F.filter(x, lambda _, i: i % hop == 0)
    rows = sums.select("doc_id", "before", "sums", F.slice(every(F.col("sums")), 1, F.ceil(F.col("own") / hop).cast("int")).alias("begin"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")).filter(F.col("size") < F.size("sums"))
    ends = F.slice(every(F.slice(F.col("sums"), F.col("size") + 1, F.size("sums"))), 1, F.size("begin")).alias("end")
    rows = rows.select("doc_id", "before", "size", F.posexplode(F.arrays_zip(F.col("begin").alias("y"), ends)).alias("at", "pair")).filter(F.col("pair.end").isNotNull())
    rows = rows.select("doc_id", (F.col("before") + F.col("at") * hop).alias("place"), "size", F.col("pair.end").alias("x"), F.col("pair.y").alias("y"))
    fp = majority([F.col(f"x.s{b}") - F.col(f"y.s{b}") for b in range(width)], F.col("size"), width)
    rows = rows.select("doc_id", "place", "size", fp.alias("doc_fp"))
    return rows.select("*", F.posexplode(blocks(F.col("doc_fp"), choices)).alias("number", "bits"))


def blocks(fp: Column, choices: list[int]) -> Column:
    return F.array(*(fp.bitwiseAND(F.lit(signed(m))) for m in choices))


def hashed(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", words(F.col("text")).alias("hashes"))


def candidates(texts: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Places (doc_id, item_id, start) at which a document's window is within the radius of an item's at the same words.

    texts: doc_id, text. items: item_id, hashes.
    """
    total, longest = items.agg(F.sum(F.size("hashes")), F.max(F.size("hashes"))).first()
    if not total:
        return texts.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start")).filter(F.lit(False))
    stretch = max(STRETCH, longest + longest % HOP)  # so windows reach into the next stretch only; even, so that places are the same in all
    width = lane_width(2 * stretch)
    index, counts = index_of(items, width)
    choices = masks(next(p for most, p in PARTS if max(counts.values()) <= most))
    keyed = saved(index.select("item_id", "size", "at", "fp", F.posexplode(blocks(F.col("fp"), choices)).alias("number", "bits")))
    near = saved(places(hashed(texts), items, total <= BROADCAST_WORDS, stretch, longest))
    few = near.count() <= BROADCAST_DOCS
    ids = near.select("doc_id").distinct()
    # the texts with a near stretch alone are read again
    docs = hashed(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))
    sums = saved(running_sums(docs, F.broadcast(near) if few else near, stretch, max(counts), width))
    found = []
    tiny = [n for n in counts if n < 7]  # items of fewer than seven words are looked for at every word
    for hop, sizes in ((HOP, sorted(set(counts) - set(tiny))), (1, sorted(tiny))):
        if not sizes:
            continue
        mine = keyed.filter(F.col("size").isin(sizes))
        few = sum(counts[n] for n in sizes) * len(choices) <= BROADCAST_INDEX
        rows = windows(sums, sizes, hop, choices, width)
        met = rows.join(F.broadcast(mine) if few else mine, ["size", "number", "bits"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("doc_fp"))) <= radius)
        found.append(met.select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("start")))
    return reduce(DataFrame.unionByName, found).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row a leaking pair: doc_id, item_id, start (word at which the best window begins), similarity."""
    jit_sized_methods(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(item_text_col)).alias("hashes")).filter(F.size("hashes") > 0)
    items = saved(items)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hits = saved(candidates(texts, items, radius))
    ids = hits.select("doc_id").distinct()
    # the texts of hit documents alone are read again; their ids are broadcast if they are few
    few = ids.count() <= BROADCAST_DOCS
    hit_texts = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    rows = hashed(hit_texts).join(hits, "doc_id")
    wanted = items.select("item_id", F.col("hashes").alias("item"), shingles(F.col("hashes")).alias("item_shingles"))
    rows = rows.join(F.broadcast(wanted) if (items.agg(F.sum(F.size("hashes"))).first()[0] or 0) <= BROADCAST_WORDS else wanted, "item_id")
    reach = F.greatest(F.col("start") - SHIFT, F.lit(0))
    rows = rows.select("doc_id", "item_id", "item_shingles", F.size("item").alias("words"), "start", reach.alias("from"), F.slice("hashes", reach + 1, F.size("item") + 2 * SHIFT).alias("near"))
    # no window here can share more shingles than all of them together do, so most hits end before they are compared;
    # an item of fewer words than a shingle is one shingle as long as itself, which those of near are not, so it is compared at once
    every = shingles(F.col("near"))
    shared = F.size(F.array_intersect("item_shingles", every)) + F.size("item_shingles") - F.size(F.array_distinct("item_shingles"))
    rows = rows.filter((F.col("words") < SHINGLE) | (shared >= threshold * F.size("item_shingles")))
    at = lambda shift: similarity(F.col("item_shingles"), shingles(F.slice("near", F.greatest(F.col("start") + shift - F.col("from") + 1, F.lit(1)), F.col("words"))))
    rows = rows.withColumn("exact", at(F.lit(0)))
    tries = F.when(F.col("exact") >= 1, F.array(F.struct(F.col("exact").alias("similarity"), F.lit(0).alias("shift")))).otherwise(
        F.transform(F.sequence(F.lit(-SHIFT), F.lit(SHIFT)), lambda d: F.struct(at(d).alias("similarity"), d.alias("shift")))
    )
    best = rows.select("doc_id", "item_id", "start", F.array_max(tries).alias("best"))
    best = best.groupBy("doc_id", "item_id").agg(F.max(F.struct("best.similarity", (-F.greatest(F.col("start") + F.col("best.shift"), F.lit(0))).alias("from"))).alias("best"))
    return best.filter(F.col("best.similarity") >= threshold).select("doc_id", "item_id", (-F.col("best.from")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    pairs = leaks(docs, benchmark, **names)
    bad = saved(pairs.select("doc_id").distinct())
    few = bad.count() <= BROADCAST_DOCS
    id_col = names.get("id_col", "doc_id")
    # the ids under a name that no column of docs has, and a join that keeps every column as it is
    own = next(f"leaking_{i}" for i in range(len(docs.columns) + 1) if f"leaking_{i}" not in (c.lower() for c in docs.columns))
    bad = bad.select(F.col("doc_id").alias(own))
    return docs.join(F.broadcast(bad) if few else bad, docs[id_col].cast("long").eqNullSafe(F.col(own)), "left_anti")
