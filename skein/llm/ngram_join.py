"""N-gram Jaccard join by vertical partitioning, and its components.

A document is the set of its distinct word n-grams, as 64-bit hashes. Their global order is that of the
hashes. The order is cut into fragments, each document's set thereby into segments, and overlaps are
counted fragment by fragment and summed per pair.

Candidates. Two sets with Jaccard t or more, of sizes a <= b, differ in at most d = (a + b)(1 - t) / (1 + t)
n-grams. With more than d segments of s or more n-grams in one of them, one of these at least is the same in
both. So sets are cut into some more fragments than the largest d of their band of sizes (a set near the end
of its band also as the next one is cut), and a set's keys are its segments of at least s n-grams, s being the
largest number (up to LARGEST) that leaves more than d; the set with the smaller s has the common segment
too. A set with too few non-empty segments has all of them and also its n-grams of smallest hash as keys, (1 - t) of it and
one more: two such sets share one. The segments of all other sets are more than d by a leeway that is the same for a band,
and as an n-gram spoils one segment only, linked sets have so many keys and one more in common: who shares fewer is left
out before anything is compared (_enough). No key depends on how frequent an n-gram is, and a common passage makes
two texts meet only where a whole segment of both lies in it.

Links. Every bucket of a key has a pivot. Each document is first compared with the heaviest pivot of its buckets
alone, which makes a row a document; then with the pivots that still lie in another component than it. Where a bucket
then still spans several components, members of different ones are compared, but for pairs whose unshared
n-grams alone rule a link out. So a group of G texts that link does not cost G * G comparisons, nor G for each
of its pivots; every pair that may link two components is compared exactly, and no bucket is cut short.

Copies (equal sets) are one class and join a component through it; their pairs are never listed.

The number of links of every document, if wanted, needs all pairs of a component's classes: they are counted by
products of matrices, block by block, so that a group of G classes gives G * G / BLOCK rows and no list of pairs.

Defined cases: a text without words, empty or null has an empty set, links with nothing and is its own
component; a text with fewer words than n has one n-gram, its whole sequence; rows that repeat an id are
one document whose component holds all of them; ties do not matter; a null id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import free_shuffles, saved, small_batches
from skein.llm.textscan import SPACED, Scan, mix, slices, texts_of

#: Ratio of a band's sizes, and fragments in which overlaps are counted.
RATIO, FRAGMENTS = 1.5, 16
#: Fragments for candidates, as a multiple of one more than the differences; the largest s.
SPARE, LARGEST = 1.2, 4
#: Linked sets share one key, and one more for so many n-grams in which they may differ; rounds in which that is asked for.
LEEWAY, ROUNDS = 20, 2
#: A bound on the keys that are asked for, so that they and the scheme stand in one number.
NEEDS = 1 << 16
#: Bytes that a task should read of a shuffle: its rows are short and sorted, so they take several times that of memory.
PARTITION = "16m"
#: Sets that a task remembers to leave out copies early.
SEEN = 1 << 20
#: Longs of the shortest parity sketch; a sketch has at least as many bits as its set has n-grams.
SKETCH = 8
#: Documents with candidates up to which their ids are broadcast to the scan; beyond, the join shuffles.
BROADCAST_DOCS = 1_000_000

#: Classes of a component in a block whose links are counted at once, and cells of a part of its matrix.
BLOCK, CELLS = 256, 1 << 22

_FRAGMENT, _SCHEME = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text, ascending within each, and the limits between texts."""
    grams, text = Scan(data, offsets, SPACED).shingles(size)
    cuts = np.searchsorted(text, np.arange(len(offsets)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[fresh], np.concatenate([[0], np.cumsum(fresh)])[cuts]


def bands(largest: int, numerator: int) -> list[tuple[int, int, int]]:
    """(first size, differences, fragments) of every band up to a size, and one band more."""
    out, low = [], 1
    while not out or out[-1][0] <= largest:
        high = max(low + 1, int(low * RATIO))
        differ = 2 * (high - 1) * (100 - numerator) // (100 + numerator)
        out.append((low, differ, 1 if not differ else int(np.ceil((differ + 1) * SPARE)) + 1))
        low = high
    high = max(low + 1, int(low * RATIO))
    differ = 2 * (high - 1) * (100 - numerator) // (100 + numerator)
    return [*out, (low, differ, 1 if not differ else int(np.ceil((differ + 1) * SPARE)) + 1)]


def _segments(grams: np.ndarray, sizes: np.ndarray, fragments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the non-empty segments of sets cut into fragments equal ranges of the order, the set of each, and its size."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    f = fragments.astype(np.uint64)[owner]
    place = ((grams >> np.uint64(32)) * f) >> np.uint64(32)
    begin = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(place, prepend=np.uint64(0)) != 0))
    if not len(begin):
        return grams[:0], owner[:0], owner[:0]
    content = np.add.reduceat(mix(grams), begin)
    return mix(content + place[begin] * _FRAGMENT + f[begin] * _SCHEME), owner[begin], np.diff(begin, append=len(grams))


def shared_least(differ: np.ndarray) -> np.ndarray:
    """Keys that two linked sets have in common at least, where they may differ in so many n-grams."""
    return np.minimum(1 + differ // LEEWAY, NEEDS - 1)


def keys_of(grams: np.ndarray, limits: np.ndarray, numerator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All keys of a run of sets, the set of each, the scheme by which it was cut, and how many keys of it are shared at least."""
    sizes = np.diff(limits)
    table = bands(int(sizes.max(initial=1)), numerator)
    first = np.array([b[0] for b in table])
    differ, fragments = np.array([b[1] for b in table]), np.array([b[2] for b in table])
    band = np.searchsorted(first, sizes, "right") - 1
    out, of, scheme, needs = [], [], [], []
    weak = np.zeros(len(sizes), bool)
    for ahead in (0, 1):
        use = sizes > 0 if not ahead else (sizes > 0) & (100 * sizes >= numerator * first[np.minimum(band + 1, len(first) - 1)])
        at = np.flatnonzero(use)
        if not len(at):
            continue
        b = band[at] + ahead
        keys, owner, large = _segments(grams[np.repeat(use, sizes)], sizes[at], fragments[b])
        need = shared_least(differ[b])
        least = np.ones(len(at), np.int64)
        for s in range(1, LARGEST + 1):
            enough = np.bincount(owner[large >= s], minlength=len(at)) >= differ[b] + need
            least[enough] = s
            if s == 1:
                strong = enough
        weak[at] |= ~strong
        keep = large >= least[owner]
        out.append(keys[keep])
        of.append(at[owner[keep]])
        scheme.append(b[owner[keep]])
        needs.append(np.where(strong, need, 1)[owner[keep]])
    for i in np.flatnonzero(weak).tolist():
        few = sizes[i] - -(-numerator * sizes[i] // 100) + 1
        out.append(mix(grams[limits[i] : limits[i] + few] + _SCHEME))
        of.append(np.full(few, i))
        scheme.append(np.full(few, -1))
        needs.append(np.ones(few, np.int64))
    if not out:
        return grams[:0], limits[:0], limits[:0], limits[:0]
    return tuple(np.concatenate(x) for x in (out, of, scheme, needs))


def _scan(docs: DataFrame, size: int, body, schema: str, names: list[str]) -> DataFrame:
    """Run body(ids, grams, limits, state) -> columns over every run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(*texts_of(batch.column(1))):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in body(ids[a:b], *sets_of(data, offsets, size), state)], names=names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _sums(grams: np.ndarray, limits: np.ndarray, salts: range) -> list[np.ndarray]:
    """For every salt, a hash of each set: the sum of its n-grams' hashes."""
    totals = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(k)), dtype=np.uint64)]) for k in salts)
    return [(t[limits[1:]] - t[limits[:-1]]).view(np.int64) for t in totals]


def _labels(ids: np.ndarray, grams: np.ndarray, limits: np.ndarray, _: set[int]) -> list:
    """Of every document: its id, the size of its set, two hashes of the set and its parity sketch.

    A sketch has a bit for each of 64 * SKETCH * 2**k ranges of n-grams, set if the set has an odd number of them,
    with the least k that gives a bit an n-gram. Two sets differ in at least as many n-grams as their sketches
    differ in bits; a longer sketch is folded to the length of a shorter one by the parity of its parts.
    """
    sizes = np.diff(limits)
    least = 64 * SKETCH
    bits = least << np.ceil(np.log2(np.maximum(sizes, least) / least)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(ids)), sizes)
    cell = starts[owner] + (mix(grams + np.uint64(3)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    parity = np.packbits((np.bincount(cell, minlength=starts[-1]) & 1).astype(np.uint8)).view(np.int64)
    sketch = pa.ListArray.from_arrays(pa.array(starts // 64, pa.int32()), pa.array(parity))
    return [ids, sizes.astype(np.int64), *_sums(grams, limits, range(1, 3)), sketch]


def _bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the longer folded to the length of the shorter; null if one is null."""
    xor = lambda x, y: x.bitwiseXOR(y)
    length = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        rest = F.sequence(F.lit(1), (F.size(x) / length).cast("int") - 1)
        return F.when(F.size(x) == length, x).otherwise(F.aggregate(rest, F.slice(x, F.lit(1), length), lambda acc, i: F.zip_with(acc, F.slice(x, i * length + 1, length), xor)))

    return F.aggregate(F.zip_with(folded(a), folded(b), xor), F.lit(0), lambda acc, x: acc + F.bit_count(x))


def components(docs: DataFrame, *, size: int = 5, numerator: int = 80, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id that links reach), n_links if wanted.

    n_links is the number of other documents that link with it, copies included. Two documents link if 100 * intersection >= numerator * union of their sets of size-word shingles.
    """
    free_shuffles(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION)
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = saved(_scan(docs, size, _labels, "doc_id long, n long, s1 long, s2 long, sketch array<long>", ["doc_id", "n", "s1", "s2", "sketch"]))
    # rows of one id may have several sets; then there is no sketch, and it rules nothing out
    sketches = every.filter("n > 0").groupBy("doc_id").agg(F.max("n").alias("n"), F.when(F.min("s1") == F.max("s1"), F.max("sketch")).alias("sketch"))
    sketches = saved(sketches)
    classes = every.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("head"))
    # rows (id, head): a document and the first one with its set; repeated ids may have several
    heads = saved(every.filter("n > 0").join(classes, ["s1", "s2"]).select("doc_id", "head", "n").distinct())

    def keyed(ids: np.ndarray, grams: np.ndarray, limits: np.ndarray, seen: set[int]) -> list:
        """Keys of the sets that this task has not met yet."""
        (one,) = _sums(grams, limits, range(1, 2))
        fresh = np.zeros(len(ids), bool)
        if len(seen) > SEEN:  # only saves work: copies are made one class later
            seen.clear()
        for i, s in enumerate(one.tolist()):
            if s not in seen:
                seen.add(s)
                fresh[i] = True
        keys, of, scheme, need = keys_of(grams, limits, numerator)
        keep = fresh[of]
        return [keys[keep].view(np.int64), ids[of[keep]], ((scheme[keep] + 1) * NEEDS + need[keep]).astype(np.int32)]

    # scheme and need in one column, as every column costs each of many rows
    keys = _scan(docs, size, keyed, "key long, doc_id long, scheme int", ["key", "doc_id", "scheme"])
    met = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    # members of buckets with several documents, as heads of their classes; most keys are met by one document only
    members = saved(keys.join(met, "key"))
    names = heads.groupBy("doc_id").agg(F.min("head").alias("head"), F.max("n").alias("n"))
    members = saved(members.join(names, "doc_id").select("key", F.col("head").alias("doc_id"), "n", "scheme").distinct())
    members = saved(_with_pivots(_enough(members)))

    first, found = _with_their_pivots(docs, members, sketches, size, numerator)
    rest = _across(docs, members, found, size, numerator)
    if not rest.isEmpty():
        second = _verify(docs, rest, "a", "b", sketches, size, numerator)
        found = connect(saved(first.unionByName(second).distinct()))
    # repeated ids tie their classes together
    repeated = every.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    ties = heads.join(repeated, "doc_id").join(names.withColumnRenamed("head", "least"), "doc_id").filter("head <> least").select(F.col("least").alias("a"), F.col("head").alias("b"))
    ties = saved(ties)
    if not ties.isEmpty():
        links = first if rest.isEmpty() else first.unionByName(second)
        found = connect(saved(links.unionByName(ties).distinct()))
    belongs = names.join(found, names["head"] == found["node"], "left").select("doc_id", F.coalesce("component", "head").alias("component_id"))
    out = every.select("doc_id", F.col("n").alias("n_shingles")).join(belongs, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if not count_links:
        return out
    out = saved(out)
    counts = _n_links(docs, every, out.select("doc_id", "component_id").distinct(), size, numerator)
    return out.join(counts, "doc_id", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _n_links(docs: DataFrame, every: DataFrame, belongs: DataFrame, size: int, numerator: int) -> DataFrame:
    """(doc_id, n_links) of documents with a set, counted over all pairs of classes of a component, block by block.

    A link never leaves a component. Classes of one are dealt into blocks of about BLOCK; every two blocks are compared
    in one group, which returns a count a class and no pairs. Pairs are listed only for ids that repeat with several
    sets, where a document must not be counted twice.
    """
    sets = every.filter("n > 0").select("doc_id", "s1", "s2").distinct()
    several = sets.groupBy("doc_id").agg((F.count("*") > 1).alias("multi"))
    sets = saved(sets.join(several, "doc_id"))
    classes = sets.groupBy("s1", "s2").agg(F.min("doc_id").alias("head"), F.sum((~F.col("multi")).cast("long")).alias("mult"), F.max("multi").alias("odd"))
    classes = saved(classes.join(belongs.withColumnRenamed("doc_id", "head"), "head"))
    shared = saved(classes.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    placed = classes.join(F.broadcast(shared) if shared.count() <= BROADCAST_DOCS else shared, "component_id")
    placed = saved(placed.withColumn("block", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int")))
    wanted = placed.select(F.col("head").alias("doc_id")).distinct()
    few = wanted.count() <= BROADCAST_DOCS

    def listed(ids: np.ndarray, grams: np.ndarray, limits: np.ndarray, _: set[int]) -> list:
        return [*_sums(grams, limits, range(1, 3)), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(grams.view(np.int64)))]

    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    grams = _scan(texts, size, listed, "s1 long, s2 long, grams array<long>", ["s1", "s2", "grams"]).dropDuplicates(["s1", "s2"])
    rows = saved(placed.join(grams, ["s1", "s2"])).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component_id", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "s1", "s2", "mult", "odd", "grams")

    def count(table: pa.Table) -> pa.Table:
        low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
        x, y = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
        s1, s2, mult = (table.column(c).to_numpy() for c in ("s1", "s2", "mult"))
        odd = table.column("odd").to_numpy(zero_copy_only=False).astype(bool)
        common, sizes = _common(table.column("grams").combine_chunks(), x, y)
        link = 100 * common >= numerator * (sizes[x][:, None] + sizes[y][None, :] - common)
        link &= x[:, None] != y[None, :]
        i, j = np.nonzero(link & (odd[x][:, None] | odd[y][None, :]))
        of, n, a, b = x, link @ mult[y], x[i], y[j]
        if low[0] != high[0]:
            of, n, a, b = np.concatenate([x, y]), np.concatenate([n, mult[x] @ link]), np.concatenate([a, b]), np.concatenate([b, a])
        nothing = [pa.nulls(len(of), pa.int64())] * 2
        counts = pa.table([s1[of], s2[of], *nothing, n.astype(np.int64)], names=["s1", "s2", "t1", "t2", "n"])
        pairs = pa.table([s1[a], s2[a], s1[b], s2[b], np.zeros(len(a), np.int64)], names=["s1", "s2", "t1", "t2", "n"])
        return pa.concat_tables([counts, pairs])

    found = saved(rows.groupBy("component_id", "low", "high").applyInArrow(count, "s1 long, s2 long, t1 long, t2 long, n long"))
    linked = found.groupBy("s1", "s2").agg(F.sum("n").alias("linked"))
    near = classes.select("s1", "s2", "mult").join(linked, ["s1", "s2"], "left").select("s1", "s2", (F.col("mult") + F.coalesce("linked", F.lit(0))).alias("near"))
    out = sets.join(near, ["s1", "s2"]).groupBy("doc_id").agg(F.max(F.when(F.col("multi"), F.lit(0)).otherwise(F.col("near") - 1)).alias("n_links"))
    if several.filter("multi").isEmpty():
        return out
    pairs = found.filter("t1 is not null").select("s1", "s2", "t1", "t2").unionByName(classes.filter("odd").select("s1", "s2", F.col("s1").alias("t1"), F.col("s2").alias("t2")))
    ends = sets.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("doc_id").alias("other"), F.col("multi").alias("other_multi"))
    more = pairs.join(sets, ["s1", "s2"]).join(ends, ["t1", "t2"]).filter("doc_id <> other and (multi or other_multi)").select("doc_id", "other").distinct().groupBy("doc_id").agg(F.count("*").alias("more"))
    return out.join(more, "doc_id", "left").select("doc_id", (F.col("n_links") + F.coalesce("more", F.lit(0))).alias("n_links"))


def _common(grams: pa.ListArray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams sets x and sets y have in common, as a matrix, and the sizes of all sets."""
    sizes = np.diff(grams.offsets.to_numpy()).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, crowd = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
    keep = crowd[column] > 1  # what one set alone has is not shared
    order = np.argsort(column[keep], kind="stable")
    column, owner = column[keep][order], owner[keep][order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
    common, width = np.zeros((len(x), len(y)), np.int64), max(1, CELLS // max(1, len(sizes)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [a, a + width])
        has = np.zeros((len(sizes), min(width, int(column[-1]) + 1 - a)), np.float32)
        has[owner[i:j], column[i:j] - a] = 1
        common += np.rint(has[x] @ has[y].T).astype(np.int64)
    return common, sizes


def _enough(members: DataFrame) -> DataFrame:
    """Members with as many keys of a scheme in common with others as linked sets have; who has fewer links with nobody."""
    for _ in range(ROUNDS):
        crowds = members.groupBy("key").agg((F.count("*") > 1).alias("crowd")).filter("crowd").select("key")
        members = members.join(crowds, "key")
        have = members.groupBy("doc_id", "scheme").agg((F.count("*") >= F.col("scheme") % NEEDS).alias("enough")).filter("enough").select("doc_id", "scheme")
        members = saved(members.join(have, ["doc_id", "scheme"]))
    return members.select("key", "doc_id", "n")


def _with_pivots(members: DataFrame) -> DataFrame:
    """Adds each bucket's pivot, its size and its weight: the member that meets most others over all its buckets, so the least edited of a group."""
    crowds = members.groupBy("key").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    members = members.join(crowds, "key")
    weights = members.groupBy("doc_id").agg(F.round(F.sum(F.log2("crowd")), 6).alias("weight"))
    members = saved(members.join(weights, "doc_id").select("key", "doc_id", "n", "weight"))
    pivots = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("id"), "n")).alias("p"))
    return members.drop("weight").join(pivots.select("key", (-F.col("p.id")).alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.weight").alias("pivot_weight")), "key")


def _with_their_pivots(docs: DataFrame, members: DataFrame, sketches: DataFrame, size: int, numerator: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between members and pivots of their buckets, as many as join all components that these make; and those components.

    A member that its heaviest pivot links with needs no comparison with the pivots that this one links with too.
    """
    pairs = members.filter("doc_id <> pivot")
    # where rows of one id have several sets, n is that of one only
    if sketches.filter("sketch is null").isEmpty():
        pairs = pairs.filter(100 * F.least("n", "pivot_n") >= numerator * F.greatest("n", "pivot_n"))
    pairs = saved(pairs.select("pivot", "doc_id", "pivot_weight").distinct())
    best = pairs.groupBy("doc_id").agg((-F.max(F.struct("pivot_weight", (-F.col("pivot")).alias("id")))["id"]).alias("pivot"))
    best = saved(best)
    links = saved(_verify(docs, best, "pivot", "doc_id", sketches, size, numerator))
    found = connect(links)
    rest = pairs.join(best, ["doc_id", "pivot"], "left_anti")
    for end in ("pivot", "doc_id"):
        rest = rest.join(found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component")), end, "left")
    rest = saved(rest.filter(F.coalesce("pivot_component", "pivot") != F.coalesce("doc_id_component", "doc_id")).select("pivot", "doc_id"))
    if rest.isEmpty():
        return links, found
    links = saved(links.unionByName(_verify(docs, rest, "pivot", "doc_id", sketches, size, numerator)))
    return links, connect(links)


def _across(docs: DataFrame, members: DataFrame, found: DataFrame, size: int, numerator: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, lie in different components, have not been compared and may link.

    An n-gram that no other document of these buckets has cannot be shared. With u of them, a set of a has at
    most a - u in common with any other, which leaves out the documents of a group that are edited too much.
    The rest meet by their n-grams, rarest first, where what follows in both still suffices for a link. Buckets
    of every size are taken alike, so what is listed follows the documents and not the size of their groups.
    """
    part = members.join(found, members["doc_id"] == found["node"], "left").select("key", "pivot", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))

    # pivots have been compared with all their bucket
    part = saved(part)
    open_ = part.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one < other").select("key")
    part = saved(part.join(open_, "key").filter("doc_id <> pivot"))
    wanted = part.select("doc_id").distinct()
    few = wanted.count() <= BROADCAST_DOCS

    def listed(ids: np.ndarray, grams: np.ndarray, limits: np.ndarray, _: set[int]) -> list:
        return [np.repeat(ids, np.diff(limits)), grams.view(np.int64)]

    grams = saved(_scan(docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"), size, listed, "doc_id long, gram long", ["doc_id", "gram"]))
    alone = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))
    part = part.join(alone, "doc_id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    least = part.groupBy("key").agg(F.min("n").alias("least"))
    may = lambda common, both: (100 + numerator) * common >= numerator * both  # noqa: E731  common n-grams suffice for sets with so many in all
    part = part.join(least, "key").filter(may(F.col("common"), F.col("n") + F.greatest("least", F.ceil(F.col("n") * numerator / 100))))
    part = saved(part.select("key", "doc_id", "n", "component", "least"))
    open_ = part.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one < other").select("key")
    left = saved(part.join(open_, "key").groupBy("doc_id").agg(F.max("n").alias("n"), F.min("component").alias("component"), F.min("least").alias("least")))
    # rarest first, the first n-gram that two sets share bounds what they have in common by what follows it in each
    grams = grams.join(left, "doc_id").distinct()
    counts = grams.groupBy("gram").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("crowd", "gram"))
    ranked = grams.join(counts, "gram", "left").withColumn("crowd", F.coalesce("crowd", F.lit(1))).withColumn("rest", F.col("n") + 1 - place).filter("crowd > 1")
    ranked = saved(ranked.filter(may(F.col("rest"), F.col("n") + F.greatest("least", F.ceil(F.col("n") * numerator / 100)))).select("gram", "doc_id", "n", "component", "rest"))
    other = ranked.select("gram", F.col("doc_id").alias("y"), F.col("n").alias("yn"), F.col("component").alias("yc"), F.col("rest").alias("yrest"))
    pairs = ranked.join(other, "gram").filter((F.col("doc_id") < F.col("y")) & (F.col("component") != F.col("yc")) & may(F.least("rest", "yrest"), F.col("n") + F.col("yn")))
    return saved(pairs.select(F.col("doc_id").alias("a"), F.col("y").alias("b")).distinct())


def _verify(docs: DataFrame, pairs: DataFrame, a: str, b: str, sketches: DataFrame, size: int, numerator: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps of their segments are counted fragment by fragment and summed, in one row a pair.

    Pairs whose sizes are too far apart for a link, or whose sketches differ in more bits than linked sets differ
    in n-grams, are left out before.
    """
    pairs = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    for end in "ab":
        pairs = pairs.join(sketches.select(F.col("doc_id").alias(end), F.col("n").alias(f"{end}n"), F.col("sketch").alias(f"{end}s")), end)
    apart = _bits_apart(F.col("as"), F.col("bs"))
    may = (100 * F.least("an", "bn") >= numerator * F.greatest("an", "bn")) & ((100 + numerator) * apart <= (100 - numerator) * (F.col("an") + F.col("bn")))
    pairs = pairs.filter(F.col("as").isNull() | F.col("bs").isNull() | may)
    pairs = saved(pairs.select("a", "b"))
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    few = wanted.count() <= BROADCAST_DOCS

    def cut(ids: np.ndarray, grams: np.ndarray, limits: np.ndarray, _: set[int]) -> list:
        owner = np.repeat(np.arange(len(ids)), np.diff(limits))
        cell = owner * FRAGMENTS + (grams >> np.uint64(60)).astype(np.int64)
        edges = np.searchsorted(cell, np.arange(len(ids) * FRAGMENTS + 1))
        segments = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(grams.view(np.int64)))
        return [ids, np.diff(limits).astype(np.int64), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * FRAGMENTS, pa.int32()), segments)]

    # a document whose id repeats stands for its first class; other rows of the id have their own heads
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    segments = _scan(texts, size, cut, "doc_id long, n long, segments array<array<long>>", ["doc_id", "n", "segments"])
    segments = saved(segments)
    left = segments.select(F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("segments").alias("a_segments"))
    right = segments.select(F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("segments").alias("b_segments"))
    overlaps = F.zip_with("a_segments", "b_segments", lambda x, y: F.size(F.array_intersect(x, y)))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", F.aggregate(overlaps, F.lit(0), lambda m, x: m + x).alias("m"))
    return both.filter(100 * F.col("m") >= numerator * (F.col("an") + F.col("bn") - F.col("m"))).select("a", "b").distinct()


def connect(links: DataFrame) -> DataFrame:
    """Components of a graph of links (a, b): (node, component), the smallest node that links reach.

    Every round gives each node its smallest neighbour and contracts the links; nodes that others point
    at are contracted in the next round. No round collects a node's links, and nothing goes to the driver.
    """
    edges, steps = links.select("a", "b"), []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
        if step.isEmpty():
            break
        steps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        edges = saved(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = steps[0]
    for step in steps[1:]:
        step = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return saved(out)


def keep_one(docs: DataFrame, *, size: int = 5, numerator: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's, with all columns; rows that repeat an id stay as they are."""
    found = components(docs, size=size, numerator=numerator, id_col=id_col, text_col=text_col)
    gone = saved(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    few = gone.count() <= BROADCAST_DOCS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == F.col("__gone"), "left_anti")
