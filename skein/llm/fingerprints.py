"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is a sequence of words; a k-mer of words is an anchor if the smallest of its inner s-mers, by hash,
stands at its start or at its end. Whether a k-mer is an anchor depends on nothing outside it, so an edit
moves anchors only where it touches them. A fingerprint keeps all anchors, each hash once with its first
place, so repeats take nobody's room. Two fingerprints are compared on the union of their hashes: the
likeness is the share of those that both have at places whose distance is the one most of them agree on.

Defined cases: a null text is empty; an empty text has an empty fingerprint; a text with too few words
for a k-mer has one anchor, its whole sequence; two texts are compared by characters if one of them is short
or hardly broken into words, else by words; equal texts have equal fingerprints; two empty fingerprints have likeness 1, an empty one and
another 0; rows that share an id follow each other in the order of their texts; a single row's next
document is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import let

#: Words of a k-mer and of an s-mer.
K, S = 5, 2
#: Bits of an anchor's place; the other bits of a positive long are its hash.
PLACE_BITS = 23
#: Characters up to which, and mean characters a word from which, a text is taken by characters.
SHORT, UNBROKEN = 256, 48


def by_characters(text: Column) -> Column:
    """Whether a text is short or has hardly any spaces."""
    n = F.length(text)
    spaces = n - F.length(F.replace(text, F.lit(" ")))
    return (n <= SHORT) | (n > UNBROKEN * (spaces + 1))


def words(text: Column, characters: Column) -> Column:
    """Words between spaces, or characters."""
    return F.when(characters, F.split(text, "")).otherwise(F.split(text, " "))


def with_anchors(df: DataFrame, text_col: str, out_col: str, characters: Column, k: int = K, s: int = S) -> DataFrame:
    """Adds the anchors of a text by words or by characters, smallest first: hash and place in one long, each hash once, at its first place.

    The anchors of a null text are null.
    """
    if s != 2 or k <= s:
        raise ValueError("inner substrings are pairs of words, shorter than k")
    w, g = f"{out_col}_words", f"{out_col}_pairs"
    df = df.withColumn(w, F.transform(words(F.col(text_col), characters), lambda x: F.xxhash64(x)))
    df = df.withColumn(g, F.when(F.size(w) >= k, F.zip_with(F.col(w), F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b))))
    last = k - s  # the inner s-mers of the k-mer at i are pairs i .. i + last

    def anchor(pairs: Column, x: Column, i: Column) -> Column:
        end = F.get(pairs, i + last)
        inner = F.least(x, end)
        closed = F.lit(True)
        for j in range(1, last):
            closed = closed & (F.get(pairs, i + j) >= inner)
        packed = F.shiftleft(F.shiftrightunsigned(F.xxhash64(x, F.get(pairs, i + 2), end), PLACE_BITS + 1), PLACE_BITS) + F.least(i, F.lit((1 << PLACE_BITS) - 1)).cast("long")
        return F.when((i <= F.size(pairs) - 2 - last) & closed, packed)

    hash_of = lambda v: F.shiftrightunsigned(v, PLACE_BITS)
    found = let(F.col(g), lambda pairs: F.transform(pairs, lambda x, i: anchor(pairs, x, i)))
    found = let(F.sort_array(F.array_compact(found)), lambda v: F.filter(v, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(v, i - 1)))))
    whole = F.array(F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(w)), PLACE_BITS + 1), PLACE_BITS))
    short = F.when(F.col(text_col) == "", F.array().cast("array<long>")).otherwise(whole)
    df = df.withColumn(out_col, found)
    # few k-mers may have no anchor among them; such a text, like one without a k-mer, is taken whole
    df = df.withColumn(out_col, F.when(F.col(text_col).isNotNull(), F.when(F.size(out_col) > 0, F.col(out_col)).otherwise(short)))
    return df.drop(w, g)


def as_text(anchors: Column) -> Column:
    """hash@place of every anchor, in hexadecimal, joined by commas."""
    return F.array_join(F.transform(anchors, lambda a: F.concat(F.lower(F.hex(F.shiftrightunsigned(a, PLACE_BITS))), F.lit("@"), F.lower(F.hex(a.bitwiseAND((1 << PLACE_BITS) - 1))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of both that agree in hash and, up to one common shift, in place; in the time of a sort."""
    mask = (1 << PLACE_BITS) - 1
    place = lambda v: F.shiftright(v, 1).bitwiseAND(mask)

    def shifts(both: Column) -> Column:
        """Of each hash that both have, its place in a less that in b. A value is hash, place and, in the last bit, whose it is."""
        same = lambda v, w: F.shiftrightunsigned(v, PLACE_BITS + 1) == F.shiftrightunsigned(w, PLACE_BITS + 1)
        shift = lambda v, w: (place(v) - place(w)) * (1 - 2 * v.bitwiseAND(1))
        return F.sort_array(F.array_compact(F.transform(both, lambda v, i: let(F.get(both, i + 1), lambda w: F.when(same(v, w), shift(v, w))))))

    def agree(runs: Column) -> Column:
        """The most shifts within 1 of one. runs: each different shift and where it begins among the sorted ones, and an end."""
        at = lambda i: F.get(runs, i)
        low = lambda r, i: F.when((i > 0) & (at(i - 1)["shift"] == r["shift"] - 1), at(i - 1)["start"]).otherwise(r["start"])
        high = lambda r, i: F.when(at(i + 1)["shift"] == r["shift"] + 1, at(i + 2)["start"]).otherwise(at(i + 1)["start"])
        return F.array_max(F.transform(runs, lambda r, i: high(r, i) - low(r, i)))

    def runs(d: Column) -> Column:
        begins = F.transform(d, lambda x, i: F.when((i == 0) | (x != F.get(d, i - 1)), F.struct(x.alias("shift"), i.alias("start"))))
        return F.concat(F.array_compact(begins), F.array(F.struct(F.lit(None).cast("long").alias("shift"), F.size(d).alias("start"))))

    def compare(d: Column) -> Column:
        return F.when(F.size(d) == 0, F.lit(0)).otherwise(let(runs(d), agree)) / (F.size(a) + F.size(b) - F.size(d))

    both = F.sort_array(F.concat(F.transform(a, lambda v: F.shiftleft(v, 1)), F.transform(b, lambda v: F.shiftleft(v, 1) + 1)))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(let(both, shifts), compare)).cast("double")


#: Rows in a run of neighbours, and the most runs (so that their tops can be broadcast and held by the driver).
RUN, RUNS = 64, 100_000


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: the values of the next row by descending doc_id; after the last comes the first.

    Rows are dealt into runs of neighbouring ids. The top row of the next run joins each run as a
    sentinel, so every row finds its next one within its run, in one shuffle. There are at most RUNS
    runs, whatever the table, and their tops are ids only.
    """
    spark = rows.sparkSession
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if not n:
        return rows.withColumns({f"next_{c}": F.col(c) for c in columns})
    width = max(1, -(-(high - low + 1) // max(1, min(RUNS, n // RUN))))
    run = F.floor((F.col("doc_id") - low) / width).cast("long")
    tops = sorted((r[0], r[1]) for r in rows.select("doc_id").groupBy(run.alias("run")).agg(F.max("doc_id")).collect())
    after = spark.createDataFrame([(tops[i - 1][1], tops[i][0]) for i in range(len(tops))], "doc_id long, run long")  # the first run's next top is that of the last
    sentinels = rows.join(F.broadcast(after), "doc_id").withColumn("sentinel", F.lit(1))
    both = rows.withColumns({"run": run, "sentinel": F.lit(0)}).unionByName(sentinels)
    order = Window.partitionBy("run").orderBy("sentinel", F.col("doc_id").desc(), "text")
    both = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return both.filter("sentinel = 0").drop("sentinel", "run")


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last third replaced by the beginning of the next document. Both texts of a comparison
    are taken by characters if either has to be, else by words; a fingerprint that is returned depends on its text only.
    Rows without an id have no place in the order and are left out.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("fine", by_characters(F.col("text"))), ["text", "fine"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("next_text", F.lit(1), third)))
    rows = rows.withColumn("fine_edited", by_characters(F.col("edited")))
    for text, fine in (("text", "fine"), ("edited", "fine_edited"), ("next_text", "next_fine")):
        rows = with_anchors(rows, text, f"{text}_anchors", F.col(fine))
        # beside a text that is taken by characters, one that is not has anchors by characters too
        beside = F.col("fine_edited") | F.col("next_fine") if text == "text" else F.col("fine")
        rows = rows.withColumn("coarse", F.when(beside & ~F.col(fine), F.col(text)))
        rows = with_anchors(rows, "coarse", f"{text}_characters", F.lit(True))

    def near(other: str, fine: str) -> Column:
        both = lambda text: F.when(F.col("fine") | F.col(fine), F.coalesce(f"{text}_characters", f"{text}_anchors")).otherwise(F.col(f"{text}_anchors"))
        return likeness(both("text"), both(other))

    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("text_anchors")).alias("fingerprint"), as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        near("edited", "fine_edited").alias("near_edited"), near("next_text", "next_fine").alias("near_next"),
    )
