"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their stems (leading bytes). A bounded, class-balanced sample of labelled rows is the
example set, and every term that stands in an example is in its index. A term weighs 1 + log of its count,
times its inverse document frequency over all documents, times 1 + chi-square of its dependence on the label
among the examples: plain weights let the many words of a topic outvote the few that a label depends on
(README has figures). Terms that no example has can meet none and are in no norm.

Search. Examples stand in an inverted index cut into blocks; the postings of a term are grouped by block,
and each group keeps its largest weight. The sums of these bound every cosine in a block, blocks are
opened from the highest bound on, and those whose bound does not reach the k-th best cosine stay closed, so
the neighbours found are exact. Votes weighted by similarity give a raw value, and a logistic curve fitted to
leave-one-out values of the examples, reweighted to the class shares of the labelled rows, makes it a probability.

Defined cases: null and empty texts and texts without a term of any example have the share of toxic rows among
the examples of that kind (of all labelled rows if there is none); texts of any length are read whole; equal
texts, also repeated rows, have equal scores; ties between neighbours go to the earlier example in the index;
without labelled rows of both kinds every score is the share of toxic rows (0 if there are none); an empty table
gives an empty one; a column of the name of the score is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.llm.shared import small_batches
from skein.llm.textscan import ALPHA, Scan, mix, slices, texts_of

#: Labelled rows of each class that serve as examples, and the longest text among them (documented bounds).
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 10_000
#: Neighbours that vote, examples in a block, blocks opened at first, lengths of stems in bytes.
K, BLOCK, OPEN, STEMS = 15, 64, 4, (4, 5, 6)
#: A term is frequent if more than this share (one in so many) of the examples has it; texts that are compared at once.
FREQUENT, BATCH = 24, 64


def terms_of(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a run of texts, and the text of each."""
    start, end = scan.start, scan.end
    out, text = [scan.hash_spans(start, end)], [scan.text]
    for k in STEMS:
        long = end - start > k
        out.append(mix(scan.hash_spans(start[long], start[long] + k) + np.uint64(k)))
        text.append(scan.text[long])
    return np.concatenate(out), np.concatenate(text)


class Vocabulary:
    """Sorted term hashes, and where those of each range of hashes begin."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bits = max(4, int(np.ceil(np.log2(2 * len(hashes) + 1))))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.begin = np.append(np.searchsorted(self.hashes, edges), len(hashes)).astype(np.int32)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms, -1 for those that are none."""
        out = np.full(len(terms), -1, np.int32)
        part = (terms >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begin[part], self.begin[part + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            hit = self.hashes[at] == terms[live]
            out[live[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            live, at, end = live[more], at[more], end[more]
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and number of occurrences, sorted by text and term."""
        terms, text = terms_of(Scan(data, offsets, ALPHA))
        at = self.find(terms)
        ok = at >= 0
        width = len(self.hashes) + 1
        keys = text[ok] * width + at[ok]
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[first], np.diff(first, append=len(keys))
        return keys // width, keys % width, counts


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several ranges, and the range each belongs to."""
    size = end - begin
    of = np.repeat(np.arange(len(begin)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + begin[of], of


class Index:
    """An inverted index of examples in blocks of BLOCK, and of every term the largest weight in each block.

    Terms that many examples have keep a weight for every example of a block, so that a block is opened for many
    texts at once by one product of matrices; the others keep lists of examples. Similarities of lists are summed
    at once, so a block's bound is the largest of those sums and what the frequent terms can add at most.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, n_terms: int):
        n = len(labels)
        # examples that share their heaviest term share blocks, so bounds are tight
        heavy = np.full(n, -1, np.int64)
        order = np.lexsort((term, weight, example))
        heavy[example[order]] = term[order]
        place = np.empty(n, np.int64)
        place[np.lexsort((np.arange(n), heavy))] = np.arange(n)
        self.place, example, self.labels, self.blocks = place, place[example], np.empty(n), -(-n // BLOCK)
        self.labels[place] = labels
        often = np.bincount(term, minlength=n_terms) * FREQUENT > n
        self.column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        rows = np.zeros((self.blocks * BLOCK, int(often.sum())), np.float32)
        many = often[term]
        rows[example[many], self.column[term[many]]] = weight[many]
        self.rows = rows  # single precision, as a worker keeps them; sums are in double precision
        self.most = rows.reshape(self.blocks, BLOCK, rows.shape[1]).max(1, initial=0.0).T.astype(float)
        example, term, weight = example[~many], term[~many], weight[~many]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order].astype(np.float32)
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1)).astype(np.int32)

    def nearest(self, text: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int = K, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n texts the k examples of largest cosine, ties to the earlier one: text, example and similarity of each.

        skip: of every text an example left out.
        """
        size = self.blocks * BLOCK
        bulk = self.column[terms] >= 0
        own = np.zeros((n, self.rows.shape[1]))
        own[text[bulk], self.column[terms[bulk]]] = weights[bulk]
        at, of = ranges(self.begin[terms], self.begin[terms + 1])  # none of a frequent term
        near = np.bincount(text[of] * size + self.example[at], self.weight[at] * weights[of], n * size).astype(float).reshape(n, self.blocks, BLOCK)
        reach = near.max(2) + own @ self.most
        opened = np.zeros((n, self.blocks), bool)
        wanted = np.argsort(-reach, 1, kind="stable").argsort(1) < OPEN  # the blocks of highest bound first
        while wanted.any():
            for b in np.flatnonzero(wanted.any(0)):
                who = np.flatnonzero(wanted[:, b])
                near[who, b] += own[who] @ self.rows[b * BLOCK : (b + 1) * BLOCK].T.astype(float)
            opened |= wanted
            known = np.where(opened[:, :, None], near, 0.0).reshape(n, size)
            if skip is not None:
                known[np.arange(n), skip] = 0
            best = np.partition(known, size - k, 1)[:, size - k] if size > k else np.zeros(n)
            wanted = ~opened & (reach > 0) & (reach >= best[:, None] - 1e-6)
        known = np.round(known, 9)  # so that sums of another order tie
        who, at = np.nonzero((known > 0) & (known >= best[:, None] - 1e-8))
        order = np.lexsort((at, -known[who, at], who))
        who, at = who[order], at[order]
        first = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[first], at[first], known[who[first], at[first]]


@dataclass
class Model:
    vocabulary: Vocabulary
    importance: np.ndarray  # of every term: inverse document frequency times dependence on the label
    index: Index
    curve: tuple[float, float]
    empty: float  # score without a term of any example

    def weigh(self, text: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the terms of texts, each text's of unit length."""
        w = (1 + np.log(counts)) * self.importance[terms]
        return w / np.sqrt(np.bincount(text, w * w))[text]

    def raw(self, text: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, skip: np.ndarray | None = None) -> np.ndarray:
        """The neighbours' votes, a value for each of n texts; one half without a neighbour."""
        who, at, near = self.index.nearest(text, terms, weights, n, skip=skip)
        total = np.bincount(who, near, n)
        return np.where(total > 0, np.bincount(who, near * self.index.labels[at], n) / np.maximum(total, 1e-12), 0.5)

    def evidence(self, text: str) -> list[tuple[int, float, int]]:
        """The neighbours that decide a text's score: example, similarity and label."""
        whose, terms, counts = self.vocabulary.count(*texts_of(pa.array([text])))
        if not len(terms):
            return []
        _, at, near = self.index.nearest(whose, terms, self.weigh(whose, terms, counts), 1)
        return [(int(i), float(s), int(self.index.labels[i])) for i, s in zip(at, near, strict=True)]

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.empty)
        data, offsets = texts_of(column)
        for a, b, part, cut in slices(data, offsets):
            text, terms, counts = self.vocabulary.count(part, cut)
            weights = self.weigh(text, terms, counts) if len(text) else np.zeros(0)
            for low in range(0, b - a, BATCH):
                i, j = np.searchsorted(text, [low, low + BATCH])
                have = np.unique(text[i:j])
                if len(have):
                    x = self.raw(np.searchsorted(have, text[i:j]), terms[i:j], weights[i:j], len(have))
                    out[a + have] = 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * x)))
        return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees; a null id is in no fold, and not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def terms_of_examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a few texts: sorted hashes of all their terms; and of every term of a text the text, the place among the hashes, the count."""
    found, owners, often = [], [], []
    for first, _, data, offsets in slices(*texts_of(pa.array(texts, pa.string())), limit=1 << 19):
        terms, text = terms_of(Scan(data, offsets, ALPHA))
        order = np.lexsort((terms, text))
        terms, text = terms[order], text[order]
        begin = np.flatnonzero((np.diff(terms, prepend=~terms[:1]) != 0) | (np.diff(text, prepend=-1) != 0))
        found.append(terms[begin])
        owners.append((text[begin] + first).astype(np.int32))
        often.append(np.diff(begin, append=len(terms)).astype(np.int32))
    hashes, at = np.unique(np.concatenate(found), return_inverse=True)
    return hashes, np.concatenate(owners), at.astype(np.int32), np.concatenate(often)


def dependence(term: np.ndarray, toxic: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Chi-square of every term's presence against the label. toxic: of every term of a text, the text's label."""
    yes, no = np.bincount(term, toxic, n_terms), np.bincount(term, 1 - toxic, n_terms)
    n1, n0 = max(1, labels.sum()), max(1, (1 - labels).sum())
    mean = (yes + no) / (n1 + n0)
    return (yes / n1 - no / n0) ** 2 / np.maximum(mean * (1 - mean) * (1 / n1 + 1 / n0), 1e-12)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Choose examples, count their terms over all of docs, index them, and calibrate.

    Examples are about ``rows`` rows of each class, chosen by a hash of the id among texts of at most
    ``chars`` characters, so what the driver holds is bounded whatever the input.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    nothing = np.zeros(0, np.int64)
    none = Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), Index(nothing, nothing, np.zeros(0), np.zeros(0), 0), (0.0, 0.0), share)
    if len(counts) < 2:
        return none
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    chosen = F.lit(False)
    for label, n in counts.items():
        chosen = chosen | ((F.col("label") == label) & (draw < int(min(1.0, rows / n) * (1 << 30))))
    sample = known.filter(chosen).groupBy("id").agg(F.max("label").alias("label"))
    picked = {r[0]: r[1] for r in sample.collect()}
    # at most a few thousand ids, so they go to the scan as a broadcast
    got = docs.filter(F.length(text_col) <= chars).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(spark.createDataFrame([(int(i),) for i in picked], "id long")), "id").collect()
    got = sorted({r[0]: r[1] for r in sorted(got, key=lambda r: (r[0], r[1]), reverse=True)}.items())
    y = np.array([picked[i] for i, _ in got])
    if len(set(y.tolist())) < 2:
        return none
    hashes, text, term, tf = terms_of_examples([t for _, t in got])
    size = len(hashes)
    if not size:
        return none
    vocabulary = Vocabulary(hashes)
    shared = spark.sparkContext.broadcast(vocabulary)
    small_batches(spark)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, part, cut in slices(*texts_of(batch.column(0))):
                _, terms, _ = shared.value.count(part, cut)
                df += np.bincount(terms, minlength=size)
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(have, -1).astype(np.int32)), pa.array(np.append(df[have], n))], names=["term", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(tally, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)  # the last: all documents
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    importance = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * (1 + dependence(term, y[text], y, size))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    has = np.zeros(len(y), bool)
    has[text] = True
    empty = float((weight * y)[~has].sum() / max(weight[~has].sum(), 1e-12)) if (~has).any() else share
    w = (1 + np.log(tf)) * importance[term]
    w = w / np.sqrt(np.bincount(text, w * w, len(y)))[text]
    whose = (np.cumsum(has) - 1)[text]  # among the examples with a term
    ys = y[has].astype(float)
    model = Model(vocabulary, importance, Index(whose, term, w, ys, size), (0.0, 0.0), empty)
    # each example again, without itself
    raws = np.zeros(len(ys))
    for low in range(0, len(ys), BATCH):
        i, j = np.searchsorted(whose, [low, low + BATCH])
        n = min(BATCH, len(ys) - low)
        raws[low : low + n] = model.raw(whose[i:j] - low, term[i:j], w[i:j], n, skip=model.index.place[low : low + n])
    model.curve = _calibrate(raws, ys, np.where(ys == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return model


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one value, with a small pull to a sensible slope."""
    if not len(x):
        return 0.0, 0.0
    w = w / w.mean()
    a, b = -3.0, 6.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(w * (y - p)).sum() - 0.5 * (a + 3), (w * (y - p) * x).sum() - 0.5 * (b - 6)])
        h = w * p * (1 - p)
        m = np.array([[h.sum() + 0.5, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 0.5]])
        d = np.linalg.solve(m, g)
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "toxic_score") -> DataFrame:
    """All columns of docs with the score (replacing a column of that name)."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() == score_col.lower()))
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(at)), pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score_col, "double"))
