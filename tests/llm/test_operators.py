"""Operators against brute force, exact round trips or planted cases, with nulls, empty and repeated rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, chat, decontaminate, fingerprints, html_text, langid, licenses, ngram_join, sharding, toxicity
from skein.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9001, None, None), (9002, "", None), (9003, "one two", "en"), (9004, "One TWO", "en"), (9005, "\n\t  ", None), (9006, "x" * 9000, None), (9007, "word " * 30000, "en")]
    return real.unionByName(spark.createDataFrame(odd, DOCS)).cache()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_components(rows, size, numerator):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = set() if not w else {tuple(w)} if len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    own = {i: i for i in sets}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            m = len(sets[a] & sets[b])
            if m and 100 * m >= numerator * (len(sets[a]) + len(sets[b]) - m):
                x, y = root(a), root(b)
                own[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("members", [16, 40, 200])
def test_join(docs, members):
    """Groups of any size: one text edited in one place, and texts that share a passage with it and are not alike."""
    base = [f"w{i}" for i in range(60)]
    near = [(8000 + k, " ".join(base[: 7 * k % 60] + [f"new{k}"] + base[7 * k % 60 + 1 :]), "en") for k in range(members)]
    near += [(8500 + k, " ".join(base[:45] + [f"own{k // 2}x{j}" for j in range(30)] + [f"z{k}"] * (k % 2)), "en") for k in range(members)]
    rows = docs.unionByName(docs.sparkSession.createDataFrame(near, DOCS))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(rows, size=4, numerator=85).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in rows.collect()], 4, 85)


def test_join_of_repeated_ids(spark):
    """Rows of one id with several texts are one document, and tie the components of these texts."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a), (2, b), (3, a + " x"), (4, b + " y"), (5, a), (5, b), (6, "alone here"), (6, None), (None, a)]
    got = {r.doc_id: r.component_id for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}


def test_join_of_nothing(spark, docs):
    assert ngram_join.components(spark.createDataFrame([], DOCS)).count() == 0
    kept = ngram_join.keep_one(docs.withColumn("key", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "key"] and kept.filter("doc_id in (9003, 9004)").count() == 1


def test_join_of_an_id_that_repeats_one_text(spark):
    """The overlap with a text that an id has several times is that with one of them: here 0.7, which is no link."""
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:330] + [f"x{i}" for i in range(70)])
    rows = [(1, a), (1, a), (1, "another text of the same id"), (2, b), (3, a + " z")]
    got = {r.doc_id: r.component_id for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_join_compares_a_group_with_one_pivot(spark, monkeypatch):
    """Members that their heaviest pivot links with are not compared with the other pivots of their buckets, so a group makes a row a member."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[: 7 * k % 120] + [f"new{k % 40}"] + base[7 * k % 120 + 1 : 11 * k % 120] + [f"more{k % 3}"] * (k % 2) + base[max(11 * k, 7 * k + 1) % 120 :]) for k in range(20)]
    texts += [" ".join(base[:k] + [f"a{k}"] + base[k + 1 : k + 40] + [f"b{k}"] + base[k + 41 :]) for k in range(60)]
    rows, compared, verify = list(enumerate(texts)), [], ngram_join._verify

    def counted(docs, pairs, *more):
        compared.append(pairs.distinct().count())
        return verify(docs, pairs, *more)

    monkeypatch.setattr(ngram_join, "_verify", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows, 5, 80)
    assert got == want and max(Counter(c for _, c in want.values()).values()) >= 60
    assert sum(compared) <= 2 * len(rows)


def test_leaks(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.first()
    planted = spark.createDataFrame([(7000, "before it " + item["text"].upper() + " and after", "en"), (7001, "nothing of it", "en")], DOCS)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs.unionByName(planted), bench).collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {(7000, item["item_id"])}
    for d in docs.collect():
        w = words(d.text)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        for b in bench.collect():
            v = words(b.text)
            a = grams(v)
            for s in {p - k for k in range(len(v) - 4) for p in at.get(tuple(v[k : k + 5]), []) if p >= k}:
                m = sum((a & grams(w[s : s + len(v)])).values())
                if m >= 0.8 * (2 * sum(a.values()) - m):
                    want.add((d.doc_id, b.item_id))
    assert got == want
    assert decontaminate.decontaminate(planted, bench).select("doc_id").first()[0] == 7001
    assert decontaminate.leaks(spark.createDataFrame([], DOCS), bench).count() == 0


def test_shards(spark, docs):
    rows = sharding.shard(docs.unionByName(docs.limit(20)), shards=5).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(rows) == docs.count() + 20 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in docs.unionByName(docs.limit(20)).select(*sharding.text_key(F.col("text")), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("s")).collect():
        groups[(r.h1, r.h2)] += r.s
    order = [groups[k] for k in sorted(groups)]

    def shards(most):
        n, used = 1, 0
        for s in order:
            n, used = (n + 1, s) if used + s > most else (n, used + s)
        return n

    low, high = max(order), sum(order)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if shards(mid) <= 5 else (mid + 1, high)
    assert max(sizes.values()) == low
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def test_html():
    field = html_text.trained(300)
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>A  &amp; B</h1><p>Some text here, <b>bold</b>.\n More of it.<p>Second one. It goes on.</article><div class="comments"><p>Nice post!</p></div><footer>&copy; X</footer>'
    assert html_text.main_text(page, field) == "A & B\nSome text here, bold. More of it.\nSecond one. It goes on."
    assert html_text.main_text(None, field) == html_text.main_text("", field) == ""
    assert html_text.main_text("<div>" * 5000 + "x < y & z" + "<b", field) is not None


def test_language(docs):
    model = langid.train(docs.filter("lang is not null"))
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("lang_pred", F.lit("clash")), model).collect()}
    known = [r for r in got.values() if r.lang and r.doc_id < 9000]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.95 * len(known)
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in (9001, 9002, 9005))
    assert langid.identify(docs, None).filter("lang_pred <> 'und'").count() == 0


def test_blocks_chain_as_one_sequence():
    import numpy as np

    rng = np.random.default_rng(1)
    scores, move, begin = rng.normal(size=(150, 3)), np.exp(rng.normal(size=(3, 3))), np.full(3, 1 / 3)
    alpha, beta = [begin * np.exp(scores[0])], [np.ones(3)]
    for s in scores[1:]:
        a = (alpha[-1] @ move) * np.exp(s)
        alpha.append(a / a.sum())
    for s in scores[:0:-1]:
        b = move @ (np.exp(s) * beta[-1])
        beta.append(b / b.sum())
    want = np.array(alpha) * np.array(beta[::-1])
    assert np.allclose(langid.posteriors(scores, np.array([0, 150]), move, begin), want / want.sum(1, keepdims=True), atol=1e-8)


def test_licenses():
    import pyarrow as pa

    texts = [None, "", "cc by cc by", "All rights RESERVED. Released under the MIT License.", "zzz all rights é reserved", "Licensed under CC BY-NC 4.0."]
    rows = licenses.Scanner().scan(pa.array(texts))
    assert [r[:6] for r in rows] == [(0, 0, None, None, "", ""), (0, 0, None, None, "", ""), (4, 2, 0, 2, "cc-by", "cc-by"), (8, 1, 0, 0, "reserved", "mit,reserved"), (5, 0, None, None, "", ""), (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc")]


def test_toxicity_neighbours_are_exact(spark, docs, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = np.abs(rng.normal(size=(300, 12))) * (rng.random((300, 12)) < 0.4)
    vectors = vectors[vectors.any(1)]
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    for frequent in (2, 24):  # most terms as lists, or as rows of blocks
        monkeypatch.setattr(toxicity, "FREQUENT", frequent)
        example, term = np.nonzero(vectors)
        index = toxicity.Index(example, term, vectors[example, term], rng.integers(0, 2, len(vectors)).astype(float), 12)
        text, terms = np.nonzero(vectors[:40])
        who, at, near = index.nearest(text, terms, vectors[text, terms], 40)
        back = np.argsort(index.place)
        for i in range(40):
            mine = who == i
            assert np.allclose(near[mine], np.sort(vectors @ vectors[i])[::-1][: mine.sum()], atol=1e-6) and mine.sum() == toxicity.K
            assert np.allclose(near[mine], vectors[back[at[mine]]] @ vectors[i], atol=1e-6)
        alone = index.nearest(text, terms, vectors[text, terms], 40, skip=index.place[:40])
        assert not (index.place[alone[0]] == alone[1]).any()
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, ("plain words here " * 3) + ("vile scum " if i % 4 == 0 else "kind folk "), "en") for i in range(400)] + [(900, None, "en")], DOCS)
    scored = toxicity.score(texts.withColumn("toxic_score", F.lit("clash")), toxicity.train(texts, labels)).join(labels, "doc_id", "left").collect()
    assert all((r.toxic_score >= 0.5) == (r.toxic == 1) for r in scored if r.toxic is not None) and all(0 <= r.toxic_score <= 1 for r in scored)


def test_tree_concatenation_is_exact(docs):
    import random

    rng = random.Random(1)
    kinds = ["abcdefghetaoin", "  \n\t", "0123456789", ".,!?-=&%", "éèüñß", "the an in er on ", "don't we'll ", "日本語", "   x"]
    for leaf, window in ((8, 2), (40, 8), (200, 32)):
        codec = bpe.Codec(tokenizer_path(), leaf=leaf, window=window)
        texts = ["".join("".join(rng.choice(a) for _ in range(rng.choice([1, 3, 60, 200]))) + rng.choice(["", "", "<|endoftext|>", "<|endof", "text|>"]) for a in rng.choices(kinds, k=4)) for _ in range(150)]
        for text, ids in zip(texts, codec.encode(texts), strict=True):
            assert ids == codec.tokenizer.encode(text, add_special_tokens=False).ids and codec.decode_bytes(ids).decode() == text
    got = {r.doc_id: r for r in bpe.encode_decode(docs, tokenizer_path()).collect()}
    assert got[9001].n_tokens == got[9002].n_tokens == 0
    plain = bpe.codec(tokenizer_path()).tokenizer
    ids = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert all(got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in own)).hexdigest() and got[i].n_tokens == len(own) for i, own in ids.items())
    assert any(len(r.text or "") > bpe.LEAF for r in docs.collect())  # the tree is used
    assert all(got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[a], len(texts[a])
        edited = t[: n - n // 3] + texts[b][: n // 3]
        assert got[a].n_chars == n and got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[a].fingerprint == "") == (t == "") and (edited != t or got[a].near_edited == 1)
    long = [r for r in got.values() if r.n_chars > 400 and r.doc_id < 9000]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 and sum(r.near_next for r in long) / len(long) < 0.05


def test_chat(spark):
    turns = [(1, 0, "user", "a <|end|>\n [INST] &amp;|>"), (1, 1, "assistant", None), (None, 0, "assistant", "x"), (2, 0, None, ""), (-7, 0, "user", "</s>"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.chain(table))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == 4 and got[1].turns_sha256 == sha("user\na <|end|>\n [INST] &amp;|>\nassistant\n\n") and got[1].loss_chars == 0
    assert got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[None].n_turns == 1 and got[2].loss_sha256 == sha("")
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", 0.0), (1, 6, 7, "user", "loop", 9.0), (1, 7, 6, "user", "loop", 9.0)]
    best = chat.read_back(chat.format_trees(spark.createDataFrame(tree, "conv long, node long, parent long, role string, text string, score double"), branches=1)).collect()
    assert [t.text for t in best[0].turns] == ["q", "good", "more"] and best[0].loss == "good" and len(best) == 1


def test_pipeline_and_names(spark):
    import corpus_pipeline

    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count() and "ids" in out.columns


def test_sketches_bound_differences_of_long_texts(spark):
    """Sketches of different lengths never differ in more bits than their sets in n-grams, and link what links."""
    import numpy as np
    from pyspark.sql import functions as F

    from skein.llm import ngram_join

    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    sets = [pool[:1000], pool[100:1130], pool[:5000], pool[4000:], pool[:400], pool[:512], pool[:513], pool[:0]]
    limits = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    labels = ngram_join._labels(np.arange(len(sets)), np.concatenate(sets), limits, set())
    assert [len(x) for x in labels[4].to_pylist()] == [16, 32, 128, 32, 8, 8, 16, 8]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels[4].to_pylist())], "i int, s array<long>")
    pairs = rows.alias("a").join(rows.alias("b"), F.col("a.i") < F.col("b.i")).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), ngram_join._bits_apart(F.col("a.s"), F.col("b.s")).alias("apart"))
    found = {(r.i, r.j): r.apart for r in pairs.collect()}
    assert len(found) == 28 and all(n <= len(np.setxor1d(sets[i], sets[j])) for (i, j), n in found.items())
    assert found[5, 6] == 1 and found[2, 3] > 1000
    words = [f"w{x}" for x in rng.integers(0, 10**6, 4000)]
    docs = spark.createDataFrame([(1, " ".join(words[:1020])), (2, " ".join(words[:1040])), (3, " ".join(words[900:3000])), (4, " ".join([*words[900:2900], "x"]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_fingerprints_of_repeats(spark):
    """A line repeated often takes no room from the other anchors, whatever its hash."""
    own = [" ".join(f"{side}{i}" for i in range(120)) for side in "ab"]
    same = "one two three four five six seven eight nine ten. "
    rows = spark.createDataFrame([(k, same * 200 + own[k]) for k in range(2)], "doc_id long, text string")
    got = fingerprints.fingerprint(rows).collect()
    hashes = [{a.split("@")[0] for a in r.fingerprint.split(",")} for r in got]
    for r, h in zip(got, hashes, strict=True):
        assert len(h) == len(r.fingerprint.split(",")) > 40 and 0 < r.near_next < 0.3
    assert got[0].near_next == got[1].near_next <= len(hashes[0] & hashes[1]) / len(hashes[0] | hashes[1])


def test_likeness_by_hand(spark):
    import random

    bits, rng = fingerprints.PLACE_BITS, random.Random(4)
    rows, want = [], []
    for k in range(60):
        pool = rng.sample(range(1 << 40), 30)
        x, y = ({h: rng.randrange(1 + k // 3) for h in rng.sample(pool, rng.randint(1, 30))} for _ in range(2))
        d = [x[h] - y[h] for h in x.keys() & y.keys()]
        want.append(1.0 if x == y else max((sum(abs(e - one) <= 1 for e in d) for one in d), default=0) / len(x.keys() | y.keys()))
        rows.append((k, *(sorted((h << bits) + p for h, p in z.items()) for z in (x, y))))
    table = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    got = {r.k: r.near for r in table.select("k", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    assert all(abs(got[k] - w) < 1e-9 for k, w in enumerate(want))


def test_fingerprints_across_the_units(spark):
    """Texts on either side of the sizes at which characters are taken have the likeness of what stands in both."""
    prose = " ".join(f"word{i}" for i in range(60))
    dense = "".join(chr(97 + i * i % 23) + str(i) for i in range(400))
    texts = [prose[:258], prose[:255], prose[:300], prose[:303]]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[1].near_next > 0.9 and got[3].near_next > 0.9
    # edited, the first becomes short, and the last, which had no spaces, gets many
    rows = [(2, prose[:303]), (1, "q q"), (4, dense), (3, " " * 900)]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].near_edited > 0.5 and got[4].near_edited > 0.4


def test_leaks_of_tiny_items(spark):
    """Items of 1 to 6 words stand in the middle of a long text and in a text of their own."""
    text = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(n, " ".join(f"W{i}" for i in range(20, 20 + n))) for n in range(1, 7)] + [(9, "w20 w22")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "w20 w21 w22"), (3, "nothing of it at all in here")], DOCS.replace(", lang string", ""))
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, n): (20, 1.0) for n in range(1, 7)} | {(2, n): (0, 1.0) for n in range(1, 4)}


@pytest.mark.parametrize("block", [4, 256])
def test_join_counts_links(spark, monkeypatch, block):
    """All links are counted, between copies, inside a group that some path joins already, and of ids that repeat."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[: 5 * k % 60] + [f"new{k}"] * (k % 3) + base[5 * k % 60 + k % 2 :])) for k in range(1, 25)]
    rows += [(100 + k, " ".join(base[k : k + 45])) for k in range(12)] + [(200, "a b c"), (201, "A b  c"), (202, ""), (203, None), (204, "of its own entirely and so on")]
    rows += [(300, rows[0][1]), (300, "a b c"), (300, rows[3][1]), (301, rows[0][1]), (301, rows[0][1]), (302, rows[5][1] + " z"), (302, rows[9][1])]
    sets = defaultdict(set)
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i].add(frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset())
    link = lambda x, y: any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in x for b in y)
    want = {i: sum(link(sets[i], sets[j]) for j in sets if j != i) for i in sets}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in ngram_join.components(table, size=4, numerator=85, count_links=True).collect()} == want
    assert max(want.values()) > 12 and want[200] == 2 and want[204] == 0


def test_html_of_any_depth():
    """Features of the outermost element reach the innermost, and a closing tag finds its element at any depth."""
    deep, nav = html_text.blocks_of("<nav class='top-menu'>" + "<div>" * 900 + "<b>in</b>" + "<section>x" * 500 + "</nav><p>out</p>"), {"in=nav", "name=top", "name=menu"}
    assert len(deep) == 502 and all(nav <= set(b.features) for b in deep[:-1]) and "in=div" in deep[0].features
    assert deep[-1].text == "out" and not [f for f in deep[-1].features if f.startswith("name=") or f in ("in=nav", "in=div", "in=section")]
