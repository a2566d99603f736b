"""Windows, fingerprints and leaks against brute force."""

import random
import re
from collections import Counter

import pytest

from skein.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """Every window of an item's words, compared by multisets of shingles."""
    grams = lambda w: Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)])
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            a = grams(v)
            for s in range(max(1, len(w) - len(v) + 1)) if w and v else ():
                m = sum((a & grams(w[s : s + len(v)])).values())
                out[d, i] = max(out.get((d, i), 0), m / (2 * sum(a.values()) - m) if len(v) >= 5 else float(w[s : s + len(v)] == v))
    return {k for k, x in out.items() if x >= 0.8}


def changed(rng, item, kind):
    w = item.split()
    if kind == "middle":
        w[rng.randrange(6, len(w) - 6)] = "other"
    elif kind == "ends":
        w = ["x"] * ((len(w) - 4) // 18) + w[(len(w) - 4) // 18 : len(w) - (len(w) - 4) // 18] + ["y"] * ((len(w) - 4) // 18)
    return " ".join(w)


def table(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} long, text string")


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(900)]
    items = [(k, " ".join(rng.choices(pool, k=n))) for k, n in enumerate([16, 24, 33, 40, 52, 60, 70, 90] * 4)]
    docs = []
    for k, (i, item) in enumerate(items):
        for kind in ("same", "ends", "middle"):
            body = item if kind == "middle" and len(item.split()) < 50 else changed(rng, item, kind)
            docs.append((len(docs), " ".join(rng.choices(pool, k=rng.randrange(60))) + " " + body + " " + " ".join(rng.choices(pool, k=30))))
    return docs + [(9000, None), (9001, ""), (9002, "one two"), (9003, " ".join(rng.choices(pool, k=500)))], items


def test_recall_against_brute_force(spark, planted):
    docs, items = planted
    want = brute(docs, items)
    pairs = D.leaks(table(spark, docs, ["doc_id"]), table(spark, items, ["item_id"]))
    got = {(r.doc_id, r.item_id) for r in pairs.collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 80
    ends = {(d, i) for d, i in want if d % 3 < 2}
    assert ends <= got  # what is unchanged, or changed at its ends only, is always found


def test_radius_finds_what_equal_fingerprints_lose(spark, planted):
    docs, items = planted
    docs, items = table(spark, docs, ["doc_id"]), table(spark, items, ["item_id"])
    near, equal = ({(r.doc_id, r.item_id) for r in D.leaks(docs, items, radius=r).collect()} for r in (D.RADIUS, 0))
    assert equal < near


def test_running_sums_give_the_majority(spark):
    rng = random.Random(3)
    hashes = [rng.getrandbits(64) for _ in range(700)]
    docs = spark.createDataFrame([(1, [h - (1 << 64) if h >> 63 else h for h in hashes])], "doc_id long, hashes array<long>")
    near = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, stretch int")
    sums = D.running_sums(docs, near, 256, 200, 16)
    rows = D.windows(sums, [5, 60, 127, 200], 2, [(1 << 64) - 1], 16).collect()
    assert sorted((r["place"], r["size"]) for r in rows) == sorted((p, n) for p in range(0, 512, 2) for n in (5, 60, 127, 200) if p + n <= 700)
    for r in rows:
        bits = [sum(h >> j & 1 for h in hashes[r["place"] : r["place"] + r["size"]]) > r["size"] // 2 for j in range(64)]
        assert r["doc_fp"] & ((1 << 64) - 1) == sum(1 << j for j, x in enumerate(bits) if x) and r["bits"] == r["doc_fp"]


def test_block_choices_meet_within_the_radius():
    rng = random.Random(2)
    for _, parts in D.PARTS:
        choices = D.masks(parts)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for j in rng.sample(range(64), D.RADIUS):
                b ^= 1 << j
            assert any(a & m == b & m for m in choices)


def test_long_texts_and_long_items(spark, monkeypatch):
    """Stretches of a long text meet without a gap; items beyond 127 words have wider lanes."""
    monkeypatch.setattr(D, "STRETCH", 64)
    rng = random.Random(5)
    pool = [f"v{i}" for i in range(5000)]
    text = rng.choices(pool, k=1500)
    items = [(k, " ".join(text[a : a + n])) for k, (a, n) in enumerate([(0, 16), (55, 20), (63, 30), (64, 40), (100, 300), (1460, 40), (700, 7), (703, 6), (801, 5)])]
    got = {(r.doc_id, r.item_id): r.start for r in D.leaks(table(spark, [(1, " ".join(text))], ["doc_id"]), table(spark, items, ["item_id"])).collect()}
    assert got == {(1, k): a for k, a in enumerate([0, 55, 63, 64, 100, 1460, 700, 703, 801])}


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame([(1, item), (1, "other words of the same id here now"), (2, item), (3, None), (4, ""), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item} y", "a"), (1, "nothing", "b"), (2, None, "c"), (3, "", "d"), (4, "clean", "e"), (None, item, "f")], "doc_id long, text string, __leaking string")
    got = sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()), key=str)
    assert got == [(1, 1), (1, 2)]
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4, None]
    empty = docs.limit(0)
    assert D.leaks(empty, items).count() == 0 and D.decontaminate(empty, items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0 and D.decontaminate(docs, items.limit(0)).count() == 6
