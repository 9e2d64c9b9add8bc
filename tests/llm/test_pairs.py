from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import leaks, mixing, nearest, neardup


def brute(rows, threshold=0.7, least=200):
    grams = {}
    for i, t in rows:
        if i is not None and t is not None and len(t) >= least:
            n = neardup.normal(t)
            grams[i] = {n[k : k + 5] for k in range(len(n) - 4)}
    out = set()
    for a in grams:
        for b in grams:
            if a < b and grams[a] | grams[b] and len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b]):
                out.add((a, b))
    return out


def texts(n=60, seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    rows, k = [], 0
    for _ in range(n):
        base = [rnd.choice(words) for _ in range(60)]
        for copy in range(rnd.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(copy * rnd.randint(1, 5)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((k, " ".join(own)))
            k += 1
    return rows


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, content string").withColumn("a", F.lit(1)).withColumn("node", F.lit("clash"))
    return {(r["a"], r["b"]) for r in neardup.near_pairs(df, "id", "content").collect()}


def test_near_pairs_equal_brute_force(spark):
    rows = texts() + [(1000, None), (None, "x" * 300), (1001, ""), (1002, " " * 300), (1003, "z" * 250), (1004, "z" * 300)]
    rows += [(2000 + i, rows[0][1].upper() + "  ") for i in range(6)] + [rows[5], rows[5]]
    assert pairs(spark, rows) == brute(rows)
    assert pairs(spark, []) == set()


def test_a_hot_family_is_linked_whole(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rnd.randrange(80)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    assert pairs(spark, rows) == brute(rows)
    df = spark.createDataFrame([*rows, *[(100 + i, t) for i, t in texts(5, seed=9)]], "id bigint, content string")
    got = {r["id"]: r["group_id"] for r in neardup.groups(df, "id", "content").collect()}
    assert {got[i] for i in range(60)} == {0} and got[100] == 100


def test_large_buckets_and_hot_keys_lose_no_pair(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
    rows = texts(10)
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randint(1, 9)):
            own[rnd.randrange(80)] = f"edit{rnd.randrange(10**6)}"
        rows.append((1000 + i, " ".join(own)))
    want = brute(rows)
    for name, value in (("STAR", 4), ("CELL", 30), ("SAMPLE", 10**6), ("PART_RECORDS", 500)):
        monkeypatch.setattr(neardup, name, value)
    df = spark.createDataFrame(rows, "id bigint, content string")
    assert len(neardup.hot_keys(df, len(rows), "id", "content", 200)) > 0
    assert pairs(spark, rows) == want


def test_leaves_of_a_large_bucket_meet_through_its_hub():
    r = np.zeros(6, neardup.RECORD)
    r["node"], r["s1"] = [5, 1, 2, 3, 4, 1], [2**40 - 1, 0, 1, 3, 2**64 - 1, 0]
    r["key"] = 7
    small = set(zip(*[x.tolist() for x in neardup.bucket_links(r)[:2]], strict=True))
    a, b, star = neardup.bucket_links(r, 3)
    large = set(zip(a.tolist(), b.tolist(), star.tolist(), strict=True))
    assert small == {(1, 2), (1, 3), (2, 3), (4, 5)} and large == {(1, 2, True), (1, 3, True), (4, 5, False)}
    assert [len(x) for x in neardup.bucket_links(r[:0])] == [0, 0, 0]


def test_a_long_chain_is_one_group(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(800)]
    rows = [(i, " ".join(words[7 * i : 7 * i + 60])) for i in range(90)]
    assert brute(rows) == {(i, i + 1) for i in range(89)}
    df = spark.createDataFrame([*rows, (500, "z" * 300)], "id bigint, content string")
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in neardup.groups(df, "id", "content").collect()}
    assert got == {**{i: (0, 2 - (i in (0, 89))) for i in range(90)}, 500: (500, 0)}


def found_at(similarity, n=1500):
    """Share of pairs of texts at a similarity that meet in a band and pass the sketch."""
    rnd = np.random.default_rng(int(1000 * similarity))
    texts = []
    for _ in range(n):
        size = int(rnd.integers(220, 1200))
        grams = size - 4
        cut = int(grams * (1 - similarity) / (1 + similarity)) - 4
        at = int(rnd.integers(4, size - cut - 4))
        own = [chr(0x100 + k) for k in rnd.integers(0, 500, size)]
        other = own[:at] + [chr(0x400 + k) for k in rnd.integers(0, 500, cut)] + own[at + cut :]
        texts += ["".join(own), "".join(other)]
    keys, sketch = neardup.bands_and_sketch(neardup.signatures(texts))
    meet = (keys[::2] == keys[1::2]).any(1)
    differ = np.bitwise_count(sketch[::2].view(np.uint64) ^ sketch[1::2].view(np.uint64)).sum(1)
    return float((meet & (differ <= 128 - neardup.AGREE)).mean())


def test_pairs_at_the_threshold_are_found():
    assert found_at(0.70) >= 0.998 and found_at(0.72) >= 0.999 and found_at(0.75) >= 0.999


def test_densified_bins_agree_as_often_as_sets_do():
    rows = [t for _, t in texts(40)]
    sig = neardup.signatures([neardup.normal(t) for t in rows])
    for a, b in ((0, 1), (2, 3), (5, 6)):
        s, t = ({x[k : k + 5] for k in range(len(x) - 4)} for x in map(neardup.normal, (rows[a], rows[b])))
        assert abs((sig[a] == sig[b]).mean() - len(s & t) / len(s | t)) < 0.2
    short = neardup.signatures(["abcdef", "abcdef"])
    assert (short[0] == short[1]).all() and (short != neardup._FULL).all()


def test_nearest_reaches_brute_force(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 64))
    x = (centres[rnd.integers(0, 40, 3000)] + 0.4 * rnd.normal(size=(3000, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 64), (5002, [1.0] * 32), (5003, [float("nan")] * 64), (7, x[7].tolist()), (5004, (3 * x[7]).tolist()), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").withColumn("cell", F.lit(1))
    asked = spark.createDataFrame([(i,) for i in [*range(0, 3000, 20), 7, 5000, 5001, 99999, None]], "id bigint")
    got = {}
    for r in nearest.nearest(df, asked, "id", "v", visit=600).collect():
        got.setdefault(r["id"], []).append((-r["cosine"], r["neighbour"]))
    full = np.vstack([x, 3 * x[7]]).astype(np.float64)
    ids = np.array([*range(3000), 5004])
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    hit = total = 0
    for i, found in got.items():
        assert len(found) == 10 and i not in [n for _, n in found]
        c = full @ full[i]
        c[i] = -9
        best = set(ids[np.argsort(-c, kind="stable")[:10]].tolist())
        hit += len(best & {n for _, n in found})
        total += 10
    assert set(got) == {*range(0, 3000, 20), 7} and hit / total >= 0.97
    assert min(got[7])[1] == 5004
    assert nearest.nearest(df.limit(0), asked, "id", "v").count() == 0


def test_a_hot_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 50)
    monkeypatch.setattr(nearest, "QUERIES", 5)
    rows = [(i, [1.0, 0.001 * i, 0.0, 0.5]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    asked = spark.createDataFrame([(i,) for i in range(0, 300, 20)], "id bigint")
    got = nearest.nearest(df, asked, "id", "v", dim=4, k=2, visit=300).collect()
    assert len(got) == 30 and all(abs(r["id"] - r["neighbour"]) <= 2 for r in got)


def brute_leaks(docs, items, n=13):
    def runs(t):
        w = leaks.words(t)
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    held = {i: runs(t) for i, t in items if t is not None}
    return {(d, i) for d, t in docs if t is not None for i, r in held.items() if r & runs(t)}


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60)))) for i in range(30)] + [(90, None), (91, ""), (0, None)][:2]
    docs = []
    for i in range(120):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 300))]
        if i % 3 == 0:
            source = leaks.words(rnd.choice(items[:30])[1])
            a = rnd.randrange(max(1, len(source) - 12))
            piece = source[a : a + rnd.randint(8, 40)]
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [w.upper() for w in piece]
        docs.append((i, "\n# ".join(" ".join(body[k : k + 7]) for k in range(0, len(body), 7))))
    docs += [(200, None), (201, ""), docs[0], (202, " ".join(vocabulary) * 300)]
    d = spark.createDataFrame(docs, "doc bigint, t string").withColumn("item", F.lit("clash"))
    e = spark.createDataFrame(items, "item bigint, t string")
    got = leaks.leaks(d, "doc", "t", e, "item", "t")
    assert {(r["doc"], r["item"]) for r in got.collect()} == brute_leaks(docs, items)
    assert leaks.leaks(d, "doc", "t", e.limit(0), "item", "t").count() == 0


def test_tiles_cover_a_reordered_passage():
    item = [f"w{i}" for i in range(40)]
    block = leaks.Items([(1, " ".join(item))], 8)
    doc, near = block.candidates(" ".join([*item[20:40], "x", *item[0:20]]))
    assert near == {1} and sorted(k for *_, k in block.tiles(doc, 1)) == [20, 20]
    twice, _ = block.candidates(" ".join([*item, *item]))
    assert [k for *_, k in block.tiles(twice, 1)] == [40]  # an item's words are marked once
    assert leaks.words("Ａb_c １２é\u00a0ß") == ["ab", "c", "12é", "ß"]


def test_mixing(spark):
    rows = [(i, f"word{i} " * (i % 7 + 1), "big") for i in range(400)] + [(1000 + i, "tiny text", "small") for i in range(3)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 2), ("none", 0.1, 3), ("big", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, targets)
    got = {r["source"]: r for r in mixing.shares(mix, targets).collect()}
    assert got["none"]["tokens"] == 0 and got["small"]["n_docs"] == 3 and got["small"]["most_uses"] == 2
    assert got["big"]["most_uses"] <= 2 and abs(sum(r["share"] for r in got.values()) - 1) < 1e-9
    assert mix.groupBy("source", "doc", "pass").count().where("count > 1").count() == 0 and mix.where("slot is null").count() == 0
    assert mixing.mixed(docs.limit(0), targets).count() == 0
    even = spark.createDataFrame([("big", 1.0, 1)], targets.schema)
    assert mixing.mixed(docs, even, total=50).agg(F.sum("tokens")).first()[0] in range(35, 66)


def test_plan_fills_caps_and_shares_the_rest():
    plans = {p.source: p.wanted for p in mixing.plan([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 4)], {"a": 1000, "b": 50, "c": 1000}, 900)}
    assert plans["b"] == 50 and abs(plans["a"] / plans["c"] - 2.5) < 0.02 and sum(plans.values()) in range(898, 901)


def test_largest_exact_total():
    targets, has = [("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, 1)], {"a": 1000, "b": 60}
    n = mixing.largest_exact_total(targets, has)
    plans = {p.source: p.wanted for p in mixing.plan(targets, has, n)}
    assert n == 360 and plans == {"a": 240, "b": 120, "c": 0} and mixing.largest_exact_total(targets, {}) == 0


def test_schedule_follows_weights_everywhere(spark):
    plans = mixing.plan([("a", 0.6, 1), ("b", 0.3, 1), ("c", 0.1, 1)], {"a": 10**7, "b": 10**7, "c": 10**7}, 4_096_000)
    rows = sorted((r["slot"], r["source"], r["rank"]) for r in mixing.schedule(spark, plans).collect())
    for at in (100, 333, 777):
        share = sum(s == "a" for _, s, _ in rows[:at]) / at
        assert abs(share - 0.6) < 0.03
    seen: dict[str, int] = {}
    for _, s, rank in rows:
        assert rank == seen.get(s, 0)
        seen[s] = rank + 1


def test_long_texts_are_counted_in_pieces():
    assert mixing.count_tokens("") == 0
    assert mixing.count_tokens("word " * 10_000) > 9_000
    assert mixing.count_tokens("a" * 100_000) > 0
