"""Fingerprints against their definition; radius search against all pairs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import simhash


def hashes(spark, terms):
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    return {r["t"]: (r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in
            df.select("t", F.xxhash64("t").alias("a"), F.xxhash64("t", F.lit(1)).alias("b")).collect()}


def fingerprint(text, table):
    terms = set((text or "").lower().split())
    total, votes = 0, [0] * 128
    for t in terms:
        w = min(len(t), 16)
        total += w
        a, b = table[t]
        for i in range(64):
            votes[i] += w * (a >> i & 1)
            votes[64 + i] += w * (b >> i & 1)
    bits = [2 * v > total for v in votes]
    word = lambda part: sum(1 << i for i, x in enumerate(part) if x)
    return f"{word(bits[:64]):016x}{word(bits[64:]):016x}"


def near(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


def edit(docs):
    out = []
    for n, (_, t) in enumerate(docs):
        t, other = t or "", docs[(n + 1) % len(docs)][1] or ""
        half = len(t) // 2
        out.append(t[:len(t) - half] + other[:half])
    return out


def corpus(seed, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdÉ😀xyZ") for _ in range(rng.randint(1, 20)))
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            w = (rng.choice(docs)[1] or "x").split()
            if rng.random() < 0.6 and w:
                w[rng.randrange(len(w))] = word()
            docs.append((i * 5, " ".join(w)))
        else:
            docs.append((i * 5, " ".join(word() for _ in range(rng.choice([1, 2, 10, 60])))))
    return [*docs, (n * 5, None), (n * 5 + 1, ""), (n * 5 + 2, " \n"), (n * 5 + 20, docs[0][1])]


@pytest.mark.parametrize("seed", range(2))
def test_against_definition(spark, make_docs, seed):
    docs = corpus(seed)
    edited = edit(docs)
    table = hashes(spark, {w for t in [*edited, *(t or "" for _, t in docs)] for w in t.lower().split()})
    prints = [fingerprint(t, table) for _, t in docs]
    got = {r["doc_id"]: r for r in simhash.compare(make_docs(docs).repartition(3)).collect()}
    assert len(got) == len(docs)
    for n, (i, t) in enumerate(docs):
        r = got[i]
        assert r["n_chars"] == len(t or "")
        assert r["edited_sha256"] == hashlib.sha256(edited[n].encode()).hexdigest()
        assert r["fingerprint"] == prints[n]
        assert r["edited_fingerprint"] == fingerprint(edited[n], table)
        assert r["near_edited"] == near(prints[n], r["edited_fingerprint"])
        assert r["near_next"] == near(prints[n], prints[(n + 1) % len(docs)])
        want = sum((int(prints[n], 16) ^ int(p, 16)).bit_count() <= 3 for p in prints) - 1
        assert r["within_radius"] == (want if i % 20 == 0 else None)


@pytest.mark.parametrize("radius,blocks", [(0, 1), (1, 4), (3, 6), (4, 7)])
def test_radius_search_is_exact(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = []
    for _ in range(300):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(128)
        prints.append(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p & (1 << 64) - 1), signed(p >> 64)) for p in prints], "f1 long, f2 long")
    got = simhash.within(df, df, radius, blocks).collect()
    pairs = {(r["q1"], r["q2"], r["f1"], r["f2"]) for r in got}
    assert len(pairs) == len(got)
    unique = set(prints)
    want = {(signed(a & (1 << 64) - 1), signed(a >> 64), signed(b & (1 << 64) - 1), signed(b >> 64))
            for a in unique for b in unique if (a ^ b).bit_count() <= radius}
    assert pairs == want
    assert sum(r["n"] for r in got if r["distance"] == 0) == len(prints)


def test_no_python_in_the_plan(spark, make_docs):
    plan = simhash.compare(make_docs(corpus(1)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_edge_tables(spark, make_docs):
    assert simhash.compare(make_docs([])).collect() == []
    one = simhash.compare(make_docs([(20, "abcd")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["within_radius"] == 0
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    rows = simhash.compare(make_docs([(1, "a b"), (1, "a b"), (None, "x y z")])).collect()
    assert len(rows) == 3 and len({r["fingerprint"] for r in rows}) == 2


def test_edits_stay_nearer_than_the_next_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in simhash.compare(docs).collect() if r["n_chars"] > 100]
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.9 * len(rows)


@pytest.mark.parametrize("radius,blocks", [(5, 4), (23, 8), (40, 16)])
def test_wide_radius_search_is_exact(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = []
    for _ in range(200):
        x = rng.choice(base)
        for b in rng.sample(range(128), rng.randint(0, radius + 3)):
            x ^= 1 << b
        prints.append(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    two = lambda p: (signed(p & (1 << 64) - 1), signed(p >> 64))
    df = spark.createDataFrame([two(p) for p in prints], "f1 long, f2 long")
    asked = df.limit(20) if radius == 40 else df
    got = [(r["q1"], r["q2"], r["f1"], r["f2"], r["distance"]) for r in simhash.within(df, asked, radius, blocks).collect()]
    assert len(set(got)) == len(got)
    assert set(got) == {(r["f1"], r["f2"], *two(p), d) for r in asked.collect() for p in prints
                        if (d := ((r["f1"] % (1 << 64) | r["f2"] % (1 << 64) << 64) ^ p).bit_count()) <= radius}


def planted(seed=5, n=40, words=200):
    """Texts of distinct words, each with a copy that has a share of them replaced."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(6, 9)))
    docs = []
    for i in range(n):
        text = [word() for _ in range(words)]
        for c, replaced in enumerate((0, 1, 10, 20)):  # 0, 0.5, 5 and 10 % of the words
            copy = list(text)
            for at in rng.sample(range(words), replaced):
                copy[at] = word()
            docs.append((20 * i if c == 0 else 20 * i + c, " ".join(copy)))
    return docs


def test_near_copies_are_found_with_their_classes(spark, make_docs):
    docs = make_docs(planted())
    classes = {r["doc_id"]: simhash_hex(r) for r in simhash.membership(docs).collect()}
    smallest = {}
    for i, c in sorted(classes.items(), reverse=True):
        smallest[c] = i
    rows = simhash.near(docs).collect()
    pairs = [(r["doc_id"], r["fingerprint"], *e) for r in rows for e in r["near"]]
    found = {(i, c) for i, _, _, c, _, _ in pairs}
    recall = [sum((20 * i, classes[20 * i + c]) in found for i in range(40)) / 40 for c in (1, 2, 3)]
    assert recall[0] == 1 and recall[1] >= 0.95 and recall[2] >= 0.8
    assert all(near(own, other) == 1 - d / 128 and smallest[other] == i for _, own, i, other, d, _ in pairs)
    counts = {r["doc_id"]: r for r in simhash.compare(docs).collect()}
    for i in range(40):
        own = [x for x in pairs if x[0] == 20 * i]
        assert counts[20 * i]["fingerprint"] == classes[20 * i]
        assert counts[20 * i]["near_classes"] == len(own) - 1
        assert counts[20 * i]["within_reach"] == sum(x[5] for x in own) - 1
        assert counts[20 * i + 1]["within_reach"] is None


def test_a_group_of_near_copies_makes_lists_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 16)
    rng = random.Random(4)
    base = rng.getrandbits(128)
    prints = {base}
    while len(prints) < 300:
        x = base
        for b in rng.sample(range(128), rng.randint(1, 9)):
            x ^= 1 << b
        prints.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    two = lambda p: (signed(p & (1 << 64) - 1), signed(p >> 64))
    df = spark.createDataFrame([(*two(p), i) for i, p in enumerate(sorted(prints))], "f1 long, f2 long, id long")
    asked = df.filter("id % 20 = 0")
    rows = simhash.lists_within(df, asked, 23, 8).collect()
    pairs = [(r["q1"], r["q2"], e["f1"], e["f2"]) for r in rows for e in r["near"]]
    assert len(pairs) == len(set(pairs)) == sum(
        (a ^ b).bit_count() <= 23 for i, a in enumerate(sorted(prints)) if i % 20 == 0 for b in prints)
    assert len(rows) < len(pairs) / 2


def test_radius_from_similarity_and_recall():
    import math
    rng = random.Random(1)
    assert simhash.reach(0.92, 0.95) == simhash.REACH == 23
    assert simhash.reach(1.0, 0.99) == 0
    p = math.acos(0.92) / math.pi
    far = [sum(rng.random() < p for _ in range(128)) for _ in range(4000)]
    assert sum(d <= simhash.REACH for d in far) / 4000 >= 0.94


def test_blocks_widen_with_the_table():
    sizes = [simhash.choose_blocks(n, 23) for n in (10, 10 ** 5, 10 ** 7, 10 ** 10)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1]
    assert simhash.choose_blocks(1000, 3) == simhash.BLOCKS


def simhash_hex(r):
    return f"{r['f1'] % (1 << 64):016x}{r['f2'] % (1 << 64):016x}"
