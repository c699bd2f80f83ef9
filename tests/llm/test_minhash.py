"""Near-duplicate classes against all-pairs brute force."""

import random

import numpy as np
import pytest

from vellum.llm import minhash, textops
from vellum.llm.graph import components


def shingle_set(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = lower.encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, num, den):
    """Positions in sorted order -> (n, smallest reachable position)."""
    sets = [shingle_set(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÄxyZ") for _ in range(rng.randint(1, 4)))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts[-40:]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    at = rng.randrange(len(w))
                    w[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            t = (" " if rng.random() < 0.5 else "\n").join(w)
            texts.append(t.upper() if rng.random() < 0.1 and t.isascii() else t)
        else:
            texts.append(" ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 7, 12, 40, 150]))))
    return list(enumerate([*texts, None, "", "one", "ONE", "one two", "\t "]))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_against_brute_force(spark, make_docs, seed, k, num):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in minhash.near_duplicates(make_docs(docs).repartition(3), k, num).collect()}
    want = {i: (n, c, c == i) for i, (n, c) in enumerate(brute(docs, k, num, 100))}
    assert got == want


def test_blocks_of_a_cluster(spark, make_docs, monkeypatch):
    """A cluster over several blocks (driver-side sizes) gives the same answer."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    docs = corpus(11, 220)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make_docs(docs), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute(docs, 3, 85, 100))}


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    want = [rows[c][0] for _, c in brute(rows, 3, 85, 100)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: c for (i, _), c in zip(rows, want)}


def test_repeated_and_null_ids(spark, make_docs):
    docs = make_docs([(5, "a b c d e f"), (5, "a b c d e f"), (None, "q w e r t y"), (7, "a b c d e f"), (9, None)])
    got = sorted(map(str, (tuple(r) for r in minhash.near_duplicates(docs).collect())))
    assert got == sorted(["(5, 2, 5, True)", "(5, 2, 5, True)", "(None, 2, None, True)", "(7, 2, 5, False)",
                          "(9, 0, 9, True)"])
    kept = minhash.apply(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "9", "None"]


def test_empty_table(spark, make_docs):
    assert minhash.near_duplicates(make_docs([])).collect() == []
    assert minhash.apply(make_docs([])).collect() == []


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    sets = [pool[:4000], pool[400:4400], pool[2000:6000], rng.integers(0, 1 << 63, 4000).astype(np.uint64)]
    doc = np.repeat(np.arange(4), 4000)
    regs = minhash.registers(doc, np.concatenate(sets), 4)
    guess, _ = minhash.estimate(regs, np.full(4, 4000))
    for (i, j), want in {(0, 1): 3600 / 4400, (0, 2): 2000 / 6000, (0, 3): 0.0}.items():
        assert abs(guess[i, j] - want) < 0.12
    assert np.allclose(np.diag(guess), 1)


def test_registers_hold_zeros_and_mantissa():
    h = textops.mix(np.arange(1000, dtype=np.uint64))
    regs = minhash.registers(np.zeros(1000, np.int64), h, 1)[0]
    bucket = ((h >> np.uint64(32)) * np.uint64(240)) >> np.uint64(32)
    value = np.maximum(textops.mix(h, 7) >> np.uint64(1), np.uint64(1))
    for b in range(240):
        mine = [int(v) for v, x in zip(value, bucket) if x == b]
        if not mine:
            assert regs[b] == minhash.EMPTY
            continue
        bits = f"{min(mine) << 1:064b}"
        zeros = min(len(bits) - len(bits.lstrip("0")), 30)
        assert regs[b] == (zeros << 11) | int(bits[zeros + 1:zeros + 12], 2)


def test_components(spark):
    rng = random.Random(1)
    nodes = 400
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_rows_sharing_an_id_are_kept_as_their_id_is(spark, make_docs):
    text = "one two three four five six seven"
    got = minhash.near_duplicates(make_docs([(5, text), (5, text), (7, text), (9, "other words only here")]), k=3, num=85, den=100)
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()) == [
        (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]
