"""Mixing, packing, sharding and top-k against brute force and planted cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import mixing, packing, sharding, topk

EDGE = [(0, None), (1, ""), (2, "a"), (3, "a b  c\nd"), (4, "word " * 5000), (5, "é<|endoftext|>ü x"), (6, "a b  c\nd"),
        (6, "a b  c\nd"), (None, "null id"), (8, "   \t\n")]


def waterfill(sizes, ratio=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = min(ratio * sum(sizes.values()), cap * sum(sizes.values()))
    open_, target = set(names), {}
    while open_:
        left = total - sum(target.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def test_targets_against_iteration(spark, make_docs):
    rng = random.Random(3)
    for trial in range(4):
        names = [None, "a", "b", "ä", "z", "A"][: 2 + trial]
        sizes = {n: rng.choice([0, 5, 100, 3000]) for n in names}
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "_source string, size long")
        got = {r["_source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = waterfill(sizes)
        assert got.keys() == want.keys()
        for k in got:
            assert got[k] == pytest.approx(want[k], abs=1e-6)


def test_mix_takes_near_target_and_repeats(spark, make_docs):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["big"] * 6 + ["s1", "s2", None]))
            for i in range(3000)]
    docs = make_docs(rows)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        s = r["_row"]["source"]
        assert 0 <= r["_copies"] <= 2
        taken[s] += r["_copies"] * r["_size"]
        size[s] += r["_size"]
        target[s] = r["_target"]
        assert r["_target"] <= 2 * r["_source_size"] + 1e-9
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.1)
    again = {(r["_row"]["doc_id"], r["_copies"]) for r in mixing.plan(docs.repartition(7)).collect()}
    assert again == {(r["_row"]["doc_id"], r["_copies"]) for r in got}
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["_copies"] for r in got)


def test_mix_edge_and_empty(spark, make_docs):
    assert len(mixing.plan(make_docs(EDGE)).collect()) == len(EDGE)
    assert mixing.emit(make_docs([])).collect() == []
    got = mixing.plan(make_docs([(1, None, "a"), (2, "", None)])).collect()
    assert {r["_target"] for r in got} == {0.0}


def reference_ids(text):
    from tokenizers import Tokenizer
    global _tok
    if "_tok" not in globals():
        _tok = Tokenizer.from_file(packing.default_tokenizer())
    return [*_tok.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200) | st.lists(st.sampled_from(["don't", " ", "\n\n", "é", "<|endoftext|>", "12", "  x", "!?", "　"]), max_size=20).map("".join))
def test_encoder_equals_tokenizers(text):
    assert packing.encoder(packing.default_tokenizer()).ids(text).tolist() == reference_ids(text)[:-1]


def check_packing(rows, docs, capacity=1024):
    by_doc = defaultdict(list)
    fill = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        assert 1 <= r["length"] <= capacity
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    for i, text in docs:
        ids = np.array(reference_ids(text), "<u4")
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        at = 0
        for n, r in enumerate(got):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
            assert n == 0 or r["length"] == capacity
        assert at == len(ids)
        assert len(ids) > capacity or len(got) == 1
    return len(fill)


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs).collect()
    n = check_packing(rows, [tuple(r) for r in docs.collect()])
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_packing_edge_cases(spark, make_docs):
    unique = [r for r in EDGE if r[0] not in (6,)]
    check_packing(packing.pack(make_docs(unique)).collect(), unique)
    assert len(packing.pack(make_docs(EDGE), keep_ids=True).collect()) >= len(EDGE)
    assert packing.pack(make_docs([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_places_every_piece_once(hist):
    table, n = packing.plan(hist, 64)
    seen, fill = Counter(), defaultdict(list)
    for length, lo, times, seq, off in table.tolist():
        for k in range(times):
            seen[length, lo + k] += 1
            fill[seq + k].append((off, length))
    assert set(seen.values()) <= {1}
    assert Counter(length for length, _ in seen) == Counter(hist)
    assert len(fill) == n
    for spans in fill.values():
        at = 0
        for o, length in sorted(spans):
            assert o == at
            at += length
        assert at <= 64


def test_plan_uses_exact_complements():
    assert packing.plan({60: 5, 4: 5}, 64)[1] == 5
    assert packing.plan({50: 3, 9: 3, 5: 3}, 64)[1] == 3
    assert packing.plan({40: 2, 12: 2, 7: 2, 5: 2}, 64)[1] == 2


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 10), st.integers(1, 40))
def test_permutation_and_inverse(n, seed, shards):
    rows = np.arange(n)
    p = sharding.permute(rows, n, seed)
    assert sorted(p.tolist()) == rows.tolist()
    shard, slot = sharding.locate(rows, n, shards, seed)
    assert (sharding.row_at(shard, slot, n, shards, seed) == rows).all()


def test_shards_are_even_and_gapless(spark, make_docs):
    docs = make_docs([*EDGE, *[(i, f"t{i % 50}") for i in range(100, 733)]])
    rows = sharding.assign(docs, 16).collect()
    assert len(rows) == docs.count()
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    again = sharding.assign(docs.repartition(5), 16).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    for r in rows:
        if r["doc_id"] == 5:
            assert r["size"] == len(EDGE[5][1].encode()) + 1 and r["text_crc32"] == zlib.crc32(EDGE[5][1].encode())
    assert sharding.assign(make_docs([]), 16).collect() == []


def brute_topk(vectors, every, k):
    good = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(good):
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], good[i])), i) for i in good if i != q)
            out += [(q, n + 1, i, -v) for n, (v, i) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("shape", ["dense", "sparse", "ties", "negative", "few"])
def test_topk_against_brute_force(spark, shape):
    rng = np.random.default_rng(len(shape))
    n = 4 if shape == "few" else 300
    x = rng.normal(size=(n, 12))
    if shape == "sparse":
        x[rng.random(x.shape) < 0.8] = 0
    if shape == "ties":
        x = np.round(x * 2) / 4
        x[50:150] = x[0]
    if shape == "negative":
        x = -np.abs(x)
        x[::10] *= -1
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(1000, None), (1001, []), (1010, [float("nan")] * 12), (1020, [None] + [0.1] * 11),
             (1030, [float("inf")] * 12), (1040, [0.0] * 12), (None, [0.5] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS shard")
    data = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    q = topk.quantise(df)
    got = topk.maxscore(q, q.filter("id % 10 = 0"), k=5, shard_rows=90, query_block=7)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "id", "score").collect()) == brute_topk(data, 10, 5)


def test_topk_empty(spark):
    q = topk.quantise(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.maxscore(q, q).collect() == []


def test_topk_of_repeated_ids(spark):
    """Rows that share an id are vectors of their own, as candidates and as queries."""
    rng = random.Random(8)
    data = [(rng.choice([0, 10, 10, 10, 1, 2, 3, 20]), [rng.uniform(-1, 1) for _ in range(4)]) for _ in range(60)]
    data += [data[0], data[0]]
    q = topk.quantise(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    asked = q.filter("name % 10 = 0")
    got = topk.named(topk.maxscore(q, asked, k=5, shard_rows=20, query_block=3), q, asked).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data]
    want = Counter()
    for n, (i, v) in enumerate(whole):
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(whole) if m != n)[:5]
            want.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    assert Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == want
