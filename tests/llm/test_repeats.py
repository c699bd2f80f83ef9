"""Substring removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from vellum.llm import repeats, suffix_dedup, textops, window_dedup
from vellum.llm.bwt import Collection


def brute_bytes(docs, k):
    """docs: (id, text) in order."""
    seen, out = set(), {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - k + 1):
            x = raw[s:s + k]
            if x in seen:
                gone[s:s + k] = True
            seen.add(x)
        gone[-1] = False
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        out[i] = (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(docs, k):
    seen, out = {}, {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for s in range(len(w) - k + 1):
            seen.setdefault(tuple(w[s:s + k]), i)
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if seen[tuple(w[s:s + k])] != i:
                gone[s:s + k] = [True] * k
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed, n=60):
    """Copies, near copies, shared passages in varying places, common lines,
    periodic texts, edge cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeéithnß") for _ in range(rng.randint(1, 5)))
    passage = [" ".join(word() for _ in range(rng.randint(4, 30))) for _ in range(4)]
    docs = []
    for i in range(n):
        kind = rng.random()
        base = " ".join(word() for _ in range(rng.randint(0, 60)))
        if kind < 0.25 and docs:
            base = rng.choice(docs)[1] or ""
            if rng.random() < 0.6 and base:
                at = rng.randrange(len(base))
                base = base[:at] + word() + base[at + rng.randint(0, 4):]
        elif kind < 0.6:
            base = base[:rng.randint(0, 40)] + rng.choice(passage) + base[:rng.randint(0, 40)] + rng.choice(passage)
        elif kind < 0.7:
            base = rng.choice(["a", "ab", "xy z ", "- "]) * rng.randint(5, 60)
        docs.append((i, base))
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, docs[3][1]), (n + 4, "é" * 300)]
    return docs


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [8, 0])
def test_bytes_against_brute_force(spark, make_docs, seed, hot):
    docs = corpus(seed)
    got = suffix_dedup.digests(make_docs(docs).repartition(3), length=24, gram=9, hot=hot)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute_bytes(docs, 24)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [8, 0])
def test_words_against_brute_force(spark, make_docs, seed, hot):
    docs = corpus(seed, 120)
    have = {r["doc_id"]: tuple(r)[1:] for r in window_dedup.digests(make_docs(docs).repartition(3), 6, 3, hot=hot).collect()}
    assert have == brute_words(docs, 6)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    have = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(docs).collect()}
    assert have == brute_bytes(rows, 100)
    have = {r["doc_id"]: tuple(r)[1:] for r in window_dedup.digests(docs).collect()}
    assert have == brute_words(rows, 50)


def test_many_contents_under_one_anchor(spark, make_docs):
    """A line too short to be a repeat, in many documents, next to real repeats."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(4))
    tail = " ".join(word() for _ in range(5))
    docs = [(i, " ".join(word() for _ in range(6)) + line + (tail if i % 3 else word()) + " ".join(word() for _ in range(6)))
            for i in range(400)]
    have = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(make_docs(docs), 24, 9).collect()}
    assert have == brute_bytes(docs, 24)
    have = {r["doc_id"]: tuple(r)[1:] for r in window_dedup.digests(make_docs(docs), 4, 2).collect()}
    assert have == brute_words(docs, 4)


def test_apply_keeps_columns_and_other_rows(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(200))
    docs = make_docs([(1, long), (2, None), (3, long), (3, long), (None, "x"), (4, "clean")])
    for out in (suffix_dedup.apply(docs), window_dedup.apply(docs)):
        assert out.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"], r["_uid"]) for r in out.collect()), key=str)
        assert got == sorted([(1, long, "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "x", "x"),
                              (4, "clean", "x")], key=str)


def test_empty_tables(spark, make_docs):
    assert suffix_dedup.digests(make_docs([])).collect() == []
    assert window_dedup.digests(make_docs([])).collect() == []


def test_very_long_text(spark, make_docs):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 107, 400_000).astype(np.uint8).tobytes().decode()
    docs = [(0, text), (1, "q" + text[1000:2000])]
    have = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(make_docs(docs)).collect()}
    assert have[0][1] == 0 and have[1][1:3] == (1000, 1)


def test_parts_of_a_long_text_lose_no_window(monkeypatch):
    monkeypatch.setattr(repeats, "PART", 64)
    unit = repeats.Unit(10, 4, words=False, same_document=True)
    data = np.random.default_rng(1).integers(97, 100, 1000).astype(np.uint8)
    offsets = np.array([0, 3, 500, 505, 1000])
    starts = [s for _, _, start, n in unit.segments(data, offsets) for a, c in zip(start, n) for s in range(a, a + c)]
    assert starts == [s for a, b in zip(offsets[:-1], offsets[1:]) for s in range(a, b - 9)]


@pytest.mark.parametrize("block", [3, 7, 1 << 18])
def test_transform_and_prefixes(block):
    rng = np.random.default_rng(block)
    for _ in range(60):
        strings = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 15)).astype(np.uint8))
                   for _ in range(rng.integers(0, 12))]
        c = Collection(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64), 4, block)
        code = {b: n + 1 for n, b in enumerate(sorted(set(b"".join(strings))))}
        suffixes = sorted((s[o:], i) for i, s in enumerate(strings) for o in range(len(s) + 1))
        before = [code[strings[i][len(strings[i]) - len(x) - 1]] if len(x) < len(strings[i]) else 0 for x, i in suffixes]
        assert [int(x) for b in c.bwt.blocks(99) for x in b] == before
        group, who, at = c.repeats(3)
        sub = [strings[w][o:o + 3] for w, o in zip(who, at)]
        assert sorted(zip(who.tolist(), at.tolist())) == [(i, o) for i, s in enumerate(strings) for o in range(len(s) - 2)]
        assert len(set(zip(group.tolist(), sub))) == len(set(sub)) == len(set(group.tolist()))


def test_anchor_positions():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, w = rng.integers(1, 80), rng.integers(1, 20)
        h = rng.integers(0, 6, n).astype(np.uint64) << np.uint64(40)
        assert list(textops.window_anchors(h, w)) == [i + int(np.argmin(h[i:i + w])) for i in range(n - w + 1)]
