"""Repetition rules against brute force over all window lengths."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import quality_rules, textops
from vellum.llm.queries import REGISTRY


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text, least=8):
    w = words_of(text)
    n = len(w)

    def repeated(k):
        seen = Counter(tuple(w[i:i + k]) for i in range(n - k + 1))
        return [i for i in range(n - k + 1) if seen[tuple(w[i:i + k])] > 1]

    def cover(k):
        return len({j for i in repeated(k) for j in range(i, i + k)})
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": cover(3), "n_covered": cover(least),
            "longest_repeat": max((k for k in range(1, n) if repeated(k)), default=0)}


def verdict(m):
    base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    return base, not base and m["n_covered"] <= 0.5 * m["n_words"] and m["longest_repeat"] <= 100


def measure(texts, limit):
    data, offsets = textops.buffers(pa.array([None if t is None else t.encode() for t in texts], pa.large_binary()))
    out = []
    for i, j in textops.chunks(offsets, limit):
        m = quality_rules.measures(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        out += [{c: int(m[c][k]) for c in m} for k in range(j - i)]
    return out


words = st.lists(st.sampled_from(["a", "b", "c#", "é|", "\n", "日"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), words.map(" ".join)), max_size=6), st.sampled_from([1, 50, 1 << 17]))
def test_measures_against_brute_force(texts, limit):
    assert measure(texts, limit) == [brute(t) for t in texts]


def test_long_repeats_and_many_words():
    rng = random.Random(4)
    part = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(150))
    other = " ".join(f"w{x}" for x in rng.sample(range(10 ** 6), 400))
    texts = [part + " " + other + " " + part, "a " * 300, part, "\n".join([part] * 2), other]
    got = measure(texts, 1 << 17)
    assert got == [brute(t) for t in texts]
    assert [m["longest_repeat"] for m in got] == [150, 299, 0, 150, 0]


def test_whole_long_text():
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000))
    got = measure([text + " " + text[:200_000]], 1 << 17)[0]
    assert got["longest_repeat"] >= len(text[:200_000].split()) - 1


def test_queries_over_rows(spark, make_docs):
    rng = random.Random(5)
    clean = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(120)) for _ in range(20)]
    quote = " ".join(f"q{i}" for i in range(101))
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "few words"), (None, clean[0]), (3, clean[1]), (3, clean[1]),
             (60, " ".join(clean[:5] + [quote, clean[5], quote])),  # one repeat of 101 words
             (61, " ".join(clean[:5] + [quote[:-5], clean[5], quote[:-5]])),  # of 100
             (62, "spam offer now " * 40), (63, "\n".join([clean[0][:300], "x", clean[0][:300]]))]
    docs = make_docs(rows)
    got = quality_rules.scores(docs)
    want = Counter()
    for i, t in rows:
        m = brute(t)
        base, kept = verdict(m)
        want[(i, *m.values(), base, kept)] += 1
    names = ["doc_id", *quality_rules.COLUMNS, "base_failed", "kept"]
    assert got.columns == names
    assert Counter(map(tuple, got.collect())) == want
    left = quality_rules.keep(docs)
    assert left.columns == docs.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert not {50, 51, 52, 53, 60, 62} & set(ids) and ids[61] == 1 and ids[3] == 3 and ids[None] == 1
    assert quality_rules.scores(make_docs([])).collect() == []
    assert quality_rules.repeats(make_docs([])).collect() == []


def maximal(w, least):
    """Substrings with two occurrences or more that no word on either side extends."""
    out, n = set(), len(w)
    for k in range(least, n):
        places = {}
        for i in range(n - k + 1):
            places.setdefault(tuple(w[i:i + k]), []).append(i)
        for at in places.values():
            if len(at) > 1:
                left = {w[i - 1] if i else None for i in at}
                right = {w[i + k] if i + k < n else None for i in at}
                if (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                    out.add((at[0], k, len(at)))
    return out


def test_maximal_repeats(spark, make_docs):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for i in range(60)}
    got = Counter((r["doc_id"], r["start"], r["length"], r["times"])
                  for r in quality_rules.repeats(make_docs(list(texts.items())), least=3).collect())
    want = Counter((i, *x) for i, t in texts.items() for x in maximal(t.split(), 3))
    assert got == want


def test_spans_equal_windows():
    """The union over the deepest intervals is the union over all windows."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        w = rng.integers(0, 4, 80)
        ends = np.full(80, 80)
        found = quality_rules.Suffixes.of(w.astype(np.uint64), ends, np.zeros(80, np.int64))
        got = quality_rules.covered(np.where(found.deepest >= 5, found.deepest, 0), ends)
        seen = Counter(tuple(w[i:i + 5]) for i in range(76))
        want = np.zeros(80, bool)
        for i in range(76):
            want[i:i + 5] |= seen[tuple(w[i:i + 5])] > 1
        assert (got == want).all()


def test_query_against_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    q = REGISTRY["op13_quality_rules"]
    want = con.sql(q.sql)
    got = q.run(spark, sf)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
