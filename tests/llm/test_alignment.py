"""Token alignment against a plain two-list intersection, one document at a time."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellum.llm import alignment
from vellum.llm.packing import default_tokenizer

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    vocab = a.get_vocab()
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    bytes_a = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t != "<|endoftext|>"}
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
    return a, bytes_a, b, piece


def brute(rows, tokenizers):
    a, bytes_a, b, piece = tokenizers
    made = []
    for ident, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(bytes_a[i] for i in ids_a) != raw or b"".join(map(piece, ids_b)) != raw:
            ids_a, ids_b = [], []
        ends_a = np.cumsum([len(bytes_a[i]) for i in ids_a]).tolist()
        ends_b = np.cumsum([len(piece(i)) for i in ids_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        links = [(ids_a[ends_a.index(c)], ids_b[ends_b.index(c)]) for c in cuts] if len(cuts) < 3000 else \
            list(zip(*[[i for i, e in zip(ids, ends) if e in set(cuts)] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]))
        groups, low = [], 0
        for c in cuts if len(cuts) < 3000 else []:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if low < e <= c)
                                   for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            low = c
        made.append((ident, ids_a, ids_b, cuts, links, ";".join(groups)))
    n = Counter(x for m in made for x in m[4])
    most = defaultdict(int)
    for (_, y), k in n.items():
        most[y] = max(most[y], k)
    return [(i, len(x), len(y), len(cuts), len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for i, x, y, cuts, links, g in made]


EDGE = [(0, None), (1, ""), (2, "a"), (3, " \n\t x"), (4, "<|endoftext|> and </s> <unk> text"), (5, "日本語 ünï \U0001F600 ￼"),
        (6, "same words again"), (6, "same words again"), (None, "no id"), (8, "\x00\x01 control"), (9, "ﬁ ligature　wide"),
        (10, "▁ the mark itself"), (11, "  two  blanks  "), (12, "é combining")]


@pytest.mark.parametrize("top", [1 << 20, 3])
def test_against_brute_force(spark, make_docs, tokenizers, top):
    rng = random.Random(4)
    parts = ["the ", "ing", "tion", "é", "ß", " of", "\n", "12", "日", "x", "<|endoftext|>", "▁", "un", "Th"]
    rows = EDGE + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    got = alignment.align(make_docs(rows), top=top)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, tokenizers))


def test_lanes_do_not_matter(tokenizers):
    both = alignment.pair(default_tokenizer(), alignment.default_pieces())
    rng = random.Random(9)
    texts = ["".join(rng.choice(["the ", "of", "ing", "日", "x y", "\n"]) for _ in range(n)) for n in (0, 1, 2000, 5, 700)]
    ids = both.encode(texts)
    want = alignment.merge(*ids, both.side_a, both.side_b, lane=1 << 30)
    for lane in (1, 3, 64, 4096):
        for x, y in zip(alignment.merge(*ids, both.side_a, both.side_b, lane=lane), want, strict=True):
            assert np.array_equal(x, y)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=60), st.lists(st.integers(1, 6), min_size=1, max_size=60))
def test_lockstep_is_the_intersection(a, b):
    x, y = np.cumsum(a), np.cumsum(b)
    i, j = alignment.lockstep(x, y, np.array([0]), np.array([0]), np.array([len(x)]), np.array([len(y)]))
    _, wi, wj = np.intersect1d(x, y, return_indices=True)
    assert np.array_equal(i, wi) and np.array_equal(j, wj)


def test_empty_table_and_one_long_text(spark, make_docs, tokenizers):
    assert alignment.align(make_docs([])).collect() == []
    text = "word of the " * 60_000 + "x" * 50_000
    got = alignment.align(make_docs([(1, text), (2, "a")])).collect()
    a, _, b, _ = tokenizers
    row = next(r for r in got if r["doc_id"] == 1)
    assert row["n_a"] == len(a.encode(" " + text).ids) and row["n_b"] == len(b.encode(text))
    assert row["n_links"] == row["n_groups"] > 100_000


def test_groups_as_text(spark, make_docs, tokenizers):
    from vellum.llm.common import keyed
    docs = keyed(make_docs([(1, "the tokens of it"), (2, None)]))
    got = {r["uid"]: r for r in alignment.aligned(docs, default_tokenizer(), alignment.default_pieces(), True).collect()}
    assert hashlib.sha256(got[1]["groups"].encode()).hexdigest() == got[1]["groups_sha256"]
    assert got[2]["groups"] == "" == got[2]["groups_sha256"]
