"""Restoration of obfuscated words, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np
import pytest

from vellum.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scorer(spark, make_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    s = toxicity.train(docs, labels)
    s.start()
    return s


@pytest.mark.parametrize("seen,source", [
    ("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("i-d-i-o-t", "idiot"), ("IDIOOOOT", "idiot"),
    ("m0r0n!", "moron"), ("l0s3r", "loser"), ("tr4$h", "trash"), ("$cum", "scum"), ("p a t h e t i c", "pathetic"),
    ("w0rthl3ss", "worthless"), ("stuuuupid", "stupid")])
def test_restored_words(scorer, seen, source):
    assert source in scorer.restorer.tokens(f"the {seen} and")


def test_plain_words_have_one_reading(scorer):
    for word in ("thereof", "öffnung", "committee", "aaah"[:2]):
        assert scorer.restorer.readings(word + ",") == (word,)


def test_held_out_accuracy_and_obfuscation(spark, scorer):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()]
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    score = np.array([scorer.score(t) for t, _ in held])
    y = np.array([x for _, x in held])
    assert ((score >= 0.5) == (y == 1)).mean() > 0.98
    # some junk texts (one line repeated, no insult of any kind) are labelled toxic here
    assert (score[y == 1][:, None] > score[y == 0][None, :]).mean() > 0.97
    swap = str.maketrans({"i": "1", "o": "0", "e": "3"})
    insults = ("idiot", "moron", "loser", "worthless", "stupid")
    clean = next(t for t, x in held if x == 0 and len(t) > 500)
    for w in insults:
        assert scorer.score(clean + " " + w) >= 0.5
        assert scorer.score(clean + " " + w.translate(swap) + " " + " ".join(w)) >= 0.5


def test_query_shape_and_inputs(spark, make_docs):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)] + (["zounds"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), bad))
    docs = make_docs([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "zounds"), (5, "zounds")])
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows] + [(7, None), (None, 1), (99999, 1)],
                                   "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == 404
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
    by = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] not in (5,)}
    assert all(by[i] == int(b) for i, _, b in rows if i != 5)
    assert by[None] == 1 and by[1000] == by[1001] == 0
    kept = toxicity.apply(docs, labels)
    assert kept.columns == docs.columns
    assert kept.filter("text like '%zounds%'").count() == 0 and kept.count() == 302


def test_without_labels_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.scores(make_docs([(1, "a"), (2, None)]), none).collect()} == {0}
    assert toxicity.scores(make_docs([]), none).collect() == []


def test_labels_outside_the_learning_folds_do_not_matter(spark, make_docs):
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 0][:40]
    docs = make_docs([(i, "zounds" if n % 2 else "fine") for n, i in enumerate(held)])
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(held)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.scores(docs, labels).collect()} == {toxicity.Scorer._squash(-30.0)}


def test_very_long_text(scorer):
    assert scorer.score("alpha beta " * 200_000 + "idiot moron") >= 0.5
    scorer.restorer.tokens("x" * 20_000 + "1" * 2000)


@pytest.mark.parametrize("seen,source", [
    ("iddiott", "idiot"), ("mmoorroonn", "moron"), ("loosserr", "loser"), ("id iot", "idiot"), ("st u pid", "stupid"),
    ("mo ron", "moron"), ("lo s er", "loser"), ("i . d . i . o . t", "idiot"), ("m - o - r - o - n", "moron")])
def test_doubled_split_and_separated_words(scorer, seen, source):
    assert source in scorer.restorer.tokens(f"the {seen} and")
    assert scorer.score(f"the {seen} and") > scorer.score("the and")


# Words that set no cost and no threshold of the decoder, each held out from the lists above.
HELD = [("imb3c1l3", "imbecile"), ("v.e.r.m.i.n", "vermin"), ("c0w4rd", "coward"), ("hhypoccritte", "hypocrite"),
        ("l o w l i f e", "lowlife"), ("vveerrmmiinn", "vermin"), ("cow ard", "coward"), ("v - e - r - m - i - n", "vermin"),
        ("imbeciiiile", "imbecile"), ("sc0undr3l", "scoundrel")]


@pytest.fixture(scope="module")
def english():
    """A character model of words in which the held-out ones are rare."""
    import pyarrow as pa
    rng = random.Random(1)
    words = ["the", "of", "and", "people", "imbecile", "vermin", "coward", "hypocrite", "lowlife", "scoundrel", "better",
             "committee", "winter", "summer", "carbon", "mechanic", "universe", "virtue", "cowboy", "wardrobe", "hypothesis"]
    text = " ".join(rng.choices(words, [40, 30, 30, 9] + [1] * 6 + [6] * 11, k=30_000))
    n = np.zeros(toxicity.SYMBOLS ** 4)
    for b in toxicity.count_grams(iter([pa.record_batch([pa.array([text])], names=["text"])])):
        n[b.column(0).to_numpy()] += b.column(1).to_numpy()
    return toxicity.interpolated(n)


@pytest.mark.parametrize("seen,source", HELD)
def test_held_out_forms(english, seen, source):
    assert source in toxicity.Restorer(english).tokens(f"the {seen} and")


def brute_reading(token, cost, drop, space, doubles):
    """All paths of the lattice, one by one."""
    from itertools import groupby, product

    from vellum.llm import lattice
    signs = [(c, run, length) for c, same in groupby(lattice.fold(token)) for length in [len(list(same))] for run in range(length)]
    options = [lattice.readings(*s, drop, space, doubles) or [("", 0.0)] for s in signs]
    best = None
    for path in product(*options):
        spent, state = 0.0, 0
        for x, price in path:
            spent += price
            if x:
                spent += cost[state * 28 + lattice.letter_class(x)]
                state = (state * 28 + lattice.letter_class(x)) % lattice.STATES
        spent += cost[state * 28]
        found = (spent, "".join(x for x, _ in path))
        best = found if best is None or found[0] < best[0] - 1e-9 else best
    return best


def test_decoder_against_all_paths():
    from vellum.llm import lattice
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.full(28, 0.3), 28 ** 3).ravel() + 1e-6).astype(np.float32)
    pick = random.Random(5)
    for how in ((0.6, 1.5, False), (0.6, 1.5, True), (1.0, 0.0, False)):
        lat = lattice.Lattice(model, *how)
        for _ in range(250):
            token = "".join(pick.choice("aabbcdeé01!*.- $٣") for _ in range(pick.randint(1, 9)))
            want = brute_reading(token, lat.cost, *how)
            got = lat.restore(token)
            assert got == lat.restore(token)
            if got != want[1]:  # only for a tie
                assert abs(cost_of(token, got, lat, how) - want[0]) < 1e-6, (token, got, want)


def cost_of(token, output, lat, how):
    """Cheapest path that writes ``output``."""
    from itertools import groupby

    from vellum.llm import lattice
    signs = [(c, run, length) for c, same in groupby(lattice.fold(token)) for length in [len(list(same))] for run in range(length)]
    live = {("", 0): 0.0}
    for s in signs:
        step = {}
        for (text, state), spent in live.items():
            for x, price in lattice.readings(*s, *how) or [("", 0.0)]:
                t, total = state, spent + price
                if x:
                    total += lat.cost[state * 28 + lattice.letter_class(x)]
                    t = (state * 28 + lattice.letter_class(x)) % lattice.STATES
                if output.startswith(text + x):
                    step[text + x, t] = min(total, step.get((text + x, t), 1e18))
        live = step
    return min(spent + lat.cost[state * 28] for (text, state), spent in live.items() if text == output)


def test_keeps_agrees_with_restore(english):
    from vellum.llm import lattice
    lat = lattice.Lattice(english, doubles=True)
    pick = random.Random(6)
    for _ in range(2000):
        word = "".join(pick.choice(["better", "tt", "ee", "the", "wi", "n", "s", "mm", "er"]) for _ in range(pick.randint(1, 4)))
        if not any(c * 3 in word for c in "tenmsrwih") and lat.keeps(word):
            assert lat.restore(word) == word


def test_long_tokens_take_linear_time(english):
    import time
    r = toxicity.Restorer(english)
    pick = random.Random(7)
    took = []
    for n in (50_000, 200_000):
        token = "".join(pick.choice("abcdefghijklmnop0123456789+/") for _ in range(n))
        began = time.process_time()
        r.readings(token)
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.05)
    r.readings("*" * 3000 + "a")


def test_signs_that_only_vanish_open_no_core(english):
    from vellum.llm import lattice
    lat = lattice.Lattice(english)
    for token, want in (("winter###", "winter"), ("summer,&&&", "summer"), ("%%%carbon%%%", "carbon"), ("&&wi#nt#er", "winter")):
        assert lat.restore(token) == want
    assert not lat.memo
    assert lat.restore("w1nter###") == "winter" and len(lat.memo) == 1


def test_short_cores_agree_with_long_ones(english):
    from vellum.llm import lattice
    pick = random.Random(8)
    for how in ((0.6, 1.5, False), (0.6, 1.5, True), (1.0, 0.0, False)):
        short, long, whole = (lattice.Lattice(english, *how) for _ in range(3))
        long.SHORT, long.COMMIT, whole.NUMBERS = 0, 5, 0  # back pointers; no sign has a character: undivided
        for _ in range(1500):
            token = "".join(pick.choice(["the", "winter", "ee", "tt", "0", "1", "!", "*", "$", " ", ".", "#", "é", "ß", "\U000f0000"])
                            for _ in range(pick.randint(1, 8)))
            assert short.restore(token) == long.restore(token) == whole.restore(token)
        assert short.memo and not long.memo and not whole.memo


def test_runs_are_found_at_either_end_and_behind_any_blank(english):
    r = toxicity.Restorer(english)
    for text in ("c o w a r d", "x\nc o w a r d", "the\u00a0c o w a r d\u00a0the", "c.o w\x1cc o w a r d"):
        assert "coward" in r.spaced(text), text
    assert r.spaced("winterc o") == [] and r.spaced("the winter") == []


def test_tokens_without_weight_are_remembered_in_two_generations():
    blank = toxicity.Blank(2)
    assert blank.others({"a", "b"}) == {"a", "b"}
    blank.add(["a", "b"])
    blank.add(["c"])
    assert blank.others({"a", "b", "c", "d"}) == {"d"}
    blank.add(["d"])
    assert blank.others({"a", "b", "c", "d"}) == set() and len(blank.recent) + len(blank.older) <= 8
    blank.add(["e"])
    blank.add(["f", "g"])
    blank.add(["h"])
    assert blank.others({"a", "e", "h"}) == {"a"}


def test_readings_do_not_depend_on_the_words_before(english):
    from vellum.llm import lattice
    pick = random.Random(9)
    words = ["".join(pick.choice(["ee", "tt", "nn", "mm", "rr", "s"]) for _ in range(pick.randint(2, 4))) for _ in range(300)]
    words = [w for w in words if not any(c * 3 in w for c in "etnmrs")]
    used = lattice.Lattice(english, doubles=True)
    for w in words:
        used.keeps(w)
    assert [used.restore(w) for w in words] == [_fresh(used).restore(w) for w in words]


def _fresh(lat):
    """The same costs, nothing remembered."""
    from vellum.llm import lattice
    new = lattice.Lattice(np.zeros(1, np.float32), *lat.how)
    new.cost = lat.cost
    return new
