"""Merkle manifest against a plain recomputation on the driver."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vellum.llm import merkle
from vellum.llm.queries import REGISTRY

UNICODE = "ä€ß Ünder 日本 Text"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row, text)))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, i, folded):
    siblings = []
    for level in tree[:-1]:
        run, at = level[i // 16 * 16:i // 16 * 16 + 16], i % 16
        siblings += run[:at] + run[at + 1:]
        folded, i = h("".join([*run[:at], folded, *run[at + 1:]])), i // 16
    return siblings, folded


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> result rows."""
    by = defaultdict(list)
    for *head, text in rows:
        ident = head[0]
        hit = ident is not None and text is not None and zlib.crc32(str(ident).encode()) % 5 == 0
        by[head[1]].append(((ident is not None, ident or 0), leaf(head, text), leaf(head, text.translate(FOLD) if hit else text), ident))
    trees = {}
    for s in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        by[s].sort()
        trees[s] = levels([x[1] for x in by[s]])
    if not trees:
        return Counter()
    top = levels([t[-1][0] for t in trees.values()])
    out = Counter()
    for t, (s, tree) in enumerate(trees.items()):
        for i, (_, own, folded, ident) in enumerate(by[s]):
            a, folded = climb(tree, i, folded)
            b, folded = climb(top, t, folded)
            out[ident, own, tree[-1][0], top[-1][0], h("".join(a + b)), folded, folded == top[-1][0]] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, make_docs, rows):
    docs = make_docs([(r[0], r[4], r[1]) for r in rows])
    docs = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    want = brute([(i, s, None, None if t is None else len(t), t) for i, s, _, _, t in rows])
    got = merkle.verify(docs)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == want


def test_trees_of_many_shapes(spark, make_docs):
    rng = random.Random(2)
    rows = []
    for source, n in {None: 1, "": 16, "a": 17, "B": 256, "b": 257, "ä": 40, "z": 1}.items():
        rows += [(rng.getrandbits(40), source, None, None, f"{rng.random()} Some Text") for _ in range(n)]
    rng.shuffle(rows)
    check(spark, make_docs, rows)


def test_many_groups_and_slots(spark, make_docs, monkeypatch):
    monkeypatch.setattr(merkle, "SLOT", 8)
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 400 + [f"s{j}" for j in range(300)]), None, None, f"T{i}") for i in range(900)]
    check(spark, make_docs, rows)


def test_edges(spark, make_docs):
    check(spark, make_docs, [])
    check(spark, make_docs, [(5, "a", None, None, "ONE")])
    check(spark, make_docs, [(5, "a", None, None, None), (5, "b", None, None, "")])
    edge = [(None, "a", None, None, "NULL ID"), (1, None, None, None, None), (2, "a", None, None, ""), (2, "a", None, None, "x"),
            (3, "a", None, None, "SAME"), (3, "a", None, None, "SAME"), (4, "b", None, None, "LONG " * 100_000),
            (10, "a", None, None, UNICODE), (-7, "a", None, None, "negative")]
    check(spark, make_docs, edge)


def test_tampering_shows(spark, make_docs):
    got = merkle.verify(make_docs([(i, f"Text {i}", "s") for i in range(200)])).collect()
    for r in got:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0)


def test_nodes_are_linked(spark, make_docs):
    leaves, nodes = merkle.build(make_docs([(i, f"t{i}", f"s{i % 3}") for i in range(300)]))
    rows = {r["node"]: r for r in nodes.collect()}
    assert sum(r["parent"] is None for r in rows.values()) == 1
    for r in [*rows.values(), *leaves.collect()]:
        if r["parent"] is not None:
            kept = rows[r["parent"]]["children"]
            assert kept[32 * r["place"]:32 * r["place"] + 32] == r["hash"]


def test_plan_climbs_by_slot(spark, make_docs):
    leaves, nodes = merkle.build(make_docs([(i, f"t{i}", "s") for i in range(50)]))
    plan = merkle.climb(leaves, nodes)._jdf.queryExecution().toString()
    assert "UnionLoop" in plan and "slot" in plan


def test_query_against_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    q = REGISTRY["op12_merkle_manifest"]
    want = Counter(con.sql(q.sql).fetchall())
    assert Counter(map(tuple, q.run(spark, sf).collect())) == want
