"""The pipeline against a brute-force run of its own stages, and edge tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.test_minhash import brute
from tests.llm.test_mix_pack_shard_topk import reference_ids
from vellum.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


def cut_repeats(docs, k=100):
    seen, out = set(), []
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - k + 1):
            x = raw[s:s + k]
            if x in seen:
                gone[s:s + k] = True
            seen.add(x)
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, None if text is None else rest.decode("utf-8", "ignore")))
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, frames = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).cache()
        frames.append(kept)
        if name != "pack":
            assert kept.columns == docs.columns
    toxic, near, cut, mixed, packed = frames
    scorer = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer.start()
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [r for r in rows if scorer.score(r[1]) < 0.5]
    assert sorted((r["doc_id"], r["text"]) for r in toxic.collect()) == rows
    rows = [r for n, (r, (_, c)) in enumerate(zip(rows, brute(rows, 5, 80, 100))) if c == n]
    assert sorted((r["doc_id"], r["text"]) for r in near.collect()) == rows
    rows = cut_repeats(rows)
    assert sorted((r["doc_id"], r["text"]) for r in cut.collect()) == rows
    copies = {r["_row"]["doc_id"]: r["_copies"] for r in mixing.plan(cut).collect()}
    want = Counter({i: n for i, n in copies.items() if n})
    assert Counter(r["doc_id"] for r in mixed.collect()) == want
    texts = dict(rows)
    pieces, fill = Counter(), defaultdict(list)
    for r in packed.collect():
        ids = np.array(reference_ids(texts[r["doc_id"]]), "<u4")[r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        pieces[r["doc_id"], r["piece"]] += 1
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: n for (i, p), n in pieces.items() if p == 0} == dict(want)
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024


def test_run_equals_stages(spark):
    a = corpus_pipeline.run(spark, SF)
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, a.select(key).collect())) == Counter(map(tuple, kept.select(key).collect()))


def test_edge_rows_pass_every_stage(spark, make_docs):
    for rows in ([], [(1, None, None), (2, "", "a"), (3, " \n", "a"), (3, "x", "b"), (None, "y z", "b"), (3, "x", "b")]):
        docs = make_docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()
            assert name == "pack" or docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
