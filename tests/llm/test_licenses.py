"""Licence notices: held-out wording, unknown licences, planted documents."""

import re

import pytest

from vellum.llm import licenses

# The notices that the test documents hold (fixed values).
PLANTED = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit",
           "Licensed under the Apache License, Version 2.0.": "apache-2.0",
           "This work is licensed under the GNU General Public License, version 3.": "gpl"}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("text,family", [
    *PLANTED.items(),
    ("This file is released under the MIT license", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("the data is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("you may redistribute it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("Licensed under the Frobnicator License, Version 7.", "unknown"),
    ("Released under a license of our own.", "unknown"),
    ("The of and to in that ertion.", "none"), ("She gave permission to use the car.", "none"), ("", "none")])
def test_paragraphs(model, text, family):
    got = model.classify(text)[0]
    assert got == family or (family == "none" and got == "unknown" and "permission" in text)


def test_every_notice_is_its_own_family(model):
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            assert model.classify(t)[0] == family
            assert model.classify(t.upper())[0] == family


def test_documents_against_planted_lines(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = 0
    for r in licenses.scan(docs, model).collect():
        lines = [x for x in texts[r["doc_id"]].split("\n") if x.strip()]
        assert r["n_paragraphs"] == len(lines)
        want = [(i, PLANTED[x.strip()]) for i, x in enumerate(lines) if x.strip() in PLANTED]
        got = [(x["paragraph"], x["family"]) for x in r["notices"] if x["family"] in PLANTED.values()]
        assert set(want) <= set(got)
        for x in r["notices"]:
            line = texts[r["doc_id"]][x["start"]:].split("\n")[0]
            assert line == lines[x["paragraph"]]
            assert re.search("licen|permission|copyright|rights|public", line, re.I) or x["family"] == "unknown"
        n += len(want)
    assert n > 10


def test_edge_rows(spark, make_docs, model):
    docs = make_docs([(1, None), (2, ""), (3, " \n\t\n"), (4, "x\n\nReleased under the MIT License.\ny"),
                      (4, "Released under the MIT License."), (None, "word " * 50_000)])
    got = sorted(((r["doc_id"] or 0, r["n_paragraphs"], [(n["paragraph"], n["family"]) for n in r["notices"]])
                  for r in licenses.scan(docs, model).collect()), key=str)
    assert got == sorted([(1, 0, []), (2, 0, []), (3, 0, []), (4, 3, [(1, "mit")]), (4, 1, [(0, "mit")]), (0, 1, [])], key=str)
    assert licenses.scan(make_docs([])).collect() == []


def test_learning_lines_are_different_and_repeatable(spark, make_docs, monkeypatch):
    """A line copied very often is one line, however the rows are dealt."""
    drawn = []
    monkeypatch.setattr(licenses, "fit", lambda lines: drawn.append(lines))
    rows = [(i, f"copied line\nown line {i}\n\n ") for i in range(400)]
    docs = make_docs(rows)
    licenses.train(docs.repartition(3), negatives=1000)
    licenses.train(docs.repartition(8, "doc_id"), negatives=1000)
    assert drawn[0] == drawn[1] == sorted({"copied line", *(f"own line {i}" for i in range(400))})
    licenses.train(docs, negatives=50)
    assert 20 <= len(drawn[2]) <= 100 and set(drawn[2]) <= set(drawn[0])
