"""Removal of repeated word windows with a count-min prefilter.

A word goes when a window of ``window`` consecutive words that covers it also
starts in a document with a smaller id. Two passes over the texts:

1. every task counts the anchors of its windows (``repeats``) in a count-min
   sketch; the partial sketches are summed block by block. A window is at
   most as frequent as its anchor, and a sketch never underestimates, so a
   window estimated once repeats nowhere: nothing is lost.
2. only windows whose anchor is estimated repeated are grouped exactly: first
   by segment content, then window by window with digests of their words.

The sketch has a fixed number of cells per input byte (``CELLS_PER_BYTE``), is
sharded into blocks of ``BLOCK`` cells and never leaves the cluster: blocks
are summed by key, looked up by a join.

Defined cases: null texts have no words; texts with fewer words than a window
stay whole; documents sharing an id are told apart by a stable order (see
``common.keyed``) and count as different documents, as do repeated rows; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, textops
from .common import keyed

WINDOW = 50
GRAM = 25
DEPTH = 2
BLOCK = 1 << 20
CELLS_PER_BYTE = 1 / 16
FLUSH = 1 << 20


def cells(keys: np.ndarray, width: int, row: int) -> np.ndarray:
    """Cell of every key in one row of the sketch."""
    return (textops.mix(keys, 100 + row) % np.uint64(width)).astype(np.int64)


def _partial(unit: repeats.Unit, width: int):
    """Arrow function: texts -> partial sketches, one row per (row, block):
    the cells that were hit and how often (saturated at 255)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            keys = np.concatenate(held)
            held.clear()
            out = ([], [], [], [])
            for row in range(DEPTH):
                hit, n = np.unique(cells(keys, width, row), return_counts=True)
                block = hit // BLOCK
                cuts = np.flatnonzero(np.diff(block, prepend=-1))
                for s, e in zip(cuts, [*cuts[1:], len(hit)], strict=True):
                    out[0].append(row)
                    out[1].append(int(block[s]))
                    out[2].append(pa.compress(np.diff(hit[s:e] % BLOCK, prepend=0).astype(np.uint32).tobytes(),
                                              "zstd", asbytes=True))
                    out[3].append(pa.compress(np.minimum(n[s:e], 255).astype(np.uint8).tobytes(), "zstd", asbytes=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()),
                 pa.array(out[3], pa.binary())], names=["row", "block", "cells", "counts"])

        for b in batches:
            data, offsets = textops.buffers(b.column(0))
            for i, j in textops.chunks(offsets):
                lo, hi = offsets[i], offsets[j]
                values, o = unit.units(data[lo:hi], offsets[i:j + 1] - lo)
                held += [key for key, _, _, _ in unit.segments(values, o)]
            if sum(map(len, held)) >= FLUSH:
                yield flush()
        if held:
            yield flush()
    return run


def _decode(raw: bytes, kind) -> np.ndarray:
    codec = pa.Codec("zstd")
    # sizes are not stored: the stream decompresses itself
    return np.frombuffer(pa.CompressedInputStream(pa.BufferReader(raw), codec.name).read(), kind)


def repeated_cells(docs: DataFrame, unit: repeats.Unit, width: int) -> DataFrame:
    """``(row, cell)`` of the merged sketch with a count of 2 or more."""
    partial = docs.select("_text").mapInArrow(_partial(unit, width),
                                              "row int, block long, cells binary, counts binary")

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint32)
        for c, n in zip(group["cells"].to_pylist(), group["counts"].to_pylist(), strict=True):
            total[np.cumsum(_decode(c, np.uint32))] += _decode(n, np.uint8)
        hit = np.flatnonzero(total >= 2)
        row, block = group["row"][0].as_py(), group["block"][0].as_py()
        return pa.table({"row": pa.array(np.full(len(hit), row, np.int32)), "cell": pa.array(hit + block * BLOCK)})

    return partial.groupBy("row", "block").applyInArrow(merge, "row int, cell long")


def _with_cells(unit: repeats.Unit, width: int):
    inner = repeats.segment_rows(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in inner(batches):
            key = b.column("route").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(cells(key, width, r)) for r in range(DEPTH)]],
                                             names=[*b.schema.names, *[f"c{r}" for r in range(DEPTH)]])
    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int | None = None,
                   hot: int = repeats.HOT) -> DataFrame:
    """``(uid, start, end)`` in words, overlapping."""
    unit = repeats.Unit(window, gram or min(GRAM, window), words=True, same_document=False, hot=hot)
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    width = BLOCK * max(1, -(-int(size * CELLS_PER_BYTE) // BLOCK))
    sketch = repeats.staged(repeated_cells(docs, unit, width))
    rows = docs.select("_uid", "_text").mapInArrow(
        _with_cells(unit, width), repeats.SEGMENTS + "".join(f", c{r} long" for r in range(DEPTH)))
    for r in range(DEPTH):  # decided rows pass: their route is not an anchor
        hit = sketch.filter(F.col("row") == r).select(F.col("cell").alias("_hit"))
        rows = (rows.join(hit, F.col(f"c{r}") == F.col("_hit"), "left")
                .filter((F.col("flag") != repeats.NORMAL) | F.col("_hit").isNotNull()).drop("_hit"))
    met = repeats.meet(rows.select("route", "content", "uid", "pos", "flag"), unit)
    fetched = repeats.places(met, docs).mapInArrow(repeats.fetch(unit, compare_segments=False), repeats.FETCHED)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in repeats.grouped(batches, 1 << 16):
            kind = table["kind"].to_numpy()
            done = table.filter(pa.array(kind == repeats.DROPPED))
            if len(done):
                s = done["start"].to_numpy()
                yield repeats.spans_batch(done["uid"].to_numpy(), s, s + window)
            digests = table.filter(pa.array(kind == repeats.SPREAD))
            if len(digests):
                yield repeats.spans_batch(*repeats.repeated_windows(unit, digests))

    compared = fetched.repartition("route").sortWithinPartitions("route").mapInArrow(resolve, repeats.SPANS)
    start, n = F.shiftright("pos", 8), F.col("pos").bitwiseAND(F.lit(255))
    known = met.filter(F.col("kind") == repeats.DROPPED).select(
        "uid", start.alias("start"), (start + n + (window - 1)).alias("end"))
    return known.unionByName(compared)


def _kept(text: str | None, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    words = (text or "").encode().split()
    at, parts = 0, []
    for s, e in repeats.union_spans(spans):
        parts += words[at:s]
        at = e
    return len(words), parts + words[at:]


def digests(docs: DataFrame, window: int = WINDOW, gram: int | None = None, id_col: str = "doc_id",
            text_col: str = "text", hot: int = repeats.HOT) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed`` and
    ``kept_sha256`` of the words left, joined by one blank."""
    def describe(text, spans):
        n, kept = _kept(text, spans)
        return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    rows = keyed(docs, id_col, text_col)
    return repeats.cut(rows, lambda: repeated_spans(rows, window, gram, hot=hot), "n_words long, n_removed long, kept_sha256 string",
                       describe, [id_col])


def apply(docs: DataFrame, window: int = WINDOW, gram: int | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The documents with repeated windows taken out; a text that loses
    nothing stays as it is, one that loses words has single blanks."""
    def describe(text, spans):
        return (b" ".join(_kept(text, spans)[1]).decode() if spans else text,)

    rows = keyed(docs, id_col, text_col)
    kept = repeats.cut(rows, lambda: repeated_spans(rows, window, gram), "_kept_text string", describe,
                       [c for c in docs.columns if c != text_col])
    return kept.select(*[F.col("_kept_text" if c == text_col else f"`{c}`").alias(c) for c in docs.columns])
