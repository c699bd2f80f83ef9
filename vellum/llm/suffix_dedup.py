"""Removal of repeated byte strings with a collection suffix array.

Every byte covered by a ``length``-byte string that also starts earlier
(smaller document, or same document and earlier start) goes; strings never
cross documents and are judged on the input. Anchors (``repeats``) reduce
the corpus to segments that could hold a repeated string and bring those
with a common anchor together. Each collection of segments then gets its
Burrows-Wheeler transform and common-prefix array, built column by column
over all its strings at once in sequential files (``bwt``); intervals with
common prefixes of ``length`` are the equal strings, and all of their places
but the first are repeats.

Defined cases: null texts are empty; texts shorter than ``length`` are never
touched; repeated rows are separate documents in a stable order (see
``common.keyed``), so all but the first of equal long texts are emptied; an
empty table gives no rows. Bytes are removed, not characters: where a cut
goes through a character, ``apply`` drops the rest of it, while the digest of
``digests`` is of the exact bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .bwt import Collection
from .common import keyed

LENGTH = 100
GRAM = 48
COLLECTION = 1500


def _resolve(unit: repeats.Unit, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in repeats.grouped(batches, rows):
            kind = table["kind"].to_numpy()
            done = table.filter(pa.array(kind == repeats.DROPPED))
            if len(done):
                s = done["start"].to_numpy()
                yield repeats.spans_batch(done["uid"].to_numpy(), s, s + unit.window)
            digests = table.filter(pa.array(kind == repeats.SPREAD))
            if len(digests):
                yield repeats.spans_batch(*repeats.repeated_windows(unit, digests))
            strings = table.filter(pa.array(kind == repeats.NORMAL))
            if len(strings):
                yield repeats.spans_batch(*_later_places(strings, unit.window))
    return run


def _later_places(strings: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    uid, start = strings["uid"].to_numpy(), strings["start"].to_numpy()
    raw = strings["piece"].to_pylist()
    collection = Collection(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64), length)
    group, who, offset = collection.repeats(length)
    u, at = uid[who], start[who] + offset
    order = np.lexsort((at, u, group))
    group, u, at = group[order], u[order], at[order]
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    return u[~first], at[~first], at[~first] + length


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None,
                   collection: int = COLLECTION, hot: int = repeats.HOT) -> DataFrame:
    """``(uid, start, end)``: repeated strings of the keyed documents, as
    overlapping spans."""
    unit = repeats.Unit(length, gram or min(GRAM, length), words=False, same_document=True, hot=hot)
    rows = docs.select("_uid", "_text").mapInArrow(repeats.segment_rows(unit), repeats.SEGMENTS)
    met = repeats.meet(rows, unit)
    fetched = repeats.places(met, docs).mapInArrow(repeats.fetch(unit, compare_segments=True), repeats.FETCHED)
    compared = (fetched.repartition("route").sortWithinPartitions("route")
                .mapInArrow(_resolve(unit, collection), repeats.SPANS))
    start, n = F.shiftright("pos", 8), F.col("pos").bitwiseAND(F.lit(255))
    known = met.filter(F.col("kind") == repeats.DROPPED).select(
        "uid", start.alias("start"), (start + n + (length - 1)).alias("end"))
    return known.unionByName(compared)


def _rest(text: str | None, spans: list[dict] | None) -> tuple[bytes, bytes, int]:
    """(input bytes, bytes left, maximal removed runs)."""
    raw = (text or "").encode()
    runs = repeats.union_spans(spans)
    at, parts = 0, []
    for s, e in runs:
        parts.append(raw[at:s])
        at = e
    return raw, b"".join([*parts, raw[at:]]), len(runs)


def digests(docs: DataFrame, length: int = LENGTH, gram: int | None = None, id_col: str = "doc_id",
            text_col: str = "text", hot: int = repeats.HOT) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs) and ``kept_sha256`` of the bytes left."""
    def describe(text, spans):
        raw, rest, runs = _rest(text, spans)
        return len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest()

    rows = keyed(docs, id_col, text_col)
    return repeats.cut(rows, lambda: repeated_spans(rows, length, gram, hot=hot),
                       "n_bytes long, n_removed long, n_spans long, kept_sha256 string", describe, [id_col])


def apply(docs: DataFrame, length: int = LENGTH, gram: int | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The documents with repeated strings taken out of ``text_col`` (null
    texts stay null); all input columns, all rows."""
    def describe(text, spans):
        return (None if text is None else _rest(text, spans)[1].decode("utf-8", "ignore"),)

    rows = keyed(docs, id_col, text_col)
    kept = repeats.cut(rows, lambda: repeated_spans(rows, length, gram), "_kept_text string", describe,
                       [c for c in docs.columns if c != text_col])
    return kept.select(*[F.col("_kept_text" if c == text_col else f"`{c}`").alias(c) for c in docs.columns])
