"""Finding substrings that repeat anywhere in a corpus, without shuffling
every window.

A window of ``window`` units (bytes or words) is represented by its anchor,
the run of ``gram`` units inside it with the smallest hash: equal windows
have equal anchors at equal places, so only windows under the same anchor
can be equal. Consecutive windows with one anchor form a segment. Rows
``(route = anchor hash, content hash, document, place)`` meet by anchor:

* a segment whose whole content also starts earlier is a repeat at once;
* a segment whose anchor occurs with one content only repeats nothing else;
* first occurrences of different contents under one anchor are compared
  exactly (``resolve``).

Hot anchors are split, never capped. Copies collapse per batch before any
shuffle. An anchor with more than ``HOT`` contents in one batch is marked;
all its segments, in every batch, are then compared window by window: rows
are spread at random, and equal windows meet by a digest of their content,
again collapsed per batch. So at most ``HOT`` rows per batch share a key, and
an anchor with more than ``MANY`` contents in all goes the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textops
from .common import staged, temporary

HOT = 8
MANY = 4096
PART = 1 << 22

_U = np.uint64

NORMAL, DROPPED, SPREAD, MARK = 0, 1, 2, 3


class Unit:
    """What a window counts: bytes or words."""

    def __init__(self, window: int, gram: int, words: bool, same_document: bool, hot: int = HOT):
        if not 0 < gram <= window or window - gram > 254:
            raise ValueError("a gram fits into the window and leaves at most 254 units")
        self.window, self.gram, self.words, self.same_document, self.hot = window, gram, words, same_document, hot

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, document offsets) of a chunk, in units."""
        if not self.words:
            return data, offsets
        s, e, d = textops.word_spans(data, offsets)
        values = textops.range_hash(textops.prefix_hash(data), s, e)
        return values, np.searchsorted(d, np.arange(len(offsets)))

    def segments(self, values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(key, content, start, windows) of all segments of a chunk."""
        w, k = self.window, self.gram
        size = np.diff(offsets)
        has = size >= w
        for at in range(0, max(0, len(values) - w + 1), PART):
            v = values[at:at + PART + w - 1]
            n = len(v) - w + 1
            if n <= 0:
                continue
            edge = np.zeros(n + 1, np.int32)  # +1 where valid starts begin, -1 behind the last
            np.add.at(edge, np.clip(offsets[:-1][has] - at, 0, n), 1)
            np.add.at(edge, np.clip(offsets[1:][has] - w + 1 - at, 0, n), -1)
            valid = np.cumsum(edge[:n]) > 0
            if not valid.any():
                continue
            h, inv = textops.prefix_hash(v), textops._powers(len(v) + 1)[1]
            with np.errstate(over="ignore"):
                gram = (h[k:] - h[:-k]) * inv[:len(v) - k + 1]
            gram ^= gram >> _U(29)
            anchor = textops.window_anchors(gram, w - k + 1)
            new = np.ones(n, bool)
            np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
            new[1:] |= valid[1:] != valid[:-1]
            begins = offsets[:-1][has] - at
            new[begins[(begins >= 0) & (begins < n)]] = True
            q = np.flatnonzero(new)
            c = np.diff(np.append(q, n))
            keep = valid[q]
            q, c = q[keep], c[keep]
            with np.errstate(over="ignore"):
                content = (h[q + c + w - 1] - h[q]) * inv[q]
            yield gram[anchor[q]], content ^ (content >> _U(31)), q + at, c


def segment_rows(unit: Unit) -> Callable:
    """Arrow function: (uid, text) -> (route, content, uid, pos, flag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = textops.buffers(b.column(1))
            parts = []
            for i, j in textops.chunks(offsets):
                lo, hi = offsets[i], offsets[j]
                values, o = unit.units(data[lo:hi], offsets[i:j + 1] - lo)
                for key, content, start, n in unit.segments(values, o):
                    d = np.searchsorted(o, start, side="right") - 1
                    parts.append((key, content, uid[i + d], ((start - o[d]) << 8) | n))
            if parts:
                yield _collapse(unit, *(np.concatenate(c) for c in zip(*parts, strict=True)))
    return run


def _collapse(unit: Unit, key, content, uid, pos) -> pa.RecordBatch:
    """Mark what the batch itself decides, see module doc."""
    order = np.lexsort((pos, uid, content, key))
    key, content, uid, pos = key[order], content[order], uid[order], pos[order]
    first_key = np.ones(len(key), bool)
    first_key[1:] = key[1:] != key[:-1]
    first = first_key.copy()
    first[1:] |= content[1:] != content[:-1]
    heads = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    later = ~first if unit.same_document else uid != uid[heads][group]
    flag = np.where(later, DROPPED, NORMAL).astype(np.int8)
    kid = np.cumsum(first_key) - 1
    many = np.bincount(kid, weights=first) > unit.hot
    flag[many[kid] & (flag == NORMAL)] = SPREAD
    route = np.where(flag == NORMAL, key, textops.mix(key ^ textops.mix(uid.astype(np.uint64)) ^ pos.astype(np.uint64)))
    marks = key[first_key][many]
    extra = len(marks)
    z = np.zeros(extra, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([route, marks]).view(np.int64)),
         pa.array(np.concatenate([content.view(np.int64), z])),
         pa.array(np.concatenate([uid, z])), pa.array(np.concatenate([pos, z])),
         pa.array(np.concatenate([flag, np.full(extra, MARK, np.int8)]))],
        names=["route", "content", "uid", "pos", "flag"])


SEGMENTS = "route long, content long, uid long, pos long, flag byte"


def meet(rows: DataFrame, unit: Unit) -> DataFrame:
    """Decide segments by anchor: ``(kind, route, uid, pos)`` with kind
    DROPPED (a repeat), NORMAL (compare under its anchor) or SPREAD (compare
    window by window); segments that repeat nothing are gone. Staged."""
    by_content = Window.partitionBy("route", "content").orderBy("uid", "pos")
    by_anchor = Window.partitionBy("route")
    rows = rows.repartition("route").withColumn("_n", F.row_number().over(by_content))
    if unit.same_document:
        rows = rows.withColumn("_first", F.col("_n") == 1)
    else:
        rows = rows.withColumn("_first", F.col("uid") == F.first("uid").over(by_content))
    rows = (rows.withColumn("_contents", F.sum(F.when((F.col("_n") == 1) & (F.col("flag") == NORMAL), 1).otherwise(0))
                            .over(by_anchor))
            .withColumn("_hot", F.max(F.col("flag") == MARK).over(by_anchor)))
    kind = (F.when(F.col("flag") == MARK, None)
            .when(F.col("flag") == DROPPED, DROPPED)
            .when((F.col("flag") == SPREAD) | F.col("_hot"), SPREAD)
            .when(~F.col("_first"), DROPPED)
            .when(F.col("_contents") > MANY, SPREAD)
            .when(F.col("_contents") > 1, NORMAL))
    return staged(rows.withColumn("kind", kind.cast("byte")).filter("kind IS NOT NULL")
                  .select("kind", "route", "uid", "pos"))


def _windows(unit: Unit, text: str) -> tuple[bytes, np.ndarray]:
    """The bytes that windows are cut from, and the offset of every unit
    (one more at the end): words are joined by one blank."""
    raw = text.encode()
    if not unit.words:
        return raw, np.empty(0, np.int64)
    words = raw.split()  # bytes.split() uses the same six blanks
    at = np.cumsum([0] + [len(x) + 1 for x in words])
    return b" ".join(words), at


FETCHED = "kind byte, route long, uid long, start long, n int, piece binary"


def fetch(unit: Unit, compare_segments: bool) -> Callable:
    """Arrow function: (uid, text, places) -> rows with the bytes to compare:
    whole segments under their anchor, or digests of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [], [], [], [])
            seen: dict[bytes, tuple[int, int]] = {}
            later: list[tuple[int, int]] = []

            def put(kind, route, uid, start, n, piece, out=out):
                for column, x in zip(out, (kind, route, uid, start, n, piece), strict=True):
                    column.append(x)

            def window(uid, start, digest, seen=seen, later=later):
                old = seen.get(digest)
                if old is None or (uid, start) < old:
                    old, seen[digest] = seen.get(digest), (uid, start)
                    if old is not None:
                        later.append(old)
                else:
                    later.append((uid, start))

            same: list[tuple[int, int, bytes]] = []
            for uid, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                                         strict=True):
                raw, at = _windows(unit, text)
                for p in places:
                    start, n, kind = p["pos"] >> 8, p["pos"] & 255, p["kind"]
                    if kind == NORMAL and compare_segments:
                        put(NORMAL, p["route"], uid, start, n, raw[start:start + n + unit.window - 1])
                        continue
                    for s in range(start, start + n):
                        piece = raw[at[s]:at[s + unit.window] - 1] if unit.words else raw[s:s + unit.window]
                        digest = hashlib.blake2b(piece, digest_size=16).digest()
                        if unit.same_document:
                            window(uid, s, digest)
                        else:
                            same.append((uid, s, digest))
            if not unit.same_document:  # keep every place in the smallest document
                least: dict[bytes, int] = {}
                for uid, s, digest in same:
                    least[digest] = min(uid, least.get(digest, uid))
                for uid, s, digest in same:
                    if uid == least[digest]:
                        put(SPREAD, int.from_bytes(digest[:8], "little", signed=True), uid, s, 1, digest)
                    else:
                        later.append((uid, s))
            for digest, (uid, s) in seen.items():
                put(SPREAD, int.from_bytes(digest[:8], "little", signed=True), uid, s, 1, digest)
            for uid, s in later:
                put(DROPPED, hash((uid, s)), uid, s, 1, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
                                                      pa.binary()), strict=True)],
                names=["kind", "route", "uid", "start", "n", "piece"])
    return run


def places(met: DataFrame, docs: DataFrame) -> DataFrame:
    """(uid, text, places): documents with segments still to compare."""
    todo = (met.filter(F.col("kind") != DROPPED).groupBy("uid")
            .agg(F.collect_list(F.struct("kind", "route", "pos")).alias("places")))
    return docs.select(F.col("_uid"), F.col("_text")).join(todo, F.col("_uid") == F.col("uid")) \
        .select("uid", "_text", "places")


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by ``route``, regrouped into tables of at least ``rows``
    rows that never split a route."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= rows:
            route = b.column("route").to_numpy(zero_copy_only=False)
            last = held[-1].column("route")[-1].as_py()
            cut = int(np.searchsorted(route != last, True))
            if cut:
                held.append(b.slice(0, cut))
            if cut < b.num_rows:
                yield pa.Table.from_batches(held)
                held, n, b = [], 0, b.slice(cut)
            else:
                continue
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def repeated_windows(unit: Unit, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, start, end) of windows in ``table`` (digest rows) that also
    occur earlier."""
    raw = np.frombuffer(b"".join(table["piece"].to_pylist()), np.uint64).reshape(-1, 2)
    uid, start = table["uid"].to_numpy(), table["start"].to_numpy()
    order = np.lexsort((start, uid, raw[:, 1], raw[:, 0]))
    raw, uid, start = raw[order], uid[order], start[order]
    first = np.ones(len(uid), bool)
    first[1:] = (raw[1:] != raw[:-1]).any(axis=1)
    group = np.cumsum(first) - 1
    later = ~first if unit.same_document else uid != uid[np.flatnonzero(first)][group]
    return uid[later], start[later], start[later] + unit.window


SPANS = "uid long, start long, end long"


def spans_batch(uid, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(start, pa.int64()),
                                       pa.array(end, pa.int64())], names=["uid", "start", "end"])


def union_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    if not spans:
        return []
    s = np.array([(x["start"], x["end"]) for x in spans], np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.ones(len(s), bool)
    new[1:] = s[1:, 0] > reach[:-1]
    heads = np.flatnonzero(new)
    ends = reach[np.append(heads[1:], len(s)) - 1]
    return list(zip(s[heads, 0].tolist(), ends.tolist(), strict=True))


def cut(docs: DataFrame, find: Callable[[], DataFrame], fields: str, describe: Callable, carry: list[str]) -> DataFrame:
    """``carry`` columns of every keyed document plus ``fields``, which
    ``describe(text, spans)`` gives as one tuple per document; ``find()``
    returns the spans, whose intermediate tables go once they are grouped."""
    with temporary(docs.sparkSession):
        per = staged(find().groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans")), outlives=True)
    rest = F.struct(*[F.col("_row").getField(c).alias(c) for c in carry]).alias("_rest")
    joined = docs.select("_uid", "_text", rest).join(per, F.col("_uid") == F.col("uid"), "left") \
        .select("_text", "spans", "_rest")
    kind = joined.schema["_rest"].dataType.simpleString()
    out = T._parse_datatype_string(fields)
    types = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(t, s) for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [b.column(2), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                names=["_rest", *out.names])
    done = joined.mapInArrow(run, f"_rest {kind}, {fields}")
    return done.select(*[F.col("_rest").getField(c).alias(c) for c in carry], *out.names)
