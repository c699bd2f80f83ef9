"""Sharding by a Feistel permutation of the global row numbers.

Rows are numbered 0..N-1 in the order of their key; a keyed Feistel network
permutes the smallest even-width power of two that holds N, and a value
outside [0, N) is permuted again until it falls inside (cycle walking), so
the result is a permutation of 0..N-1. Row r goes to shard ``p % shards``,
slot ``p // shards``: counts differ by at most one, slots have no gaps, and
``locate`` / ``row_at`` compute place from row number and back without any
table. Only (id, size, checksum) are sorted, never the texts.

Defined cases: an empty table gives no rows; null texts have size 1 and the
checksum of the empty string; rows with equal ids are numbered in the order
of checksum and size, so exact repeats are interchangeable; null ids come
first; extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.ordered import with_global_index

from . import textops

ROUNDS = 8


def permute(x: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """Feistel permutation of [0, n) applied to ``x`` (cycle walking)."""
    if n <= 1:
        return np.zeros_like(x, dtype=np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for r in rounds:
            if inverse:
                left, right = right ^ (textops.mix(left, seed * ROUNDS + r) & mask), left
            else:
                left, right = right, left ^ (textops.mix(right, seed * ROUNDS + r) & mask)
        return (left << shift) | right

    out = once(np.asarray(x).astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def locate(row: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of global row numbers."""
    p = permute(row, n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """Global row number stored at (shard, slot)."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, inverse=True)


def assign(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes + 1), ``text_crc32``,
    ``row`` (global row number), ``shard``, ``slot``."""
    if shards < 1:
        raise ValueError("a sharding needs at least one shard")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col),
                       (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    numbered = with_global_index(slim, [id_col, "text_crc32", "size"], idx="row")
    n = numbered.agg(F.max("row")).first()[0]
    n = 0 if n is None else n + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, slot = locate(b.column("row").to_numpy(zero_copy_only=False), n, shards, seed)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(shard.astype(np.int32)), pa.array(slot.astype(np.int64))],
                names=[*b.schema.names, "shard", "slot"])

    kind = slim.schema[id_col].dataType.simpleString()
    return numbered.select(id_col, "size", "text_crc32", "row").mapInArrow(
        place, f"`{id_col}` {kind}, size long, text_crc32 long, row long, shard int, slot long")
