"""Best-fit packing of tokenised documents into fixed-size sequences.

Texts are tokenised in parallel; a document longer than the capacity is cut
into full pieces with the remainder first. Packing looks only at the
histogram of piece lengths (at most ``capacity`` numbers, whatever the size
of the corpus): ``plan`` opens sequences for the longest lengths left and
looks the gap up among single lengths, pair sums and triple sums under the
counts still available, taking as many equal sequences at once as the counts
allow; a gap no combination fills exactly takes the best-fitting (longest)
piece and is looked up again. Every step uses up a length, so the plan has a
few thousand rows at most. A piece finds its place from its length and its
rank among the pieces of that length: ranks are running counts inside each
task plus offsets per (task, length), so no group of pieces ever meets in
one task.

Defined cases: null or empty texts give one piece with the end id alone; a
repeated row gives its own pieces; an empty table gives no rows; texts that
hold a special-token string are encoded as the tokenizer file defines it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CAPACITY = 1024
END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE tokenizer file.

    The file's vocabulary drives tiktoken's merge loop (about four times
    faster; ids rank the merges in such files); texts with one of the file's
    special strings go through the ``tokenizers`` library itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
        other = [b for b in range(256) if b not in set(plain)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in self.special}
        import public_tokenizers
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})
        self.exact = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of every document, with ``_task`` and ``_nth`` (running number
    among the task's pieces of that length). Written once: the numbering
    belongs to the files."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, piece int, start long, length long, ids_crc32 long, _task int, _nth long"
              + (", ids array<int>" if keep_ids else ""))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids_col = b.column(0)
            at, cols, tokens = [], {k: [] for k in ("piece", "start", "length", "crc", "nth")}, []
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity
                cuts = [0, *range(first, len(ids), capacity), len(ids)] if first else \
                    [*range(0, len(ids), capacity), len(ids)]
                for n, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    at.append(row)
                    cols["piece"].append(n)
                    cols["start"].append(s)
                    cols["length"].append(e - s)
                    cols["crc"].append(zlib.crc32(ids[s:e].tobytes()))
                    cols["nth"].append(seen[e - s])
                    seen[e - s] += 1
                    if keep_ids:
                        tokens.append(ids[s:e].astype(np.int32))
            out = [ids_col.take(pa.array(at, pa.int64())), pa.array(cols["piece"], pa.int32()),
                   pa.array(cols["start"], pa.int64()), pa.array(cols["length"], pa.int64()),
                   pa.array(cols["crc"], pa.int64()), pa.array([task] * len(at), pa.int32()),
                   pa.array(cols["nth"], pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "_task", "_nth"]
            if keep_ids:
                out.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return staged(slim.mapInArrow(cut, schema))


def _complement(gap: int, left: np.ndarray) -> list[int] | None:
    """One, two or three available lengths that sum to ``gap`` exactly
    (longest first), or None."""
    if left[gap]:
        return [gap]

    def pair(g: int, top: int) -> list[int] | None:
        a = np.arange(min(top, g - 1), (g + 1) // 2 - 1, -1)
        a = a[(left[a] > 0) & (left[g - a] > (g - a == a))]
        return [int(a[0]), int(g - a[0])] if len(a) else None

    if found := pair(gap, gap - 1):
        return found
    for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
        if left[a]:
            left[a] -= 1
            rest = pair(gap - a, a)
            left[a] += 1
            if rest:
                return [a, *rest]
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows ``(length, first rank, ranks, first sequence, offset)`` and the
    number of sequences. Rank r of a length lies in the row whose range holds
    it, in sequence ``first sequence + r - first rank``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used, rows, sequences = np.zeros(capacity + 1, np.int64), [], 0
    while len(live := np.flatnonzero(left)):
        longest = int(live[-1])
        chosen, gap = [longest], capacity - longest
        left[longest] -= 1
        while gap:
            rest = _complement(gap, left)
            if rest is None:
                fits = np.flatnonzero(left[:gap])
                if not len(fits):
                    break
                rest = [int(fits[-1])]  # best fit
            for x in rest:
                left[x] -= 1
            chosen += rest
            gap -= sum(rest)
        lengths, need = np.unique(chosen, return_counts=True)
        left[lengths] += need
        times = int((left[lengths] // need).min())
        offset = 0
        for x in chosen:
            rows.append((x, used[x], times, sequences, offset))
            used[x] += times
            offset += x
        left[lengths] -= need * times
        sequences += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table, sequences


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (and ``ids`` on request)."""
    cut = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids)
    counts = cut.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table, _ = plan(histogram, capacity)  # at most `capacity` numbers came to the driver
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("_task").alias("_t"), F.col("length").alias("_l"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = cut.join(base, (F.col("_task") == F.col("_t")) & (F.col("length") == F.col("_l")))
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_nth"))
    keep = ["id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    order = table[:, 0] * (1 << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(order, length * (1 << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])],
                names=[*keep, "sequence_id", "offset"])

    return (ranked.select(*keep, "_rank")
            .mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long")
            .withColumnRenamed("id", id_col))
