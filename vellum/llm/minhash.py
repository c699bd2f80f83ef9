"""Near-duplicate detection with HyperMinHash sketches.

A document is the set of its ``k``-word shingles (A-Z lower-cased). One hash
per shingle picks a bucket; a bucket keeps its minimum compressed to five
bits of leading zeros and eleven bits of mantissa behind them. ``ROWS``
registers of ``BUCKETS`` make a band (empty buckets borrow from full ones,
``densified``); documents with an equal band are
candidates (a pair at similarity 0.8 misses all bands with probability
below 1e-8, at 0.85 below 1e-12). The steps:

1. documents with equal sets form a class; its smallest id goes on;
2. per band key, members point to the smallest member (copies of a key
   within a batch collapse first), and the components of these pointers are
   the clusters inside which links can exist;
3. a cluster is cut into blocks of bounded size and every pair of blocks is
   one group: registers give a collision-corrected estimate for each pair,
   pairs that could reach the threshold are verified on the full sets, and
   the group returns a spanning forest of its true links, never all pairs;
4. components of the links.

Defined cases: null or blank texts have an empty set and are linked with
nothing; texts with fewer than ``k`` words count as one shingle of the whole
sequence; repeated rows link with each other like any equal texts; documents
sharing an id are separate (``common.keyed``); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .common import is_id, keyed, staged, temporary
from .graph import components

BUCKETS = 240
ROWS = 5
MANTISSA = 11
EMPTY = np.uint16(0xFFFF)
BLOCK_DOCS = 512
BLOCK_SHINGLES = 400_000
#: Pairs whose estimate lies this many standard errors below the threshold
#: are not verified.
MARGIN = 6.0

_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a chunk, sorted."""
    s, e, d = textops.word_spans(data, offsets)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = textops.range_hash(textops.prefix_hash(textops.LOWER[data]), s, e)
    n_docs = len(offsets) - 1
    begin = np.searchsorted(d, np.arange(n_docs + 1))
    size = np.diff(begin)
    prefix = textops.prefix_hash(w)
    at = np.arange(max(0, len(w) - k + 1))
    at = at[d[at] == d[at + k - 1]]
    short = np.flatnonzero((size > 0) & (size < k))
    doc = np.concatenate([d[at], short])
    h = np.concatenate([textops.range_hash(prefix, at, at + k),
                        textops.range_hash(prefix, begin[short], begin[short + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def registers(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Compressed registers, one row per document."""
    least = np.full(n_docs * BUCKETS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    bucket = ((h >> _U(32)) * _U(BUCKETS)) >> _U(32)
    value = np.maximum(textops.mix(h, 7) >> _U(1), _U(1))  # below 2^63, so an empty bucket is told apart
    np.minimum.at(least, doc * BUCKETS + bucket.astype(np.int64), value)
    full = least != _U(0xFFFFFFFFFFFFFFFF)
    v = least[full] << _U(1)
    _, exponent = np.frexp((v >> _U(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 30).astype(np.uint64)
    mantissa = (v << (zeros + _U(1))) >> _U(64 - MANTISSA)
    out = np.full(n_docs * BUCKETS, EMPTY, np.uint16)
    out[full] = ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)
    return out.reshape(n_docs, BUCKETS)


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty buckets take the register of a full one, looked for in an order
    that depends on the bucket only (optimal densification): every register
    then agrees with the chance of a common minimum, also for short texts.
    Rows without any register stay empty."""
    out = regs.ravel().copy()
    some = (regs != EMPTY).any(axis=1)
    todo = np.flatnonzero((regs == EMPTY).ravel() & np.repeat(some, BUCKETS))
    base = todo // BUCKETS * BUCKETS
    flat = regs.ravel()
    attempt = 0
    while len(todo):
        attempt += 1
        step = (textops.mix(np.arange(BUCKETS, dtype=np.uint64), 1000 + attempt) % _U(BUCKETS)).astype(np.int64)
        got = flat[base + step[todo - base]]
        hit = got != EMPTY
        out[todo[hit]] = got[hit]
        todo, base = todo[~hit], base[~hit]
    return out.reshape(regs.shape)


def collision(sizes: np.ndarray) -> np.ndarray:
    """Chance that two different minima share a register, for every pair of
    set sizes: equal leading zeros times an equal mantissa."""
    load = (np.asarray(sizes, float) / BUCKETS)[:, None]
    z = np.arange(31)
    p = np.exp(-load * 2.0 ** -(z + 1)) - np.exp(-load * 2.0 ** -z)
    full = 1 - np.exp(-load)
    p = p / np.maximum(full, 1e-300)
    return (p @ p.T) / (1 << MANTISSA)


def estimate(regs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate and its standard error at the
    estimate's own sample size, for every pair of documents."""
    g = len(regs)
    same, either = np.zeros((g, g)), np.zeros((g, g))
    filled = regs != EMPTY
    for i in range(g):
        both = filled[i] & filled[i:]
        same[i, i:] = ((regs[i:] == regs[i]) & both).sum(axis=1)
        either[i, i:] = (filled[i] | filled[i:]).sum(axis=1)
    same, either = np.triu(same) + np.triu(same, 1).T, np.triu(either) + np.triu(either, 1).T
    either = np.maximum(either, 1)
    chance = collision(sizes)
    return (same / either - chance) / (1 - chance), either


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = textops.buffers(b.column(1))
            out = []
            for i, j in textops.chunks(offsets):
                lo, hi = offsets[i], offsets[j]
                doc, h = shingles(data[lo:hi], offsets[i:j + 1] - lo, k)
                n = np.bincount(doc, minlength=j - i)
                sums = []
                for salt in (11, 12):  # sums of mixed hashes name the set
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textops.mix(h, salt))])
                    end = np.cumsum(n)
                    sums.append(total[end] - total[end - n])
                out.append((n, sums[0].view(np.int64), sums[1].view(np.int64), registers(doc, h, j - i)))
            n, h1, h2, regs = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2),
                 pa.array([r.tobytes() if c else None for r, c in zip(regs, n, strict=True)], pa.binary())],
                names=["uid", "n", "h1", "h2", "registers"])
    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, registers) -> (key, uid, hub): the smallest member of a key in
    this batch stands for the key, the others point to it (hub)."""
    for b in batches:
        if not b.num_rows:
            continue
        uid = b.column(0).to_numpy()
        regs = densified(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(uid), BUCKETS))
        regs = regs.reshape(len(uid), BUCKETS // ROWS, ROWS)
        key = np.zeros(regs.shape[:2], np.uint64)
        for r in range(ROWS):
            key = textops.mix(key ^ regs[:, :, r].astype(np.uint64), r)
        key = textops.mix(key + np.arange(regs.shape[1], dtype=np.uint64)[None, :], 99)
        key, who = key.ravel(), np.repeat(uid, regs.shape[1])
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        hub = who[np.flatnonzero(first)][np.cumsum(first) - 1]
        pairs = np.unique(np.stack([who[~first], hub[~first]], 1), axis=0)
        spread = textops.mix(pairs[:, 0].astype(np.uint64) ^ textops.mix(pairs[:, 1].astype(np.uint64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([key[first], spread]).view(np.int64)),
             pa.array(np.concatenate([who[first], pairs[:, 0]])),
             pa.array(np.concatenate([np.zeros(int(first.sum()), np.int64), pairs[:, 1]]),
                      mask=np.concatenate([np.ones(int(first.sum()), bool), np.zeros(len(pairs), bool)]))],
            names=["key", "uid", "hub"])


def _sets(k: int):
    """(uid, text, cluster, blocks) -> (cluster, uid, block, blocks, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = textops.buffers(b.column(1))
            out = []
            for i, j in textops.chunks(offsets):
                lo, hi = offsets[i], offsets[j]
                doc, h = shingles(data[lo:hi], offsets[i:j + 1] - lo, k)
                out += [x.view(np.int64) for x in np.split(h, np.searchsorted(doc, np.arange(1, j - i)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(out, pa.list_(pa.int64()))],
                                             names=["uid", "cluster", "blocks", "shingles"])
    return run


def _intersections(sets: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the common parts for the wanted pairs (a symmetric mask)."""
    g = len(sets)
    out = np.zeros((g, g))
    pairs = np.argwhere(np.triu(wanted, 1))
    if len(pairs) <= 2 * g:
        for i, j in pairs:
            out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    row = np.repeat(np.arange(g), [len(s) for s in sets])
    value, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1  # only shingles of two documents or more count
    keep = n[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((g, width), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left = np.ones(len(links), bool)
    out = []
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(links[i] & left)
            left[new] = False
            out += [(i, int(j)) for j in new]
            queue += new.tolist()
    return out


def _verify(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        uid, block = group["uid"].to_numpy(), group["block"].to_numpy()
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in group["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        doc = np.repeat(np.arange(len(sets)), sizes)
        regs = registers(doc, np.concatenate(sets), len(sets))
        guess, sample = estimate(regs, sizes)
        t = num / den
        wanted = guess >= t - MARGIN * np.sqrt(t * (1 - t) / sample) - 0.01
        if (block != block[0]).any():  # two blocks: pairs within one belong to its own group
            wanted &= block[:, None] != block[None, :]
        np.fill_diagonal(wanted, False)
        edges = []
        if wanted.any():
            common = _intersections(sets, wanted)
            links = wanted & (den * common >= num * (sizes[:, None] + sizes[None, :] - common))
            edges = forest(links)
        a = uid[[i for i, _ in edges]] if edges else np.zeros(0, np.int64)
        b = uid[[j for _, j in edges]] if edges else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def links(docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(a, b)``: true links between class representatives, enough of them
    to connect whatever is connected."""
    members = reps.select("uid", "registers").mapInArrow(_bands, "key long, uid long, hub long")
    hub = F.coalesce("hub", F.min("uid").over(Window.partitionBy("key")))
    pointers = members.select("uid", hub.alias("hub")).filter("uid <> hub").distinct()
    clustered = components(pointers.select(F.col("uid").alias("a"), F.col("hub").alias("b")))
    sized = clustered.join(reps.select("uid", "n"), F.col("node") == F.col("uid")).select("uid", "n", "component")
    blocks = sized.groupBy(F.col("component").alias("_c")).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    todo = sized.join(blocks, F.col("component") == F.col("_c")).select(
        F.col("uid").alias("_u"), F.col("component").alias("cluster"), "blocks")
    sets = (docs.select("_uid", "_text").join(todo, F.col("_uid") == F.col("_u"))
            .select(F.col("_uid").alias("uid"), "_text", "cluster", "blocks")
            .mapInArrow(_sets(k), "uid long, cluster long, blocks int, shingles array<long>"))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    grid = (sets.select("*", other)
            .select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                    "uid", "block", "shingles"))
    return grid.groupBy("cluster", "low", "high").applyInArrow(_verify(num, den), "a long, b long")


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(uid, n, component)`` of keyed documents: size of the set and the
    smallest document reachable over links with
    ``den * intersection >= num * union``."""
    with temporary(docs.sparkSession):
        sketch = staged(docs.select("_uid", "_text").mapInArrow(
            _sketch(k), "uid long, n long, h1 long, h2 long, registers binary"))
        full = sketch.filter("n > 0")
        same = full.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min("uid").alias("rep"))
        reps = full.join(same.select(F.col("rep")), F.col("uid") == F.col("rep"), "left_semi")
        linked = staged(components(links(docs, reps, k, num, den)))
        # written, so that both sides of the last join are plain exchanges: a large class
        # of copies on the left is then split among tasks
        named = staged(same.join(linked, F.col("rep") == F.col("node"), "left").select(
            "_h1", "_h2", F.coalesce("component", "rep").alias("_component")))
        out = (sketch.select("uid", "n", "h1", "h2")
                .join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") > 0), "left")
                .select("uid", "n", F.coalesce("_component", "uid").alias("component")))
        return staged(out, outlives=True)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest
    id reachable), ``kept`` (its id names its component: rows that share it
    are all kept here; ``apply`` keeps one)."""
    rows = keyed(docs, id_col, text_col)
    found = classes(rows, k, num, den)
    if is_id(rows):
        kind = docs.schema[id_col].dataType
        return found.select(F.col("uid").cast(kind).alias(id_col), F.col("n").alias("n_shingles"),
                            F.col("component").cast(kind).alias("component_id"),
                            (F.col("component") == F.col("uid")).alias("kept"))
    ids = rows.select(F.col("_uid"), F.col("_row").getField(id_col).alias("_id"))
    own = found.join(ids, F.col("uid") == F.col("_uid")).select("uid", "n", "component", "_id")
    names = ids.select(F.col("_uid").alias("_c"), F.col("_id").alias("_name"))
    return own.join(names, F.col("component") == F.col("_c")).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_name").alias("component_id"),
        F.col("_id").eqNullSafe(F.col("_name")).alias("kept"))


def apply(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The documents with one row of every group of near duplicates kept
    (the smallest id); all input columns."""
    rows = keyed(docs, id_col, text_col)
    dropped = classes(rows, k, num, den).filter("component <> uid").select(F.col("uid").alias("_u"))
    left = rows.join(dropped, F.col("_uid") == F.col("_u"), "left_anti")
    return left.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
