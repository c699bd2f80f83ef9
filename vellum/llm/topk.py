"""Exact top-k inner product with MaxScore, shard by shard.

Rows are sparse integer vectors (terms, weights). A shard keeps two posting
lists per term, one for positive and one for negative weights, so every list
has a one-sided contribution: lists that agree with the sign of the query's
weight add up to ``|q| * max|w|``, the others add at most 0. Per query, lists
are sorted by that bound; the longest run of weak lists whose bounds sum to
less than the current k-th score is non-essential. Only essential lists are
traversed; the other lists, and those that can only lower a score, are probed,
strongest first, for the rows that are still competitive under the bounds that
remain. Ties are kept competitive, so equal scores always resolve to the
smaller id. A list that covers much of its shard is kept as one weight per
row, any other as (row, weight) pairs. Each (query block, shard) pair
is one bounded task group; its k best are merged per query by a window.

The query set is a parameter: queries against all rows, in blocks.
Defined cases: rows with a null, empty of valid parts or non-finite vector
take no part (``quantise``); several rows with one id count once (the
smallest vector); a query never meets rows with its own id; fewer than k
candidates give as many rows; no queries or rows give no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.ordered import with_global_index

SHARD_ROWS = 16384
QUERY_BLOCK = 2048
#: A list over more than this share of the shard's rows is kept dense.
DENSE = 1 / 16
#: Lists probed between two prunings.
PRUNE_EVERY = 4


def quantise(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, name, terms, weights)``: one row per vector with weight
    floor(scale * x), zero weights left out. ``name`` is the vector's id;
    ``id`` is it too where ids are unique, else a number of the row in the
    order of (id, weights), so rows that share an id are vectors of their own."""
    x = F.col(f"`{vector_col}`")
    doubles = F.transform(x, lambda v: v.cast("double"))
    whole = vectors.select(F.col(f"`{id_col}`").cast("long").alias("name"), doubles.alias("x")).filter(
        F.col("name").isNotNull() & F.col("x").isNotNull()
        & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))
    weights = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    pairs = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size("x") - 1).alias("t"), weights.alias("w")),
                     lambda p: p["w"] != 0)
    pairs = F.when(F.size("x") == 0, F.filter(F.arrays_zip(F.array(F.lit(0)).alias("t"), F.array(F.lit(0).cast("long"))
                                                           .alias("w")), lambda p: p["w"] != 0)).otherwise(pairs)
    rows = whole.select("name", pairs.alias("p"))
    if rows.groupBy("name").count().filter("count > 1").isEmpty():
        numbered = rows.withColumn("id", F.col("name"))
    else:
        numbered = with_global_index(rows, ["name", "p"], idx="id")
    return numbered.select("id", "name", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))


def named(found: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``maxscore`` rows with the ids of the vectors in place of row numbers."""
    other = rows.select(F.col("id").alias("_i"), F.col("name").alias("_name"))
    own = queries.select(F.col("id").alias("_q"), F.col("name").alias("_own"))
    return found.join(other, F.col("id") == F.col("_i")).join(own, F.col("query_id") == F.col("_q")).select(
        F.col("_own").alias("query_id"), "rank", F.col("_name").alias("id"), "score")


class Shard:
    """Posting lists of one shard and exact top-k over them."""

    def __init__(self, ids: np.ndarray, rows: list[np.ndarray], terms: list[np.ndarray], weights: list[np.ndarray]):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        row = place[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
        term = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        weight = np.concatenate(weights) if weights else np.zeros(0, np.int64)
        self.lists: dict[tuple[int, bool], tuple[np.ndarray | None, np.ndarray, int]] = {}
        key = term * 2 + (weight > 0)
        by = np.lexsort((row, key))
        key, row, weight = key[by], row[by], weight[by]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        for s, e in zip(cut, [*cut[1:], len(key)], strict=True):
            at, w, most = row[s:e], weight[s:e], int(np.abs(weight[s:e]).max())
            w = w.astype(np.int32) if most < 1 << 31 else w
            if e - s > DENSE * len(ids):
                every = np.zeros(len(ids), w.dtype)
                every[at] = w
                at, w = None, every
            self.lists[int(key[s]) // 2, bool(key[s] & 1)] = (at, w, most)

    def probe(self, term: int, positive: bool, rows: np.ndarray) -> np.ndarray:
        """Weights of ``rows`` (sorted) in one list, 0 where absent."""
        at, weight, _ = self.lists[term, positive]
        if at is None:
            return weight[rows]
        i = np.minimum(np.searchsorted(at, rows), len(at) - 1)
        return np.where(at[i] == rows, weight[i], 0)

    def strongest(self, term: int, positive: bool, n: int) -> np.ndarray:
        at, weight, _ = self.lists[term, positive]
        size = np.abs(weight)
        best = np.argpartition(-size, n)[:n] if len(size) > n else np.flatnonzero(size)
        return best if at is None else at[best]

    def score(self, query: list[tuple[int, int]], rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        for t, q in query:
            for sign in (True, False):
                if (t, sign) in self.lists:
                    out += q * self.probe(t, sign, rows)
        return out

    def top(self, own: int, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        query = list(zip(terms.tolist(), weights.tolist(), strict=True))
        free = self.ids != own
        if not free.any():
            return []
        gain = sorted((abs(q) * self.lists[t, q > 0][2], t, q) for t, q in query if (t, q > 0) in self.lists)
        loss = [(abs(q) * self.lists[t, q < 0][2], t, q) for t, q in query if (t, q < 0) in self.lists]
        # narrow sums where no score can overflow them
        kind = np.int32 if sum(g[0] for g in gain) + sum(x[0] for x in loss) < 1 << 31 else np.int64
        seeds = [np.flatnonzero(free)[:k]]
        for _, t, q in gain[-4:]:  # rows with the strongest weights of the strongest lists
            best = self.strongest(t, q > 0, 16 * k)
            seeds.append(best[free[best]])
        rows = np.unique(np.concatenate(seeds))
        got = self.score(query, rows)
        enough = len(got) >= k
        floor = int(np.partition(got, -k)[-k]) if enough else 0
        bounds = np.cumsum([0] + [g[0] for g in gain])  # bounds[i]: of the i weakest lists
        weak = int(np.searchsorted(bounds, floor, side="left")) - 1 if enough and floor > 0 else -1
        if weak < 0:  # every row may compete: nothing can be left out
            rows = np.flatnonzero(free)
            got = self.score(query, rows)
        else:
            weak = min(weak, len(gain))
            acc = np.zeros(len(self.ids), kind)  # essential lists only add
            for _, t, q in gain[weak:]:
                at, w, _ = self.lists[t, q > 0]
                if at is None:
                    acc += np.multiply(w, q, dtype=kind)
                else:
                    acc[at] += np.multiply(w, q, dtype=kind)
            rest = int(bounds[weak])
            rows = np.flatnonzero((acc > 0) & free & (acc + rest >= floor))
            got = acc[rows]
            others = sorted([(*g, True) for g in gain[:weak]] + [(*x, False) for x in loss], reverse=True)
            for n, (bound, t, q, adds) in enumerate(others, 1):
                got = got + np.multiply(self.probe(t, (q > 0) == adds, rows), q, dtype=kind)
                rest -= bound * adds
                if n % PRUNE_EVERY == 0 or n == len(others):
                    alive = got >= floor - rest
                    rows, got = rows[alive], got[alive]
        if len(got) > k:  # rows below the k-th score cannot be among the k best
            alive = got >= np.partition(got, -k)[-k]
            rows, got = rows[alive], got[alive]
        best = np.lexsort((self.ids[rows], -got))[:k]
        return [(int(self.ids[rows[i]]), int(got[i])) for i in best]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column."""
    arr = column.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], column.type)
    sizes = np.diff(arr.offsets.to_numpy())
    return arr.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(arr)), sizes)


def maxscore(rows: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS,
             query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, id, score)``: the k best rows of every query.
    Both inputs are ``(id, terms, weights)`` with one row per id."""
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_block))
    cols = ["id", "terms", "weights"]
    at = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    # each side goes once to every block of the other
    grid = (rows.select(*cols, at, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"))
            .unionByName(queries.select(
                *cols, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"))))

    def search(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy()
        data, asked = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
        out: list[tuple[int, int, int]] = []
        if len(data) and len(asked):
            terms, row = _flat(data["terms"])
            weights, _ = _flat(data["weights"])
            shard = Shard(data["id"].to_numpy(), [row], [terms.astype(np.int64)], [weights])
            for own, t, w in zip(asked["id"].to_pylist(), asked["terms"].to_pylist(), asked["weights"].to_pylist(),
                                 strict=True):
                out += [(own, i, s) for i, s in
                        shard.top(own, np.array(t, np.int64), np.array(w, np.int64), k)]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.int64())})

    found = grid.groupBy("block", "shard").applyInArrow(search, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
