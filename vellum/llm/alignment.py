"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE (``tokenizers`` file, run through tiktoken's merge
loop), B a sentencepiece model; both see a blank followed by the text. Tokens
are byte ranges, so a document is two ascending lists of ends. Where both end
the text is cut: the tokens between two cuts form a group, and the last two
tokens of a group, which end together, are a link.

All documents of a batch are merged in lockstep: one numpy vector of pointers
per side, one entry per lane (a document, or a stretch of ``LANE`` bytes of a
longer one: merging only looks at ends, so it can begin at any byte). A step
compares the ends that all lanes point at, emits links where they are equal,
advances the side that is behind (both at a link) and compacts the vectors
when half of the lanes have finished. A batch therefore takes at most
2 * ``LANE`` steps, however long its texts are.

How often a pair of ids is linked in the corpus is needed for every link
again. Documents are staged with their distinct pairs and multiplicities;
pair counts come from partial sums per task. The ``TOP`` most frequent pairs
go to all tasks (a table of fixed size), and pairs beyond it meet their count
in a shuffle, which carries rare pairs only. A B id's highest count is one
number per vocabulary entry.

Defined cases: null and empty texts have no tokens, nor have texts that a
tokenizer does not give back byte by byte (sentencepiece normalises some);
strings of special tokens inside texts are plain text; repeated rows and rows
that share an id count each for itself; an empty table gives no rows; other
columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, staged, temporary
from .packing import default_tokenizer, encoder

LANE = 1 << 11
BATCH_BYTES = 1 << 21
TOP = 1 << 20
ID_BITS = 32  # a pair is one long: id of A above, id of B below


def default_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """Bytes and lengths of a vocabulary, and its decimal ids for printing."""

    def __init__(self, entries: list[bytes], endings: tuple[bytes, ...]):
        self.bytes = np.empty(len(entries), object)
        self.bytes[:] = entries
        self.length = np.array([len(x) for x in entries], np.int64)
        self.printed = np.empty(len(endings) * len(entries), object)
        self.printed[:] = [b"%d%s" % (i, end) for end in endings for i in range(len(entries))]


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = encoder(a_path)
        ranks = self.a.fast._mergeable_ranks
        entries = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            entries[i] = token
        self.side_a = Side(entries, (b",", b"|"))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)

        def piece(i: int) -> bytes:
            if self.b.is_byte(i):
                return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
            if self.b.is_control(i) or self.b.is_unknown(i):
                return b""
            return self.b.id_to_piece(i).replace("▁", " ").encode()
        self.side_b = Side([piece(i) for i in range(self.b.get_piece_size())], (b",", b";", b""))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids per text of both sides; empty where a side does not give the
        bytes back."""
        a = [self.a.fast.encode_to_numpy(" " + t, disallowed_special=()) if t else _NONE for t in texts]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        for i, t in enumerate(texts):
            raw = b" " + t.encode()
            if not t or (b"".join(self.side_a.bytes[a[i]].tolist()) != raw
                         or b"".join(self.side_b.bytes[b[i]].tolist()) != raw
                         or not self.side_b.length[b[i]].all()):
                a[i] = b[i] = _NONE
        return a, b


_NONE = np.zeros(0, np.int64)
_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, stop_a: np.ndarray,
             stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of tokens that end together: lane l walks tokens ``at_a[l]``
    to ``stop_a[l]`` of A and likewise of B, all lanes one step at a time."""
    links_a, links_b = [], []
    i, j, last_i, last_j = at_a.copy(), at_b.copy(), stop_a, stop_b
    while True:
        alive = (i < last_i) & (j < last_j)
        n = int(np.count_nonzero(alive))
        if not n:
            break
        if 2 * n <= len(i):  # compact finished lanes
            i, j, last_i, last_j = i[alive], j[alive], last_i[alive], last_j[alive]
            alive = alive[alive]
        # a finished lane looks at its last tokens and stays
        x, y = end_a[np.minimum(i, last_i - 1)], end_b[np.minimum(j, last_j - 1)]
        equal = (x == y) & alive
        links_a.append(i[equal])
        links_b.append(j[equal])
        i = i + ((x <= y) & alive)
        j = j + ((y <= x) & alive)
    if not links_a:
        return _NONE, _NONE
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def merge(ids_a: list[np.ndarray], ids_b: list[np.ndarray], side_a: Side, side_b: Side,
          lane: int = LANE) -> tuple[np.ndarray, ...]:
    """``(flat ids of A, of B, document offsets in A, in B, link places in A,
    in B, link offsets)`` of a batch, links in the order of the text."""
    docs = len(ids_a)
    off_a = np.concatenate([[0], np.cumsum([len(x) for x in ids_a])]).astype(np.int64)
    off_b = np.concatenate([[0], np.cumsum([len(x) for x in ids_b])]).astype(np.int64)
    flat_a = np.concatenate([*ids_a, _NONE]).astype(np.int64)
    flat_b = np.concatenate([*ids_b, _NONE]).astype(np.int64)
    # ends run on over all documents: both sides have the same bytes, so they stay in step
    end_a, end_b = np.cumsum(side_a.length[flat_a]), np.cumsum(side_b.length[flat_b])
    total = np.concatenate([[0], end_a])[off_a]
    size = np.diff(total)
    lanes = -(-size // lane)
    doc = np.repeat(np.arange(docs), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    low = total[:-1][doc] + nth * lane  # a lane takes the ends in (low, high]
    high = np.minimum(low + lane, total[1:][doc])
    at = [np.searchsorted(end, edge, side="right") for end in (end_a, end_b) for edge in (low, high)]
    link_a, link_b = lockstep(end_a, end_b, at[0], at[2], at[1], at[3])
    off_links = np.searchsorted(link_a, off_a)
    return flat_a, flat_b, off_a, off_b, link_a, link_b, off_links


def printed(flat_a, flat_b, off_a, off_b, link_a, link_b, off_links, side_a: Side, side_b: Side) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    n_a, n_b = len(flat_a), len(flat_b)
    mark_a, mark_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    mark_a[link_a] = 1  # the last token of A in a group
    mark_b[link_b] = 1
    last = off_b[1:][np.diff(off_b) > 0] - 1
    mark_b[last] = 2  # nothing behind a document's last token
    # tokens in printing order: A's of a group, then B's
    before_a = np.cumsum(mark_a) - mark_a  # groups closed before a token
    before_b = np.cumsum(mark_b > 0) - (mark_b > 0)
    closed_b = np.concatenate([[0], link_b + 1])
    place_a = np.arange(n_a) + closed_b[before_a]
    place_b = np.arange(n_b) + link_a[before_b] + 1 if n_b else np.zeros(0, np.int64)
    stream = np.empty(n_a + n_b, object)
    stream[place_a] = side_a.printed[flat_a + mark_a * len(side_a.bytes)]
    stream[place_b] = side_b.printed[flat_b + mark_b * len(side_b.bytes)]
    begin = off_a + off_b
    return [b"".join(stream[s:e].tolist()) for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def pair_counts(flat_a, flat_b, link_a, link_b, off_links) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(offsets, pairs, times)``: distinct linked pairs of every document,
    ascending, with their multiplicity."""
    docs = len(off_links) - 1
    code = (flat_a[link_a] << ID_BITS) | flat_b[link_b]
    doc = np.repeat(np.arange(docs), np.diff(off_links))
    distinct, number = np.unique(code, return_inverse=True)
    key = np.sort(doc * max(len(distinct), 1) + number)
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    heads = np.flatnonzero(first)
    times = np.diff(np.append(heads, len(key)))
    offsets = np.searchsorted(key[heads], np.arange(docs + 1) * max(len(distinct), 1))
    pairs = distinct[key[heads] % max(len(distinct), 1)] if len(heads) else _NONE
    return offsets, pairs, times


STAGED = "uid long, n_a long, n_b long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _batches(col: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BATCH_BYTES`` characters, at least one each."""
    i, held = 0, 0
    for j, t in enumerate(col):
        if j > i and held + len(t) > BATCH_BYTES:
            yield i, j
            i, held = j, 0
        held += len(t)
    if i < len(col):
        yield i, len(col)


def aligned(rows: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """``STAGED`` columns of keyed rows (``_uid, _text``); ``with_groups``
    adds the groups themselves as text."""
    schema = STAGED + (", groups string" if with_groups else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in _batches(texts):
                a_ids, b_ids = both.encode(texts[i:j])
                merged = merge(a_ids, b_ids, both.side_a, both.side_b)
                flat_a, flat_b, off_a, off_b, link_a, link_b, off_links = merged
                text = printed(*merged, both.side_a, both.side_b)
                at, pairs, times = pair_counts(flat_a, flat_b, link_a, link_b, off_links)
                lists = pa.array(at, pa.int32())
                columns = [b.column(0).slice(i, j - i), pa.array(np.diff(off_a)), pa.array(np.diff(off_b)),
                           pa.array(np.diff(off_links)),
                           pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in text], pa.string()),
                           pa.ListArray.from_arrays(lists, pa.array(pairs, pa.int64())),
                           pa.ListArray.from_arrays(lists, pa.array(times, pa.int32()))]
                if with_groups:
                    columns.append(pa.array([x.decode() for x in text], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])
    return rows.select("_uid", "_text").mapInArrow(run, schema)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of a task, summed before they leave it."""
    pairs, counts = _NONE, _NONE
    for b in batches:
        p = b.column(0).flatten().to_numpy(zero_copy_only=False)
        n = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, where = np.unique(np.concatenate([pairs, p]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
        if len(pairs) > 1 << 22:  # a task holds no more
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
            pairs, counts = _NONE, _NONE
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])


def counted(table: DataFrame) -> DataFrame:
    """``(pair, a, b, n, best)``: how often every pair of ids is linked in
    the corpus, and whether no other pair of its B id is linked more often."""
    counts = table.select("pairs", "times").mapInArrow(_partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = staged(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))))
    highest = counts.groupBy(F.col("b").alias("_b")).agg(F.max("n").alias("_most"))
    # one row per id of a vocabulary
    return counts.join(F.broadcast(highest), F.col("b") == F.col("_b")).select(
        "pair", F.shiftright("pair", ID_BITS).alias("a"), "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def _look_up(top) -> callable:
    """(uid, pairs, times) -> sums over frequent pairs, and the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = top.value
        for b in batches:
            lists, times = b.column(1), b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            if len(keys):
                where = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                known = keys[where] == pairs
                total = np.where(known, counts[where], 0) * times
                chosen = np.where(known & best[where], times, 0)
            else:
                known, total, chosen = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            rare = np.flatnonzero(~known)
            off = pa.array(np.searchsorted(rare, at), pa.int32())
            running = [np.concatenate([[0], np.cumsum(x)]) for x in (chosen, total)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x[at[1:]] - x[at[:-1]], pa.int64()) for x in running],
                 pa.ListArray.from_arrays(off, pa.array(pairs[rare], pa.int64())),
                 pa.ListArray.from_arrays(off, pa.array(times[rare], pa.int64()))],
                names=["uid", "n_best", "count_sum", "pairs", "times"])
    return run


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, top: int = TOP, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    spark = docs.sparkSession
    with temporary(spark):
        rows = keyed(docs, id_col, text_col)
        table = staged(aligned(rows, a_path or default_tokenizer(), b_path or default_pieces()))
        counts = counted(table)
        often = counts.orderBy(F.desc("n"), "pair").limit(top).toPandas()  # at most `top` rows, a few numbers each
        often = often.sort_values("pair")
        shared = spark.sparkContext.broadcast((often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64),
                                               often["best"].to_numpy(bool)))
        found = table.select("uid", "pairs", "times").mapInArrow(
            _look_up(shared), "uid long, n_best long, count_sum long, pairs array<long>, times array<long>")
        if len(often) == top:  # there may be rarer pairs: they meet their counts by a join
            found = staged(found)
            single = found.filter(F.size("pairs") > 0).select(
                "uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", "x.pairs", "x.times")
            rest = single.join(counts.select("pair", "n", "best"), F.col("pairs") == F.col("pair")).groupBy("uid").agg(
                F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
                F.sum(F.col("times") * F.col("n")).alias("_sum")).withColumnRenamed("uid", "_v")
            found = found.join(rest, F.col("uid") == F.col("_v"), "left").select(
                "uid", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
                (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))
        found = found.select(F.col("uid").alias("_u"), "n_best", "count_sum")
        done = table.select("uid", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "groups_sha256").join(
            found, F.col("uid") == F.col("_u"))
        ids = rows.select("_uid", F.col("_row").getField(id_col).alias(id_col))
        return staged(ids.join(done, F.col("_uid") == F.col("uid")).select(
            id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), outlives=True)
