"""Quality rules on the repetition inside a document, by suffix arrays.

Texts are taken as sequences of words. For a chunk of documents at once the
suffixes of all documents are sorted by prefix doubling: after the round of
length h, suffixes of one document share a rank when their first h words are
equal; only suffixes that still share one are sorted again. The ranks of every
round are kept, so the common prefix of neighbours in the suffix array is
found by taking the rounds from the longest to the shortest: where the ranks
are equal, both suffixes advance by h.

Intervals of the common-prefix array are the repeated substrings that cannot
be extended to the right; those whose occurrences are preceded by different
words are maximal. An occurrence that starts at a word reaches as far as the
deepest interval around its suffix, which is the larger common prefix with
its two neighbours, so the union of all spans takes one pass.

A document is rejected when repeated substrings of ``MIN_REPEAT`` words or
more cover more than ``MAX_COVERED`` of its words, or when the longest one has
more than ``MAX_LONGEST`` words; and when it fails the base rules (fewer than
``MIN_WORDS`` words, or more than half of them in repeated 3-word windows).

Words and lines are compared by 64-bit hashes inside one chunk (128 kB, or one
longer document).

Defined cases: null and empty texts have no words and fail the base rules;
repeated rows and rows sharing an id are judged each for itself; an empty
table gives no rows; other columns are carried by ``keep`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

MIN_WORDS = 50
BASE_WINDOW = 3
MIN_REPEAT = 8
MAX_COVERED = 0.5
MAX_LONGEST = 100

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class Suffixes:
    """Suffix array of a chunk: ``order`` lists word positions, document by
    document; ``common[i]`` is the common prefix of entries i - 1 and i."""

    order: np.ndarray
    common: np.ndarray
    deepest: np.ndarray  # per word: longest repeated substring that starts there

    @classmethod
    def of(cls, words: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> Suffixes:
        """``words``: a hash per word; ``doc``: its document, ascending;
        ``ends``: where that document ends."""
        n = len(words)
        if not n:
            z = np.zeros(0, np.int64)
            return cls(z, z, z)
        _, word = np.unique(words, return_inverse=True)
        key = doc.astype(np.int64) * (int(word.max()) + 1) + word
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int32)
        rounds: list[np.ndarray] = []
        # `open_`: entries of `order` whose rank is shared; a rank is the first entry that has it
        head = np.ones(n, bool)
        np.not_equal(key[order[1:]], key[order[:-1]], out=head[1:])
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = first
        h = 1
        while True:
            shared = np.zeros(n, bool)  # entries beside one of the same rank
            same = first[1:] == first[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            open_ = np.flatnonzero(shared)
            if not len(open_):
                break
            rounds.append(rank.copy())
            at = order[open_]
            beyond = at + h
            inside = beyond < ends[at]
            second = np.zeros(len(at), np.int64)  # 0: the document ends, before any word
            second[inside] = rank[beyond[inside]].astype(np.int64) + 1
            both = first[open_].astype(np.int64) * (n + 1) + second
            by = np.argsort(both, kind="stable")
            order[open_] = at[by]
            both = both[by]
            head = np.ones(len(both), bool)
            np.not_equal(both[1:], both[:-1], out=head[1:])
            first[open_] = open_[np.maximum.accumulate(np.where(head, np.arange(len(both)), 0))]
            rank[order[open_]] = first[open_]
            h *= 2
        common = _common(order, rounds, ends)
        deepest = np.empty(n, np.int64)
        deepest[order] = np.maximum(common, np.append(common[1:], 0))
        return cls(order, common, deepest)

    def maximal(self, words: np.ndarray, starts: np.ndarray, least: int) -> list[tuple[int, int, int]]:
        """``(first place, length, occurrences)`` of every maximal repeated
        substring of ``least`` words or more; ``starts``: where the document
        of a word begins. Only runs of entries with such a common prefix are
        walked."""
        n = len(self.order)
        before = np.where(self.order > starts[self.order], words[self.order - 1], np.uint64(0)) if n else words[:0]
        lonely = self.order == starts[self.order] if n else np.zeros(0, bool)
        varied = np.zeros(n, bool)  # the word before differs from that of the entry above
        varied[1:] = (before[1:] != before[:-1]) | lonely[1:] | lonely[:-1]
        changes = np.cumsum(varied)
        out = []
        long = self.common >= least
        edge = np.diff(np.concatenate([[0], long.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            stack: list[tuple[int, int]] = []  # (length, first entry) of open intervals
            for i, v in enumerate([*self.common[a:b].tolist(), 0], a):
                left = i - 1
                while stack and stack[-1][0] > v:
                    length, left = stack.pop()
                    if changes[i - 1] > changes[left]:
                        out.append((int(self.order[left:i].min()), length, i - left))
                if v >= least and (not stack or stack[-1][0] < v):
                    stack.append((v, left))
        return out


def _common(order: np.ndarray, rounds: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Common prefix of every entry with the one above it."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if not rounds or n < 2:
        return out
    pairs = np.flatnonzero(rounds[0][order[1:]] == rounds[0][order[:-1]]) + 1  # those that share a word
    a, b = order[pairs - 1].copy(), order[pairs].copy()
    length = np.zeros(len(pairs), np.int64)
    enda, endb = ends[a], ends[b]
    for r in range(len(rounds) - 1, -1, -1):
        ok = np.flatnonzero((a < enda) & (b < endb))
        ok = ok[rounds[r][a[ok]] == rounds[r][b[ok]]]
        length[ok] += 1 << r
        a[ok] += 1 << r
        b[ok] += 1 << r
    out[pairs] = length
    return out


def covered(reach: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word lies in a span: ``reach`` words from each word on,
    never beyond its document."""
    n = len(reach)
    delta = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(reach)
    np.add.at(delta, at, 1)
    np.add.at(delta, np.minimum(at + reach[at], ends[at]), -1)
    return np.cumsum(delta[:n]) > 0


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(docs, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 10
    cut[offsets] = True  # a line begins after a line feed and with a document
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10)
    doc = np.searchsorted(offsets, start, side="right") - 1
    filled = np.concatenate([[0], np.cumsum(~textops.IS_BLANK[data])])
    has = filled[end] > filled[start]
    start, end, doc = start[has], end[has], doc[has]
    key = textops.range_hash(textops.prefix_hash(data), start, end)
    order = np.lexsort((key, doc))
    again = np.zeros(len(order), bool)
    again[1:] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return np.bincount(doc[order[again]], minlength=docs).astype(np.int64)


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
           "n_covered": "long", "longest_repeat": "long"}


def measures(data: np.ndarray, offsets: np.ndarray, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """``COLUMNS`` of every document of a chunk."""
    s, e, doc = textops.word_spans(data, offsets)
    docs = len(offsets) - 1
    at = np.searchsorted(doc, np.arange(docs + 1))
    ends = at[1:][doc]
    words = textops.range_hash(textops.prefix_hash(data), s, e)
    found = Suffixes.of(words, ends, doc)
    again = covered(np.where(found.deepest >= BASE_WINDOW, BASE_WINDOW, 0), ends)
    long = covered(np.where(found.deepest >= least, found.deepest, 0), ends)
    longest = np.zeros(docs, np.int64)
    if len(doc):
        full = np.flatnonzero(at[1:] > at[:-1])
        longest[full] = np.maximum.reduceat(found.deepest, at[full])
    letter = ~textops.IS_BLANK[data] & ((data & 0xC0) != 0x80)
    return {"n_words": np.diff(at), "word_chars": _per_doc(letter, offsets), "n_symbols": _per_doc(SYMBOL[data], offsets),
            "n_dup_lines": repeated_lines(data, offsets), "n_repeat_words": _per_doc(again, at),
            "n_covered": _per_doc(long, at), "longest_repeat": longest}


def measured(docs: DataFrame, text_col: str = "text", least: int = MIN_REPEAT) -> DataFrame:
    """Every input row (``_row``) with ``COLUMNS``."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = textops.buffers(b.column(0))
            parts = [measures(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], least)
                     for i, j in textops.chunks(offsets)]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), *[pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COLUMNS]],
                names=["_row", *COLUMNS])
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row {kind}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))


def judged(docs: DataFrame, text_col: str = "text", least: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
           max_longest: int = MAX_LONGEST) -> DataFrame:
    """``measured`` rows with ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("n_covered") <= F.lit(max_covered) * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return measured(docs, text_col, least).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & good)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts and verdicts."""
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    return judged(slim, text_col).select(F.col("_row").getField(id_col).alias(id_col), *list(COLUMNS), "base_failed", "kept")


def keep(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The documents that pass, with all input columns."""
    return judged(docs, text_col, **limits).filter("kept").select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_REPEAT) -> DataFrame:
    """``(id, start, length, times)``: every maximal repeated substring of
    ``least`` words or more, by its first occurrence (in words)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = textops.buffers(b.column(1))
            for i, j in textops.chunks(offsets):
                part, o = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                s, e, doc = textops.word_spans(part, o)
                at = np.searchsorted(doc, np.arange(len(o)))
                words = textops.range_hash(textops.prefix_hash(part), s, e)
                found = Suffixes.of(words, at[1:][doc], doc).maximal(words, at[:-1][doc], least)
                if found:
                    start, length, times = np.array(sorted(found), np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(i + doc[start])), pa.array(start - at[:-1][doc[start]]), pa.array(length),
                         pa.array(times)], names=["id", "start", "length", "times"])
    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, start long, length long, times long").withColumnRenamed("id", id_col)
