"""Toxicity scores of deobfuscated text.

1. A character model is counted over all documents: 4-grams of letters and
   word boundaries, partial counts per task, summed by key. The table has
   ``SYMBOLS ** 4`` cells whatever the corpus, so it can be broadcast.
2. Noisy-channel restoration: a token that holds digits or signs between
   letters or a repeated letter, a run of single characters and a run of
   fragments of at most ``FRAGMENT`` characters is a lattice: look-alike
   signs stand for letters, separators and repeats may vanish (one of two
   equal letters at ``COST_DOUBLE``), blanks inside a run, with or without
   separators between them, may join. Viterbi search under the character model
   over all paths (``lattice``) picks the restored words, which are scored
   beside the observed ones. Other tokens have one path.
3. A logistic regression scores the restored tokens. Features are the tokens
   and their beginnings of ``PREFIXES`` letters (present or not), selected by
   how unevenly they fall on the labels.

Labels come from at most ``SAMPLE`` labelled rows (a share of the ids by
hash) of the learning folds; everything else covers all documents. Ids,
languages, sources and labels are never inputs of a score.

Defined cases: null and empty texts score as the intercept does; rows with
repeated ids are scored one by one (their strictest label counts); without
labelled rows of both kinds every score is 0; labels of unknown ids and null
labels are ignored; a null id is in the held-out fold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import staged, temporary
from .lattice import STATES, SYMBOLS, Lattice, Recent, fold as unaccented, letter_class

SAMPLE = 20_000
FEATURES = 1 << 20
SELECTED = 4096
UNEVEN = 2.0  # standard errors between the labels that a feature must show
PREFIXES = (4, 5, 6)
FOLDS = 5

SKIP = 28  # digits, currency signs and control characters part runs of the model

COST_JOIN = 1.0  # a blank between fragments
KNOWN_WORD = 2.75  # nats a letter: a word that lost a doubled letter must be as likely as this under the model
FRAGMENT = 3

_CLASS = np.full(256, SKIP, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 0
_CLASS[65:91] = np.arange(1, 27)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial 4-gram counts of a task."""
    total = np.zeros(SYMBOLS ** 4, np.int64)
    for b in batches:
        data, offsets = textops.buffers(b.column(0))
        for i, j in textops.chunks(offsets):
            c = _CLASS[data[offsets[i]:offsets[j]]].astype(np.int32)
            c = np.concatenate([[0], c, [0, 0, 0]])
            keep = ~((c[1:] == 0) & (c[:-1] == 0))  # runs of boundaries are one
            keep &= ~((c[1:] == 27) & (c[:-1] == 27))  # so are the bytes of one letter
            c = np.concatenate([[0, 0, 0], c[1:][keep]])
            if len(c) < 4:
                continue
            gram = ((c[:-3] * SYMBOLS + c[1:-2]) * SYMBOLS + c[2:-1]) * SYMBOLS + c[3:]
            fine = (c[:-3] < SKIP) & (c[1:-2] < SKIP) & (c[2:-1] < SKIP) & (c[3:] < SKIP)
            total += np.bincount(gram[fine], minlength=SYMBOLS ** 4)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["gram", "n"])


def character_model(texts: DataFrame) -> np.ndarray:
    """log P(next | three before), interpolated down to single letters."""
    rows = (texts.mapInArrow(count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            .filter("n > 0").toPandas())
    n = np.zeros(SYMBOLS ** 4)
    n[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return interpolated(n)


def interpolated(n: np.ndarray) -> np.ndarray:
    """``character_model`` from 4-gram counts."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, 5):
        counts = n.reshape(-1, SYMBOLS ** order).sum(axis=0).reshape(-1, SYMBOLS)
        total = counts.sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order > 1 else 1, 1))
        p = (counts + 5.0 * lower) / (total + 5.0)
    return np.log(p.ravel()).astype(np.float32)


_GAP = r"[ \t\n\r\v\f]+(?:[.\-_*~'`^,:;/\\=#|]+[ \t\n\r\v\f]+)*"
_SIGN = r"[\w@$!|+*]"
# Both begin with the blank in front, so that a search skips to the next blank.
_SPACED = re.compile(rf"\s((?!_){_SIGN}(?:{_GAP}{_SIGN}(?!\S)){{2,}})")
_END = r"(?=[.,;:?\"')]*(?!\S))"
_SPLIT = re.compile(rf"\s({_SIGN}{{1,{FRAGMENT}}}+(?:{_GAP}{_SIGN}{{1,{FRAGMENT}}}+{_END})+)")
_EDGE = ".,;:!?\"'()[]{}<>%&#*|~`^_-/\\=…»«„“”’‘"
_MARKS = ".,;:?\"'"
_WORD = re.compile("[a-z]+")
_LETTER = bytes(letter_class(chr(i)) for i in range(256))
_TWICE = re.compile(r"([^\W\d_])\1")
_REPEAT, _TRIPLE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")


def suspicious(token: str) -> bool:
    """Whether a token (lower case, edges stripped) has more than one reading."""
    if token.isalpha():
        return bool(_REPEAT.search(token))
    letters = sum(map(str.isalpha, token))
    return letters >= 2 or (len(token) > 2 and (letters > 0 or any(c in "@$!|" for c in token)))


class Restorer:
    """Tokens of a text after restoration."""

    def __init__(self, model: np.ndarray):
        self.plain = Lattice(model)
        self.doubled = Lattice(model, doubles=True)
        self.fragments = Lattice(model, COST_JOIN, 0.0)
        self.doubled.cost = self.fragments.cost = self.plain.cost  # one table in memory
        self.runs: Recent = Recent()

    def readings(self, raw: str) -> tuple[str, ...]:
        """Restored words of one observed (lower-case) token."""
        if raw.isalpha() and not _REPEAT.search(raw):  # one reading
            return (raw,)
        token = raw.strip(_EDGE)
        if _WORD.fullmatch(token) and (raw.rstrip(_MARKS) == token) \
                and not _TRIPLE.search(token) and self.doubled.keeps(token):
            return (token,)
        got = (token,) if token else ()
        other = raw.rstrip(_MARKS)  # an edge sign may be a letter: 'b!tch!' or '$cum'
        for form in (token,) if other == token else (token, other):
            if not form or not suspicious(form):
                continue
            word = None
            if not form.isalpha() or _TRIPLE.search(form):
                word = self.plain.restore(form)
                got += tuple(word.split())
            if _REPEAT.search(form):  # 'iddiott', but also 'better': beside the reading that keeps doubled letters
                if word is None or _TWICE.search(unaccented(form)):  # else both lattices are the same
                    word = self.doubled.restore(form)
                if len(word) > 2 and word != unaccented(form) and self.known(word):
                    got += tuple(word.split())
        return got

    def known(self, word: str) -> bool:
        """Whether the character model explains the word."""
        state, spent, cost = 0, 0.0, self.plain.cost
        for c in word.encode().translate(_LETTER) if word.isascii() else map(letter_class, word):
            state = state % STATES * SYMBOLS + c
            spent += cost[state]
        return spent + cost[state % STATES * SYMBOLS] <= KNOWN_WORD * (len(word) + 1)

    def spaced(self, text: str) -> list[str]:
        """Words restored from runs of single characters and of fragments."""
        out = []
        text = " " + text
        for run in _SPACED.findall(text):
            out += self.plain.restore(run).split()
        for run in _SPLIT.findall(text):
            out += self.joined(run)
        return out

    def joined(self, run: str) -> tuple[str, ...]:
        """Words of a run of fragments; recent runs are remembered."""
        got = self.runs[run]
        if got is None:
            got = self.runs[run] = tuple(self.fragments.restore(run).split())
        return got

    def tokens(self, text: str) -> set[str]:
        text = text.lower()
        out = set(self.spaced(text))
        for raw in set(text.split()):
            out.update(self.readings(raw))
        return out


def features(word: str) -> list[int]:
    """Numbers of the word and of its beginnings of ``PREFIXES`` letters."""
    crc = zlib.crc32
    whole = word.encode()
    if len(whole) == len(word):  # a letter is a byte
        return [crc(whole, _EQUALS) % FEATURES, *[crc(whole[:n]) % FEATURES for n in PREFIXES if n <= len(whole)]]
    return [crc(whole, _EQUALS) % FEATURES, *[crc(word[:n].encode()) % FEATURES for n in PREFIXES if n <= len(word)]]


_EQUALS = zlib.crc32(b"=")


class Blank:
    """Tokens without a weight: the last ``size`` to 2 * ``size`` ones."""

    def __init__(self, size: int = 400_000):
        self.size, self.recent, self.older = size, set(), set()

    def others(self, tokens: set[str]) -> set[str]:
        """Those of the tokens that are not remembered."""
        rest = tokens - self.recent
        again = rest & self.older
        if again:
            self.recent |= again
            rest -= again
        return rest

    def add(self, tokens: list[str]) -> None:
        if len(self.recent) >= self.size:
            self.recent, self.older = set(), self.recent
        self.recent.update(tokens)


@dataclass
class Scorer:
    """Everything a task needs: bounded by ``SYMBOLS ** 4`` and ``SELECTED``.
    A worker remembers what recent tokens mean."""

    model: np.ndarray
    weights: dict[int, float]
    intercept: float

    def start(self) -> None:
        if not hasattr(self, "hits"):
            self.restorer = Restorer(self.model)
            self.hits: Recent = Recent()
            self.blank = Blank()
            self.found: Recent = Recent()

    def score(self, text: str | None) -> float:
        if not text:
            return self._squash(self.intercept)
        text = text.lower()
        found: set[int] = set()
        hits, words, readings, blank = self.hits, self.found, self.restorer.readings, []
        for raw in self.blank.others(set(text.split())):
            got = hits[raw]
            if got is None:
                got = [f for w in set(readings(raw)) for f in self.weighty(w)]
                if not got:
                    blank.append(raw)
                    continue
                hits[raw] = got
            found.update(got)
        self.blank.add(blank)
        for w in self.restorer.spaced(text):
            got = words[w]
            if got is None:
                got = words[w] = self.weighty(w)
            found.update(got)
        return self._squash(self.intercept + sum(self.weights[f] for f in sorted(found)))

    def weighty(self, word: str) -> list[int]:
        """Features of a word that have a weight."""
        weights = self.weights
        return [f for f in features(word) if f in weights]

    @staticmethod
    def _squash(z: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fold(ident) -> F.Column:
    return F.crc32(F.encode(F.coalesce(ident.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """``(text, toxic)`` of at most ``sample`` labelled ids outside fold 0."""
    ident = F.col(f"`{id_col}`")
    known = (labels.filter(ident.isNotNull() & F.col("toxic").isNotNull() & (fold(ident) != 0))
             .groupBy(ident.alias("_id")).agg(F.max("toxic").alias("toxic")))
    # a share of the ids by hash, a little below the bound: no task needs to know the others' rows
    share = min(1.0, 0.97 * sample / max(1, known.count()))
    part = F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    known = known.filter(part < share) if share < 1 else known
    return docs.select(ident.alias("_d"), F.col(f"`{text_col}`").cast("string").alias("text")).join(
        F.broadcast(known), F.col("_d") == F.col("_id")).select("text", "toxic")  # at most `sample` rows


def _sets(model):
    """(text, toxic) -> (toxic, features present)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model.value)
        for b in batches:
            out = [sorted({f for w in r.tokens(t or "") for f in features(w)}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(out, pa.list_(pa.int32()))],
                                             names=["toxic", "present"])
    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, FEATURES), np.int64)
    for b in batches:
        for y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n[1 if y else 0, f] += 1
    hit = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[0, hit]), pa.array(n[1, hit])], names=["f", "neg", "pos"])


def fit(rows: list[np.ndarray], y: np.ndarray, width: int, l2: float = 0.05, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features, classes weighted evenly;
    accelerated gradient steps."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(width), 0.0
    v, vb, t = w.copy(), b, 1.0
    scale = np.zeros(len(rows))
    np.add.at(scale, row, 1.0)
    rate = 4.0 / (1 + (share * (scale + 1)).sum() + 4 * l2 / max(len(rows), 1))
    for _ in range(steps):
        z = np.bincount(row, v[column], minlength=len(rows)) + vb
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(column, g[row], minlength=width) + l2 / max(len(rows), 1) * v
        new, new_b = v - rate * grad, vb - rate * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new, new_b, nt
    return calibrated(w, b, np.bincount(row, w[column], minlength=len(rows)) + b, y)


def calibrated(w: np.ndarray, b: float, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Platt scaling: slope and shift of the margins ``z`` fitted to smoothed
    labels with evenly weighted classes (Newton steps)."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    share = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    x, beta = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (share * (target - p)))
        beta += np.clip(step, -0.5, 0.5)
    return (w * beta[0], b * beta[0] + beta[1]) if beta[0] > 0 else (w, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text") -> Scorer:
    """Character model over all documents, classifier over the sample."""
    with temporary(docs.sparkSession):
        return _train(docs, labels, sample, id_col, text_col)


def _train(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> Scorer:
    spark = docs.sparkSession
    model = character_model(docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")))
    shared = spark.sparkContext.broadcast(model)
    sets = staged(learning_rows(docs, labels, sample, id_col, text_col)
                  .mapInArrow(_sets(shared), "toxic int, present array<int>"))
    by_label = {r["toxic"]: r["n"] for r in sets.groupBy((F.col("toxic") != 0).cast("int").alias("toxic"))
                .agg(F.count(F.lit(1)).alias("n")).collect()}
    neg, pos = by_label.get(0, 0), by_label.get(1, 0)
    if not neg or not pos:
        return Scorer(model, {}, -30.0)
    counts = sets.mapInArrow(_count, "f long, neg long, pos long").groupBy("f").agg(
        F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    # how far the share among toxic texts is from the share among the others, in standard errors
    p, q = (F.col("pos") + 0.5) / F.lit(pos + 1.0), (F.col("neg") + 0.5) / F.lit(neg + 1.0)
    all_ = (F.col("pos") + F.col("neg") + 1.0) / F.lit(pos + neg + 2.0)
    z = F.abs(p - q) / F.sqrt(all_ * (1 - all_) * F.lit(1 / pos + 1 / neg))
    best = counts.filter((F.col("pos") + F.col("neg") >= 3) & (z >= UNEVEN)).orderBy(z.desc(), "f").limit(SELECTED)
    chosen = [r["f"] for r in best.select("f").collect()]  # at most SELECTED
    number = {f: i for i, f in enumerate(chosen)}
    picked = F.array_intersect("present", F.array(*[F.lit(f).cast("int") for f in chosen]) if chosen
                               else F.array().cast("array<int>"))
    rows = [(r["toxic"], np.array([number[f] for f in r["hits"]], np.int64))
            for r in sets.select("toxic", picked.alias("hits")).collect()]  # at most `sample` short lists
    y = np.array([1.0 if t else 0.0 for t, _ in rows])
    w, b = fit([h for _, h in rows], y, len(chosen))
    return Scorer(model, {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-6}, float(b))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row (``_row``) with its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded, see Scorer
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        s.start()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([s.score(t) for t in b.column(0).to_pylist()], pa.float64())],
                names=["_row", "score"])
    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, score double")


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``."""
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    out = score(slim, train(slim, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    ident = F.col("_row").getField(id_col)
    return out.select(ident.alias(id_col), (fold(ident) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic; all input columns."""
    out = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return out.filter("score < 0.5").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
