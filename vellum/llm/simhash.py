"""SimHash fingerprints and exact search within a Hamming radius, in
DataFrame expressions only.

A term (a lower-cased word, once per document) votes with its weight (its
length, at most ``TOP_WEIGHT``) for the bits set in its hash and against the
others; a fingerprint bit is set when the votes for it exceed half of all
weight. Two 64-bit hashes give 128 bits. The votes of two bits share one
64-bit sum (32 bits each, enough for 2^28 distinct terms), so a document is
64 sums over its exploded terms, folded inside the task that holds the text.

Search: fingerprints are cut into ``blocks`` blocks. For a radius below the
number of blocks, two fingerprints within it agree on ``blocks - radius``
blocks at least, so there is one table per choice of that many blocks, keyed
by them (the permuted block tables). For a wider radius they differ in at
most ``radius // blocks`` bits of one block at least, so there is one table
per block, and a query asks it for its own value and all values that near. A
pair counts in the first table where it meets and only if its distance is
within the radius. Equal fingerprints are one entry with a count.

The entries under one key of a table lie in lists of about ``LIST``; a hot key
(a group of near copies) has many lists. A query meets lists, not entries, and
keeps one row per list with the entries within the radius, so counting or
reporting them never makes a row per pair (``within`` does, for callers that
want pairs).

Texts whose term weights have the cosine c are Binomial(128, acos(c) / pi)
bits apart. ``REACH`` is the least radius that holds the share ``RECALL`` of
the pairs at the cosine ``SIMILARITY``; nearer pairs are found more often.
``RADIUS`` finds little beyond exact copies.

Defined cases: null texts are empty; a text without terms has the zero
fingerprint; equal texts have equal fingerprints; documents sharing an id
are separate, in a stable order (``common.keyed``), as are repeated rows; an
empty table gives no rows; a single document is its own next document.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.ordered import with_global_index

from .common import keyed, staged

BITS = 128
TOP_WEIGHT = 16
RADIUS = 3
BLOCKS = 6
SIMILARITY, RECALL = 0.92, 0.95
LIST = 64



def reach(similarity: float, recall: float) -> int:
    """Least radius within which the share ``recall`` of the pairs of cosine
    ``similarity`` lies."""
    p, held = math.acos(similarity) / math.pi, 0.0
    for r in range(BITS):
        held += math.comb(BITS, r) * p ** r * (1 - p) ** (BITS - r)
        if held >= recall:
            return r
    return BITS


REACH = reach(SIMILARITY, RECALL)  # 23

_PAIR = (1 << 32) + 1  # one bit in either half of a sum


def _votes(h: Column, weight: Column, name: str) -> list[Column]:
    """Sum i holds the weight for bit i (low half) and bit i + 32 (high half)."""
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR)) * weight).alias(f"{name}{i}") for i in range(32)]


def _bits(name: str, total: Column) -> Column:
    """The 64-bit word of one hash from its sums."""
    parts = []
    for i in range(32):
        low = F.col(f"{name}{i}").bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(F.col(f"{name}{i}"), 32)
        parts.append(F.when(low * 2 > total, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        bit = 1 << (i + 32)
        parts.append(F.when(high * 2 > total, F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0)).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``f1``, ``f2``: fingerprint words of every row with a term
    (rows without one are absent). Rows of one key are taken as one text; the
    input's partitioning by the keys is reused."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"))
    terms = texts.select(*keys, F.explode(words).alias("_term")).filter("_term <> ''")
    terms = terms.select(*keys, F.xxhash64("_term").alias("_a"), F.xxhash64("_term", F.lit(1)).alias("_b"),
                         F.least(F.char_length("_term"), F.lit(TOP_WEIGHT)).cast("long").alias("_w"))
    sums = terms.groupBy(*keys).agg(*_votes(F.col("_a"), F.col("_w"), "_a"), *_votes(F.col("_b"), F.col("_w"), "_b"),
                                    F.sum("_w").alias("_total"))
    return sums.select(*keys, _bits("_a", F.col("_total")).alias("f1"), _bits("_b", F.col("_total")).alias("f2"))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.lit(1.0) - distance(a1, a2, b1, b2) / F.lit(float(BITS))


def written(f1: Column, f2: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(f1)), 16, "0"), F.lpad(F.lower(F.hex(f2)), 16, "0"))


def _blocks(f1: Column, f2: Column, blocks: int) -> list[Column]:
    """The fingerprint cut into ``blocks`` numbers."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]

    def word(f: Column, lo: int, hi: int) -> Column:  # bits [lo, hi) of one word
        mask = (1 << (hi - lo)) - 1
        return F.shiftrightunsigned(f, lo).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long"))

    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        parts = ([word(f1, lo, min(hi, 64))] if lo < 64 else []) + ([word(f2, max(lo, 64) - 64, hi - 64)] if hi > 64 else [])
        out.append(parts[0] if len(parts) == 1 else F.xxhash64(*parts))
    return out


def _permuted(df: DataFrame, f1: str, f2: str, tables: list[tuple[int, ...]], blocks: int) -> DataFrame:
    """Every row once per table, with its key ``_k<f1>``."""
    cut = _blocks(F.col(f1), F.col(f2), blocks)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[cut[i] for i in chosen]).alias("k"))
                     for t, chosen in enumerate(tables)])
    return df.select("*", F.explode(keys).alias("_e")).select("*", F.col("_e.t").alias(f"_t{f1}"),
                                                               F.col("_e.k").alias(f"_k{f1}")).drop("_e")


def _by_block(df: DataFrame, f1: str, f2: str, blocks: int, differ: int) -> DataFrame:
    """Every row once per block and value at most ``differ`` bits from the
    block's own; the key ``_k<f1>`` is the value, ``_t<f1>`` the block."""
    width = BITS // blocks
    masks = [sum(1 << b for b in chosen) for n in range(differ + 1) for chosen in combinations(range(width), n)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), v.alias("v"))
                     for t, v in enumerate(_blocks(F.col(f1), F.col(f2), blocks))])
    rows = df.select("*", F.explode(keys).alias("_e"))
    if differ:
        rows = rows.select("*", F.explode(F.lit(masks).cast("array<long>")).alias("_m"))
    value = F.col("_e.v").bitwiseXOR(F.col("_m")) if differ else F.col("_e.v")
    return rows.select("*", F.col("_e.t").alias(f"_t{f1}"), value.alias(f"_k{f1}")).drop("_e", "_m")


def choose_blocks(fingerprints: int, radius: int) -> int:
    """Blocks that make a search cheapest: a query asks for so many values,
    and each value has so many entries (blocks get wider as the table grows)."""
    def cost(blocks: int) -> float:
        width, differ = BITS // blocks, min(radius // blocks, BITS // blocks)
        asks = blocks * sum(math.comb(width, k) for k in range(differ + 1))
        return asks * (1 + fingerprints / 2 ** width)
    return min((b for b in (4, 8, 16, 32) if radius >= b), key=cost, default=BLOCKS)


def lists_within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``(q1, q2, near)``: for every distinct query fingerprint all distinct
    fingerprints within the radius, in rows of one list each: ``near`` has
    ``(f1, f2, n, id, distance)``, ``n`` rows having it, the smallest ``id``
    among them. Inputs have columns ``f1, f2`` and ``id`` (of ``prints``)."""
    if not 0 <= radius <= BITS or blocks is not None and not 1 <= blocks <= BITS:
        raise ValueError("radius and blocks count bits of a fingerprint")
    entries = prints.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    if blocks is None:
        entries = staged(entries)
        blocks = choose_blocks(entries.count(), radius)
    if radius >= blocks and blocks not in (4, 8, 16, 32):
        raise ValueError("a radius of as many bits as there are blocks or more needs 4, 8, 16 or 32 equal blocks")
    asked = queries.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct()
    if radius < blocks:
        tables = list(combinations(range(blocks), blocks - radius))
        entries, asked = _permuted(entries, "f1", "f2", tables, blocks), _permuted(asked, "q1", "q2", tables, blocks)
    else:
        differ = min(radius // blocks, BITS // blocks)
        entries, asked = _by_block(entries, "f1", "f2", blocks, 0), _by_block(asked, "q1", "q2", blocks, differ)

    def counts(f1: Column, f2: Column) -> Column:  # the first table where a pair meets
        both = list(zip(_blocks(f1, f2, blocks), _blocks(F.col("q1"), F.col("q2"), blocks), strict=True))
        if radius < blocks:
            meets = [reduce(lambda a, b: a & b, [both[i][0] == both[i][1] for i in chosen]) for chosen in tables]
        else:
            meets = [F.bit_count(a.bitwiseXOR(b)) <= differ for a, b in both]
        return F.coalesce(*[F.when(m, F.lit(t)) for t, m in enumerate(meets)])

    def fits(e: Column) -> Column:
        return ((distance(e["f1"], e["f2"], F.col("q1"), F.col("q2")) <= radius)
                & (counts(e["f1"], e["f2"]) == F.col("_tq1")))
    hot = (entries.groupBy(F.col("_tf1").alias("_t"), F.col("_kf1").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > LIST))
    dealt = entries.join(hot, (F.col("_tf1") == F.col("_t")) & (F.col("_kf1") == F.col("_k")), "left")
    part = F.coalesce(F.pmod(F.xxhash64("f2", "f1"), F.ceil(F.col("_n") / LIST)), F.lit(0))
    lists = dealt.groupBy("_tf1", "_kf1", part.alias("_part")).agg(
        F.collect_list(F.struct("f1", "f2", "n", "id")).alias("_list"))  # about LIST entries
    # the planner does not count the values a query asks for: without the hint it would broadcast them all
    met = lists.hint("merge").join(asked, (F.col("_kf1") == F.col("_kq1")) & (F.col("_tf1") == F.col("_tq1"))
                                   & F.exists("_list", fits))
    near = F.transform(F.filter("_list", fits), lambda e: F.struct(
        e["f1"].alias("f1"), e["f2"].alias("f2"), e["n"].alias("n"), e["id"].alias("id"),
        distance(e["f1"], e["f2"], F.col("q1"), F.col("q2")).alias("distance")))
    return met.select("q1", "q2", near.alias("near"))


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``(q1, q2, f1, f2, n, distance)``: for every distinct query
    fingerprint all distinct fingerprints within the radius and how many
    rows have them. Inputs have columns ``f1, f2``."""
    found = lists_within(prints.withColumn("id", F.lit(None).cast("long")), queries, radius, blocks)
    return found.select("q1", "q2", F.explode("near").alias("x")).select("q1", "q2", "x.f1", "x.f2", "x.n", "x.distance")


def _asks(ident: Column, kind: str, every: int) -> Column:
    """Whether a document is a query: integer ids divisible by ``every``."""
    integral = kind in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(ident % every == 0, F.lit(False)) if integral else F.lit(False)


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, f1, f2)`` of every input row: the fingerprint class it is in."""
    rows = keyed(docs, id_col, text_col)
    prints = fingerprints(rows.select("_uid", "_text"), ["_uid"], "_text").withColumnRenamed("_uid", "_u")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("_uid", F.col("_row").getField(id_col).alias(id_col)).join(
        prints, F.col("_uid") == F.col("_u"), "left").select(id_col, zero("f1"), zero("f2"))


def near(docs: DataFrame, radius: int = REACH, blocks: int | None = None, every: int = 20, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, near)``: for every fingerprint of a document whose
    id is divisible by ``every`` (``id``: the smallest one) all fingerprints
    within the radius, its own included, in rows of about ``LIST`` at most.
    ``near`` lists ``(id, fingerprint, distance, n_documents)``, ``id`` being
    the smallest of the documents that have it; ``membership`` says which
    others do."""
    rows = staged(membership(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    asking = rows.filter(_asks(F.col("id"), dict(rows.dtypes)["id"], every))
    found = lists_within(rows, asking, radius, blocks)
    asking = asking.groupBy(F.col("f1").alias("_a1"), F.col("f2").alias("_a2")).agg(F.min("id").alias("_id"))
    listed = F.transform("near", lambda e: F.struct(
        e["id"].alias(id_col), written(e["f1"], e["f2"]).alias("fingerprint"), e["distance"].alias("distance"),
        e["n"].alias("n_documents")))
    return asking.join(found, (F.col("_a1") == F.col("q1")) & (F.col("_a2") == F.col("q2"))).select(
        F.col("_id").alias(id_col), written(F.col("q1"), F.col("q2")).alias("fingerprint"), listed.alias("near"))


def edited_pairs(rows: DataFrame) -> DataFrame:
    """``(uid, next, n_chars, text, edited)`` of keyed documents: the last
    half of every text replaced by the beginning of the next one."""
    lengths = rows.select("_uid", F.char_length(F.coalesce("_text", F.lit(""))).cast("long").alias("_n"))
    ranked = with_global_index(lengths, ["_uid"], idx="_i")
    total = ranked.count()
    after = ranked.select(F.col("_uid").alias("_next"), F.col("_i").alias("_j"))
    step = ranked.join(after, F.pmod(F.col("_i") + 1, F.lit(max(total, 1))) == F.col("_j")).select(
        F.col("_uid").alias("_u"), F.col("_next"), F.col("_n"))
    # what a document lends: the first `_need` characters, to `_to`
    lends = step.select(F.col("_next").alias("_v"), F.col("_u").alias("_to"), F.floor(F.col("_n") / 2).alias("_need"))
    light = step.join(lends, F.col("_u") == F.col("_v")).select("_u", "_next", "_n", "_to", "_need")
    text = F.coalesce("_text", F.lit("")).alias("_text")
    whole = rows.select("_uid", text).join(light, F.col("_uid") == F.col("_u"))
    lent = whole.select(F.col("_to").alias("_for"), F.left("_text", F.col("_need")).alias("_lent"))
    kept = F.left("_text", F.col("_n") - F.floor(F.col("_n") / 2))
    return whole.join(lent, F.col("_uid") == F.col("_for")).select(
        F.col("_uid").alias("uid"), F.col("_next").alias("next"), F.col("_n").alias("n_chars"), F.col("_text").alias("text"),
        F.concat(kept, F.col("_lent")).alias("edited"))


def compare(docs: DataFrame, radius: int = RADIUS, reach: int = REACH, blocks: int | None = None, every: int = 20,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_chars``, ``edited_sha256``, both
    fingerprints, their likeness, the likeness to the next document's, and
    for ids divisible by ``every``: ``within_radius``, how many other
    documents have a fingerprint within ``radius``, ``within_reach``, the
    same for ``reach``, and ``near_classes``, how many other fingerprints are
    within ``reach`` (``near`` lists them)."""
    rows = keyed(docs, id_col, text_col)
    pairs = edited_pairs(rows)
    both = pairs.select("uid", "next", "n_chars", F.explode(F.array(
        F.struct(F.lit(0).alias("e"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))).alias("x")).select("uid", "x.e", "x.t")
    prints = fingerprints(both, ["uid", "e"], "t")
    wide = prints.groupBy("uid").agg(*[F.max(F.when(F.col("e") == e, F.col(f))).alias(f"{f}{e}")
                                       for e in (0, 1) for f in ("f1", "f2")])
    info = pairs.select("uid", "next", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    ids = rows.select(F.col("_uid"), F.col("_row").getField(id_col).alias("_id"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    table = staged(info.join(wide, "uid", "left").join(ids, F.col("uid") == F.col("_uid")).select(
        "uid", "_id", "next", "n_chars", "edited_sha256", *[zero(f"{f}{e}") for e in (0, 1) for f in ("f1", "f2")]))
    after = table.select(F.col("uid").alias("_v"), F.col("f10").alias("_n1"), F.col("f20").alias("_n2"))
    is_query = _asks(F.col("_id"), dict(table.dtypes)["_id"], every)
    plain = table.select(F.col("f10").alias("f1"), F.col("f20").alias("f2"), is_query.alias("_q"))
    plain = plain.withColumn("id", F.lit(None).cast("long"))
    found = lists_within(plain, plain.filter("_q"), max(radius, reach), blocks)
    zero_n = F.lit(0).cast("long")
    told = {"within_radius": lambda e: F.when(e["distance"] <= radius, e["n"]).otherwise(zero_n),
            "within_reach": lambda e: F.when(e["distance"] <= reach, e["n"]).otherwise(zero_n),
            "near_classes": lambda e: F.when(e["distance"] <= reach, F.lit(1).cast("long")).otherwise(zero_n)}
    counts = found.groupBy("q1", "q2").agg(*[
        (F.sum(F.aggregate(F.transform("near", x), zero_n, lambda a, v: a + v)) - 1).alias(f"_{name}")
        for name, x in told.items()])
    return (table.join(after, F.col("next") == F.col("_v"))
            .join(counts, (F.col("f10") == F.col("q1")) & (F.col("f20") == F.col("q2")), "left")
            .select(F.col("_id").alias(id_col), "n_chars", "edited_sha256",
                    written(F.col("f10"), F.col("f20")).alias("fingerprint"),
                    written(F.col("f11"), F.col("f21")).alias("edited_fingerprint"),
                    likeness(F.col("f10"), F.col("f20"), F.col("f11"), F.col("f21")).alias("near_edited"),
                    likeness(F.col("f10"), F.col("f20"), F.col("_n1"), F.col("_n2")).alias("near_next"),
                    *[F.when(is_query, F.col(f"_{name}")).alias(name) for name in told]))
