"""Relationship discovery between tables.

Candidates come from column names and types (a self-join of the schema
table on the normalised name: metadata, not data). ``containment`` is the
data part that scales with the tables: for each candidate pair, the share
of distinct values of one column found in the other, all pairs from one
grouping of value hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import normalise_name
from vellum.operators.common import col
from vellum.sources.schema import schema_counts
from vellum import texts

# Type families (fixed values): substrings of the lower-cased type name.
NUMERIC_FAMILY = ["int", "float", "decimal", "numeric", "number"]
STRING_FAMILY = ["str", "varchar", "text", "char", "string", "objectid"]


def _has_any(t, words):
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))


def join_key_candidates(schema_df: DataFrame) -> DataFrame:
    """Profiler variant: same normalised name, pairs within one source allowed;
    compatible when both types contain 'int', both 'string', both 'varchar' or equal."""
    s = schema_df.withColumn("norm", normalise_name(F.col("column_name"))).filter(F.col("norm") != "")
    a, b = s.alias("a"), s.alias("b")
    pos_a = F.struct(F.col("a.source_no"), F.col("a.ordinal"))
    pos_b = F.struct(F.col("b.source_no"), F.col("b.ordinal"))
    t1, t2 = F.lower(F.col("a.type")), F.lower(F.col("b.type"))
    ok = ((F.contains(t1, F.lit("int")) & F.contains(t2, F.lit("int")))
          | (F.contains(t1, F.lit("string")) & F.contains(t2, F.lit("string")))
          | (F.contains(t1, F.lit("varchar")) & F.contains(t2, F.lit("varchar"))) | (t1 == t2))
    pairs = a.join(b, (F.col("a.norm") == F.col("b.norm")) & (pos_a < pos_b)).filter(ok)
    return pairs.select(
        F.concat_ws(".", "a.source", "a.column_name").alias("column1"),
        F.concat_ws(".", "b.source", "b.column_name").alias("column2"),
        F.format_string(texts.JOIN_KEY_REASON, F.col("a.norm"), t1, t2).alias("reason"))


def find_relationships(schema_df: DataFrame) -> DataFrame:
    """Heuristic relationships between different sources (name length >= 2)."""
    s = (schema_df.withColumn("norm", normalise_name(F.col("column_name")))
         .filter(F.length("norm") >= 2))
    a, b = s.alias("a"), s.alias("b")
    pos_a = F.struct(F.col("a.source_no"), F.col("a.ordinal"))
    pos_b = F.struct(F.col("b.source_no"), F.col("b.ordinal"))
    t1, t2 = F.lower(F.col("a.type")), F.lower(F.col("b.type"))
    ok = ((_has_any(t1, NUMERIC_FAMILY) & _has_any(t2, NUMERIC_FAMILY))
          | (_has_any(t1, STRING_FAMILY) & _has_any(t2, STRING_FAMILY)) | (t1 == t2))
    pairs = (a.join(b, (F.col("a.norm") == F.col("b.norm")) & (pos_a < pos_b)
                    & (F.col("a.source") != F.col("b.source"))).filter(ok))
    return pairs.select(
        F.col("a.source").alias("source1"), F.col("a.column_name").alias("column1"),
        F.col("b.source").alias("source2"), F.col("b.column_name").alias("column2"),
        F.format_string(texts.RELATIONSHIP_RATIONALE, F.col("a.norm"), t1, t2)
        .alias("rationale"))


def _comparable(df: DataFrame, c: str, other_type: str):
    t = df.schema[c].dataType.simpleString()
    ints = ("tinyint", "smallint", "int", "bigint")
    if t in ints and other_type in ints:
        return col(c).cast("long")
    if t != "string" and other_type != "string" and "int" in t + other_type and t == other_type:
        return col(c)
    return col(c).cast("string")


SLOTS = 60  # columns that share one 64-bit map


def containment(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """For each (source1, column1, source2, column2): distinct values of
    column1, how many of them occur in column2, and the share.

    Every table is scanned once for all its columns. A value (by a 128-bit
    hash, never the text itself) is grouped once and gets a bit for each
    column that holds it; all pairs are read off the counts per bit map."""
    parts, batch, slots = [], [], {}
    for pair in pairs:
        need = {k for k in _slots(tables, pair) if k not in slots}
        if len(slots) + len(need) > SLOTS:
            parts.append(_containment(tables, batch, slots))
            batch, slots = [], {}
        for k in _slots(tables, pair):
            slots.setdefault(k, len(slots))
        batch.append(pair)
    if batch:
        parts.append(_containment(tables, batch, slots))
    if not parts:
        raise ValueError("Containment needs at least one pair of columns.")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("containment", F.try_divide(F.col("matched_values").cast("double"), F.col("distinct_values")))


def _slots(tables: dict[str, DataFrame], pair: tuple[str, str, str, str]) -> list[tuple[str, str, str]]:
    """(source, column, type it is compared with) of both ends of a pair."""
    s1, c1, s2, c2 = pair
    t1, t2 = (tables[s].schema[c].dataType.simpleString() for s, c in ((s1, c1), (s2, c2)))
    return [(s1, c1, t2), (s2, c2, t1)]


def _containment(tables: dict[str, DataFrame], pairs: list, slots: dict) -> DataFrame:
    rows = None
    for source in dict.fromkeys(k[0] for k in slots):
        df = tables[source]
        values = [F.struct(F.lit(1 << i).cast("long").alias("bit"), _comparable(df, c, t).cast("string").alias("v"))
                  for (s, c, t), i in slots.items() if s == source]
        part = df.select(F.explode(F.array(*values)).alias("x")).select("x.bit", "x.v").filter("v IS NOT NULL") \
            .select("bit", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"))
        rows = part if rows is None else rows.unionByName(part)
    maps = rows.groupBy("h1", "h2").agg(F.bit_or("bit").alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    found = []
    for s1, c1, s2, c2 in pairs:
        a, b = (1 << slots[k] for k in _slots(tables, (s1, c1, s2, c2)))
        held = F.col("bits").bitwiseAND(F.lit(a)) != 0
        both = held & (F.col("bits").bitwiseAND(F.lit(b)) != 0)
        found.append(F.struct(F.lit(s1).alias("source1"), F.lit(c1).alias("column1"), F.lit(s2).alias("source2"),
                              F.lit(c2).alias("column2"),
                              F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("distinct_values"),
                              F.coalesce(F.sum(F.when(both, F.col("n"))), F.lit(0)).alias("matched_values")))
    return maps.agg(F.array(*found).alias("s")).select(F.inline("s"))


def with_counts(candidates: DataFrame, tables: dict[str, DataFrame], first: tuple, second: tuple) -> DataFrame:
    """Candidates with ``values1`` / ``values2``: how many values each of the two
    columns holds. ``first`` / ``second`` name the candidate's columns that
    spell out (source, column), or the one that spells ``source.column``."""
    counts = schema_counts(tables).select(F.concat_ws(".", "source", "column_name").alias("_c"), F.col("present").alias("_n"))
    out = candidates
    for names, new in ((first, "values1"), (second, "values2")):
        key = F.concat_ws(".", *names)
        out = out.join(counts.withColumnRenamed("_n", new), key == F.col("_c"), "left").drop("_c")
    return out


def relationship_containment(spark: SparkSession, tables: dict[str, DataFrame], schema_df: DataFrame) -> DataFrame:
    """Candidates of ``find_relationships`` scored in both directions.

    The candidate list is read on the driver: it is bounded by the number
    of column pairs across the schemas, not by the data."""
    cands = find_relationships(schema_df).select("source1", "column1", "source2", "column2").collect()
    pairs = []
    for r in cands:
        pairs.append((r.source1, r.column1, r.source2, r.column2))
        pairs.append((r.source2, r.column2, r.source1, r.column1))
    return containment(tables, pairs)
