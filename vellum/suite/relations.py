"""Schema inspection (SRC9) and relationship discovery (JN8-JN10)."""

from vellum.operators import relations
from vellum.sources.schema import schema_counts, schema_info
from vellum.suite import query

TEXT_TABLES = ["documents", "labels", "conversations", "benchmark", "pages", "events"]
SCHEMA_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def _tables(spark, names=TEXT_TABLES):
    return {n: spark.table(n) for n in names}


# Oracle side: DuckDB type names written as Spark's simpleString.
SPARK_TYPE_SQL = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
  WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'FLOAT' THEN 'float' ELSE lower(data_type) END"""

NORM_SQL = "trim(replace(replace(replace(replace(lower(column_name), '_id', ''), 'id', ''), '_key', ''), 'key', ''), '_ ')"
Q = "'"  # a quote inside the SQL text


def _schema_sql(names):
    order = ", ".join(f"('{n}', {i})" for i, n in enumerate(names))
    return (f"SELECT c.table_name AS source, CAST(o.source_no AS INTEGER) AS source_no, "
            f"CAST(c.ordinal_position - 1 AS INTEGER) AS ordinal, c.column_name, {SPARK_TYPE_SQL} AS type "
            f"FROM information_schema.columns c JOIN (VALUES {order}) AS o(name, source_no) ON c.table_name = o.name")


def _family(t, words):
    return "(" + " OR ".join(f"contains(lower({t}), '{w}')" for w in words) + ")"


ORDERED_PAIR = "(a.source_no < b.source_no OR (a.source_no = b.source_no AND a.ordinal < b.ordinal))"
TYPES_TEXT = "' || lower(a.type) || '/' || lower(b.type) || ')'"

JN8_SQL = (
    f"WITH s AS (SELECT *, {NORM_SQL} AS norm FROM ({_schema_sql(TEXT_TABLES)}) WHERE {NORM_SQL} <> '') "
    "SELECT a.source || '.' || a.column_name AS column1, b.source || '.' || b.column_name AS column2, "
    f"'Name match (' || {Q}{Q}{Q}{Q} || a.norm || {Q}{Q}{Q}{Q} || ') + Type compatible (' || lower(a.type) || '/' "
    "|| lower(b.type) || ')' AS reason "
    f"FROM s a JOIN s b ON a.norm = b.norm AND {ORDERED_PAIR} "
    "WHERE (contains(lower(a.type), 'int') AND contains(lower(b.type), 'int')) "
    "OR (contains(lower(a.type), 'string') AND contains(lower(b.type), 'string')) "
    "OR (contains(lower(a.type), 'varchar') AND contains(lower(b.type), 'varchar')) OR lower(a.type) = lower(b.type)")

JN9_SQL = (
    f"WITH s AS (SELECT *, {NORM_SQL} AS norm FROM ({_schema_sql(TEXT_TABLES)}) WHERE length({NORM_SQL}) >= 2) "
    "SELECT a.source AS source1, a.column_name AS column1, b.source AS source2, b.column_name AS column2, "
    f"'Heuristic: Name match (' || {Q}{Q}{Q}{Q} || a.norm || {Q}{Q}{Q}{Q} || ') & Type compatible (' || lower(a.type) "
    "|| '/' || lower(b.type) || ')' AS rationale "
    f"FROM s a JOIN s b ON a.norm = b.norm AND a.source <> b.source AND {ORDERED_PAIR} "
    f"WHERE ({_family('a.type', relations.NUMERIC_FAMILY)} AND {_family('b.type', relations.NUMERIC_FAMILY)}) "
    f"OR ({_family('a.type', relations.STRING_FAMILY)} AND {_family('b.type', relations.STRING_FAMILY)}) "
    "OR lower(a.type) = lower(b.type)")


COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text", "benchmark": "item_id text",
    "pages": "page_id url html", "documents": "doc_id text lang source n_chars",
    "events": "event_id ts user_id event_type value props", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
                 "l_linestatus l_shipdate"),
}


def _counts_sql(names):
    return " UNION ALL ".join(f"SELECT '{t}' AS source, '{c}' AS column_name, count(*) AS rows, count({c}) AS present FROM {t}"
                              for t in names for c in COLUMNS[t].split())


@query("src9_schema_info", sql=f"""
SELECT i.*, n.rows, n.present FROM ({_schema_sql(SCHEMA_TABLES)}) i LEFT JOIN ({_counts_sql(SCHEMA_TABLES)}) n
  ON i.source = n.source AND i.column_name = n.column_name""")
def src9(spark, sf):
    tables = _tables(spark, SCHEMA_TABLES)
    return schema_info(spark, tables).join(schema_counts(tables), ["source", "column_name"], "left")


@query("jn8_join_key_candidates", sql=f"""
WITH n AS (SELECT source || '.' || column_name AS c, present FROM ({_counts_sql(TEXT_TABLES)}))
SELECT k.*, a.present AS values1, b.present AS values2 FROM ({JN8_SQL}) k
LEFT JOIN n a ON a.c = k.column1 LEFT JOIN n b ON b.c = k.column2""")
def jn8(spark, sf):
    tables = _tables(spark)
    return relations.with_counts(relations.join_key_candidates(schema_info(spark, tables)), tables, ("column1",), ("column2",))


@query("jn9_relationships", sql=f"""
WITH n AS ({_counts_sql(TEXT_TABLES)})
SELECT k.*, a.present AS values1, b.present AS values2 FROM ({JN9_SQL}) k
LEFT JOIN n a ON a.source = k.source1 AND a.column_name = k.column1
LEFT JOIN n b ON b.source = k.source2 AND b.column_name = k.column2""")
def jn9(spark, sf):
    tables = _tables(spark)
    return relations.with_counts(relations.find_relationships(schema_info(spark, tables)), tables,
                                 ("source1", "column1"), ("source2", "column2"))



def _containment_sql(pairs):
    parts = []
    for s1, c1, s2, c2 in pairs:
        parts.append(f"""
SELECT '{s1}' AS source1, '{c1}' AS column1, '{s2}' AS source2, '{c2}' AS column2,
       CAST(count(*) AS BIGINT) AS distinct_values,
       CAST(count(*) FILTER (WHERE v IN (SELECT {c2} FROM {s2})) AS BIGINT) AS matched_values,
       count(*) FILTER (WHERE v IN (SELECT {c2} FROM {s2})) / count(*) AS containment
FROM (SELECT DISTINCT {c1} AS v FROM {s1} WHERE {c1} IS NOT NULL)""")
    return "\nUNION ALL\n".join(parts)


REL_PAIRS = [("documents", "doc_id", "labels", "doc_id"), ("labels", "doc_id", "documents", "doc_id"),
             ("documents", "text", "benchmark", "text"), ("benchmark", "text", "documents", "text"),
             ("documents", "text", "conversations", "text"), ("conversations", "text", "documents", "text"),
             ("conversations", "text", "benchmark", "text"), ("benchmark", "text", "conversations", "text")]


@query("jn10_containment", sql=_containment_sql(REL_PAIRS))
def jn10(spark, sf):
    return relations.relationship_containment(spark, _tables(spark, ["documents", "labels", "conversations",
                                                                     "benchmark"]),
                                              schema_info(spark, _tables(spark, ["documents", "labels",
                                                                                 "conversations", "benchmark"])))


KEYED = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"],
         "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "nation": ["n_nationkey", "n_regionkey"],
         "region": ["r_regionkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"]}


@query("jn10_sketched_candidates", sql="WITH v AS (" + "\nUNION ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS BIGINT) AS v FROM {t}" for t, cs in KEYED.items() for c in cs) + """),
n AS (SELECT t, c, count(v) AS n FROM v GROUP BY t, c)
SELECT a.t AS source1, a.c AS column1, b.t AS source2, b.c AS column2, n.n AS distinct_values
FROM v a JOIN v b ON a.v = b.v AND (a.t <> b.t OR a.c <> b.c) JOIN n ON n.t = a.t AND n.c = a.c
GROUP BY ALL HAVING count(*) = n.n""")
def jn10s(spark, sf):
    """Columns whose values all occur in another column, found by sketches and confirmed exactly."""
    from vellum.operators import sketches
    tables = {t: spark.table(t).select(*cs) for t, cs in KEYED.items()}
    stored = None
    for t, df in tables.items():
        own = sketches.column_sketches(df, t)
        stored = own if stored is None else stored.unionByName(own)
    found = sketches.confirmed(sketches.containment_candidates(sketches.summary(stored)), tables)
    return found.select("source1", "column1", "source2", "column2", "distinct_values")
