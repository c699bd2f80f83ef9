"""Quality rules (DQ1-DQ13), alert rows (FLT4) and the all-sources job (JB1)."""


from vellum.operators import quality
from vellum.operators.jobs import check_sources
from vellum.suite import query

LI_RULES = [
    {"rule_name": "qty_not_null", "rule_type": "not_null", "column_name": "l_quantity"},
    {"rule_name": "qty_min", "rule_type": "min_value", "column_name": "l_quantity", "rule_parameters": {"min": 5}},
    {"rule_name": "qty_max", "rule_type": "max_value", "column_name": "l_quantity", "rule_parameters": {"max": 45}},
    {"rule_name": "flag_enum", "rule_type": "enum_values", "column_name": "l_returnflag",
     "rule_parameters": {"allowed": ["A", "N"]}},
    {"rule_name": "status_regex", "rule_type": "regex_match", "column_name": "l_linestatus",
     "rule_parameters": {"pattern": "O"}},
    {"rule_name": "flag_len", "rule_type": "min_length", "column_name": "l_returnflag", "rule_parameters": {"min": 1}},
    {"rule_name": "price_len", "rule_type": "max_length", "column_name": "l_extendedprice",
     "rule_parameters": {"max": 7}},
    {"rule_name": "key_unique", "rule_type": "is_unique", "column_name": "l_orderkey"},
]


# String columns of the test tables (a null failing value prints as 'None' there, 'nan' elsewhere).
TEXT_COLUMNS = {"l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "text", "lang", "source",
                "url", "html", "c_name", "c_mktsegment", "event_type", "role"}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _oracle_pred(rule: dict) -> str | None:
    t, c, p = rule["rule_type"], rule.get("column_name"), rule.get("rule_parameters") or {}
    text = f"CAST({c} AS VARCHAR)"
    if t == "not_null":
        return f"{c} IS NULL"
    if t == "min_value":
        return f"coalesce(CAST({c} AS DOUBLE) < {float(p['min'])}, false)"
    if t == "max_value":
        return f"coalesce(CAST({c} AS DOUBLE) > {float(p['max'])}, false)"
    if t == "enum_values":
        return f"{c} IS NOT NULL AND {c} NOT IN ({', '.join(_q(v) for v in p['allowed'])})"
    if t == "regex_match":
        return f"coalesce(NOT regexp_matches({text}, {_q('^(?:' + p['pattern'] + ')')}), true)"
    if t == "min_length":
        return f"coalesce(length({text}) < {int(p['min'])}, false)"
    if t == "max_length":
        return f"coalesce(length({text}) > {int(p['max'])}, false)"
    if t == "custom_sql":
        return f"coalesce(NOT ({p['condition']}), true)"
    return None


def oracle_rules(table: str, rules: list[dict], source: str | None = None) -> str:
    """Result rows of ``run_quality_checks`` written as plain SQL, one SELECT per rule."""
    selects = []
    src = "CAST(NULL AS VARCHAR)" if source is None else _q(source)
    for i, r in enumerate(rules):
        name = r.get("rule_name") or f"Rule_{i + 1}"
        t, c = r["rule_type"], r.get("column_name")
        if t == "is_unique":
            dup = f"SELECT {c} AS k FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1"
            n_sql = f"(SELECT count(*) FROM ({dup}))"
            samp = f"(SELECT list(v ORDER BY v) FROM (SELECT CAST(k AS VARCHAR) AS v FROM ({dup}) ORDER BY v LIMIT 5))"
        else:
            pred = _oracle_pred(r)
            n_sql = f"(SELECT count(*) FILTER (WHERE {pred}) FROM {table})"
            missing = "'None'" if c in TEXT_COLUMNS else "'nan'"
            samp = (f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), {missing}) AS v "
                    f"FROM {table} WHERE {pred} ORDER BY v LIMIT 5))")
        selects.append(f"""
SELECT {src} AS source, {_q(name)} AS rule_name, {_q(t)} AS rule_type, {_q(c) if c else 'CAST(NULL AS VARCHAR)'} AS column_name,
       CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, CAST(n AS BIGINT) AS violation_count,
       CASE WHEN n > 0 THEN 'Rule ' || {_q("'" + t + "'")} || ' failed for column ' || {_q("'" + str(c) + "'")} || ' on ' || n || ' rows.'
            ELSE 'Rule ' || {_q("'" + t + "'")} || ' passed.' END AS details,
       CASE WHEN n > 0 THEN {samp} END AS sample_failures
FROM (SELECT {n_sql} AS n)""")
    return "\nUNION ALL".join(selects)


@query("dq11_runner", sql=oracle_rules("lineitem", LI_RULES))
def dq11(spark, sf):
    return quality.run_quality_checks(spark.table("lineitem"), LI_RULES)


for _r in LI_RULES:
    _id = {"not_null": "dq1", "is_unique": "dq2", "min_value": "dq3", "max_value": "dq4", "regex_match": "dq5",
           "enum_values": "dq6", "min_length": "dq7", "max_length": "dq8"}[_r["rule_type"]]

    def _mk(rule=_r):
        return lambda spark, sf: quality.run_quality_checks(spark.table("lineitem"), [rule])

    query(f"{_id}_{_r['rule_type']}", sql=oracle_rules("lineitem", [_r]))(_mk())


NULL_RULES = [
    {"rule_name": "price_present", "rule_type": "not_null", "column_name": "o_totalprice"},
    {"rule_name": "prio_present", "rule_type": "not_null", "column_name": "o_orderpriority"},
    {"rule_name": "prio_enum", "rule_type": "enum_values", "column_name": "o_orderpriority",
     "rule_parameters": {"allowed": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}},
    {"rule_name": "prio_regex", "rule_type": "regex_match", "column_name": "o_orderpriority",
     "rule_parameters": {"pattern": "[1-3]-"}},
    {"rule_name": "price_min", "rule_type": "min_value", "column_name": "o_totalprice",
     "rule_parameters": {"min": 2000}},
]


@query("dq1_not_null_with_nulls", views=["orders_nulls"], sql=oracle_rules("orders_nulls", NULL_RULES))
def dq1n(spark, sf):
    return quality.run_quality_checks(spark.table("orders_nulls"), NULL_RULES)


DOC_RULES = [
    {"rule_name": "text_unique", "rule_type": "is_unique", "column_name": "text"},
    {"rule_name": "text_min", "rule_type": "min_length", "column_name": "text", "rule_parameters": {"min": 40}},
    {"rule_name": "text_max", "rule_type": "max_length", "column_name": "text", "rule_parameters": {"max": 15000}},
    {"rule_name": "lang_enum", "rule_type": "enum_values", "column_name": "lang",
     "rule_parameters": {"allowed": ["en", "de", "fr"]}},
]


@query("dq2_is_unique_documents", sql=oracle_rules("documents", DOC_RULES))
def dq2d(spark, sf):
    return quality.run_quality_checks(spark.table("documents"), DOC_RULES)


URL_RULES = [
    {"rule_name": "https_only", "rule_type": "regex_match", "column_name": "url",
     "rule_parameters": {"pattern": "https://"}},
    {"rule_name": "url_len", "rule_type": "max_length", "column_name": "url", "rule_parameters": {"max": 40}},
]


@query("dq5_regex_match_urls", sql=oracle_rules("pages", URL_RULES))
def dq5u(spark, sf):
    return quality.run_quality_checks(spark.table("pages"), URL_RULES)


STATUS_RULES = [
    {"rule_name": "no_type", "column_name": "l_quantity"},
    {"rule_name": "bad_column", "rule_type": "not_null", "column_name": "nope"},
    {"rule_name": "text_min", "rule_type": "min_value", "column_name": "l_returnflag", "rule_parameters": {"min": 1}},
    {"rule_name": "no_param", "rule_type": "max_value", "column_name": "l_quantity"},
    {"rule_name": "unknown", "rule_type": "fancy", "column_name": "l_quantity"},
    {"rule_name": "disc_ok", "rule_type": "max_value", "column_name": "l_discount", "rule_parameters": {"max": 1}},
]


@query("dq9_status", sql="""
SELECT CAST(NULL AS VARCHAR) AS source, *, CAST(NULL AS VARCHAR[]) AS sample_failures FROM (VALUES
 ('no_type', NULL, 'l_quantity', 'skipped', 0, 'Missing rule_type.'),
 ('bad_column', 'not_null', 'nope', 'error', NULL, 'Error executing rule: The table has no column ''nope'' to check.'),
 ('text_min', 'min_value', 'l_returnflag', 'error', NULL, 'Error executing rule: A min_value rule checks numbers, ''l_returnflag'' holds none.'),
 ('no_param', 'max_value', 'l_quantity', 'error', NULL, 'Error executing rule: A max_value rule needs a value for ''max''.'),
 ('unknown', 'fancy', 'l_quantity', 'error', NULL, 'Error executing rule: There are no ''fancy'' rules.')
) AS t(rule_name, rule_type, column_name, status, violation_count, details)
UNION ALL
SELECT NULL, 'disc_ok', 'max_value', 'l_discount', CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END,
       n, CASE WHEN n > 0 THEN 'failed' ELSE 'Rule ''max_value'' passed.' END, NULL
FROM (SELECT count(*) FILTER (WHERE l_discount > 1) AS n FROM lineitem)""")
def dq9(spark, sf):
    return quality.run_quality_checks(spark.table("lineitem"), STATUS_RULES)


CUSTOM_RULES = [
    {"rule_name": "net_positive", "rule_type": "custom_sql",
     "rule_parameters": {"condition": "l_extendedprice * (1 - l_discount) > 1000"}},
    {"rule_name": "rows_between", "rule_type": "table_row_count", "rule_parameters": {"min": 10, "max": 100}},
]


@query("dq12_custom_sql_and_row_count", sql="""
SELECT CAST(NULL AS VARCHAR) AS source, 'net_positive' AS rule_name, 'custom_sql' AS rule_type,
       CAST(NULL AS VARCHAR) AS column_name, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status,
       n AS violation_count,
       CASE WHEN n > 0 THEN 'Rule ''custom_sql'' failed for column ''None'' on ' || n || ' rows.'
            ELSE 'Rule ''custom_sql'' passed.' END AS details, CAST(NULL AS VARCHAR[]) AS sample_failures
FROM (SELECT count(*) FILTER (WHERE NOT (l_extendedprice * (1 - l_discount) > 1000)) AS n FROM lineitem)
UNION ALL
SELECT NULL, 'rows_between', 'table_row_count', NULL,
       CASE WHEN t < 10 OR t > 100 THEN 'failed' ELSE 'passed' END, CASE WHEN t < 10 OR t > 100 THEN 1 ELSE 0 END,
       CASE WHEN t < 10 OR t > 100 THEN 'Rule ''table_row_count'' failed: table has ' || t || ' rows.'
            ELSE 'Rule ''table_row_count'' passed.' END, NULL
FROM (SELECT count(*) AS t FROM lineitem)""")
def dq12(spark, sf):
    return quality.run_quality_checks(spark.table("lineitem"), CUSTOM_RULES, samples=False)


QUARANTINE_RULES = [LI_RULES[1], LI_RULES[3], {"rule_name": "key_unique", "rule_type": "is_unique",
                                                "column_name": "o_orderkey"}]


def _quarantine_sql(which: str) -> str:
    flags = ("list_filter([CASE WHEN coalesce(l_quantity < 5.0, false) THEN 'qty_min' END, "
             "CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag_enum' END, "
             "CASE WHEN d.k IS NOT NULL THEN 'key_unique' END], lambda x: x IS NOT NULL)")
    base = f"""
WITH d AS (SELECT l_orderkey AS k FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1),
t AS (SELECT l.*, {flags} AS failed_rules FROM lineitem l LEFT JOIN d ON l.l_orderkey = d.k)"""
    if which == "good":
        return base + "\nSELECT * EXCLUDE (failed_rules) FROM t WHERE len(failed_rules) = 0"
    return base + "\nSELECT * FROM t WHERE len(failed_rules) > 0"


_QR = [LI_RULES[1], LI_RULES[3], LI_RULES[7]]


@query("dq13_quarantine_good", sql=_quarantine_sql("good"))
def dq13g(spark, sf):
    return quality.split(spark.table("lineitem"), _QR)[0]


@query("dq13_quarantine_bad", sql=_quarantine_sql("bad"))
def dq13b(spark, sf):
    return quality.split(spark.table("lineitem"), _QR)[1]


@query("flt4_alerts", sql=f"""
SELECT 'lineitem' AS source, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed_count,
       CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS error_count, list(rule_name ORDER BY rule_name) AS rules
FROM ({oracle_rules('lineitem', LI_RULES, 'lineitem')}) r WHERE status IN ('failed', 'error')""")
def flt4(spark, sf):
    return quality.alerts(quality.run_quality_checks(spark.table("lineitem"), LI_RULES, source="lineitem"))


JOB_RULES = ([dict(r, source="lineitem", is_active=True) for r in LI_RULES[:3]]
             + [dict(r, source="orders_nulls", is_active=True) for r in NULL_RULES[:2]]
             + [dict(DOC_RULES[1], source="documents", is_active=True),
                dict(DOC_RULES[0], source="documents", is_active=False),
                dict(LI_RULES[4], source="missing_table", is_active=True)])


@query("jb1_check_all_sources", views=["orders_nulls"], sql=f"""
SELECT source, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed_count,
       CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS error_count,
       CAST(count(*) AS BIGINT) AS rules_run
FROM ({oracle_rules('lineitem', LI_RULES[:3], 'lineitem')}
      UNION ALL {oracle_rules('orders_nulls', NULL_RULES[:2], 'orders_nulls')}
      UNION ALL {oracle_rules('documents', [DOC_RULES[1]], 'documents')}) r
GROUP BY source""")
def jb1(spark, sf):
    return check_sources(spark, JOB_RULES, lambda name: spark.table(name)).summary
