"""Document operators (SRC6, SRC7, SRC10) on the events table shaped as documents."""

from pyspark.sql import functions as F

from vellum.sources import documents as docs
from vellum.sources.schema import json_schema
from vellum.sources.sinks import scratch_path
from vellum.suite import query


def _coll(spark):
    return docs.as_documents(spark.table("events"))


@query("src6_find", sql="""
SELECT user_id AS uid, event_type AS type, value, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events WHERE event_type IN ('click', 'purchase') AND value > 10 AND user_id <> 7""")
def src6(spark, sf):
    found = docs.find(_coll(spark), {"type": {"$in": ["click", "purchase"]}, "value": {"$gt": 10},
                                     "user.id": {"$ne": 7}})
    return found.select(F.col("user.id").alias("uid"), "type", "value", "ts", F.col("props.k").alias("k"))


@query("src6_find_or_projection", sql="""
SELECT event_id AS _id, event_type AS type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
WHERE (CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90 OR event_type = 'signup') AND event_type NOT IN ('view')""")
def src6p(spark, sf):
    q = {"$or": [{"props.k": {"$gte": 90}}, {"type": "signup"}], "type": {"$nin": ["view"]}}
    return docs.aggregate(_coll(spark), [{"$match": q}, {"$project": {"_id": 1, "type": 1, "k": "$props.k"}}],
                          drop_id=False)


@query("src7_aggregate_group", rounds={"total": 2, "avg_k": 6}, sql="""
SELECT event_type AS _id, sum(value) AS total, count(*) AS n, avg(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS avg_k
FROM events WHERE value >= 1 GROUP BY event_type ORDER BY total DESC LIMIT 3""")
def src7(spark, sf):
    return docs.aggregate(_coll(spark), [
        {"$match": {"value": {"$gte": 1}}},
        {"$group": {"_id": "$type", "total": {"$sum": "$value"}, "n": {"$count": {}}, "avg_k": {"$avg": "$props.k"}}},
        {"$sort": {"total": -1}}, {"$limit": 3}], drop_id=False)


@query("src7_aggregate_lookup", sql="""
SELECT e.event_id AS _id, e.user_id AS uid, c.c_name AS cname FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
WHERE e.event_type = 'purchase'""")
def src7l(spark, sf):
    out = docs.aggregate(_coll(spark), [
        {"$match": {"type": "purchase"}},
        {"$addFields": {"uid": "$user.id"}},
        {"$lookup": {"from": "customer", "localField": "uid", "foreignField": "c_custkey", "as": "cust"}},
        {"$project": {"_id": 1, "uid": 1, "cname": "$cust.c_name"}}], {"customer": spark.table("customer")},
        drop_id=False)
    return out


@query("src7_aggregate_unwind", sql="""
SELECT vec_id AS _id, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE label = 3)
WHERE x > 0.25""")
def src7u(spark, sf):
    coll = spark.table("embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("x"), "label")
    out = docs.aggregate(coll, [{"$match": {"label": 3}}, {"$unwind": "$x"}, {"$match": {"x": {"$gt": 0.25}}},
                                {"$project": {"_id": 1, "x": 1}}], drop_id=False)
    return out.withColumn("x", F.col("x").cast("double"))


@query("src10_document_schema")
def src10(spark, sf):
    path = scratch_path(spark, "docs-json")
    _coll(spark).write.json(path)
    return json_schema(spark, path)


@query("sf8_safe_get", sql="""
SELECT event_id AS _id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, user_id AS uid,
       'anon' AS name, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k_text, -1 AS missing_key
FROM events""")
def sf8(spark, sf):
    from vellum.functions.nested import safe_get
    coll = _coll(spark).withColumn("props_text", F.to_json("props"))
    return coll.select("_id", safe_get(coll, ["props", "k"], -1).alias("k"), safe_get(coll, ["user", "id"]).alias("uid"),
                       safe_get(coll, ["user", "name"], "anon").alias("name"),
                       safe_get(coll, ["props_text", "k"], 0).alias("k_text"),
                       safe_get(coll, ["props", "nope"], -1).alias("missing_key"))


@query("sf8_safe_get_arrays", sql="""
SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last,
       CAST(0.0 AS DOUBLE) AS beyond FROM embeddings""")
def sf8a(spark, sf):
    from vellum.functions.nested import safe_get
    e = spark.table("embeddings")
    return e.select("vec_id", safe_get(e, ["embedding", 0]).cast("double").alias("first"),
                    safe_get(e, ["embedding", -1]).cast("double").alias("last"),
                    safe_get(e, ["embedding", 10_000], 0.0).cast("double").alias("beyond"))


@query("src7_aggregate_drops_id", rounds={"total": 2}, sql="""
SELECT sum(value) AS total, count(*) AS n FROM events GROUP BY event_type""")
def src7d(spark, sf):
    """As the reference: the result loses ``_id`` (here the group key)."""
    return docs.aggregate(_coll(spark), [{"$group": {"_id": "$type", "total": {"$sum": "$value"}, "n": {"$count": {}}}}])
