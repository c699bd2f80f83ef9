import pytest

from vellum.sources import documents as docs
from vellum.sources.files import object_path, read_file
from vellum.sources.jdbc import jdbc_options


def test_jdbc_options():
    o = jdbc_options("postgresql", user="u", password="p", host="h", database="d")
    assert o["url"] == "jdbc:postgresql://h:5432/d"
    assert jdbc_options("mssql", user="u", host="h", database="d")["url"].startswith("jdbc:sqlserver://h:1433")
    assert jdbc_options("oracle", user="u", host="h", service_name="s")["url"] == "jdbc:oracle:thin:@//h:1521/s"
    with pytest.raises(ValueError):
        jdbc_options("mysql", host="h")
    with pytest.raises(ValueError):
        jdbc_options("db2")


def test_object_paths():
    assert object_path("s3", "b", "k/x.csv") == "s3a://b/k/x.csv"
    assert object_path("gcs", "b", "/k.json") == "gs://b/k.json"


def test_read_file_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        read_file(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(ValueError):
        read_file(spark, str(tmp_path / "x.bin"))
    with pytest.raises(FileNotFoundError):
        read_file(spark, str(tmp_path / "missing.csv"))
    p = tmp_path / "records.json"
    p.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert sorted(r.a for r in read_file(spark, str(p)).collect()) == [1, 2]
    c = tmp_path / "t.csv"
    c.write_text("a,b\n1,\n2,y\n")
    rows = read_file(spark, str(c)).orderBy("a").collect()
    assert rows[0].b is None and rows[1].b == "y"


def test_document_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 20)], "_id int, t string, v int")
    def ids(q):
        return sorted(r["t"] for r in docs.find(df, q).collect())
    assert ids({"v": {"$gt": 4, "$lt": 10}}) == ["a"]
    assert ids({"v": {"$ne": 5}}) == ["b", "c"]
    assert ids({"v": {"$exists": False}}) == ["b"]
    assert ids({"$or": [{"t": "a"}, {"v": {"$gte": 20}}]}) == ["a", "c"]
    assert ids({"t": {"$nin": ["a"]}}) == ["b", "c"]
    assert "_id" not in docs.find(df, {}).columns
    g = docs.aggregate(df, [{"$group": {"_id": None, "total": {"$sum": "$v"}}}]).first()
    assert g.total == 25
    with pytest.raises(ValueError):
        docs.aggregate(df, [{"$group": {"_id": "$t", "all": {"$push": "$v"}}}])


def test_safe_get(spark):
    from pyspark.sql import functions as F
    from vellum.functions.nested import safe_get
    df = spark.createDataFrame([({"a": 1}, [1.0, 2.0], '{"x": {"y": 5}}', {"k": "v"})],
                               "s struct<a:int>, arr array<double>, j string, m map<string,string>")
    r = df.select(safe_get(df, ["s", "a"]), safe_get(df, ["s", "zz"], 7), safe_get(df, ["arr", 5], 0.0),
                  safe_get(df, ["j", "x", "y"], 0), safe_get(df, ["m", "k"]), safe_get(df, ["m", "q"], "d"),
                  safe_get(df, ["nope"], "z")).first()
    assert tuple(r) == (1, 7, 0.0, 5, "v", "d", "z")


def test_document_filter_pushdown(spark, tmp_path):
    p = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(1, "a", 5), (2, "b", 50)], "_id int, t string, v int").write.parquet(p)
    df = spark.read.parquet(p)
    out = docs.find(df, {"v": {"$gt": 10}, "t": {"$in": ["a", "b"]}})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,10)" in plan and "In(t" in plan
    assert sorted(r["t"] for r in docs.find(df, {"$nor": [{"v": {"$gt": 10}}, {"t": "zz"}]}).collect()) == ["a"]


def test_run_sql(spark):
    from vellum.plans.sql import run_sql
    with pytest.raises(ValueError):
        run_sql(spark, "   ")
    run_sql(spark, "CREATE OR REPLACE TEMP VIEW v_small AS SELECT id FROM range(10)")
    assert run_sql(spark, "SELECT count(*) AS n FROM v_small WHERE id > :lo", {"lo": 4}).first().n == 5


def test_find_returns_every_match(spark):
    df = spark.range(150_000).selectExpr("id AS _id", "id AS v")
    assert docs.find(df, {"v": {"$gte": 0}}).count() == 150_000
    assert docs.find(df, {}, limit=0).count() == 0


def test_first_and_last_follow_the_sort(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("a", 3, "y"), ("b", 5, "z"), ("b", None, "n")],
                               "g string, o int, v string").repartition(3)
    for way, first, last in ((1, {"a": "x", "b": "n"}, {"a": "y", "b": "z"}), (-1, {"a": "y", "b": "z"}, {"a": "x", "b": "n"})):
        out = docs.aggregate(df, [{"$sort": {"o": way}},
                                  {"$group": {"_id": "$g", "f": {"$first": "$v"}, "l": {"$last": "$v"}}}], drop_id=False)
        rows = {r["_id"]: (r["f"], r["l"]) for r in out.collect()}
        assert rows == {k: (first[k], last[k]) for k in first}
    with pytest.raises(ValueError):
        docs.aggregate(df, [{"$sort": {"o": 1, "v": -1}}, {"$group": {"_id": "$g", "f": {"$first": "$v"}}}])


def test_nested_unwind_and_lookup_then_unwind(spark):
    df = spark.createDataFrame([(1, ([1, 2], "p")), (2, ([], "q"))], "_id int, d struct<xs: array<int>, t: string>")
    out = docs.aggregate(df, [{"$unwind": "$d.xs"}], drop_id=False)
    assert sorted((r["_id"], r["d"]["xs"], r["d"]["t"]) for r in out.collect()) == [(1, 1, "p"), (1, 2, "p")]
    other = spark.createDataFrame([(1, "one"), (1, "uno")], "k int, n string")
    for keep, n in ((False, 2), (True, 3)):
        out = docs.aggregate(df, [{"$lookup": {"from": "o", "localField": "_id", "foreignField": "k", "as": "m"}},
                                  {"$unwind": {"path": "$m", "preserveNullAndEmptyArrays": keep}}], {"o": other})
        assert out.count() == n


def test_sketches_read_new_parts_only(spark, tmp_path):
    from vellum.operators import sketches
    path = str(tmp_path / "sketches")
    first = spark.range(0, 60_000).selectExpr("id", "id % 7 AS few", "IF(id % 3 = 0, double('nan'), id) AS x")
    second = spark.range(50_000, 100_000).selectExpr("id", "id % 9 AS few", "CAST(id AS DOUBLE) AS x")
    sketches.refresh(first, path, "t", "1")
    sketches.refresh(second, path, "t", "2")
    sketches.refresh(second, path, "t", "2")  # a part stored again replaces itself
    got = {r.column_name: r for r in sketches.summary(spark.read.parquet(path)).collect()}
    assert got["id"].rows == 110_000 and got["x"].missing == 20_000 and got["few"].distinct_count == 9
    assert abs(got["id"].distinct_count - 100_000) <= 100_000 * sketches.bound()


def test_sketch_candidates_are_confirmed_exactly(spark):
    from vellum.operators import sketches
    tables = {"a": spark.range(30_000).selectExpr("CAST(id AS INT) AS k", "CAST(id AS STRING) AS s"),
              "b": spark.range(40_000).selectExpr("id AS key", "id + 1 AS shifted", "'x' AS s"),
              "empty": spark.range(0).selectExpr("id AS none")}
    stored = None
    for t, df in tables.items():
        own = sketches.column_sketches(df, t)
        stored = own if stored is None else stored.unionByName(own)
    near = sketches.containment_candidates(sketches.summary(stored))
    pairs = {(r.source1, r.column1, r.source2, r.column2) for r in near.collect()}
    assert ("a", "k", "b", "key") in pairs and ("a", "k", "b", "shifted") in pairs  # all but one value
    assert not any("s" in (p[1], p[3]) or "empty" in (p[0], p[2]) for p in pairs)
    sure = {(r.source1, r.column1, r.source2, r.column2) for r in sketches.confirmed(near, tables).collect()}
    assert ("a", "k", "b", "key") in sure and ("a", "k", "b", "shifted") not in sure
