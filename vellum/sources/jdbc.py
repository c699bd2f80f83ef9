"""Relational sources through Spark's JDBC reader.

``jdbc_options`` builds the URL and driver for the supported databases
(drivers are supplied by the cluster); ``read_jdbc`` reads a table or
query, split into ``num_partitions`` range queries on a numeric column so
that executors read in parallel and predicates are pushed to the database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Default ports and JDBC driver classes.
DEFAULT_PORTS = {"postgresql": 5432, "mysql": 3306, "mssql": 1433, "oracle": 1521}
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "oracle": "oracle.jdbc.OracleDriver",
    "sqlite": "org.sqlite.JDBC",
}


def jdbc_options(db_type: str, user: str | None = None, password: str | None = None, host: str | None = None,
                 port: int | None = None, database: str | None = None, service_name: str | None = None,
                 driver: str | None = None) -> dict:
    """URL, user and driver options for a supported database (default ports filled
    in; required fields checked)."""
    t = (db_type or "").lower()
    if t not in DRIVERS:
        raise ValueError(f"Unsupported database type: {db_type}")
    if t == "sqlite":
        if not database:
            raise ValueError("SQLite requires a database file path.")
        return {"url": f"jdbc:sqlite:{database}", "driver": driver or DRIVERS[t]}
    missing = [n for n, v in (("user", user), ("host", host)) if not v]
    if t == "oracle" and not (service_name or database):
        missing.append("service_name")
    elif t != "oracle" and not database:
        missing.append("database")
    if missing:
        raise ValueError(f"Missing required connection fields for {t}: {', '.join(missing)}")
    port = port or DEFAULT_PORTS[t]
    if t == "postgresql":
        url = f"jdbc:postgresql://{host}:{port}/{database}"
    elif t == "mysql":
        url = f"jdbc:mysql://{host}:{port}/{database}"
    elif t == "mssql":
        url = f"jdbc:sqlserver://{host}:{port};databaseName={database}"
    else:
        url = f"jdbc:oracle:thin:@//{host}:{port}/{service_name or database}"
    opts = {"url": url, "user": user, "driver": driver or DRIVERS[t]}
    if password is not None:
        opts["password"] = password
    return opts


def read_jdbc(spark: SparkSession, options: dict, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, fetch_size: int = 10000) -> DataFrame:
    """Read a table or query through JDBC, optionally as ``num_partitions`` range
    queries on a numeric column so executors read in parallel."""
    if bool(table) == bool(query):
        raise ValueError("Give exactly one of table or query.")
    r = spark.read.format("jdbc").options(**options).option("fetchsize", fetch_size)
    r = r.option("dbtable", table) if table else r.option("query", query)
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("Partitioned reads need lower_bound, upper_bound and num_partitions.")
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions))
    return r.load()
