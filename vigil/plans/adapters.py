"""The given tables seen as security data.

``events`` carries no addresses, hosts or requests, so these are derived from its columns. The same expressions
are used by the queries and by the checking SQL; only JSON access, time and one column name differ.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.exprs import once

HOUR = 3_600_000_000

BASE_SPARK = [
    "event_id", "ts", "user_id", "event_type as raw_type", "value",
    "cast(get_json_object(props, '$.k') as int) as k",
    "unix_micros(cast(ts as timestamp)) as t",
    "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") as iso",
    "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss') as clf",
    "date_format(ts, 'MMM dd HH:mm:ss') as bsd",
]
BASE_DUCK = (
    "SELECT event_id, ts, user_id, event_type AS raw_type, value, "
    "CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) AS t, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(ts, '%d/%b/%Y:%H:%M:%S') AS clf, "
    "strftime(ts, '%b %d %H:%M:%S') AS bsd FROM events"
)

# column -> expression valid in both engines
SNAPSHOT = {
    "event_id": "event_id",
    "t": "t",
    "k": "k",
    "value": "value",
    "iso": "iso",
    "clf": "clf",
    "bsd": "bsd",
    "usr": "CASE WHEN k % 13 = 0 THEN NULL ELSE 'user' || CAST(user_id % 10 AS STRING) END",
    "source_ip": "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 29 = 0 THEN '10.0.0.99' "
    "ELSE '10.0.0.' || CAST(user_id % 5 AS STRING) END",
    "host": "CASE WHEN k % 17 = 0 THEN NULL ELSE 'host' || CAST(k % 4 AS STRING) END",
    "source": "CASE raw_type WHEN 'click' THEN 'nginx' WHEN 'view' THEN 'dns-server' "
    "WHEN 'purchase' THEN 'docker' ELSE 'auth-service' END",
    "event_type": "CASE raw_type WHEN 'error' THEN 'login_failed' WHEN 'click' THEN 'nginx.access' "
    "WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN 'process.exec' WHEN k % 37 = 1 THEN 'malware.detected' "
    "WHEN k % 37 = 2 THEN 'unauthorized_access' ELSE 'login_success' END "
    "WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'dns.query' WHEN 1 THEN 'browser.search' ELSE 'browser.download' END "
    "ELSE CASE k % 3 WHEN 0 THEN 'container.restart' WHEN 1 THEN 'container.stop' ELSE 'container.create' END END",
    "severity": "CASE WHEN k % 23 = 0 THEN 'critical' WHEN k % 7 = 0 THEN 'high' WHEN k % 3 = 0 THEN 'medium' "
    "ELSE 'low' END",
    "message": "CASE raw_type WHEN 'error' THEN 'Failed login for user ' || CAST(user_id AS STRING) "
    "WHEN 'purchase' THEN 'docker exec bash step ' || CAST(k AS STRING) "
    "WHEN 'signup' THEN 'Session opened, code ' || CAST(k AS STRING) "
    "WHEN 'view' THEN 'query: item ' || CAST(k AS STRING) || ' downloaded' ELSE 'GET page ' || CAST(k AS STRING) END",
    "http_method": "CASE WHEN raw_type <> 'click' THEN NULL WHEN k % 3 = 0 THEN 'GET' ELSE 'POST' END",
    "request_uri": "CASE WHEN raw_type <> 'click' THEN NULL WHEN k % 10 < 3 THEN '/app/login' "
    "WHEN k % 10 = 3 THEN '/item/1%20union+select+name' WHEN k % 10 = 4 THEN '/static/../../etc/passwd' "
    "WHEN k % 10 = 5 THEN '/Admin/page' || CAST(k AS STRING) WHEN k % 10 = 6 THEN '/.git/obj' || CAST(k AS STRING) "
    "WHEN k % 10 = 7 THEN '/config/' || CAST(user_id % 4 AS STRING) ELSE '/shop/' || CAST(k AS STRING) END",
    "query_string": "CASE WHEN raw_type <> 'click' THEN NULL WHEN k % 20 = 8 THEN 'id=1 or 1=1' "
    "WHEN k % 2 = 0 THEN 'page=' || CAST(k AS STRING) ELSE '' END",
    "status_code": "CASE WHEN raw_type <> 'click' THEN NULL WHEN k % 5 = 0 THEN '403' WHEN k % 5 = 1 THEN '401' "
    "WHEN k % 5 = 2 THEN '401' WHEN k % 15 = 3 THEN '500' WHEN k % 5 = 4 THEN '404' ELSE '200' END",
    "user_agent": "CASE WHEN raw_type <> 'click' THEN NULL WHEN k % 19 = 0 THEN 'SqlMap/1.7' "
    "WHEN k % 19 = 1 THEN 'scan zap/2' ELSE 'Mozilla/5.0' END",
}

# one raw JSON text per event; k % 10 picks what is wrong with it
RAW = (
    "CASE k % 10 "
    "WHEN 0 THEN '{\"source\":\"app\",\"message\":\"no type ' || CAST(user_id % 7 AS STRING) || '\",\"severity\":\"low\"}' "
    "WHEN 1 THEN '{\"source\":\"app\",\"event_type\":\"auth.failure\",\"message\":\"m\",\"timestamp\":\"not-a-time\"}' "
    "WHEN 2 THEN '{\"log_source\":\" app \",\"type\":\"Port.Scan\",\"msg\":\"alias ' || CAST(k AS STRING) || '\",\"src_ip\":\"fe80::1\","
    "\"username\":\"u1\",\"hostname\":\"h1\",\"level\":\"CRITICAL\",\"time\":\"' || iso || 'Z\"}' "
    "WHEN 3 THEN '{\"source\":\"app\",\"event_type\":\"api.abuse\",\"message\":\"m\",\"severity\":\"warning\"}' "
    "WHEN 4 THEN '{\"source\":\"app\",\"event_type\":\"x\",\"message\":\"m\",\"severity\":\"High\",\"source_ip\":\"999.1.1.1\"}' "
    "WHEN 5 THEN '{\"event_type\":\"auth.failure\",\"code\":' || CAST(user_id AS STRING) || '}' "
    "WHEN 6 THEN '{\"source\":\"app\",\"event_type\":' "
    "WHEN 7 THEN '   ' "
    "WHEN 8 THEN '{\"source\":\"app\",\"event_type\":\"windows_event\",\"message\":\"m\",\"severity\":\"low\",\"timestamp\":'"
    " || CAST(CAST(floor(t / 1000000) AS BIGINT) AS STRING) || ',\"metadata\":{\"event_id\":' || CAST(4600 + k AS STRING) || "
    "',\"event_data\":{\"IpAddress\":\"10.1.1.1\",\"SubjectUserName\":\"svc\"},\"record_number\":\"' || CAST(k AS STRING) || '\"}}' "
    "ELSE '{\"source\":\"\",\"log_source\":\"second\",\"event_type\":\"login\",\"message\":\"m\",\"severity\":\"low\",\"source_ip\":\"10.0.0.1\",\"record_number\":' "
    "|| CAST(user_id AS STRING) || '}' END"
)

EXPRESSIONS = {**SNAPSHOT, "user_id": "user_id", "raw_type": "raw_type", "raw": RAW}


def duck_snapshot(name: str = "snap") -> str:
    columns = ", ".join(f"{e} AS {n}" for n, e in EXPRESSIONS.items())
    return f"{name} AS (SELECT {columns} FROM ({BASE_DUCK}))"


def oracle(body: str, *ctes: str, recursive: bool = False) -> str:
    """Checking SQL over ``snap`` and further named subqueries."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([duck_snapshot(), *ctes]) + "\n" + body


class Tables:
    """The parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows of an input with fewer splits than cores (one small file) dealt out to all of them."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def snapshot(self) -> DataFrame:
        base = self.spread(self.table("events")).selectExpr(*BASE_SPARK)
        return base.selectExpr(*[f"{e} AS {'`user`' if n == 'usr' else n}" for n, e in EXPRESSIONS.items()])

    @cached_property
    def events(self) -> DataFrame:
        """Snapshots with web fields also in a ``metadata`` map, as the rule and detection operators read them."""
        names = ["http_method", "request_uri", "query_string", "status_code", "user_agent"]
        meta = F.map_filter(
            F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull()
        )
        return self.snapshot.withColumn("metadata", once(meta))
