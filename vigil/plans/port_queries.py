"""Port traffic, log search, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.operators import ports as P
from vigil.operators import reports as L
from vigil.operators.detect import detect
from vigil.plans.adapters import HOUR, oracle
from vigil.plans.detect_queries import VERDICT
from vigil.plans.registry import query

PORTS = "[8080, 8081, 443, 22, 9999]"
CONN = f"""conn AS (SELECT event_id, t, ({PORTS})[user_id % 5 + 1] AS port, '10.0.' || CAST(k % 4 AS VARCHAR) || '.' || CAST(user_id % 7 AS VARCHAR) AS remote_ip,
  1000 + k % 3 AS remote_port, CASE WHEN k % 5 = 0 THEN 'SYN_RECV' ELSE 'ESTABLISHED' END AS state FROM snap WHERE user_id % 5 <> 4)"""
WIDTH = 6 * HOUR
WIN = f"CAST(t // {WIDTH} * {WIDTH} AS BIGINT) AS win"


def conns(t):
    k, u = F.col("k"), F.col("user_id")
    return P.connections(t.snapshot.select(
        "event_id", "t", F.get(F.array(*map(F.lit, [8080, 8081, 443, 22, 9999])), (u % 5).cast("int")).alias("port"),
        F.concat(F.lit("10.0."), (k % 4).cast("string"), F.lit("."), (u % 7).cast("string")).alias("remote_ip"),
        (1000 + k % 3).alias("remote_port"), F.when(k % 5 == 0, "SYN_RECV").otherwise("ESTABLISHED").alias("state")))


WINDOWS = f"""win AS (SELECT {WIN}, port, count(*) AS event_count, count(DISTINCT (remote_ip, remote_port)) AS unique_pairs,
  count(DISTINCT remote_ip) AS unique_ips FROM conn GROUP BY ALL)"""
TOPS = f"""tops AS (SELECT *, row_number() OVER (PARTITION BY win, port ORDER BY n DESC, remote_ip) AS rank FROM
  (SELECT {WIN}, port, remote_ip, count(*) AS n FROM conn GROUP BY ALL) QUALIFY rank <= 10)"""


@query("port_window", oracle("SELECT *, greatest(event_count, unique_pairs) AS connection_count FROM win", CONN, WINDOWS))
def _(t):
    return P.connection_windows(conns(t), WIDTH)


@query("port_top_ips", oracle("SELECT * FROM tops", CONN, TOPS))
def _(t):
    return P.top_source_ips(conns(t), WIDTH)


@query("port_state_counts", oracle(f"SELECT {WIN}, port, state, count(*) AS n FROM conn GROUP BY ALL", CONN))
def _(t):
    return P.state_counts(conns(t), WIDTH)


ANOMALY = f"""anomaly AS (SELECT win + {WIDTH} AS t, w.port, event_count AS connection_count, unique_ips, (SELECT remote_ip FROM tops x WHERE x.win = w.win
  AND x.port = w.port AND rank = 1) AS source_ip FROM win w WHERE greatest(event_count, unique_pairs) > 18)"""


def anomalies(t):
    return P.port_anomalies(conns(t), threshold=18, width=WIDTH)


@query("port_anomaly", oracle("""SELECT t, port, connection_count, unique_ips, source_ip, 'Abnormal traffic volume detected: ' || CAST(connection_count AS VARCHAR) ||
  ' connection attempts on port ' || CAST(port AS VARCHAR) || ' in 21600s (threshold: 18)' AS message FROM anomaly""", CONN, WINDOWS, TOPS, ANOMALY))
def _(t):
    return anomalies(t).select("t", "port", "connection_count", "unique_ips", "source_ip", "message")


@query("port_cooldown", oracle(f"""SELECT a.t, a.port, a.connection_count FROM anomaly a JOIN cool USING (port, t)""", CONN, WINDOWS, TOPS, ANOMALY,
       f"""cool AS (SELECT port, min(t) AS t FROM anomaly GROUP BY port UNION ALL SELECT port, u FROM
       (SELECT c.port, (SELECT min(a.t) FROM anomaly a WHERE a.port = c.port AND a.t >= c.t + {20 * HOUR}) AS u FROM cool c) WHERE u IS NOT NULL)""",
       recursive=True))
def _(t):
    return P.port_cooldown(anomalies(t), 20 * HOUR).select("t", "port", "connection_count")


@query("port_new_connections", oracle(f"""SELECT DISTINCT a.snapshot_id, a.remote_ip, a.remote_port, a.port AS local_port FROM
  (SELECT *, t // {WIDTH} AS snapshot_id FROM conn) a WHERE NOT EXISTS (SELECT 1 FROM conn b WHERE b.t // {WIDTH} = a.snapshot_id - 1 AND b.remote_ip = a.remote_ip
  AND b.remote_port = a.remote_port AND b.port = a.port)""", CONN))
def _(t):
    snaps = conns(t).select(F.floor(F.col("t") / WIDTH).alias("snapshot_id"), "remote_ip", "remote_port", F.col("port").alias("local_port")).distinct()
    return P.new_connections(snaps)


@query("port_history", oracle(f"""SELECT port AS monitored_port, remote_ip AS source_ip, CAST(t // {WIDTH} * {WIDTH} AS BIGINT) AS first_seen, count(*) AS activity_count,
  CAST(t // {WIDTH} * {WIDTH} AS BIGINT) + {WIDTH} AS last_seen, 21600.0 AS observed_duration_seconds FROM conn GROUP BY ALL""", CONN))
def _(t):
    return P.traffic_history(conns(t), WIDTH)


# interval records: an event is activity from t for ``value`` minutes
START, END = 1704499200000000, 1704758400000000  # 2024-01-06 .. 2024-01-09
REC = """rec AS (SELECT 8080 + user_id % 3 AS monitored_port, CASE WHEN k % 31 = 0 THEN '203.0.113.50' WHEN k % 31 = 1 THEN '127.0.0.1' WHEN k % 31 = 2 THEN '172.20.1.1'
  WHEN k % 31 = 3 THEN '8.8.8.8' WHEN k % 31 = 4 THEN '::1' WHEN k % 31 = 5 THEN '169.254.0.9' WHEN k % 31 = 6 THEN '192.168.7.7' WHEN k % 31 = 7 THEN '198.51.100.1'
  ELSE '10.0.0.' || CAST(k % 31 AS VARCHAR) END AS source_ip, t AS first_seen, t + CAST(floor(value) AS BIGINT) * 60000000 AS last_seen, k AS activity_count,
  t AS window_start, t + CAST(floor(value) AS BIGINT) * 60000000 AS window_end FROM snap)"""
IPS = ["203.0.113.50", "127.0.0.1", "172.20.1.1", "8.8.8.8", "::1", "169.254.0.9", "192.168.7.7", "198.51.100.1"]


def records(t):
    m = F.col("k") % 31
    ip = F.coalesce(F.get(F.array(*map(F.lit, IPS)), m), F.concat(F.lit("10.0.0."), m.cast("string")))
    last = F.col("t") + F.floor("value").cast("bigint") * 60000000
    return t.snapshot.select((8080 + F.col("user_id") % 3).alias("monitored_port"), ip.alias("source_ip"), F.col("t").alias("first_seen"), last.alias("last_seen"),
                             F.col("k").alias("activity_count"), F.col("t").alias("window_start"), last.alias("window_end"))


def in_window(t):
    return P.records_in_window(records(t), 8081, START, END)


SEL = f"sel AS (SELECT * FROM rec WHERE monitored_port = 8081 AND window_end >= {START} AND window_start <= {END})"
BREAK = """brk AS (SELECT source_ip, min(first_seen) AS first_seen, max(last_seen) AS last_seen, CAST(sum(activity_count) AS BIGINT) AS activity_count,
  greatest(0.0, (max(last_seen) - min(first_seen)) / 1000000.0) AS observed_duration_seconds FROM sel GROUP BY source_ip)"""


@query("port_records", oracle("SELECT source_ip, first_seen, last_seen, activity_count FROM sel", REC, SEL))
def _(t):
    return in_window(t).select("source_ip", "first_seen", "last_seen", "activity_count")


@query("port_ip_breakdown", oracle("SELECT * FROM brk", REC, SEL, BREAK))
def _(t):
    return P.ranked_breakdown(in_window(t))


SUSPICIOUS = "sus AS (SELECT DISTINCT '10.0.0.' || CAST(k % 31 AS VARCHAR) AS source_ip FROM snap WHERE k IN (40, 45, 50) OR (severity = 'critical' AND k = 46))"


def evidence(t):
    ip = F.concat(F.lit("10.0.0."), (F.col("k") % 31).cast("string"))
    s = t.snapshot.withColumn("source_ip", ip)
    return P.suspicious_ips(s.where("k in (40, 45, 50)"), s.withColumn("is_suspicious", F.expr("severity = 'critical' and k = 46")))


@query("suspicious_ips", oracle("SELECT * FROM sus", SUSPICIOUS))
def _(t):
    return evidence(t)


@query("port_ip_class", oracle("""SELECT source_ip, activity_count, CASE WHEN source_ip = '203.0.113.50' THEN 'BLACKLISTED' WHEN source_ip IN (SELECT source_ip FROM sus) THEN 'SUSPICIOUS'
  WHEN source_ip IN ('127.0.0.1', '::1') THEN 'INTERNAL / LOOPBACK' WHEN source_ip = '8.8.8.8' THEN 'UNKNOWN / OBSERVED' ELSE 'INTERNAL' END AS classification,
  CASE WHEN source_ip = '203.0.113.50' THEN 'Matched in DetectionService threat blacklist rules'
  WHEN source_ip IN (SELECT source_ip FROM sus) THEN 'Searchable source IP matched existing alert/correlation record'
  WHEN source_ip IN ('127.0.0.1', '::1') THEN 'Loopback Address (127.0.0.0/8)' WHEN source_ip = '8.8.8.8' THEN 'Observed port activity; no matching blacklist or alert evidence'
  ELSE 'RFC 1918 Private IP Range (' || CASE WHEN starts_with(source_ip, '10.') THEN '10.0.0.0/8' WHEN starts_with(source_ip, '172.') THEN '172.16.0.0/12'
  WHEN starts_with(source_ip, '192.168.') THEN '192.168.0.0/16' ELSE 'Private IP Range' END || ')' END AS evidence FROM brk""", REC, SEL, BREAK, SUSPICIOUS))
def _(t):
    return P.classify_ips(P.ip_breakdown(in_window(t)), evidence(t)).select("source_ip", "activity_count", "classification", "evidence")


STEP = 30 * 60_000_000
TIMELINE = f"""grid AS (SELECT CAST(range AS BIGINT) AS bucket FROM range({START}, {END}, {STEP}))"""


@query("port_timeline", oracle(f"""SELECT bucket, CAST(coalesce(sum(activity_count), 0) AS BIGINT) AS connection_count, count(DISTINCT source_ip) AS active_ips,
  coalesce(greatest(0.0, (max(last_seen) - min(first_seen)) / 1000000.0), 0.0) AS observed_duration_seconds FROM grid LEFT JOIN sel
  ON first_seen < bucket + {STEP} AND last_seen >= bucket GROUP BY bucket""", REC, SEL, TIMELINE))
def _(t):
    return P.timeline(in_window(t), START, END, STEP)


@query("port_timeline_ips", oracle(f"""SELECT bucket, source_ip, CAST(sum(activity_count) AS BIGINT) AS activity_count FROM grid JOIN sel
  ON first_seen < bucket + {STEP} AND last_seen >= bucket GROUP BY ALL""", REC, SEL, TIMELINE))
def _(t):
    return P.timeline_ips(in_window(t), START, END, STEP).select("bucket", "source_ip", "activity_count")


@query("port_report", oracle(f"""SELECT 8081 AS port, 'Besto Health' AS service_name, 259200.0 AS duration_seconds, CAST(sum(activity_count) AS BIGINT) AS total_activity_count,
  count(*) AS unique_source_ips, max(observed_duration_seconds) AS total_observed_duration_seconds FROM brk""", REC, SEL, BREAK))
def _(t):
    return P.report_summary(records(t), 8081, START, END)


NAMES = "CASE port " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in fx.SERVICE_NAMES.items()) + " ELSE 'Port ' || CAST(port AS VARCHAR) || ' Service' END"
ALL_PORTS = "mp AS (SELECT DISTINCT port FROM (SELECT CAST(monitored_port AS INT) + 10 AS port FROM rec UNION ALL SELECT unnest([8080, 8081, 8082, 443, 80, 22, 3306, 5432, 8000])))"


@query("monitored_ports", oracle("SELECT port FROM mp ORDER BY port", REC, ALL_PORTS))
def _(t):
    return P.monitored_ports(records(t).withColumn("monitored_port", F.col("monitored_port") + 10))


AS_OF = 1705000000000000
SOCK = "sock AS (SELECT ([8080, 8081, 443, 22, 9999])[user_id % 5 + 1] AS local_port, CASE WHEN user_id % 5 = 1 THEN 'LISTEN' WHEN k % 3 = 0 THEN 'LISTEN' WHEN k % 3 = 1 THEN 'ESTABLISHED' ELSE 'TIME_WAIT' END AS status FROM snap)"
PSTATUS = f"""ps AS (SELECT port, {NAMES} AS service_name, CASE WHEN coalesce(active, 0) > 0 THEN 'OPEN_AND_ACTIVE' WHEN listening THEN 'OPEN_IDLE' ELSE 'CLOSED' END AS current_status,
  coalesce(active, 0) AS current_active_connections, coalesce(a, 0) AS total_activity_count, coalesce(u, 0) AS unique_source_ips, f AS first_activity, l AS last_activity
  FROM (SELECT DISTINCT port FROM (SELECT CAST(monitored_port AS INT) AS port FROM rec UNION ALL SELECT unnest([8080, 8081, 8082, 443, 80, 22, 3306, 5432, 8000])))
  LEFT JOIN (SELECT local_port AS port, bool_or(status = 'LISTEN') AS listening, count(*) FILTER (status = 'ESTABLISHED') AS active FROM sock GROUP BY 1) USING (port)
  LEFT JOIN (SELECT CAST(monitored_port AS INT) AS port, CAST(sum(activity_count) AS BIGINT) AS a, count(DISTINCT source_ip) AS u, min(first_seen) AS f, max(last_seen) AS l
    FROM rec WHERE window_end >= {AS_OF - 6 * HOUR} AND window_start <= {AS_OF} GROUP BY 1) USING (port))"""


def status(t):
    k, u = F.col("k"), F.col("user_id")
    sockets = t.snapshot.select(
        F.get(F.array(*map(F.lit, [8080, 8081, 443, 22, 9999])), (u % 5).cast("int")).alias("local_port"),
        F.when(u % 5 == 1, "LISTEN").when(k % 3 == 0, "LISTEN").when(k % 3 == 1, "ESTABLISHED").otherwise("TIME_WAIT").alias("status"))
    return P.port_status(sockets, records(t), AS_OF)


@query("port_status", oracle("SELECT * FROM ps", REC, SOCK, PSTATUS))
def _(t):
    return status(t).drop("observed_duration_seconds")


@query("port_search", oracle("SELECT port, current_status FROM ps WHERE (contains(lower(service_name), 'besto') OR contains(CAST(port AS VARCHAR), 'Besto')) "
       "AND current_status <> 'CLOSED' UNION ALL SELECT port, current_status FROM ps WHERE (contains(lower(service_name), '80') OR contains(CAST(port AS VARCHAR), '80')) "
       "AND current_status = 'CLOSED'", REC, SOCK, PSTATUS))
def _(t):
    s = status(t).select("port", "service_name", "current_status")
    return P.search_ports(s, "Besto", "ONLINE").unionByName(P.search_ports(s, "80", "OFFLINE")).drop("service_name")


# --------------------------------------------------------------------------- logs and health
def logs(t):
    return detect(t.events).withColumn("is_suspicious", F.when(F.col("k") % 6 != 0, F.col("detection.is_suspicious")))


SUSP = "CASE WHEN k % 6 <> 0 THEN found IS NOT NULL END"


@query("log_list", oracle("SELECT event_id, source, severity FROM snap ORDER BY event_id DESC OFFSET 40 LIMIT 100"))
def _(t):
    return L.list_logs(t.snapshot, 40, 100).select("event_id", "source", "severity")


@query("log_get", oracle("SELECT event_id, event_type, message FROM snap WHERE event_id = 77"))
def _(t):
    return L.get_log(t.snapshot, 77).select("event_id", "event_type", "message")


@query("log_search", oracle(f"""SELECT event_id FROM verdict WHERE (contains(lower(message), 'user1') OR contains(lower(source), 'user1') OR contains(event_type, 'user1')
  OR contains(host, 'user1') OR contains(source_ip, 'user1') OR contains(usr, 'user1')) AND severity = 'low' AND coalesce({SUSP}, false) = false""", VERDICT))
def _(t):
    return L.search_logs(logs(t), "User1", "low", False).select("event_id")


@query("log_sort_page", oracle("SELECT event_id, host FROM snap ORDER BY host DESC NULLS FIRST, event_id OFFSET 100 LIMIT 50"))
def _(t):
    return L.sort_page(t.snapshot, "host", False, 2, 50).select("event_id", "host")


@query("log_sort_page_asc", oracle("SELECT event_id, usr AS user_name FROM snap ORDER BY usr ASC NULLS LAST, event_id OFFSET 0 LIMIT 50"))
def _(t):
    return L.sort_page(t.snapshot, "user", True, 0, 50).select("event_id", F.col("user").alias("user_name"))


@query("log_suspicious_count", oracle(f"SELECT count(*) FILTER ({SUSP}) AS suspicious_logs FROM verdict", VERDICT))
def _(t):
    return L.suspicious_count(logs(t))


@query("host_health", oracle("""SELECT event_id, CASE WHEN k > 85 OR user_id % 100 > 90 OR value > 90 OR (k % 4) * 12 > 30 THEN 'Critical'
  WHEN k > 65 OR user_id % 100 > 75 OR value > 75 OR k % 4 > 0 THEN 'Warning' ELSE 'Healthy' END AS health FROM snap"""))
def _(t):
    health = L.host_health(F.col("k"), F.col("user_id") % 100, F.col("value"), (F.col("k") % 4) * 12)
    return t.snapshot.select("event_id", health.alias("health"))


SERVICES = """svc AS (SELECT 'host' || CAST(user_id AS VARCHAR) AS host, 'svc' || CAST(event_id AS VARCHAR) AS service_name, event_id AS ord,
  CASE WHEN k % 4 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS status, CASE WHEN user_id % 3 = 0 THEN 0 ELSE k % 7 END AS cpu_percent, k % 5 AS memory_mb FROM snap)"""


def services(t):
    k, u = F.col("k"), F.col("user_id")
    return t.snapshot.select(F.concat(F.lit("host"), u.cast("string")).alias("host"), F.concat(F.lit("svc"), F.col("event_id").cast("string")).alias("service_name"),
                             F.col("event_id").alias("ord"), F.when(k % 4 == 0, "OFFLINE").otherwise("ONLINE").alias("status"),
                             F.when(u % 3 == 0, 0).otherwise(k % 7).alias("cpu_percent"), (k % 5).alias("memory_mb"))


@query("top_service", oracle("""SELECT host, CASE WHEN max(cpu_percent) > 0 THEN arg_max(service_name, cpu_percent * 10000000 - ord) END AS top_cpu_service,
  arg_max(service_name, memory_mb * 10000000 - ord) AS top_memory_service FROM svc WHERE status = 'ONLINE' GROUP BY host""", SERVICES))
def _(t):
    return L.top_services(services(t))


@query("service_counts", oracle("SELECT host, CASE status WHEN 'ONLINE' THEN 'Online' ELSE 'Offline' END AS slice, count(*) AS value FROM svc GROUP BY ALL", SERVICES))
def _(t):
    return L.service_counts(services(t))
