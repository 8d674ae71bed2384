"""Sources, validation, routing, normalization, duplicates, quarantine, unknown logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.exprs import event_time, is_ip, micros, strip
from vigil.operators import ingest as I
from vigil.operators.classify import classify_log_type
from vigil.plans.adapters import oracle
from vigil.plans.registry import query
from vigil.streaming.storage import new_folder
from vigil.sources import collectors as C
from vigil.sources import readers as R


def raw(t):
    return I.with_fields(t.snapshot.select("event_id", "t", "k", "user_id", "iso", "raw"))


def validated(t):
    return I.validate(raw(t))


# what the k % 10 variants of the raw text must give
VERDICT = """verdict AS (SELECT *, k % 10 AS m,
  CASE WHEN k % 10 IN (0, 1, 6, 7) THEN 'INVALID' WHEN k % 10 IN (3, 4, 5, 9) THEN 'WARNING' ELSE 'VALID' END AS status,
  CASE k % 10 WHEN 0 THEN 'Missing required event_type; Missing critical fields required for SOC processing (event_type)'
    WHEN 1 THEN 'Invalid timestamp format: not-a-time' WHEN 6 THEN 'Malformed JSON payload' WHEN 7 THEN 'Empty payload'
    ELSE '' END AS errors,
  CASE k % 10 WHEN 3 THEN 'Non-standard severity value' WHEN 4 THEN 'Invalid source_ip format'
    WHEN 5 THEN 'Missing source; Missing message' WHEN 9 THEN 'Missing source' ELSE '' END AS warnings,
  CASE WHEN k % 10 IN (6, 7) THEN 'payload_check' ELSE 'field_check' END AS stage FROM snap)"""

NORMAL = """normal AS (SELECT event_id, k,
  CASE m WHEN 5 THEN 'unknown' WHEN 9 THEN 'unknown' ELSE 'app' END AS source,
  CASE m WHEN 2 THEN 'h1' END AS host,
  CASE m WHEN 2 THEN 'port.scan' WHEN 3 THEN 'api.abuse' WHEN 4 THEN 'x' WHEN 5 THEN 'auth.failure'
    WHEN 8 THEN 'windows_event_' || CAST(4600 + k AS VARCHAR) ELSE 'login' END AS event_type,
  CASE m WHEN 2 THEN 'alias ' || CAST(k AS VARCHAR)
    WHEN 5 THEN 'Unparsed log event: {"code":"' || CAST(user_id AS VARCHAR) || '"}' ELSE 'm' END AS message,
  CASE m WHEN 2 THEN 'critical' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'high' ELSE 'low' END AS severity,
  CASE m WHEN 8 THEN CAST(floor(t / 1000000) AS BIGINT) * 1000000 ELSE t END AS t,
  CASE m WHEN 2 THEN 'fe80::1' WHEN 4 THEN '999.1.1.1' WHEN 8 THEN '10.1.1.1' WHEN 9 THEN '10.0.0.1' END AS source_ip,
  CASE m WHEN 2 THEN 'u1' WHEN 8 THEN 'svc' END AS user_name,
  CASE m WHEN 8 THEN k WHEN 9 THEN user_id END AS record_number
  FROM verdict WHERE status <> 'INVALID')"""


def normalized(t):
    valid, _ = I.route(validated(t))
    return I.normalize(valid, F.timestamp_micros("t"), keep=["event_id", "k"])


@query("src_raw_json", oracle("""SELECT event_id,
  CASE WHEN k % 10 IN (6, 7) THEN NULL ELSE CASE k % 10 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 4 WHEN 4 THEN 5
    WHEN 5 THEN 2 WHEN 8 THEN 6 ELSE 7 END END AS n_fields,
  CASE k % 10 WHEN 5 THEN CAST(user_id AS VARCHAR) END AS code FROM snap"""))
def _(t):
    fields = F.col("fields")
    return raw(t).select("event_id", F.size(F.map_keys(fields)).alias("n_fields"), fields["code"].alias("code")).withColumn(
        "n_fields", F.when(F.col("n_fields") >= 0, F.col("n_fields")))


@query("src_text_lines", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'error' ELSE 'access' END AS kind, "
       "length(text) AS n_chars FROM conversations WHERE length(trim(text)) > 0")
def _(t):
    names = F.when(F.col("role") == "user", "site.ERROR.log").otherwise("access-1.log")
    lines = t.table("conversations").select("conv_id", "turn", F.col("text").alias("line"), names.alias("file_name"))
    return R.with_line_kind(lines).select("conv_id", "turn", "kind", F.length("line").alias("n_chars"))


@query("src_browser_visits", """SELECT 100000000 + o_orderkey AS record_number,
  CASE WHEN c_custkey % 3 = 0 THEN 'browser.search' ELSE 'browser.url_visit' END AS event_type,
  CASE WHEN c_custkey % 3 = 0 THEN 'Search query: ''' || c_mktsegment || ''' on URL: http://shop/' || c_name
    ELSE 'Visited URL: http://shop/' || c_name END AS message,
  epoch_us(o_orderdate) AS t,
  CASE WHEN o_custkey % 16 < 11 THEN (['Link','Typed','Auto_Bookmark','Auto_Subframe','Manual_Subframe','Generated',
    'Auto_Toplevel','Form_Submit','Reload','Keyword','Keyword_Generated'])[o_custkey % 16 + 1]
    ELSE 'Other (' || CAST(o_custkey % 16 AS VARCHAR) || ')' END AS transition_name
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey > 100""")
def _(t):
    orders, customer = t.table("orders"), t.table("customer")
    visits = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("url"),
        (micros(F.col("o_orderdate")) + 11644473600000000).alias("visit_time"),
        (F.col("o_custkey") % 16 + 0x30000000).alias("transition"),
    )
    urls = customer.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("http://shop/"), "c_name").alias("url"),
        F.col("c_name").alias("title"), F.lit(1).alias("visit_count"), F.lit(0).alias("typed_count"),
    )
    terms = customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("url_id"), F.col("c_mktsegment").alias("term"))
    out = C.browser_visits(visits, urls, terms, 100, 1, F.timestamp_micros(F.lit(0)))
    return out.select("record_number", "event_type", "message", micros(F.col("ts")).alias("t"), "transition_name")


@query("src_browser_downloads", """SELECT 200000000 + p_partkey AS record_number,
  CASE p_partkey % 3 WHEN 0 THEN p_name || '.exe' WHEN 1 THEN 'part' || CAST(p_partkey AS VARCHAR) ELSE 'unknown_file' END AS file_name,
  'Downloaded file: ' || CASE p_partkey % 3 WHEN 0 THEN p_name || '.exe' WHEN 1 THEN 'part' || CAST(p_partkey AS VARCHAR)
    ELSE 'unknown_file' END || ' from http://b/' || p_brand || ' to ' ||
  CASE p_partkey % 3 WHEN 0 THEN '/home/d/' || p_name || '.exe' WHEN 1 THEN '/tmp/part' || CAST(p_partkey AS VARCHAR)
    ELSE 'unknown_file' END AS message FROM part WHERE p_partkey > 10""")
def _(t):
    part = t.table("part")
    downloads = part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/home/d/"), "p_name", F.lit(".exe"))).otherwise("").alias("target_path"),
        F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/tmp/part"), F.col("p_partkey").cast("string"))).alias("current_path"),
        F.lit(0).cast("bigint").alias("start_time"), F.lit(1).alias("received_bytes"), F.lit(1).alias("total_bytes"),
        F.concat(F.lit("http://b/"), "p_brand").alias("tab_url"),
    )
    return C.browser_downloads(downloads, 10, 2, F.timestamp_micros(F.lit(0))).select("record_number", "file_name", "message")


@query("src_incremental", """SELECT 'browser' AS source_kind, max(o_orderkey) AS max_id,
  CASE WHEN max(o_orderkey) < 1000000000 THEN max(o_orderkey) ELSE 1000000000 END AS continue_from FROM orders
  UNION ALL SELECT 'event_log', max(o_orderkey), CASE WHEN max(o_orderkey) < 1000000000 THEN 0 ELSE 1000000000 END FROM orders
  UNION ALL SELECT 'running', max(o_orderkey), CASE WHEN max(o_orderkey) < 5 THEN max(o_orderkey) ELSE 5 END FROM orders""")
def _(t):
    orders = t.table("orders")
    named = lambda df, n: df.select(F.lit(n).alias("source_kind"), "*")
    return (
        named(R.watermark(orders, "o_orderkey", 1_000_000_000), "browser")
        .unionByName(named(R.watermark(orders, "o_orderkey", 1_000_000_000, on_reset="zero"), "event_log"))
        .unionByName(named(R.watermark(orders, "o_orderkey", 5), "running"))
    )


@query("src_windows_events", oracle("""SELECT raw_type AS channel, event_id AS record_number,
  CASE WHEN k % 17 IN (1, 16) THEN 'high' WHEN k % 17 = 2 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN k % 3 = 0 THEN message WHEN k % 3 = 1 THEN 'a' || CAST(k AS VARCHAR) || ' | b'
    ELSE 'Windows Event ID ' || CAST(4600 + k AS VARCHAR) || ' generated by ' || source END AS message
  FROM snap WHERE raw_type IN ('view', 'click', 'error') AND
    event_id > CASE raw_type WHEN 'view' THEN 50 WHEN 'click' THEN 0 ELSE 200 END"""))
def _(t):
    s = t.snapshot.select(
        F.col("raw_type").alias("channel"), F.col("event_id").alias("record_number"), (F.col("k") + 4600).alias("event_id"),
        F.col("source").alias("provider"), (F.col("k") % 17).alias("event_kind"),
        F.when(F.col("k") % 3 == 0, F.col("message")).alias("text"),
        F.when(F.col("k") % 3 == 1, F.array(F.concat(F.lit("a"), F.col("k").cast("string")), F.lit(None), F.lit("b"))).alias("inserts"),
    )
    # the click channel was cleared: its newest number is below the last one seen
    seen = t.table("events").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("_n")).where(
        "channel in ('view', 'click', 'error')").select(
        "channel", F.when(F.col("channel") == "view", 50).when(F.col("channel") == "click", 1 << 50).otherwise(200).alias("last_record"))
    return C.windows_events(s, seen).select("channel", "record_number", "severity", "message")


@query("src_container_lifecycle", oracle("""SELECT event_id,
  CASE k % 9 WHEN 0 THEN 'docker.container_started' WHEN 1 THEN 'docker.container_stopped' WHEN 2 THEN 'docker.container_stopped'
    WHEN 3 THEN 'docker.container_restarted' WHEN 4 THEN 'docker.container_stopped' ELSE 'docker.security_event' END AS event_type,
  CASE WHEN k % 9 = 4 THEN 'high' WHEN k % 9 IN (5, 6) THEN 'warning' WHEN k % 9 IN (1, 2) AND k % 2 = 1 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN k % 9 = 4 THEN 'Container c' || CAST(user_id AS VARCHAR) || ' (abcdefabcdef) was terminated due to Out Of Memory (OOM) error'
    WHEN k % 9 IN (5, 6) THEN 'Security Event: Command execution attempted inside container c' || CAST(user_id AS VARCHAR) || ' (abcdefabcdef): sh'
    WHEN k % 9 IN (1, 2) AND k % 2 = 1 THEN 'Container c' || CAST(user_id AS VARCHAR) || ' (abcdefabcdef) stopped with non-zero exit code: 1'
    ELSE 'Container c' || CAST(user_id AS VARCHAR) || ' (abcdefabcdef) action: ' || (['start','stop','die','restart'])[k % 9 + 1] END AS message
  FROM snap WHERE k % 9 < 7"""))
def _(t):
    actions = ["start", "stop", "die", "restart", "oom", "exec_create", "exec_start", "pause", "attach"]
    events = t.snapshot.select(
        "event_id", F.get(F.array(*map(F.lit, actions)), F.col("k") % 9).alias("action"),
        F.lit("abcdefabcdef0123").alias("container_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("name"),
        (F.col("k") % 2).cast("string").alias("exit_code"), F.lit("sh").alias("exec_cmd"),
    )
    return C.container_lifecycle(events).select("event_id", "event_type", "severity", "message")


@query("src_container_lines", """SELECT doc_id, length(rtrim(substr(text, strpos(text, ' ') + 1), chr(13) || chr(10))) AS n_message,
  CASE WHEN contains(lower(text), 'error') OR contains(lower(text), 'failed') OR contains(lower(text), 'exception') THEN 'high'
    WHEN contains(lower(text), 'warn') THEN 'warning' ELSE 'info' END AS severity
  FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0""")
def _(t):
    lines = t.table("documents").select("doc_id", F.concat(F.lit("2024-01-01T00:00:00Z "), "text").alias("line"))
    real = lines.where(F.length(strip(F.expr("substring(line, 22)"))) > 0)
    out = C.container_log_lines(real)
    return out.select("doc_id", F.length(F.when(F.instr("message", " ") > 0, F.expr("substring(message, instr(message, ' ') + 1)"))
                                         .otherwise(F.col("message"))).alias("n_message"), "severity")


@query("src_enabled_rules", """SELECT p_partkey AS id, p_name AS rule_name, p_brand AS source_type FROM part
  WHERE p_partkey % 3 <> 0 ORDER BY id""")
def _(t):
    from vigil.operators.rules import enabled_rules
    rules = t.table("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("rule_name"), F.col("p_brand").alias("source_type"),
        (F.col("p_partkey") % 3 != 0).alias("is_enabled"))
    return enabled_rules(rules).drop("is_enabled")


@query("src_rule_by_code", """SELECT p_partkey AS id, p_name AS rule_name, p_brand AS rule_code, p_partkey % 3 <> 0 AS is_enabled FROM part
  WHERE p_partkey = (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#23')""")
def _(t):
    from vigil.operators.rules import rule_by_code
    rules = t.table("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("rule_name"), F.col("p_brand").alias("rule_code"),
        (F.col("p_partkey") % 3 != 0).alias("is_enabled"))
    return rule_by_code(rules, "Brand#23")


@query("sink_append", oracle("SELECT event_id, t, message, strftime(make_timestamp(CAST(t AS BIGINT)), '%Y-%m-%d') AS day FROM snap"))
def _(t):
    from vigil.sources.readers import write_events
    from vigil.streaming.storage import new_folder
    path, rows = new_folder(t.spark, "events"), t.snapshot.select("event_id", "t", "message", "k")
    for half in (0, 1):  # two appends to the same table
        write_events(rows.where(F.col("k") % 2 == half).drop("k"), path, "t")
    return t.spark.read.schema("event_id bigint, t bigint, message string, day string").parquet(path)


@query("src_logs_history", oracle("""SELECT event_id, CASE WHEN k % 5 = 0 THEN 'unknown' ELSE source END AS source,
  CASE WHEN k % 7 = 0 THEN 'info' ELSE severity END AS severity, CASE WHEN k % 3 = 0 THEN '' ELSE message END AS message,
  CASE WHEN k % 2 = 0 THEN k END AS record_number, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS n_meta FROM snap"""))
def _(t):
    k = F.col("k")
    stored = t.snapshot.select(
        "event_id", F.when(k % 5 == 0, "").otherwise(F.col("source")).alias("source"), "event_type",
        F.when(k % 7 != 0, F.col("severity")).alias("severity"), F.when(k % 3 != 0, F.col("message")).alias("message"),
        F.when(k % 2 == 0, k.cast("string")).otherwise("n/a").alias("record_number"),
        F.when(k % 4 == 0, "[broken").otherwise('{"a": 1}').alias("metadata"),
    )
    return R.read_logs(stored).select("event_id", "source", "severity", "message", "record_number", F.size("metadata").alias("n_meta"))


@query("norm_alias_coalesce", oracle("""SELECT event_id,
  CASE WHEN m IN (6, 7, 5, 9) THEN NULL ELSE 'app' END AS source,
  CASE m WHEN 2 THEN 'u1' END AS user_name, CASE m WHEN 2 THEN 'h1' END AS host FROM verdict""", VERDICT))
def _(t):
    return raw(t).select("event_id", I.pick("source").alias("source"), I.pick("user").alias("user_name"), I.pick("host").alias("host"))


@query("validate_logs", oracle("SELECT event_id, status, errors, warnings, stage FROM verdict", VERDICT))
def _(t):
    return validated(t).select(
        "event_id", "status", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "stage")


@query("validate_ip", oracle("""SELECT event_id, CASE k % 6 WHEN 0 THEN user_id < 256 WHEN 1 THEN true WHEN 2 THEN false
  WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS ok FROM snap"""))
def _(t):
    u = F.col("user_id").cast("string")
    texts = [F.concat(F.lit("10.0.0."), u), F.concat(F.lit("2001:db8::"), u), F.concat(F.lit("1.2.3.0"), u), F.lit("::ffff:1.2.3.4"),
             F.concat(F.lit("1::2::"), u), F.lit(None).cast("string")]
    text = F.coalesce(*[F.when(F.col("k") % 6 == i, x) for i, x in enumerate(texts)])
    return t.snapshot.select("event_id", is_ip(text).alias("ok"))


@query("route_counts", oracle("""SELECT CASE WHEN status = 'INVALID' THEN 'quarantine' ELSE 'pass' END AS target,
  status, count(*) AS n FROM verdict GROUP BY ALL""", VERDICT))
def _(t):
    passed, held = I.route(validated(t))
    both = passed.select(F.lit("pass").alias("target"), "status").unionByName(held.select(F.lit("quarantine").alias("target"), "status"))
    return both.groupBy("target", "status").agg(F.count("*").alias("n"))


@query("norm_timestamp", oracle("""SELECT event_id, CASE k % 5 WHEN 0 THEN t WHEN 1 THEN CAST(floor(t / 1000000) AS BIGINT) * 1000000
  WHEN 2 THEN t - 7200000000 WHEN 3 THEN NULL ELSE CAST(floor(t / 86400000000) AS BIGINT) * 86400000000 END AS t FROM snap"""))
def _(t):
    k = F.col("k") % 5
    text = (F.when(k == 0, F.concat("iso", F.lit("Z"))).when(k == 1, F.floor(F.col("t") / 1000000).cast("string"))
            .when(k == 2, F.concat("iso", F.lit("+02:00"))).when(k == 3, "yesterday").otherwise(F.substring("iso", 1, 10)))
    return t.snapshot.select("event_id", micros(event_time(text)).alias("t"))


@query("norm_severity", oracle("""SELECT event_id, CASE WHEN k % 2 = 0 THEN severity WHEN event_type = 'malware.detected' THEN 'high'
  WHEN k % 9 = 1 THEN 'medium' ELSE 'low' END AS severity FROM snap"""))
def _(t):
    given = F.when(F.col("k") % 2 == 0, F.upper("severity")).otherwise("notice")
    kind = F.when(F.col("event_type") == "malware.detected", F.col("event_type")).when(F.col("k") % 9 == 1, " Port.Scan ").otherwise("x")
    return t.snapshot.select("event_id", I.resolve_severity(given, kind).alias("severity"))


@query("norm_message", oracle("SELECT event_id, message FROM normal", VERDICT, NORMAL))
def _(t):
    return normalized(t).select("event_id", "message")


@query("norm_metadata", oracle("""SELECT event_id, CASE m WHEN 5 THEN 'code=' || CAST(user_id AS VARCHAR)
  WHEN 8 THEN 'event_id=' || CAST(4600 + k AS VARCHAR) || ',record_number=' || CAST(k AS VARCHAR)
  WHEN 9 THEN 'record_number=' || CAST(user_id AS VARCHAR) ELSE '' END AS metadata FROM verdict WHERE status <> 'INVALID'""", VERDICT))
def _(t):
    flat = F.map_filter("metadata", lambda k, v: k != "event_data")
    text = F.array_join(F.array_sort(F.transform(F.map_entries(flat), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return normalized(t).select("event_id", text.alias("metadata"))


@query("norm_windows", oracle("SELECT event_id, event_type, source_ip, user_name FROM normal WHERE k % 10 = 8", VERDICT, NORMAL))
def _(t):
    return normalized(t).where("event_type like 'windows%'").select(
        "event_id", "event_type", "source_ip", F.col("user").alias("user_name"))


@query("normalize_logs", oracle("""SELECT event_id, source, host, event_type, message, severity, t, source_ip, user_name,
  record_number FROM normal""", VERDICT, NORMAL))
def _(t):
    return normalized(t).select(
        "event_id", "source", "host", "event_type", "message", "severity", micros(F.col("ts")).alias("t"), "source_ip",
        F.col("user").alias("user_name"), "record_number")


@query("dedup_record_number", oracle("""SELECT min(event_id) AS event_id, source, host, event_type, rn AS record_number FROM
  (SELECT *, CASE WHEN k % 3 <> 0 THEN k END AS rn FROM snap) WHERE rn IS NOT NULL GROUP BY source, host, event_type, rn
  UNION ALL SELECT event_id, source, host, event_type, NULL FROM snap WHERE k % 3 = 0"""))
def _(t):
    s = t.snapshot.select("event_id", "source", "host", "event_type",
                          F.when(F.col("k") % 3 != 0, F.col("k").cast("bigint")).alias("record_number"))
    return I.drop_duplicate_events(s, ["event_id"])


@query("dedup_container", oracle("""SELECT DISTINCT raw_type || '_c' || CAST(user_id % 3 AS VARCHAR) || '_' ||
  CAST(CASE WHEN k % 2 = 0 THEN k + 1 ELSE 7 END AS VARCHAR) AS event_key, raw_type AS action FROM snap"""))
def _(t):
    events = t.snapshot.select(
        F.col("raw_type").alias("action"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("container_id"),
        F.when(F.col("k") % 2 == 0, F.col("k") + 1).otherwise(0).alias("time_nano"), F.lit(7).alias("time"))
    return I.drop_duplicate_container_events(events).select("event_key", "action")


@query("quarantine_hash", oracle("""SELECT event_id, sha256(CASE m WHEN 0 THEN 'appno type ' || CAST(user_id % 7 AS VARCHAR)
  WHEN 1 THEN 'appauth.failuremnot-a-time' ELSE '' END) AS quarantine_hash FROM verdict WHERE status = 'INVALID'""", VERDICT))
def _(t):
    return validated(t).where("status = 'INVALID'").select("event_id", I.quarantine_hash().alias("quarantine_hash"))


QUARANTINED = oracle("""SELECT sha256(CASE m WHEN 0 THEN 'appno type ' || CAST(user_id % 7 AS VARCHAR)
  WHEN 1 THEN 'appauth.failuremnot-a-time' ELSE '' END) AS quarantine_hash, count(*) AS quarantined_count,
  arg_min(stage, event_id) AS stage, arg_min(CASE m WHEN 0 THEN 'Missing required event_type' ELSE errors END, event_id) AS rejection_reason,
  arg_min(CASE WHEN m IN (0, 1) THEN 'app' ELSE '' END, event_id) AS collector_name
  FROM verdict WHERE status = 'INVALID' GROUP BY 1""", VERDICT)


@query("quarantine_dedup", QUARANTINED)
def _(t):
    _, held = I.route(validated(t))
    return I.quarantine(held, ["event_id"]).select(
        "quarantine_hash", "quarantined_count", "stage", "rejection_reason", F.coalesce("collector_name", F.lit("")).alias("collector_name"))


def added_in_runs(t, stored, rows):
    """Thirds of the events as runs of their own, the second one twice: a run that was added before changes nothing."""
    for run in (0, 1, 1, 2):
        stored.add(rows(F.col("event_id") % 3 == run), f"run {run}")
    return stored.rows()


@query("quarantine_runs", QUARANTINED)
def _(t):
    _, held = I.route(validated(t))
    rows = lambda some: I.quarantine(held.where(some), ["event_id"], ranked=True)
    stored = I.StoredCounts(t.spark, new_folder(t.spark, "quarantine"), rows(F.lit(False)), "quarantine_hash", "quarantined_count", 8)
    return added_in_runs(t, stored, rows).select(
        "quarantine_hash", "quarantined_count", "stage", "rejection_reason", F.coalesce("collector_name", F.lit("")).alias("collector_name"))


def odd_sources(t):
    names = ["chrome-x", "Docker", "my windows", "syslog1", "FIREWALL", "", "web app-1", "db_collector"]
    return t.snapshot.withColumn("source", F.get(F.array(*map(F.lit, names)), F.col("k") % 8))


@query("unknown_collector", oracle("""SELECT event_id, (['chrome_browser_collector','docker_collector','windows_event_collector',
  'syslog_collector','firewall_collector','unknown_collector','web_app_1_collector','db_collector'])[k % 8 + 1] AS collector_name,
  sha256((['chrome-x','Docker','my windows','syslog1','FIREWALL','','web app-1','db_collector'])[k % 8 + 1] || message || event_type)
  AS unknown_hash FROM snap"""))
def _(t):
    return odd_sources(t).select("event_id", I.unknown_collector(F.col("source")).alias("collector_name"),
                                 I.unknown_hash().alias("unknown_hash"))


@query("unknown_dedup", oracle("""SELECT sha256('dev' || 'thing ' || CAST(k AS VARCHAR) || 'odd') AS unknown_hash,
  count(*) AS occurrence_count, min(t) AS first_seen, 'dev_collector' AS collector_name, 30 AS parser_confidence,
  20 AS detection_confidence FROM snap WHERE raw_type = 'click' GROUP BY k"""))
def _(t):
    s = t.snapshot.where("raw_type = 'click'").select(
        "event_id", F.col("t").alias("ts"), F.lit("dev").alias("source"), F.lit("odd").alias("event_type"),
        F.concat(F.lit("thing "), F.col("k").cast("string")).alias("message"), F.lit("text").alias("detected_format"),
        F.lit(0.3).alias("parsing_confidence"), F.from_json(F.lit("{}"), "map<string,string>").alias("metadata"))
    out = I.unknown_logs(classify_log_type(s), ["ts", "event_id"])
    return out.select("unknown_hash", "occurrence_count", "first_seen", "collector_name", "parser_confidence", "detection_confidence")


UNKNOWN = oracle("""SELECT sha256('dev' || 'thing ' || CAST(k AS VARCHAR) || 'odd') AS unknown_hash,
  count(*) AS occurrence_count, min(t) AS first_seen, 'dev_collector' AS collector_name, 30 AS parser_confidence,
  20 AS detection_confidence FROM snap GROUP BY k""")


def odd_events(t):
    s = t.snapshot.select(
        "event_id", F.col("t").alias("ts"), F.lit("dev").alias("source"), F.lit("odd").alias("event_type"),
        F.concat(F.lit("thing "), F.col("k").cast("string")).alias("message"), F.lit("text").alias("detected_format"),
        F.lit(0.3).alias("parsing_confidence"), F.from_json(F.lit("{}"), "map<string,string>").alias("metadata"))
    return classify_log_type(s)


UNKNOWN_COLUMNS = ["unknown_hash", "occurrence_count", "first_seen", "collector_name", "parser_confidence", "detection_confidence"]


@query("unknown_dedup_all", UNKNOWN)
def _(t):
    return I.unknown_logs(odd_events(t), ["ts", "event_id"]).select(*UNKNOWN_COLUMNS)


@query("unknown_runs", UNKNOWN)
def _(t):
    rows = lambda some: I.unknown_logs(odd_events(t).where(some), ["ts", "event_id"], ranked=True)
    stored = I.StoredCounts(t.spark, new_folder(t.spark, "unknown"), rows(F.lit(False)), "unknown_hash", "occurrence_count", 8)
    return added_in_runs(t, stored, rows).select(*UNKNOWN_COLUMNS)
