"""Alerts, incidents, notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import DAY, MINUTE, severity_index, severity_name
from vigil.operators import alerts as A
from vigil.operators import incidents as N
from vigil.operators import notify as M
from vigil.operators.detect import detect
from vigil.plans.adapters import HOUR, oracle
from vigil.plans.detect_queries import BURST, CODES, HITS, RISK, VERDICT, detector, matched
from vigil.plans.registry import query
from vigil.streaming.storage import new_folder, written

SEV = "['informational','low','medium','high','critical']"
AS_OF = "(SELECT max(t) FROM snap)"

# candidates: rule hits, the detection verdict, and whether the event completed a login burst
CAND = f"""cand AS (SELECT h.*, {CODES} AS codes, {RISK} AS rule_risk, v.found, v.why, b.event_id IS NOT NULL AS corr,
  (h_docker OR h_auth OR h_sql OR h_path OR h_agent) AS high_rule FROM hits h JOIN verdict v USING (event_id) LEFT JOIN burst b USING (event_id))"""
OCC = f"""occ AS (SELECT *,
  CASE WHEN corr THEN 'Correlation Match: failed_login_burst' WHEN codes <> '' THEN 'Rule Match: ' || string_split(codes, ',')[1]
    WHEN found IS NOT NULL THEN 'Suspicious Activity Detected: ' || why ELSE 'Suspicious Log: ' || event_type END AS title,
  CASE WHEN corr THEN 'correlation' WHEN high_rule THEN 'rule_match' WHEN found IS NOT NULL THEN 'detection' ELSE 'other' END AS alert_type,
  greatest(list_position({SEV}, severity) - 1, list_position({SEV}, coalesce(found, 'low')) - 1, CASE WHEN corr THEN 3 ELSE 0 END,
    CASE WHEN h_docker OR h_sql THEN 4 WHEN h_auth OR h_path OR h_agent THEN 3 WHEN h_recon THEN 2 ELSE 0 END) AS sev,
  greatest(rule_risk, CASE WHEN corr THEN 75 ELSE 0 END, 20 * (list_position({SEV}, coalesce(found, 'low')) - 1)) AS risk,
  least(100, greatest(50, CASE WHEN corr THEN 50 ELSE 0 END + CASE WHEN high_rule THEN 40 ELSE 0 END + CASE WHEN found IS NOT NULL THEN 30 ELSE 0 END))
    AS confidence,
  sha256(source || '|' || event_type || '|' || coalesce(host, 'unknown_host')
    || CASE WHEN codes <> '' THEN '|' || array_to_string(list_sort(string_split(codes, ',')), ',') ELSE '' END
    || CASE WHEN corr THEN '|failed_login_burst' ELSE '' END) AS fp
  FROM cand WHERE corr OR high_rule OR found IS NOT NULL)"""
CHAIN = [HITS, VERDICT, BURST, CAND, OCC]


def candidates(t):
    events = detect(matched(t))
    corr = detector(t, "failed_login_burst").select(
        "event_id", F.array(F.struct("correlation_type", "severity", "risk_score", "event_count")).alias("correlation_matches"))
    return events.join(corr, "event_id", "left")


def occurrences(t):
    return A.alert_occurrences(candidates(t))


@query("alert_gate", oracle("SELECT event_id FROM occ", *CHAIN))
def _(t):
    return A.alert_gate(candidates(t)).select("event_id")


@query("alert_title", oracle("SELECT event_id, title FROM occ", *CHAIN))
def _(t):
    return occurrences(t).select("event_id", F.col("alert_title").alias("title"))


@query("alert_type", oracle("SELECT alert_type, count(*) AS n FROM occ GROUP BY ALL", *CHAIN))
def _(t):
    return occurrences(t).groupBy("alert_type").agg(F.count("*").alias("n"))


@query("alert_severity", oracle(f"SELECT event_id, ({SEV})[sev + 1] AS severity FROM occ", *CHAIN))
def _(t):
    return occurrences(t).select("event_id", F.col("alert_severity").alias("severity"))


@query("alert_risk", oracle("SELECT event_id, risk FROM occ", *CHAIN))
def _(t):
    return occurrences(t).select("event_id", "risk")


@query("alert_confidence", oracle("SELECT event_id, confidence FROM occ", *CHAIN))
def _(t):
    return occurrences(t).select("event_id", "confidence")


@query("alert_fingerprint", oracle("SELECT event_id, fp AS alert_fingerprint FROM occ", *CHAIN))
def _(t):
    return occurrences(t).select("event_id", "alert_fingerprint")


# alerts are closed at every occurrence whose event number ends in 300
EPISODES = """occ2 AS (SELECT *, count(*) FILTER (event_id % 1000 = 300) OVER (PARTITION BY fp ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS episode FROM occ)"""
MERGED = f"""merged AS (SELECT fp, episode, count(*) AS n, min(t) AS first_seen, max(t) AS last_seen, arg_min(event_id, t) AS event_id, arg_min(title, t) AS title,
  arg_min(sev, t) AS sev0, arg_min(risk, t) AS risk0, arg_max(confidence, t) AS confidence, arg_min(host, t) AS host, arg_min(source, t) AS source,
  arg_min(source_ip, t) AS source_ip, arg_min(usr, t) AS usr, arg_min(codes, t) AS codes FROM occ2 GROUP BY fp, episode),
alerts AS (SELECT *, ({SEV})[least(4, sev0 + greatest(least(n, 20) - 5, 0) + 2 * greatest(n - 20, 0)) + 1] AS severity,
  least(100, risk0 + 5 * greatest(least(n, 20) - 5, 0) + 10 * greatest(n - 20, 0)) AS risk_score FROM merged)"""
ALERTS = [*CHAIN, EPISODES, MERGED]


def alerts(t):
    occ = written(occurrences(t), "occurrences")
    # the close happens right after the occurrence
    closes = occ.where("event_id % 1000 = 300").select("alert_fingerprint", F.col("t"))
    return A.dedup_alerts(occ, closes)


DEDUPED = oracle("""SELECT fp AS alert_fingerprint, episode, event_id, n AS occurrence_count, first_seen, last_seen, title, confidence,
  CASE WHEN codes = '' THEN '' ELSE array_to_string(list_sort(string_split(codes, ',')), ',') END AS rule_codes FROM alerts""", *ALERTS)


def deduped(found):
    return found.select("alert_fingerprint", "episode", "event_id", "occurrence_count", "first_seen", "last_seen", F.col("alert_title").alias("title"),
                        "confidence", F.coalesce(F.array_join("rule_codes", ","), F.lit("")).alias("rule_codes"))


@query("alert_dedup", DEDUPED)
def _(t):
    return deduped(alerts(t))


# the events in four runs by time, every run twice: the stored alerts equal those of one run
@query("alert_runs", DEDUPED)
def _(t):
    occ = written(occurrences(t), "occurrences")
    stored = A.StoredAlerts(t.spark, new_folder(t.spark, "alerts"), 8)
    first, last = occ.agg(F.min("t"), F.max("t")).first()
    part = F.floor((F.col("t") - first) * 4 / (last + 1 - first))
    for run in (0, 0, 1, 1, 2, 3, 3):
        rows = occ.where(part == run)
        stored.add(rows, f"run {run}", rows.where("event_id % 1000 = 300").select("alert_fingerprint", "t"))
    return deduped(stored.alerts())


@query("alert_escalation", oracle("""SELECT fp AS alert_fingerprint, episode, severity, risk_score,
  CASE severity WHEN 'critical' THEN 'P1' WHEN 'high' THEN 'P2' WHEN 'medium' THEN 'P3' WHEN 'low' THEN 'P4' ELSE 'P5' END AS priority FROM alerts""", *ALERTS))
def _(t):
    return alerts(t).select("alert_fingerprint", "episode", "severity", "risk_score", "priority")


@query("alert_escalation_steps", oracle(f"""SELECT event_id, ({SEV})[least(4, k % 5 + greatest(least(k, 20) - 5, 0) + 2 * greatest(k - 20, 0)) + 1] AS severity,
  least(100, k % 60 + 5 * greatest(least(k, 20) - 5, 0) + 10 * greatest(k - 20, 0)) AS risk FROM snap"""))
def _(t):
    k = F.col("k")
    index, risk = A.escalated(severity_index(severity_name(k % 5)), k % 60, k)
    return t.snapshot.select("event_id", severity_name(index).alias("severity"), risk.alias("risk"))


IDS = """'{p}-' || strftime(make_timestamp({t}), '%Y%m%d') || '-' ||
  printf('%04d', row_number() OVER (PARTITION BY {t} // 86400000000 ORDER BY {t}, {o}))"""


@query("alert_ids", oracle("SELECT event_id, " + IDS.format(p="ALT", t="t", o="event_id") + " AS alert_id FROM snap"))
def _(t):
    return A.daily_ids(t.snapshot.select("event_id", "t"), "ALT", "t", ["event_id"], "alert_id").select("event_id", "alert_id")


# three runs over a third of the events each; every run goes on behind the numbers that the runs before gave out on a day
@query("alert_ids_runs", oracle("""SELECT event_id, run, 'ALT-' || strftime(make_timestamp(t), '%Y%m%d') || '-' ||
  printf('%04d', row_number() OVER (PARTITION BY t // 86400000000 ORDER BY run, t, event_id)) AS alert_id FROM (SELECT *, event_id % 3 AS run FROM snap)"""))
def _(t):
    out, counters = None, None
    for run in range(3):
        rows = t.snapshot.where(F.col("event_id") % 3 == run).select("event_id", "t", (F.col("event_id") % 3).alias("run"))
        ids = written(A.daily_ids(rows, "ALT", "t", ["event_id"], "alert_id", counters=counters), "ids")
        counters = written(A.daily_counters(ids, "alert_id", counters), "counters")
        out = ids if out is None else out.unionByName(ids)
    return out.select("event_id", "run", "alert_id")


# one alert per ten events, changed by the events in between
ALERT_ROWS = "al AS (SELECT 'A' || CAST(event_id AS VARCHAR) AS alert_id, event_id AS id, t AS created_at, severity, source, source_ip, host, usr, message FROM snap WHERE event_id % 10 = 0)"
ALERT_CHANGES = """ch AS (SELECT event_id - event_id % 10 AS id, t, event_id AS seq, CASE k % 5 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'investigating'
  WHEN 2 THEN 'resolved' WHEN 3 THEN 'closed' END AS status FROM snap WHERE event_id % 10 <> 0 AND k % 5 < 4)"""
STATUS = """st AS (SELECT al.*, s.status, s.acknowledged_at, s.resolved_at, s.closed_at FROM (SELECT alert_id, id, created_at, severity, source, source_ip, host, usr, message FROM al) al
  LEFT JOIN (SELECT id, arg_max(status, t) AS status, max(t) FILTER (status = 'acknowledged') AS acknowledged_at, max(t) FILTER (status = 'resolved') AS resolved_at,
  max(t) FILTER (status = 'closed') AS closed_at FROM ch GROUP BY id) s USING (id))"""
STORE = [ALERT_ROWS, ALERT_CHANGES, STATUS]


def alert_rows(t):
    return t.snapshot.where("event_id % 10 = 0").select(
        F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("alert_id"), F.col("event_id").alias("id"), F.col("t").alias("created_at"),
        "severity", "source", "source_ip", "host", "user", F.col("message").alias("alert_title"), F.lit("").alias("rule_text"))


def alert_changes(t):
    """Half of the changes name the alert by its number."""
    actions = ["acknowledge", "investigate", "resolve", "close", "ignore"]
    number = (F.col("event_id") - F.col("event_id") % 10).cast("string")
    return t.snapshot.where("event_id % 10 <> 0").select(
        F.when(F.col("event_id") % 2 == 0, number).otherwise(F.concat(F.lit("A"), number)).alias("alert_id"), "t",
        F.col("event_id").alias("seq"), F.get(F.array(*map(F.lit, actions)), F.col("k") % 5).alias("action"))


def alert_store(t):
    return A.alert_status(alert_rows(t), alert_changes(t))


@query("alert_status", oracle("SELECT alert_id, coalesce(status, 'open') AS status, acknowledged_at, resolved_at, closed_at FROM st", *STORE))
def _(t):
    return alert_store(t).select("alert_id", "status", "acknowledged_at", "resolved_at", "closed_at")


@query("alert_search", oracle("""SELECT alert_id, created_at FROM st WHERE severity = 'low' AND (contains(lower(source), 'auth') ) AND
  (contains(lower(alert_id), '1') OR contains(lower(message), '1') OR contains(coalesce(host, ''), '1')
  OR contains(coalesce(usr, ''), '1') OR contains(coalesce(source_ip, ''), '1')) ORDER BY created_at DESC, alert_id OFFSET 5 LIMIT 20""", *STORE))
def _(t):
    page, _ = A.search_alerts(alert_store(t), severity="low", source="AUTH", search="1", skip=5, limit=20)
    return page.select("alert_id", "created_at")


@query("alert_search_total", oracle("""SELECT count(*) AS total FROM st WHERE coalesce(status, 'open') = 'open' AND contains(source_ip, '0.0.1')""", *STORE))
def _(t):
    return A.search_alerts(alert_store(t), status="open", source_ip="0.0.1")[1]


@query("alert_lookup", oracle("SELECT alert_id, severity FROM st WHERE alert_id = 'A100' UNION ALL SELECT alert_id, severity FROM st WHERE id = 200", *STORE))
def _(t):
    rows = alert_rows(t)
    return A.get_alert(rows, alert_id="A100").select("alert_id", "severity").unionByName(A.get_alert(rows, number=200).select("alert_id", "severity"))


@query("alert_counts", oracle("""SELECT count(*) FILTER (severity = 'critical') AS critical_alerts, count(*) FILTER (severity = 'high') AS high_alerts,
  count(*) FILTER (coalesce(status, 'open') = 'open') AS open_alerts FROM st""", *STORE))
def _(t):
    return A.alert_counts(alert_store(t))


# --------------------------------------------------------------------------- incidents
@query("incident_create", oracle("SELECT alert_id, message AS title, 'open' AS status, " + IDS.format(p="INC", t="created_at", o="alert_id") + " AS incident_id FROM al", ALERT_ROWS))
def _(t):
    return N.create_incidents(alert_rows(t)).select("alert_id", "title", "status", "incident_id")


# events of one user on one day change one incident
CHANGES = """chg AS (SELECT 'I' || CAST(user_id AS VARCHAR) || '-' || CAST(t // 259200000000 AS VARCHAR) AS incident_id, t, event_id AS seq,
  CASE k % 5 WHEN 0 THEN 'acknowledge' WHEN 1 THEN 'investigate' WHEN 2 THEN 'close' WHEN 3 THEN 'assign' ELSE 'acknowledge' END AS action,
  usr AS actor, row_number() OVER (PARTITION BY user_id, t // 259200000000 ORDER BY t, event_id) AS rn FROM snap)"""
REPLAY = """rep AS (SELECT incident_id, seq, t, action, rn, 'open' AS before, CASE action WHEN 'acknowledge' THEN 'acknowledged' WHEN 'assign' THEN 'investigating'
    ELSE 'open' END AS after, action IN ('acknowledge', 'assign') AS accepted FROM chg WHERE rn = 1
  UNION ALL SELECT c.incident_id, c.seq, c.t, c.action, c.rn, r.after, CASE WHEN r.after = 'open' AND c.action = 'acknowledge' THEN 'acknowledged'
    WHEN r.after = 'acknowledged' AND c.action = 'investigate' THEN 'investigating' WHEN r.after = 'investigating' AND c.action = 'close' THEN 'closed'
    WHEN r.after IN ('open', 'acknowledged') AND c.action = 'assign' THEN 'investigating' ELSE r.after END,
    c.action = 'assign' OR (r.after = 'open' AND c.action = 'acknowledge') OR (r.after = 'acknowledged' AND c.action = 'investigate')
    OR (r.after = 'investigating' AND c.action = 'close') FROM rep r JOIN chg c ON c.incident_id = r.incident_id AND c.rn = r.rn + 1)"""


def incident_changes(t):
    actions = ["acknowledge", "investigate", "close", "assign", "acknowledge"]
    three_days = F.floor(F.col("t") / (3 * DAY)).cast("string")
    return t.snapshot.select(
        F.concat(F.lit("I"), F.col("user_id").cast("string"), F.lit("-"), three_days).alias("incident_id"), "t", F.col("event_id").alias("seq"),
        F.get(F.array(*map(F.lit, actions)), F.col("k") % 5).alias("action"), F.col("user").alias("actor"), F.lit("analyst").alias("role"),
        F.col("message").alias("note"), "severity")


@query("incident_transitions", oracle("""SELECT incident_id, seq, before, after, accepted, CASE WHEN NOT accepted THEN 'Invalid state transition from ''' || before ||
  ''' to ''' || CASE action WHEN 'acknowledge' THEN 'acknowledged' WHEN 'investigate' THEN 'investigating' ELSE 'closed' END || '''' END AS rejection FROM rep""",
       CHANGES, REPLAY, recursive=True))
def _(t):
    return N.apply_transitions(incident_changes(t)).select("incident_id", "seq", "before", "after", "accepted", "rejection")


@query("incident_state", oracle("""SELECT incident_id, arg_max(after, rn) AS status, max(t) FILTER (accepted AND before = 'open' AND after <> 'open') AS acknowledged_at,
  max(t) FILTER (accepted AND after = 'investigating' AND before <> after) AS investigating_at, max(t) FILTER (accepted AND after = 'closed' AND before <> after) AS closed_at,
  count(*) FILTER (accepted) AS accepted_changes, count(*) FILTER (NOT accepted) AS rejected_changes FROM rep GROUP BY incident_id""", CHANGES, REPLAY, recursive=True))
def _(t):
    out = N.current_state(N.apply_transitions(incident_changes(t)))
    return out.select("incident_id", "status", "acknowledged_at", "investigating_at", "closed_at", "accepted_changes", "rejected_changes")


@query("incident_assign", oracle("""SELECT incident_id, arg_max_null(actor, rn) AS assigned_to FROM chg WHERE action = 'assign' GROUP BY incident_id""", CHANGES))
def _(t):
    changes = incident_changes(t)
    out = N.current_state(N.apply_transitions(changes), changes)
    return out.where("assigned_role is not null").select("incident_id", "assigned_to")


@query("incident_notes", oracle("""SELECT 'I' || CAST(user_id AS VARCHAR) || '-' || CAST(t // 259200000000 AS VARCHAR) AS incident_id, sha256(string_agg(message, chr(10) ORDER BY t, event_id)) AS notes_hash,
  count(*) AS note_count FROM snap GROUP BY 1"""))
def _(t):
    return N.incident_notes(incident_changes(t)).select("incident_id", F.sha2("notes", 256).alias("notes_hash"), "note_count")


INCIDENTS = """inc AS (SELECT 'INC' || CAST(event_id AS VARCHAR) AS incident_id, message AS title, severity, t AS created_at,
  (['open','acknowledged','investigating','closed'])[k % 4 + 1] AS status, usr AS assigned_to FROM snap)"""


def incidents(t):
    return t.snapshot.select(
        F.concat(F.lit("INC"), F.col("event_id").cast("string")).alias("incident_id"), F.col("message").alias("title"), "severity",
        F.col("t").alias("created_at"), F.get(F.array(*map(F.lit, N.STATUSES)), F.col("k") % 4).alias("status"), F.col("user").alias("assigned_to"))


@query("incident_list", oracle("SELECT incident_id, created_at FROM inc WHERE status = 'open' AND severity = 'low' ORDER BY created_at DESC, incident_id OFFSET 10 LIMIT 30", INCIDENTS))
def _(t):
    return N.list_incidents(incidents(t), "open", "low", 10, 30).select("incident_id", "created_at")


@query("incident_get", oracle("SELECT incident_id, title, severity, status, created_at FROM inc WHERE incident_id = (SELECT max(incident_id) FROM inc)", INCIDENTS))
def _(t):
    found = incidents(t)
    last = found.agg(F.max("incident_id")).first()[0]
    return N.get_incident(found, last).select("incident_id", "title", "severity", "status", "created_at")


@query("incident_search", oracle("SELECT incident_id, assigned_to FROM inc WHERE contains(lower(incident_id), 'failed') OR contains(lower(title), 'failed') ORDER BY assigned_to ASC NULLS FIRST, incident_id OFFSET 25 LIMIT 25", INCIDENTS))
def _(t):
    return N.search_incidents(incidents(t), "FAILED", "assigned_to", True, 1, 25).select("incident_id", "assigned_to")


@query("incident_charts", oracle("""SELECT 'severity' AS chart, severity AS slice, count(*) AS value FROM inc GROUP BY severity
  UNION ALL SELECT 'status', status, count(*) FROM inc GROUP BY status""", INCIDENTS))
def _(t):
    return N.incident_charts(incidents(t))


@query("incident_latest", oracle("SELECT incident_id, status FROM inc ORDER BY created_at DESC, incident_id LIMIT 5", INCIDENTS))
def _(t):
    return N.latest_incidents(incidents(t)).select("incident_id", "status")


@query("dashboard_summary", oracle("""SELECT count(*) AS total_incidents, (SELECT count(*) FROM snap) AS total_logs,
  count(*) FILTER (status = 'open') AS open_incidents, count(*) FILTER (status = 'acknowledged') AS acknowledged_incidents,
  count(*) FILTER (status = 'investigating') AS investigating_incidents, count(*) FILTER (status = 'closed') AS closed_incidents,
  count(*) FILTER (severity = 'critical') AS critical_incidents, count(*) FILTER (severity = 'high') AS high_incidents,
  count(*) FILTER (severity = 'medium') AS medium_incidents, count(*) FILTER (severity = 'low') AS low_incidents FROM inc""", INCIDENTS))
def _(t):
    return N.dashboard_summary(incidents(t), t.table("events"))


# --------------------------------------------------------------------------- notifications
ALERT_EVENTS = "ae AS (SELECT event_id, t, severity, source || coalesce(host, '-') AS fp FROM snap)"
NOTES = f"""nx AS (SELECT a.event_id, arg_min(b.event_id, b.t) AS next_id FROM ae a JOIN ae b ON a.fp = b.fp AND b.t >= a.t + {4 * HOUR} GROUP BY a.event_id),
  alive AS (SELECT arg_min(event_id, t) AS event_id FROM ae GROUP BY fp UNION ALL SELECT next_id FROM alive JOIN nx USING (event_id)),
  fresh AS (SELECT ae.*, lead(t) OVER (PARTITION BY fp ORDER BY t) AS until FROM ae JOIN alive USING (event_id)),
  note AS (SELECT f.event_id, f.fp, f.t, f.severity, count(*) AS occurrence_count, max(r.t) AS last_seen FROM fresh f JOIN ae r ON r.fp = f.fp AND r.t >= f.t
    AND (f.until IS NULL OR r.t < f.until) GROUP BY ALL)"""


def alert_events(t):
    return t.snapshot.select("event_id", "t", "severity", F.concat("source", F.coalesce("host", F.lit("-"))).alias("alert_fingerprint"))


@query("notify_suppress", oracle("SELECT event_id, occurrence_count, last_seen FROM note", ALERT_EVENTS, NOTES, recursive=True))
def _(t):
    runs = M.suppress_notifications(alert_events(t), 4 * HOUR)
    return runs.groupBy(F.col("anchor").alias("event_id")).agg(F.count("*").alias("occurrence_count"), F.max("t").alias("last_seen"))


QUIET = "((t // 3600000000) % 24 >= 22 OR (t // 3600000000) % 24 < 8)"
POLICY = "(CASE severity WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' ELSE 'Critical' END || ' Severity Policy')"


@query("notify_create", oracle(f"""SELECT event_id, occurrence_count, {POLICY} AS recipient_group, CASE WHEN occurrence_count > 1 THEN 'suppressed'
  WHEN {QUIET} AND severity <> 'critical' THEN 'suppressed' WHEN severity IN ('high', 'critical') THEN 'delivered' ELSE 'pending' END AS status FROM note""",
       ALERT_EVENTS, NOTES, recursive=True))
def _(t):
    out = M.notifications(alert_events(t), M.default_policies(t.spark), 4 * HOUR)
    return out.select("event_id", "occurrence_count", "recipient_group", "status")


@query("notify_policy", oracle(f"""SELECT event_id, CASE WHEN k % 6 = 0 THEN 'informational_policy' ELSE {POLICY} END AS recipient_group,
  CASE WHEN k % 6 = 0 THEN 'analyst' WHEN severity IN ('high', 'critical') THEN 'lead_analyst' ELSE 'analyst' END AS initial_role FROM snap"""))
def _(t):
    df = t.snapshot.select("event_id", F.when(F.col("k") % 6 == 0, "informational").otherwise(F.col("severity")).alias("severity"))
    return M.with_policy(df, M.default_policies(t.spark)).select("event_id", "recipient_group", "initial_role")


@query("notify_quiet_hours", oracle(f"SELECT event_id, {QUIET} AS quiet FROM snap"))
def _(t):
    return t.snapshot.select("event_id", M.in_quiet_hours(M.hour_of(F.col("t"))).alias("quiet"))


@query("notify_route", oracle(f"""SELECT event_id, CASE WHEN {QUIET} AND severity <> 'critical' THEN 'suppressed'
  WHEN severity IN ('high', 'critical') THEN 'immediate' ELSE 'pending' END AS target FROM snap"""))
def _(t):
    return t.snapshot.select("event_id", M.route(F.col("severity"), M.hour_of(F.col("t"))).alias("target"))


RECIPIENTS = """rcp AS (SELECT s_name AS recipient_name, CASE s_suppkey % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'lead_analyst' ELSE 'other' END AS role
  FROM supplier WHERE s_suppkey < 12 AND s_suppkey % 5 <> 0)"""


@query("notify_recipients", oracle("""SELECT event_id, recipient_name, CASE WHEN recipient_name IS NULL THEN 'No active recipients' ELSE 'queued' END AS delivery_status
  FROM (SELECT event_id, CASE WHEN k % 9 = 0 THEN 'nobody' WHEN severity IN ('high', 'critical') THEN 'lead_analyst' ELSE 'analyst' END AS role FROM snap)
  LEFT JOIN rcp USING (role)""", RECIPIENTS))
def _(t):
    rcp = t.table("supplier").where("s_suppkey < 12").select(
        F.col("s_name").alias("recipient_name"), F.when(F.col("s_suppkey") % 4 == 0, "analyst").when(F.col("s_suppkey") % 4 == 1, "lead_analyst")
        .otherwise("other").alias("role"), (F.col("s_suppkey") % 5 != 0).alias("is_active"))
    df = t.snapshot.select("event_id", F.when(F.col("k") % 9 == 0, "nobody").when(F.col("severity").isin("high", "critical"), "lead_analyst")
                           .otherwise("analyst").alias("initial_role"))
    return M.expand_recipients(df, rcp).select("event_id", "recipient_name", "delivery_status")


ALL_RECIPIENTS = """rcp AS (SELECT s_name AS recipient_name, CASE s_suppkey % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'lead_analyst' ELSE 'other' END AS role
  FROM supplier WHERE s_suppkey % 5 <> 0)"""


@query("notify_recipients_all", oracle("""SELECT event_id, recipient_name, CASE WHEN recipient_name IS NULL THEN 'No active recipients' ELSE 'queued' END AS delivery_status
  FROM (SELECT event_id, CASE WHEN k % 9 = 0 THEN 'nobody' WHEN severity IN ('high', 'critical') THEN 'lead_analyst' ELSE 'analyst' END AS role FROM snap)
  LEFT JOIN rcp USING (role)""", ALL_RECIPIENTS))
def _(t):
    rcp = t.table("supplier").select(
        F.col("s_name").alias("recipient_name"), F.when(F.col("s_suppkey") % 4 == 0, "analyst").when(F.col("s_suppkey") % 4 == 1, "lead_analyst")
        .otherwise("other").alias("role"), (F.col("s_suppkey") % 5 != 0).alias("is_active"))
    df = t.snapshot.select("event_id", F.when(F.col("k") % 9 == 0, "nobody").when(F.col("severity").isin("high", "critical"), "lead_analyst")
                           .otherwise("analyst").alias("initial_role"))
    return M.expand_recipients(df, rcp).select("event_id", "recipient_name", "delivery_status")


# line items are delivery attempts: order = notification, line number = channel
ATTEMPTS = """att AS (SELECT l_orderkey AS notification_id, (l_linenumber - 1) % 5 AS ord, l_quantity > 20 AS ok, epoch_us(l_shipdate) AS t FROM lineitem),
  ch AS (SELECT notification_id, ord, bool_and(ok) AS ok, count(*) AS n, max(t) AS t FROM att GROUP BY ALL),
  won AS (SELECT notification_id, min(ord) FILTER (ok) AS won FROM ch GROUP BY ALL)"""


@query("notify_failover", "WITH " + ATTEMPTS + """ SELECT notification_id, (['Email','Teams','Slack','Webhook','PagerDuty'])[won + 1] AS channel_used,
  CASE WHEN won IS NULL THEN 'failed' ELSE 'delivered' END AS status,
  CASE WHEN won IS NULL THEN 'all_channels_failed' ELSE 'delivered_via_' || lower((['Email','Teams','Slack','Webhook','PagerDuty'])[won + 1]) END AS delivery_status,
  CAST(sum(n) AS BIGINT) AS history_rows, max(t) AS last_delivery_attempt FROM won JOIN ch USING (notification_id) WHERE won IS NULL OR ord <= won GROUP BY ALL""")
def _(t):
    channel = F.get(F.array(*map(F.lit, fx.CHANNELS)), (F.col("l_linenumber") - 1) % 5)
    att = t.table("lineitem").select(F.col("l_orderkey").alias("notification_id"), channel.alias("channel"), (F.col("l_quantity") > 20).alias("ok"),
                                     F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"))
    return M.channel_outcome(att)


NSTATES = list(fx.NOTIFICATION_TRANSITIONS)
NMOVES = " OR ".join(f"(s = '{a}' AND w = '{b}')" for a, bs in fx.NOTIFICATION_TRANSITIONS.items() for b in [*bs, a])
NCHANGES = f"""nchg AS (SELECT 'N' || CAST(user_id AS VARCHAR) || '-' || CAST(t // 259200000000 AS VARCHAR) AS nid, event_id AS seq, ({NSTATES!r})[k % 10 + 1] AS w,
  row_number() OVER (PARTITION BY user_id, t // 259200000000 ORDER BY t, event_id) AS rn FROM snap),
  nrep AS (SELECT nid, seq, rn, s AS before, CASE WHEN {NMOVES} THEN w ELSE s END AS after, ({NMOVES}) AS accepted FROM (SELECT *, 'pending' AS s FROM nchg WHERE rn = 1)
  UNION ALL SELECT nid, seq, rn, s, CASE WHEN {NMOVES} THEN w ELSE s END, ({NMOVES}) FROM
    (SELECT c.*, r.after AS s FROM nrep r JOIN nchg c ON c.nid = r.nid AND c.rn = r.rn + 1))"""


@query("notify_transitions", oracle("SELECT nid AS notification_id, seq, before, after, accepted FROM nrep", NCHANGES, recursive=True))
def _(t):
    three_days = F.floor(F.col("t") / (3 * DAY)).cast("string")
    changes = t.snapshot.select(F.concat(F.lit("N"), F.col("user_id").cast("string"), F.lit("-"), three_days).alias("notification_id"), "t",
                                F.col("event_id").alias("seq"), F.get(F.array(*map(F.lit, NSTATES)), F.col("k") % 10).alias("action"))
    return M.apply_transitions(changes).select("notification_id", "seq", "before", "after", "accepted")


NROWS = """nt AS (SELECT 'N' || CAST(event_id AS VARCHAR) AS notification_id, 'A' || CAST(event_id - event_id % 10 AS VARCHAR) AS alert_id, severity,
  (['sent','delivered','escalated','suppressed','failed','pending','closed'])[k % 7 + 1] AS status, k % 5 AS delivery_attempts,
  CASE WHEN k % 4 <> 0 THEN t END AS last_delivery_attempt, k % 3 AS escalation_level, k % 17 = 0 AS escalation_stopped, t AS created_at, k % 6 + 1 AS occurrence_count
  FROM snap),
  open_nt AS (SELECT nt.* FROM nt WHERE NOT escalation_stopped AND alert_id NOT IN (SELECT alert_id FROM st WHERE status IN ('acknowledged', 'resolved', 'closed')))"""


def notification_rows(t):
    states = ["sent", "delivered", "escalated", "suppressed", "failed", "pending", "closed"]
    k, e = F.col("k"), F.col("event_id")
    return t.snapshot.select(
        F.concat(F.lit("N"), e.cast("string")).alias("notification_id"), F.concat(F.lit("A"), (e - e % 10).cast("string")).alias("alert_id"), "severity",
        F.get(F.array(*map(F.lit, states)), k % 7).alias("status"), (k % 5).alias("delivery_attempts"),
        F.when(k % 4 != 0, F.col("t")).alias("last_delivery_attempt"), (k % 3).alias("escalation_level"), (k % 17 == 0).alias("escalation_stopped"),
        F.col("t").alias("created_at"), (k % 6 + 1).alias("occurrence_count"))


@query("notify_stopped", oracle("SELECT notification_id FROM open_nt", *STORE, NROWS))
def _(t):
    return M.not_stopped(notification_rows(t), alert_store(t)).select("notification_id")


# 2024-01-20 00:00 UTC
NOW = 1705708800000000


@query("notify_escalations", oracle(f"""SELECT notification_id, escalation_level + 1 AS escalation_level,
  CASE WHEN escalation_level = 1 THEN 'soc_manager' WHEN severity IN ('low', 'medium') THEN 'lead_analyst' ELSE 'soc_manager' END AS escalation_target,
  'Level-' || CAST(escalation_level + 1 AS VARCHAR) || ' escalation: unacknowledged for ' || CAST(mins AS VARCHAR) || ' minutes' AS escalation_reason
  FROM (SELECT *, CASE WHEN escalation_level = 0 THEN CASE severity WHEN 'low' THEN 30 WHEN 'medium' THEN 15 WHEN 'high' THEN 10 ELSE 5 END
    WHEN escalation_level = 1 THEN CASE severity WHEN 'low' THEN 60 WHEN 'medium' THEN 30 END END AS mins FROM open_nt WHERE status IN ('delivered', 'escalated', 'suppressed'))
  WHERE mins IS NOT NULL AND {NOW} >= created_at + CAST(mins AS BIGINT) * 60000000 AND NOT (occurrence_count = 2 AND escalation_level = 0)""", *STORE, NROWS))
def _(t):
    n = notification_rows(t)
    done = n.where("occurrence_count = 2").select("notification_id", F.lit(1).alias("escalation_level"))
    out = M.due_escalations(n, M.default_policies(t.spark), alert_store(t), done, NOW)
    return out.select("notification_id", "escalation_level", "escalation_target", "escalation_reason")


@query("notify_retry", oracle(f"""SELECT notification_id FROM open_nt WHERE status = 'failed' AND delivery_attempts < 3
  AND (last_delivery_attempt IS NULL OR last_delivery_attempt <= {NOW - 5 * MINUTE})""", *STORE, NROWS))
def _(t):
    return M.retry_set(notification_rows(t), alert_store(t), NOW).select("notification_id")


@query("notify_batch", oracle("SELECT notification_id FROM open_nt WHERE status = 'pending' AND severity IN ('low', 'medium')", *STORE, NROWS))
def _(t):
    return M.batch_queue(notification_rows(t), alert_store(t)).select("notification_id")


@query("notify_daily_metrics", oracle("""SELECT strftime(make_timestamp(t), '%Y-%m-%d') AS metric_date, count(*) FILTER (k % 5 = 0) AS total_sent,
  count(*) FILTER (k % 5 = 1) AS total_failed, count(*) FILTER (k % 5 = 2) AS total_suppressed, count(*) FILTER (k % 5 = 3) AS total_escalated,
  count(*) FILTER (k % 5 = 4) AS total_retried, coalesce(avg(CAST(floor(value) AS BIGINT)) FILTER (k % 5 = 0), 0) AS avg_delivery_time_seconds FROM snap GROUP BY 1"""))
def _(t):
    outcomes = ["sent", "failed", "suppressed", "escalated", "retried"]
    h = t.snapshot.select("t", F.get(F.array(*map(F.lit, outcomes)), F.col("k") % 5).alias("outcome"), F.floor("value").alias("delivery_seconds"))
    return M.daily_metrics(h)


@query("notify_context", oracle(f"""SELECT notification_id, alert_id, CASE escalation_level WHEN 0 THEN 'NEW' ELSE 'ESCALATED' END AS tag,
  '[' || upper(nt.severity) || '][L' || CAST(escalation_level AS VARCHAR) || '][' || CASE escalation_level WHEN 0 THEN 'NEW' ELSE 'ESCALATED' END || '] ' || message
    || coalesce(' on ' || host, '') AS subject,
  CASE WHEN secs < 0 THEN '0s' ELSE coalesce(nullif(concat_ws(' ', CASE WHEN secs >= 86400 THEN CAST(secs // 86400 AS VARCHAR) || 'd' END,
    CASE WHEN secs % 86400 // 3600 > 0 THEN CAST(secs % 86400 // 3600 AS VARCHAR) || 'h' END, CASE WHEN secs % 3600 // 60 > 0 THEN CAST(secs % 3600 // 60 AS VARCHAR) || 'm' END,
    CASE WHEN secs % 60 > 0 THEN CAST(secs % 60 AS VARCHAR) || 's' END), ''), '0s') END AS time_since,
  upper(coalesce(st.status, 'open')) AS alert_status, CASE WHEN id % 20 = 0 THEN 'Rule A, CODE_B' ELSE 'N/A' END AS rule_name,
  CASE WHEN id % 20 = 0 THEN 'because; also' ELSE 'N/A' END AS detection_reason, CASE WHEN id % 30 = 0 THEN 'burst, scan' ELSE 'N/A' END AS correlation_rule,
  CASE WHEN id % 30 = 0 THEN '12' ELSE 'N/A' END AS related_events, CASE WHEN occurrence_count > 1 THEN 'Yes' ELSE 'No' END AS is_duplicate
  FROM (SELECT *, CAST(floor(({NOW} - created_at) / 1000000) AS BIGINT) AS secs FROM nt) nt JOIN st USING (alert_id)""", *STORE, NROWS))
def _(t):
    def rule(name, code, reason):
        return F.struct(F.lit(name).alias("rule_name"), F.lit(code).alias("rule_code"), F.lit(reason).alias("reason"))

    def corr(kind, n):
        return F.struct(F.lit(kind).alias("correlation_type"), F.lit(n).alias("event_count"))

    store = alert_store(t).withColumns({
        "rule_matches": F.when(F.col("id") % 20 == 0, F.array(rule("Rule A", "CODE_A", "because"), rule("", "CODE_B", "also"))),
        "correlation_matches": F.when(F.col("id") % 30 == 0, F.array(corr("burst", 5), corr("scan", 7))),
    })
    return M.message_context(notification_rows(t), store, NOW)
