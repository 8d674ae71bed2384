"""Boundary pairs: what fires and what does not."""

import json

import pytest
from pyspark.sql import functions as F

from vigil.functions.exprs import MINUTE, severity_index, severity_name
from vigil.operators import alerts, correlate as X, detect, incidents, ingest, notify, ports, rules, weblog
from vigil.plans import pipeline

SNAP = ("event_id bigint, t bigint, event_type string, host string, source string, user string, source_ip string, "
        "http_method string, request_uri string, status_code string, risks array<int>")
S = 1_000_000


def snap(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = dict(event_type="x", host="h", source="s", user="u", source_ip="1.1.1.1", http_method=None, request_uri=None,
                 status_code=None, risks=None, t=i * S)
        d.update(r)
        full.append((i, *[d[k] for k in ("t", "event_type", "host", "source", "user", "source_ip", "http_method", "request_uri",
                                          "status_code", "risks")]))
    df = spark.createDataFrame(full, SNAP)
    match = F.transform("risks", lambda r: F.struct(F.concat(F.lit("R"), r.cast("string")).alias("rule_code"), r.alias("risk_score")))
    return df.withColumn("rule_matches", match)


def fired(detector, df, **kw):
    return sorted((r.event_id, r.event_count) for r in detector(df, **kw).collect())


FAIL, OK = {"event_type": "login_failed"}, {"event_type": "login_success"}


def test_login_burst(spark):
    assert fired(X.failed_login_burst, snap(spark, [FAIL] * 5)) == []
    assert fired(X.failed_login_burst, snap(spark, [FAIL] * 6)) == [(5, 6)]
    assert fired(X.failed_login_burst, snap(spark, [FAIL] * 5 + [{**FAIL, "user": ""}])) == []
    late = [{**FAIL, "t": 0}] + [{**FAIL, "t": 5 * MINUTE + 1 + i} for i in range(5)]
    assert fired(X.failed_login_burst, snap(spark, late)) == []
    edge = [{**FAIL, "t": 0}] + [{**FAIL, "t": 5 * MINUTE - 4 + i} for i in range(5)]
    assert fired(X.failed_login_burst, snap(spark, edge)) == [(5, 6)]


def test_brute_force(spark):
    assert fired(X.brute_force_success, snap(spark, [FAIL] * 3 + [OK])) == [(3, 4)]
    assert fired(X.brute_force_success, snap(spark, [FAIL] * 2 + [OK])) == []
    assert fired(X.brute_force_success, snap(spark, [FAIL] * 4)) == []


def test_multi_host(spark):
    hosts = [{"host": f"h{i}"} for i in range(3)]
    df = snap(spark, hosts)
    assert fired(X.multi_host_attack, df) == [(2, 3)]
    assert fired(X.multi_host_attack, snap(spark, [*hosts[:2], {"host": None}, hosts[0]])) == []
    listed = X.with_hosts(X.multi_host_attack(df), df, 15 * MINUTE).first()
    assert listed.related_host == "h0, h1, h2"


def test_reconnaissance(spark):
    kinds = [{"event_type": e} for e in ("dns.query", "http.get", "login", "container.stop")]
    out = {r.event_id: (r.severity, r.risk_score) for r in X.reconnaissance(snap(spark, kinds)).collect()}
    assert out == {2: ("medium", 70), 3: ("high", 85)}
    assert fired(X.reconnaissance, snap(spark, [{"event_type": "browser.access"}])) == []


def test_rule_chain_and_escalation(spark):
    assert fired(X.high_risk_rule_chain, snap(spark, [{"risks": [60]}, {"risks": [70]}])) == [(1, 2)]
    assert fired(X.high_risk_rule_chain, snap(spark, [{"risks": [60]}, {"risks": [60, 40]}])) == []
    # an event without an address is judged on all events of its user
    mixed = [{"risks": [60]}, {"risks": [70], "source_ip": None}]
    assert fired(X.high_risk_rule_chain, snap(spark, mixed)) == [(1, 2)]
    # and one with an address only on that address
    assert fired(X.high_risk_rule_chain, snap(spark, mixed[::-1])) == []
    assert fired(X.risk_escalation, snap(spark, [{"risks": [60, 20]}, {"risks": [40]}])) == [(1, 2)]
    assert fired(X.risk_escalation, snap(spark, [{"risks": [60]}, {"risks": [39]}])) == []


def test_chains(spark):
    steps = [{"event_type": e} for e in ("process_start", "browser.download", "browser.search")]
    assert fired(X.download_execution_chain, snap(spark, steps)) == [(2, 3)]
    assert fired(X.download_execution_chain, snap(spark, steps[:2])) == []
    assert fired(X.download_execution_chain, snap(spark, [{**s, "user": None} for s in steps])) == []
    ops = [{"event_type": f"container.{e}"} for e in ("restart", "stop", "create")]
    assert fired(X.container_attack, snap(spark, [{"event_type": "other"}, *ops])) == [(3, 4)]
    assert fired(X.container_attack, snap(spark, ops[:2])) == []


def test_web_detectors(spark):
    post = dict(source="nginx", http_method="post", request_uri="/App/Login", status_code="401")
    assert fired(X.web_brute_force, snap(spark, [post] * 5)) == [(4, 5)]
    assert fired(X.web_brute_force, snap(spark, [post] * 4)) == []
    assert fired(X.web_brute_force, snap(spark, [{**post, "source_ip": None}] * 5)) == []
    probes = [dict(source="nginx", request_uri=f"/admin/{i}", status_code="404") for i in range(10)]
    out = {r.event_id: r.severity for r in X.web_recon_scan(snap(spark, probes)).collect()}
    assert out == {4: "medium", 5: "medium", 6: "medium", 7: "medium", 8: "medium", 9: "high"}
    assert fired(X.web_recon_scan, snap(spark, [{**p, "source": "apache"} for p in probes])) == []


def test_suppression(spark):
    rows = [FAIL] * 12 + [{**FAIL, "t": 20 * MINUTE + i} for i in range(6)]
    found = X.failed_login_burst(snap(spark, rows))
    assert found.count() == 8
    assert sorted(r.event_id for r in X.surviving(found).collect()) == [5, 17]
    control = spark.createDataFrame([("failed_login_burst:u:1.1.1.1", 8 * S)], "key string, t bigint")
    assert sorted(r.event_id for r in X.surviving(found, control=control).collect()) == [5, 9, 17]


EVENT = "event_id bigint, t bigint, source string, event_type string, message string, severity string, source_ip string, metadata map<string,string>"


def test_rules(spark):
    rows = [(0, 0, "auth-svc", "login.failure", "m", "low", None, {}), (1, 1, "web", "x", "SELECT a FROM b", "low", None, {}),
            (2, 2, "nginx", "x", "m", "low", None, {"request_uri": "/x?id=1 UNION SELECT 2", "status_code": "401", "user_agent": "Zap"})]
    compiled = rules.load_rules(rules.default_rules(spark)) + rules.load_rules(rules.web_rules(spark))
    out = {r.event_id: [m.rule_code for m in r.rule_matches] for r in rules.pattern_rules(spark.createDataFrame(rows, EVENT), compiled).collect()}
    assert out == {0: [], 1: ["SQL_INJECTION"], 2: ["NGINX_AUTH_FAILURE", "NGINX_SQL_INJECTION", "NGINX_SUSPICIOUS_UA"]}
    # a rule without conditions and a broken regex match nothing
    empty = rules.default_rules(spark).limit(1).withColumns(
        {"source_type": F.lit(None).cast("string"), "message_pattern": F.lit("/(/")}).collect()
    assert all(not r.rule_matches for r in rules.pattern_rules(spark.createDataFrame(rows, EVENT), empty).collect())


def test_threshold_keeps_firing_and_expires(spark):
    rows = [(i, t, "auth", "login.failure", "m", "low", None, {}) for i, t in enumerate([0, S, 2 * S, 3 * S, 10 * MINUTE])]
    hits = rules.threshold_rules(spark.createDataFrame(rows, EVENT), rules.load_rules(rules.default_rules(spark)), "event_id", "t")
    assert sorted((r.event_id, r.matching) for r in hits.collect()) == [(2, 3), (3, 4)]


@pytest.mark.parametrize("row,want", [
    (("login_failed", "low", "10.0.0.99", "auth", {}), "high"), (("login_failed", "low", "10.0.0.1", "auth", {}), None),
    (("malware.detected", "low", None, "s", {}), "high"), (("unauthorized_access", "low", None, "s", {}), "high"),
    (("malware", "critical", None, "s", {}), "critical"), (("x", "low", None, "nginx", {"status_code": "503"}), "medium"),
    (("x", "low", None, "web", {"status_code": "401"}), None), (("x", "low", None, "web", {"request_uri": "/a/../b"}), "high"),
    (("x", "low", None, "web", {"request_uri": "/a", "query_string": "q=' or '"}), "critical"),
    (("x", "low", None, "web", {"user_agent": "OWASP ZAP/2"}), "high"), (("x", "low", None, "web", {"user_agent": "zapier"}), None),
])
def test_detection(spark, row, want):
    df = spark.createDataFrame([(0, 0, row[3], row[0], "m", row[1], row[2], row[4])], EVENT)
    got = detect.detect(df).first().detection
    assert (got.severity if got.is_suspicious else None) == want


def test_escalation_closed_form(spark):
    names = ["informational", "low", "medium", "high", "critical"]
    df = spark.range(1, 41).crossJoin(spark.createDataFrame([(s, r) for s in [*names, "odd"] for r in (0, 35, 90)], "s string, r int"))
    i, k = alerts.escalated(severity_index(F.col("s")), F.col("r"), F.col("id"))
    for row in df.select("id", "s", "r", i.alias("i"), k.alias("k"), severity_name(F.when(i >= 0, i)).alias("name")).collect():
        sev, risk = row.s, row.r
        for n in range(2, row.id + 1):
            step, points = (2, 10) if n > 20 else (1, 5) if n > 5 else (0, 0)
            if step:
                sev = names[min(4, names.index(sev) + step)] if sev in names else "high"
                risk = min(100, risk + points)
        assert (row.name or row.s, row.k) == (sev, risk), row


def test_validation_cases(spark):
    cases = {
        json.dumps({"source": "s", "event_type": "e", "message": "m", "severity": "low", "timestamp": "2026-01-01T00:00:00Z", "source_ip": "1.2.3.4"}): ("VALID", 0, 0),
        json.dumps({"source": "s", "event_type": "e", "severity": "extremely_high", "source_ip": "999.999.999.999"}): ("WARNING", 0, 3),
        json.dumps({"source": "s", "message": "m"}): ("INVALID", 2, 0),
        json.dumps({"source": "s", "message": "m", "event_type": "e", "timestamp": "not-a-timestamp-iso-format"}): ("INVALID", 1, 0),
        json.dumps({"source": "s", "event_type": "e", "message": "x" * 105000}): ("INVALID", 1, 0),
        json.dumps({"source": None}): ("INVALID", 1, 0), "[1]": ("INVALID", 2, 2), "": ("INVALID", 1, 0), "{": ("INVALID", 1, 0),
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    for r in ingest.validate(ingest.with_fields(df)).collect():
        assert (r.status, len(r.errors), len(r.warnings)) == cases[r.raw], r.raw[:80]


def test_merge_counts_is_an_upsert(spark):
    a = spark.createDataFrame([("h1", 2, 1, "first"), ("h2", 1, 5, "x")], "h string, n bigint, at int, p string")
    b = spark.createDataFrame([("h1", 3, 9, "later"), ("h3", 1, 9, "new")], "h string, n bigint, at int, p string")
    assert {(r.h, r.n, r.p) for r in ingest.merge_counts(a, b, "h", "n", "at").collect()} == {("h1", 5, "first"), ("h2", 1, "x"), ("h3", 1, "new")}


def test_incident_workflow(spark):
    steps = ["close", "acknowledge", "acknowledge", "assign", "investigate", "close", "assign"]
    df = spark.createDataFrame([("i", i, i, a) for i, a in enumerate(steps)], "incident_id string, t bigint, seq bigint, action string")
    rep = incidents.apply_transitions(df)
    assert [r.accepted for r in rep.orderBy("seq").collect()] == [False, True, False, True, False, True, True]
    state = incidents.current_state(rep).first()
    assert (state.status, state.acknowledged_at, state.investigating_at, state.closed_at) == ("closed", 1, 3, 5)


def test_notifications(spark):
    noon, night = 12 * 60 * MINUTE, 23 * 60 * MINUTE
    rows = [(1, noon, "a", "high"), (2, noon + MINUTE, "a", "high"), (3, noon + 6 * MINUTE, "a", "high"), (4, night, "b", "high"),
            (5, night, "c", "critical"), (6, noon, "d", "low"), (7, noon, "e", "informational")]
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, alert_fingerprint string, severity string")
    out = {r.event_id: (r.status, r.occurrence_count, r.recipient_group) for r in notify.notifications(df, notify.default_policies(spark)).collect()}
    assert out == {1: ("suppressed", 2, "High Severity Policy"), 3: ("delivered", 1, "High Severity Policy"), 4: ("suppressed", 1, "High Severity Policy"),
                   5: ("delivered", 1, "Critical Severity Policy"), 6: ("pending", 1, "Low Severity Policy"), 7: ("pending", 1, "informational_policy")}


def test_escalation_levels(spark):
    schema = "notification_id string, alert_id string, severity string, status string, escalation_level int, escalation_stopped boolean, created_at bigint"
    rows = [("n0", "a", "low", "delivered", 0, False, 0), ("n1", "a", "low", "escalated", 1, False, 0), ("n2", "a", "low", "escalated", 2, False, 0),
            ("n3", "a", "high", "escalated", 1, False, 0), ("n4", "x", "low", "delivered", 0, False, 0), ("n5", "a", "low", "sent", 0, False, 0)]
    n = spark.createDataFrame(rows, schema)
    al = spark.createDataFrame([("a", "open"), ("x", "closed")], "alert_id string, status string")
    done = spark.createDataFrame([], "notification_id string, escalation_level int")
    due = lambda m: sorted((r.notification_id, r.escalation_level) for r in
                           notify.due_escalations(n, notify.default_policies(spark), al, done, m * MINUTE).collect())
    assert due(29) == [] and due(30) == [("n0", 1)] and due(60) == [("n0", 1), ("n1", 2)]


def test_ports(spark):
    schema = "t bigint, port int, remote_ip string, remote_port int, state string"
    df = spark.createDataFrame([(i, 80, "1.1.1.1", 1, "S") for i in range(10)] + [(i, 443, "1.1.1.1", 1, "S") for i in range(11)], schema)
    hot = ports.port_anomalies(df, threshold=10).collect()
    assert [(r.port, r.connection_count, r.source_ip, r.top_source_ips) for r in hot] == [(443, 11, "1.1.1.1", {"1.1.1.1": 11})]


def test_ip_classes(spark):
    import ipaddress
    ips = ["0.0.0.1", "10.1.2.3", "100.64.0.1", "127.0.0.9", "169.254.1.1", "172.31.0.1", "172.32.0.1", "192.0.0.8", "192.0.0.9", "192.0.2.1",
           "192.88.99.1", "192.168.1.1", "198.18.0.1", "198.51.100.9", "203.0.113.9", "224.0.0.1", "240.0.0.1", "255.255.255.255", "8.8.8.8", "bad"]
    df = spark.createDataFrame([(i,) for i in ips], "source_ip string")
    none = spark.createDataFrame([], "source_ip string")
    for r in ports.classify_ips(df, none).collect():
        try:
            p = ipaddress.ip_address(r.source_ip)
            want = "INTERNAL / LOOPBACK" if p.is_loopback else "INTERNAL" if p.is_private else "UNKNOWN / OBSERVED"
        except ValueError:
            want = "UNKNOWN / OBSERVED"
        assert r.classification == want, r


def test_empty_application_list_keeps_all(spark):
    df = spark.createDataFrame([("h", None, None)], "host string, server_name string, upstream_port string")
    assert weblog.assign_application(df, []).first().application == "all"
    assert weblog.assign_application(df).count() == 0


def test_pipeline(spark):
    def log(i, **kw):
        return (i, f"2026-01-01 00:00:{i:02d}", json.dumps(kw))

    rows = [log(i, source="auth", event_type="login_failed", message="Failed login", severity="low", source_ip="10.0.0.7", user="bob",
                host="h", timestamp=f"2026-01-01T12:00:{i:02d}Z") for i in range(8)]
    rows += [log(20, source="auth", message="no type"), log(21, source="auth", message="no type"),
             log(22, source="zzz", event_type="odd", message="thing"),
             log(23, source="win", event_type="e", message="m", record_number=5), log(24, source="win", event_type="e", message="m", record_number=5)]
    rows += [log(30, source="gw", event_type="raw", message="CEF:0|Acme|FW|1|T1|Hit|9|src=10.9.9.9 suser=eve rt=1767268800000"),
             log(31, event_type="raw", message="<Event><System><Provider Name=\"P\"/><EventID>4625</EventID><Computer>PC</Computer></System>"
                 "<EventData><Data Name=\"IpAddress\">10.8.8.8</Data></EventData></Event>")]
    raw = spark.createDataFrame(rows, "event_id bigint, received string, raw string").withColumn("received", F.to_timestamp("received"))
    out = pipeline.run(raw, rules.default_rules(spark), notify.default_policies(spark), 2026)
    assert [(r.quarantined_count, r.rejection_reason) for r in out.quarantine.collect()] == [(2, "Missing required event_type")]
    assert {(r.source, r.collector_name) for r in out.unknown.collect()} == {("win", "win_collector"), ("zzz", "zzz_collector")}
    events = {r.event_id: r for r in out.events.collect()}
    assert len(events) == 12
    cef, xml = events[30], events[31]
    assert (cef.source, cef.event_type, cef.severity, cef.source_ip, cef.user, cef.t) == (
        "cef-acme-fw", "cef_t1", "critical", "10.9.9.9", "eve", 1767268800000000)
    assert (cef.detected_format, cef.metadata["vendor"], cef.detection.severity) == ("cef", "Acme", "critical")
    assert (xml.source, xml.event_type, xml.source_ip, xml.host, xml.log_type, xml.log_subtype) == (
        "P", "windows_event_4625", "10.8.8.8", "PC", "windows_event", "authentication")
    assert [(r.correlation_type, r.event_count) for r in out.correlations.collect()] == [("failed_login_burst", 6)]
    alert = {a.alert_type: a for a in out.alerts.collect()}
    assert set(alert) == {"correlation", "detection"}
    burst = alert["correlation"]
    assert (burst.severity, burst.occurrence_count, burst.alert_title) == ("high", 1, "Correlation Match: failed_login_burst")
    assert {a.alert_id for a in alert.values()} == {"ALT-20260101-0001", "ALT-20260101-0002"}
    assert {r.incident_id for r in out.incidents.collect()} == {"INC-20260101-0001", "INC-20260101-0002"}
    assert sorted(r.recipient_group for r in out.notifications.collect()) == ["Critical Severity Policy", "High Severity Policy"]
