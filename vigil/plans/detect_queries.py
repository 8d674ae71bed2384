"""Rules, detection, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.operators import correlate as X
from vigil.operators import detect as D
from vigil.operators import rules as R
from vigil.plans.adapters import HOUR, oracle
from vigil.plans.registry import query
from vigil.streaming.storage import written

SQLI = "|".join(fx.SQL_INJECTION_PATTERNS).replace("'", "''")
TRAVERSAL = "|".join(fx.PATH_TRAVERSAL_PATTERNS)
RECON = " OR ".join(f"starts_with(lower(request_uri), '{p}')" for p in fx.RECON_PATHS)
AGENTS = " OR ".join(f"contains(lower(user_agent), '{a}')" for a in fx.SCANNER_AGENTS)
DETECT_AGENTS = " OR ".join(f"contains(lower(user_agent), '{a}')" for a in fx.DETECTION_SCANNER_AGENTS)
LOGIN_URI = " OR ".join(f"contains(lower(request_uri), '{p}')" for p in fx.LOGIN_URI_PARTS)

# hits of the built-in web rules and of the default pattern rules that can match these events
HITS = f"""hits AS (SELECT *,
  source = 'docker' AND regexp_matches(message, 'docker exec.*(sh|bash|nc|curl|wget)', 'i') AS h_docker,
  source = 'nginx' AND coalesce(status_code = '401', false) AS h_auth,
  source = 'nginx' AND coalesce(regexp_matches(request_uri, '{SQLI}', 'i'), false) AS h_sql,
  source = 'nginx' AND coalesce(regexp_matches(request_uri, '{TRAVERSAL}', 'i'), false) AS h_path,
  source = 'nginx' AND coalesce({RECON}, false) AS h_recon,
  source = 'nginx' AND coalesce({AGENTS}, false) AS h_agent FROM snap)"""
CODES = """concat_ws(',', CASE WHEN h_docker THEN 'SUSPICIOUS_DOCKER_EXEC' END, CASE WHEN h_auth THEN 'NGINX_AUTH_FAILURE' END,
  CASE WHEN h_sql THEN 'NGINX_SQL_INJECTION' END, CASE WHEN h_path THEN 'NGINX_PATH_TRAVERSAL' END,
  CASE WHEN h_recon THEN 'NGINX_RECON_SCAN' END, CASE WHEN h_agent THEN 'NGINX_SUSPICIOUS_UA' END)"""
RISK = """greatest(0, CASE WHEN h_docker THEN 95 ELSE 0 END, CASE WHEN h_auth THEN 60 ELSE 0 END, CASE WHEN h_sql THEN 90 ELSE 0 END,
  CASE WHEN h_path THEN 80 ELSE 0 END, CASE WHEN h_recon THEN 50 ELSE 0 END, CASE WHEN h_agent THEN 70 ELSE 0 END)"""


def default_and_web(t):
    return [r for df in (R.default_rules(t.spark), R.web_rules(t.spark)) for r in R.load_rules(df)]


def matched(t):
    """Events with the matches of all pattern rules."""
    return R.pattern_rules(t.events, default_and_web(t))


def codes(column="rule_matches"):
    return F.array_join(F.transform(column, lambda m: m["rule_code"]), ",")


# --------------------------------------------------------------------------- rules
@query("rule_field_match", oracle("""SELECT event_id, contains(lower(message), 'failed login') AS plain,
  regexp_matches(message, 'failed.*user 1', 'i') AS regex_i, regexp_matches(message, 'failed') AS regex_case, false AS broken FROM snap"""))
def _(t):
    m = F.col("message")
    return t.snapshot.select("event_id", R.match_field(m, "Failed LOGIN").alias("plain"), R.match_field(m, "/failed.*user 1/i").alias("regex_i"),
                             R.match_field(m, "/failed/").alias("regex_case"), R.match_field(m, "/(failed/").alias("broken"))


@query("rule_pattern", oracle(f"SELECT event_id, {CODES} AS rule_codes FROM hits WHERE {CODES} <> ''", HITS))
def _(t):
    return matched(t).where(F.size("rule_matches") > 0).select("event_id", codes().alias("rule_codes"))


@query("rule_meta_ops", oracle("""SELECT event_id, coalesce(lower(http_method) = 'post', false) AS eq,
  coalesce(contains(lower(request_uri), 'login'), false) AS has, coalesce(contains(lower(request_uri), 'git') OR contains(lower(request_uri), 'shop'), false)
  AS has_any, coalesce(starts_with(lower(request_uri), '/admin') OR starts_with(lower(request_uri), '/shop'), false) AS starts,
  coalesce(regexp_matches(request_uri, 'PAGE\\d+', 'i'), false) AS regex, coalesce(regexp_matches(user_agent, '^sql|zap', 'i'), false) AS regex_any,
  false AS missing, false AS unknown_op FROM snap"""))
def _(t):
    uri, m = F.col("metadata")["request_uri"], F.col("metadata")
    c = R.condition_holds
    return t.events.select(
        "event_id", c(m["http_method"], "eq", ["Post"]).alias("eq"), c(uri, "contains", ["LOGIN"]).alias("has"),
        c(uri, "contains_any", ["git", "shop"]).alias("has_any"), c(uri, "startswith_any", ["/ADMIN", "/shop"]).alias("starts"),
        c(uri, "regex", ["PAGE\\d+"]).alias("regex"), c(m["user_agent"], "regex_any", ["^sql", "zap"]).alias("regex_any"),
        c(m["nothing"], "eq", ["x"]).alias("missing"), c(uri, "like", ["/"]).alias("unknown_op"))


@query("rule_builtin_web", oracle("""SELECT rule_code, severity, risk_score, count(*) AS n FROM (
  SELECT 'NGINX_AUTH_FAILURE' AS rule_code, 'high' AS severity, 60 AS risk_score FROM hits WHERE h_auth
  UNION ALL SELECT 'NGINX_SQL_INJECTION', 'critical', 90 FROM hits WHERE h_sql UNION ALL SELECT 'NGINX_PATH_TRAVERSAL', 'high', 80 FROM hits WHERE h_path
  UNION ALL SELECT 'NGINX_RECON_SCAN', 'medium', 50 FROM hits WHERE h_recon UNION ALL SELECT 'NGINX_SUSPICIOUS_UA', 'high', 70 FROM hits WHERE h_agent)
  GROUP BY ALL""", HITS))
def _(t):
    out = R.pattern_rules(t.events, R.load_rules(R.web_rules(t.spark))).select(F.explode("rule_matches").alias("m"))
    return out.groupBy("m.rule_code", "m.severity", "m.risk_score").agg(F.count("*").alias("n"))


@query("rule_theta_join", oracle("""SELECT event_id, unnest(string_split(codes, ',')) AS rule_code FROM
  (SELECT event_id, """ + CODES + """ AS codes FROM hits) WHERE codes <> ''""", HITS))
def _(t):
    rules = R.default_rules(t.spark).unionByName(R.web_rules(t.spark))
    return R.rule_theta_join(t.events, rules, "event_id").select("event_id", "rule_code")


def login_rules(t):
    from pyspark.sql import Row
    base = dict(rule_type="threshold", severity="high", source_type="auth", message_pattern=None, risk_score=75, conditions=None)
    return [Row(rule_code="BURST", rule_name="Burst", event_type_pattern="login_failed", threshold_count=5, threshold_minutes=360, **base),
            Row(rule_code="LOGINS", rule_name="Logins", event_type_pattern="/^login/", threshold_count=12, threshold_minutes=720, **base),
            Row(rule_code="NEVER", rule_name="Never", event_type_pattern=None, threshold_count=None, threshold_minutes=5, **base)]


THRESHOLD = f"""counted AS (SELECT event_id, 'BURST' AS rule_code, count(*) OVER (PARTITION BY source, event_type ORDER BY t
  RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW) AS matching, 5 AS needed FROM snap WHERE contains(source, 'auth') AND event_type = 'login_failed'
  UNION ALL SELECT event_id, 'LOGINS', count(*) OVER (PARTITION BY source, event_type ORDER BY t
  RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW), 12 FROM snap WHERE contains(source, 'auth') AND starts_with(event_type, 'login'))"""


@query("rule_threshold", oracle("SELECT event_id, rule_code, matching FROM counted WHERE matching >= needed", THRESHOLD))
def _(t):
    return R.threshold_rules(t.snapshot, login_rules(t), "event_id", "t").select("event_id", "rule_code", "matching")


@query("rule_matches_all", oracle(f"""SELECT event_id, {CODES} || CASE WHEN {CODES} <> '' AND more IS NOT NULL THEN ',' ELSE '' END || coalesce(more, '')
  AS rule_codes FROM hits LEFT JOIN (SELECT event_id, string_agg(rule_code, ',' ORDER BY rule_code) AS more FROM counted WHERE matching >= needed
  GROUP BY event_id) USING (event_id)""", HITS, THRESHOLD))
def _(t):
    hits = R.threshold_rules(t.snapshot, login_rules(t), "event_id", "t")
    out = R.with_threshold_matches(matched(t), hits, "event_id")
    return out.select("event_id", F.array_join(F.array_sort(F.transform(F.filter("rule_matches", lambda m: m["rule_code"].isin("BURST", "LOGINS")),
                                                                        lambda m: m["rule_code"])), ",").alias("_b"),
                      codes().alias("_all"), F.array_join(F.transform(F.filter("rule_matches", lambda m: ~m["rule_code"].isin("BURST", "LOGINS")),
                                                                      lambda m: m["rule_code"]), ",").alias("_p")).select(
        "event_id", F.concat_ws(",", F.when(F.col("_p") != "", F.col("_p")), F.when(F.col("_b") != "", F.col("_b"))).alias("rule_codes"))


# about a thousand rules, one per brand and size of the parts: plain texts, regexes, and patterns that only Python takes or nobody does
def part_rules(t):
    brand = F.substring_index("p_brand", "#", -1).cast("int")
    pairs = t.table("part").select(brand.alias("b"), F.col("p_size").alias("z")).distinct()
    z, kind = F.col("z").cast("string"), F.col("b") % 5
    pattern = (
        F.when(kind == 0, F.concat(F.lit("/page "), z, F.lit("$/"))).when(kind == 1, F.concat(F.lit(" Item "), z, F.lit(" Down ")))
        .when(kind == 2, F.concat(F.lit("/(?P<who>USER) "), z, F.lit("\\Z/i"))).when(kind == 3, F.concat(F.lit("/page ("), z, F.lit("/")))
        .otherwise(F.concat(F.lit("/^(query|get).* "), z, F.lit(r"\b/i")))
    )
    none = lambda kind: F.lit(None).cast(kind)
    return pairs.select(
        (F.col("b") * 100 + F.col("z")).alias("id"), F.concat(F.lit("rule "), z).alias("rule_name"), F.concat_ws("-", F.col("b").cast("string"), z).alias("rule_code"),
        F.lit("pattern").alias("rule_type"), F.lit("high").alias("severity"), F.when(F.col("b") % 2 == 0, "nginx").alias("source_type"),
        none("string").alias("event_type_pattern"), pattern.alias("message_pattern"), none("int").alias("threshold_count"), none("int").alias("threshold_minutes"),
        (F.col("z") % 100).cast("int").alias("risk_score"), F.lit(True).alias("is_enabled"),
        none("array<struct<field:string,op:string,values:array<string>>>").alias("conditions"),
    )


THOUSAND = """pr AS (SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INT) AS b, p_size AS z FROM part),
hit AS (SELECT event_id, b, z, b * 100 + z AS id FROM snap JOIN pr ON (b % 2 <> 0 OR contains(source, 'nginx')) AND CASE b % 5
  WHEN 0 THEN regexp_matches(message, 'page ' || z || '$') WHEN 1 THEN contains(lower(message), 'item ' || z || ' down')
  WHEN 2 THEN regexp_matches(message, 'USER ' || z || '$', 'i') WHEN 4 THEN regexp_matches(message, '^(query|get).* ' || z || '\\b', 'i') ELSE false END)"""


@query("rule_thousand", oracle("""SELECT event_id, count(*) AS n, arg_min(b || '-' || z, id) AS first_rule, string_agg(b || '-' || z, ',' ORDER BY id) AS rule_codes
  FROM hit GROUP BY event_id""", THOUSAND))
def _(t):
    out = R.match_rules(t.snapshot.select("event_id", "source", "event_type", "message"), R.load_rules(part_rules(t))).where(F.size("rule_matches") > 0)
    return out.select("event_id", F.size("rule_matches").cast("bigint").alias("n"), F.col("rule_matches")[0]["rule_code"].alias("first_rule"), codes().alias("rule_codes"))


@query("rule_max_risk", oracle(f"SELECT event_id, {RISK} AS risk FROM hits", HITS))
def _(t):
    return matched(t).select("event_id", R.max_rule_risk(F.col("rule_matches")).alias("risk"))


# --------------------------------------------------------------------------- detection
REQUEST = "CASE WHEN coalesce(query_string, '') <> '' THEN request_uri || '?' || query_string ELSE request_uri END"
VERDICT = f"""verdict AS (SELECT *, CASE WHEN severity = 'critical' THEN 'critical' WHEN contains(event_type, 'malware') THEN 'high'
    WHEN contains(event_type, 'unauthorized') THEN 'high' WHEN event_type = 'login_failed' AND source_ip IN ('192.168.1.10', '10.0.0.99', '203.0.113.50') THEN 'high'
    WHEN regexp_matches({REQUEST}, '{SQLI}', 'i') THEN 'critical' WHEN regexp_matches(request_uri, '{TRAVERSAL}', 'i') THEN 'high'
    WHEN {DETECT_AGENTS} THEN 'high' WHEN source = 'nginx' AND status_code = '401' THEN 'high' WHEN source = 'nginx' AND ({RECON}) THEN 'medium'
    WHEN source = 'nginx' AND starts_with(status_code, '5') THEN 'medium' END AS found,
  CASE WHEN severity = 'critical' THEN 'Critical severity log event' WHEN contains(event_type, 'malware') THEN 'Malware activity detected'
    WHEN contains(event_type, 'unauthorized') THEN 'Unauthorized access attempt'
    WHEN event_type = 'login_failed' AND source_ip IN ('192.168.1.10', '10.0.0.99', '203.0.113.50') THEN 'Login failure from blacklisted IP'
    WHEN regexp_matches({REQUEST}, '{SQLI}', 'i') THEN 'SQL injection pattern detected in request: ' || substr(request_uri, 1, 120)
    WHEN regexp_matches(request_uri, '{TRAVERSAL}', 'i') THEN 'Directory traversal pattern detected in request: ' || substr(request_uri, 1, 120)
    WHEN {DETECT_AGENTS} THEN 'Suspicious scanning tool user-agent detected: ' || substr(user_agent, 1, 80)
    WHEN source = 'nginx' AND status_code = '401' THEN 'HTTP 401 authentication failure on ' || request_uri
    WHEN source = 'nginx' AND ({RECON}) THEN 'Sensitive path probing detected: ' || substr(request_uri, 1, 120)
    WHEN source = 'nginx' AND starts_with(status_code, '5') THEN 'HTTP ' || status_code || ' server error on ' || request_uri END AS why FROM snap)"""


@query("detect_events", oracle("""SELECT event_id, found IS NOT NULL AS is_suspicious, coalesce(found, 'low') AS severity, why AS reason FROM verdict""", VERDICT))
def _(t):
    return D.detect(t.events).select("event_id", "detection.*")


@query("detect_web", oracle("""SELECT event_id, found AS severity, why AS reason FROM verdict WHERE source = 'nginx' AND severity <> 'critical'
  AND found IS NOT NULL""", VERDICT))
def _(t):
    web = D.detect(t.events.where("source = 'nginx' and severity <> 'critical'"))
    return web.where("detection.is_suspicious").select("event_id", "detection.severity", "detection.reason")


@query("detect_blacklist", oracle("""SELECT event_id, event_type = 'login_failed' AS login_failure FROM snap
  WHERE source_ip IN (SELECT '10.0.0.' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey IN (1, 3))"""))
def _(t):
    bad = t.table("supplier").where("s_suppkey in (1, 3)").select(F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")).alias("ip"))
    hit = D.blacklisted_events(t.events, bad)
    found = D.detect(hit.where("event_type = 'login_failed'"), bad).where("detection.is_suspicious").select("event_id", F.lit(True).alias("_f"))
    return hit.join(found, "event_id", "left").select("event_id", F.coalesce("_f", F.lit(False)).alias("login_failure"))


@query("detect_blacklist_all", oracle("""SELECT event_id, event_type = 'login_failed' AS login_failure FROM snap
  WHERE source_ip IN (SELECT '10.0.0.' || CAST(s_suppkey AS VARCHAR) FROM supplier)"""))
def _(t):
    bad = t.table("supplier").select(F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")).alias("ip"))
    hit = D.blacklisted_events(t.events, bad)
    found = D.detect(hit.where("event_type = 'login_failed'"), bad).where("detection.is_suspicious").select("event_id", F.lit(True).alias("_f"))
    return hit.join(found, "event_id", "left").select("event_id", F.coalesce("_f", F.lit(False)).alias("login_failure"))


# --------------------------------------------------------------------------- correlation
# the events are sparse, so the windows of these queries are longer than the defaults
W = {"failed_login_burst": 12, "brute_force_success": 12, "multi_host_attack": 2, "reconnaissance_activity": 2, "high_risk_rule_chain": 2,
     "browser_download_execution_chain": 6, "docker_attack_pattern": 2, "risk_score_escalation": 2, "nginx_brute_force": 12, "nginx_recon_scanning": 12}
WIDTHS = {k: h * HOUR for k, h in W.items()}
THRESHOLDS = {"risk_score_escalation": 300, "nginx_recon_scanning": 3, "nginx_brute_force": 3}


def over(key, kind, order="t"):
    return f"OVER (PARTITION BY {key} ORDER BY {order} RANGE BETWEEN {WIDTHS[kind]} PRECEDING AND CURRENT ROW)"


def detector(t, kind):
    df = matched(t) if "risk" in kind else t.events
    extra = {"threshold": THRESHOLDS[kind]} if kind in THRESHOLDS else {}
    return X.DETECTORS[kind](df, width=WIDTHS[kind], **extra)


def shown(df, *more):
    return df.select("event_id", "severity", "event_count", "first_seen", "last_seen", *more)


o = over("source_ip, usr", "failed_login_burst")
BURST = f"""burst AS (SELECT *, count(*) {o} AS n, min(t) {o} AS first_seen FROM snap WHERE event_type = 'login_failed'
  AND source_ip IS NOT NULL AND usr IS NOT NULL QUALIFY n > 5)"""


@query("corr_failed_login_burst", oracle("""SELECT event_id, 'high' AS severity, n AS event_count, first_seen, t AS last_seen,
  usr AS related_user, source_ip AS related_source_ip FROM burst""", BURST))
def _(t):
    return shown(detector(t, "failed_login_burst"), "related_user", "related_source_ip")


o = over("usr", "brute_force_success")


@query("corr_brute_force_success", oracle(f"""SELECT event_id, 'critical' AS severity, n + 1 AS event_count, first_seen, t AS last_seen FROM (
  SELECT *, count(*) FILTER (event_type = 'login_failed') {o} AS n, min(t) FILTER (event_type = 'login_failed') {o} AS first_seen FROM snap
  WHERE usr IS NOT NULL AND contains(event_type, 'login')) WHERE event_type = 'login_success' AND n >= 3"""))
def _(t):
    return shown(detector(t, "brute_force_success"))


o = over("source_ip", "multi_host_attack")


@query("corr_multi_host", oracle(f"""SELECT event_id, 'high' AS severity, n AS event_count, first_seen, t AS last_seen, hosts AS measure FROM (
  SELECT *, count(*) {o} AS n, min(t) {o} AS first_seen, count(DISTINCT host) {o} AS hosts FROM snap WHERE source_ip IS NOT NULL) WHERE hosts >= 3"""))
def _(t):
    return shown(detector(t, "multi_host_attack"), "measure")


@query("corr_multi_host_list", oracle(f"""SELECT a.event_id, string_agg(DISTINCT b.host, ', ' ORDER BY b.host) AS related_host
  FROM snap a JOIN snap b ON a.source_ip = b.source_ip AND b.t BETWEEN a.t - {WIDTHS["multi_host_attack"]} AND a.t
  GROUP BY a.event_id HAVING count(DISTINCT b.host) >= 3"""))
def _(t):
    return X.with_hosts(detector(t, "multi_host_attack"), t.events, WIDTHS["multi_host_attack"]).select("event_id", "related_host")


o = over("source_ip", "reconnaissance_activity")
CATS = {"dns": "contains(event_type, 'dns')", "http": "regexp_matches(event_type, 'http|web|browser')",
        "auth": "regexp_matches(event_type, 'login|auth|access')", "docker": "source = 'docker' OR contains(event_type, 'container')"}


@query("corr_recon", oracle(f"""SELECT event_id, CASE WHEN c >= 4 THEN 'high' ELSE 'medium' END AS severity, n AS event_count, first_seen,
  t AS last_seen, c AS measure FROM (SELECT *, count(*) {o} AS n, min(t) {o} AS first_seen,
  {' + '.join(f"max(CASE WHEN {c} THEN 1 ELSE 0 END) {o}" for c in CATS.values())} AS c FROM snap WHERE source_ip IS NOT NULL) WHERE c >= 3"""))
def _(t):
    return shown(detector(t, "reconnaissance_activity"), "measure")


def by_ip_or_user(kind, aggregates, trigger):
    """Rows with an address use the address, the others everything their user did."""
    a = aggregates.format(o=over("source_ip", kind))
    b = aggregates.format(o=over("usr", kind))
    return f"""SELECT *, {a} FROM hits WHERE source_ip IS NOT NULL QUALIFY {trigger}
      UNION ALL SELECT * FROM (SELECT *, {b} FROM hits WHERE usr IS NOT NULL) WHERE source_ip IS NULL AND {trigger}"""


CHAIN_AGG = ("count(*) {o} AS n, min(t) {o} AS first_seen, " + " + ".join(
    f"max(CASE WHEN {h} THEN 1 ELSE 0 END) {{o}}" for h in ("h_docker", "h_auth", "h_sql", "h_path", "h_recon", "h_agent")) + " AS rules")


@query("corr_rule_chain", oracle(f"""SELECT event_id, 'critical' AS severity, n AS event_count, first_seen, t AS last_seen, rules AS measure FROM (
  {by_ip_or_user("high_risk_rule_chain", CHAIN_AGG, "rules >= 2 AND (h_docker OR h_auth OR h_sql OR h_path OR h_recon OR h_agent)")})""", HITS))
def _(t):
    return shown(detector(t, "high_risk_rule_chain"), "measure")


o = over("usr", "browser_download_execution_chain")


@query("corr_download_exec", oracle(f"""SELECT event_id, 'critical' AS severity, n AS event_count, first_seen, t AS last_seen FROM (SELECT *,
  count(*) {o} AS n, min(t) {o} AS first_seen, bool_or(event_type = 'browser.search') {o} AND bool_or(event_type = 'browser.download') {o}
  AND bool_or(starts_with(event_type, 'process')) {o} AS hit FROM snap WHERE usr IS NOT NULL) WHERE hit"""))
def _(t):
    return shown(detector(t, "browser_download_execution_chain"))


o = over("host", "docker_attack_pattern")


@query("corr_container_attack", oracle(f"""SELECT event_id, 'high' AS severity, n AS event_count, first_seen, t AS last_seen FROM (SELECT *,
  count(*) {o} AS n, min(t) {o} AS first_seen, bool_or(event_type = 'container.restart') {o} AND bool_or(event_type = 'container.stop') {o}
  AND bool_or(event_type = 'container.create') {o} AS hit FROM snap WHERE host IS NOT NULL) WHERE hit AND source = 'docker'"""))
def _(t):
    return shown(detector(t, "docker_attack_pattern"))


RISK_AGG = "count(*) {o} AS n, min(t) {o} AS first_seen, sum(" + RISK + ") {o} AS total"


@query("corr_risk_escalation", oracle(f"""SELECT event_id, 'critical' AS severity, n AS event_count, first_seen, t AS last_seen,
  CAST(total AS BIGINT) AS risk_score FROM ({by_ip_or_user("risk_score_escalation", RISK_AGG, f"total >= 300 AND {RISK} > 0")})""", HITS))
def _(t):
    return shown(detector(t, "risk_score_escalation"), "risk_score")


o = over("source_ip", "nginx_brute_force")


@query("corr_web_brute_force", oracle(f"""SELECT event_id, 'high' AS severity, n AS event_count, first_seen, t AS last_seen FROM (SELECT *,
  count(*) {o} AS n, min(t) {o} AS first_seen FROM snap WHERE status_code = '401' AND http_method = 'POST' AND ({LOGIN_URI})
  AND source_ip IS NOT NULL) WHERE n >= 3"""))
def _(t):
    return shown(detector(t, "nginx_brute_force"))


o = over("source_ip", "nginx_recon_scanning")
PROBE = f"(source = 'nginx' AND status_code IN ('401', '403', '404', '500') AND ({RECON}))"


@query("corr_web_recon", oracle(f"""SELECT event_id, CASE WHEN paths >= 10 THEN 'high' ELSE 'medium' END AS severity, n AS event_count, first_seen,
  t AS last_seen, paths AS measure FROM (SELECT *, count(*) {o} AS n, min(t) {o} AS first_seen,
  count(DISTINCT CASE WHEN {PROBE} THEN lower(request_uri) END) {o} AS paths FROM snap WHERE source_ip IS NOT NULL) WHERE {PROBE} AND paths >= 3"""))
def _(t):
    return shown(detector(t, "nginx_recon_scanning"), "measure")


@query("corr_fingerprint", oracle("""SELECT event_id, sha256(source || '|' || coalesce(host, '') || '|' || event_type || '|' || coalesce(usr, '') || '|' ||
  coalesce(source_ip, '')) AS event_fingerprint FROM snap"""))
def _(t):
    return t.snapshot.select("event_id", X.event_fingerprint().alias("event_fingerprint"))


@query("corr_key", oracle("""SELECT event_id, kind || ':' || CASE kind WHEN 'failed_login_burst' THEN coalesce(usr, '') || ':' || coalesce(source_ip, '')
  WHEN 'brute_force_success' THEN coalesce(usr, '') WHEN 'multi_host_attack' THEN coalesce(source_ip, '') WHEN 'docker_attack_pattern' THEN coalesce(host, '')
  WHEN 'risk_score_escalation' THEN coalesce(source_ip, usr, 'unknown') ELSE coalesce(source_ip, usr, host, 'unknown') END AS correlation_key FROM
  (SELECT *, (['failed_login_burst','brute_force_success','multi_host_attack','docker_attack_pattern','risk_score_escalation','other'])[k % 6 + 1] AS kind FROM snap)"""))
def _(t):
    kinds = ["failed_login_burst", "brute_force_success", "multi_host_attack", "docker_attack_pattern", "risk_score_escalation", "other"]
    df = t.snapshot.select("event_id", F.get(F.array(*map(F.lit, kinds)), F.col("k") % 6).alias("correlation_type"),
                           F.col("user").alias("related_user"), F.col("source_ip").alias("related_source_ip"), F.col("host").alias("related_host"))
    return df.select("event_id", X.correlation_key().alias("correlation_key"))


# suppression: follow the pointer from each firing match to the next one
SURVIVORS = f"""m AS (SELECT event_id, usr || ':' || source_ip AS key, t, first_seen + {12 * HOUR} AS d, n FROM burst),
  nxt AS (SELECT a.event_id, arg_min(b.event_id, b.t) AS next_id FROM m a JOIN m b ON a.key = b.key AND a.d < b.t GROUP BY a.event_id),
  alive AS (SELECT arg_min(event_id, t) AS event_id FROM m GROUP BY key
    UNION ALL SELECT next_id FROM alive JOIN nxt USING (event_id))"""


@query("corr_suppress", oracle("SELECT event_id, key AS correlation_key, n AS event_count FROM m JOIN alive USING (event_id)", BURST, SURVIVORS, recursive=True)
       .replace("usr || ':' || source_ip AS key", "'failed_login_burst:' || usr || ':' || source_ip AS key"))
def _(t):
    out = X.surviving(detector(t, "failed_login_burst"), {"failed_login_burst": 12 * HOUR})
    return out.select("event_id", "correlation_key", "event_count")


@query("corr_survivors", oracle("SELECT event_id, usr AS related_user, source_ip AS related_source_ip, n AS event_count, first_seen, 'high' AS severity FROM burst "
       "WHERE event_id IN (SELECT event_id FROM alive)", BURST, SURVIVORS, recursive=True))
def _(t):
    return login_survivors(t, 12)


def login_survivors(t, hours):
    """Scan, trailing window per user and address, suppression of repeats, alert rows."""
    found = written(X.failed_login_burst(t.events, width=hours * HOUR), "matches")
    out = X.surviving(found, {"failed_login_burst": hours * HOUR})
    return out.select("event_id", "related_user", "related_source_ip", "event_count", "first_seen", "severity")


CLOSED = f"""ctl AS (SELECT 'failed_login_burst:' || usr || ':' || source_ip AS key, t FROM snap WHERE k % 50 = 7 AND usr IS NOT NULL AND source_ip IS NOT NULL),
  cm AS (SELECT event_id, key, t, least(d, coalesce((SELECT min(c.t) FROM ctl c WHERE c.key = x.key AND c.t >= x.t), d)) AS d FROM
    (SELECT event_id, 'failed_login_burst:' || usr || ':' || source_ip AS key, t, first_seen + {12 * HOUR} AS d FROM burst) x),
  cn AS (SELECT a.event_id, arg_min(b.event_id, b.t) AS next_id FROM cm a JOIN cm b ON a.key = b.key AND a.d < b.t GROUP BY a.event_id),
  up AS (SELECT arg_min(event_id, t) AS event_id FROM cm GROUP BY key UNION ALL SELECT next_id FROM up JOIN cn USING (event_id))"""


@query("corr_close_reset", oracle("""SELECT m.key, m.event_id, arg_max(a.event_id, a.t) AS anchor, m.event_id IN (SELECT event_id FROM up) AS fires
  FROM cm m JOIN (SELECT cm.* FROM cm JOIN up USING (event_id)) a ON a.key = m.key AND a.t <= m.t GROUP BY m.key, m.event_id""", BURST, CLOSED, recursive=True))
def _(t):
    """An analyst closes the correlation of a user's key at every 50th event: the key fires again at once."""
    control = t.snapshot.where("k % 50 = 7 and `user` is not null and source_ip is not null").select(
        F.concat_ws(":", F.lit("failed_login_burst"), "user", "source_ip").alias("key"), "t")
    out = X.suppress_matches(detector(t, "failed_login_burst"), {"failed_login_burst": 12 * HOUR}, control)
    return out.select("key", F.col("id").alias("event_id"), "anchor", "fires")


@query("recent_correlations", oracle("SELECT event_id, n AS event_count FROM burst ORDER BY t DESC, event_id DESC LIMIT 50", BURST))
def _(t):
    return X.recent(detector(t, "failed_login_burst"), 50).select("event_id", "event_count")
