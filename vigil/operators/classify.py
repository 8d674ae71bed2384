"""Log type classification: twelve ordered rules, the order is the meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import any_of, contains_any, once, or_else, strip


def windows_subtype(event_id: Column) -> Column:
    number = event_id.try_cast("int")
    choice = None
    for name, ids in fx.WINDOWS_SUBTYPES.items():
        choice = F.when(number.isin(ids), name) if choice is None else choice.when(number.isin(ids), name)
    return choice.otherwise("system")


def classify_log_type(df: DataFrame) -> DataFrame:
    """Adds log_type, log_subtype, confidence, reason from source, event_type, message, detected_format, metadata."""
    low = lambda name: F.coalesce(F.lower(strip(F.col(name))), F.lit(""))
    src, kind, msg = F.col("_src"), F.col("_kind"), F.col("_msg")
    fmt, meta, data = F.coalesce("detected_format", F.lit("text")), F.col("metadata"), F.col("_data")
    event_id = or_else(meta["event_id"], data["EventID"], meta["EventID"])
    has_id = event_id.isNotNull()
    has_provider = or_else(meta["provider"], meta["Provider"], data["Provider"]).isNotNull()
    said = lambda *words: contains_any(msg, words)

    def result(log_type, subtype, confidence, reason):
        sub = subtype if isinstance(subtype, Column) else F.lit(subtype)
        why = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(
            F.lit(log_type).alias("log_type"),
            sub.cast("string").alias("log_subtype"),
            F.lit(confidence).alias("confidence"),
            why.alias("reason"),
        )

    streams = kind.isin("docker.stdout", "docker.stderr", "docker_log")
    web = fmt == "web"
    named_key = any_of(F.map_contains_key(meta, k) for k in fx.FIREWALL_KEYS)
    rules = [
        (
            (fmt == "windows_xml") | src.contains("windows") | kind.contains("windows") | (has_id & has_provider),
            result(
                "windows_event",
                F.when(has_id, windows_subtype(event_id)).otherwise("system"),
                95,
                F.when(has_id, "Detected EventID and Provider fields").otherwise("Detected Windows Event signature"),
            ),
        ),
        (
            src.contains("chrome") | kind.startswith("browser."),
            result(
                "chrome_browser",
                F.when(kind.isin("browser.url_visit", "browser.search", "browser.download"), F.substring_index(kind, ".", -1)),
                95,
                "Source or event type matches Chrome browser log collector",
            ),
        ),
        (
            (src == "docker") & kind.startswith("docker.") & ~streams,
            result("docker_event", "container_lifecycle", 95, "Docker event lifecycle format detected"),
        ),
        (
            (src == "docker") & (streams | contains_any(kind, ["stdout", "stderr"])),
            result(
                "docker_container_log",
                F.when(kind.contains("stdout"), "stdout").when(kind.contains("stderr"), "stderr")
                .otherwise("container_log"),
                95,
                "Docker container stdout/stderr log stream",
            ),
        ),
        (
            (fmt == "syslog") | kind.contains("syslog") | src.contains("syslog"),
            result(
                "syslog",
                F.when(said(*fx.AUTH_KEYWORDS), "authentication").otherwise("system"),
                95,
                "Detected standard syslog format",
            ),
        ),
        (
            src.contains("nginx") & (web | (src == "nginx-access") | kind.contains("access")),
            result("nginx_access", "access", 95, "Web access log with Nginx source"),
        ),
        (
            src.contains("apache") & (web | (src == "apache-access") | kind.contains("access")),
            result("apache_access", "access", 95, "Web access log with Apache source"),
        ),
        (
            contains_any(src, fx.FIREWALL_SOURCES)
            | kind.contains("firewall")
            | ((fmt == "key_value") & F.coalesce(named_key, F.lit(False))),
            result(
                "firewall_log",
                F.when(said("deny", "block", "drop"), "deny").when(said("allow", "accept", "permit"), "allow")
                .otherwise("traffic"),
                90,
                "Firewall source or event pattern detected",
            ),
        ),
        (
            src.contains("dns") | contains_any(kind, ["dns", "query"]) | said("query:"),
            result(
                "dns_log",
                F.when(said("response", "reply"), "response").otherwise("query"),
                90,
                "DNS service or query pattern detected",
            ),
        ),
        (
            contains_any(src, fx.DB_KEYWORDS) | contains_any(kind, fx.DB_KEYWORDS) | said(*fx.SQL_COMMANDS),
            result(
                "database_log",
                F.when(said("error", "fail"), "error").when(said("connect", "login"), "connection").otherwise("query"),
                85,
                "Database log pattern or SQL keywords detected",
            ),
        ),
        (
            contains_any(kind, ["auth", "login", "signin", "signup", "logout"]) | said(*fx.AUTH_KEYWORDS),
            result(
                "authentication_log",
                F.when(said("fail", "deny", "bad", "mismatch", "unauthorized"), "failure").otherwise("success"),
                90,
                "Authentication keywords or event category detected",
            ),
        ),
        (
            any_of(contains_any(c, ["app", "service", "api", "backend", "frontend"]) for c in (src, kind)),
            result(
                "application_log",
                F.when(said("error", "exception"), "error").when(said("warn"), "warning").otherwise("info"),
                85,
                "Application source or service tag detected",
            ),
        ),
    ]
    chain = F
    for condition, outcome in rules:
        chain = chain.when(F.coalesce(condition, F.lit(False)), outcome)
    staged = df.withColumns(
        {
            "_src": low("source"),
            "_kind": low("event_type"),
            "_msg": low("message"),
            "_data": F.from_json(meta["event_data"], "map<string,string>"),
        }
    ).withColumn("_c", once(chain.otherwise(result("unknown", None, 20, "No matching classifier"))))
    return staged.select(*df.columns, "_c.log_type", "_c.log_subtype", "_c.confidence", "_c.reason")
