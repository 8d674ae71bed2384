"""First-match detection: ten ordered checks per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import contains_any, matches_any, once, or_else, starts_with_any, strip


def _verdict(severity: str, reason: Column | str) -> Column:
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(True).alias("is_suspicious"), F.lit(severity).alias("severity"), why.alias("reason"))


def web_indicators(source: Column, uri: Column, query: Column, status: Column, agent: Column) -> list:
    """(condition, verdict) pairs in priority order."""
    uri, query, status, agent = [F.coalesce(c, F.lit("")) for c in (uri, query, status, agent)]
    from_web = F.lower(F.coalesce(source, F.lit(""))).contains("nginx")
    request = F.when(query != "", F.concat(uri, F.lit("?"), query)).otherwise(uri)
    short, place = F.substring(uri, 1, 120), or_else(uri, F.lit("unknown path"))
    return [
        (
            matches_any(request, fx.SQL_INJECTION_PATTERNS),
            _verdict("critical", F.concat(F.lit("SQL injection pattern detected in request: "), short)),
        ),
        (
            matches_any(uri, fx.PATH_TRAVERSAL_PATTERNS),
            _verdict("high", F.concat(F.lit("Directory traversal pattern detected in request: "), short)),
        ),
        (
            contains_any(F.lower(agent), fx.DETECTION_SCANNER_AGENTS),
            _verdict(
                "high", F.concat(F.lit("Suspicious scanning tool user-agent detected: "), F.substring(agent, 1, 80))
            ),
        ),
        (
            from_web & (status == "401"),
            _verdict("high", F.concat(F.lit("HTTP 401 authentication failure on "), place)),
        ),
        (
            from_web & starts_with_any(F.lower(uri), fx.RECON_PATHS),
            _verdict("medium", F.concat(F.lit("Sensitive path probing detected: "), short)),
        ),
        (
            from_web & status.startswith("5"),
            _verdict("medium", F.concat(F.lit("HTTP "), status, F.lit(" server error on "), place)),
        ),
    ]


def detect(df: DataFrame, blacklist: DataFrame | None = None, blacklist_limit: int = 100_000) -> DataFrame:
    """Adds ``detection`` (is_suspicious, severity, reason). Web fields are read from ``metadata``.

    ``blacklist`` (column ip) replaces the fixed three addresses. It is joined; Spark picks the strategy, and a
    small one is broadcast after its size was checked.
    """
    kind = F.lower(strip(F.coalesce("event_type", F.lit(""))))
    if blacklist is None:
        listed = F.coalesce(F.col("source_ip").isin(fx.BLACKLISTED_IPS), F.lit(False))
        rows = df
    else:
        ips = blacklist.select(F.col("ip").alias("_bad")).where("_bad is not null").distinct()
        if ips.limit(blacklist_limit + 1).count() <= blacklist_limit:
            ips = F.broadcast(ips)
        rows = df.join(ips, (F.col("source_ip") == F.col("_bad")) & (kind == "login_failed"), "left")
        listed = F.col("_bad").isNotNull()
    meta = lambda name: F.col("metadata")[name]
    chain = (
        F.when(F.col("severity") == "critical", _verdict("critical", "Critical severity log event"))
        .when(kind.contains("malware"), _verdict("high", "Malware activity detected"))
        .when(kind.contains("unauthorized"), _verdict("high", "Unauthorized access attempt"))
        .when((kind == "login_failed") & listed, _verdict("high", "Login failure from blacklisted IP"))
    )
    for condition, verdict in web_indicators(
        F.col("source"), meta("request_uri"), meta("query_string"), meta("status_code"), meta("user_agent")
    ):
        chain = chain.when(condition, verdict)
    clean = F.struct(
        F.lit(False).alias("is_suspicious"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("reason")
    )
    return rows.withColumn("detection", once(chain.otherwise(clean))).select(*df.columns, "detection")


def blacklisted_events(df: DataFrame, blacklist: DataFrame) -> DataFrame:
    return df.join(blacklist.select(F.col("ip").alias("source_ip")).distinct(), "source_ip", "left_semi")
