"""Ten trailing-window detectors over event snapshots, and suppression of repeats.

A detector prepares its rows, hands them to ``windows`` (``kernels.trailing_window``, or its streaming form in ``streaming.keyed``) and
judges what comes back. A snapshot row has: event_id, t (epoch microseconds), event_type, host, source, user, source_ip, rule_matches,
http_method, request_uri, status_code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import MINUTE, contains_any, or_else, sha_of, starts_with_any
from vigil.operators.kernels import suppress, trailing_window, values_in_window
from vigil.operators.rules import max_rule_risk

MATCH_COLUMNS = [
    "event_id", "t", "correlation_type", "severity", "confidence", "risk_score", "related_user", "related_source_ip",
    "related_host", "event_count", "first_seen", "last_seen", "measure", "reason", "event_fingerprint",
]


def _low(name: str) -> Column:
    return F.lower(F.coalesce(name, F.lit("")))


def _id(name: str) -> Column:
    return or_else(F.col(name))


def event_fingerprint() -> Column:
    return sha_of(F.col("source"), F.col("host"), F.col("event_type"), F.col("user"), F.col("source_ip"))


def is_login_failure() -> Column:
    return _low("event_type").contains("login") & _low("event_type").contains("fail")


def is_web_auth_failure() -> Column:
    return (
        (F.coalesce("status_code", F.lit("")) == "401")
        & (F.upper(F.coalesce("http_method", F.lit(""))) == "POST")
        & contains_any(_low("request_uri"), fx.LOGIN_URI_PARTS)
    )


def is_web_probe() -> Column:
    return (
        _low("source").contains("nginx")
        & F.coalesce(F.col("status_code").isin(fx.RECON_STATUS_CODES), F.lit(False))
        & starts_with_any(_low("request_uri"), fx.RECON_PATHS)
    )


def is_container_event() -> Column:
    return _low("source").contains("docker") | _low("event_type").contains("container")


def _carry() -> dict[str, Column]:
    return {
        "event_id": F.col("event_id"),
        "_user": F.col("user"),
        "_ip": F.col("source_ip"),
        "_host": F.col("host"),
        "event_fingerprint": event_fingerprint(),
    }


def _matches(found: DataFrame, kind: str, severity, confidence: int, risk, count: str, span: str, measure: str,
             reason: Column) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return found.select(
        "event_id", "t",
        F.lit(kind).alias("correlation_type"),
        as_col(severity).alias("severity"),
        F.lit(confidence).alias("confidence"),
        as_col(risk).cast("bigint").alias("risk_score"),
        F.col("_user").alias("related_user"),
        F.col("_ip").alias("related_source_ip"),
        F.col("_host").alias("related_host"),
        F.col(count).cast("bigint").alias("event_count"),
        F.col(f"{span}_first").alias("first_seen"),
        F.col("t").alias("last_seen"),
        F.col(measure).cast("bigint").alias("measure"),
        reason.alias("reason"),
        "event_fingerprint",
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _minutes(width: int) -> str:
    return f"{width // MINUTE} minutes"


def failed_login_burst(df: DataFrame, width: int = 5 * MINUTE, threshold: int = 5, windows: Callable = trailing_window) -> DataFrame:
    """More than ``threshold`` failed logins of one user from one address."""
    fails = df.where(is_login_failure())
    found = windows(
        fails, {"k_ip": _id("source_ip"), "k_user": _id("user")}, F.col("t"), width, query=F.lit(True), keep=_carry(),
        sums={"n": F.lit(1)}, spans={"hit": F.lit(True)},
    ).where(F.col("n") > threshold)
    reason = _text(F.col("n"), " failed login attempts from ", F.col("k_ip"), " for user '", F.col("k_user"),
                   f"' within {_minutes(width)}")
    return _matches(found, "failed_login_burst", "high", 90, 75, "n", "hit", "n", reason)


def brute_force_success(df: DataFrame, width: int = 10 * MINUTE, threshold: int = 3, windows: Callable = trailing_window) -> DataFrame:
    """A successful login after at least ``threshold`` failed ones of the same user."""
    failed, login = is_login_failure(), _low("event_type").contains("login")
    found = windows(
        df.where(login), {"k_user": _id("user")}, F.col("t"), width, query=~failed, keep=_carry(),
        sums={"n": failed.cast("int")}, spans={"hit": failed},
    ).where(F.col("n") >= threshold).withColumn("events", F.col("n") + 1)
    reason = _text("Brute force detected: ", F.col("n"), " failed login attempts followed by successful login for user '",
                   F.col("k_user"), f"' within {_minutes(width)}")
    return _matches(found, "brute_force_success", "critical", 95, 95, "events", "hit", "n", reason)


def multi_host_attack(df: DataFrame, width: int = 15 * MINUTE, threshold: int = 3, windows: Callable = trailing_window) -> DataFrame:
    """One address on at least ``threshold`` hosts. ``with_hosts`` adds the list of hosts."""
    found = windows(
        df, {"k_ip": _id("source_ip")}, F.col("t"), width, query=F.lit(True), keep=_carry(),
        sums={"events": F.lit(1)}, spans={"any": F.lit(True)}, distinct={"hosts": F.array(_id("host"))},
    ).where(F.col("hosts") >= threshold)
    reason = _text("Source IP ", F.col("k_ip"), " contacted ", F.col("hosts"), f" distinct hosts within {_minutes(width)}")
    return _matches(found, "multi_host_attack", "high", 85, 80, "events", "any", "hosts", reason)


def with_hosts(matches: DataFrame, df: DataFrame, width: int) -> DataFrame:
    """Replace related_host by the sorted list of hosts; meant for matches that survived suppression."""
    asked = matches.select(F.col("related_source_ip").alias("k_ip"), "t", "event_id")
    lists = values_in_window(asked, df, {"k_ip": _id("source_ip")}, F.col("t"), _id("host"), width, "event_id").select(
        "event_id", F.array_join("values", ", ").alias("_hosts")
    )
    text = _text("Source IP ", F.col("related_source_ip"), " contacted ", F.col("measure"), " distinct hosts (",
                 F.col("_hosts"), f") within {_minutes(width)} — possible lateral movement")
    return matches.join(lists, "event_id").withColumns({"related_host": F.col("_hosts"), "reason": text}).drop("_hosts")


def reconnaissance(df: DataFrame, width: int = 10 * MINUTE, threshold: int = 3, windows: Callable = trailing_window) -> DataFrame:
    """One address active in at least ``threshold`` of four event categories."""
    kind = _low("event_type")
    categories = {
        "auth": contains_any(kind, ["login", "auth", "access"]),
        "dns": kind.contains("dns"),
        "docker": is_container_event(),
        "http": contains_any(kind, ["http", "web", "browser"]),
    }
    found = windows(
        df, {"k_ip": _id("source_ip")}, F.col("t"), width, query=F.lit(True), keep=_carry(),
        sums={"events": F.lit(1), **{f"c_{n}": c.cast("int") for n, c in categories.items()}},
        spans={"any": F.lit(True)},
    )
    present = F.array_compact(F.array(*[F.when(F.col(f"c_{n}") > 0, n) for n in categories]))
    found = found.withColumn("present", present).withColumn("n", F.size("present")).where(F.col("n") >= threshold)
    high = F.col("n") >= 4
    reason = _text("Reconnaissance detected from ", F.col("k_ip"), ": ", F.col("n"), " distinct event categories (",
                   F.array_join("present", ", "), f") observed within {_minutes(width)}")
    return _matches(found, "reconnaissance_activity", F.when(high, "high").otherwise("medium"), 80,
                    F.when(high, 85).otherwise(70), "events", "any", "n", reason)


def _by_address_or_user(df: DataFrame, query: Column) -> tuple[DataFrame, dict[str, Column], Column]:
    """Rows once per entity they belong to. Events without an address are judged on everything their user did,
    including what that user did from known addresses, so the two roles need separate windows."""
    ip, user = _id("source_ip"), _id("user")
    roles = F.array_compact(
        F.array(
            F.when(ip.isNotNull(), F.struct(F.lit("ip").alias("role"), ip.alias("entity"), query.alias("asks"))),
            F.when(
                user.isNotNull(),
                F.struct(F.lit("user").alias("role"), user.alias("entity"), (query & ip.isNull()).alias("asks")),
            ),
        )
    )
    rows = df.withColumn("_r", F.explode(roles))
    return rows, {"role": F.col("_r.role"), "entity": F.col("_r.entity")}, F.col("_r.asks")


def high_risk_rule_chain(df: DataFrame, width: int = 15 * MINUTE, threshold: int = 2, min_risk: int = 50, windows: Callable = trailing_window) -> DataFrame:
    """At least ``threshold`` different high-risk rules for one address (else user)."""
    codes = F.transform(
        F.filter("rule_matches", lambda m: m["risk_score"] >= min_risk), lambda m: m["rule_code"]
    )
    rows, keys, asks = _by_address_or_user(df.withColumn("_codes", codes), F.size(F.coalesce(codes, F.array())) > 0)
    found = windows(
        rows, keys, F.col("t"), width, query=asks, keep=_carry(), sums={"events": F.lit(1)},
        spans={"any": F.lit(True)}, distinct={"rules": F.col("_codes")},
    ).where(F.col("rules") >= threshold)
    reason = _text("High-risk rule chain detected: ", F.col("rules"),
                   f" distinct high-risk rules triggered within {_minutes(width)}")
    return _matches(found, "high_risk_rule_chain", "critical", 92, 95, "events", "any", "rules", reason)


def download_execution_chain(df: DataFrame, width: int = 30 * MINUTE, windows: Callable = trailing_window) -> DataFrame:
    """Browser search, browser download and process start of one user, in any order."""
    kind = _low("event_type")
    browser = kind.contains("browser")
    found = windows(
        df, {"k_user": _id("user")}, F.col("t"), width, query=F.lit(True), keep=_carry(),
        sums={
            "events": F.lit(1),
            "s": (browser & kind.contains("search")).cast("int"),
            "d": (browser & kind.contains("download")).cast("int"),
            "x": (kind.startswith("process") | kind.startswith("exec")).cast("int"),
        },
        spans={"any": F.lit(True)},
    ).where("s > 0 and d > 0 and x > 0")
    reason = _text("Attack chain detected for user '", F.col("k_user"),
                   f"': browser search → browser download → process execution within {_minutes(width)}")
    return _matches(found, "browser_download_execution_chain", "critical", 88, 90, "events", "any", "events", reason)


def container_attack(df: DataFrame, width: int = 10 * MINUTE, windows: Callable = trailing_window) -> DataFrame:
    """Container restart, stop and create on one host; the count covers all events of the host."""
    kind, mine = _low("event_type"), is_container_event()
    found = windows(
        df, {"k_host": _id("host")}, F.col("t"), width, query=mine, keep=_carry(),
        sums={
            "events": F.lit(1),
            "r": (mine & kind.contains("restart")).cast("int"),
            "s": (mine & kind.contains("stop")).cast("int"),
            "c": (mine & kind.contains("create")).cast("int"),
        },
        spans={"any": F.lit(True)},
    ).where("r > 0 and s > 0 and c > 0")
    reason = _text("Docker attack pattern detected on host '", F.col("k_host"),
                   f"': container restart + stop + create/recreate within {_minutes(width)}")
    return _matches(found, "docker_attack_pattern", "high", 85, 80, "events", "any", "events", reason)


def risk_escalation(df: DataFrame, width: int = 60 * MINUTE, threshold: int = 100, windows: Callable = trailing_window) -> DataFrame:
    """Sum of per-event rule risk of one address (else user) reaches ``threshold``."""
    rows, keys, asks = _by_address_or_user(df, F.coalesce(F.size("rule_matches") > 0, F.lit(False)))
    found = windows(
        rows, keys, F.col("t"), width, query=asks, keep=_carry(),
        sums={"events": F.lit(1), "risk": max_rule_risk(F.col("rule_matches"))}, spans={"any": F.lit(True)},
    ).where(F.col("risk") >= threshold)
    what = F.when(F.col("role") == "ip", "source_ip").otherwise("user")
    reason = _text("Risk score escalation: cumulative risk score ", F.col("risk"), f" (threshold: {threshold}) for ", what,
                   " '", F.col("entity"), "' across ", F.col("events"), f" events within {_minutes(width)}")
    return _matches(found, "risk_score_escalation", "critical", 90, F.col("risk"), "events", "any", "risk", reason)


def web_brute_force(df: DataFrame, width: int = 5 * MINUTE, threshold: int = 5, windows: Callable = trailing_window) -> DataFrame:
    """Rejected POSTs to login pages from one address."""
    found = windows(
        df.where(is_web_auth_failure()), {"k_ip": _id("source_ip")}, F.col("t"), width, query=F.lit(True),
        keep=_carry(), sums={"n": F.lit(1)}, spans={"hit": F.lit(True)},
    ).where(F.col("n") >= threshold)
    reason = _text(F.col("n"), " HTTP 401 authentication failures from ", F.col("k_ip"),
                   f" within {width // MINUTE} minute(s) (threshold: {threshold})")
    return _matches(found, "nginx_brute_force", "high", 90, 80, "n", "hit", "n", reason)


def web_recon_scan(df: DataFrame, width: int = 10 * MINUTE, threshold: int = 5, high: int = 10, windows: Callable = trailing_window) -> DataFrame:
    """Different sensitive paths probed from one address; the count covers all its events."""
    probe = is_web_probe()
    found = windows(
        df, {"k_ip": _id("source_ip")}, F.col("t"), width, query=probe, keep=_carry(), sums={"events": F.lit(1)},
        spans={"any": F.lit(True)}, distinct={"paths": F.when(probe, F.array(_low("request_uri")))},
    ).where(F.col("paths") >= threshold)
    many = F.col("paths") >= high
    reason = _text("Reconnaissance scanning detected from ", F.col("k_ip"), ": ", F.col("paths"),
                   f" distinct sensitive path(s) probed within {width // MINUTE} minute(s) (threshold: {threshold})")
    return _matches(found, "nginx_recon_scanning", F.when(many, "high").otherwise("medium"), 85,
                    F.when(many, 85).otherwise(70), "events", "any", "paths", reason)


DETECTORS = {
    "failed_login_burst": failed_login_burst,
    "brute_force_success": brute_force_success,
    "multi_host_attack": multi_host_attack,
    "reconnaissance_activity": reconnaissance,
    "high_risk_rule_chain": high_risk_rule_chain,
    "browser_download_execution_chain": download_execution_chain,
    "docker_attack_pattern": container_attack,
    "risk_score_escalation": risk_escalation,
    "nginx_brute_force": web_brute_force,
    "nginx_recon_scanning": web_recon_scan,
}


def all_matches(df: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    out = None
    for name, detector in DETECTORS.items():
        part = detector(df, **({"width": widths[name]} if widths and name in widths else {}))
        out = part if out is None else out.unionByName(part)
    return out


# --------------------------------------------------------------------------- suppression of repeats
def correlation_key() -> Column:
    kind = F.col("correlation_type")
    user, ip, host = [F.coalesce(f"related_{n}", F.lit("")) for n in ("user", "source_ip", "host")]
    entity = or_else(ip, user, F.lit("unknown"))
    who = (
        F.when(kind == "failed_login_burst", F.concat_ws(":", user, ip))
        .when(kind.isin("brute_force_success", "browser_download_execution_chain"), user)
        .when(kind.isin("multi_host_attack", "reconnaissance_activity", "nginx_brute_force", "nginx_recon_scanning"), ip)
        .when(kind == "docker_attack_pattern", host)
        .when(kind.isin("high_risk_rule_chain", "risk_score_escalation"), entity)
        .otherwise(or_else(ip, user, host, F.lit("unknown")))
    )
    return F.concat_ws(":", kind, who)


def suppress_matches(matches: DataFrame, windows: dict[str, int] | None = None, control: DataFrame | None = None):
    """(key, id, t, anchor, fires): a match fires unless an earlier one of its key is active.

    Active means: no more than the type's window after the *first_seen* of the match that fired.
    ``control`` (key, t) closes an active correlation.
    """
    window = suppression_window(windows, F.col("correlation_type"))
    if control is not None:
        control = control.withColumn("reach", suppression_window(windows, F.substring_index("key", ":", 1)))
    return suppress(
        matches, correlation_key(), F.col("event_id"), F.col("t"), F.col("first_seen") + window, reach=window,
        control=control,
    )


def suppression_window(windows: dict[str, int] | None, kind: Column) -> Column:
    windows = windows or {k: m * MINUTE for k, m in fx.SUPPRESSION_MINUTES.items()}
    out = F
    for name, width in windows.items():
        out = out.when(kind == name, F.lit(width))
    return out.otherwise(F.lit(5 * MINUTE)).cast("bigint")


def surviving(matches: DataFrame, windows: dict[str, int] | None = None, control: DataFrame | None = None) -> DataFrame:
    kept = suppress_matches(matches, windows, control).where("fires").select(
        F.col("key").alias("correlation_key"), F.col("id").alias("event_id")
    )
    return matches.withColumn("correlation_key", correlation_key()).join(
        kept, ["correlation_key", "event_id"], "left_semi"
    )


def recent(correlations: DataFrame, limit: int) -> DataFrame:
    return correlations.orderBy(F.desc("t"), F.desc("event_id")).limit(limit)
