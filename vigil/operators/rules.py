"""Rule matching: pattern rules, metadata conditions, sliding thresholds, rules as data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx
from vigil.functions.exprs import MINUTE, all_of, any_of, matches_any, once, starts_with_any
from vigil.operators.kernels import trailing_window
from vigil.operators.rule_index import candidate_rules, java_regex, split_pattern
from vigil.streaming.storage import written

MATCH = "struct<rule_code:string,rule_name:string,severity:string,risk_score:int,reason:string>"
RULES = (
    "id int, rule_name string, rule_code string, rule_type string, severity string, source_type string, "
    "event_type_pattern string, message_pattern string, threshold_count int, threshold_minutes int, "
    "risk_score int, is_enabled boolean, conditions array<struct<field:string,op:string,values:array<string>>>"
)


def default_rules(spark) -> DataFrame:
    rows = [(i, *r[:3], *r[3:7], *r[7:9], r[9], True, None) for i, r in enumerate(fx.DEFAULT_RULES, 1)]
    return spark.createDataFrame(rows, RULES)


def web_rules(spark) -> DataFrame:
    rows = [
        (1000 + i, name, code, "pattern", severity, fx.WEB_RULE_SOURCE, None, None, None, None, risk, True,
         [(field, op, list(values))])
        for i, (code, name, severity, risk, field, op, values) in enumerate(fx.WEB_RULES)
    ]
    return spark.createDataFrame(rows, RULES)


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.where("is_enabled").orderBy("id")


def load_rules(rules: DataFrame) -> list:
    """Enabled rules on the driver, in order of their ids. Rules are configuration: their number doesn't grow with the events."""
    return enabled_rules(rules).collect()


def rule_by_code(rules: DataFrame, code: str) -> DataFrame:
    """The rule of this code, enabled or not; the one with the smallest id should several have it."""
    return rules.where(F.col("rule_code") == code).orderBy("id").limit(1)


# --------------------------------------------------------------------------- one rule as an expression
def match_field(col: Column, pattern: str) -> Column:
    """``/regex/flags`` or a case-insensitive substring; a regex that is broken for Python or Java matches nothing."""
    kind, text = split_pattern(pattern)
    if kind == "never":
        return F.lit(False)
    col = F.coalesce(col, F.lit(""))
    return col.rlike(text) if kind == "regex" else F.lower(col).contains(text)


def condition_holds(value: Column, op: str, values: list[str]) -> Column:
    """A metadata condition; a missing value or an unknown operator is false."""
    low, wanted = F.lower(value), [v.lower() for v in values]
    if op == "eq":
        holds = low == wanted[0]
    elif op in ("contains", "contains_any"):
        holds = any_of(low.contains(w) for w in wanted)
    elif op == "startswith_any":
        holds = starts_with_any(low, wanted)
    elif op in ("regex", "regex_any"):
        patterns = [java_regex(v) for v in values]
        if None in patterns:
            return F.lit(False)
        holds = matches_any(value, patterns)
    else:
        return F.lit(False)
    return F.coalesce(holds, F.lit(False))


def rule_holds(rule, metadata: str = "metadata") -> Column:
    """All given conditions hold; a rule without conditions never matches."""
    parts = []
    for name, pattern in (("source", rule.source_type), ("event_type", rule.event_type_pattern),
                          ("message", rule.message_pattern)):
        if pattern:
            parts.append(match_field(F.col(name), pattern))
    for c in rule.conditions or []:
        parts.append(condition_holds(F.col(metadata)[c.field], c.op, c["values"]))
    return all_of(parts) if parts else F.lit(False)


def _match(rule, reason: Column) -> Column:
    return F.struct(
        F.lit(rule.rule_code).alias("rule_code"),
        F.lit(rule.rule_name).alias("rule_name"),
        F.lit(rule.severity).alias("severity"),
        F.lit(int(rule.risk_score or 0)).alias("risk_score"),
        reason.alias("reason"),
    )


def pattern_rules(df: DataFrame, rules: list, out: str = "rule_matches") -> DataFrame:
    """One pass over the events: every rule is an expression, the hits become an array in rule order."""
    hits = [
        F.when(rule_holds(r), _match(r, F.lit(f"Log matched pattern rule: {r.rule_name}")))
        for r in rules
        if r.rule_type == "pattern"
    ]
    found = F.array_compact(F.array(*hits)) if hits else F.array()
    return df.withColumn(out, once(found.cast(f"array<{MATCH}>")))


def threshold_rules(df: DataFrame, rules: list, id_col: str, t: str) -> DataFrame | None:
    """Hits of counting rules: one row per event that sees at least ``threshold_count`` events in its trailing window, with the rule's
    place in ``rules`` (``rule_order``).

    Counted per (rule, source, event_type). A rule keeps firing while the count holds. One pass of windows per
    different width, whatever the number of rules.
    """
    usable = [(i, r) for i, r in enumerate(rules) if r.rule_type == "threshold" and r.threshold_count and r.threshold_minutes]
    if not usable:
        return None
    places = F.array(*[F.lit(i) for i, _ in usable])
    counted = df.select(id_col, t, "source", "event_type", F.explode(matched_rules(df, [r for _, r in usable])).alias("_r"))
    told = F.struct(*[F.col(f"_r.{c}").alias(c) for c in ("rule_code", "rule_name", "severity", "risk_score", "threshold_count", "threshold_minutes")])
    # the windows read their rows several times: each event is tried with the rules once
    counted = written(counted.select(id_col, t, "source", "event_type", told.alias("_r"), F.get(places, F.col("_r.n")).alias("_order")), "matched")
    hits = None
    for minutes in sorted({r.threshold_minutes for _, r in usable}):
        seen = trailing_window(
            counted.where(F.col("_r.threshold_minutes") == minutes),
            {"_rule": F.col("_order"), "source": F.coalesce("source", F.lit("")),
             "event_type": F.coalesce("event_type", F.lit(""))},
            F.col(t),
            minutes * MINUTE,
            query=F.lit(True),
            keep={id_col: F.col(id_col), "_r": F.col("_r")},
            sums={"matching": F.lit(1)},
        ).where(F.col("matching") >= F.col("_r.threshold_count"))
        reason = F.concat(
            F.col("matching").cast("string"), F.lit(f" matching events detected within {minutes} minute(s) (threshold: "),
            F.col("_r.threshold_count").cast("string"), F.lit(")"),
        )
        part = seen.select(
            id_col, "t", "source", "event_type", "matching", F.col("_r.rule_code").alias("rule_code"), F.col("_r.rule_name").alias("rule_name"),
            F.col("_r.severity").alias("severity"), F.col("_r.risk_score").alias("risk_score"), reason.alias("reason"),
            F.col("_rule").alias("rule_order"),
        )
        hits = part if hits is None else hits.unionByName(part)
    return hits


def with_threshold_matches(
    df: DataFrame, hits: DataFrame | None, id_col: str, out: str = "rule_matches", last: str | None = None
) -> DataFrame:
    """Append threshold hits to the match array, at most one per rule and event and in the order of the rules, then the matches of
    column ``last``: the order of matches is stored pattern rules, threshold rules, built-in rules."""
    none_type = f"array<{MATCH}>"
    none = F.array().cast(none_type)
    joined, more = df, none
    if hits is not None:
        grouped = hits.groupBy(id_col).agg(
            F.array_sort(F.collect_list(F.struct("rule_order", "rule_code", "rule_name", "severity", "risk_score", "reason"))).alias("_more")
        )
        plain = F.transform("_more", lambda m: F.struct(*[m[c].alias(c) for c in ("rule_code", "rule_name", "severity", "risk_score", "reason")]))
        joined, more = df.join(grouped, id_col, "left"), F.coalesce(plain.cast(none_type), none)
    parts = [F.col(out), more, *([F.col(last)] if last else [])]
    return joined.withColumn(out, F.concat(*parts)).drop("_more", *([last] if last else []))


# --------------------------------------------------------------------------- any number of rules
_FIELDS = ("source", "event_type", "message")
_PREPARED = (
    "array<struct<n:int,rule_code:string,rule_name:string,severity:string,risk_score:int,threshold_count:int,threshold_minutes:int,given:boolean,"
    + ",".join(f"{f}_kind:string,{f}_text:string" for f in _FIELDS)
    + ",conditions:array<struct<field:string,op:string,values:array<string>>>>>"
)


def _prepared(i: int, rule) -> dict:
    """A rule with its patterns taken apart and checked: what an event is tested against."""
    out = {
        "n": i, "rule_code": rule.rule_code, "rule_name": rule.rule_name, "severity": rule.severity, "risk_score": int(rule.risk_score or 0),
        "threshold_count": rule.threshold_count, "threshold_minutes": rule.threshold_minutes, "conditions": [],
    }
    for field, pattern in zip(_FIELDS, (rule.source_type, rule.event_type_pattern, rule.message_pattern), strict=True):
        out[f"{field}_kind"], out[f"{field}_text"] = split_pattern(pattern) if pattern else ("", "")
    for c in rule.conditions or []:
        values, op = [v.lower() for v in c["values"]], c.op
        if op in ("regex", "regex_any"):
            values, op = [java_regex(v, any_case=True) for v in c["values"]], "regex"
        elif op == "eq":
            values = values[:1]
        elif op in ("contains", "contains_any"):
            op = "contains"
        known = op in ("regex", "eq", "contains", "startswith_any") and None not in values
        out["conditions"].append({"field": c.field, "op": op if known else "never", "values": values if known else []})
    out["given"] = bool(out["conditions"]) or any(out[f"{f}_kind"] for f in _FIELDS)
    return out


def _fields_hold(rule: Column) -> Column:
    parts = []
    for name in _FIELDS:
        value, kind, text = F.coalesce(name, F.lit("")), rule[f"{name}_kind"], rule[f"{name}_text"]
        tested = F.when(kind == "contains", F.contains(F.lower(value), text)).when(kind == "regex", F.regexp_like(value, text))
        parts.append(F.when(kind == "", True).otherwise(F.coalesce(tested, F.lit(False))))
    return all_of([rule["given"], *parts])


def _conditions_hold(rule: Column) -> Column:
    def holds(c):
        value = F.col("metadata")[c["field"]]
        low = F.lower(value)
        tested = (
            F.when(c["op"] == "eq", F.exists(c["values"], lambda v: low == v))
            .when(c["op"] == "contains", F.exists(c["values"], lambda v: F.contains(low, v)))
            .when(c["op"] == "startswith_any", F.exists(c["values"], lambda v: F.startswith(low, v)))
            .when(c["op"] == "regex", F.exists(c["values"], lambda v: F.regexp_like(value, v)))
        )
        return F.coalesce(tested, F.lit(False))

    return F.forall(rule["conditions"], holds)


def matched_rules(df: DataFrame, rules: list) -> Column:
    """The rules (array of structs in their order, with ``n``, the place in ``rules``) that hold for an event of ``df`` (source, event_type,
    message and, where rules ask for it, metadata). One pass over its texts finds those that can hold; only these are evaluated."""
    prepared = F.from_json(F.lit(json.dumps([_prepared(i, r) for i, r in enumerate(rules)])), _PREPARED)
    conditions = any(r.conditions for r in rules)
    if conditions and "metadata" not in df.columns:
        raise ValueError("rules with conditions need a metadata column")
    texts = [F.col(f) for f in _FIELDS] + ([F.array_join(F.map_values("metadata"), "\0")] if conditions else [])
    found = candidate_rules(F.lower(F.concat_ws("\0", *texts)), rules)
    holds = (lambda r: _fields_hold(r) & _conditions_hold(r)) if conditions else _fields_hold
    return once(F.filter(F.transform(found, lambda i: F.get(prepared, i)), holds))


def match_rules(df: DataFrame, rules: list, out: str = "rule_matches") -> DataFrame:
    """``pattern_rules`` for any number of rules: the same matches, found through the index."""
    kept = [r for r in rules if r.rule_type == "pattern"]
    if not kept:
        return df.withColumn(out, F.array().cast(f"array<{MATCH}>"))
    hits = F.transform(matched_rules(df, kept), lambda r: F.struct(
        r["rule_code"].alias("rule_code"), r["rule_name"].alias("rule_name"), r["severity"].alias("severity"), r["risk_score"].alias("risk_score"),
        F.concat(F.lit("Log matched pattern rule: "), r["rule_name"]).alias("reason"),
    ))
    return df.withColumn(out, hits.cast(f"array<{MATCH}>"))


def rule_theta_join(df: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """One row per (event, matching rule) for a table of rules of any size; broken patterns match nothing."""
    kept = [r for r in load_rules(rules) if r.rule_type == "pattern"]
    hits = matched_rules(df, kept) if kept else F.array().cast(_PREPARED)
    rows = df.select(id_col, F.explode(hits).alias("_r"))
    return rows.select(
        id_col, F.col("_r.rule_code").alias("rule_code"), F.col("_r.rule_name").alias("rule_name"), F.col("_r.severity").alias("rule_severity"),
        F.col("_r.risk_score").alias("risk_score"),
    )


def max_rule_risk(matches: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(matches, lambda m: m["risk_score"])), F.lit(0))
