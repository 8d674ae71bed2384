"""Rules in any number: the index finds what the compiled expressions find, and bad rules match nothing."""

import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vigil.operators import rule_index, rules

EVENT = "event_id bigint, t bigint, source string, event_type string, message string, metadata map<string,string>"


def rule(code, **given):
    base = dict(rule_code=code, rule_name=code.lower(), rule_type="pattern", severity="high", source_type=None, event_type_pattern=None,
                message_pattern=None, threshold_count=None, threshold_minutes=None, risk_score=50, conditions=None)
    return Row(**{**base, **given})


def condition(field, op, *values):
    return [Row(field=field, op=op, values=list(values))]


WORDS = ["select", "union", "passwd", "Admin", "login", "failed", "exec", "bash", "été", "K", "x", "404", "İstanbul", "ſet"]


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(31)
    rows = [(i, i, rnd.choice(["nginx", "auth-svc", None]), rnd.choice(["login.failed", "http.get", "", None]),
             rnd.choice([None, "", " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 8)))]),
             rnd.choice([None, {}, {"uri": rnd.choice(["/a/../b", "/login?x=1", "/Admin"]), "code": rnd.choice(["401", "200"])}])) for i in range(400)]
    return spark.createDataFrame(rows, EVENT)


def many():
    rnd = random.Random(32)
    out = []
    for i in range(150):
        a, b = rnd.choice(WORDS), rnd.choice(WORDS)
        pattern = rnd.choice([a, f"{a} {b}", f"/{a}.*{b}/", f"/{a}.*{b}/i", f"/({a}|{b}) x/i", f"/(?P<w>{a})+/", f"/[a-z]{{3}} {b}$/", f"/^{a}?{b}/i", "/(/", f"/{a}(?=x)/", "x", f"/(?:{a}){{0,2}}/"])
        out.append(rule(f"R{i}", message_pattern=pattern, source_type=rnd.choice([None, "nginx", "AUTH", "/^auth/"]),
                        event_type_pattern=rnd.choice([None, None, "login", "/HTTP/i"])))
    out += [rule("C1", conditions=condition("uri", "contains_any", "ADMIN", "login")), rule("C2", conditions=condition("uri", "regex", "^/a/(?P<up>\\.\\.)")),
            rule("C3", conditions=condition("code", "eq", "401")), rule("C4", conditions=condition("uri", "startswith_any", "/ADMIN")),
            rule("C5", conditions=condition("uri", "like", "/")), rule("C6", conditions=condition("none", "eq", "x")),
            rule("C7", conditions=condition("uri", "regex_any", "(", "/a")), rule("E"), rule("S", source_type="nginx")]
    return out


def test_the_index_finds_what_the_expressions_find(spark, events):
    got = {r.event_id: r.rule_matches for r in rules.match_rules(events, many()).collect()}
    want = {r.event_id: r.rule_matches for r in rules.pattern_rules(events, many()).collect()}
    assert got == want and sum(map(len, want.values())) > 1000


def test_needed_literals_are_needed():
    rnd = random.Random(33)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(5)) for _ in range(300)]
    patterns = [r.message_pattern.strip("/i").strip("/") for r in many() if r.message_pattern and r.message_pattern.startswith("/")]
    for p in [*patterns, "(?:select|union)+ (?:passwd|exec)", "a*", "(?i)SELECT.+FROM", "sel(ect|f)", "(?>exec)bash", "x{2,}login", "[0-9]+", "(a|)login"]:
        found = rule_index.needed(p)
        try:
            regex = re.compile(p, re.IGNORECASE)
        except re.error:
            assert found is None
            continue
        for text in texts:
            if found and regex.search(text):
                assert any(x in text.lower() for x in found), (p, text, found)
    assert rule_index.needed("(?i)SELECT.+FROM") == ["select"] and rule_index.needed("[a-z]+") is None


def test_patterns_of_python_run_in_java_or_match_nothing(spark):
    df = spark.createDataFrame([("user 7",), ("user 7\n",)], "m string")
    holds = lambda p: [r[0] for r in df.select(rules.match_field(F.col("m"), p)).collect()]
    assert holds("/(?P<who>user) 7/") == [True, True]
    assert holds("/user 7\\Z/") == [True, False]
    for broken in ("/(/", "/(?<n>user)/", "/(?P<a>u)(?P=a)/", "/user++++/", "/\\p{L}/"):
        assert holds(broken) == [False, False], broken


def test_threshold_hits_keep_the_order_of_the_rules(spark):
    rows = [(i, i, "auth", "login", "m", {}) for i in range(4)]
    df = spark.createDataFrame(rows, EVENT)
    given = [rule("Z", rule_type="threshold", source_type="auth", threshold_count=2, threshold_minutes=1),
             rule("A", rule_type="threshold", source_type="auth", threshold_count=3, threshold_minutes=9),
             rule("M", rule_type="threshold", event_type_pattern="/(/", threshold_count=1, threshold_minutes=1)]
    matched = rules.match_rules(df, [rule("P", message_pattern="m", source_type="auth")])
    out = rules.with_threshold_matches(matched, rules.threshold_rules(df, given, "event_id", "t"), "event_id")
    got = {r.event_id: [m.rule_code for m in r.rule_matches] for r in out.collect()}
    assert got == {0: ["P"], 1: ["P", "Z"], 2: ["P", "Z", "A"], 3: ["P", "Z", "A"]}


def test_a_rule_by_its_code(spark):
    assert [r.rule_code for r in rules.rule_by_code(rules.default_rules(spark), "SQL_INJECTION").collect()] == ["SQL_INJECTION"]
