"""What keeps jobs bounded when their tables grow."""

import json
import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from vigil.operators import decode, formats, kernels, notify, rule_index, rules
from vigil.plans import pipeline
from vigil.streaming import keyed


def test_recipients_meet_notifications_without_a_shuffle_of_them(spark):
    rows = [(i, ["analyst", "lead", "nobody", None][i % 4]) for i in range(40)]
    names = [(f"n{i}", "analyst", i % 5 != 0) for i in range(3000)] + [(None, "lead", True), ("x", "lead", True), ("x", "lead", True), ("y", "nobody", False)]
    df = spark.createDataFrame(rows, "event_id long, initial_role string")
    recipients = spark.createDataFrame(names, "recipient_name string, role string, is_active boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = notify.expand_recipients(df, recipients)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    by_role = {}
    for name, role, active in names:
        if active:
            by_role.setdefault(role, []).append(name)
    want = Counter((i, n, "queued" if n else "No active recipients") for i, role in rows for n in by_role.get(role, [None]))
    assert Counter((r.event_id, r.recipient_name, r.delivery_status) for r in out.collect()) == want
    assert out.columns == ["initial_role", "event_id", "recipient_name", "delivery_status"]


def test_a_crowded_role_is_a_product_of_its_notifications_and_recipients(spark, monkeypatch):
    """Rows of a role with many recipients are put together in a product, in parts that a task holds; roles beyond the few that give most rows go by lists."""
    monkeypatch.setattr(notify, "CROSSED", 1000, raising=False)
    monkeypatch.setattr(notify, "CROSSED_ROLES", 2, raising=False)
    roles = ["a", "b", "c", "few", "nobody", None, "it's"]
    names = [(f"n{i}", r, True) for r, n in [("a", 2500), ("b", 1500), ("c", 1100), ("few", 3), (None, 2000), ("unasked", 3000)] for i in range(n)]
    names += [(None, "a", True), ("n1", "a", True), ("off", "a", False), ("x", "nobody", False), ("y", "it's", True), ("z", "few", None)]
    rows = [(i, roles[i % len(roles)], i * 10) for i in range(21)]
    df = spark.createDataFrame(rows, "event_id long, initial_role string, t long")
    recipients = spark.createDataFrame(names, "recipient_name string, role string, is_active boolean")
    out = notify.expand_recipients(df, recipients)
    plan = out.select("event_id", "recipient_name", "delivery_status")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") == 2 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    by_role = {}
    for name, role, active in names:
        if active and role is not None:
            by_role.setdefault(role, []).append(name)
    want = Counter((role, i, t, n, "queued" if n else "No active recipients") for i, role, t in rows for n in by_role.get(role, [None]))
    assert Counter(map(tuple, out.collect())) == want
    assert out.columns == ["initial_role", "event_id", "t", "recipient_name", "delivery_status"]


class _Map:
    """A map state that notes how many rows a value has held at most."""

    def __init__(self):
        self.kept, self.most = {}, 0

    def containsKey(self, key):
        return key in self.kept

    def getValue(self, key):
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.kept[key] = value
        if isinstance(value[0], str):
            self.most = max(self.most, len(json.loads(value[0])))

    def removeKey(self, key):
        del self.kept[key]

    def keys(self):
        return iter(list(self.kept))

    def clear(self):
        self.kept.clear()


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Map())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, _Value())

    def registerTimer(self, at):
        pass

    def deleteTimer(self, at):
        pass


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_busy_key_is_told_slot_by_slot(monkeypatch):
    """Rows of one key over 100 slots in several batches: no more than a slot of them is given out, or parsed, at once."""
    monkeypatch.setattr(keyed, "HELD", 500, raising=False)
    spec = {"width": 10_000, "sums": ["n"], "spans": ["x"], "distinct": ["host"]}
    windows = keyed.Windows({"d": spec}, 1_000_000)
    windows.init(_Handle())
    rnd = random.Random(5)
    times = [rnd.randrange(1, 100_000_000) for _ in range(5000)]

    def body(i, t):
        return json.dumps({"q": True, "keep": {"id": i}, "s": [1], "p": [i % 2 == 0], "d": [[f"h{i % 3}"]]})

    rows = [(t, body(i, t)) for i, t in enumerate(times)]
    batches = [pd.DataFrame(rows[i : i + 1000], columns=["t", "body"]) for i in range(0, 5000, 1000)]
    assert not list(windows.handleInputRows(("d", "k", ""), iter(batches), _Clock(0)))
    out = list(windows.handleExpiredTimer(("d", "k", ""), _Clock(50_000), None))  # a slot is cut by this watermark
    out += list(windows.handleExpiredTimer(("d", "k", ""), _Clock(50_500), None))
    out += list(windows.handleExpiredTimer(("d", "k", ""), _Clock(200_000), None))
    assert max(map(len, out)) < 200 and sum(map(len, out)) == 5000
    got = {json.loads(r.keep)["id"]: json.loads(r.found) for pdf in out for r in pdf.itertuples()}
    for i, t in enumerate(times):
        inside = [j for j, u in enumerate(times) if t - 10_000 <= u <= t]
        marked = [times[j] for j in inside if j % 2 == 0]
        assert got[i] == {"n": len(inside), "host": len({j % 3 for j in inside}), "x_first": min(marked, default=None), "x_last": max(marked, default=None)}
    states = windows.handle.states
    assert not states["waiting"].kept and not states["window"].kept and states["waiting"].most < 200


def test_rules_that_share_a_literal_are_told_apart_by_their_others(spark):
    """A thousand rules on three words: an event is tried with the few whose other literals it holds, and with none that can't hold."""
    given = [Row(rule_code=str(i), rule_name="r", rule_type="pattern", severity="high", source_type="nginx" if i % 2 else None, event_type_pattern=None,
                 message_pattern=[f"/(?P<w>user) {i}$/i", f"/^(query|get).* {i}\\b/i", f"/page ({i}/", f"page {i}"][i % 4],
                 threshold_count=None, threshold_minutes=None, risk_score=1, conditions=None) for i in range(1000)]
    always, _, _ = rule_index.candidates(given)
    assert not always
    rows = [(i, ["nginx", "auth"][i % 2], "t", f"{['GET page', 'query: x', 'USER', 'user', 'get'][i % 5]} {i % 1000}") for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, source string, event_type string, message string")
    tried = rule_index.candidate_rules(F.lower(F.concat_ws("\0", "source", "event_type", "message")), given)
    assert df.select(F.max(F.size(tried))).first()[0] < 12
    got = {r.event_id: [m.rule_code for m in r.rule_matches] for r in rules.match_rules(df, given).collect()}
    for i, source, _, message in rows:
        want = []
        for k, r in enumerate(given):
            text = r.message_pattern
            hit = k % 4 != 2 and (text in message.lower() if k % 4 == 3 else re.search(text[1 : text.rfind("/")], message, re.I) is not None)
            if hit and (r.source_type is None or r.source_type in source):
                want.append(r.rule_code)
        assert got[i] == want, message


def test_decoder_batches_are_bounded(spark):
    """No batch that reaches Python holds more than a bounded number of texts, however many rows a task reads."""
    size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
    df = decode.decode_payloads(spark.range(0, 20_000, 1, 1).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")), "text")
    assert df.select(size("decoded").alias("n")).agg(F.max("n")).first()[0] <= 500
    assert df.where("decoded != text").count() == 0 and df.count() == 20_000


def test_more_rows_make_more_partitions_of_windows(spark, monkeypatch):
    """Few keys and many rows: tasks of the window pass hold a bounded number of rows, and the windows are the same."""
    rows = spark.range(0, 20_000, 1, 4).select((F.col("id") % 2).cast("string").alias("key"), (F.xxhash64("id") % 500_000).alias("t"), F.col("id").alias("n"))

    def windows():
        return kernels.trailing_window(rows, {"key": F.col("key")}, F.col("t"), 10_000, F.lit(True), keep={"id": F.col("n")}, sums={"many": F.lit(1)},
                                       spans={"x": F.col("n") % 3 == 0}, distinct={"v": F.array((F.col("n") % 5).cast("string"))})

    few = windows()
    want = {tuple(r) for r in few.collect()}
    monkeypatch.setattr(kernels, "SHARE", 500, raising=False)
    more = windows()
    got = more.withColumn("p", F.spark_partition_id())
    assert got.groupBy("p").count().agg(F.max("count")).first()[0] < 3000 and got.select("p").distinct().count() > 20
    assert {tuple(r) for r in more.collect()} == want and len(want) == 20_000


def test_the_time_of_a_csv_line_is_read_once(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.5,EDR,Bad File,High,\"a, b\"",), ("2024-13-02,a,b,c",), ("2024-01-02,x",)], "line string")
    out = formats.detect_format(df, "line", 2024)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # one step of reading a time that stands nowhere else
    assert plan.count(r"^(\d{4}-\d{2}-\d{2})[T ]") <= 3
    got = [(r.detected_format, r.parsed and (r.parsed.timestamp, r.parsed.message)) for r in out.collect()]
    assert got == [("csv", ("2024-01-02T03:04:05.500000+00:00", "a, b")), ("text", None), ("text", None)]


def test_the_path_validates_and_normalizes_a_row_once(spark, monkeypatch):
    """Quarantine reads what validation has written, and what follows duplicate removal reads normalized rows: no text is parsed for each reader."""
    plans, write = {}, pipeline.written

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(pipeline, "written", noted)
    texts = [
        '{"source":"a","event_type":"x","message":"m","record_number":7}', '{"source":"a","event_type":"x","message":"n","record_number":7}',
        '{"source":"a","event_type":"malware.found","message":"m"}', '{"message":"no type"}', '{"message":"no type"}', "{", None,
    ]
    raw = spark.createDataFrame(list(enumerate(texts)), "event_id long, raw string").selectExpr("event_id", "timestamp_micros(event_id) as received", "raw")
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        out = pipeline.run(raw, rules.default_rules(spark), notify.default_policies(spark), 2024)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
    files = out.quarantine.inputFiles()
    assert files and all("/validated-" in f for f in files)
    assert "from_json" not in plans["events"]
    held = {(r.raw_payload, r.quarantined_count, r.rejection_reason) for r in out.quarantine.collect()}
    # a text that is no JSON has no fields, so its hash is that of the missing one
    assert held == {('{"message":"no type"}', 2, "Missing required event_type"), ("{", 2, "Malformed JSON payload")}
    assert sorted((r.event_id, r.message) for r in out.events.collect()) == [(0, "m"), (2, "m")]
    assert [(r.event_id, r.occurrence_count) for r in out.alerts.collect()] == [(2, 1)]


def test_threshold_rules_try_an_event_once(spark):
    """The windows read an event several times; its texts go to Python before, not in each of these reads."""
    rows = [(i, i * 1_000_000, "auth", "login.failure", "m") for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, t long, source string, event_type string, message string")
    hits = rules.threshold_rules(df, rules.load_rules(rules.default_rules(spark)), "event_id", "t")
    assert "Python" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.event_id, r.matching) for r in hits.collect()) == [(2, 3), (3, 4), (4, 5), (5, 6)]
