import base64
import gzip
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from vigil.operators import formats, weblog
from vigil.operators.decode import decode_base64, decode_hex, decode_payloads, decode_url

XML = """<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System>
<Provider Name="Volume Watch"/><EventID>310</EventID><Level>2</Level>
<TimeCreated SystemTime="2026-02-03T04:05:06Z"/><Channel>Storage</Channel><Computer>ARCHIVE-9</Computer></System>
<EventData><Data Name="Volume">D:</Data><Data>nearly full</Data><Data Name="Owner"/></EventData></Event>"""

CASES = [
    ("xml", XML, "windows_xml", dict(source="Volume Watch", host="ARCHIVE-9", event_type="windows_event_310",
     severity="high", message="Windows Event 310 [Volume Watch]: Volume=D: | field_1=nearly full | Owner=")),
    ("bad xml", "<Event><System>", "text", {}),
    ("cef", "cef:1|Harbor Works|Gate|2.4|door 7|Door held open|9|rt=1767225600000 duser=mira sourceAddress=198.51.100.23 cs1=zone four",
     "cef", dict(severity="critical", source_ip="198.51.100.23", user="mira", source="cef-harbor-works-gate",
                 event_type="cef_door_7", message="Door held open", timestamp="2026-01-01T00:00:00+00:00")),
    ("cef separator", "CEF:0|Harbor\u001fWorks|Gate|2.4|door|Door\u001fopen|2|cs1=x", "cef",
     dict(severity="low", message="Door\u001fopen", event_type="cef_door")),
    ("cef lines", "CEF:0|Harbor|Gate|2|door|Door open|2|no pairs\nhere", "text", {}),
    ("leef", "LEEF:1.0|Kite Labs|Mailgate|5.1|Quarantined|startTime=2026-02-03T04:05:06Z\tsrcip=198.51.100.7\tsuser=noa\tseverity=5",
     "leef", dict(event_type="leef_quarantined", severity="medium", source_ip="198.51.100.7", user="noa",
                  source="leef-kite-labs-mailgate")),
    ("leef spaces", "LEEF:1.0|Kite Labs|Mailgate|5.1|Bounce|sourceip=198.51.100.8 severity=HIGH", "leef",
     dict(severity="high", source_ip="198.51.100.8")),
    ("container json", '{"time":"2026-02-03T04:05:06Z","stream":"stderr","log":" worker 3 restarted "}', "json",
     dict(source="docker-stderr", event_type="docker_log", message="worker 3 restarted")),
    ("json", '{"user":"noa","source_ip":"198.51.100.9","event_type":"badge.read"}', "json",
     dict(event_type="badge.read", user="noa", source_ip="198.51.100.9")),
    ("json array", '["a", 2]', "text", {}),
    ("3164", "<13>Feb  3 04:05:06 printer-2 spooler[77]: tray two is empty", "syslog",
     dict(source="spooler", host="printer-2", severity="low", timestamp="2026-02-03T04:05:06+00:00",
          message="tray two is empty")),
    ("5424", '<11>1 2026-02-03T04:05:06Z cam-4.site.example recorder 9 - [clip@1 length="12"] motion in yard', "syslog",
     dict(source="recorder", host="cam-4.site.example", event_type="syslog_event", severity="high", message="motion in yard")),
    ("web", '198.51.100.30 - - [03/Feb/2026:04:05:06 +0200] "PUT /files/7 HTTP/2.0" 503 0', "web",
     dict(source_ip="198.51.100.30", user=None, severity="high", event_type="http_put",
          message="PUT /files/7 -> 503", timestamp="2026-02-03T02:05:06+00:00")),
    ("kv", "device=lift-2 type=overload level=medium username=noa srcip=198.51.100.31 reason=weight above the limit",
     "key_value", dict(source="lift-2", event_type="overload", severity="medium", user="noa", source_ip="198.51.100.31",
                       message="weight above the limit")),
    ("kv quoted", 'alert="door forced" facility=\'north gate\' category=entry', "key_value",
     dict(event_type="kv_event", source="north gate", message="door forced")),
    ("csv", '2026-02-03T04:05:06Z,Badge Reader,Card Refused,MEDIUM,"Card 12, expired"', "csv",
     dict(source="Badge Reader", event_type="card_refused", severity="medium", message="Card 12, expired",
          timestamp="2026-02-03T04:05:06+00:00")),
    ("prose", "This door, that gate, one fence, no key", "text", {}),
    ("plain", "quiet night", "text", {}),
]


def test_formats(spark):
    df = spark.createDataFrame([(n, t) for n, t, _, _ in CASES], "name string, message string")
    rows = {r.name: r for r in formats.parse_logs(df, year=2026).collect()}
    for name, _, fmt, want in CASES:
        assert rows[name].detected_format == fmt, name
        for field, value in want.items():
            assert rows[name].parsed[field] == value, (name, field)


def test_decoding_chain(spark):
    plain = "Gate four was opened by hand at night"
    b64 = base64.b64encode(plain.encode()).decode()
    cases = [
        (plain, plain, []),
        (b64, plain, ["base64"]),
        (plain.encode().hex(), plain, ["hex"]),
        ("shelf%209%20of%20row%3A%203+4", "shelf 9 of row: 3+4", ["url"]),
        (quote(base64.b64encode(b"subjects?>>").decode(), safe=""), "subjects?>>", ["url", "base64"]),
        (base64.b64encode(gzip.compress(plain.encode())).decode(), plain, ["gzip"]),
        (gzip.compress(plain.encode()).hex(), plain, ["gzip"]),
        (r"tab\there", "tab\there", ["escaped"]),
        ("snow " + chr(92) + "u2603", "snow " + chr(0x2603), ["unicode_escape"]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    for r in decode_payloads(df, "t").collect():
        assert (r.decoded, r.decoding_chain) == cases[r.i][1:], cases[r.i]


def test_single_decoders(spark):
    df = spark.createDataFrame([("a%20b+c%zz",), ("aGVsbG8",), ("68656c6c6f",), ("te$t",)], "t string")
    c = F.col("t")
    got = df.select(decode_url(c), decode_base64(c), decode_hex(c)).collect()
    assert got[0][0] == "a%20b+c%zz" and got[1][1] == "hello" and got[2][2] == "hello"
    assert got[3][1] is None and got[3][2] is None


ACCESS = [
    ('198.51.100.40 - mira [03/Feb/2026:04:05:06 +0100] "HEAD /shelf/9?lang=fr HTTP/1.1" 304 0 "-" "reader/2.1"',
     dict(http_method="HEAD", request_uri="/shelf/9", query_string="lang=fr", upstream_port=None, application="LoginApp")),
    ('198.51.100.41 - - [03/Feb/2026:04:06:00 +0100] "PATCH /cart/5 HTTP/1.1" 409 77 "https://shop.example/cart" '
     '"reader/2.1" "cart.example" "127.0.0.1:8081" "1.250" "r-15"',
     dict(upstream_port="8081", host="cart.example", response_time="1.250", request_id="r-15", application="LoginApp2")),
    ('{"client":"198.51.100.42","request":"OPTIONS /cart HTTP/1.1","status_code":200,"upstream":"127.0.0.1:8082",'
     '"timestamp":"2026-02-03T04:07:00Z"}', dict(http_method="OPTIONS", status_code="200", upstream_port="8082",
                                                 application="LoginApp3")),
    ('{"client":"198.51.100.42","upstream":"127.0.0.1:9100"}', None),
    ("no layout at all", None),
]


def test_access_log(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ACCESS)], "i int, line string")
    rows = {r.i: r for r in weblog.assign_application(weblog.parse_access_log(df)).collect()}
    for i, (_, want) in enumerate(ACCESS):
        if want is None:
            assert i not in rows
        else:
            for k, v in want.items():
                assert rows[i][k] == v, (i, k, rows[i])


def test_error_log(spark):
    line = ('2026/02/03 04:05:06 [warn] 88#3: *41 short header while reading (2 of 9 bytes), client: 198.51.100.43, '
            'server: cart.example, request: "POST /pay HTTP/1.1", upstream: "http://127.0.0.1:8082/pay", host: "www.cart.example"')
    r = weblog.parse_error_log(spark.createDataFrame([(line,)], "line string")).first()
    assert (r.error_level, r.pid, r.connection_id, r.client_ip, r.upstream_port, r.server_name, r.host) == (
        "warn", "88", "41", "198.51.100.43", "8082", "cart.example", "www.cart.example")
    assert (r.http_method, r.request_uri) == ("POST", "/pay")
    assert r.message == "short header while reading (2 of 9 bytes)"


@pytest.mark.parametrize("text,want", [
    ("2026-06-05T10:25:00Z", "2026-06-05 10:25:00"), ("2026-06-05 10:25", "2026-06-05 10:25:00"),
    ("2026-06-05", "2026-06-05 00:00:00"), ("20260605", "2026-06-05 00:00:00"),
    ("20260605T102500+0200", "2026-06-05 08:25:00"), ("2026-06-05T10:25:00.5+05:30", "2026-06-05 04:55:00.5"),
    ("1704067200", "2024-01-01 00:00:00"), ("2026", "1970-01-01 00:33:46"), ("not-a-timestamp", None), ("", None),
    ("2026-13-45", None), ("2026-06-05T10", "2026-06-05 10:00:00"),
])
def test_event_time(spark, text, want):
    from vigil.functions.exprs import event_time
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(event_time(F.col("t")).cast("string").alias("x")).first().x
    assert got == want


def test_is_ip(spark):
    import ipaddress
    from vigil.functions.exprs import is_ip
    texts = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::1", "fe80::1%eth0", "2001:db8::8a2e:370:7334", "1::2::3",
             "::ffff:10.0.0.1", "g::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::", ":::", "", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def ok(t):
        try:
            ipaddress.ip_address(t)
            return True
        except ValueError:
            return False
    assert {r.t: r.v for r in df.select("t", is_ip(F.col("t")).alias("v")).collect()} == {t: ok(t) for t in texts}


def test_long_lines_do_not_overflow(spark):
    words = "word " * 60000
    texts = [f"src=1.2.3.4 msg={words}user=bob", 'event=x msg="' + "a " * 60000 + '" user=bob',
             '2026-06-05T10:00:00Z,a,b,low,"' + "x, " * 50000 + '"', words]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, message string")
    rows = {r.i: r for r in formats.detect_format(df, "message", 2026).collect()}
    assert [rows[i].detected_format for i in range(4)] == ["key_value", "key_value", "csv", "text"]
    assert rows[0].parsed.user == rows[1].parsed.user == "bob"
    assert len(rows[2].parsed.message) == 3 * 50000 - 1
