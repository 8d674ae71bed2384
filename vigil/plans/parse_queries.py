"""Decoding, format parsing, classification. Lines are built from the events and parsed back."""

from __future__ import annotations

import base64
import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.exprs import event_time, micros
from vigil.operators import decode as D
from vigil.operators import formats, weblog
from vigil.operators.classify import classify_log_type, windows_subtype
from vigil.plans.adapters import oracle
from vigil.plans.registry import query
from vigil.sources.collectors import transition_name, webkit_time

YEAR = 2024

# line text per format, valid in both engines
CEF = ("'CEF:0|Acme Corp|Web FW|1.0|' || CAST(k AS STRING) || '|Rule ' || raw_type || '|' || CAST(k % 11 AS STRING) || "
       "'|src=10.0.0.' || CAST(user_id % 5 AS STRING) || ' suser=user' || CAST(user_id AS STRING) || ' msg=two words act=x rt=' "
       "|| CAST(CAST(floor(t / 1000) AS BIGINT) AS STRING)")
LEEF = ("'LEEF:2.0|Vend|Prod|7|Ev ' || raw_type || '|src=10.1.0.' || CAST(user_id % 5 AS STRING) || chr(9) || 'usrName=u' || "
        "CAST(user_id AS STRING) || chr(9) || 'sev=' || CAST(k % 10 AS STRING) || chr(9) || 'devTime=' || iso")
SYSLOG_NEW = ("'<' || CAST(k AS STRING) || '>1 ' || iso || 'Z host' || CAST(k % 4 AS STRING) || ' app' || CAST(k % 3 AS STRING) || "
              "' 77 ID' || CAST(k AS STRING) || ' - Message ' || raw_type")
SYSLOG_OLD = ("'<' || CAST(k AS STRING) || '>' || bsd || ' host' || CAST(k % 4 AS STRING) || ' sshd[' || CAST(user_id AS STRING) || "
              "']: Failed for ' || raw_type")
WEB = ("'10.0.0.' || CAST(user_id % 5 AS STRING) || ' - ' || CASE WHEN k % 2 = 0 THEN '-' ELSE 'bob' END || ' [' || clf || ' +0000] \"GET /p' "
       "|| CAST(k AS STRING) || '?a=1 HTTP/1.1\" ' || CAST(200 + (k % 4) * 100 AS STRING) || ' 55 \"-\" \"UA ' || raw_type || '\"'")
KV = ("'src=10.0.0.' || CAST(user_id % 5 AS STRING) || ' action=' || raw_type || ' user=u' || CAST(user_id AS STRING) || "
      "' msg=some longer text ' || CAST(k AS STRING) || ' severity=' || CASE WHEN k % 2 = 0 THEN 'HIGH' ELSE 'odd' END")
CSV = ("iso || ',EDR,' || CASE WHEN k % 2 = 0 THEN 'Bad File' ELSE 'scan' END || ',Critical,\"a, b ' || CAST(k AS STRING) || '\"'")
JSON = ("'{\"event_type\":\"' || raw_type || '\",\"severity\":\"high\",\"source_ip\":\"10.0.0.1\",\"n\":' || CAST(k AS STRING) || '}'")
CONTAINER = ("'{\"log\":\"line ' || CAST(k AS STRING) || ' \",\"stream\":\"' || CASE WHEN k % 2 = 0 THEN 'stdout' ELSE 'stderr' END || "
             "'\",\"time\":\"' || iso || 'Z\"}'")
XML = ("'<Event xmlns=\"http://schemas.microsoft.com/win/2004/08/events/event\"><System><Provider Name=\"Prov' || CAST(k % 3 AS STRING) || "
       "'\"/><EventID>' || CAST(4600 + k AS STRING) || '</EventID><Level>' || CAST(k % 6 AS STRING) || '</Level><Channel>Security</Channel>"
       "<Computer>PC' || CAST(k % 5 AS STRING) || '</Computer></System><EventData><Data Name=\"A\">' || raw_type || "
       "'</Data><Data Name=\"B\">x</Data></EventData></Event>'")
KINDS = [XML, CEF, LEEF, JSON, CONTAINER, SYSLOG_NEW, SYSLOG_OLD, WEB, KV, CSV, "'plain words ' || raw_type"]
MIXED = "CASE k % 11 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(KINDS[:-1])) + f" ELSE {KINDS[-1]} END"
FORMATS = "(['windows_xml','cef','leef','json','json','syslog','syslog','web','key_value','csv','text'])[k % 11 + 1]"


def lines(t, expression):
    return t.snapshot.select("event_id", F.expr(expression).alias("line"))


def parsed(t, expression):
    return formats.detect_format(lines(t, expression), "line", YEAR)


def standard(df, *names):
    return df.select("event_id", "detected_format", *[F.col(f"parsed.{n}").alias({"user": "user_name"}.get(n, n)) for n in names])


@query("decode_chain", "SELECT doc_id, sha256(text) AS decoded_hash, 'base64' AS chain FROM documents WHERE doc_id % 3 = 0 "
       "AND NOT regexp_matches(text, '[%\\\\]') AND length(trim(text)) > 3 AND NOT regexp_matches(trim(text), '^[A-Za-z0-9+/=\\s]+$') "
       "UNION ALL SELECT doc_id, sha256('plain ' || lang || ':' || source), 'hex' FROM documents WHERE doc_id % 3 = 1 "
       "UNION ALL SELECT doc_id, sha256('a b ' || lang || '+'), 'url' FROM documents WHERE doc_id % 3 = 2")
def _(t):
    docs = t.table("documents")
    m = F.col("doc_id") % 3
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    simple = ~F.col("text").rlike(r"[%\\]") & (F.length(F.trim("text")) > 3) & ~F.trim("text").rlike(r"^[A-Za-z0-9+/=\s]+$")
    coded = (
        F.when((m == 0) & simple, F.base64(F.encode("text", "UTF-8")))
        .when(m == 1, F.hex(F.encode(F.concat(F.lit("plain "), "lang", F.lit(":"), "source"), "UTF-8")))
        .when(m == 2, F.concat(F.lit("a%20b%20"), "lang", F.lit("%2B")))
    )
    src = docs.select("doc_id", coded.alias("coded"), F.length(body).alias("_n")).where("coded is not null")
    out = D.decode_payloads(src, "coded")
    return out.select("doc_id", F.sha2("decoded", 256).alias("decoded_hash"), F.array_join("decoding_chain", ",").alias("chain"))


SIMPLE = ("NOT regexp_matches(text, '[%\\\\]') AND length(trim(text)) > 3 AND NOT regexp_matches(trim(text), '^[A-Za-z0-9+/=\\s]+$') "
          "AND NOT regexp_matches(text, '[^\\x20-\\x7e\\n\\x{a1}-\\x{24f}]')")


@query("decode_gzip", f"SELECT doc_id, sha256(text) AS decoded_hash, 'gzip' AS chain FROM documents WHERE {SIMPLE}")
def _(t):
    """Documents packed the way cloud agents ship them, base64 over gzip, and unpacked again."""

    @F.pandas_udf(T.StringType())
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode())

    simple = (~F.col("text").rlike(r"[%\\]") & (F.length(F.trim("text")) > 3) & ~F.trim("text").rlike(r"^[A-Za-z0-9+/=\s]+$")
              & ~F.col("text").rlike(r"[^\x20-\x7e\n\xa1-\u024f]"))
    docs = t.table("documents").where(simple).select("doc_id", pack("text").alias("packed"))
    out = D.decode_payloads(docs, "packed")
    return out.select("doc_id", F.sha2("decoded", 256).alias("decoded_hash"), F.array_join("decoding_chain", ",").alias("chain"))


@query("decode_chain_all")
def _(t):
    """Every document's whole text, by its id as base64, hex or percent signs. Texts that are themselves coded go on, which SQL can't follow."""
    m = F.pmod("doc_id", F.lit(3))
    data = F.encode("text", "UTF-8")
    coded = F.when(m == 1, F.hex(data)).when(m == 2, F.regexp_replace(F.url_encode("text"), r"\+", "%20")).otherwise(F.base64(data))
    out = D.decode_payloads(t.table("documents").select("doc_id", coded.alias("coded")), "coded")
    return out.select("doc_id", F.sha2("decoded", 256).alias("decoded_hash"), F.array_join("decoding_chain", ",").alias("chain"))


@query("decode_gzip_all")
def _(t):
    """As ``decode_gzip``, with every text."""

    @F.pandas_udf(T.StringType())
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode() if x is not None else None)

    out = D.decode_payloads(t.table("documents").select("doc_id", pack("text").alias("packed")), "packed")
    return out.select("doc_id", F.sha2("decoded", 256).alias("decoded_hash"), F.array_join("decoding_chain", ",").alias("chain"))


@query("decode_documents", "SELECT doc_id, '' AS chain, length(text) AS n_decoded FROM documents")
def _(t):
    """Documents as they are: which layers does the chain driver find in whole texts."""
    out = D.decode_payloads(t.table("documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.array_join("decoding_chain", ",").alias("chain"), F.length("decoded").alias("n_decoded"))


@query("decode_url", "SELECT page_id, url AS decoded FROM pages")
def _(t):
    coded = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "/", "%2F"), "&", "%26")
    return t.table("pages").select("page_id", D.decode_url(coded).alias("decoded"))


@query("decode_base64", "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN NULL ELSE sha256(text) END AS h "
       "FROM documents WHERE length(text) > 3")
def _(t):
    coded = F.base64(F.encode("text", "UTF-8"))
    return t.table("documents").where(F.length("text") > 3).select("doc_id", F.sha2(D.decode_base64(coded), 256).alias("h"))


@query("decode_hex", "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN NULL ELSE sha256(text) END AS h "
       "FROM documents WHERE length(text) > 3")
def _(t):
    return t.table("documents").where(F.length("text") > 3).select(
        "doc_id", F.sha2(D.decode_hex(F.hex(F.encode("text", "UTF-8"))), 256).alias("h"))


@query("decode_base64_all", "SELECT doc_id, CASE WHEN strlen(text) < 1 OR regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN NULL "
       "ELSE sha256(text) END AS h FROM documents")
def _(t):
    coded = F.base64(F.encode("text", "UTF-8"))
    return t.table("documents").select("doc_id", F.sha2(D.decode_base64(coded), 256).alias("h"))


@query("decode_hex_all", "SELECT doc_id, CASE WHEN strlen(text) < 2 OR regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN NULL "
       "ELSE sha256(text) END AS h FROM documents")
def _(t):
    return t.table("documents").select("doc_id", F.sha2(D.decode_hex(F.hex(F.encode("text", "UTF-8"))), 256).alias("h"))


@query("detect_format", oracle(f"""SELECT event_id, {FORMATS} AS detected_format,
  ([0.95, 1.0, 1.0, 0.9, 0.95, 0.95, 0.95, 0.95, 0.7, 0.6, 0.3])[k % 11 + 1]::DOUBLE AS parsing_confidence FROM snap"""))
def _(t):
    return parsed(t, MIXED).select("event_id", "detected_format", "parsing_confidence")


@query("parse_windows_xml", oracle("""SELECT event_id, 'windows_xml' AS detected_format, 'Prov' || CAST(k % 3 AS VARCHAR) AS source,
  'PC' || CAST(k % 5 AS VARCHAR) AS host, 'windows_event_' || CAST(4600 + k AS VARCHAR) AS event_type,
  'Windows Event ' || CAST(4600 + k AS VARCHAR) || ' [Prov' || CAST(k % 3 AS VARCHAR) || ']: A=' || raw_type || ' | B=x' AS message,
  CASE k % 6 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS severity FROM snap"""))
def _(t):
    return standard(parsed(t, XML), "source", "host", "event_type", "message", "severity")


@query("parse_cef", oracle("""SELECT event_id, 'cef' AS detected_format, 'cef-acme-corp-web-fw' AS source, 'cef_' || CAST(k AS VARCHAR) AS event_type,
  'Rule ' || raw_type AS message, CASE WHEN k % 11 <= 3 THEN 'low' WHEN k % 11 <= 6 THEN 'medium' WHEN k % 11 <= 8 THEN 'high'
  ELSE 'critical' END AS severity, '10.0.0.' || CAST(user_id % 5 AS VARCHAR) AS source_ip, 'user' || CAST(user_id AS VARCHAR) AS user_name,
  CAST(floor(t / 1000) AS BIGINT) * 1000 AS t FROM snap"""))
def _(t):
    out = standard(parsed(t, CEF), "source", "event_type", "message", "severity", "source_ip", "user", "timestamp")
    return out.withColumn("t", micros(event_time(F.col("timestamp")))).drop("timestamp")


@query("parse_leef", oracle("""SELECT event_id, 'leef' AS detected_format, 'leef-vend-prod' AS source, 'leef_ev_' || raw_type AS event_type,
  'LEEF event Ev ' || raw_type || ' from Vend Prod' AS message, CASE WHEN k % 10 >= 9 THEN 'critical' WHEN k % 10 >= 7 THEN 'high'
  WHEN k % 10 >= 4 THEN 'medium' ELSE 'low' END AS severity, iso AS "timestamp", '10.1.0.' || CAST(user_id % 5 AS VARCHAR) AS source_ip,
  'u' || CAST(user_id AS VARCHAR) AS user_name FROM snap"""))
def _(t):
    return standard(parsed(t, LEEF), "source", "event_type", "message", "severity", "timestamp", "source_ip", "user")


@query("parse_json", oracle("""SELECT event_id, 'json' AS detected_format, CASE WHEN k % 2 = 0 THEN NULL ELSE
  CASE WHEN k % 4 = 1 THEN 'docker-stderr' ELSE 'docker-stderr' END END AS source,
  CASE WHEN k % 2 = 0 THEN raw_type ELSE 'docker_log' END AS event_type, CASE WHEN k % 2 = 1 THEN 'line ' || CAST(k AS VARCHAR) END AS message,
  CASE WHEN k % 2 = 0 THEN 'high' END AS severity, CASE WHEN k % 2 = 1 THEN iso || 'Z' END AS "timestamp" FROM snap"""))
def _(t):
    return standard(parsed(t, f"CASE WHEN k % 2 = 0 THEN {JSON} ELSE {CONTAINER} END"), "source", "event_type", "message", "severity", "timestamp")


@query("parse_syslog5424", oracle("""SELECT event_id, 'syslog' AS detected_format, 'app' || CAST(k % 3 AS VARCHAR) AS source,
  'host' || CAST(k % 4 AS VARCHAR) AS host, 'ID' || CAST(k AS VARCHAR) AS event_type, 'Message ' || raw_type AS message, iso || 'Z' AS "timestamp",
  CASE WHEN k % 8 <= 2 THEN 'critical' WHEN k % 8 = 3 THEN 'high' WHEN k % 8 = 4 THEN 'medium' ELSE 'low' END AS severity,
  CAST(k // 8 AS VARCHAR) AS facility FROM snap"""))
def _(t):
    df = parsed(t, SYSLOG_NEW)
    return df.select("event_id", "detected_format", *[F.col(f"parsed.{n}").alias(n) for n in
                     ("source", "host", "event_type", "message", "timestamp", "severity")], F.col("parsed.extra")["facility"].alias("facility"))


@query("parse_syslog3164", oracle("""SELECT event_id, 'syslog' AS detected_format, 'sshd' AS source, 'host' || CAST(k % 4 AS VARCHAR) AS host,
  'syslog_event' AS event_type, 'Failed for ' || raw_type AS message, CASE WHEN k % 8 <= 2 THEN 'critical' WHEN k % 8 = 3 THEN 'high'
  WHEN k % 8 = 4 THEN 'medium' ELSE 'low' END AS severity, substr(iso, 1, 19) || '+00:00' AS "timestamp", CAST(user_id AS VARCHAR) AS pid FROM snap"""))
def _(t):
    df = parsed(t, SYSLOG_OLD)
    return df.select("event_id", "detected_format", *[F.col(f"parsed.{n}").alias(n) for n in
                     ("source", "host", "event_type", "message", "timestamp", "severity")], F.col("parsed.extra")["pid"].alias("pid"))


@query("parse_web", oracle("""SELECT event_id, 'web' AS detected_format, 'web-server' AS source, 'http_get' AS event_type,
  'GET /p' || CAST(k AS VARCHAR) || '?a=1 -> ' || CAST(200 + (k % 4) * 100 AS VARCHAR) AS message,
  CASE k % 4 WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, substr(iso, 1, 19) || '+00:00' AS "timestamp",
  '10.0.0.' || CAST(user_id % 5 AS VARCHAR) AS source_ip, CASE WHEN k % 2 = 1 THEN 'bob' END AS user_name FROM snap"""))
def _(t):
    return standard(parsed(t, WEB), "source", "event_type", "message", "severity", "timestamp", "source_ip", "user")


@query("parse_key_value", oracle("""SELECT event_id, 'key_value' AS detected_format, 'kv-source' AS source, raw_type AS event_type,
  'some longer text ' || CAST(k AS VARCHAR) AS message, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END AS severity,
  '10.0.0.' || CAST(user_id % 5 AS VARCHAR) AS source_ip, 'u' || CAST(user_id AS VARCHAR) AS user_name FROM snap"""))
def _(t):
    return standard(parsed(t, KV), "source", "event_type", "message", "severity", "source_ip", "user")


@query("parse_csv", oracle("""SELECT event_id, 'csv' AS detected_format, 'EDR' AS source, CASE WHEN k % 2 = 0 THEN 'bad_file' ELSE 'scan' END AS event_type,
  'a, b ' || CAST(k AS VARCHAR) AS message, 'critical' AS severity, CASE WHEN t % 1000000 = 0 THEN substr(iso, 1, 19) ELSE iso END || '+00:00' AS "timestamp" FROM snap"""))
def _(t):
    return standard(parsed(t, CSV), "source", "event_type", "message", "severity", "timestamp")


ACCESS = ("CASE k % 3 WHEN 0 THEN '10.0.0.9 - - [' || clf || ' +0000] \"GET /a' || CAST(k AS STRING) || '?q=1 HTTP/1.1\" 200 5 \"-\" \"UA\"' "
          "WHEN 1 THEN '10.0.0.8 - - [' || clf || ' +0000] \"POST /b HTTP/1.1\" 401 5 \"-\" \"UA\" \"h.example\" \"127.0.0.1:808' || "
          "CAST(k % 4 AS STRING) || '\" \"0.04\"' ELSE '{\"remote_addr\":\"10.0.0.7\",\"request\":\"DELETE /c HTTP/1.1\",\"status\":503,"
          "\"upstream_addr\":\"http://127.0.0.1:8081/\",\"host\":\"localhost\",\"time\":\"' || iso || 'Z\"}' END")
ACCESS_CTE = """access AS (SELECT event_id, k, t, CASE k % 3 WHEN 0 THEN '10.0.0.9' WHEN 1 THEN '10.0.0.8' ELSE '10.0.0.7' END AS client_ip,
  CASE k % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS http_method,
  CASE k % 3 WHEN 0 THEN '/a' || CAST(k AS VARCHAR) WHEN 1 THEN '/b' ELSE '/c' END AS request_uri,
  CASE k % 3 WHEN 0 THEN 'q=1' ELSE '' END AS query_string, CASE k % 3 WHEN 0 THEN '200' WHEN 1 THEN '401' ELSE '503' END AS status_code,
  CASE k % 3 WHEN 1 THEN 'h.example' WHEN 2 THEN 'localhost' END AS host,
  CASE k % 3 WHEN 1 THEN '808' || CAST(k % 4 AS VARCHAR) WHEN 2 THEN '8081' END AS upstream_port,
  CASE k % 3 WHEN 2 THEN t ELSE CAST(floor(t / 1000000) AS BIGINT) * 1000000 END AS line_t FROM snap)"""


def access(t):
    return weblog.parse_access_log(lines(t, ACCESS))


@query("parse_access_log", oracle("""SELECT event_id, client_ip, http_method, request_uri, query_string, status_code, host, upstream_port,
  line_t AS t FROM access""", ACCESS_CTE))
def _(t):
    return access(t).select("event_id", "client_ip", "http_method", "request_uri", "query_string", "status_code", "host", "upstream_port",
                            micros(F.col("ts")).alias("t"))


ERROR = ("substr(iso, 1, 4) || '/' || substr(iso, 6, 2) || '/' || substr(iso, 9, 2) || ' ' || substr(iso, 12, 8) || ' [' || CASE k % 4 WHEN 0 "
         "THEN 'crit' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' ELSE 'notice' END || '] ' || CAST(user_id AS STRING) || '#0: *' || CAST(k AS STRING) || "
         "' open() failed (2: none)' || CASE WHEN k % 2 = 0 THEN ', client: 10.0.0.3, server: srv.example, request: \"GET /x HTTP/1.1\", "
         "upstream: \"http://127.0.0.1:8082/\", host: \"h.example\"' ELSE '' END")


@query("parse_error_log", oracle("""SELECT event_id, CASE k % 4 WHEN 0 THEN 'crit' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' ELSE 'notice' END AS error_level,
  CAST(user_id AS VARCHAR) AS pid, CAST(k AS VARCHAR) AS connection_id, 'open() failed (2: none)' AS message,
  CASE WHEN k % 2 = 0 THEN '10.0.0.3' ELSE '' END AS client_ip, CASE WHEN k % 2 = 0 THEN 'h.example' END AS host,
  CASE WHEN k % 2 = 0 THEN '8082' END AS upstream_port, CASE WHEN k % 2 = 0 THEN '/x' ELSE '' END AS request_uri,
  CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'info' END AS severity,
  CAST(floor(t / 1000000) AS BIGINT) * 1000000 AS t FROM snap"""))
def _(t):
    out = weblog.parse_error_log(lines(t, ERROR))
    return out.select("event_id", "error_level", "pid", "connection_id", "message", "client_ip", "host", "upstream_port", "request_uri",
                      weblog.error_severity(F.col("error_level")).alias("severity"), micros(F.col("ts")).alias("t"))


@query("web_severity", oracle("""SELECT event_id, CASE WHEN k % 6 = 0 THEN 'high' WHEN k % 6 IN (1, 2) THEN 'medium' WHEN k % 6 = 3 THEN 'low'
  ELSE 'info' END AS severity FROM snap"""))
def _(t):
    codes = ["502", "401", "403", "404", "301", "-"]
    return t.snapshot.select("event_id", weblog.access_severity(F.get(F.array(*map(F.lit, codes)), F.col("k") % 6)).alias("severity"))


@query("assign_application", oracle("""SELECT event_id, CASE k % 3 WHEN 0 THEN 'LoginApp' WHEN 2 THEN 'LoginApp'
  ELSE (['LoginApp','LoginApp2','LoginApp3'])[k % 4 + 1] END AS application FROM access WHERE NOT (k % 3 = 1 AND k % 4 = 3)""", ACCESS_CTE))
def _(t):
    return weblog.assign_application(access(t)).select("event_id", "application")


@query("merge_parsed", oracle(f"""SELECT event_id, CASE WHEN k % 11 = 8 THEN 'kv-source' ELSE 'declared' END AS source,
  CASE WHEN k % 11 = 8 THEN raw_type ELSE 'declared_type' END AS event_type, {FORMATS} AS detected_format,
  CASE WHEN k % 11 = 8 THEN 2 ELSE 1 END + CASE WHEN k % 11 = 8 THEN 1 ELSE 0 END AS n_meta FROM snap WHERE k % 11 IN (8, 10)"""))
def _(t):
    src = t.snapshot.where("k % 11 in (8, 10)").select(
        "event_id", F.expr(MIXED).alias("message"), F.lit("declared").alias("source"), F.lit("declared_type").alias("event_type"),
        *[F.lit(None).cast("string").alias(n) for n in ("host", "severity", "timestamp", "source_ip", "user")],
        F.from_json(F.lit('{"kept":"1"}'), "map<string,string>").alias("metadata"))
    out = formats.merge_parsed(formats.parse_logs(src, year=YEAR))
    return out.select("event_id", "source", "event_type", "detected_format", F.size("metadata").alias("n_meta"))


@query("merge_parsed_all", oracle(f"""SELECT event_id, CASE k % 11 WHEN 0 THEN 'Prov' || CAST(k % 3 AS VARCHAR) WHEN 1 THEN 'cef-acme-corp-web-fw'
  WHEN 2 THEN 'leef-vend-prod' WHEN 4 THEN CASE WHEN k % 2 = 0 THEN 'docker-stdout' ELSE 'docker-stderr' END WHEN 5 THEN 'app' || CAST(k % 3 AS VARCHAR)
  WHEN 6 THEN 'sshd' WHEN 7 THEN 'web-server' WHEN 8 THEN 'kv-source' WHEN 9 THEN 'EDR' ELSE 'declared' END AS source,
  CASE k % 11 WHEN 0 THEN 'windows_event_' || CAST(4600 + k AS VARCHAR) WHEN 1 THEN 'cef_' || CAST(k AS VARCHAR) WHEN 2 THEN 'leef_ev_' || raw_type
  WHEN 3 THEN raw_type WHEN 4 THEN 'docker_log' WHEN 5 THEN 'ID' || CAST(k AS VARCHAR) WHEN 6 THEN 'syslog_event' WHEN 7 THEN 'http_get'
  WHEN 8 THEN raw_type WHEN 9 THEN CASE WHEN k % 2 = 0 THEN 'bad_file' ELSE 'scan' END ELSE 'declared_type' END AS event_type,
  {FORMATS} AS detected_format, '1' AS kept FROM snap"""))
def _(t):
    src = t.snapshot.select(
        "event_id", F.expr(MIXED).alias("message"), F.lit("declared").alias("source"), F.lit("declared_type").alias("event_type"),
        *[F.lit(None).cast("string").alias(n) for n in ("host", "severity", "timestamp", "source_ip", "user")],
        F.from_json(F.lit('{"kept":"1"}'), "map<string,string>").alias("metadata"))
    out = formats.merge_parsed(formats.parse_logs(src, year=YEAR))
    return out.select("event_id", "source", "event_type", "detected_format", F.col("metadata")["kept"].alias("kept"))


@query("parse_report", oracle(f"""SELECT {FORMATS} AS detected_format, raw_type AS source, count(*) AS lines,
  avg(([0.95, 1.0, 1.0, 0.9, 0.95, 0.95, 0.95, 0.95, 0.7, 0.6, 0.3])[k % 11 + 1])::DOUBLE AS mean_confidence,
  count(*) FILTER (k % 11 = 3 AND false) AS decoded_lines FROM snap GROUP BY ALL"""))
def _(t):
    src = t.snapshot.select("event_id", F.col("raw_type").alias("source"), F.expr(MIXED).alias("message"))
    return formats.parse_report(formats.parse_logs(src, year=YEAR))


@query("event_fingerprint", "SELECT doc_id, sha256(source || '|' || lang || '|' || substr(text, 1, 512) || '|') AS event_fingerprint FROM documents")
def _(t):
    fp = formats.event_fingerprint(F.col("source"), F.col("lang"), F.col("text"), F.lit(None).cast("string"))
    return t.table("documents").select("doc_id", fp.alias("event_fingerprint"))


@query("webkit_time", oracle("SELECT event_id, CASE WHEN k % 5 = 0 THEN 0 ELSE t END AS t FROM snap"))
def _(t):
    webkit = F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("t") + 11644473600000000)
    return t.snapshot.select("event_id", micros(webkit_time(webkit, F.timestamp_micros(F.lit(0)))).alias("t"))


@query("transition_name", oracle("""SELECT event_id, CASE WHEN k % 14 < 11 THEN (['Link','Typed','Auto_Bookmark','Auto_Subframe','Manual_Subframe',
  'Generated','Auto_Toplevel','Form_Submit','Reload','Keyword','Keyword_Generated'])[k % 14 + 1]
  ELSE 'Other (' || CAST(k % 14 AS VARCHAR) || ')' END AS transition_name FROM snap"""))
def _(t):
    return t.snapshot.select("event_id", transition_name(F.col("k") % 14 + 256 * F.col("k")).alias("transition_name"))


@query("classify_log_type", oracle("""SELECT event_id,
  CASE WHEN k % 19 = 0 THEN 'windows_event' WHEN event_type LIKE 'browser.%' THEN 'chrome_browser'
    WHEN k % 19 = 1 THEN 'syslog' WHEN source = 'nginx' THEN 'nginx_access' WHEN k % 19 = 2 THEN 'firewall_log'
    WHEN source = 'dns-server' OR contains(lower(message), 'query:') THEN 'dns_log'
    WHEN regexp_matches(event_type, 'auth|login|signin|signup|logout') OR contains(lower(message), 'failed login')
      OR contains(lower(message), 'session opened') OR contains(event_type, 'unauthorized') AND false THEN 'authentication_log'
    WHEN contains(source, 'service') THEN 'application_log' ELSE 'unknown' END AS log_type FROM snap"""))
def _(t):
    m = F.col("k") % 19
    fmt = F.when(m == 0, "windows_xml").when(m == 1, "syslog").when(m == 2, "key_value").otherwise("text")
    meta = F.when(m == 2, F.create_map(F.lit("proto"), F.lit("tcp"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return classify_log_type(t.snapshot.withColumns({"detected_format": fmt, "metadata": meta})).select("event_id", "log_type")


@query("classify_windows", oracle("""SELECT event_id, CASE WHEN id IN (4624, 4625) THEN 'authentication' WHEN id = 4688 THEN 'process_creation'
  WHEN id IN (4720, 4722, 4723, 4724, 4725, 4726, 4738, 4740) THEN 'account_management' WHEN id IN (7045, 4697) THEN 'service_installation'
  WHEN id IN (4663, 4656) THEN 'object_access' WHEN id IN (1102, 4719) THEN 'audit_log' ELSE 'system' END AS log_subtype
  FROM (SELECT event_id, CASE WHEN k % 10 = 0 THEN 7045 WHEN k % 10 = 5 THEN 1102 WHEN k % 2 = 0 THEN 4600 + k ELSE 4690 + k END AS id FROM snap)"""))
def _(t):
    k = F.col("k")
    eid = F.when(k % 10 == 0, 7045).when(k % 10 == 5, 1102).when(k % 2 == 0, 4600 + k).otherwise(4690 + k)
    return t.snapshot.select("event_id", windows_subtype(eid.cast("string")).alias("log_subtype"))
