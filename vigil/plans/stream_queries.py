"""The detectors and the suppression as streams with keyed state, over the events in an order that they could really come in."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vigil.operators import correlate as X
from vigil.plans.adapters import HOUR, oracle
from vigil.plans.detect_queries import BURST, SURVIVORS, WIDTHS, over
from vigil.plans.registry import query
from vigil.streaming import keyed
from vigil.streaming.storage import new_folder

COLUMNS = ["event_id", "t", "event_type", "host", "source", "user", "source_ip"]
LATE = 6 * HOUR
#: Behind the newest event by so much at most (rows that come one batch late) or more than that (rows that come last).
DELAYED, LOST = "k % 10 = 3", "k % 97 = 5"


def detectors(*names):
    return {n: partial(X.DETECTORS[n], width=WIDTHS[n]) for n in names}


def replayed(t, folder, run, parts=4, lost=False):
    """Append the events in ``parts`` steps by time and run the stream after each of them. A row that matches ``DELAYED`` comes a step late if it
    lies in the last ``LATE`` before its step ends; one that matches ``LOST`` comes at the very end, if ``lost``."""
    events = t.snapshot.select(*COLUMNS, "k")
    first, last = events.agg(F.min("t"), F.max("t")).first()
    step = (last - first) // parts + 1
    own = F.floor((F.col("t") - first) / step)
    near = F.expr(DELAYED) & (F.col("t") > first + (own + 1) * step - LATE)
    part = F.when(F.expr(LOST), parts + 1).otherwise(own + near.cast("int")) if lost else own + near.cast("int")
    dealt = events.withColumn("_part", F.coalesce(part, F.lit(0)))
    schema = StructType([StructField(f.name, f.dataType) for f in events.drop("k").schema])
    # an event without anything but a time moves the clock behind the last window
    clock = t.spark.createDataFrame([(None, last + 1000 * HOUR, *[None] * 5)], schema)
    for i in range(parts + 2):
        new = dealt.where(F.col("_part") == i).select(*COLUMNS) if i != parts else dealt.where(F.col("_part") == i).select(*COLUMNS).unionByName(clock)
        if i == parts + 1 and not lost:
            break
        new.write.mode("append").parquet(f"{folder}/in")
        run(t.spark.readStream.schema(schema).parquet(f"{folder}/in")).awaitTermination()
    return schema


def found(t, folder, chosen, lost=False):
    schema = replayed(t, folder, lambda events: keyed.detect_stream(events, f"{folder}/found", chosen, LATE), lost=lost)
    return lambda stream=False: keyed.stored_matches(t.spark, f"{folder}/found", schema, chosen, stream)


@query("corr_keyed_matches", oracle(f"""SELECT event_id, 'failed_login_burst' AS correlation_type, n AS event_count, first_seen, t AS last_seen, n AS measure FROM burst
  UNION ALL SELECT event_id, 'multi_host_attack', n, first_seen, t, hosts FROM (SELECT *, count(*) {over("source_ip", "multi_host_attack")} AS n,
  min(t) {over("source_ip", "multi_host_attack")} AS first_seen, count(DISTINCT host) {over("source_ip", "multi_host_attack")} AS hosts FROM snap
  WHERE source_ip IS NOT NULL) WHERE hosts >= 3
  UNION ALL SELECT event_id, 'brute_force_success', n + 1, first_seen, t, n FROM (SELECT *, count(*) FILTER (event_type = 'login_failed') {over("usr", "brute_force_success")} AS n,
  min(t) FILTER (event_type = 'login_failed') {over("usr", "brute_force_success")} AS first_seen FROM snap
  WHERE usr IS NOT NULL AND contains(event_type, 'login')) WHERE event_type = 'login_success' AND n >= 3""", BURST))
def _(t):
    stored = found(t, new_folder(t.spark, "keyed"), detectors("failed_login_burst", "multi_host_attack", "brute_force_success"))
    return stored().select("event_id", "correlation_type", "event_count", "first_seen", "last_seen", "measure")


@query("corr_keyed_survivors", oracle("SELECT event_id, key AS correlation_key, n AS event_count FROM m JOIN alive USING (event_id)", BURST, SURVIVORS, recursive=True)
       .replace("usr || ':' || source_ip AS key", "'failed_login_burst:' || usr || ':' || source_ip AS key"))
def _(t):
    folder, names = new_folder(t.spark, "keyed"), ("failed_login_burst",)
    stored = found(t, folder, detectors(*names))
    clock = t.spark.createDataFrame([(None, 1 << 60)], "key string, t bigint")
    clock.write.parquet(f"{folder}/clock")
    control = t.spark.readStream.schema(clock.schema).parquet(f"{folder}/clock")
    windows = {n: WIDTHS[n] for n in names}
    keyed.suppress_matches_stream(stored(stream=True), f"{folder}/kept", LATE, windows, control).awaitTermination()
    fired = keyed.stored_kept(t.spark, f"{folder}/kept").where("fires").select(F.col("key").alias("correlation_key"), F.col("id").alias("event_id"))
    counts = stored().select("event_id", "event_count")
    return fired.join(counts, "event_id").select("event_id", "correlation_key", "event_count")


@query("corr_keyed_late", oracle(f"""SELECT event_id, 'too late' AS outcome, NULL AS event_count FROM snap WHERE event_type = 'login_failed' AND source_ip IS NOT NULL AND usr IS NOT NULL
  AND {LOST} UNION ALL SELECT event_id, 'match', n FROM (SELECT *, count(*) {over("source_ip, usr", "failed_login_burst")} AS n FROM snap WHERE event_type = 'login_failed'
  AND source_ip IS NOT NULL AND usr IS NOT NULL AND NOT coalesce({LOST}, false)) WHERE n > 5"""))
def _(t):
    folder, chosen = new_folder(t.spark, "keyed"), detectors("failed_login_burst")
    stored = found(t, folder, chosen, lost=True)()
    late = keyed.stored_late(t.spark, f"{folder}/found").select("event_id", F.lit("too late").alias("outcome"), F.lit(None).cast("bigint").alias("event_count"))
    return late.unionByName(stored.select("event_id", F.lit("match").alias("outcome"), "event_count"))
