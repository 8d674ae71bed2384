"""Log search and health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.exprs import any_of

SEARCHED = ["message", "source", "event_type", "host", "source_ip", "user"]


def list_logs(logs: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    return logs.orderBy(F.desc("event_id")).offset(skip).limit(limit)


def get_log(logs: DataFrame, event_id: int) -> DataFrame:
    return logs.where(F.col("event_id") == event_id)


def search_logs(logs: DataFrame, text: str = "", severity: str = "all", suspicious: bool | None = None) -> DataFrame:
    found = logs
    if text.strip():
        needle = text.lower()
        found = found.where(any_of(F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in SEARCHED))
    if severity != "all":
        found = found.where(F.col("severity") == severity)
    if suspicious is not None:
        found = found.where(F.coalesce("is_suspicious", F.lit(False)) == suspicious)
    return found


def sort_page(logs: DataFrame, sort_by: str, ascending: bool, page: int, rows: int) -> DataFrame:
    """Missing values come last ascending and first descending."""
    order = F.asc_nulls_last(sort_by) if ascending else F.desc_nulls_first(sort_by)
    return logs.orderBy(order, "event_id").offset(page * rows).limit(rows)


def suspicious_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count_if("is_suspicious").alias("suspicious_logs"))


def host_health(cpu: Column, ram: Column, disk: Column, offline_percent: Column) -> Column:
    critical = (cpu > 85) | (ram > 90) | (disk > 90) | (offline_percent > 30)
    warning = (cpu > 65) | (ram > 75) | (disk > 75) | (offline_percent > 0)
    return F.when(critical, "Critical").when(warning, "Warning").otherwise("Healthy")


def top_services(services: DataFrame) -> DataFrame:
    """Busiest online service per host by cpu (none when all are idle) and by memory; the first one wins ties."""
    online = services.where("status = 'ONLINE'")
    return online.groupBy("host").agg(
        F.max_by("service_name", F.struct("cpu_percent", -F.col("ord"))).alias("_cpu"),
        F.max("cpu_percent").alias("_max_cpu"),
        F.max_by("service_name", F.struct("memory_mb", -F.col("ord"))).alias("top_memory_service"),
    ).select("host", F.when(F.col("_max_cpu") > 0, F.col("_cpu")).alias("top_cpu_service"), "top_memory_service")


def service_counts(services: DataFrame) -> DataFrame:
    """Non-empty slices of the online/offline chart per host."""
    online = F.when(F.col("status") == "ONLINE", "Online").otherwise("Offline")
    return services.groupBy("host", online.alias("slice")).agg(F.count("*").alias("value"))
