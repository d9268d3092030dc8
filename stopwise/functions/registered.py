"""SQL names for the column functions: temporary functions that Catalyst inlines, so they cost no call."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "haversine_m": ("lat1 double, lon1 double, lat2 double, lon2 double", "double", "2 * 6371000.0D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"),
    "bearing_deg": ("lat1 double, lon1 double, lat2 double, lon2 double", "double", "(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360"),
    "gtfs_seconds": ("t string", "int", "case when trim(t) rlike '^[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]$' and cast(split_part(trim(t), ':', 1) as int) <= 72 then cast(split_part(trim(t), ':', 1) as int) * 3600 + cast(split_part(trim(t), ':', 2) as int) * 60 + cast(split_part(trim(t), ':', 3) as int) end"),
    "service_anchor_s": ("d date, zone string", "bigint", "unix_timestamp(to_utc_timestamp(cast(d as timestamp) + interval 12 hours, zone)) - 43200"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {returns} return {body}")
    return sorted(FUNCTIONS)
