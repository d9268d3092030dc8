"""SIRI payloads in JSON: estimated timetables, stop and vehicle monitoring, messages.

Payloads are parsed to variants and taken apart by exploding lists; where a value may be a scalar, an object with ``value``
or a list of these, all are tried. Everything stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAYS = (("ontime", 0), ("early", -60), ("delayed", 120), ("late", 120))


def payload_format(content: Column) -> Column:
    """json, xml, protobuf or empty, by the first bytes after a byte order mark."""
    head = F.ltrim(F.regexp_replace(F.coalesce(content, F.lit("")), "^﻿", ""))
    return F.when(head == "", "empty").when(head.rlike(r"^[\[{]"), "json").when(F.startswith(head, F.lit("<")), "xml").otherwise("protobuf")


def value(node: str, *paths: str) -> Column:
    """First of ``paths`` under ``node`` that is a scalar, an object with ``value``, or a list of either."""
    tries = []
    for p in paths:
        tries += [f"try_variant_get({node}, '$.{p}.value', 'string')", f"try_variant_get({node}, '$.{p}[0].value', 'string')", f"try_variant_get({node}, '$.{p}[0]', 'string')", f"case when schema_of_variant(variant_get({node}, '$.{p}', 'variant')) not rlike '^(OBJECT|ARRAY)' then try_variant_get({node}, '$.{p}', 'string') end"]
    return F.expr(f"nullif(trim(coalesce({', '.join(tries)})), '')")


def instant(node: str, *paths: str) -> Column:
    """Epoch second of a time."""
    return F.unix_timestamp(F.expr("try_to_timestamp(" + f"coalesce({', '.join(f'''try_variant_get({node}, '$.{p}', 'string')''' for p in paths)})" + ")"))


def listed(rows: DataFrame, node: str, path: str, to: str) -> DataFrame:
    """One row for each member of a list, or for a single object that stands in its place; ``to`` is the member, ``to_at`` its place."""
    many = f"try_variant_get({node}, '$.{path}', 'array<variant>')"
    one = f"try_variant_get({node}, '$.{path}', 'variant')"
    return rows.selectExpr("*", f"posexplode(coalesce({many}, case when {one} is not null then array({one}) end)) as ({to}_at, {to})")


def delay_of_status(status: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, seconds in DELAYS:
        out = F.when(F.lower(status) == name, F.lit(seconds)).otherwise(out)
    return out.cast("long")


def is_canceled(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin("cancelled", "canceled"), F.lit(False))


def deliveries(payloads: DataFrame, kind: str) -> DataFrame:
    """(feed_id, d): deliveries of a kind in payloads (feed_id, content); content that is no JSON yields nothing."""
    rows = payloads.select("feed_id", F.expr("try_parse_json(content)").alias("v")).where("v is not null")
    rows = rows.select("feed_id", F.expr("coalesce(try_variant_get(v, '$.Siri.ServiceDelivery', 'variant'), try_variant_get(v, '$.ServiceDelivery', 'variant'), try_variant_get(v, '$.siri.serviceDelivery', 'variant'))").alias("s")).where("s is not null")
    return listed(rows, "s", kind, "d").select("feed_id", "d")


def _call(rows: DataFrame, call: str, journey: str) -> DataFrame:
    return rows.select(
        "feed_id", value(journey, "DatedVehicleJourneyRef", "FramedVehicleJourneyRef.DatedVehicleJourneyRef", "VehicleJourneyRef").alias("journey_ref"), value(journey, "LineRef").alias("line_ref"), value(call, "StopPointRef").alias("stop_ref"),
        instant(call, "AimedArrivalTime").alias("aimed_arrival"), instant(call, "ExpectedArrivalTime").alias("arrival"), instant(call, "AimedDepartureTime").alias("aimed_departure"), instant(call, "ExpectedDepartureTime").alias("departure"),
        value(call, "ArrivalStatus").alias("arrival_status"), value(call, "DepartureStatus").alias("departure_status"), value(journey, "VehicleRef").alias("vehicle_ref"),
        F.expr(f"try_variant_get({journey}, '$.VehicleLocation.Latitude', 'double')").alias("lat"), F.expr(f"try_variant_get({journey}, '$.VehicleLocation.Longitude', 'double')").alias("lon"), "call_at",
    )


def _judged(rows: DataFrame) -> DataFrame:
    arrival = F.coalesce(F.col("arrival") - F.col("aimed_arrival"), delay_of_status(F.col("arrival_status")))
    departure = F.coalesce(F.col("departure") - F.col("aimed_departure"), delay_of_status(F.col("departure_status")))
    skipped = is_canceled(F.col("arrival_status")) & is_canceled(F.coalesce("departure_status", "arrival_status"))
    return rows.withColumn("arrival_delay", arrival).withColumn("departure_delay", departure).withColumn("skipped", skipped)


def estimated_calls(payloads: DataFrame) -> DataFrame:
    """One row for each call of an estimated timetable, in order of ``call_at``."""
    rows = listed(deliveries(payloads, "EstimatedTimetableDelivery"), "d", "EstimatedJourneyVersionFrame", "f")
    rows = listed(rows.select("feed_id", "f"), "f", "EstimatedVehicleJourney", "j")
    rows = listed(rows.select("feed_id", "j"), "j", "EstimatedCalls.EstimatedCall", "call")
    return _judged(_call(rows, "call", "j")).where("journey_ref is not null")


def monitored_visits(payloads: DataFrame) -> DataFrame:
    """One row for each visit of stop or vehicle monitoring."""
    rows = listed(deliveries(payloads, "StopMonitoringDelivery"), "d", "MonitoredStopVisit", "m")
    rows = rows.select("feed_id", F.expr("try_variant_get(m, '$.MonitoredVehicleJourney', 'variant')").alias("j"), F.col("m_at").alias("call_at"))
    rows = rows.withColumn("call", F.expr("try_variant_get(j, '$.MonitoredCall', 'variant')")).where("call is not null")
    return _judged(_call(rows, "call", "j")).where("journey_ref is not null")


def positions(visits: DataFrame) -> DataFrame:
    """Vehicles that tell where they are; (0, 0) is nowhere."""
    return visits.where("lat is not null and lon is not null and not (lat = 0 and lon = 0)").select("feed_id", F.coalesce("vehicle_ref", "journey_ref").alias("vehicle_id"), "journey_ref", "line_ref", "lat", "lon")


def messages(payloads: DataFrame) -> DataFrame:
    """(feed_id, message_id, severity, line_ref, text, end_s) of general messages."""
    rows = listed(deliveries(payloads, "GeneralMessageDelivery"), "d", "InfoMessage", "m")
    channel = F.lower(F.coalesce(value("m", "InfoChannelRef"), F.lit("")))
    severity = F.when(channel.rlike("perturb|incident"), "SEVERE").when(channel.rlike("travaux|work"), "WARNING").when(channel.rlike("info|commercial"), "INFO").otherwise("WARNING")
    rows = rows.select("feed_id", value("m", "InfoMessageIdentifier", "ItemIdentifier").alias("message_id"), severity.alias("severity"), instant("m", "ValidUntilTime").alias("end_s"), F.expr("try_variant_get(m, '$.Content', 'variant')").alias("c"))
    rows = rows.withColumn("line_ref", value("c", "LineRef"))
    texts = listed(rows, "c", "Message", "t").withColumn("text", value("t", "MessageText")).where("text is not null")
    return texts.groupBy("feed_id", "message_id", "severity", "end_s", "line_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_at", "text"))), lambda x: x["text"]), "\n").alias("text"))
