"""One way in for live payloads: each is sent to the parser of its format and comes out as what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import gtfsrt, siri

#: Formats of JSON payloads and the node of a delivery that tells them, in the order in which they are tried.
NODES = (("estimated", "EstimatedTimetableDelivery"), ("monitoring", "StopMonitoringDelivery"), ("monitoring", "VehicleMonitoringDelivery"), ("messages", "GeneralMessageDelivery"))


def format_of(text: Column, binary: Column) -> Column:
    """protobuf (only of ``binary`` payloads), estimated, monitoring, messages, or unknown (empty, XML, JSON of no known delivery)."""
    kind = siri.payload_format(text)
    out = F.when(binary & (kind == "protobuf"), "protobuf")
    for name, node in NODES:
        out = out.when((kind == "json") & F.contains(text, F.lit(node)), name)
    return out.otherwise("unknown")


def kind_of(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind): trip, vehicle, alert or mixed, by what a message's entities (keys, kind) are."""
    has = [F.bool_or(F.col("kind") == k).alias(k) for k in ("trip", "vehicle", "alert")]
    n = sum((F.col(k).cast("int") for k in ("trip", "vehicle", "alert")), F.lit(0))
    kind = F.when(n != 1, "mixed").when(F.col("trip"), "trip").when(F.col("vehicle"), "vehicle").otherwise("alert")
    return entities.groupBy(*keys).agg(*has).select(*keys, kind.alias("kind"))


def ingest(payloads: DataFrame) -> dict[str, DataFrame]:
    """Tables of payloads (feed_id, content string or null, bytes binary or null): ``entities`` of protobuf messages, ``calls``, ``visits`` and ``messages`` of JSON ones, ``unknown`` the rest.

    Each parser sees only the payloads of its format; a feed may mix formats. A byte order mark is passed over.
    """
    text = F.regexp_replace(F.coalesce("content", F.make_valid_utf8(F.col("bytes").cast("string"))), "^\ufeff", "")
    rows = payloads.select("feed_id", text.alias("content"), "bytes").withColumn("format", format_of(F.col("content"), F.col("bytes").isNotNull()))
    pick = lambda name: rows.where(F.col("format") == name).select("feed_id", "content")
    return {
        "entities": gtfsrt.entities(rows.where("format = 'protobuf'").select("feed_id", F.col("bytes").alias("content"))), "calls": siri.estimated_calls(pick("estimated")), "visits": siri.monitored_visits(pick("monitoring")),
        "messages": siri.messages(pick("messages")), "unknown": rows.where("format = 'unknown'").select("feed_id", "content", "bytes"),
    }
