"""Queries over names, addresses, labels and state tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..operators import ledger, search
from ..sources.derived import Network, with_views

QUERIES, SQL = {}, {}
STOP_QUERIES = ("stop 1", "STOP 2", "7", "Stop 99", "s")
STREET_QUERIES = ("12 rue de small bolt", "larg gear", "rue de blue widget", "5 bis red", "widgit 75001")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Network(spark, folder))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


def fold_sql(x: str) -> str:
    out = f"translate({x}, '{tx.ACCENTED}', '{tx.PLAIN}')"
    for a, b in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def plain_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({fold_sql(x)}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"select doc_id, md5({fold_sql('text')}) as digest from documents")
def accent_fold(net: Network) -> DataFrame:
    return net.raw("documents").select("doc_id", F.md5(tx.fold_accents(F.col("text"))).alias("digest"))


@query(f"select doc_id, md5({plain_sql('text')}) as digest from documents")
def search_normalize(net: Network) -> DataFrame:
    return net.raw("documents").select("doc_id", F.md5(tx.address_normal(F.col("text"))).alias("digest"))


@query("""with n as (select p_partkey, case p_partkey % 4 when 0 then 'Gare de ' when 1 then 'Station ' when 2 then 'Arrêt ' else '' end || p_name || case p_partkey % 3 when 0 then ' RER' when 1 then ' la Métro' else '' end as name from part),
k as (select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(name), 'êé', 'ee'), '^(gare de |gare d''|gare d’|station |arret )', ''), ' rer$', ''), ' metro$', ''), ' tram$', ''), ' bus$', '') as s from n)
select p_partkey, array_to_string(list_filter(string_split(regexp_replace(s, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w not in ('', 'de', 'la', 'le', 'les')), ' ') as key from k""")
def place_key(net: Network) -> DataFrame:
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, "Gare de ").when(k % 4 == 1, "Station ").when(k % 4 == 2, "Arrêt ").otherwise("")
    tail = F.when(k % 3 == 0, " RER").when(k % 3 == 1, " la Métro").otherwise("")
    return net.raw("part").select("p_partkey", tx.place_key(F.concat(head, "p_name", tail)).alias("key"))


@query("""with q as (select p_partkey, lower(p_name) as hay, unnest(['blue', 'gear', 'ea', 'zz']) as needle from part) select p_partkey, needle, case when starts_with(hay, needle) then 3 when regexp_matches(hay, '(^|[^A-Za-z0-9])' || needle) then 2 when contains(hay, needle) then 1 else 0 end::int as kind from q""")
def match_kind(net: Network) -> DataFrame:
    rows = net.raw("part").select("p_partkey", F.lower("p_name").alias("hay"), F.explode(F.array(*map(F.lit, ("blue", "gear", "ea", "zz")))).alias("needle"))
    return rows.select("p_partkey", "needle", tx.match_kind(F.col("hay"), F.col("needle")).alias("kind"))


_ASKS_SQL = "asks as (select unnest([" + ", ".join(f"'{q}'" for q in STOP_QUERIES) + "]) as query)"


@query(f"""with {_ASKS_SQL}, s as (select stop_id, name, lower(name) as n, 'net:' || stop_id::varchar as i, case when wheelchair = 1 then 200 when wheelchair = 0 then 120 else 0 end as kind, stop_id in (select stop_id from stop_times where pickup_type <> 1) as dep from stops),
h as (select query, s.*, lower(trim(query)) as q from s, asks where octet_length(lower(trim(query))::blob) >= 2),
k as (select *, case when starts_with(n, q) then 3 when regexp_matches(n, '(^|[^a-z0-9])' || q) then 2 when contains(n, q) then 1 else 0 end as a, case when starts_with(i, q) then 3 when regexp_matches(i, '(^|[^a-z0-9])' || q) then 2 when contains(i, q) then 1 else 0 end as b from h),
sc as (select *, 100 * greatest(a, b) + case when a >= b and a > 0 then 30 else 0 end + kind - least(strlen(n), 40) + case when dep then 80 when kind >= 300 then -350 else 0 end as score from k where a > 0 or b > 0),
one as (select * from (select *, row_number() over (partition by query, n order by score desc, name, stop_id) as r from sc) where r = 1)
select query, rank::int as rank, stop_id, name, score::int as score from (select *, row_number() over (partition by query order by score desc, name, stop_id) as rank from one) where rank <= 10""")
def stop_search(net: Network) -> DataFrame:
    boardable = net.stop_times.where("pickup_type <> 1").select("stop_id", F.lit(True).alias("dep")).distinct()
    w = F.col("wheelchair")
    raw_id = F.concat(F.lit("net:"), F.col("stop_id").cast("string"))
    kind = search.place_kind(raw_id, F.when(w == 1, 1).otherwise(0), w == 0)
    rows = net.stops.join(boardable, "stop_id", "left").select("stop_id", raw_id.alias("raw_id"), "name", kind.alias("place_kind"), F.coalesce("dep", F.lit(False)).alias("has_departures"))
    return search.stop_search(rows, asks(net, STOP_QUERIES), 10)


def asks(net: Network, texts: tuple[str, ...]) -> DataFrame:
    return net.spark.range(1).select(F.explode(F.array(*map(F.lit, texts))).alias("query"))


@query(f"select street, postcode, city, count(*) as n_addresses, round(avg(lat), 5) as lat, {plain_sql('street')} as name_n from addresses group by street, postcode, city")
def address_index(net: Network) -> DataFrame:
    streets, _ = search.street_index(net.addresses)
    return streets.select("street", "postcode", "city", "n_addresses", F.round("lat", 5).alias("lat"), "name_n")


@query("""with w as (select distinct street, postcode, city, unnest(string_split(lower(street) || ' ' || lower(city), ' ')) as word from addresses) select substring(word, 1, 3) as prefix, count(distinct (street, postcode, city)) as n from w where length(word) >= 3 group by 1""")
def address_postings(net: Network) -> DataFrame:
    _, postings = search.street_index(net.addresses)
    return postings.groupBy("prefix").agg(F.count("*").alias("n"))


@query()
def address_suggest(net: Network) -> DataFrame:
    """Suggestions for a batch of queries; golden cases are in the tests."""
    return search.address_suggest(net.addresses, asks(net, STREET_QUERIES))


@query("""with q as (select unnest(['smal', 'widgt', 'gaer', 'blue', 'copper']) as token), n as (select p_partkey, lower(p_name) as name from part)
select p_partkey, token from n, q where len(list_filter(string_split(name, ' '), lambda w: length(w) >= 3 and levenshtein(token, w) <= case when length(token) >= 7 then 2 else 1 end)) > 0""")
def address_fuzzy(net: Network) -> DataFrame:
    rows = net.raw("part").select("p_partkey", F.lower("p_name").alias("name"), F.explode(F.array(*map(F.lit, ("smal", "widgt", "gaer", "blue", "copper")))).alias("token"))
    return rows.where(search.fuzzy_word(F.col("token"), F.col("name"))).select("p_partkey", "token")


@query("""with a as (select address_id, case address_id % 4 when 0 then num || ' bis ' || street when 1 then num || 'b ' || street when 2 then num || ' ' || street else street end as text from addresses)
select address_id, case when address_id % 4 < 3 then (1 + address_id % 120)::varchar end as num, case address_id % 4 when 0 then 'bis' when 1 then 'b' when 2 then '' end as rep, lower(regexp_extract(text, 'rue.*')) as street from a""")
def number_split(net: Network) -> DataFrame:
    m = F.col("address_id") % 4
    num = F.col("num").cast("string")
    text = F.when(m == 0, F.concat(num, F.lit(" bis "), "street")).when(m == 1, F.concat(num, F.lit("b "), "street")).when(m == 2, F.concat(num, F.lit(" "), "street")).otherwise(F.col("street"))
    return net.addresses.select("address_id", tx.split_number(text).alias("x")).select("address_id", "x.num", "x.rep", "x.street")


@query()
def places(net: Network) -> DataFrame:
    """Stops and addresses for one text; composed of two checked searches."""
    stops = QUERIES["stop_search"](net.spark, net.folder)
    return search.places(stops, search.address_suggest(net.addresses, asks(net, STOP_QUERIES)))


@query("""with s as (select page_id, regexp_replace(html, '<[^>]*(>|$)', ' ', 'g') as t from pages),
d as (select page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') as t from s)
select page_id, md5(trim(regexp_replace(regexp_replace(t, '<[^>]*(>|$)', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as digest from d""")
def alert_clean_html(net: Network) -> DataFrame:
    return net.raw("pages").select("page_id", F.md5(tx.clean_html(F.col("html"))).alias("digest"))


@query("""with t as (select alert_id // 4 as g, lang, header from alerts), r as (select *, case lang when 'fr' then 0 when 'en' then 3 when 'de' then 200 else 100 end as rank from t where trim(header) <> '')
select g as group_id, md5(trim(regexp_replace(header, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as digest from (select *, row_number() over (partition by g order by rank, header) as n from r) where n = 1 and g in (select g from r where rank < 200) and not contains(header, '<') and not contains(header, '&')""")
def alert_translation(net: Network) -> DataFrame:
    """Groups of four alerts as one alert in several languages."""
    g = F.floor(F.col("alert_id") / 4)
    rows = net.alerts.where(F.trim("header") != "").groupBy(g.alias("group_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("header").alias("text"), "lang"))).alias("t"))
    rows = rows.withColumn("t", F.transform("t", lambda x: F.struct(x["lang"].alias("lang"), x["text"].alias("text"))))
    chosen = tx.pick_translation(F.col("t"))
    raw = F.exists("t", lambda x: F.lower(x["lang"]) != "de")
    rows = rows.where(raw).select("group_id", chosen.alias("text"))
    return rows.where(~F.contains("text", F.lit("<")) & ~F.contains("text", F.lit("&"))).select("group_id", F.md5("text").alias("digest"))


@query("select distinct route_id, 'OP:Line::C' || (1000 + route_id)::varchar || '0:LOC' as ref, 'C' || (1000 + route_id)::varchar || '0' as label, 'C' || (1000 + route_id)::varchar || '0' as code from trips")
def humanize_ref(net: Network) -> DataFrame:
    ref = F.concat(F.lit("OP:Line::C"), (1000 + F.col("route_id")).cast("string"), F.lit("0:LOC"))
    return net.trips.select("route_id", ref.alias("ref")).distinct().withColumns({"label": tx.humanize_ref(F.col("ref")), "code": tx.product_code(F.col("ref"))})


@query("select trip_id, coalesce(case route_type when 1 then 'M' || (route_id % 14 + 1)::varchar when 0 then 'T' || (route_id % 9 + 1)::varchar when 2 then 'RER ' || chr(65 + (route_id % 5)::int) end, 'Bus ' || route_id::varchar) as label from trips")
def map_label(net: Network) -> DataFrame:
    """Short labels for a map, by mode."""
    r, kind = F.col("route_id"), F.col("route_type")
    rail = F.concat(F.lit("RER "), F.call_function("chr", (65 + r % 5).cast("long")))
    label = F.when(kind == 1, F.concat(F.lit("M"), (r % 14 + 1).cast("string"))).when(kind == 0, F.concat(F.lit("T"), (r % 9 + 1).cast("string"))).when(kind == 2, rail).otherwise(F.concat(F.lit("Bus "), r.cast("string")))
    return net.trips.select("trip_id", label.alias("label"))


@query("""with c as (select p_partkey, upper(printf('%06x', (p_partkey * 48271) % 16777216)) as color from part)
select p_partkey, color, case when (('0x' || substring(color, 1, 2))::int * 299 + ('0x' || substring(color, 3, 2))::int * 587 + ('0x' || substring(color, 5, 2))::int * 114) / 1000.0::double > 160 then '000000' else 'FFFFFF' end as text_color from c""")
def line_color_contrast(net: Network) -> DataFrame:
    color = F.lpad(F.hex((F.col("p_partkey") * 48271) % 16777216), 6, "0")
    return net.raw("part").select("p_partkey", color.alias("color")).withColumn("text_color", geo.contrast_text(F.col("color")))


@query("select user_id as key, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value, max(ts) as last_ts from events group by user_id")
def state_latest(net: Network) -> DataFrame:
    from ..operators.realtime import latest

    rows = net.raw("events").select(F.col("user_id").alias("key"), "event_type", "value", "ts", "event_id")
    return latest(rows, ["key"], ["ts", "event_id"]).select("key", "event_type", "value", F.col("ts").alias("last_ts"))


_NOW_SQL = "(select max(floor(epoch(ts))::bigint) from events)"


@query(f"select key, seen from (select user_id as key, max(floor(epoch(ts))::bigint) as seen from events group by user_id) where seen >= {_NOW_SQL} - 86400 order by seen desc, key limit 200")
def state_eviction(net: Network) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    state = net.raw("events").groupBy(F.col("user_id").alias("key")).agg(F.max(at).alias("seen"))
    now = net.raw("events").agg(F.max(at)).first()[0]
    return ledger.evicted(state, F.lit(now), 86_400, 200, "seen")


@query("select event_id as key, user_id, floor(epoch(ts))::bigint as seen from (select *, row_number() over (partition by user_id order by floor(epoch(ts)) desc, event_id) as n from events) where n <= 3")
def state_cap(net: Network) -> DataFrame:
    rows = net.raw("events").select(F.col("event_id").alias("key"), "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seen"))
    return ledger.newest(rows, "user_id", "seen", 3)


@query("select event_id, cast(ts + interval 1 hour as date) as day, row_number() over (partition by cast(ts + interval 1 hour as date), event_type order by ts, event_id) <= 40 as granted from events")
def quota_daily(net: Network) -> DataFrame:
    rows = net.raw("events").select("event_id", "ts", F.col("event_type").alias("client"))
    return ledger.daily_quota(rows, 40).select("event_id", "day", "granted")


@query("""with recursive r as (select user_id as client, floor(epoch(ts))::double as at_s, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) as n from events),
b as (select client, n, at_s, 3.0::double as tokens, 1 as ok from r where n = 1 union all select r.client, r.n, r.at_s, t - case when t >= 1 then 1 else 0 end, case when t >= 1 then 1 else 0 end from (select r.*, least(4.0::double, b.tokens + (r.at_s - b.at_s) * 0.00001::double) as t from b join r on r.client = b.client and r.n = b.n + 1) r)
select client, sum(ok)::bigint as granted, (count(*) - sum(ok))::bigint as refused from b group by client""".replace("with recursive ", "with "))
def token_bucket(net: Network) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    rows = net.raw("events").select(F.col("user_id").alias("client"), at.alias("at_s"))
    return ledger.token_bucket(rows, 0.00001, 4.0).withColumn("refused", F.col("refused").cast("long"))


SQL["token_bucket"] = SQL["token_bucket"].replace("with stops as", "with recursive stops as", 1)


@query("select key, seen from (select user_id as key, max(floor(epoch(ts))::bigint) as seen, bool_or(event_type = 'purchase') as trusted from events group by user_id) where trusted or true qualify row_number() over (partition by trusted order by seen desc, key) <= case when trusted then 64 else 8 end")
def interest_lru(net: Network) -> DataFrame:
    """Watched keys: the newest of the confirmed ones and, under a cap of their own, of the others."""
    from pyspark.sql import Window as W

    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = net.raw("events").groupBy(F.col("user_id").alias("key")).agg(F.max(at).alias("seen"), F.bool_or(F.col("event_type") == "purchase").alias("trusted"))
    rank = F.row_number().over(W.partitionBy("trusted").orderBy(F.desc("seen"), "key"))
    return rows.withColumn("n", rank).where(F.col("n") <= F.when(F.col("trusted"), 64).otherwise(8)).select("key", "seen")


@query("with t as (select stop_id, departure_s // 3600 as hour, departure_s, departure_s - lag(departure_s) over (partition by stop_id order by departure_s, trip_id, off) as gap from stop_times) select stop_id, hour::bigint as hour, count(*) as departures, max(gap)::bigint as longest_gap from t group by 1, 2")
def headway_windows(net: Network) -> DataFrame:
    from pyspark.sql import Window as W

    gap = F.col("departure_s") - F.lag("departure_s").over(W.partitionBy("stop_id").orderBy("departure_s", "trip_id", "off"))
    rows = net.stop_times.withColumn("gap", gap)
    return rows.groupBy("stop_id", F.floor(F.col("departure_s") / 3600).alias("hour")).agg(F.count("*").alias("departures"), F.max("gap").alias("longest_gap"))


@query("with o as (select trip_id, ts, ts - lag(ts) over (partition by trip_id order by ts) >= interval 2 day as fresh from rt_events where delay_s is not null), s as (select trip_id, ts, sum(case when fresh then 1 else 0 end) over (partition by trip_id order by ts) as k from o) select trip_id, count(*) as n, min(ts) as first_ts from s group by trip_id, k")
def delay_sessions(net: Network) -> DataFrame:
    rows = net.rt_events.where("delay_s is not null").select("trip_id", "ts")
    return rows.groupBy("trip_id", F.session_window("ts", "2 days")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts")).select("trip_id", "n", "first_ts")


@query("select 'feed' || (trip_id % 4)::varchar as feed, count(*) as updates, 1706659200 - max(floor(epoch(ts)))::bigint as age_s, 1706659200 - max(floor(epoch(ts)))::bigint < 300 as fresh from rt_events group by 1")
def feed_status(net: Network) -> DataFrame:
    feed = F.concat(F.lit("feed"), (F.col("trip_id") % 4).cast("string"))
    age = 1_706_659_200 - F.max(F.unix_timestamp(F.col("ts").cast("timestamp")))
    return net.rt_events.groupBy(feed.alias("feed")).agg(F.count("*").alias("updates"), age.alias("age_s"), (age < 300).alias("fresh"))


@query("select case when t > 0 then 'ok' else 'empty' end as status, s as stops, t as trips, e as updates from (select (select count(*) from stops) as s, (select count(*) from trips) as t, (select count(*) from rt_events) as e)")
def health(net: Network) -> DataFrame:
    counts = [d.agg(F.count("*").alias(n)) for d, n in ((net.stops, "stops"), (net.trips, "trips"), (net.rt_events, "updates"))]
    rows = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
    return rows.select(F.when(F.col("trips") > 0, "ok").otherwise("empty").alias("status"), "stops", "trips", "updates")


@query("select 'updates_total{feed=\"' || regexp_replace('feed ' || (trip_id % 4)::varchar, '[^A-Za-z0-9_]', '_', 'g') || '\"} ' || count(*)::varchar as line from rt_events group by trip_id % 4")
def metrics_text(net: Network) -> DataFrame:
    label = F.regexp_replace(F.concat(F.lit("feed "), (F.col("trip_id") % 4).cast("string")), "[^A-Za-z0-9_]", "_")
    rows = net.rt_events.groupBy(label.alias("feed")).agg(F.count("*").alias("n"))
    return rows.select(F.concat(F.lit('updates_total{feed="'), "feed", F.lit('"} '), F.col("n").cast("string")).alias("line"))


@query("select pattern_id, count(*) as n, sum(('0x' || left(md5(trip_id::varchar), 8))::bigint)::bigint as digest from trips group by pattern_id")
def content_hash(net: Network) -> DataFrame:
    """Order-independent digest of each partition's ids: sums of hashes, so that no group is gathered."""
    part = F.conv(F.left(F.md5(F.col("trip_id").cast("string")), F.lit(8)), 16, 10).cast("long")
    return net.trips.groupBy("pattern_id").agg(F.count("*").alias("n"), F.sum(part).alias("digest"))


@query("select n_regionkey::bigint as level_index, n_name as level_name, (row_number() over (order by n_regionkey, n_nationkey))::int as position from nation")
def levels(net: Network) -> DataFrame:
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.orderBy("n_regionkey", "n_nationkey"))
    return net.raw("nation").select(F.col("n_regionkey").cast("long").alias("level_index"), F.col("n_name").alias("level_name"), rank.alias("position"))
