"""Search for stops and street addresses, for a batch of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

#: A typo may cost so many edits from so many letters on.
TYPOS = ((7, 2), (4, 1))


def place_kind(raw_id: Column, location_type: Column, station: Column) -> Column:
    low = F.lower(raw_id)
    shell = F.contains(low, F.lit("stopplace")) & ~F.contains(low, F.lit("quay"))
    out = F.when(F.contains(low, F.lit("monomodalstopplace")), 400).when(F.contains(low, F.lit("multimodalstopplace")), 350).when(shell, 300)
    return out.when(location_type == 1, 200).when(station, 120).otherwise(0)


def stop_search(stops: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query, rank, stop_id, name, score) for stops (stop_id, raw_id, name, place_kind, has_departures).

    Stops are filed under the parts of one to three letters of their names that queries ask for; a query looks up its rarest
    part of three letters (or itself, if shorter), so that only stops that have it are scored, by an equi-join for any number of queries.
    Queries of fewer than two bytes find nothing.
    """
    asks = queries.withColumn("q", tx.normalize(F.trim("query"))).where(F.octet_length("q") >= 2)
    rows = stops.withColumn("name_n", tx.normalize(F.col("name"))).withColumn("id_n", tx.normalize(F.col("raw_id")))
    parts = lambda c, n: f"if(length({c}) >= {n}, transform(sequence(1, length({c}) - {n} + 1), k -> substring({c}, k, {n})), array())"
    filed = rows.withColumn("part", F.explode(F.array_distinct(F.concat(*(F.expr(parts(c, n)) for c in ("name_n", "id_n") for n in (1, 2, 3))))))
    wanted = asks.select("query", "q", F.explode(F.array_distinct(F.expr(f"case length(q) when 1 then {parts('q', 1)} when 2 then {parts('q', 2)} else {parts('q', 3)} end"))).alias("part"))
    filed = filed.join(wanted.select("part").distinct(), "part", "left_semi")
    sizes = filed.groupBy("part").agg(F.count("*").alias("n"))
    rarest = wanted.join(sizes, "part", "left").groupBy("query", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("x")).select("query", "q", "x.part")
    hits = filed.join(rarest, "part").where(F.contains("name_n", F.col("q")) | F.contains("id_n", F.col("q"))).drop("part")
    by_name, by_id = tx.match_kind(F.col("name_n"), F.col("q")), tx.match_kind(F.col("id_n"), F.col("q"))
    hits = hits.withColumn("by_name", by_name).withColumn("by_id", by_id)
    score = 100 * F.greatest("by_name", "by_id") + F.when((F.col("by_name") >= F.col("by_id")) & (F.col("by_name") > 0), 30).otherwise(0)
    score = score + F.col("place_kind") - F.least(F.octet_length("name_n"), F.lit(40)) + F.when(F.col("has_departures"), 80).when(F.col("place_kind") >= 300, -350).otherwise(0)
    hits = hits.withColumn("score", score).where("name_n <> ''")
    best = hits.groupBy("query", "name_n").agg(F.min(F.struct((-F.col("score")).alias("s"), "name", "stop_id")).alias("x"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("x.s", "x.name", "x.stop_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "x.stop_id", "x.name", (-F.col("x.s")).alias("score"))


def street_index(addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Streets (street_id, street, postcode, city, name_n, city_n, n_addresses, lat, lon) and postings (prefix, street_id)."""
    streets = addresses.groupBy("street", "postcode", "city").agg(F.count("*").alias("n_addresses"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    streets = streets.withColumn("name_n", tx.address_normal(F.col("street"))).withColumn("city_n", tx.address_normal(F.col("city")))
    streets = streets.withColumn("street_id", F.concat_ws(":", "postcode", "city_n", "name_n"))
    words = F.explode(F.array_distinct(F.split(F.concat_ws(" ", "name_n", "city_n"), " ")))
    postings = streets.select("street_id", words.alias("word")).where(F.length("word") >= 3).select(F.substring("word", 1, 3).alias("prefix"), "street_id").distinct()
    return streets, postings


def fuzzy_word(token: Column, hay: Column) -> Column:
    """Some word of ``hay`` is within the token's typo budget."""
    budget = F.when(F.length(token) >= TYPOS[0][0], TYPOS[0][1]).when(F.length(token) >= TYPOS[1][0], TYPOS[1][1]).otherwise(-1)
    near = F.exists(F.split(hay, " "), lambda w: (F.length(w) >= 3) & (F.levenshtein(token, w) <= budget))
    return (budget > 0) & near


def token_score(name: Column, token: Column) -> Column:
    starts = F.startswith(name, token) | F.contains(name, F.concat(F.lit(" "), token))
    return F.when(name == token, 40.0).when(starts, 15.0).when(F.contains(name, token), 8.0).when(fuzzy_word(token, name), 10.0).otherwise(0.0)


def street_score(query: Column, tokens: Column, name: Column, city: Column, postcode: Column, n: Column) -> Column:
    """Score of a street for a normalised query; tokens are those of two letters or more that are no street types."""
    whole = F.when(name == query, 100.0).when(F.startswith(name, query), 80.0).when(F.contains(name, query), 50.0).otherwise(0.0)
    each = F.transform(tokens, lambda t: token_score(name, t))
    names = whole + F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    context = F.aggregate(tokens, F.lit(0.0), lambda a, t: a + F.when(F.contains(city, t), 8.0).otherwise(0.0) + F.when((postcode != "") & F.startswith(postcode, t), 20.0).otherwise(0.0))
    matched = F.size(F.filter(each, lambda x: x > 0))
    coverage = F.when(F.size(tokens) == 0, 1.0).otherwise(matched / F.size(tokens))
    total = (names + context) * (0.5 + 0.5 * coverage)
    return F.when(names <= 0, F.least(total * 0.3, F.lit(9.0))).otherwise(total + F.least(n.cast("double"), F.lit(50.0)) * 0.05)


def address_suggest(addresses: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """(query, rank, kind, label, score): streets, with their house where the query names a number that exists.

    Candidates share a three-letter prefix with a significant word of the query, found by an equi-join on postings;
    streets that meet two words or more come first, others fill up.
    """
    streets, postings = street_index(addresses)
    asks = queries.withColumn("n", tx.split_number(F.col("query"))).select("query", "n.num", "n.rep", tx.expand_street(F.col("n.street")).alias("q"))
    words = F.split("q", " ")
    asks = asks.withColumn("tokens", F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*tx.STREET_TYPES)))
    sought = asks.withColumn("word", F.explode(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*tx.STREET_TYPES) & ~w.isin(*tx.CONNECTIVES))))
    cut = F.substring("word", 1, 3)
    # a letter lost in a word of four: the only typo in the first letters that the buckets can meet
    lost = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(F.substring("word", 1, k - 1), F.substring("word", k + 1, F.lit(3))))
    prefixes = F.explode(F.array_distinct(F.when(F.length("word") == 4, F.concat(F.array(cut), lost)).otherwise(F.array(cut))))
    met = sought.select("query", "word", prefixes.alias("prefix")).join(postings, "prefix").groupBy("query", "street_id").agg(F.count_distinct("word").alias("bits"))
    rows = met.join(asks, "query").join(streets, "street_id")
    rows = rows.withColumn("base", street_score(F.col("q"), F.col("tokens"), F.col("name_n"), F.col("city_n"), F.col("postcode"), F.col("n_addresses"))).where("base > 0")
    house = addresses.groupBy("street", "postcode", "city", F.col("num").cast("string").alias("num")).agg(F.lit(True).alias("has_house"))
    rows = rows.join(house, ["street", "postcode", "city", "num"], "left")
    hit = F.coalesce("has_house", F.lit(False))
    rows = rows.where(F.col("num").isNull() | hit | (F.col("base") > 20))
    score = F.when(hit, F.col("base") + 50).otherwise(F.greatest("base", F.lit(1.0)))
    label = F.concat_ws(" ", F.when(hit, F.col("num")), "street", "postcode", "city")
    rows = rows.select("query", F.when(hit, "address").otherwise("street").alias("kind"), label.alias("label"), score.alias("score"), F.when(F.col("bits") >= 2, 0).otherwise(1).alias("tier"), "street_id")
    tiered = W.partitionBy("query").orderBy("tier").rangeBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("above", F.count("*").over(tiered)).where((F.col("tier") == 0) | (F.col("above") < 3 * limit))
    one = rows.groupBy("query", "label").agg(F.min(F.struct((-F.col("score")).alias("s"), "street_id", "kind")).alias("x"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("x.s", "x.street_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "x.kind", "label", F.round(-F.col("x.s"), 3).alias("score"))


def places(stops: DataFrame, addresses: DataFrame, limit: int = 12) -> DataFrame:
    """Stops, then addresses, of (query, rank, label): half of each, four at least."""
    half = max(4, limit // 2)
    a = stops.where(F.col("rank") <= half).select("query", F.lit("stop").alias("kind"), F.col("name").alias("label"), F.col("rank").alias("r"))
    b = addresses.where(F.col("rank") <= max(4, limit - half)).select("query", "kind", "label", (F.col("rank") + 1000).alias("r"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("r"))
    return a.unionByName(b).withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "kind", "label")
