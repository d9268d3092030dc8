"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Text becomes tokens: runs of letters and digits in lower case. A template replaces values by typed
placeholders: numbers, units after a number, and names (capitalised inside a sentence). Items of one template whose equal
values stand in equal places are one *class*; findings are rows (document, class), the class named by its least item id, so that
items of one template do not multiply the documents. ``item_classes`` gives the members.

Templates. Windows of ``WINDOW`` template tokens (the whole item where it is shorter, ``SHORTEST`` tokens at least) with
``LITERALS`` literal tokens or more are hashed and joined with those of the documents. The values that a document holds in a class's
placeholders must be consistent: one item value stands for one document value wherever the matched windows have it, and different
names stay different. Windows that break this do not count. A document holds a class when consistent windows cover ``COVER`` of its
windows. This is judged for each occurrence, so that several variants of a template in a document do not outvote each other: windows of
one shift (their place less that in the item), windows of shifts less than an item's length apart (a copy with words put in or left
out), and all of the document (a copy in pieces); the occurrence with most windows is reported.

Whole items. Every item, however short and whatever it is made of, is also looked for as it stands (its tokens with
their values). Items of one or two tokens are ordinary words, so they are found only as a whole document. ``exact_slots`` tells whether an item
of the class stands there so; ``exact_item_id`` is the least such. Otherwise the values are re-parameterised or parts are missing.
Not searched for are other values in items without a template window: shorter than ``SHORTEST``, or of too few literal tokens.

Join. A document that holds half of a class's windows has one of any half and one more, so only that many are *probes*, those that
fewest classes share. Documents look their tokens up among the probes' longest literal tokens (anchors), at most one row for each pair of offset
and width, and windows are hashed only around those. Only documents that meet a probe go on. The benchmark's tables are broadcast while
their checked number is below ``BROADCAST_WINDOWS``; beyond it the joins are shuffled.

Edge cases: null, empty and blank texts on either side match nothing; repeated items are one class; repeated documents
are reported each; no text is cut; columns of ``docs`` other than id and text are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, if_small, row_key

WINDOW, COVER, LITERALS = 8, 0.5, 5
BROADCAST_WINDOWS = 200_000
SHORTEST = 5
#: Items of fewer tokens are found only where they are the whole document.
ALONE = 3
# Units that follow a number.
UNITS = (
    "km m cm mm mile miles foot feet inch inches yard yards kg g mg pound pounds lb lbs ounce ounces ton tons "
    "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "liter liters litre litres gallon gallons degree degrees mph kmh volts watts kwh "
    "meter metern kilometer kilo tonne tonnen gramm sekunde sekunden stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren grad prozent "
    "mètre mètres kilomètre kilomètres gramme grammes seconde secondes heure heures jour jours semaine semaines mois an ans degré degrés "
    "metro metros kilómetro kilómetros gramo gramos segundo segundos minuto minutos hora horas día días semana semanas mes meses año años litro litros grado grados"
).split()
NUM, UNIT, NAME = "\x01", "\x02", "\x03"
_MARKS = f"'{NUM}{UNIT}{NAME}'"


def canonical(text: Column, values: bool = False) -> Column:
    """Text as space-separated template tokens. With ``values``, a placeholder's token goes on with the value it stands for.

    Each pattern begins with a character that is rare or literal, so that most places fail at once.
    """
    held = (lambda value: value) if values else (lambda value: "")
    odd = F.contains(text, F.lit(NUM)) | F.contains(text, F.lit(UNIT)) | F.contains(text, F.lit(NAME))
    out = F.when(odd, F.regexp_replace(text, f"[{NUM}{UNIT}{NAME}]", " ")).otherwise(text)
    out = F.regexp_replace(out, r" (?<=[\p{Ll},] )(\p{Lu}\p{Ll}\p{L}*)", f" {NAME}{held('$1')}")
    out = F.lower(out)
    out = F.regexp_replace(out, r"[.,](?<=[0-9][.,])(?=[0-9])", "·")
    out = F.regexp_replace(out, r"[0-9](?<![\p{L}\p{N}·][0-9])[0-9·]*", f" {NUM}{held('$0')} ")
    units = "|".join(sorted(set(UNITS), key=lambda u: (-len(u), u)))
    out = F.regexp_replace(out, rf"({NUM}[0-9·]* +)({units})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}{held('$2')}")
    return F.trim(F.regexp_replace(out, rf"[^a-z0-9\p{{L}}\p{{N}}·{NUM}{UNIT}{NAME}]+", " "))


def tokens(text: Column) -> Column:
    """Tokens with their values; none for a null, empty or blank text."""
    return F.filter(F.split(F.coalesce(canonical(text, True), F.lit("")), " "), lambda x: x != "")


def _plain(v: str = "v") -> str:
    """Tokens as they stand, without the marks of placeholders."""
    return f"transform({v}, x -> trim(leading {_MARKS} from x))"


def _template(v: str = "v") -> str:
    return f"transform({v}, x -> if(startswith(x, '{NUM}') or startswith(x, '{UNIT}') or startswith(x, '{NAME}'), left(x, 1), x))"


def _hashed(tokens: str, start: str, width: str, sign: str = "") -> str:
    return f"xxhash64({sign}{width}, array_join(slice({tokens}, {start}, {width}), ' '))"


def _both(value: str) -> Column:
    return F.expr(f"struct(xxhash64({value}) as a, xxhash64(1, {value}) as b)")


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, class, pattern, p): the class of each item with a token; ``pattern`` has numbered placeholders, ``p`` its tokens as they stand."""
    rows = benchmark.select("item_id", tokens(F.col("text")).alias("v")).where(F.size("v") > 0)
    numbered = "transform(v, x -> if(trim(leading " + _MARKS + " from x) = x, x, concat(left(x, 1), array_position(v, x))))"
    return rows.select("item_id", F.expr(_plain()).alias("p"), F.expr(numbered).alias("pattern")).withColumn("class", _both("array_join(pattern, ' ')"))


def class_windows(classes: DataFrame) -> DataFrame:
    """(class, length, n_windows, at, width, h, anchor, offset, ids, probe) of (class, pattern): template windows with enough literal tokens.

    ``anchor`` is a window's longest literal token, the rarest as a rule; it stands ``offset`` tokens from the start.
    """
    rows = classes.withColumn("t", F.expr(_template("pattern"))).withColumn("width", F.least(F.size("t"), F.lit(WINDOW))).where(F.col("width") >= SHORTEST)
    literal = f"filter(transform(x.w, (y, k) -> struct(-length(y) as l, y, k)), z -> z.y not in ('{NUM}', '{UNIT}', '{NAME}'))"
    rows = rows.withColumn("windows", F.expr("transform(sequence(0, size(t) - width), i -> struct(i as at, slice(t, i + 1, width) as w, slice(pattern, i + 1, width) as ids))"))
    rows = rows.withColumn("windows", F.expr(f"filter(windows, x -> size({literal}) >= least({LITERALS}, width))"))
    rows = rows.withColumn("windows", F.expr(f"transform(windows, x -> struct(x.at, x.w, x.ids, array_min({literal}) as anchor))"))
    rows = rows.select("class", F.size("t").alias("length"), "width", F.size("windows").alias("n_windows"), F.explode("windows").alias("x"))
    h = F.expr("xxhash64(width, array_join(x.w, ' '))")
    rows = rows.select("class", "length", "n_windows", "x.at", "width", h.alias("h"), F.col("x.anchor.y").alias("anchor"), F.col("x.anchor.k").alias("offset"), F.col("x.ids").alias("ids"))
    shared = rows.groupBy("h").agg(F.count_distinct("class").alias("shared"))
    rank = F.row_number().over(W.partitionBy("class").orderBy("shared", F.desc(F.length("anchor")), "at"))
    needed = F.col("n_windows") - F.ceil(COVER * F.col("n_windows")) + 1
    return rows.join(shared, "h").withColumn("probe", rank <= needed).drop("shared")


def whole_items(members: DataFrame) -> DataFrame:
    """(class, exact_item_id, length, whole, at, width, h, anchor, offset): each different item of a class with the window around its longest token."""
    rows = members.withColumn("whole", _both("array_join(p, ' ')")).groupBy("class", "whole").agg(F.min("item_id").alias("exact_item_id"), F.min("p").alias("p"))
    rows = rows.withColumn("length", F.size("p")).withColumn("width", F.least("length", F.lit(WINDOW)))
    rows = rows.withColumn("k", F.expr("array_min(transform(p, (y, k) -> struct(-length(y) as l, k as k))).k"))
    rows = rows.withColumn("at", F.expr(f"greatest(0, least(k - {WINDOW // 2}, length - width))"))
    rows = rows.withColumn("h", F.expr(_hashed("p", "at + 1", "width", "-"))).withColumn("anchor", F.expr("p[k]"))
    return rows.select("class", "exact_item_id", "length", "whole", "at", "width", "h", "anchor", (F.col("k") - F.col("at")).alias("offset"))


def met_by_anchor(docs: DataFrame, probes: DataFrame, key: Column) -> DataFrame:
    """Keys of the documents that hold a probe: each token is looked up among the anchors, windows are hashed only around those.

    The probes are broadcast; the caller has checked their number. A token meets one row for each offset and width of its anchor.
    """
    rows = docs.select(key.alias("key"), tokens(F.col("text")).alias("v")).select("key", F.expr(_template()).alias("t"), F.expr(_plain()).alias("p"))
    # outer: else a filter on the array's size would work the text out again
    rows = rows.select("key", "t", "p", F.posexplode_outer("p").alias("place", "token"))
    around = F.broadcast(probes.select("anchor", "kind", "offset", "width").distinct())
    rows = rows.join(around, (F.col("token") == F.col("anchor")) & F.expr("place >= offset and place - offset + width <= size(p)"))
    start = "place - offset + 1"
    rows = rows.select("key", F.expr(f"if(kind = 't', {_hashed('t', start, 'width')}, {_hashed('p', start, 'width', '-')})").alias("h"))
    return rows.join(F.broadcast(probes.select("h").distinct()), "h", "left_semi").select("key")


def _all_windows(kind: str, width: int, more: str = "") -> Column:
    """Each window of a document as a struct of place, width, h and ``more``."""
    tokens, sign = ("t", "") if kind == "t" else ("p", "-")
    made = f"struct(cast(i as int) as place, {width} as width, {_hashed(tokens, 'i + 1', str(width), sign)} as h{more})"
    return F.expr(f"case when size(p) >= {width} then transform(sequence(0, size(p) - {width}), i -> {made}) else array() end")


def met_by_hash(docs: DataFrame, probes: DataFrame, key: Column, widths: list[tuple[str, int]]) -> DataFrame:
    """The same for a benchmark of any size: the hashes of all windows go through a shuffled join."""
    rows = docs.select(key.alias("key"), tokens(F.col("text")).alias("v")).select("key", F.expr(_template()).alias("t"), F.expr(_plain()).alias("p"))
    each = [F.transform(_all_windows(kind, width), lambda x: x["h"]) for kind, width in widths]
    rows = rows.select("key", F.explode_outer(F.array_distinct(F.concat(*each))).alias("h"))
    return rows.join(probes.select("h").distinct(), "h", "left_semi").select("key")


def consistent(pairs: DataFrame) -> DataFrame:
    """(key, class, n_windows, n_matched) of matched windows (key, class, place, at, length, n_windows, ids, doc_values): the best occurrence."""
    marked = f"startswith(x.a, '{NUM}') or startswith(x.a, '{UNIT}') or startswith(x.a, '{NAME}')"
    slots = F.expr(f"filter(transform(arrays_zip(ids, doc_values), x -> struct(x.ids as a, x.doc_values as b)), x -> {marked})")
    # occurrences: the whole document, one shift, and shifts in two grids of an item's length, so that near ones share a cell
    shift = "place - at"
    cells = f"array(struct(0 as kind, 0L as cell), struct(1 as kind, cast({shift} as long) as cell), struct(2 as kind, floor(({shift}) / length) as cell), struct(3 as kind, floor(({shift}) / length + 0.5) as cell))"
    pairs = pairs.select("key", "class", "n_windows", "at", slots.alias("slots"), F.explode(F.expr(cells)).alias("part"))
    group = ["key", "class", "part"]
    votes = pairs.select(*group, F.explode("slots").alias("s")).groupBy(*group, F.col("s.a").alias("a"), F.col("s.b").alias("b")).agg(F.count("*").alias("n"))
    # of several document values for one item value the most frequent counts, then the least
    chosen = votes.groupBy(*group, "a").agg(F.min_by(F.struct("b", "n"), F.struct(-F.col("n"), F.col("b"))).alias("x")).select(*group, "a", "x.b", "x.n")
    # of several names for one document name the most frequent keeps it, then the first
    name = F.when(F.col("a").startswith(NAME), F.col("b")).otherwise(F.col("a"))
    chosen = chosen.groupBy(*group, name.alias("name")).agg(F.min_by(F.struct("a", "b"), F.struct(-F.col("n"), F.length("a"), F.col("a"))).alias("x"))
    chosen = chosen.groupBy(*group).agg(F.map_from_entries(F.collect_list("x")).alias("values"))
    judged = pairs.join(chosen, group, "left").where(F.expr("forall(slots, s -> coalesce(values[s.a] = s.b, false))"))
    found = judged.groupBy(*group, "n_windows").agg(F.count_distinct("at").alias("n_matched"))
    found = found.where(F.col("n_matched") >= COVER * F.col("n_windows"))
    return found.groupBy("key", "class", "n_windows").agg(F.max("n_matched").alias("n_matched"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, n_items, n_windows, n_matched, exact_slots, exact_item_id): documents that hold a class of items.

    ``key`` stands for id and text; equal rows share it.
    """
    key = row_key("doc_id", "text")
    members = cut_lineage(item_classes(benchmark))
    classes = members.groupBy("class").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.min("pattern").alias("pattern"))
    classes = cut_lineage(classes)
    windows, whole = cut_lineage(class_windows(classes)), cut_lineage(whole_items(members))
    columns = ["kind", "anchor", "offset", "width", "h"]
    probes = cut_lineage(windows.where("probe").withColumn("kind", F.lit("t")).select(columns).union(whole.withColumn("kind", F.lit("x")).select(columns)).distinct())
    small = probes.count() + windows.count() <= BROADCAST_WINDOWS
    widths = sorted((r[0], r[1]) for r in probes.select("kind", "width").distinct().collect())  # 2 * WINDOW values at most
    light = F.broadcast if small else lambda df: df
    # stage 1: which documents meet a probe
    if not widths:
        met = docs.limit(0).select(key.alias("key"))
    else:
        met = met_by_anchor(docs, probes, key) if small else met_by_hash(docs, probes, key, widths)
    near = cut_lineage(met.distinct())
    # stage 2: the windows of those few
    few = docs.select(key.alias("key"), "text").join(if_small(near), "key", "left_semi").dropDuplicates(["key"])
    few = cut_lineage(few.select("key", tokens(F.col("text")).alias("v")).select("key", "v", F.expr(_template()).alias("t"), F.expr(_plain()).alias("p")))
    none = F.expr("array(struct(0 as place, 0 as width, 0L as h))")
    plain = [_all_windows("x", w) for k, w in widths if k == "x"] or [F.slice(none, 1, 0)]
    at = few.select("key", F.size("p").alias("size"), F.explode(F.concat(*plain)).alias("x")).select("key", "size", "x.place", "x.width", "x.h")
    tried = at.join(light(whole), ["width", "h"]).where((F.col("length") >= ALONE) | (F.col("size") == F.col("length")))
    tried = tried.withColumn("shift", F.col("place") - F.col("at")).where("shift >= 0 and shift + length <= size")
    tried = cut_lineage(tried.select("key", "class", "exact_item_id", "whole", "length", "shift").distinct())
    exact = few.select("key", "p").join(if_small(tried), "key").where(_both("array_join(slice(p, shift + 1, length), ' ')") == F.col("whole"))
    exact = exact.groupBy("key", "class").agg(F.min("exact_item_id").alias("exact_item_id"))
    none = F.expr("array(struct(0 as place, 0 as width, 0L as h, array('') as v))")
    shaped = [_all_windows("t", w, f", slice(v, i + 1, {w}) as v") for k, w in widths if k == "t"] or [F.slice(none, 1, 0)]
    held = few.select("key", F.explode(F.concat(*shaped)).alias("x")).select("key", "x.place", "x.width", "x.h", F.col("x.v").alias("doc_values"))
    held = cut_lineage(held.join(light(windows.select("width", "h").distinct()), ["width", "h"], "left_semi"))
    asked = held.join(light(windows.where("probe").select("width", "h", "class")), ["width", "h"]).select("key", "class").distinct()
    pairs = asked.join(light(windows.drop("anchor", "offset", "probe")), "class").join(held, ["key", "width", "h"])
    shaped = consistent(pairs)
    found = shaped.withColumnRenamed("n_windows", "n").join(exact.withColumn("exact_slots", F.lit(True)), ["key", "class"], "full")
    counts = windows.groupBy("class").agg(F.max("n_windows").alias("n_windows"))
    found = found.join(light(classes.join(counts, "class", "left").select("class", "item_id", "n_items", F.coalesce("n_windows", F.lit(0)).alias("n_windows"))), "class")
    # a whole item has all its windows, whatever the words around it make of its names
    matched = F.when(F.col("exact_slots"), F.col("n_windows")).otherwise(F.col("n_matched")).cast("int")
    return found.select("key", "item_id", "n_items", "n_windows", matched.alias("n_matched"), F.coalesce("exact_slots", F.lit(False)).alias("exact_slots"), "exact_item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_items, ...): one row for each document and class of items that it holds, for each row of ``docs``; equal rows share their finding."""
    found = leaks(docs, benchmark)
    return docs.select("doc_id", row_key("doc_id", "text").alias("key")).join(if_small(cut_lineage(found)), "key").drop("key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    found = cut_lineage(leaks(docs, benchmark).select("key").distinct())
    key = row_key("doc_id", "text")
    return docs.join(if_small(found), key == found["key"], "left_anti")
