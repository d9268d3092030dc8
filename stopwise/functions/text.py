"""Text normalisation for search and alerts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with an accent and what they fold to.
ACCENTED = "àáâäãåèéêëìíîïòóôöõùúûüýÿçñÀÁÂÄÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜÝŸÇÑ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycnAAAAAAEEEEIIIIOOOOOUUUUYYCN"
# Leading and trailing words that a place name may lose, and words that do not count.
PLACE_PREFIXES = ("gare de ", "gare d'", "gare d’", "station ", "arret ", "arrêt ")
PLACE_SUFFIXES = (" rer", " metro", " métro", " tram", " bus")
PLACE_STOP_WORDS = ("de", "la", "le", "les")
# Abbreviations in street names.
STREET_WORDS = {
    "r": "rue", "r.": "rue", "av": "avenue", "av.": "avenue", "ave": "avenue", "bd": "boulevard", "bd.": "boulevard", "boul": "boulevard", "boul.": "boulevard",
    "pl": "place", "pl.": "place", "imp": "impasse", "imp.": "impasse", "all": "allee", "all.": "allee", "ch": "chemin", "ch.": "chemin", "che": "chemin",
    "rte": "route", "rte.": "route", "st": "saint", "ste": "sainte", "fg": "faubourg", "fg.": "faubourg", "sq": "square", "sq.": "square", "crs": "cours", "qu": "quai", "qu.": "quai",
}
# Words of street types, connecting words, repetition marks of house numbers.
STREET_TYPES = "rue avenue boulevard place impasse allee chemin route square cours quai faubourg passage residence lotissement sentier villa cite promenade esplanade voie de du des la le les et".split()
CONNECTIVES = "sur sous sans les aux l".split()
REPETITIONS = "bis ter quater a b c d e f".split()
# Languages of alert texts in the order in which they are preferred.
LANGUAGES = ("fr", "fr-fr", "fr_fr", "en", "en-gb", "en-us", "und", "")
# Entities of alert texts.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def fold_accents(text: Column) -> Column:
    """Accents off, case kept."""
    out = F.translate(text, ACCENTED, PLAIN)
    for a, b in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize(text: Column) -> Column:
    return F.lower(fold_accents(text))


def place_key(name: Column) -> Column:
    """One key for the spellings of a place: a leading 'station of' and trailing modes off, small words out."""
    low = normalize(name)
    prefixes = "|".join(sorted({p for p in PLACE_PREFIXES if p == p.encode("ascii", "ignore").decode() or "’" in p}, key=len, reverse=True))
    out = F.regexp_replace(low, f"^(?:{prefixes})", "")
    for suffix in PLACE_SUFFIXES:
        if suffix.isascii():
            out = F.regexp_replace(out, suffix + "$", "")
    words = F.filter(F.split(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), " "), lambda w: (w != "") & ~w.isin(*PLACE_STOP_WORDS))
    return F.array_join(words, " ")


def address_normal(text: Column) -> Column:
    """Folded, lower case, everything but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(normalize(text), r"[^\p{L}\p{N}]+", " "))


def expand_street(text: Column) -> Column:
    words = F.create_map(*(F.lit(x) for pair in STREET_WORDS.items() for x in pair))
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(words, w), w)), " ")


def split_number(query: Column) -> Column:
    """Struct (num, rep, street): leading house number with its repetition mark, and the rest; without a number num is null."""
    q = F.trim(query)
    first = F.element_at(F.split(q, r"\s+"), 1)
    has = first.rlike("^[0-9]")
    num = F.regexp_extract(first, r"^([0-9]+)", 1)
    own = F.lower(F.regexp_replace(F.substring(first, F.length(num) + 1, F.length(first)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    rest = F.filter(F.slice(F.split(q, r"\s+"), 2, 1000), lambda w: w != "")
    second = F.lower(F.get(rest, F.lit(0)))
    takes = (own == "") & F.coalesce(second.isin(*REPETITIONS), F.lit(False))
    rep = F.when(takes, second).otherwise(own)
    street = F.when(has, address_normal(F.array_join(F.when(takes, F.slice(rest, 2, 1000)).otherwise(rest), " "))).otherwise(address_normal(q))
    return F.struct(F.when(has, num).alias("num"), F.when(has, rep).alias("rep"), street.alias("street"))


def match_kind(hay: Column, needle: Column) -> Column:
    """3 prefix, 2 at a word's start (after anything but an ASCII letter or digit), 1 within, 0 none."""
    quoted = F.concat(F.lit(r"(^|[^A-Za-z0-9])\Q"), needle, F.lit(r"\E"))
    inside = F.when(F.contains(hay, needle), F.when(F.regexp_like(hay, quoted), F.lit(2)).otherwise(F.lit(1))).otherwise(F.lit(0))
    return F.when(needle == "", F.lit(0)).when(F.startswith(hay, needle), F.lit(3)).otherwise(inside)


def clean_html(text: Column) -> Column:
    """Tags out, a few entities decoded, tags that these leave out as well, white space to single spaces."""
    out = F.regexp_replace(text, r"<[^>]*(>|$)", " ")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*(>|$)", " "), r"\s+", " "))


def dedupe_key(header: Column, description: Column) -> Column:
    low = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (header, description)]
    return F.concat(low[0], F.lit("|"), F.substring(low[1], 1, 160))


def pick_translation(translations: Column) -> Column:
    """Text of the preferred language in array<struct<lang, text>>: the fixed order, then any but German, then the first."""

    def rank(t: Column) -> Column:
        lang, out = F.lower(F.trim(F.coalesce(t["lang"], F.lit("")))), F.lit(100)
        out = F.when(F.startswith(lang, F.lit("de")), F.lit(200)).otherwise(out)
        for k, name in reversed(list(enumerate(LANGUAGES))):
            out = F.when(lang == name, F.lit(k)).otherwise(out)
        return F.when(F.trim(F.coalesce(t["text"], F.lit(""))) == "", F.lit(300)).otherwise(out)

    ranked = F.transform(translations, lambda t, k: F.struct(rank(t).alias("rank"), k.alias("at"), t["text"].alias("text")))
    best = F.array_min(ranked)
    chosen = F.when(best["rank"] < 200, best["text"]).otherwise(F.get(translations, F.lit(0))["text"])
    return F.nullif(clean_html(chosen), F.lit(""))


def humanize_ref(ref: Column) -> Column:
    """Last segment of a reference that says something: no date, no filler."""
    parts = F.filter(F.reverse(F.split(ref, r"[:@]")), lambda p: (p != "") & ~p.rlike("^[0-9]{8}$") & ~p.isin("LOC", "VehicleJourney", "Line", "OP"))
    return F.get(parts, F.lit(0))


def repetition_fits(asked: Column, held: Column) -> Column:
    """Whether an address's repetition is what is asked: nothing asked takes any, one letter what begins with it (b: bis)."""
    a, h = F.lower(F.coalesce(asked, F.lit(""))), F.lower(F.coalesce(held, F.lit("")))
    return (a == "") | (a == h) | ((F.length(a) == 1) & F.startswith(h, a))


def stop_ref_keys(feed: Column, ref: Column) -> Column:
    """Names under which a stop that a live feed names so may be filed, in the order in which they are tried."""
    said = F.when(F.contains(ref, F.lit(":")), ref).otherwise(F.concat(feed, F.lit(":"), ref))
    quay = F.regexp_extract(ref, ":Q:([0-9]{4,})", 1)
    digits = F.when(quay != "", quay).otherwise(F.regexp_extract(ref, "([0-9]+)$", 1))
    # fixed values: places of the number in stop names
    forms = ("{f}:{d}", "{f}:IDFM:{d}", "{f}:IDFM:monomodalStopPlace:{d}", "{f}:IDFM:StopPoint:{d}", "IDFM:{d}", "IDFM:monomodalStopPlace:{d}", "StopPoint:{d}", "{d}", "idfm:IDFM:monomodalStopPlace:{d}", "idfm:IDFM:{d}")
    made = F.array(*(F.replace(F.replace(F.lit(form), F.lit("{f}"), feed), F.lit("{d}"), digits) for form in forms))
    return F.array_distinct(F.concat(F.array(ref, said), F.when(F.length(digits) >= 4, made).otherwise(F.array().cast("array<string>"))))


def product_code(ref: Column) -> Column:
    """``C`` and five or more digits anywhere in a reference."""
    return F.nullif(F.regexp_extract(ref, r"\b(C[0-9]{5,8})\b", 1), F.lit(""))
