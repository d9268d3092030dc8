"""Names and colours that riders know, and the spellings of references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product codes of lines and the short names they go by.
PRODUCT_NAMES = {
    "C01742": "A", "C01743": "B", "C01727": "C", "C01728": "D", "C01729": "E", "C01371": "1", "C01372": "2", "C01373": "3", "C01374": "4", "C01375": "5", "C01376": "6", "C01377": "7", "C01378": "8", "C01379": "9",
    "C01380": "10", "C01381": "11", "C01382": "12", "C01383": "13", "C01384": "14", "C01389": "T1", "C01390": "T2", "C01391": "T3a", "C01679": "T3b", "C01684": "T4", "C01690": "T5", "C01794": "T6", "C01774": "T7",
    "C01795": "T8", "C01999": "T9", "C02317": "T10", "C01928": "T11", "C01995": "T12", "C02344": "T13",
}
# Colours of lines by short name, and whether their text is black.
PALETTE = {
    "A": "EB2132", "B": "5091CB", "C": "FFCC30", "D": "008B5B", "E": "B94E9A", "1": "FFBE00", "2": "0055C8", "3": "6E6E00", "3BIS": "6EC4E8", "3B": "6EC4E8", "4": "A0006E", "5": "FF7E2E", "6": "6ECA97", "7": "FF82B4", "7BIS": "6ECA97",
    "7B": "6ECA97", "8": "D282BE", "9": "B6BD00", "10": "C9910D", "11": "704B1C", "12": "007852", "13": "6EC4E8", "14": "640082", "T1": "0055C8", "T2": "CF009E", "T3A": "FF7E2E", "T3B": "00AE41", "T4": "F68F4B", "T5": "6E6E00",
    "T6": "E2231A", "T7": "704B1C", "T8": "C5A3CD", "T9": "4CC4F2", "T10": "6E6E00", "T11": "F58400", "T12": "A50034", "T13": "8D5E2A", "H": "7B5840", "J": "CDCD00", "K": "C5A3CD", "L": "7575C9", "N": "00A092", "P": "F0B600",
    "R": "E4B4D0", "U": "D3403B", "V": "9F9825",
}
BLACK_TEXT = frozenset("C 1 3BIS 3B 5 6 7 7BIS 7B 8 9 10 13 T3A T4 T8 T9 T11 J K P R".split())
# Segments of references that say nothing.
SILENT = ("STIF", "RATP", "RATP-SIV", "IDFM", "SNCF", "LINE", "STOPPOINT", "STOPAREA", "VEHICLEJOURNEY", "DATEDVEHICLEJOURNEY", "OPERATOR", "Q", "S")
# Operators as the two kinds of reference spell them.
OPERATORS = {"SNCF": "SNCF_MAGENTA_PRD", "RATP": "RATP-SIV", "STIF": "stif"}
# Words that tell that a line is named as advice, not as the subject.
ADVICE = ("PRIVILEGIE", "SATURATION", "REPORTEZ", "REPORTER", "UTILISEZ", "EMPRUNTEZ", "EN DIRECTION DE LA LIGNE", "VERS LA LIGNE", "CORRESPONDANCE AVEC")
RAIL_LIKE = ("RAIL", "TRAIN", "METRO", "SUBWAY", "TRAM", "TRAMWAY", "RER")


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def is_date_like(text: Column) -> Column:
    return text.rlike("^[0-9]{8}$")


def _usable(text: Column) -> Column:
    t = F.trim(text)
    return F.when((t != "") & ~is_date_like(t), t)


def product_short_name(code: Column) -> Column:
    return _looked_up(PRODUCT_NAMES, F.upper(code))


def human_ref(ref: Column) -> Column:
    """Last segment of a reference that a person can use; without one the last that is no date."""
    parts = F.reverse(F.filter(F.transform(F.split(ref, "[:/@]"), lambda p: F.trim(p)), lambda p: p != ""))
    good = F.filter(parts, lambda p: ~F.upper(p).isin(*SILENT) & ~is_date_like(p) & p.rlike("[A-Za-z0-9]") & (p.rlike("[0-9]") | (F.octet_length(p) < 24)))
    return F.coalesce(F.get(good, F.lit(0)), F.get(F.filter(parts, lambda p: ~is_date_like(p)), F.lit(0)))


def display_label(trip_name: Column, label: Column, route: Column, headsign: Column, trip_ref: Column) -> Column:
    """Trip name, else label, else route and head sign, else what the reference tells, else ``train``."""
    r, h = _usable(route), _usable(headsign)
    both = F.when(r.isNotNull() & h.isNotNull(), F.concat(r, F.lit(" → "), F.substring(h, 1, 24)))
    return F.coalesce(_usable(trip_name), _usable(label), both, r, F.substring(h, 1, 32), _usable(human_ref(trip_ref)), F.lit("train"))


def map_label(mode: Column, trip_name: Column, label: Column, route: Column, long_name: Column, headsign: Column, trip_ref: Column) -> Column:
    """Product and line as on a map: train brands, RER, Transilien, metro, tram, bus; else the display label."""
    e = F.lit("")
    blob = F.lower(F.concat_ws(" ", F.coalesce(long_name, e), F.coalesce(label, e), F.coalesce(route, e), F.coalesce(trip_name, e)))
    name, r, long = F.nullif(F.trim(trip_name), e), F.trim(F.coalesce(route, e)), F.trim(F.coalesce(long_name, e))
    brand = (
        F.when(F.contains(blob, F.lit("ouigo")), F.concat_ws(" ", F.lit("Ouigo"), F.coalesce(name, F.nullif(r, e))))
        .when(blob.rlike("inoui|in oui"), F.concat_ws(" ", F.lit("TGV InOui"), name))
        .when(F.contains(blob, F.lit("tgv")) & name.isNotNull(), F.concat(F.lit("TGV "), name))
    )
    letter = F.upper(F.nullif(F.regexp_extract(long, r"^(?:RER|rer)\s*([A-Za-z])", 1), e))
    rer = F.when(letter.isNotNull(), F.concat(F.lit("RER "), letter)).when(F.upper(r).rlike("^[A-E]$") & (mode.isNull() | (mode == "RAIL")), F.concat(F.lit("RER "), F.upper(r)))
    upper = F.upper(long)
    suburban = F.when(F.contains(upper, F.lit("TRANSILIEN")), F.coalesce(F.nullif(F.regexp_extract(upper, "(?:TRANSILIEN|LIGNE) ([HJKLNPRUV])", 1), e), F.when(F.length(r) == 1, F.upper(r))))
    number = F.coalesce(F.when(r.rlike("^(?:[1-9]|1[0-4])$"), r), F.nullif(F.regexp_extract(long, r"(?:^|\s)([1-9]|1[0-4])(?=\s|$)", 1), e))
    metro = F.when((mode == "METRO") & number.isNotNull(), F.concat(F.lit("Métro "), number))
    car = F.when(F.upper(r).rlike("^T.+"), r).when(F.contains(upper, F.lit("T")), F.regexp_extract(long, r"([Tt]\S*)", 1)).when(r != "", F.concat(F.lit("T"), r))
    tram = F.when((mode == "TRAM") & car.isNotNull(), F.concat(F.lit("Tram "), car))
    bus = F.when(mode.isin("BUS", "COACH") & (r != "") & (~F.startswith(r, F.lit("C")) | (F.length(r) > 6)), F.concat(F.lit("Bus "), r))
    return F.coalesce(brand, rer, F.concat(F.lit("Transilien "), suburban), metro, tram, bus, display_label(trip_name, label, route, headsign, trip_ref))


def line_colors(short_name: Column, color: Column, text_color: Column) -> Column:
    """Struct (color, text_color): the feed's colours, else those of the palette; black or white text by luminance where none is given."""
    from .geo import contrast_text

    own, key = F.nullif(F.trim(color), F.lit("")), F.regexp_replace(F.upper(F.trim(short_name)), "^(T1[1-3]) EXPRESS$", "$1")
    known = _looked_up(PALETTE, key)
    text = F.when(own.isNotNull(), F.coalesce(F.nullif(F.trim(text_color), F.lit("")), contrast_text(own), F.lit("FFFFFF"))).when(known.isNotNull(), F.when(key.isin(*BLACK_TEXT), "000000").otherwise("FFFFFF"))
    return F.struct(F.coalesce(own, known).alias("color"), text.alias("text_color"))


def alert_blob(*parts: Column) -> Column:
    """Upper case without accents, for finding line names."""
    from .text import fold_accents

    return F.upper(fold_accents(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))))


def lines_in_text(blob: Column) -> Column:
    """Lines that a folded text names: RER letters, metro numbers near a word for line, trams."""
    found = [F.when(blob.rlike(f"RER ?{x}"), F.lit(x)) for x in "ABCDE"]
    context = F.contains(blob, F.lit("LIGNE")) | F.contains(blob, F.lit("METRO"))
    found += [F.when(blob.rlike(rf"METRO ?{n}|LIGNES? {n}") | (context & blob.rlike(rf" {n}[ .,]| {n}$|ET {n}")), F.lit(str(n))) for n in range(1, 15)]
    found += [F.when(F.contains(blob, F.lit(f"T{n}")) & (F.contains(blob, F.lit("TRAM")) | F.contains(blob, F.lit(f" T{n}"))), F.lit(f"T{n}")) for n in range(1, 14)]
    return F.array_compact(F.array(*found))


def named_as_advice(blob: Column, line: Column) -> Column:
    """The line stands within 48 letters after or 24 before words of advice, or such words and a leading subject are there at all."""
    words = "|".join(ADVICE)
    token = F.concat(F.lit(r"(?:LIGNES? |METRO | ET | )\Q"), line, F.lit(r"\E(?![A-Z0-9])"))
    near = F.regexp_like(blob, F.concat(F.lit(f"(?:{words}).{{0,48}}?"), token)) | F.regexp_like(blob, F.concat(token, F.lit(f".{{0,24}}(?:{words})")))
    return near | (blob.rlike(words) & F.contains(blob, line) & blob.rlike("RER |TRAVAUX SUR"))


def is_subject(blob: Column, line: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), line, F.lit(r"\E"))
    return F.regexp_like(blob, F.concat(F.lit("(?:RER ?|METRO |TRAVAUX SUR LES? RER |INCIDENT LIGNE )"), quoted)) | F.regexp_like(blob, F.concat(F.lit("LIGNE "), quoted, F.lit(" (?::|-|INTERRUPT|TRAFIC)")))


def alert_fits_leg(header: Column, description: Column, line: Column, mode: Column) -> Column:
    """Whether an alert's text can be about a leg: no road traffic for rail, and the line named as the subject if lines are named."""
    blob = alert_blob(header, description)
    lines, own = lines_in_text(blob), F.upper(F.trim(F.coalesce(line, F.lit(""))))
    other_subject = F.exists(lines, lambda m: (m != own) & is_subject(blob, m))
    fits = (own == "") | (F.size(lines) == 0) | (F.array_contains(lines, own) & ~(named_as_advice(blob, own) & other_subject))
    return ~(road_traffic(blob) & F.upper(F.coalesce(mode, F.lit(""))).isin(*RAIL_LIKE)) & fits


def road_traffic(blob: Column) -> Column:
    return F.contains(blob, F.lit("TRAFIC ROUTIER")) | (blob.rlike("ARRET") & blob.rlike("DEPLAC") & blob.rlike("CIRCULATION"))


def siri_label(number: Column, line: Column, destination: Column, vehicle_ref: Column, trip_ref: Column) -> Column:
    n, line, to = (F.nullif(F.trim(x), F.lit("")) for x in (number, line, destination))
    route = F.when(line.isNotNull() & to.isNotNull(), F.concat(line, F.lit(" → "), to))
    return F.coalesce(F.when(n.isNotNull(), F.concat_ws(" ", n, F.coalesce(route, line, F.concat(F.lit("→ "), to)))), route, to, line, human_ref(vehicle_ref), human_ref(trip_ref), vehicle_ref)


def siri_journey_ref(netex: Column) -> Column:
    """``OP:ServiceJourney:ID:LOC`` as the reference that live feeds use."""
    op, kind = F.split_part(netex, F.lit(":"), F.lit(1)), F.upper(F.split_part(netex, F.lit(":"), F.lit(2)))
    return F.when(kind.isin("SERVICEJOURNEY", "VEHICLEJOURNEY") & journey_id(netex).isNotNull(), F.concat(F.coalesce(_looked_up(OPERATORS, F.upper(op)), F.upper(op)), F.lit(":VehicleJourney::"), journey_id(netex), F.lit(":LOC")))


def journey_id(code: Column) -> Column:
    """Bare id of a journey in either spelling."""
    live = F.regexp_replace(F.regexp_replace(F.regexp_extract(code, "::(.*)$", 1), ":+$", ""), "(:LOC)+$", "")
    static = F.regexp_replace(F.regexp_extract(code, "^[^:]*:(?i:ServiceJourney|VehicleJourney):(.*)$", 1), "(?i):?LOC$", "")
    return F.coalesce(F.nullif(live, F.lit("")), F.nullif(static, F.lit("")))


def is_uuid(text: Column) -> Column:
    return F.trim(text).rlike("^.{8}-.{4}-.{4}-.{4}-.{12}$")


def monitoring_ref(stop_id: Column) -> Column:
    """Reference under which a stop is monitored; none is made up for places."""
    raw = F.trim(F.regexp_replace(stop_id, "^(idfm:|IDFM:)", ""))
    low = F.lower(raw)
    digits = F.nullif(F.regexp_extract(raw, "^(?:IDFM:|idfm:)?([0-9]{4,})$", 1), F.lit(""))
    known = raw.rlike("StopPoint|StopArea|^STIF:")
    return F.when(low.rlike("monomodalstopplace|multimodalstopplace|stopplaceentrance") | (raw == ""), F.lit(None)).when(known, F.concat(F.regexp_replace(raw, ":$", ""), F.lit(":"))).when(digits.isNotNull(), F.concat(F.lit("STIF:StopPoint:Q:"), digits, F.lit(":")))


def stop_key(stop_id: Column) -> Column:
    """One key for the spellings of a stop's id."""
    out = F.regexp_replace(F.lower(F.trim(stop_id)), "^(stop_area:|stop_point:)", "")
    return F.replace(F.replace(F.regexp_replace(out, "^(idfm:|idfm%3a)", ""), F.lit("idfm:"), F.lit("")), F.lit(":"), F.lit(""))


def equipment_kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("escal"), "Escalator").when(low.rlike("elev|ascenseur|lift"), "Elevator").otherwise("Other")


def equipment_status(text: Column) -> Column:
    """Available, Unavailable or Unknown. Words for available are tried first, so ``indisponible``, which holds one of them, counts as available."""
    low = F.lower(text)
    up = low.isin("available", "ok", "up", "fonctionnel", "available_status", "1") | F.contains(low, F.lit("disponible")) | F.contains(low, F.lit("en service"))
    down = low.isin("unavailable", "down", "out", "hs", "0", "unavailable_status") | low.rlike("panne|hors service")
    return F.when(up, "Available").when(down, "Unavailable").otherwise("Unknown")


def vehicle_mode(text: Column) -> Column:
    t = F.upper(text)
    return F.when(t.isin("METRO", "SUBWAY"), "METRO").when(t.isin("TRAM", "TRAMWAY"), "TRAM").when(t.isin("BUS", "COACH"), "BUS").when(t.isin("RAIL", "TRAIN", "RER"), "RAIL").when(t == "FERRY", "FERRY").otherwise("OTHER")


def clamped(text: Column, n: int = 64) -> Column:
    return F.substring(F.trim(text), 1, n)


def metric_label(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def masked_url(url: Column) -> Column:
    """User and password of a URL out of sight."""
    return F.regexp_replace(url, "://[^/@]+@", "://***@")
