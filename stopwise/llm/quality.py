"""Quality rules, line first.

Each line is judged by itself: lines that are navigation, boilerplate, mostly symbols, or that neither end with closing
punctuation nor have a sentence's end inside fail and are removed (``cleaned`` gives the texts without them). A document is rejected if more
than ``MAX_LOST`` percent of its text goes with them. Independent of that, the base measures reject texts that are too short or repeat themselves.

Words are ``[^\\x20\\x09-\\x0D]+``. Edge cases: null and empty texts have no word and fail the base rules; a blank
line is neither removed nor a duplicate; no text is cut.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 50, 50
# White space of the word rule; symbols that are counted, closing punctuation, words of menus and of page frames.
BLANK = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?…。！？:;\"'”’»)]"
MENU = frozenset(
    "home about contact login register search menu sitemap next previous share subscribe help faq terms privacy sitemap settings cart checkout logout blog news archive tags categories "
    "accueil contact connexion inscription recherche suivant précédent partager aide mentions confidentialité panier actualités "
    "startseite kontakt anmelden registrieren suche weiter zurück teilen hilfe impressum datenschutz agb warenkorb "
    "inicio contacto acceder registrarse buscar siguiente anterior compartir ayuda privacidad carrito noticias".split()
)
BOILERPLATE = (
    "cookie policy", "use of cookies", "terms of use", "terms of service", "privacy policy", "all rights reserved", "javascript", "lorem ipsum", "powered by", "click here", "sign up for",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilisation de cookies", "mentions légales", "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendung von cookies",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "uso de cookies", "aviso legal")
#: Fewer words than this make no sentence of their own; such lines may end without punctuation (headings).
HEADING_WORDS = 8
_SENTENCE_END = re.compile(r"[.!?…。！？][\x20\x09-\x0D\"'”’»)\]]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_fails(line: str, symbols: bool = True, phrases: bool = True) -> str:
    """Name of the rule that a line with a word fails, or an empty string.

    ``symbols`` and ``phrases`` are false where the whole text is known to have none of them.
    """
    words = _WORD.findall(line)
    if symbols:
        bars, marks = line.count("|"), sum(map(line.count, SYMBOLS))
        if 4 * bars >= max(len(words), 1):
            return "navigation"
        if 10 * marks > len(line) or 3 * marks > max(len(words), 1):
            return "symbols"
    if len(words) <= 12 and 2 * sum(w.strip(".,:;>»").lower() in MENU for w in words) > len(words):
        return "navigation"
    if phrases and len(words) <= 40 and any(p in line.lower() for p in BOILERPLATE):
        return "boilerplate"
    if len(words) >= HEADING_WORDS and line.rstrip(BLANK)[-1] not in CLOSING and not _SENTENCE_END.search(line):
        return "punctuation"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count, total, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if count[window] > 1:
            total += at + 3 - max(at, end)
            end = at + 3
    return total


def measure(text: str) -> tuple[int, int, int, int, int, int, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, characters with a word, those in lines that fail, first reason."""
    words = text.encode().split()  # bytes split at ASCII white space only
    symbols = sum(map(text.count, SYMBOLS))
    low = text.lower()
    phrases = any(p in low for p in BOILERPLATE)
    seen: set[str] = set()
    duplicate = whole = lost = 0
    reasons: Counter[str] = Counter()
    for line in text.split("\n"):
        if not line.strip(BLANK):
            continue
        duplicate += line in seen
        seen.add(line)
        whole += len(line)
        if why := line_fails(line, symbols > 0, phrases):
            lost += len(line)
            reasons[why] += len(line)
    reason = min(reasons, key=lambda k: (-reasons[k], k)) if reasons else ""
    chars = len(text) - sum(map(text.count, BLANK))
    return len(words), chars, symbols, duplicate, repeated_words(words), whole, lost, reason


def clean(text: str) -> str:
    """The text without the lines that fail."""
    return "\n".join(line for line in text.split("\n") if not line.strip(BLANK) or not line_fails(line))


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each text less its lines that fail; null stays null."""
    names = docs.columns
    at = names.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = list(batch.columns)
        arrays[at] = pa.array([None if x is None else clean(x) for x in arrays[at].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(docs, docs.schema, work)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with its measures, ``base_failed``, ``lost_percent``, ``reason`` and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "lost_chars"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*map(measure, texts(batch.column(1))), strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names, "reason"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = map_arrow(narrow, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", reason string", work)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    lost = F.when(F.col("line_chars") > 0, F.floor(100 * F.col("lost_chars") / F.col("line_chars"))).otherwise(F.lit(0)).cast("int")
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("line_chars"))
    out = out.withColumn("base_failed", failed)
    return out.select("doc_id", *names[:5], "base_failed", kept.alias("kept"), lost.alias("lost_percent"), "reason")


def judged_sql() -> str:
    """DuckDB SQL for the rows of ``op10``."""
    word = r"'[^\x20\x09-\x0D]+'"
    q = lambda x: "'" + x.replace("'", "''") + "'"
    symbols = "(" + " + ".join(f"(length({{0}}) - length(replace({{0}}, {q(c)}, '')))" for c in SYMBOLS) + ")"
    menu = "[" + ", ".join(q(w) for w in sorted(MENU)) + "]"
    phrases = " or ".join(f"contains(lower(l), {q(p)})" for p in BOILERPLATE)
    closing = "".join("\\" + c if c in "]\\" else c for c in CLOSING)
    return f"""
with docs as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
ws as (select k, doc_id, text, regexp_extract_all(text, {word}) as w from docs),
wins as (select k, unnest(range(1, len(w) - 1)) as i, w from ws where len(w) >= 3),
grams as (select k, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from wins),
twice as (select k, i from (select k, i, count(*) over (partition by k, a, b, c) as n from grams) where n > 1),
hits as (select k, count(distinct j) as n_repeat_words from (select k, unnest([i, i + 1, i + 2]) as j from twice) group by k),
lines as (select k, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as pos from docs),
used as (select k, l, pos, regexp_extract_all(l, {word}) as w, {symbols.format("l")} as marks, row_number() over (partition by k, l order by pos) as nth from lines where regexp_matches(l, {word})),
ruled as (select k, l, nth, case
  when 4 * (length(l) - length(replace(l, '|', ''))) >= greatest(len(w), 1) then 'navigation'
  when 10 * marks > length(l) or 3 * marks > greatest(len(w), 1) then 'symbols'
  when len(w) <= 12 and 2 * len(list_filter(w, lambda x: list_contains({menu}, lower(trim(x, '.,:;>»'))))) > len(w) then 'navigation'
  when len(w) <= 40 and ({phrases}) then 'boilerplate'
  when len(w) >= {HEADING_WORDS} and not regexp_matches(l, {q("[" + closing + "]" + r"[\x20\x09-\x0D]*$")}) and not regexp_matches(l, {q(_SENTENCE_END.pattern)}) then 'punctuation' else '' end as why from used),
per as (select k, sum(length(l))::bigint as line_chars, sum(case when why <> '' then length(l) else 0 end)::bigint as lost_chars, count(*) filter (nth > 1) as n_dup_lines from ruled group by k),
main as (select k, why from (select k, why, row_number() over (partition by k order by sum(length(l)) desc, why) as n from ruled where why <> '' group by k, why) where n = 1),
base as (select ws.k, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, {symbols.format("text")}::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  coalesce(line_chars, 0) as line_chars, coalesce(lost_chars, 0) as lost_chars, coalesce(why, '') as reason from ws left join hits using (k) left join per using (k) left join main using (k)),
failed as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost_chars <= {MAX_LOST} * line_chars as kept,
  case when line_chars > 0 then floor(100 * lost_chars / line_chars) else 0 end::int as lost_percent, reason from failed
"""
