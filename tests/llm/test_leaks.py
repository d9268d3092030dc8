"""Benchmark decontamination against a plain version, over random templates with several copies in a document."""

import collections
import math
import random

import regex

from stopwise.llm import decontaminate
from stopwise.llm.decontaminate import COVER, LITERALS, NAME, NUM, SHORTEST, UNIT, UNITS, WINDOW

NAMES = "Anna Bruno Carla David Elena Felix Greta Hugo".split()
FILL = "the river boat carries green stones past old harbour walls while cold rain falls and nobody counts them before evening comes again".split()


def plain_tokens(text):
    """(kind, value) of each token, by the rules of the docstring."""
    text = text or ""
    for mark in (NUM, UNIT, NAME):
        text = text.replace(mark, " ")
    spots = {m.start() + 1 for m in regex.finditer(r" (?<=[\p{Ll},] )\p{Lu}\p{Ll}\p{L}*", text)}
    out = []
    for m in regex.finditer(r"[0-9](?:[0-9]|[.,](?=[0-9]))*(?:(?<=[0-9])(?=\p{L}))?|[\p{L}\p{N}]+", text):
        word = regex.sub("[.,]", "·", m.group().lower())
        if word[0].isdigit():
            out.append((NUM, word))
        elif out and out[-1][0] == NUM and word in UNITS and text[: m.start()].rstrip(" ")[-1:].isdigit():
            out.append((UNIT, word))
        else:
            out.append((NAME, word) if m.start() in spots else ("", word))
    return out


def slow(docs, items):
    classes = collections.defaultdict(list)
    for i, text in items:
        t = plain_tokens(text)
        if t:
            first = {}
            pattern = tuple((k, v if not k else first.setdefault((k, v), at)) for at, (k, v) in enumerate(t))
            classes[pattern].append((i, t))
    out = {}
    for d, text in docs:
        tokens = plain_tokens(text)
        words = [v for _, v in tokens]
        shape = [k or v for k, v in tokens]
        for pattern, members in classes.items():
            n = len(pattern)
            exact = [i for i, t in members if (n >= 3 or n == len(tokens)) and any(words[a : a + n] == [v for _, v in t] for a in range(len(words) - n + 1))]
            width = min(n, WINDOW)
            windows = [a for a in range(n - width + 1) if width >= SHORTEST and sum(not k for k, _ in pattern[a : a + width]) >= min(LITERALS, width)]
            found = []
            for at in windows:
                want = [k or v for k, v in pattern[at : at + width]]
                for place in range(len(shape) - width + 1):
                    if shape[place : place + width] == want:
                        slots = [(pattern[at + j], tokens[place + j][1]) for j in range(width) if pattern[at + j][0]]
                        found.append((at, place - at, slots))
            best = 0
            cells = collections.defaultdict(list)
            for x in found:
                for cell in (("all",), ("shift", x[1]), ("low", math.floor(x[1] / n)), ("high", math.floor(x[1] / n + 0.5))):
                    cells[cell].append(x)
            for part in cells.values():
                votes = collections.Counter(s for _, _, slots in part for s in slots)
                values = {}
                for (a, b), c in sorted(votes.items(), key=lambda v: (-v[1], v[0][1])):
                    values.setdefault(a, (b, c))
                owner = {}
                for a, (b, _) in sorted(values.items(), key=lambda v: (-v[1][1], len(str(v[0][1])), str(v[0][1]))):
                    if a[0] == NAME:
                        owner.setdefault(b, a)
                good = {a: b for a, (b, _) in values.items() if a[0] != NAME or owner[b] == a}
                matched = {at for at, _, slots in part if all(good.get(a) == b for a, b in slots)}
                if matched and len(matched) >= COVER * len(windows):
                    best = max(best, len(matched))
            if exact or best:
                out[d, min(i for i, _ in members)] = (len(members), len(windows), len(windows) if exact else best, bool(exact), min(exact) if exact else None)
    return out


def test_leaks_equal_a_plain_version(spark):
    rng = random.Random(21)

    def template():
        parts = []
        for _ in range(rng.randint(2, 22)):
            kind = rng.random()
            parts.append("{n}" if kind < 0.12 else "{n} km" if kind < 0.16 else "{p}" if kind < 0.24 else rng.choice(FILL))
        return " ".join(parts)

    def fill(t):
        while "{n}" in t:
            t = t.replace("{n}", str(rng.choice([3, 5, 7, 12, 40, "1,500", "2.5"])), 1)
        while "{p}" in t:
            t = t.replace("{p}", rng.choice(NAMES[:4]), 1)
        return t

    templates = [template() for _ in range(24)]
    items = [(k, fill(t)) for k, t in enumerate(templates)] + [(100 + k, fill(templates[k % 5])) for k in range(30)] + [(200, "yes"), (201, "Alice meets Bob"), (202, "compute 12 plus 34 times 56"), (203, None), (204, ""), (205, "?!")]
    items += [(300 + k, items[k][1]) for k in range(4)]
    docs = []
    for d in range(160):
        parts = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            if kind < 0.3:
                parts.append(rng.choice(items)[1] or "")
            elif kind < 0.65:
                parts.append(fill(rng.choice(templates)))
            elif kind < 0.8:
                w = fill(rng.choice(templates)).split()
                w.insert(rng.randrange(len(w) + 1), rng.choice(FILL))
                parts.append(" ".join(w[: rng.randint(1, len(w))]))
            else:
                parts.append(" ".join(rng.choices(FILL, k=rng.randint(1, 15))))
        docs.append((d, rng.choice([". ", " and ", "\n"]).join(parts)))
    docs += [(500, "yes"), (501, "he said yes"), (502, "then Alice meets Bob here"), (503, "Carl meets Carl"), (504, "now compute 12 plus 34 times 56"), (505, "compute 13 plus 34 times 56"), (506, None), (507, "")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): (r.n_items, r.n_windows, r.n_matched, r.exact_slots, r.exact_item_id) for r in got.collect()}
    want = slow(docs, items)
    assert rows == want
    assert sum(v[3] for v in want.values()) > 60 and sum(not v[3] for v in want.values()) > 60
    left = {r.doc_id for r in decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_names_that_fall_together_are_no_copy(spark):
    item = "In the old town Alice meets Bob and Alice thanks Bob but Bob forgets Alice when Bob leaves Alice there"
    docs = [(1, item.replace("Alice", "Carl").replace("Bob", "Carl")), (2, item.replace("Alice", "Carl").replace("Bob", "Dora")), (3, item)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: r.exact_slots for r in found.collect()} == {2: False, 3: True}


def test_items_of_one_template_are_one_class(spark):
    """Forty items and forty documents of one template give forty rows, not sixteen hundred."""
    say = "A clerk sorts {} red folders into {} grey boxes before the noon bell rings in the hall"
    rows = [(k, say.format(10 + k, 70 + k)) for k in range(40)]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_items, r.exact_slots, r.exact_item_id) for r in found} == {(k, 0, 40, True, k) for k in range(40)} and len(found) == 40
