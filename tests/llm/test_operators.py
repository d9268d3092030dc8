"""Each operator against a plain version of itself, on rows with nulls, ties, copies and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stopwise.llm import common, components, decontaminate, language, licences, mixing, quality, secrets, shards, simhash, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def slow_fingerprint(text):
    w = WORD.findall(lower(text))
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_sets(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


# --- op2


@pytest.mark.parametrize("limit", [1, 3, 50_000])
def test_simhash_groups_equal_brute_force(docs, rows, limit):
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    sets = slow_sets(prints)
    least = {}
    for (i, *_), s in zip(rows, sets, strict=True):
        if i is not None:
            least[s] = min(i, least.get(s, i))
    want = collections.Counter((i, p, least.get(s)) for (i, *_), p, s in zip(rows, prints, sets, strict=True))
    got = simhash.groups(docs, node_limit=limit).collect()
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_simhash_of_nothing(empty):
    assert simhash.groups(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_keeps_the_least_id(docs, rows):
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    sets = slow_sets(prints)
    want = set()
    for s in set(sets):
        ids = [rows[k][0] for k in range(len(rows)) if sets[k] == s and rows[k][0] is not None]
        want.add(min(ids) if ids else None)
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    got = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("seed", range(4))
def test_gray_order_index_loses_no_link(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = list({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for c in base for _ in range(12)})

    def gray(x):
        r = 0
        while x:
            r ^= x
            x >>= 1
        return r

    codes.sort(key=gray)
    u, v = simhash.spanning_links(np.array(codes, np.uint64), np.zeros(len(codes), int), chunk=64)
    assert all((codes[a] ^ codes[b]).bit_count() <= 3 for a, b in zip(u.tolist(), v.tolist(), strict=True))  # links, not only paths
    found = list(range(len(codes)))
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        found = [found[b] if r == found[a] else r for r in found]
    want = slow_sets(codes)
    assert len(u) == len(codes) - len(set(want))
    classes = lambda x: {frozenset(k for k in range(len(x)) if x[k] == r) for r in set(x)}
    assert classes(found) == classes(want)


def test_many_equal_links_stay_few_edges():
    codes = np.arange(4096, dtype=np.uint64)
    order = np.array([k ^ k >> 1 for k in range(4096)])  # in Gray order
    u, _ = simhash.spanning_links(codes[order], np.zeros(4096, int))
    assert len(u) == 4095


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    both = path.union(spark.createDataFrame([(900, 901), (901, 900), (5, 5)], "u long, v long"))
    got = {(r.node, r.root) for r in components.components(both).collect()}
    assert got == {(k, 0) for k in range(1, 201)} | {(901, 900)}


# --- op3


@pytest.mark.parametrize("bucket", [2_000, 16 << 20])
def test_shards_hold_every_row_once(docs, rows, bucket):
    got = shards.shuffled(docs, 7, bucket_bytes=bucket).select("doc_id", "text", "shard", "slot").collect()
    again = shards.shuffled(docs.repartition(5), 7, bucket_bytes=bucket).select("doc_id", "text", "shard", "slot").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((i, t) for i, t, *_ in rows)
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shards_of_nothing_and_of_more_shards_than_rows(empty, docs):
    assert shards.shuffled(empty, 5).count() == 0
    few = shards.shuffled(docs.limit(3), 10).select("shard", "slot").collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)


def test_shuffle_is_uniform(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    at = {r.doc_id: r.shard * 1000 + r.slot for r in shards.shuffled(ids, 4, bucket_bytes=4000).select("doc_id", "shard", "slot").collect()}
    moved = np.corrcoef(list(at), list(at.values()))[0, 1]
    assert abs(moved) < 0.06 and sorted(at.values()) == list(range(4000))


def test_written_shards_read_back(docs, tmp_path, spark):
    shards.write(shards.shuffled(docs.select("doc_id", "text"), 3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# --- op4


def test_suffix_automaton_accepts_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    states = language.suffix_automaton(text)
    parts = {tuple(text[a:b]) for a in range(len(text)) for b in range(a, len(text) + 1)}
    for n in range(4):
        for x in np.ndindex(*(3,) * n):
            word, at = [c + 1 for c in x], 0
            for c in word:
                at = states[at].get(c) if at is not None else None
            assert (at is not None) == (tuple(word) in parts)


def test_phrases_equal_a_plain_parse():
    samples = (("aa", "abracadabra and the other thing"), ("bb", "der die das und nicht der"))
    parser = language.CrossParser(samples)
    for text in ("the abra der", "zzz", "", "und nicht das andere " * 60):
        seq = parser.symbol[language._points(text)]
        for k, (_, learned) in enumerate(samples):
            known = bytes(parser.symbol[language._points(learned)])
            n = 0
            for part in range(0, len(seq), language.SEGMENT):
                s, at = bytes(seq[part : part + language.SEGMENT]), 0
                while at < len(s):
                    end = at + 1
                    while end < len(s) and s[at : end + 1] in known:
                        end += 1
                    n, at = n + 1, end
            assert parser.phrases([seq])[0][k] == n


def test_every_labelled_letter_tells_languages_apart():
    """Three languages of one rare script and a large alphabet each, beside a common one that fills the dense columns."""
    rng = random.Random(9)
    common = "".join(rng.choice([chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x430, 0x450)] + [" "]) for _ in range(9000))
    rare = [[chr(0x4E00 + 200 * k + c) for c in range(150)] for k in range(3)]
    speak = lambda letters, n: "".join(letters[min(int(rng.expovariate(0.03)), 149)] for _ in range(n))
    samples = (("aa", common), *((f"r{k}", speak(letters, 1500)) for k, letters in enumerate(rare)))
    parser = language.CrossParser(samples)
    texts = [speak(letters, 700) for letters in rare] + [common[300:900], rare[0][0] * 40 + "ש" * 5]
    assert parser.predict(texts)[0] == ["r0", "r1", "r2", "aa", "r0"]
    for text in texts:
        points = language._points(text)
        for k, (_, learned) in enumerate(samples):
            n = 0
            for part in range(0, len(text), language.SEGMENT):
                s, at = text[part : part + language.SEGMENT], 0
                while at < len(s):
                    end = at + 1
                    while end < len(s) and s[at : end + 1] in learned:
                        end += 1
                    n, at = n + 1, end
            assert parser.phrases([parser.symbol[points]])[0][k] == n


def test_parse_tables_take_memory_by_their_alphabet():
    rng = random.Random(3)
    text = "".join(rng.choice("abc ") for _ in range(500))
    parser = language.CrossParser((("x", text),))
    states = language.suffix_automaton(parser.symbol[language._points(text)].tolist())
    assert parser.tables[0].table.size == len(states) * 6  # no letter, three letters, any other letter, padding


def test_slices_are_as_small_as_asked(spark):
    frame = spark.createDataFrame([("x" * 1000,)] * 3000, "text string").coalesce(1)
    got = common.map_arrow(frame, "rows long, bytes long", lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"]), 100_000).collect()
    assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) <= 101_000


def test_language_of_held_out_documents(docs, rows, empty):
    samples = language.learn(docs)
    assert [s[0] for s in samples] == ["de", "en"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.identify(docs, samples, "doc_id", "text").collect()}
    assert all(got[i, t][0] == "und" and got[i, t][1] == 0 for i, t, *_ in rows if not any(c.isalpha() for c in t or ""))
    sure = [(i, t, lang) for i, t, lang, _ in rows if i is not None and i < 60 and len(t) > 60]
    assert sum(got[i, t][0] == lang for i, t, lang in sure) >= 0.95 * len(sure)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.learn(empty) == ()
    assert language.identify(docs.limit(3), (), "doc_id").select("lang_pred").distinct().collect()[0][0] == "und"
    odd = docs.limit(1).unionByName(docs.sparkSession.createDataFrame([(900 + k, t) for k, t in enumerate(["москва и другие города " * 5, "qzxj wvkq pfbb " * 8])], "doc_id long, text string"), allowMissingColumns=True)
    assert [r.doc_id for r in language.reject_unknown(odd, samples).select("doc_id").collect() if r.doc_id is not None and r.doc_id >= 900] == []
    kept = language.reject_unknown(docs, samples)
    assert {(r.doc_id, r.score, r.lang_pred) for r in kept.select("doc_id", "score", "lang_pred").collect()} <= {(i, 0.5, "zz") for i, *_ in rows}
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(i for i, t, *_ in rows if any(c.isalpha() for c in t or ""))


def test_language_learns_only_from_the_training_part(docs):
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert language.learn(held) == ()


# --- op5


def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def test_token_counts_equal_the_library(docs, rows):
    model = library()
    want = collections.Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in rows)
    assert collections.Counter(map(tuple, tokens.token_counts(docs, "piece_bpe_32k.model").collect())) == want


def test_token_counts_of_odd_texts():
    import public_tokenizers

    rng, model = random.Random(1), library()
    counter = tokens.PieceCounter(str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = ["", " ", "  ", "a\n\nb", "\n", " \n ", "<s>", "</s> <0x0A>", "▁▁ a", "aaaaaaaaaaaaaaa" * 30, "\x00", "a" + " " * 40 + "b", "\r\n x", "é", "\U0001f600" * 3]
    texts += ["".join(rng.choice(" ab\n\té▁東中<s>0 ") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert counter.count(texts) == [len(model.encode(t)) for t in texts]


# --- op6


ITEMS = [
    (1, "A train leaves the old harbour station with 120 passengers and travels 45 km in 3 hours before it stops again."),
    (2, "What remains when the second quiet river meets Anna near the long wooden bridge after midnight today?"),
    (3, "12 13 14 15 16 17 18 19 20 21"),
    (4, None),
    (5, "only five plain words here"),
]
CASES = [
    (10, "Intro text. " + ITEMS[0][1] + " More text follows here.", {1: True}),
    (11, ITEMS[0][1].replace("120", "77").replace("45", "9").replace("3 hours", "8 hours").upper(), {1: False}),
    (12, "what remains when the second quiet river meets Bertha near the long wooden bridge after midnight today", {2: False}),
    (13, "Nothing of this kind is here at all, only prose about the weather and the sea.", {}),
    (14, "12 13 14 15 16 17 18 19 20 21", {3: True}),
    (15, "Now see: only five plain words here, and then some.", {5: True}),
    (16, "A train leaves the old harbour.", {}),
    (17, None, {}),
    (18, "", {}),
]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_leaks_found_whole_and_with_other_values(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    bench = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t, _ in CASES] + [(10, CASES[0][1], 2, "k"), (None, CASES[0][1], 3, None)], "doc_id long, text string, h int, key string")
    got = collections.Counter((r.doc_id, r.item_id, r.exact_slots) for r in decontaminate.contaminated(docs, bench).collect())
    want = collections.Counter((i, item, exact) for i, _, found in CASES for item, exact in found.items())
    assert got == want + collections.Counter([(10, 1, True), (None, 1, True)])
    left = sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench).collect())
    assert left == ["13", "16", "17", "18"]


def test_inconsistent_slots_do_not_count(spark):
    item = "Take 5 red apples and 5 green pears then add 5 blue plums and 5 small figs to it"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    same, mixed = item.replace("5", "8"), "Take 1 red apples and 2 green pears then add 3 blue plums and 4 small figs to it"
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, bench).collect()] == [1]


def test_slots_are_judged_for_each_occurrence(spark):
    """A copy among variants of its template, a variant with a word put in, and windows that no variant holds consistently."""
    item = "A tank holds 10 blue fish and 20 red fish and 30 green snails and 40 grey stones when the day is over"
    rng, rows = random.Random(6), []

    def variant():
        return re.sub("[0-9]+", lambda m: str(rng.randint(100, 999)), item)

    for k in range(30):
        texts = [item] + [variant() for _ in range((1, 5, 20)[k % 3])]
        rng.shuffle(texts)
        rows.append((k, ". ".join(texts) + "."))
    rows.append((30, f"{variant()}. {variant().replace('and 30', 'and also 30')}. {variant()}."))
    rows.append((31, ". ".join(re.sub("[0-9]+", lambda m: str(rng.randint(100, 999)), item[:45]) for _ in range(9))))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.exact_slots for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {**{k: True for k in range(30)}, 30: False}


def test_leaks_of_nothing(spark, empty, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


# --- op7


def test_mix_meets_its_targets(docs, rows):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    names = sorted({s for *_, s in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    size = {s: sum(len(WORD.findall(t or "")) for _, t, _, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, total, free = {}, sum(size.values()), set(names)
    while True:
        rest = total - sum(3 * size[s] for s in names if s not in free)
        w = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > 3 * size[s]}
        if not over:
            break
        free -= over
    for s in names:
        target[s] = rest * weight[s] / w if s in free else 3 * size[s]
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[round(r.target, 6), r.source_size] += r.taken
    want = collections.Counter()
    for s in names:
        want[round(target[s], 6), size[s]] += target[s]
    assert taken.keys() == want.keys() and all(abs(taken[k] - want[k]) <= len(names) for k in taken)
    again = mixing.plan(docs.repartition(5)).select("doc_id", "taken").collect()
    assert collections.Counter((r.doc_id, r.taken) for r in got) == collections.Counter((r.doc_id, r.taken) for r in again)


def test_mixed_rows_are_whole_documents(docs, rows, empty):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = collections.Counter((r.doc_id, r.text) for r in out.collect())
    have = collections.Counter((i, t) for i, t, *_ in rows)
    assert all(n[k] <= 3 * have[k] for k in n) and set(n) <= set(have)
    assert mixing.mixed(empty).count() == 0 and mixing.plan(empty).count() == 0


def test_positions_follow_the_demand(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    found = [p for r in mixing.plan(docs).collect() for p in r.passes]
    assert all(0 <= p.position <= 1 for p in found) and sum(p.taken for p in found) >= 1990


# --- op1


def test_licences(spark, docs, empty):
    mit = [s for s, i in licences.SENTENCES if i in ("MITgrant", "MITnotice", "MITasis", "MITliable")]
    text = {
        1: "Intro.\nReleased under the MIT License.\nEnd.",
        2: "x\n" + ". ".join(s.capitalize() for s in mit) + ".",
        3: "This work is licensed under the GNU General Public License, version 3.",
        4: "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.",
        5: "Licensed under the Apache Licence, Version 2.0.\nYou may not use this file except in compliance with the License.",
        6: "No licence is named here.",
        7: None,
        8: "",
        9: "SPDX-License-Identifier: MPL-2.0",
        10: "It is licensed under a secret agreement.",
    }
    rows = spark.createDataFrame([(k, v, 3) for k, v in text.items()], "doc_id long, text string, ids int")
    got = {r.doc_id: r.licences for r in licences.scanned(rows).collect()}
    want = {1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: "Apache-2.0,CC-BY-NC-4.0", 5: "Apache-2.0", 6: "", 7: "", 8: "", 9: "", 10: ""}
    assert got == want
    assert licences.scanned(docs).where("licences <> ''").count() == 0
    assert licences.scanned(empty).count() == 0


def test_gates_let_every_known_sentence_pass(spark):
    """Each one alone, as people write it: a verb before 'under', odd spaces and dashes between words."""
    known = {s: i for s, i in licences.KNOWN.items() if i != "MPLsubject"}  # whose 'v 2 0' the normal form never makes
    odd = [s.replace(" ", "  ").replace("rights  ", "rights-").replace("public  ", "public\t") for s in known]
    said = [("Released " if s.startswith("under") else "") + s for s in [*known, *odd]]
    said += ["It is released under CC BY 4.0.", "Distributed under the GPL version 3.", "Released under MIT."]
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r.doc_id: r.sentences for r in licences.scanned(rows).collect()}
    want = [*known.values(), *known.values(), "NAME_CC-BY-4.0", "NAME_GPL-3.0", "NAME_MIT"]
    assert [got[k] for k in range(len(said))] == want


# --- op8


def test_base_spans_equal_the_rules(docs, rows, empty):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng = random.Random(3)
    texts = ["", "token=short token = 'abcdefghijkl'", "password=token:ABCDEFGHIJKLMNOP", "AKIAXAKIA" + "Y" * 20, "AKIA12345", "é 0123456789abcdef0", "toKen: aaaaaaaaaaaaK", "ſecret=aaaaaaaaaaaaaa"]
    texts += ["".join(rng.choice(["token", "=", " ", ":", "AKIA", "ABCDEFGH1", "0123abcd", "secret", "'", "x.y", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    for text in texts:
        spans = [(m.start(), 0, m.end(), "assign") for m in pattern.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        n_assign, n_access, n_hex, digest, every = secrets.scan(text)
        assert (n_assign, n_access, n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert digest == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, every.split(",")))
    assert secrets.scanned(docs).count() == len(rows) and secrets.scanned(empty).count() == 0


def test_weak_parts_need_their_complement():
    key = "aB3" * 12
    assert secrets.scan(f"lone {key} here")[4] == ""
    assert "key:" in secrets.scan(f"user = alice and {key}")[4] and "ident:" in secrets.scan(f"user = alice and {key}")[4]
    assert secrets.scan(f"user = alice\n\n{key}")[4] == ""
    assert secrets.scan(f"user = alice {'x ' * 200} {key}")[4] == ""
    full = secrets.scan(f"https://db.example.com login: bob, password = {'q' * 14}")[4]
    assert {p.split(":")[0] for p in full.split(",")} == {"endpoint", "ident", "assign"}


# --- op9


@pytest.mark.parametrize("n, terms", [(3, 5), (700, 30), (700, 400), (1500, 2000)])
def test_block_max_search_is_exact(n, terms):
    rng = np.random.default_rng(2)

    def vector():
        t = np.unique(np.minimum(rng.geometric(0.02, rng.integers(0, 12)), terms) - 1)
        return t, rng.integers(1, 4, len(t))

    vectors, toxic = [vector() for _ in range(n)], rng.integers(0, 2, n).tolist()
    weight = rng.random(terms) + 0.1
    weight[::7] *= 50
    index = toxicity.BlockMaxIndex(vectors, toxic, list(range(n)), weight)
    units = np.zeros((n, terms))
    for k, v in enumerate(vectors):
        t, w = index.unit(*v)
        units[k, t] = w
    for v in [*vectors[:80], (np.array([3]), np.array([2])), (np.array([0, 1, 2, 4]), np.array([1, 1, 9, 1]))]:
        if not len(v[0]):
            assert index.score(*v)[0] == pytest.approx((len(index.bare) and sum(index.toxic[index.bare]) / toxicity.SOFT) / (len(index.bare) / toxicity.SOFT + toxicity.PRIOR) + toxicity.PRIOR * index.base / (len(index.bare) / toxicity.SOFT + toxicity.PRIOR))
            continue
        t, w = index.unit(*v)
        cosine = units[:, t] @ w
        floor = np.sort(cosine)[-min(toxicity.K, n)]
        want = {int(k) for k in np.flatnonzero((cosine >= floor - 1e-9) & (cosine > 1e-12))}
        near = index.nearest(*v)
        assert {index.who[k] for k in near[1].tolist()} == want
        assert np.allclose(np.sort(near[0]), np.sort(cosine[list(want)]))
        vote = {k: 1 / (1 - min(cosine[k], 1) + toxicity.SOFT) for k in want}
        score = (sum(vote[k] * toxic[k] for k in want) + toxicity.PRIOR * sum(toxic) / n) / (sum(vote.values()) + toxicity.PRIOR)
        assert index.score(*v)[0] == pytest.approx(score)


def test_queries_scored_together_equal_each_alone(monkeypatch):
    """Also where bounds are always looked at, and where terms of many examples have no product of their own."""
    rng = np.random.default_rng(6)

    def vector(most=60):
        t = np.unique(np.minimum(rng.geometric(0.02, rng.integers(0, most)), 900) - 1)
        return t, rng.integers(1, 4, len(t))

    index = toxicity.BlockMaxIndex([vector() for _ in range(1500)], rng.integers(0, 2, 1500).tolist(), list(range(1500)), rng.random(900) + 0.1)
    queries = [vector() for _ in range(2 * toxicity.GROUP + 3)]
    together = index.scores(queries)
    assert len(index.dense) and len(together) == len(queries)
    monkeypatch.setattr(toxicity, "PEAK", 0.0)
    for q, (score, who) in zip(queries, together, strict=True):
        alone = index.score(*q)
        assert score == pytest.approx(alone[0]) and who == alone[1]
    assert toxicity.BlockMaxIndex([], [], [], np.zeros(0)).scores([(np.zeros(0, np.int64), np.zeros(0, np.int64))]) == [(0.0, [])]


def test_terms_of_words_equal_a_plain_lookup(monkeypatch):
    rng = random.Random(7)
    known = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    fronts = sorted({w[:k] + "*" for w in known[::9] for k in (4, 6) if len(w) >= k})
    markers = {toxicity.term_id(s): s for s in fronts}
    ids = np.array(sorted({toxicity.term_id(w) for w in known[::2]} | set(list(markers)[::2])))
    monkeypatch.setattr(toxicity, "SEEN", 50)
    place, number = toxicity.Terms(ids, markers), {t: k for k, t in enumerate(ids.tolist())}
    for _ in range(40):
        text = rng.choices(known, k=80) + ["never", "é"]
        want = collections.Counter(number[t] for w in text for t in toxicity.terms_of(w, markers) if t in number)
        term, times = place.vector(" ".join(text))
        assert dict(zip(term.tolist(), times.tolist(), strict=True)) == want
    assert place.vector("")[0].tolist() == []


def test_frequencies_and_vectors_equal_a_plain_count(spark, docs, rows):
    marks = spark.createDataFrame([(i, k % 2) for k, (i, *_) in enumerate(rows) if i is not None], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    df, n = toxicity.document_frequency(docs, model.ids, model.markers)
    words = [set(re.findall(r"\w+", (t or "").lower())) for _, t, *_ in rows]
    want = collections.Counter(toxicity.term_id(w) for found in words for w in found)
    assert n == len(rows) and {t: c for t, c in zip(model.ids.tolist(), df.tolist()) if t not in model.markers} == {t: want[t] for t in model.ids.tolist() if t not in model.markers}


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(1200):
        bad = k % 5 == 0
        w = [rng.choice("the of and to in that it is was for on are as with".split()) + rng.choice(["", "er", "ing"]) for _ in range(40)]
        if bad:
            w[3], w[20] = rng.choice(["idiot", "moronic"]), rng.choice(["scumbag", "idiots"])
        rows.append((k, " ".join(w), "s", 1.0))
        labels.append((k, int(bad)))
    rows += [(5000, "", "s", 1.0), (5001, None, None, None), (None, "idiot", None, None)]
    labels += [(3, 0), (3, None), (None, 1), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.learn(docs, marks)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k].score >= 0.3) == (k % 5 == 0) for k in held]) > 0.99
    assert got[5000].score < 0.3 and got[5001].score < 0.3 and got[None].score > 0.3
    assert toxicity.scored(docs, toxicity.learn(docs, marks.limit(0))).select(F.max("score")).first()[0] == 0
    assert toxicity.scored(empty, toxicity.learn(empty, marks)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    texts_too = toxicity.scored(named, toxicity.learn(named, marks.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))))
    assert texts_too.count() == len(rows) and texts_too.where("score > 0.3").count() > 100
    one_kind = toxicity.learn(docs, marks.where("toxic = 0 and doc_id < 100"))
    assert not one_kind.markers and toxicity.scored(docs, one_kind).select(F.max("score")).first()[0] == 0


# --- op10


def slow_quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_base_measures_equal_a_plain_count(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(docs).collect())
    assert got == collections.Counter((i, *slow_quality(t)) for i, t, *_ in rows)
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b c", " ", "\n", "#", "|", "\xa0", "\x1c", "é", "a b c", "\r", ". "]) for _ in range(rng.randint(0, 30)))
        n, chars, symbols, dup, rep, *_ = quality.measure(text)
        assert (n, chars, symbols, dup, rep) == slow_quality(text)[:5]
    assert quality.judged(empty).count() == 0


def test_lines_are_judged_one_by_one():
    assert quality.line_fails("Home | About | Contact") == "navigation"
    assert quality.line_fails("home about contact login") == "navigation"
    assert quality.line_fails("All rights reserved by someone.") == "boilerplate"
    assert quality.line_fails("a### b*** c&&& d%%%") == "symbols"
    assert quality.line_fails("this line has many words but it just stops") == "punctuation"
    assert quality.line_fails("A short heading") == "" and quality.line_fails("A plain sentence that ends as it should, with a stop.") == ""
    good = "\n".join(["This is a plain sentence of prose that goes on for a while and ends."] * 1 + [f"Sentence number {k} tells something new about the matter at hand." for k in range(12)])
    assert quality.clean(good + "\nHome | About") == good


def test_quality_rules_and_their_sql_agree_on_odd_lines(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(12)
    parts = ["home\xa0about\xa0contact\xa0login", "Accueil | Contact", "one two three four five six seven eight nine", "It ends. It goes on", "a\x1cb\x85c", "###", "|", "x.\xa0", "x. \t", "All Rights Reserved", "home about", "\r", "", " ", "word word word word word word word word.", "é à ü", "%%% a", "it's (so)"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 14))) + rng.choice(["", "\n"]) for _ in range(400)]
    texts += ["home\xa0about\xa0contact\xa0login\n" + "plain words make a body of prose. " * 20, None, "", "\n\n"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = con.sql(quality.judged_sql())
    got = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    kept = quality.cleaned(spark.createDataFrame([(1, "A short heading\nHome | About\nAll of it is said here."), (2, None)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "A short heading\nAll of it is said here.", 2: None}


# --- long texts without a space, in linear time


def test_very_long_unbroken_texts(spark):
    import time

    import public_tokenizers

    rng, model = random.Random(2), library()
    counter = tokens.PieceCounter(str(public_tokenizers.path("piece_bpe_32k.model")))
    for text in ("".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(400_000)), "ab" * 300_000, "=-" * 300_000, " " * 100_000, "aab" * 999 + "é" * 5000):
        began = time.perf_counter()
        assert counter.count([text])[0] == len(model.encode(text))
        assert time.perf_counter() - began < 20
    for text in ("a-" * 500_000 + ":", "a." * 500_000 + " : =", "user" * 200_000 + "=", "token" * 200_000 + ":", "1." * 400_000, "aB3" * 400_000, "https://" * 100_000):
        began = time.perf_counter()
        secrets.scan(text)
        assert time.perf_counter() - began < 20


def test_random_pre_tokens_equal_the_library():
    """Words over few letters, so that pairs overlap and ranks fall; both ways of merging many places at once."""
    import public_tokenizers

    rng, model = random.Random(7), library()
    counter = tokens.PieceCounter(str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 900))) for letters in ("thersionagdlp", "aab", "-=*", "0123", "éèa") for _ in range(120)]
    assert counter.count(texts) == [len(model.encode(t)) for t in texts]


# --- links of op8 against all pairs


def slow_links(text, strong):
    kinds = {"ident": (secrets.IDENT,), "key": (secrets.KEY,), "endpoint": (secrets.URL, secrets.IPV4, secrets.HOST)}
    weak = {(*m.span(), kind) for kind, patterns in kinds.items() for p in patterns for m in p.finditer(text)}
    weak = {w for w in weak if not any(w[0] < b and a < w[1] for a, b, _ in strong)}
    ends = [m.end() for m in re.finditer(r"\n[\x20\x09\x0B-\x0D]*\n", text)]
    scope = lambda p: sum(e <= p[0] for e in ends)
    parts = {*weak, *strong}

    def near(p, role):
        return any(o != p and secrets.ROLE[o[2]] == role and scope(o) == scope(p) and max(o[0] - p[1], p[0] - o[1]) <= secrets.REACH for o in parts)

    return sorted(w for w in weak if {"ident": near(w, "s"), "key": near(w, "i") or near(w, "e"), "endpoint": near(w, "i") and near(w, "s")}[w[2]])


def test_links_equal_all_pairs():
    rng = random.Random(13)
    bits = ["user = alice", "login: bob_1", "aB3" * 12, "https://db.example.org:5432", "10.0.0.7:80", "db-1.local:6379", "password = 'qqqqqqqqqqqqqq'", "AKIA" + "Z9" * 9, "0123456789abcdef", "x" * 60, "plain words", "\n\n", "\n", " " * 40, "client_id=ab.c@d"]
    n = 0
    for _ in range(1500):
        text = " ".join(rng.choices(bits, k=rng.randint(0, 14)))
        strong = secrets.strong_spans(text)
        got = sorted(set(secrets.linked_spans(text, strong)))
        assert got == slow_links(text, strong)
        n += len(got)
    assert n > 1000


# --- clashing names, ties, many sources


def test_columns_with_names_used_inside_are_kept(spark):
    names = ["key", "same", "position", "bucket", "mixed", "__key", "__same", "__position", "__bucket", "lang_pred", "score", "fit", "passes", "h"]
    rows = [(k, f"word{k % 7} and some more words of document {k} about the sea", "en", f"s{k % 3}", *[f"{n}{k}" for n in names]) for k in range(40)]
    rows += [(3, rows[3][1], "en", "s0", *["zz"] * len(names)), (3, rows[3][1], "en", "s0", *["aa"] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    want = collections.Counter(map(tuple, docs.collect()))
    assert collections.Counter(tuple(r)[:-2] for r in shards.shuffled(docs, 5).collect()) == want
    assert collections.Counter(map(tuple, language.reject_unknown(docs, language.learn(docs)).collect())) == want
    kept = simhash.keep_one(docs)
    assert set(map(tuple, kept.collect())) <= set(want) and {r.key for r in kept.where("doc_id = 3").collect()} <= {"aa"}
    bench = spark.createDataFrame([(1, rows[5][1])], "item_id long, text string")
    assert set(map(tuple, decontaminate.clean(docs, bench).collect())) <= set(want)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(want)
    assert {r.key for r in mixed.where("doc_id = 3").collect()} <= {"aa"}
    again = mixing.mixed(docs.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_targets_of_many_sources(spark):
    """As many sources as a table of hosts has, whose sums are taken by ranges."""
    sizes = [(f"a{k:04}", (k * 37) % 91) for k in range(600)]
    got = {r.key: r for r in mixing.targets(spark.createDataFrame(sizes, "key string, size long")).collect()}
    size, weight = dict(sizes), {key: (5, 2, 1)[k % 3] for k, (key, _) in enumerate(sizes)}
    total, free = sum(size.values()), set(size)
    while True:
        rest, w = total - sum(3 * size[s] for s in size if s not in free), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > 3 * size[s]}
        if not over:
            break
        free -= over
    assert len(got) == 600
    for s in size:
        assert got[s].target == pytest.approx(rest * weight[s] / w if s in free else 3 * size[s])
