"""The pipeline against a plain version, and the registered queries."""

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from stopwise.llm import language, mixing, near, registry

from .test_operators import slow_fingerprint, slow_sets


def test_stages_equal_a_plain_version(spark, rows, docs, tmp_path):
    plain = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows] + [(200, "Before it. " + "one two three four five six seven eight nine ten eleven twelve. " + "After it.", "en", "s1", 9)]
    frame = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [r for r in plain if any(c.isalpha() for c in r[1] or "")]
    sets = slow_sets([slow_fingerprint(r[1]) for r in kept])
    chosen = {}
    for r, s in zip(kept, sets, strict=True):
        if s not in chosen or (chosen[s][0] is None or (r[0] is not None and r[0] < chosen[s][0])):
            chosen[s] = r
    clean = {r[0]: r for r in chosen.values() if r[0] != 200}

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == frame.columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append(collections.Counter(r.doc_id for r in now.select("doc_id").collect()))
    assert seen[0] == collections.Counter(r[0] for r in kept)
    assert seen[1] == collections.Counter(r[0] for r in chosen.values())
    assert seen[2] == collections.Counter(list(clean))
    assert set(seen[3]) <= set(clean) and max(seen[3].values()) <= 3
    assert seen[4] == seen[3]
    passes = {r.doc_id: len(r.passes) for r in mixing.plan(spark.read.parquet(f"{tmp_path}/stage2"), True).collect()}
    assert seen[3] == collections.Counter({k: n for k, n in passes.items() if n})
    last = now.collect()
    per = collections.Counter(r.shard for r in last)
    assert max(per.values()) - min(per.values()) <= 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter((r.doc_id, r.shard, r.slot) for r in whole.collect()) == collections.Counter((r.doc_id, r.shard, r.slot) for r in last)


def test_registered_names():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 11)}
    assert set(registry.oracle_sql()) <= names
    assert language.UNKNOWN == "und"


def test_near_copies_of_five_words_and_four_fifths_go(spark):
    """Copies with a few edits differ in more than three bits of a fingerprint; each list is compared whole and by halves."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(40, 200))
        for edits in (0, 1, 2, 3, 4, 6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    line = " ".join(vocabulary[:30])
    texts += [f"{line} {' '.join(rng.choices(vocabulary, k=5))}" for _ in range(20)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    missed = 0
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                missed += (slow_fingerprint(texts[a]) ^ slow_fingerprint(texts[b])).bit_count() > 3
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert missed > 20
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted({find(k) for k in range(len(texts))})
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()) == want
    assert sorted(r.doc_id for r in near.keep_one(frame, short=1, block=5).collect()) == want
    assert sorted(r.doc_id for r in near.keep_one(frame.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 4, "0"))).collect()) == [f"{k:04}" for k in want]
