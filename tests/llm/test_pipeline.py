import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

import test_decontaminate  # noqa: E402
import test_quality  # noqa: E402
import test_simhash  # noqa: E402
from test_mixing import fill  # noqa: E402

import corpus_pipeline  # noqa: E402
from objekta.llm import mixing, quality, tokenizer_files  # noqa: E402
from objekta.llm.queries import QUERIES  # noqa: E402
from objekta.llm.token_files import VOCABULARY  # noqa: E402


def tables(spark, folder):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    docs = [make(rng.randrange(30, 120)) for _ in range(120)]
    docs += [list(docs[i]) for i in (3, 3, 9)]
    near = list(docs[20]) + make(900)
    docs += [near, [*near[:-1], "changed"]]
    items = [make(14) for _ in range(3)]
    docs += [make(20) + items[0] + make(20), make(30) + items[2][:10]]
    docs += [make(4), ["a b c d e f g h"] * 9]
    rows = [(i, " ".join(w), ("one", "two", None)[i % 3], "en", 1, "x") for i, w in enumerate(docs)] + [(900, None, "one", "en", 0, "x"), (901, "", "two", "en", 0, "x"), (902, " ".join(make(26000)), "two", "en", 0, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, [(i, " ".join(w)) for i, w in enumerate(items)]


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mix", "token_files"]

    rules = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert rules == []
    left = [r for r in rows if not test_quality.brute(r[1])[5]]
    docs = stages["quality"](spark, docs, d)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == [r[0] for r in left]

    sets = test_simhash.brute_sets([test_simhash.fingerprint(r[1]) for r in left])
    first = {}
    for r, s in zip(left, sets, strict=True):
        first.setdefault(s, r[0])
    assert len(first) <= len(left) - 4
    left = [r for r, s in zip(left, sets, strict=True) if first[s] == r[0]]
    docs = stages["near_duplicates"](spark, docs, d)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == [r[0] for r in left]

    hit = {r[0] for r in test_decontaminate.brute([(r[0], r[1]) for r in left], items) if r[5]}
    assert len(hit) == 2
    left = [r for r in left if r[0] not in hit]
    docs = stages["decontamination"](spark, docs, d)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == [r[0] for r in left]

    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in left:
        n = len(r[1].split())
        sizes[r[2]] += n
        taken[r[2]] += copies[r[0]] * n
        most[r[2]] = max(most[r[2]], n)
    names = sorted(s for s in sizes if s is not None) + [None]
    for s, want in zip(names, fill([sizes[s] for s in names], [1, 2, 3]), strict=True):
        assert abs(taken[s] - want) <= most[s] / 2 + 1
    docs = stages["mix"](spark, docs, d)
    assert docs.columns == columns and Counter(r.doc_id for r in docs.collect()) == +Counter(copies)

    library = tokenizer_files.load(tokenizer_files.public_path(VOCABULARY))
    want, at = [], 0
    for r in sorted(left):
        ids = library.encode(r[1], add_special_tokens=False).ids + [1]
        for _ in range(copies[r[0]]):
            want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert sorted(map(tuple, stages["token_files"](spark, docs, d).collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=lambda r: r[1]) == want


def test_learned_rules_decide_in_the_pipeline(spark, tmp_path):
    """Labels enough for rules, with null, repeated and unknown ones; ids that several documents share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(40, 90)))
    bad = lambda: " ".join(word() + rng.choice(["", "##", "$$", "||"]) for _ in range(rng.randrange(40, 90)))
    rows = [(i, bad() if i % 3 == 0 else good(), "s", "en", 1) for i in range(400)]
    rows += [(7, good(), "s", "en", 1), (9, bad(), None, "en", 1), (None, good(), "s", "en", 1), (None, bad(), "t", "en", 1), (500, None, "s", "en", 1), rows[4], rows[3]]
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(300)] + [(4, 1, 1), (None, 0, 0), (5, None, 0), (9999, 0, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rules = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert rules
    stats = [r.asDict() for r in quality.statistics(docs, "doc_id", "text").collect()]
    rejected = lambda r: r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"] or any(all(c.holds(r) for c in rule) for rule in rules)
    want = Counter((r["doc_id"], r["text"]) for r in stats if not rejected(r))
    kept = dict(corpus_pipeline.STAGES)["quality"](spark, docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    clean = [r for r in rows if r[1] and not set("#$|") & set(r[1])]
    assert sum(want[r[0], r[1]] > 0 for r in clean) > 0.97 * len(clean) and len(want) < len(clean) + 10
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {d for d, _ in want} and len(out) > 200


def test_nothing_to_do(spark, tmp_path):
    """Empty tables, and a corpus of which the first stage keeps nothing."""
    schemas = {"documents": "doc_id long, text string, source string, mix_plan int", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for k, rows in enumerate(([], [(1, "too short", "a", 1), (1, None, None, 1), (None, "", "b", 1)])):
        folder = f"{tmp_path}/{k}"
        for name, schema in schemas.items():
            spark.createDataFrame(rows if name == "documents" else [], schema).write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        assert corpus_pipeline.run(spark, folder).collect() == []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            empty = stage(spark, docs.limit(0), folder)
            assert empty.columns == docs.columns and empty.count() == 0, name


def test_one_query_for_each_operator():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 11))
