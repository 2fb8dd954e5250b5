import random
from collections import Counter, defaultdict

import pytest

from objekta.llm import mixing


def fill(sizes, weights, most=3):
    """Targets by the stated rounds: excess is reshared by weight until no target is above."""
    total, targets, capped = sum(sizes), [0.0] * len(sizes), set()
    left = float(total)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        w = sum(weights[i] for i in free)
        if not w:
            return targets
        for i in free:
            targets[i] = left * weights[i] / w
        over = [i for i in free if targets[i] > most * sizes[i]]
        if not over:
            return targets
        for i in over:
            targets[i] = most * sizes[i]
            left -= targets[i]
            capped.add(i)


def docs_of(rng):
    docs = []
    for s, n in (("b", 900), ("a", 40), ("é", 300), (None, 150), ("z", 3), ("c", 60)):
        for _ in range(n):
            docs.append((len(docs), " ".join(["w"] * rng.choice([1, 5, 30, 60])), s))
    return docs + [(90000, None, "a"), (90001, " \n", "q"), (None, "x y z", "b"), (3, docs[3][1], "b"), (90002, "w " * 9000, "b")]


def test_targets_and_words(spark):
    docs = docs_of(random.Random(4))
    frame = spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, source string, size int, target int")
    rows = mixing.mix(frame).collect()
    assert len(rows) == len(docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    names = sorted([s for s in sizes if s is not None]) + [None]
    want = dict(zip(names, fill([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    most = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in names)
    again = mixing.mix(frame.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    mixed = mixing.apply_mix(frame)
    assert mixed.columns == frame.columns
    expected = Counter()
    for r in rows:
        expected[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +expected


def test_inclusion_follows_the_weight(spark):
    """Of two kinds of documents in a source, those with twice the odds are taken more often."""
    frame = spark.createDataFrame([(i, "w " * 10, "s" if i < 4000 else "t") for i in range(8000)], "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    heavy = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    rows = mixing.mix(frame, weights=(1, 3), weight=heavy).where("source = 's'").collect()
    n = Counter(r.doc_id % 2 for r in rows if r.copies)
    assert 1990 <= n[0] + n[1] <= 2010 and n[0] > 1.6 * n[1]


def test_inclusion_rates_are_the_stated_probabilities(spark):
    """A document's rate is p = min(1, k w), with w the whole square root of its size; what is certain is always in."""
    docs = [(i, " ".join(["w"] * n), "a") for i, n in enumerate([4] * 4000 + [25] * 2000 + [100] * 400 + [40000] * 2)] + [(10000 + i, "w " * 40, "b") for i in range(2800)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    sizes = {d: len(t.split()) for d, t, s in docs if s == "a"}
    times = Counter()
    for seed in ("one", "two"):
        rows = mixing.mix(frame, seed=seed).where("source = 'a'").collect()
        whole = int(rows[0].target // rows[0].source_size)
        rest = rows[0].target - whole * rows[0].source_size
        times.update({r.doc_id: r.copies - whole for r in rows})
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 100
    low, high = 0.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1.0, mid * int(n**0.5)) * n for n in sizes.values()) < rest else (low, mid)
    for size in (4, 25, 100, 40000):
        own = [times[d] / 2 for d, n in sizes.items() if n == size]
        want = min(1.0, low * int(size**0.5))
        assert sum(own) / len(own) == pytest.approx(want, abs=0.02 if size < 100 else 0.06), size
    assert low * 200 > 1 and 0.02 < low * 2 < low * 10 < 1


def test_certain_documents_and_many_sources(spark, monkeypatch):
    """Weights that make some documents certain; and the same mix when the plan is too large to broadcast."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, "w " * 10, "s" if i < 400 else "t") for i in range(800)], "doc_id long, text string, source string")
    heavy = F.when(F.col("doc_id") % 8 == 0, 1000.0).when(F.col("doc_id") % 8 == 1, None).when(F.col("doc_id") % 8 == 2, -3.0).otherwise(1.0)
    rows = mixing.mix(frame, weights=(1, 3), weight=heavy).where("source = 's'").collect()
    assert sum(r.copies for r in rows) == 200 and all(r.copies == 1 for r in rows if r.doc_id % 8 == 0) and not any(r.copies for r in rows if r.doc_id % 8 in (1, 2))
    docs = docs_of(random.Random(6)) + [(5000 + i, "a b c", f"host {i}") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    one = Counter(map(tuple, mixing.mix(frame).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert Counter(map(tuple, mixing.mix(frame).collect())) == one


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(frame).count() == 0 and mixing.apply_mix(frame).count() == 0
    none = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(none).collect()] == [(0.0, 0), (0.0, 0)]
