import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from objekta.llm import phrase_dedup as p


def brute(docs, window=50):
    inf = float("inf")
    split = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    ids = [inf if d is None else d for d, _ in docs]
    least = defaultdict(lambda: inf)
    for d, w in zip(ids, split, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least[k], d)
    out = []
    for (d, _), i, w in zip(docs, ids, split, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "c", "日", "and", "the"] + [f"w{i}" for i in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [make(n) for n in (50, 51, 60, 75, 130, 49, 400)]
    docs = []
    for i in range(60):
        w = make(rng.choice([0, 10, 49, 50, 80, 300]))
        for s in rng.sample(shared, rng.randrange(0, 4)):
            a = rng.randrange(0, 6)
            at = rng.randrange(len(w) + 1)
            w[at:at] = s[a : len(s) - rng.randrange(0, 6)]
        docs.append((rng.randrange(100), rng.choice([" ", "\n", "\t  "]).join(w)))
    docs += [(200 + k, docs[k % 7][1]) for k in range(20)]
    docs += [(300, "And " * 200), (301, "x " + "And " * 120), (302, "a b " * 90), (303, "b a " * 60), (None, docs[3][1]), (None, " ".join(shared[4])), (None, None), (5, ""), (77, " ".join(make(20000) + shared[6]))]
    docs += [docs[0], docs[0]]
    return docs


@pytest.mark.parametrize("hot", [p.HOT, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(p, "HOT", hot)
    docs = corpus(hot)
    frame = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, digest int, passages string").repartition(5)
    want = brute(docs)
    assert sum(r[2] for r in want) > 1000
    assert sorted((tuple(r) for r in p.digest(frame).collect()), key=str) == want
    left = p.remove_passages(frame)
    assert left.columns == frame.columns
    got = sorted(((r.doc_id, len(re.findall("[^\x20\x09-\x0D]+", r.text or ""))) for r in left.collect()), key=str)
    assert got == sorted(((d, n - g) for d, n, g, _ in want), key=str)


def test_words_with_equal_hashes(spark):
    """w92673 and w99178 share the bits of their hashes that automata once went by."""
    rng = random.Random(7)
    docs, words = [], [f"w{i}" for i in range(100, 900)]
    for k, (a, b) in enumerate((("w92673", "w99178"), ("w99178", "w92673"))):
        for at in (0, 20, 49):
            passage = rng.sample(words, 49)
            docs += [(10 * len(docs) + k, " ".join(passage[:at] + [x] + passage[at:])) for x in (a, b)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in p.digest(frame).collect()), key=str)
    assert got == brute(docs) and sum(r[2] for r in got) == 0


def test_periodic_and_common_passages(spark, monkeypatch):
    """A text of a million words with one period, and one passage in many documents with different surroundings."""
    period = [f"p{i}" for i in range(60)]
    passage = [f"q{i}" for i in range(55)]
    docs = [(1, " ".join(period * 17000)), (2, " ".join(period * 3)), (3, " ".join(period[5:] + period[:5]))]
    docs += [(100 + i, " ".join([f"r{i}_{k}" for k in range(30)] + passage + [f"s{i}_{k}" for k in range(30)])) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for hot in (p.HOT, 20_000):
        monkeypatch.setattr(p, "HOT", hot)
        got = {r.doc_id: (r.n_words, r.n_removed) for r in p.digest(frame).collect()}
        assert got[1] == (1020000, 0) and got[2] == (180, 180) and got[3] == (60, 60) and got[100] == (115, 0)
        assert all(got[100 + i] == (115, 55) for i in range(1, 400))


def test_window_ranks():
    numbers = np.random.default_rng(3).integers(0, 2, 300)
    for n in (1, 2, 3, 5, 8, 50):
        ranks = p.window_ranks(numbers, n)
        of = {}
        assert len(ranks) == 301 - n
        assert len({(of.setdefault(tuple(numbers[i : i + n]), r), r) for i, r in enumerate(ranks.tolist())}) == len(of) == len(set(ranks.tolist()))
    assert len(p.window_ranks(numbers[:3], 4)) == 0


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert p.digest(frame).count() == 0


def test_sliding_minimum():
    g = np.random.default_rng(1).integers(0, 99, 200)
    for n in (1, 2, 3, 8, 41):
        assert p._sliding_min(g, n).tolist() == [int(g[i : i + n].min()) for i in range(len(g) - n + 1)]
