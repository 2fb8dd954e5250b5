import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from objekta.llm import simhash
from objekta.llm.components import connected_components


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(4, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if hs and sum(h >> b & 1 for h in hs) * 2 > len(hs))


def union(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    return [root(x) for x in range(n)]


def brute_sets(values):
    v = np.array(values, dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4)]
    return union(len(v), pairs)


def test_documents_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["alpha", "Bêta", "gamma", "delta", "eps", "zeta", "ETA", "theta"] + [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 60, 400]))]
        docs.append((i, " ".join(w)))
        for k in range(rng.choice([0, 1, 3])):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "changed"
            docs.append((1000 + len(docs), "\n".join(v)))
    docs += [(500, None), (501, ""), (502, " \t"), (None, docs[0][1]), (None, "all on its own here"), (7, "another text with a used id"), (2000, " ".join(rng.choice(vocabulary) for _ in range(30000)))]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, fp int, copy_of_another int")
    fps = [fingerprint(t) for _, t in docs]
    sets = brute_sets(fps)
    least = {}
    for (d, _), s in zip(docs, sets, strict=True):
        least[s] = min([x for x in (least.get(s), d) if x is not None], default=None)
    want = sorted([(d, f"{f:016x}", least[s]) for (d, _), f, s in zip(docs, fps, sets, strict=True)], key=str)
    assert sorted([tuple(r) for r in simhash.components(frame).collect()], key=str) == want
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    gone = {d for d, _, c in want if d is not None and d != c}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in gone)
    assert simhash.components(frame.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(8)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6))
    rows = [(1, a), (2, a), (None, a), (None, a), (3, b), (3, b), (4, b), (5, a), (5, c), (None, d), (None, d), (6, e), (6, e.replace(" ", "\n")), (7, f), (7, a), (8, None), (8, ""), (None, None)]
    frame = spark.createDataFrame([(x, t, k) for k, (x, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(4)
    kept = simhash.deduplicate(frame, nameless=False)
    assert kept.schema == frame.schema
    place = lambda r: (r.doc_id, " ".join((r.text or "").split()))
    got = sorted(map(place, kept.collect()), key=str)
    assert got == sorted([(1, a), (3, b), (5, c), (None, d), (6, e), (7, f), (8, "")], key=str)
    got = sorted(map(place, simhash.deduplicate(frame).collect()), key=str)
    assert got == sorted([(1, a), (3, b), (5, c), (6, e), (7, f), (8, "")] + [(x, t or "") for x, t in rows if x is None], key=str)
    assert simhash.deduplicate(frame.limit(0), nameless=False).count() == 0


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    for centre in [rng.getrandbits(64) for _ in range(6)]:
        for _ in range(300):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            values.add(x)
    one = rng.getrandbits(64)
    for b in rng.sample(range(64), 40):  # a chain: each differs from the last in 4 bits at most
        one ^= 1 << b
        values.add(one)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(5)
    for large in (simhash.LARGE, 70, 7, 1):
        check_links(values, signed, simhash.links(frame, large).collect())


def check_links(values, signed, got):
    place = {v: i for i, v in enumerate(signed)}
    assert all((r.a ^ r.b).bit_count() <= 4 or bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in got)
    same = union(len(values), [(place[r.a], place[r.b]) for r in got])
    want = brute_sets(values)
    assert len(set(zip(same, want, strict=True))) == len(set(want)) == len(set(same))


def test_keys_over_batches():
    """Whatever a batch ends with, and whether a key is held or passed on: all rows of large keys come out once, and links connect what is near."""
    rng = random.Random(9)
    rows = []
    for key in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30])):
            rows.append((1, key, centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), True))
    rows = sorted(set(rows))
    for size in (1, 2, 3, 10, 1000):
        for large in (1, 4, 100):
            batches = []
            for a in range(0, len(rows), size):
                start, key, fp, base = zip(*rows[a : a + size], strict=True)
                batches.append(pa.RecordBatch.from_arrays([pa.array(start, pa.int8()), pa.array(key, pa.int64()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(base)], ["start", "key", "fp", "base"]))
            out = [r for b in simhash._linker(large)(iter(batches)) for r in b.to_pylist()]
            sizes = {k: sum(r[1] == k for r in rows) for k in range(12)}
            passed = sorted((r["key"], r["a"] % 2**64) for r in out if r["start"] is not None)
            assert passed == sorted((k, f) for _, k, f, _ in rows if sizes[k] > large)
            small = [r for r in rows if sizes[r[1]] <= large]
            place = {r[2]: i for i, r in enumerate(small)}
            same = union(len(small), [(place[r["a"] % 2**64], place[r["b"] % 2**64]) for r in out if r["start"] is None and r["a"] % 2**64 in place and r["b"] % 2**64 in place])
            if large == 100:
                want = union(len(small), [(i, j) for i in range(len(small)) for j in range(i) if small[i][1] == small[j][1] and bool(simhash._near(np.array([small[i][2]], dtype=np.uint64), np.array([small[j][2]], dtype=np.uint64), np.array([1]))[0])])
                assert len(set(zip(same, want, strict=True))) == len(set(want)) == len(set(same))


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000), (None, 3), (1001, 1049)]
    edges += [(rng.randrange(6000, 6300), rng.randrange(6000, 6300)) for _ in range(150)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    place = {v: i for i, v in enumerate(nodes)}
    sets = union(len(nodes), [(place[a], place[b]) for a, b in edges if None not in (a, b) and a != b])
    least = {}
    for v, s in zip(nodes, sets, strict=True):
        least.setdefault(s, v)
    assert got == {v: least[s] for v, s in zip(nodes, sets, strict=True)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
